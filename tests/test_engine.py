import hashlib
import json

import pytest
from framewise import config, schemas
from framewise.encoders import DeterministicEncoder
from framewise.engine import Engine, Rejected
from framewise.sources import files
from framewise.streaming.snapshots import event_stream, sync_once, sync_stream
from pyspark.sql import functions as F


IDS = ["0" * 15 + c for c in "abc"]


def _shots(spark, enc, lines):
    rows = []
    for i, line in enumerate(lines):
        v = enc.visual([line])[0].tolist()
        rows.append(("", i, i, float(i), i + 1.0, line, line, line, True, ["Skagen"] if "skagen" in line else [], [], "", f"a {line.split()[1]} scene", 1.0, v, v, True, v))
    return spark.createDataFrame(rows, schemas.SHOTS)


def test_search_end_to_end(spark, tmp_path):
    enc = DeterministicEncoder(16)
    lines = ["the ferry to skagen leaves", "a quiet harbour at night", "gulls over the old mill", "rain falls on the pier"]
    engine = Engine(spark, str(tmp_path), enc, size=16)
    assert engine.search("skagen").collect() == [] and engine.footage().collect() == []
    assert engine.save(IDS[0], _shots(spark, enc, lines))["shot_count"] == 4
    Engine(spark, str(tmp_path), enc, config.Settings(max_shot_sec=5.0), size=16).save(IDS[1], _shots(spark, enc, lines))
    assert [r.content_id for r in engine.ready_contents().collect()] == [IDS[0]]
    assert [engine.index_state(c) for c in IDS] == ["ready", "stale", None]
    found = engine.search("Skagen rain", 3).collect()
    assert found and abs(sum(found[0].contributions.asDict().values()) - found[0].score) < 1e-9
    assert found[0].contributions.entity in (0.0, 0.1) and any(r.contributions.entity > 0 for r in found)
    answer = engine.answer("SKAGEN")
    assert answer["entities"] == ["Skagen"] and len(answer["results"]) == len(engine.search("SKAGEN").collect()) and answer["took_ms"] >= 0
    assert engine.search("skagen", 3, "f" * 16).collect() == [] == engine.search("skagen", 3, IDS[1]).collect()
    assert engine.corpus(f"{IDS[0]},{IDS[0]}").shots.count() == 8
    with pytest.raises(ValueError):
        engine.search("x", 51)


def test_indexing_anew_replaces_and_is_seen(spark, tmp_path):
    enc, now = DeterministicEncoder(16), iter(range(100))
    engine = Engine(spark, str(tmp_path), enc, size=16, clock=lambda: float(next(now)))
    engine.save(IDS[0], _shots(spark, enc, ["the ferry leaves", "a quiet harbour"]))
    engine.save(IDS[2], _shots(spark, enc, ["an old mill"]))
    assert engine.corpus().shots.count() == 3
    for _ in range(2):
        engine.save(IDS[0], _shots(spark, enc, ["one new line"]))
    assert sorted(r.dialogue_en for r in engine.corpus().shots.collect()) == ["an old mill", "one new line"]
    assert engine.ready_contents().count() == 2


def test_vectors_of_texts(spark, tmp_path):
    enc = DeterministicEncoder(16)
    engine = Engine(spark, str(tmp_path), enc, size=16)
    lines = ["the ferry leaves", "a quiet harbour", "gulls over the mill"]
    rows = engine.embedded(_shots(spark, enc, lines).withColumn("caption", F.when(F.col("shot_id") > 0, F.col("caption")))).orderBy("shot_id").collect()
    assert [r.d for r in rows] == [v.tolist() for v in enc.text(lines)]
    assert [r.c for r in rows] == [v.tolist() for v in enc.text(["", *(f"a {x.split()[1]} scene" for x in lines[1:])])]
    assert engine.embedded(_shots(spark, enc, [])).collect() == []


def test_builds_are_kept_apart(spark, tmp_path):
    """A build that was stopped before its contents were written is never read, and goes with the next one; two builds of one
    second are told apart."""
    enc = DeterministicEncoder(16)
    engine = Engine(spark, str(tmp_path), enc, size=16, clock=lambda: 5.0)
    engine.save(IDS[0], _shots(spark, enc, ["the ferry leaves", "a quiet harbour"]))
    before = engine.corpus()
    torn = _shots(spark, enc, ["never seen"]).selectExpr("*", "0L AS row", "'torn' AS build").drop("content_id").selectExpr("*", f"'{IDS[0]}' AS content_id")
    torn.write.mode("append").partitionBy("content_id", "build").parquet(str(tmp_path / "shots"))
    assert engine.corpus() is before and sorted(r.dialogue_en for r in engine.corpus().shots.collect()) == ["a quiet harbour", "the ferry leaves"]
    engine.save(IDS[0], _shots(spark, enc, ["gulls over the mill", "rain falls on the pier", "a quiet harbour"]))
    assert engine.corpus() is not before and engine.search("gulls").first().transcript == "gulls over the mill"
    for name in files.INDEX:
        assert len([p for p in (tmp_path / name / f"content_id={IDS[0]}").iterdir() if p.name.startswith("build=")]) == 1


def test_results_with_owners(spark, tmp_path):
    enc = DeterministicEncoder(16)
    engine = Engine(spark, str(tmp_path), enc, size=16)
    assert engine.find("skagen").collect() == []
    for c in IDS[:2]:
        engine.save(c, _shots(spark, enc, [f"the ferry to skagen {i} leaves" for i in range(8)]))
    engine.save(IDS[2], _shots(spark, enc, ["the skagen nobody owns"]))
    row = lambda key, content, state: (key, f"/takes/{key}", content, 1, 1, 1, 25.0, 2, state, 1, 1.0, None, None, None)
    registry = [row("b", IDS[0], "ready"), row("a", IDS[0], "ready"), row("c", IDS[1], "ready"), row("d", IDS[2], "stale")]
    engine._registry.replace(spark.createDataFrame(registry, schemas.REGISTRY))
    found = engine.find("skagen ferry").collect()
    assert len(found) == 9 and {(r.content_id, r.footage_key, r.source_path) for r in found} == {(IDS[0], "a", "/takes/a"), (IDS[1], "c", "/takes/c")}
    assert [r.score for r in found] == sorted((r.score for r in found), reverse=True)
    assert {r.footage_key for r in engine.find("skagen", 50, ["b", "d"]).collect()} == {"b"} and engine.find("skagen", 50, ["d"]).collect() == []


def test_cancel_and_retry(spark, tmp_path):
    engine = Engine(spark, str(tmp_path), DeterministicEncoder(16), size=16)
    engine._needs_source = lambda cid: False
    first = engine.index(IDS[0])["job_id"]
    assert engine.cancel(first)["state"] == "cancelled" and engine.run_next(lambda c, r: {}) is None
    with pytest.raises(Rejected, match="NOT_CANCELLABLE"):
        engine.cancel(first)
    again = engine.retry(first)
    assert again["state"] == "queued" and again["job_id"] != first and engine.retry(first) == again
    for call in (engine.cancel, engine.retry, engine.retry_footage):
        with pytest.raises(Rejected, match="NOT_FOUND"):
            call("unheard")


def test_uploads(spark, tmp_path):
    engine = Engine(spark, str(tmp_path), DeterministicEncoder(4))
    data = bytes(i % 251 for i in range(9 << 20))
    cid = hashlib.sha1(str(len(data)).encode() + data[: 4 << 20] + data[-(4 << 20) :]).hexdigest()[:16]
    assert engine.library(cid)["state"] == "missing" and engine.library(cid)["needs_upload"]
    with pytest.raises(Rejected, match="SOURCE_MISSING"):
        engine.index(cid)
    cuts, n = [0, 3 << 20, 5 << 20, 9 << 20], len(data)
    engine.upload(cid, 0, n, "pier.MOV", data[: cuts[1]])
    for offset, size, chunk, code in ((0, n, b"x", "OFFSET_MISMATCH"), (cuts[2], n, b"x", "OFFSET_MISMATCH"), (cuts[1], n + 1, b"x", "CONTENT_MISMATCH"), (cuts[1], n, data, "CONTENT_MISMATCH")):
        with pytest.raises(Rejected) as refused:
            engine.upload(cid, offset, size, "", chunk)
        assert refused.value.code == code and (code != "OFFSET_MISMATCH" or refused.value.received == cuts[1])
    assert engine.library(cid)["state"] == "partial"
    for a, b in zip(cuts[1:], cuts[2:]):
        state = engine.upload(cid, a, n, "", data[a:b])
    assert state == {"content_id": cid, "received": n, "size": n, "complete": True} == engine.upload(cid, 0, n, "", b"again")
    assert engine.library(cid)["state"] == "uploaded"
    with pytest.raises(Rejected, match="CONTENT_MISMATCH"):
        engine.upload("0" * 16, 0, 3, "", b"abc")
    assert engine.upload_state("0" * 16)["received"] == 0
    for bad in ("../x", "A" * 16, "0" * 15):
        with pytest.raises(Rejected, match="BAD_CONTENT_ID"):
            engine.upload_state(bad)
    engine.purge(cid)
    assert engine.library(cid)["state"] == "missing"


def test_jobs(spark, tmp_path):
    now = iter(range(100))
    engine = Engine(spark, str(tmp_path), DeterministicEncoder(16), size=16, clock=lambda: float(next(now)))
    engine._needs_source = lambda cid: False
    first, second = engine.index(IDS[0]), engine.index(IDS[1])
    assert first["state"] == "queued" and engine.index(IDS[0]) == first and engine.library(IDS[0])["state"] == "indexing"

    def good(cid, report):
        report.progress("shots", 3, 7)
        assert engine.job(first["job_id"])["stages"][0] == {"name": "shots", "state": "running", "done": 3, "total": 7}
        report.done("shots")
        report.progress("unheard", 1, 1)
        return engine.save(cid, _shots(spark, engine.encoder, ["one line"]), duration=9.0)

    def bad(cid, report):
        report.progress("visual", 1, 2)
        raise RuntimeError("y" * 900)

    done, failed = engine.run_next(good), engine.run_next(bad)
    assert (done["state"], done["shot_count"], done["duration_s"], done["stages"][0]["done"]) == ("done", 1, 9.0, 7) and {s["state"] for s in done["stages"]} == {"done"}
    assert failed["job_id"] == second["job_id"] and failed["state"] == "error" and len(failed["error"]) == 500 and failed["stages"][1]["state"] == "error"
    assert engine.run_next(good) is None
    assert engine.index(IDS[0]) == {"job_id": None, "state": "done"} and [engine.library(c)["state"] for c in IDS[:2]] == ["ready", "error"]
    third = engine.index(IDS[1])
    stored = engine.job(third["job_id"])
    stored["state"], stored["stages"][2]["state"], stored["stages"][2]["done"] = "running", "running", 5
    engine._save(stored)
    engine.store.write("jobs/torn.json", b"{")
    engine.store.write_json("jobs/other.json", {"job_id": "not this"})
    assert engine.recover() == 1 and engine.job(third["job_id"])["stages"][2] == {"name": "transcribe", "state": "pending", "done": 5, "total": 0}
    assert [r.job_id for r in files.read_jobs(spark, f"{tmp_path}/jobs").collect()] == [first["job_id"], second["job_id"], third["job_id"]]


def test_thumbnails_and_files(spark, tmp_path):
    now = iter(range(100))
    engine = Engine(spark, str(tmp_path / "e"), DeterministicEncoder(16), size=16, clock=lambda: float(next(now)))
    engine.save(IDS[0], _shots(spark, engine.encoder, ["one line"]))
    for n in (10, 2):
        engine.save_thumbnail(IDS[0], n, b"jpg%d" % n)
    assert list(files.unpacked(engine.thumbnails(IDS[0]))) == [("10.jpg", b"jpg10"), ("2.jpg", b"jpg2")]
    engine.save_thumbnail(IDS[0], 3, b"late")
    assert len(list(files.unpacked(engine.thumbnails(IDS[0])))) == 2  # the index has not changed
    engine.save(IDS[0], _shots(spark, engine.encoder, ["one line"]))
    assert len(list(files.unpacked(engine.thumbnails(IDS[0])))) == 3
    sly = files.packed([("../1.jpg", b"x"), ("a/1.jpg", b"x"), ("1.png", b"x"), ("12345678.jpg", b"x"), ("7.jpg", b"ok")])
    assert list(files.unpacked(sly)) == [("7.jpg", b"ok")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "pier.mov").write_bytes(b"frames")
    found = files.contents_of(spark, str(tmp_path / "in")).first()
    assert (found["size"], found.content_id) == (6, hashlib.sha1(b"6frames").hexdigest()[:16])


def test_sync_and_quota(spark, tmp_path):
    engine = Engine(spark, str(tmp_path), DeterministicEncoder(4))
    snap = lambda n, size=10: spark.createDataFrame([(f"/takes/{i}", size, 5, i, None) for i in range(n)], schemas.SNAPSHOT)
    assert len(engine.sync(snap(3))["added"]) == 3 and engine.footage().count() == 3
    assert {r.state for r in engine.footage().collect()} == {"indexing"} and engine.registry().first().frame_rate == 25.0
    with pytest.raises(Rejected, match="QUOTA_EXCEEDED"):
        engine.sync(snap(4))
    assert engine.footage().count() == 3 and len(engine.sync(snap(4), "pro")["added"]) == 1
    assert len(engine.sync(snap(4))["unchanged"]) == 4  # nothing new, so over the plan it passes
    (tmp_path / "registry" / "change-torn").mkdir()
    (tmp_path / "registry" / "change-torn" / "part-0.parquet").write_bytes(b"torn")
    assert engine.footage().count() == 4 and len(engine.sync(snap(2), "pro")["removed"]) == 2


def test_stage_is_made_once(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    for deps in ({"a": 1}, {"a": 1}, {"a": 2}):
        assert files.stage(spark, str(tmp_path), "shots", deps, make).count() == 3
    assert len(calls) == 2
    for folder in (tmp_path / "stages").iterdir():
        (folder / "_SUCCESS").unlink()  # as a writer leaves it that was stopped
    assert files.stage(spark, str(tmp_path), "shots", {"a": 1}, make).count() == 3 and len(calls) == 3


def test_stream_equals_batch(spark, tmp_path):
    snaps = [[("a", 100, 5), ("b", 100, 5)], [("a", 100, 5), ("b", 999, 5)], [("b", 999, 5)]]
    folder = tmp_path / "in"
    folder.mkdir()
    for i, items in enumerate(snaps):
        (folder / f"{i}.json").write_text("".join(json.dumps({"path": p, "size": s, "mtime_ns": m, "item_id": 1, "frame_rate": 25.0, "seq": i}) + "\n" for p, s, m in items))
    sync_stream(event_stream(spark, str(folder)), str(tmp_path / "s"), str(tmp_path / "cp")).awaitTermination(120)
    for i, items in enumerate(snaps):
        sync_once(spark, str(tmp_path / "b"), i, spark.createDataFrame([(p, s, m, 1, 25.0) for p, s, m in items], schemas.SNAPSHOT))
    a, b = (sorted(map(str, files.read_registry(spark, f"{tmp_path}/{k}/registry/v=3").collect())) for k in "sb")
    assert a == b and len(a) == 2


def test_stream_goes_on_after_a_torn_version(spark, tmp_path):
    folder, root = tmp_path / "in", tmp_path / "s"
    folder.mkdir()
    line = lambda seq, path: json.dumps({"path": path, "size": 5, "mtime_ns": 5, "item_id": 1, "frame_rate": 25.0, "seq": seq}) + "\n"
    (folder / "0.json").write_text(line(0, "a"))
    (root / "registry" / "v=1").mkdir(parents=True)
    (root / "registry" / "v=1" / "part-0.parquet").write_bytes(b"torn")
    sync_stream(event_stream(spark, str(folder)), str(root), str(tmp_path / "cp")).awaitTermination(120)
    assert files.read_registry(spark, f"{root}/registry/v=1").count() == 1


def test_a_sync_writes_what_it_changed(spark, tmp_path):
    """One footage in a hundred drifts twice: both syncs write about a hundredth of the bytes, and the registry is that of whole rewrites."""
    from framewise.functions import text as T
    from framewise.operators import sync
    from framewise.sources.registry import Registry
    from pyspark.sql import functions as F

    registry = Registry(spark, str(tmp_path / "r"))
    assert registry.read().collect() == []
    snap = lambda size: spark.range(20_000).select(F.concat(F.lit("/takes/"), "id").alias("path"), F.when(F.col("id") % 100 == 7, size).otherwise(10).cast("long").alias("size"), F.lit(5).cast("long").alias("mtime_ns"), F.col("id").alias("item_id"), F.lit(25.0).alias("frame_rate")).withColumn("footage_key", T.footage_key(F.col("path")))
    empty = registry.read()
    registry.replace(sync.apply(snap(10), sync.diff(snap(10), empty), empty))
    size = lambda: sum(p.stat().st_size for p in (tmp_path / "r").rglob("*.parquet"))
    whole, plain = size(), registry.read().collect()
    for n in (1, 2):
        before = registry.read()
        assert registry.merge(sync.apply(snap(11), sync.diff(snap(11), before), before), before) == 200
        assert len(registry.manifest()["changes"]) == n and size() - whole < 0.03 * n * whole
        old = spark.createDataFrame(plain, schemas.REGISTRY)
        plain = sync.apply(snap(11), sync.diff(snap(11), old), old).collect()
        assert sorted(map(str, registry.read().collect())) == sorted(map(str, plain))
    before = registry.read()
    assert registry.merge(before, before) == 0 and len(registry.manifest()["changes"]) == 2
    (tmp_path / "r" / "change-torn").mkdir()
    assert registry.merge(before.withColumn("item_id", F.lit(-1).cast("long")), before) == 20_000  # as much as the base: a new base
    assert registry.manifest()["changes"] == [] and len([p for p in (tmp_path / "r").iterdir() if p.is_dir()]) == 1
    assert registry.read().filter("item_id = -1").count() == 20_000
