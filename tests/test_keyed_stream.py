"""The keyed stream against the batch sync, snapshot by snapshot, over a restart."""

import json
import random

import pytest
from framewise import schemas
from framewise.functions import text as T
from framewise.operators import sync
from framewise.streaming import keyed
from framewise.streaming.snapshots import event_stream
from pyspark.sql import functions as F


def _snapshots(rng, n):
    """Some of twelve footages in each snapshot, with sizes that drift, come back, or cannot be read."""
    return [[(f"/takes/{i}", rng.choice([100, 100, 200, -1]), rng.choice([5, 5, 9])) for i in range(12) if rng.random() < 0.75] for _ in range(n)]


@pytest.fixture
def partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # each partition of keyed state takes a worker of its own
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def _write(folder, name, rows):
    (folder / name).write_text("".join(json.dumps({"path": p, "size": s, "mtime_ns": m, "item_id": 1, "frame_rate": 25.0, "seq": q}) + "\n" for q, p, s, m in rows))


def test_stream_equals_batch_and_survives_a_restart(spark, tmp_path, partitions):
    rng = random.Random(11)
    snaps = _snapshots(rng, 5)
    expected, states = spark.createDataFrame([], schemas.REGISTRY), []
    for items in snaps:
        snap = spark.createDataFrame([(p, s, m, 1, 25.0) for p, s, m in items], schemas.SNAPSHOT).withColumn("footage_key", T.footage_key(F.col("path")))
        buckets = {r.footage_key: r.bucket for r in sync.diff(snap, expected).collect()}
        after = sync.apply(snap, sync.diff(snap, expected), expected)
        rows = after.collect()
        expected = spark.createDataFrame(rows, schemas.REGISTRY)
        states.append((sorted(map(str, rows)), buckets))
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    folder.mkdir()
    stream = lambda: keyed.keyed_stream(event_stream(spark, str(folder)), out, checkpoint)
    first = [(q, *x) for q, items in enumerate(snaps[:3]) for x in items]
    rng.shuffle(first)  # a batch may hold several snapshots, in any order
    _write(folder, "0.json", first)
    stream().awaitTermination(120)
    _write(folder, "1.json", [(q, *x) for q, items in enumerate(snaps[3:], 3) for x in reversed(items)])
    stream().awaitTermination(120)  # from its checkpoint
    seen = spark.read.parquet(out).persist()
    for q, (rows, buckets) in enumerate(states):
        found = keyed.registry_at(seen, q)
        assert sorted(map(str, found.select(*schemas.REGISTRY.names).collect())) == rows, q
        assert {r.footage_key: r.bucket for r in seen.filter(F.col("seq") == q).collect()} == {k: b for k, b in buckets.items() if b != "removed"}


def test_one_footage():
    seen = lambda seq, size=10, mtime=5: {"path": "p", "size": size, "mtime_ns": mtime, "item_id": 1, "frame_rate": 25.0, "seq": seq}
    assert keyed.advanced(None, seen(0, -1)) == (None, "pending")
    entry, bucket = keyed.advanced(None, seen(0))
    assert bucket == "added" and entry["state"] == "indexing"
    assert keyed.advanced(entry, seen(1))[1] == "unchanged" and keyed.advanced(entry, seen(2))[1] == "added"
    drift, bucket = keyed.advanced(entry, seen(1, 11))
    assert bucket == "pending" and drift["pending_hits"] == 1 and keyed.advanced(drift, seen(2, 11))[1] == "changed" and keyed.advanced(drift, seen(2, 12))[1] == "pending"
