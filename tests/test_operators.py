import numpy as np
import pytest
from framewise import config
from framewise.functions import text as T
from framewise.functions import vectors as V
from framewise.operators import build, captions, entities, fusion, intervals, jobs, sync
from framewise.operators.corpus import Corpus
from pyspark.sql import functions as F


def test_fusion_against_numpy(spark):
    rng = np.random.default_rng(7)
    n, size = 40, 8
    unit = lambda m: (m / np.linalg.norm(m, axis=-1, keepdims=True)).astype(np.float32)
    v, dd, c = (unit(rng.standard_normal((n, size))) for _ in range(3))
    mask, conf = rng.random(n) > 0.3, rng.uniform(0.5, 1.0, n)
    vocab = ["harbour", "boat", "odense", "skagen", "gull", "tide"]
    toks = [[vocab[k] for k in rng.integers(0, 6, 4)] for _ in range(n)]
    ents = [[w.title() for w in t if w in ("odense", "skagen")] for t in toks]
    rows = [(i, f"c{i // 20}", i % 20 // 2, toks[i], " ".join(toks[i]), "", ents[i], v[i].tolist(), dd[i].tolist(), bool(mask[i]), c[i].tolist(), float(conf[i])) for i in range(n)]
    shots = spark.createDataFrame(rows, "row long, content_id string, scene_id int, tokens array<string>, dialogue_en string, ocr_text string, entities array<string>, v array<float>, d array<float>, d_mask boolean, c array<float>, caption_conf double")
    qv, qt = unit(rng.standard_normal(size)), unit(rng.standard_normal(size))
    query = ["harbour", "boat", "skagen", "skagen"]
    z = lambda x, base=None: np.clip((x - (base if base is not None else x).mean()) / (base if base is not None else x).std(), 0, 3) / 3
    hit = np.array(["Skagen" in e for e in ents])
    center = unit(v[hit].mean(0, dtype=np.float64))
    df = {w: sum(w in t for t in toks) for w in vocab}
    raw = {w: np.log(n - k + 0.5) - np.log(k + 0.5) for w, k in df.items()}
    idf = {w: x if x >= 0 else 0.25 * np.mean(list(raw.values())) for w, x in raw.items()}
    bm = np.array([sum(idf[q] * t.count(q) * 2.5 / (t.count(q) + 1.5) for q in query if q in t) for t in toks])
    bm = bm / bm.max() if bm.max() > 0 else 0 * bm
    dia = dd.astype(np.float64) @ qt
    score = 0.35 * z(v @ qv) + 0.25 * np.where(mask, z(dia, dia[mask]), 0) + 0.15 * z(c @ qt) * conf + 0.15 * bm + 0.1 * hit + 0.05 * z(v @ center)
    best, seen = [], set()
    for i in np.argsort(-score, kind="stable"):
        if score[i] > 0 and (i // 20, i % 20 // 2) not in seen:
            seen.add((i // 20, i % 20 // 2))
            best.append((int(i), score[i]))
    ask = lambda **k: fusion.rank(shots, query, ["skagen"], V.literal(qv), V.literal(qt), size, top_k=6, **k).collect()
    got = ask()
    assert [r.row for r in got] == [i for i, _ in best[:6]]
    assert [r.score for r in got] == pytest.approx([s for _, s in best[:6]], abs=1e-5)
    assert all(abs(sum(r[f"w_{k}"] for k in fusion.COMPONENTS) - r.score) < 1e-9 and (r.dialogue_raw is None) == (not mask[r.row]) for r in got)
    assert [(r.row, r.score) for r in ask(exhaustive=False)] == [(r.row, r.score) for r in got]  # the candidates hold all rows
    corpus = Corpus(shots)
    for keys, terms in ((["skagen"], query), ([], query), (["skagen", "nowhere"], ["unheard"]), ([], [])):
        for more in ({}, {"exhaustive": False, "settings": config.Settings(candidates=3)}, {"settings": config.Settings(dedupe_scenes=False, zscore_cap=1.0)}):
            plain = fusion.rank(shots, terms, keys, V.literal(qv), V.literal(qt), size, top_k=9, **more).collect()
            packed = corpus.hits(terms, keys, qv, qt, top_k=9, **more).collect()
            assert [r.row for r in packed] == [r.row for r in plain]
            for a, b in zip(packed, plain, strict=True):
                assert a.asDict() == pytest.approx({k: b[k] for k in a.asDict()}, abs=1e-5)
    scored = fusion.scored_shots(shots, query, ["skagen"], V.literal(qv), V.literal(qt), size)
    assert {r.row for r in corpus.candidates(query, ["skagen"], qv, qt, 4).collect()} == {r.row for r in fusion.candidates(scored, V.literal(qv), V.literal(qt), 4).collect()}
    assert [r.score for r in corpus.rank(query, ["skagen"], qv, qt, top_k=3).collect()] == pytest.approx([r.score for r in got[:3]], abs=1e-5)
    corpus.close()
    assert Corpus(shots.limit(0)).hits(query, ["skagen"], qv, qt).collect() == []


def test_postings_of_texts_and_of_tokens(spark):
    from framewise.operators import lexical

    texts = ["Gulls over the harbour, gulls!", "", None, "大阪城 harbour 7", "the of and", "mill " * 30, "Harbour mill"]
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    tokens = docs.withColumn("tokens", T.tokenize(F.col("text")))
    plain, direct = lexical.postings(tokens), lexical.postings_of_text(docs)
    key = lambda rows: sorted((r.row, r.term, r.tf, r.dl) for r in rows)
    assert key(plain.collect()) == key(direct.join(lexical.lengths(direct), "row").collect())
    stats = lexical.statistics(tokens)
    assert tuple(stats.first()) == pytest.approx(tuple(lexical.statistics_of_postings(docs, direct).first()))
    query = spark.createDataFrame([(1, "harbour"), (1, "mill"), (1, "mill"), (2, "unheard"), (3, "大阪")], "query_id int, term string")
    found = [{(r.query_id, r.row): r.bm25 for r in lexical.scores(p, stats, lexical.inverse_frequencies(p, stats), query).collect()} for p in (plain, direct)]
    assert found[0] == pytest.approx(found[1]) and set(found[0]) == {(1, 0), (1, 3), (1, 5), (1, 6), (3, 3)}


def test_blocks_of_postings(spark):
    """The k best rows equal those of the exhaustive scores, ties included, from less than half of the entries."""
    import random

    from framewise.operators import lexical

    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(words[: rng.choice([20, 400])]) for _ in range(n))
    texts = [text(rng.randint(1, 60)) for _ in range(1_500)]
    texts[700:720] = ["w399 w398 w397"] * 20  # equal scores, over the bounds of blocks
    docs = spark.createDataFrame([(3 * i, t) for i, t in enumerate(texts)], "row long, text string")
    queries = [(0, ["w399", "w398", "w397"]), (1, ["w5", "w300", "w300", "unheard"]), (2, ["w301", "w302"]), (3, ["unheard"]), (4, ["w1", "w2", "w3"])]
    query = spark.createDataFrame([(q, t) for q, ts in queries for t in ts], "query_id int, term string")
    post = lexical.postings_of_text(docs).persist()
    stats = lexical.statistics_of_postings(docs, post)
    idf, index = lexical.inverse_frequencies(post, stats), lexical.block_postings(post, stats).persist()
    every = {}
    for r in lexical.normalised(lexical.scores(post, stats, idf, query)).collect():
        every.setdefault(r.query_id, []).append((-round(r.bm25, 9), r.row))
    for k in (1, 5):
        best, pairs = lexical.best_scores(index, idf, query, k)
        found = {}
        for r in best.orderBy("place").collect():
            found.setdefault(r.query_id, []).append((-round(r.bm25, 9), r.row))
        assert found == {q: sorted(rows)[:k] for q, rows in every.items()}
        all_of = index.join(query.filter("query_id <> 4").distinct(), "term")  # words that all rows hold bound nothing
        read = all_of.join(pairs, ["query_id", "block"]).agg(F.sum(F.size("entries"))).first()[0]
        assert read < 0.5 * all_of.agg(F.sum(F.size("entries"))).first()[0]
    none = spark.createDataFrame([], "query_id int, term string")
    assert lexical.best_scores(index, idf, none, 3)[0].collect() == []


def test_fuzzy_and_query_entities(spark):
    keys = spark.createDataFrame([("odense", 0), ("lighthouse", 1), ("river mouth", 2), ("mill", 3)], "key string, pos int")
    terms = spark.createDataFrame([(t,) for t in ("odnese", "lihgthosue", "river muth", "mil", "mlil", "viborg")], "term string")
    assert {r.term: r.key for r in entities.corrected(terms, keys).collect()} == {"odnese": "odense", "lihgthosue": "lighthouse", "river muth": "river mouth", "mlil": "mill"}
    none = lambda texts: [[] for _ in texts]
    assert entities.query_entities("the ferry from odense", keys, none) == ["odense"]
    assert entities.query_entities("Lighthose by the river mouth", keys, none) == ["river mouth", "lighthouse"]
    assert entities.query_entities("Viborg", keys.limit(0), lambda ts: [["Viborg"], []]) == ["viborg"]


def test_split_merge_and_windows(spark):
    scenes = spark.createDataFrame([(0, 3.0, 28.0), (1, 28.0, 28.5), (2, 0.0, 16.0)], "s int, start double, end double")
    got = [(r.s, round(r.t0, 3), round(r.t1, 3)) for r in intervals.split_spans(scenes).orderBy("s", "part").collect()]
    assert got == [(0, 3, 9.25), (0, 9.25, 15.5), (0, 15.5, 21.75), (0, 21.75, 28), (1, 28, 28.5), (2, 0, 8), (2, 8, 16)]
    spans = spark.createDataFrame([("p", 4, 9, 0.2), ("p", 2, 3, 0.7), ("p", 3, 4, 0.6), ("p", 11, 12, 0.1), ("q", 3, 4, 0.5)], "k string, start int, end int, score double")
    assert sorted(map(tuple, intervals.merge_spans(spans, "k").collect())) == [("p", 2, 9, 0.7), ("p", 11, 12, 0.1), ("q", 3, 4, 0.5)]
    w = lambda *xs: [dict(word=x, start=s, end=e) for x, s, e in xs]
    segs = [("c", 0, 5.0, 7.0, "cast off now", w(("cast", 5.0, 5.5), ("off", 5.5, 6.0), ("now", 6.0, 7.0))), ("c", 1, 7.0, 9.0, " hard to port", w((" hard", 7.0, 7.6), (" to", 7.6, 8.0), (" port", 8.0, 9.0))), ("c", 2, 20.0, 21.0, "steady", None)]
    segments = spark.createDataFrame(segs, "content_id string, seg_id int, start double, end double, text string, words array<struct<word: string, start: double, end: double>>")
    wins = spark.createDataFrame([("c", 0, 5.7, 7.8), ("c", 1, 20.5, 30.0), ("c", 2, 9.0, 20.0)], "content_id string, shot_id int, t0 double, t1 double")
    assert {r.shot_id: r.said for r in intervals.text_in_window(wins, segments, "content_id", ("shot_id",), 3.0).collect()} == {0: "off now hard to", 1: "steady", 2: ""}


def test_propagate(spark):
    rows = [(0, [0.0, 1.0]), (1, [0.6, 0.8]), (2, [1.0, 0.0]), (3, [-1.0, 0.0]), (4, [0.8, -0.6])]
    shots = spark.createDataFrame(rows, "row long, v array<float>")
    reps = shots.filter("row in (0, 2)").selectExpr("row as rep", "v as rv")
    got = {r.row: (r.rep, round(r.confidence, 6)) for r in captions.propagate(shots, reps).collect()}
    assert got == {0: (0, 1.0), 1: (0, 0.8), 2: (2, 1.0), 3: (0, 0.0), 4: (2, 0.8)}


def _snapshot(spark, items):
    df = spark.createDataFrame([(p, s, m, 1, 25.0) for p, s, m in items], "path string, size long, mtime_ns long, item_id long, frame_rate double")
    return df.withColumn("footage_key", T.footage_key(F.col("path")))


def _step(spark, registry, items, version=2):
    snap = _snapshot(spark, items)
    buckets = sync.diff(snap, registry, version=version)
    after = sync.apply(snap, buckets, registry, version=version)
    named = {r.footage_key: r.path for r in registry.unionByName(after).select("footage_key", "path").collect()} | {r.footage_key: r.path for r in snap.collect()}
    return {named[r.footage_key]: r.bucket for r in buckets.collect()}, spark.createDataFrame(after.collect(), after.schema)


def test_sync_sequences(spark):
    from framewise.schemas import REGISTRY

    of = lambda path: reg.filter(F.col("path") == path).first()
    reg = spark.createDataFrame([], REGISTRY)
    b, reg = _step(spark, reg, [("pier.mov", 40, 3), ("mill.mov", 41, 3), ("late.mov", 0, 3)])
    assert b == {"pier.mov": "added", "mill.mov": "added", "late.mov": "pending"} and of("late.mov") is None
    b, reg = _step(spark, reg, [("pier.mov", 50, 3), ("late.mov", 42, 3)])
    assert b == {"pier.mov": "pending", "mill.mov": "removed", "late.mov": "added"}
    assert (of("pier.mov").size, of("pier.mov").pending_hits, of("mill.mov").state) == (40, 1, "stale")
    b, reg = _step(spark, reg, [("pier.mov", 60, 3), ("late.mov", -1, 0)])  # another size: the count begins anew
    assert b == {"pier.mov": "pending", "late.mov": "unchanged"} and of("pier.mov").pending_hits == 1
    b, reg = _step(spark, reg, [("pier.mov", 60, 3), ("mill.mov", 41, 3), ("late.mov", 42, 3)])
    assert b == {"pier.mov": "changed", "mill.mov": "added", "late.mov": "unchanged"} and of("pier.mov").size == 60
    b, reg = _step(spark, reg, [("pier.mov", 60, 3), ("mill.mov", 41, 3), ("late.mov", 42, 3)], version=7)
    assert set(b.values()) == {"changed"}


def test_upload_states(spark):
    rows = [
        ("whole", 1, 0, 4, 9), ("whole", 2, 4, 4, 9), ("whole", 3, 8, 1, 9), ("again", 1, 0, 5, 10), ("again", 2, 0, 5, 10), ("again", 3, 5, 5, 10), ("again", 4, 5, 5, 10),
        ("early", 1, 0, 3, 9), ("early", 2, 6, 3, 9), ("early", 3, 3, 3, 9), ("early", 4, 6, 3, 9), ("gap", 1, 0, 5, 20), ("gap", 2, 6, 5, 20), ("late", 1, 2, 5, 9),
        ("over", 1, 0, 6, 8), ("over", 2, 6, 3, 8), ("over", 3, 6, 2, 8), ("other", 1, 0, 4, 8), ("other", 2, 4, 4, 9), ("anew", 1, 0, 9, 8), ("anew", 2, 0, 3, 3),
    ]
    df = spark.createDataFrame(rows, "content_id string, seq int, offset long, length long, size long")
    want = {"whole": (9, 9, True), "again": (10, 10, True), "early": (9, 9, True), "gap": (5, 20, False), "late": (0, 0, False), "over": (8, 8, True), "other": (4, 8, False), "anew": (3, 3, True)}
    assert {r.content_id: (r.received, r.size, r.complete) for r in jobs.received(df).collect()} == want


def test_lifecycle(spark):
    e = lambda job, seq, kind, stage=None, done=None, total=None, error=None: (job, seq, kind, stage, done, total, error)
    events = [
        e("a", 1, "submit"), e("a", 2, "start"), e("a", 3, "progress", "cut", 2, 5), e("a", 4, "cancel"), e("a", 5, "stage_done", "cut"), e("a", 6, "progress", "read", 1, 0), e("a", 7, "finish"),
        e("b", 1, "submit"), e("b", 2, "cancel"), e("b", 3, "start"), e("c", 2, "start"), e("c", 1, "submit"), e("c", 3, "progress", "cut", 4, 9), e("c", 4, "fail", error="x" * 900),
        e("d", 1, "submit"), e("d", 2, "start"), e("d", 3, "progress", "read", 4, 9), e("d", 4, "restart"), e("d", 5, "finish"), e("d", 6, "progress", "unheard", 1, 1),
    ]
    df = spark.createDataFrame(events, "job_id string, seq int, kind string, stage string, done long, total long, error string")
    out = {r.job_id: (r.state, [tuple(s)[1:] for s in r.stages], r.error) for r in jobs.lifecycle(df, ("cut", "read")).collect()}
    assert out["a"] == ("done", [("done", 5, 5), ("done", 1, 0)], None)
    assert out["b"] == ("cancelled", [("pending", 0, 0)] * 2, "cancelled by user")
    assert out["c"] == ("error", [("error", 4, 9), ("pending", 0, 0)], "x" * 500)
    assert out["d"] == ("queued", [("pending", 0, 0), ("pending", 4, 9)], None)


def test_calls_and_handoff(spark):
    calls = [(1, ["TIMEOUT", "OK"]), (2, ["ASLEEP"] * 50), (3, ["TIMEOUT", "ASLEEP", "UNREACHABLE", "ASLEEP", "TIMEOUT", "OK"]), (4, []), (5, ["REFUSED", "TIMEOUT"])]
    df = spark.createDataFrame(calls, "k int, r array<string>").select("k", jobs.called(F.col("r"), 3).alias("o"))
    assert {r.k: r.o for r in df.collect()} == {1: "answered", 2: "waiting", 3: "failed", 4: "waiting", 5: "answered"}
    rows = [("ready", "j", True, 4), ("indexing", "j", True, 4), ("indexing", None, True, 4), ("partial", None, True, 4), ("missing", None, True, 0), ("uploaded", None, False, 9)]
    df = spark.createDataFrame(rows, "s string, j string, u boolean, r long").select(jobs.handed_off(F.col("s"), F.col("j"), F.col("u"), F.col("r")).alias("x"))
    assert [tuple(r.x) for r in df.collect()] == [("reuse", 0), ("attach", 0), ("upload", 0), ("upload", 4), ("upload", 0), ("index", 0)]


def test_entities_frames_and_cards(spark):
    texts = spark.createDataFrame([("t", "From Odense to  Skagen-Nord, by boat 9"), ("u", None)], "k string, text string")
    spans = spark.createDataFrame([("t", 5, 8, 0.9), ("t", 8, 11, 0.4), ("t", 16, 27, 0.61), ("t", 32, 36, 0.59), ("t", 37, 38, 0.99), ("t", None, 3, 0.9), ("u", 0, 4, 0.9)], "k string, start int, end int, score double")
    assert sorted(map(tuple, build.clean_entities(spans, texts, "k").collect())) == [("t", 0, "Odense"), ("t", 1, "Skagen-Nord")]
    tokens = F.array(*(F.struct(F.lit(t).alias("text"), F.lit(c).alias("conf")) for t, c in (("EXIT", 0.9), (" 4 ", 0.9), ("EXIT", 0.5), ("blur", 0.39), ("mole", 0.4))))
    row = spark.range(1).select(build.ocr_text(tokens, F.lit(0.02)).alias("a"), build.ocr_text(tokens, F.lit(0.019)).alias("b"), build.ocr_text(tokens, F.lit(None).cast("double")).alias("c")).first()
    assert tuple(row) == ("EXIT mole", "", "")
    rng = np.random.default_rng(4)
    images = [rng.integers(0, 256, shape).tolist() for shape in ((5, 7), (1, 4), (3, 1), (1, 1))]
    got = [r.s for r in spark.createDataFrame([(i, x) for i, x in enumerate([*images, [], None])], "i int, p array<array<int>>").select("i", build.sharpness(F.col("p")).alias("s")).orderBy("i").collect()]

    def laplacian(image):
        h, w = len(image), len(image[0])
        at = lambda y, x: image[0 if h == 1 else abs(y) if y < h else 2 * h - 2 - y][0 if w == 1 else abs(x) if x < w else 2 * w - 2 - x]
        return np.var([at(y - 1, x) + at(y + 1, x) + at(y, x - 1) + at(y, x + 1) - 4 * image[y][x] for y in range(h) for x in range(w)])

    assert got[:4] == pytest.approx([laplacian(i) for i in images]) and got[4:] == [None, None]
    frames = spark.createDataFrame([("c", 0, 0, 2.0), ("c", 0, 1, 5.0), ("c", 0, 2, 5.0), ("c", 1, 0, None)], "content_id string, shot_id int, frame int, sharpness double")
    assert [tuple(r) for r in build.keyframes(frames).collect()] == [("c", 0, 1)]
    cards = spark.createDataFrame([("a", "b", 1.0, 3.26), ("", "b", 5.0, 3.0), (None, None, 0.0, 0.0)], "caption string, transcript string, start_s double, end_s double")
    assert [(r.card, r.seconds) for r in build.cards(cards).collect()] == [("a", "2.3"), ("b", "0.0"), ("", "0.0")]


def test_edges_and_captions(spark):
    from framewise.encoders import captioned

    step = np.zeros((6, 8))
    step[:, 4:] = 90
    assert build.edges(step, 100, 200).sum(1).tolist() == [1] * 6  # one column, where the step is
    assert not build.edges(step / 4, 100, 200).any() and not build.edges(np.full((5, 5), 9.0), 100, 200).any()
    assert build.edges(step.T, 100, 200).sum(0).tolist() == [1] * 6
    fading = np.zeros((12, 8))
    fading[:, 4:] = np.linspace(20, 90, 12)[:, None]  # the weak part of an edge counts where it is joined to a strong one
    whole, strong = build.edges(fading, 100, 200).sum(), build.edges(fading, 200, 200).sum()
    assert 0 < strong < whole
    frames = spark.createDataFrame([(0, step.astype(int).tolist()), (1, []), (2, None)], "i int, p array<array<int>>")
    assert [r.e for r in frames.select("i", build.edge_fraction(F.col("p")).alias("e")).orderBy("i").collect()] == [6 / 48, 0.0, None]
    names = spark.createDataFrame([("pier",), (None,), ("",)], "n string").select(captioned(F.col("n"), lambda: lambda x: x.upper()).alias("c"))
    assert [r.c for r in names.collect()] == ["PIER", "", ""]


def test_shot_rows(spark):
    shots = spark.createDataFrame([("c", 0, 0.0, 4.0), ("c", 1, 30.0, 34.0)], "content_id string, shot_id int, start_time double, end_time double")
    contents = spark.createDataFrame([("c", "da")], "content_id string, language string")
    segs = [("c", t, i, s, e, x, None) for t, i, s, e, x in (("en", 0, 1.0, 3.0, "the ferry leaves Skagen"), ("en", 1, 7.0, 9.0, "at noon"), ("src", 0, 1.0, 3.0, "faergen sejler"), ("src", 1, 7.0, 9.0, "klokken tolv"))]
    segments = spark.createDataFrame(segs, "content_id string, track string, seg_id int, start double, end double, text string, words array<struct<word: string, start: double, end: double>>")
    said = spark.createDataFrame([("c", 0, 0, "Skagen"), ("c", 1, 0, "noon Bell")], "content_id string, seg_id int, pos int, entity string")
    read = spark.createDataFrame([("c", 0, 0, "SKAGEN"), ("c", 0, 1, "Skagen"), ("c", 1, 0, "PIER")], "content_id string, shot_id int, pos int, entity string")
    out = {r.shot_id: tuple(r)[2:] for r in build.shot_rows(shots, contents, segments, said, read).collect()}
    # the second segment only touches the wider window: its entity counts, its words do not
    assert out[0] == ("faergen sejler", "the ferry leaves Skagen", "faergen sejler", True, ["Skagen", "noon Bell"])
    assert out[1] == ("", "", "", False, ["PIER"])


def test_order_of_contents(spark):
    ids = [f"{n:016x}" for n in (7, 3, 5)]
    shots = spark.createDataFrame([(c, i) for c in ids for i in (1, 0)], "content_id string, shot_id int")
    ready = shots.select("content_id").distinct()
    ask = lambda wanted: [(r.content_id, r.shot_id) for r in build.ordinals(shots, build.wanted_contents(wanted, ready)).orderBy("row").collect()]
    assert ask(None) == ask("") == [(f"{n:016x}", i) for n in (3, 5, 7) for i in (0, 1)]
    assert ask(f"{ids[2]},,{'a' * 16},{ids[0]},{ids[2]}") == [(c, i) for c in (ids[2], ids[0], ids[2]) for i in (0, 1)]


def test_signature_ignores_ranking():
    base = config.Settings()
    assert base.signature() == config.Settings(w_visual=0.9, candidates=3).signature() != config.Settings(max_shot_sec=5.0).signature()
    assert config.from_environment(environ={"FRAMEWISE_MAX_SHOT_SEC": "5", "FRAMEWISE_DEDUPE_SCENES": "no"}) == config.Settings(max_shot_sec=5.0, dedupe_scenes=False)
    assert abs(sum(base.weights.values()) - 1.05) < 1e-12


def test_bm25_of_a_block_holds_few_shots_at_once():
    """The products of all shots of a block and all terms of a set of queries are never held together."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa
    from framewise.operators import corpus as C

    rng = np.random.default_rng(2)
    n, terms, average = 2_048, [f"w{i}" for i in range(2_000)], 20.0
    tokens = [[f"w{k}" for k in rng.integers(0, 2_500, rng.integers(0, 40))] for _ in range(n)]
    rest, sink = pa.table({"tokens": pa.array(tokens, pa.list_(pa.string()))}), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rest.schema) as out:
        out.write_table(rest)
    weights = rng.random((len(terms), 3))
    asked = C._Asked([0, 1, 2], terms, weights, [], np.zeros((0, 3)), np.zeros(3), {}, {})
    block = C.Block(0, pa.scalar(sink.getvalue().to_pybytes(), pa.binary()))
    tracemalloc.start()
    got = asked.bm25(block, average)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20
    for i in (0, 255, 256, 2_047):
        want = np.zeros(3)
        for t in {t for t in tokens[i] if int(t[1:]) < len(terms)}:
            tf = tokens[i].count(t)
            want += weights[int(t[1:])] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(tokens[i]) / average))
        assert got[i] == pytest.approx(want, abs=1e-9)


def test_postings_of_wanted_terms_keep_lengths_and_scores(spark, tmp_path):
    """An index of wanted terms alone ranks as one of all; postings of other terms are not stored."""
    import random

    from framewise.operators import lexical
    from framewise.plans import queries as Q

    rng = random.Random(8)
    texts = [" ".join(rng.choice(["alpha", "beta", "the", "ab漢字", "ab"] + [f"w{i}" for i in range(90)]) for _ in range(rng.randint(0, 50))) for _ in range(300)]
    rows = [(i // 2 if i < 6 else i, t) for i, t in enumerate([*texts, None])]  # some rows share an id
    docs = spark.createDataFrame(rows, "row long, text string")
    every = lexical.postings_of_text(docs)
    wanted = lexical.postings_of_terms(docs, spark.createDataFrame([(t,) for t in ("w1", "w1", "ab", "b漢", "nowhere")], "term string"))
    known = {(r.row, r.term): r.tf for r in every.collect()}
    own = {(r.row, r.term): r.tf for r in wanted.collect() if r.term is not None}
    assert own == {k: n for k, n in known.items() if k[1] in ("w1", "ab", "b漢")} and len(own) < len(known) / 5
    assert sorted(map(tuple, lexical.lengths(wanted).collect())) == sorted(map(tuple, lexical.lengths(every).collect()))
    assert lexical.statistics_of_postings(docs, wanted).first() == lexical.statistics_of_postings(docs, every).first()
    docs.withColumnRenamed("row", "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "w1 w2 alpha"), (1, "ab漢 the w3"), (2, "nowhere")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.query_id, r.place): (r.row, r.bm25) for r in Q.srt3_block_max(spark, str(tmp_path)).collect()}
    ranked = {}
    for r in Q.agg7_bm25_norm(spark, str(tmp_path)).collect():
        ranked.setdefault(r.query_id, []).append((-r.bm25, r.row))
    assert {k: b for k, (_, b) in got.items()} == {(q, i + 1): -b for q, found in ranked.items() for i, (b, _) in enumerate(sorted(found)[:10])}


def test_blocks_are_sent_smaller_than_their_texts(spark):
    """What the JVM and a worker hold of a block's texts and tokens is compressed; all of it comes back."""
    import random

    from framewise.operators import corpus as C

    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    said = [[rng.choice(words) for _ in range(200)] for _ in range(120)]
    rows = [(i, f"c{i % 2}", i // 5, [0.5] * 4, [0.25] * 4, True, [1.0] * 4, 0.5, t, " ".join(t), "", ["Ab"]) for i, t in enumerate(said)]
    shots = spark.createDataFrame(rows, "row long, content_id string, scene_id int, v array<float>, d array<float>, d_mask boolean, c array<float>, caption_conf double, tokens array<string>, dialogue_en string, ocr_text string, entities array<string>")
    for by in ([], ["content_id"]):
        packed = C.pack(shots, {"v": 4, "d": 4, "c": 4}, 1, *by).toArrow().combine_chunks()
        assert packed.num_rows == (2 if by else 1)
        assert sum(len(x.as_buffer()) for x in packed.column("rest")) < 0.5 * 2 * sum(len(" ".join(t)) for t in said)
        blocks = [C.Block(0, packed.column("rest")[i], v=packed.column("v")[i]) for i in range(packed.num_rows)]
        found = {int(r): (t, x) for b in blocks for r, t, x in zip(b.row(), b.column("tokens").to_pylist(), b.column("text").to_pylist(), strict=True)}
        assert found == {i: (t, " ".join(t) + " ") for i, t in enumerate(said)}
