"""Queries over small tables whose rows reach past where inputs were once cut."""

import hashlib

from framewise.plans import queries as Q


def _documents(spark, folder, texts):
    rows = [(i, t, "en", "web", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")


def test_documents_are_not_cut(spark, tmp_path):
    words = " ".join(f"word{i}" for i in range(60))
    long = "A" * 400
    texts = [words, words, f"{long} one. {long} two. {long} three. Four.", "x" * 3000 + "a" + "y" * 3000, "x" * 3000 + "b" + "y" * 3000]
    _documents(spark, tmp_path, texts)
    tokens = {r.doc_id: r.tokens.split() for r in Q.fn2_bm25_doc(spark, str(tmp_path)).collect()}
    assert tokens[0].count("word59") == 1 and tokens[1].count("word59") == 1 and len(tokens[0]) == 64
    captions = {r.doc_id: r.caption for r in Q.fn5_clean_caption(spark, str(tmp_path)).collect()}
    assert captions[2] == f"{long} one. {long} two. {long} three."
    ids = {r.doc_id: r.content_id for r in Q.fn11_content_id(spark, str(tmp_path)).collect()}
    assert ids[3] != ids[4] and ids[3] == hashlib.sha1(b"6001" + texts[3].encode()).hexdigest()[:16]


def test_ngrams_of_whole_items(spark, tmp_path):
    words = [f"word{i}" for i in range(40)]
    spark.createDataFrame([(0, " ".join(words))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    grams = [r.gram for r in Q.win6_ngrams(spark, str(tmp_path)).orderBy("pos").collect()]
    assert grams == [" ".join(words[i : i + n]) for n in (3, 2, 1) for i in range(41 - n)]


def test_all_items_are_scored(spark, tmp_path, monkeypatch):
    from framewise.operators import lexical

    _documents(spark, tmp_path, [f"alpha{i} beta{i} gamma" for i in range(12)])
    spark.createDataFrame([(i, f"alpha{i} beta{i}") for i in range(12)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    best = lambda: {(r.query_id, r.row): r.bm25 for r in Q.j6_bm25(spark, str(tmp_path)).collect()}
    small = best()
    assert set(small) == {(i, i) for i in range(12)} == {(r.query_id, r.row) for r in Q.agg7_bm25_norm(spark, str(tmp_path)).collect()}
    assert {r.query_id for r in Q.batch_search(spark, str(tmp_path)).collect()} == set(range(12))
    monkeypatch.setattr(lexical, "BROADCAST_TERMS", 0)
    assert best() == small


def test_all_names_and_documents_without_a_vector(spark, tmp_path):
    from framewise.sources import adapters as A

    names = [f"{a}lphabet{b}" for a in "ABCDEFGH" for b in ("a", "b")]
    _documents(spark, tmp_path, [" ".join(names), "Alphabeta again here", "x " * 60 + "lastword"])
    spark.createDataFrame([(2, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(i, [1.0] * 64) for i in range(1)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    d = str(tmp_path)
    vocab = {r.key: r.pos for r in Q.agg8_vocab(spark, d).collect()}
    assert set(vocab) == {n.lower() for n in names} and len(vocab) == 16
    assert {r.key for r in Q.agg9_merged_vocab(spark, d).collect()} == set(vocab)
    assert [r.entity for r in Q.j7_entity_score(spark, d).orderBy("row").collect()] == [0.5, 0.5, 0.0]
    assert tuple(Q.agg16_summaries(spark, d).first())[1:] == (3, 2, 1, 2)
    assert A.shots(spark, d).first().caption == " ".join(names)


def test_propagate_in_blocks(spark, monkeypatch):
    from framewise.operators import captions, nearest

    shots = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "row long, v array<float>")
    reps = shots.filter("row % 3 = 0").selectExpr("row as rep", "v as rv")
    ask = lambda: sorted(map(tuple, captions.propagate(shots, reps).collect()))
    whole = ask()
    monkeypatch.setattr(nearest, "TARGETS", 6)
    assert len(whole) == 60 and ask() == whole


def test_neighbours_of_every_fiftieth_row(spark, tmp_path, monkeypatch):
    import numpy as np
    from framewise.operators import nearest

    v = np.random.default_rng(3).standard_normal((160, 8)).astype(np.float32)
    spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = {(q, int(r)) for q in (0, 50, 100, 150) for r in np.argsort(-(v.astype(float) @ v[q].astype(float)))[:10]}
    for block in (1000, 2):
        monkeypatch.setattr(nearest, "QUERIES", block)
        got = [(r.query_id, r.row) for r in Q.j12_knn(spark, str(tmp_path)).collect()]
        assert len(got) == 40 and set(got) == want


def test_equal_neighbours_go_by_row(spark, monkeypatch):
    import numpy as np
    from framewise.operators import nearest

    monkeypatch.setattr(nearest, "ROWS", 16)
    rng = np.random.default_rng(8)
    v = rng.integers(-1, 2, (200, 3)).astype(float)
    rows = spark.createDataFrame([(int(i), v[i].tolist()) for i in rng.permutation(200)] + [(999, None)], "row long, v array<float>").repartition(3)
    queries = rows.filter("row % 20 = 0").selectExpr("row AS query_id", "v AS q")
    got = sorted((r.query_id, -round(r.cosine), r.row) for r in nearest.of_each(rows, queries, 7).collect())
    want = [(q, -c, r) for q in range(0, 200, 20) for c, r in sorted(((float(v[r] @ v[q]), r) for r in range(200)), key=lambda x: (-x[0], x[1]))[:7]]
    assert got == sorted((q, round(c), r) for q, c, r in want)
    assert nearest.of_each(rows, queries.limit(0), 3).collect() == []
    assert nearest.nearest_one(rows, queries.limit(0).selectExpr("query_id AS target", "q AS v")).collect() == []


def test_spans_without_an_end_are_merged(spark, tmp_path):
    """An end that is not known hides no other span's; equal spans are one, in whatever order they come."""
    import duckdb
    from framewise.plans import oracles

    rows = [(1, 1, None, 0.1), (1, 1, 15.0, 0.2), (1, 2, None, 0.5), (1, 2, 3.0, 0.3), (2, 1, 15.0, 0.1), (2, 1, 15.0, 0.4), (2, 1, 6.0, 0.0), (3, 4, None, 0.2)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_discount double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(map(tuple, Q.win2_span_merge(spark, str(tmp_path)).collect()))
    assert got == [(1, 10.0, 15.0, 0.2), (1, 20.0, 21.0, 0.5), (2, 10.0, 15.0, 0.4), (3, 40.0, None, 0.2)]
    own = duckdb.connect(config={"threads": 1})
    own.sql(f"CREATE VIEW lineitem AS FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert got == sorted(own.sql(oracles.ORACLE_SQL["win2_span_merge"]).fetchall())
