import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from framewise.llm import suffix_dedup as sd


def brute(rows, k=sd.LENGTH):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - k + 1) if d is not None else ():
            g = b[p : p + k]
            first[g] = min(first.get(g, d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        m = np.zeros(len(b), bool)
        for p in range(len(b) - k + 1) if d is not None else ():
            if first[b[p : p + k]] < d:
                m[p : p + k] = True
        runs = int((np.diff(np.concatenate(([0], m.astype(int)))) == 1).sum())
        out.append((d, len(b), int(m.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~m].tobytes()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, rid string, first int").repartition(3)
    return sorted(map(tuple, sd.report(df).collect()), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    words = ["été", "the", "of", "In.", "ba", "zu", "\n", "東京", "x", " "]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(90)) for _ in range(n))
    passages = [text(n) for n in (4, 8, 9, 10, 12, 20, 60)]
    rows = []
    for i in range(50):
        parts = [text(rng.randint(0, 8)) if rng.random() < 0.6 else rng.choice(passages) for _ in range(rng.randint(0, 7))]
        t = "".join(parts)
        if rng.random() < 0.2:
            t = t[rng.randrange(len(t) + 1) :]
        rows.append((500 - 7 * i, t))
    return rows


ODD = [(1, None), (2, ""), (3, "In. " * 300), (4, "In. " * 299 + "!"), (5, "a" * 49), (6, "a" * 50), (7, "a" * 51), (8, "a" * 500), (None, "In. " * 300), (None, None), (9, "q" + "z1" * 40), (9, "z1" * 40), (10, "z1" * 40), (10, "z1" * 40), (-5, "y" * 60), (11, "yy" * 60)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed) + ODD
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("hot", [1, 3])
def test_many_blocks_buckets_and_hot_triggers(spark, monkeypatch, hot):
    small = sd.packed
    monkeypatch.setattr(sd, "packed", lambda docs: small(docs, 700))
    monkeypatch.setattr(sd, "BUCKET_BYTES", 900)
    monkeypatch.setattr(sd, "HOT", hot)
    monkeypatch.setattr(sd, "ROWS", 40)
    rows = corpus(3) + ODD
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_texts_of_megabytes(spark):
    rng = random.Random(5)
    line = "the same line stands in all of these texts, many times over\n"
    long = "".join(line if rng.random() < 0.3 else f"{rng.randrange(10**9)} once\n" for _ in range(40_000))
    rows = [(2, long), (1, line), (3, long[:400_000] + "end"), (4, "short")]
    out = {r[0]: r[1:3] for r in run(spark, rows)}
    assert out[1] == (60, 0) and out[4] == (5, 0)
    assert out[3] == (400_003, 400_000)
    assert out[2][1] >= long.count(line) * 59  # all copies of the line, and what joins a line to its neighbour


def test_phrases_cover_every_string_once(monkeypatch):
    rng = np.random.default_rng(0)
    for sizes, letters in (((50,), 5), ((0, 400, 30, 49, 50, 51, 0), 2), ((3000, 10, 700), 60)):
        text = rng.integers(97, 97 + letters, sum(sizes)).astype(np.uint8)
        offsets = np.cumsum((0, *sizes))
        usable = np.ones(len(sizes), bool)
        whole = sd.parse(text, offsets, usable)
        starts = [p for s, e in zip(whole.first, whole.last, strict=True) for p in range(s, e + 1)]
        assert starts == [p for at, n in zip(offsets, sizes) for p in range(at, at + n - sd.LENGTH + 1)]
        h = sd.rolling(text, sd.TRIGGER)
        mixed = sd._mixed(h * np.uint64(0x9E3779B97F4A7C15))
        assert all(mixed[o] == t and e - sd.SPAN < o - sd.SPAN + 1 <= s <= e <= o for s, e, o, t in zip(whole.first, whole.last, whole.owner, whole.hashes, strict=True))
        monkeypatch.setattr(sd, "PIECE", 37)
        for a, b in zip(vars(whole).values(), vars(sd.parse(text, offsets, usable)).values(), strict=True):
            assert a.tolist() == b.tolist()
        monkeypatch.undo()


def test_clashing_names_and_other_types(spark):
    text = "a passage of more than fifty bytes that two documents have in common"
    df = spark.createDataFrame([("7", text, 1, [2]), ("3", text, 4, [5]), ("x", text, 6, None)], "doc_id string, text string, id int, block array<int>")
    out = sorted(map(tuple, sd.deduplicated(df).collect()))
    assert out == [("3", text, 4, [5]), ("7", "", 1, [2]), ("x", text, 6, None)]


def test_deduplicated_texts(spark):
    passage = "".join(f"passage é number {i}, " for i in range(30))
    rows = [(1, "clean text " * 3), (2, "A" + passage), (3, "Bé" + passage + "end"), (4, None), (5, "A" + passage)]
    df = spark.createDataFrame([(r[1], r[0], 2.5) for r in rows], "text string, doc_id long, _x double")
    out = {r.doc_id: r.text for r in sd.deduplicated(df).collect()}
    assert out == {1: rows[0][1], 2: rows[1][1], 3: "Béend", 4: None, 5: ""}


def test_workers_hold_few_blocks_at_once(spark, monkeypatch):
    """Blocks close after 4 MB of text, and only a few go to a Python worker in one batch; the session's own setting stays."""
    from framewise.llm import blocks, common

    key, asked = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before, materialize = spark.conf.get(key), common.materialize

    def watched(df, label, rows=None):
        asked.append((label, rows))
        return materialize(df, label, rows)

    monkeypatch.setattr(sd, "materialize", watched)
    monkeypatch.setattr(blocks, "materialize", watched)
    texts = [chr(97 + i) * 2_500_000 for i in range(4)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    assert blocks.packed(docs).count() == 2


    def count(batches):
        yield from (pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())}) for b in batches)

    sizes = spark.range(20, numPartitions=1).mapInArrow(count, "n long")
    assert {r.n for r in materialize(sizes, "sizes", rows=4).collect()} == {4} and spark.conf.get(key) == before
    sd.report(docs.limit(1)).collect()
    assert {label: rows for label, rows in asked} == {"blocks": 1_000, "trigger-states": 4, "repeats": 4}
