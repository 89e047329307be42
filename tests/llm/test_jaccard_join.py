import random

import pytest
from framewise.llm import components as cc
from framewise.llm import jaccard_join as jj


def shingle_set(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = [x for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", low)]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def roots(n_ids, pairs):
    parent = {i: i for i in n_ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in n_ids}


def brute(rows):
    sets = [(d, shingle_set(t)) for d, t in rows]
    pairs = [(a, b) for i, (a, s) in enumerate(sets) for b, t in sets[i + 1 :] if a is not None and b is not None and s and t and 100 * len(s & t) >= 75 * len(s | t)]
    root = roots({d for d, _ in rows if d is not None}, pairs)
    return sorted(((d, len(s), root.get(d)) for d, s in sets), key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, n int, component_id string").repartition(3)
    return sorted(map(tuple, jj.join(df).collect()), key=repr)


def corpus(seed, n=90):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    bases = [[rng.choice(vocab) for _ in range(rng.choice([5, 6, 9, 20, 60, 120]))] for _ in range(12)]
    line = "a very common line of many documents here it is".split()
    rows = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        if rng.random() < 0.3:
            w = line + w
        rows.append((1000 - i, rng.choice([" ", "  ", "\n"]).join(w).upper() if i % 2 else " ".join(w)))
    return rows


ODD = [(3, None), (4, ""), (5, " \t\n"), (6, "One two"), (7, "one TWO"), (8, "one two three four"), (9, "a b c d e"), (10, "a b c d e"), (None, "a b c d e"), (11, "x " * 40_000), (12, "X " * 300)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed) + ODD
    assert run(spark, rows) == brute(rows)


def test_order_of_tokens_never_changes_the_result(spark, monkeypatch):
    rows = corpus(5, 60)
    for frequent, agree in ((1, 2), (10**9, 7)):
        monkeypatch.setattr(jj, "FREQUENT", frequent)
        monkeypatch.setattr(jj, "AGREE", agree)
        assert run(spark, rows) == brute(rows)


def test_blocks_of_any_size_give_the_same(spark, monkeypatch):
    rows = corpus(7, 70)
    monkeypatch.setattr(jj, "BLOCK_SETS", 3)
    monkeypatch.setattr(jj, "BLOCK_TOKENS", 150)
    monkeypatch.setattr(jj, "BLOCK_BYTES", 700)
    assert run(spark, rows) == brute(rows)


def test_repeated_ids_tie_and_empty_table(spark):
    a, b = "a b c d e f g h", "m n o p q r s t"
    rows = [(5, a), (5, b), (2, a), (9, b), (9, b), (1, "z z z")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_deduplicated_keeps_one_of_each_group(spark):
    rows = corpus(3, 50) + [(1, None), (None, "x y"), (2, "")]
    df = spark.createDataFrame([(*r, 1.5) for r in rows], "doc_id long, text string, score double")
    kept = sorted(map(tuple, jj.deduplicated(df).collect()), key=repr)
    named = {d: c for d, _, c in brute(rows)}
    assert kept == sorted(((d, t, 1.5) for d, t in rows if named.get(d) == d), key=repr)


def test_deduplicated_with_repeated_ids_and_clashing_names(spark):
    a, b = "a b c d e f g h", "m n o p q r s t"
    rows = [(5, a, "x"), (5, a, "x"), (5, a, "y"), (6, b, "z"), (7, None, "n"), (7, None, "n"), (None, a, "k")]
    df = spark.createDataFrame([(t, d, g, 1) for d, t, g in rows], "text string, doc_id long, gone string, component_id int")
    kept = sorted((r.doc_id, r.gone) for r in jj.deduplicated(df).filter("doc_id IS NOT NULL").collect())
    assert [d for d, _ in kept] == [5, 6, 7, 7] and kept[0][1] in "xy"
    assert jj.deduplicated(df).filter("doc_id IS NULL").count() == 1
    assert jj.deduplicated(df.limit(0)).collect() == []


def test_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(200, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    got = {r.id: r.component for r in cc.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    ids = {x for p in pairs if p[0] != p[1] for x in p}
    want = roots({x for p in pairs for x in p}, pairs)
    assert got == {i: want[i] for i in ids}
    assert cc.components(spark.createDataFrame([], "a long, b long")).collect() == []
