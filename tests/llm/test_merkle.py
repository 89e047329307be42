import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from framewise.llm import merkle as M
from pyspark.sql import functions as F

H = lambda s: sha256(s.encode()).hexdigest()


def _leaf(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def _tree(leaves):
    """All levels, leaves first."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def _siblings(levels, i):
    out = []
    for level in levels[:-1]:
        first = i // 8 * 8
        out.append((i % 8, "".join(x for k, x in enumerate(level[first : first + 8], first) if k != i)))
        i //= 8
    return out


def _expected(rows):
    """rows: doc_id, source, lang, n_chars, text."""
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append(row)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: _tree([_leaf(r) for r in sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))]) for g in langs}
    top = _tree([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for i, row in enumerate(sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))):
            path = _siblings(trees[g], i) + _siblings(top, k)
            node, text = _leaf(row), row[4]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and text is not None:
                node = _leaf((*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in text)))
            for at, others in path:
                node = H(others[: 64 * at] + node + others[64 * at :])
            out.append((row[0], _leaf(row), trees[g][-1][0], top[-1][0], H("".join(o for _, o in path)), node, node == top[-1][0]))
    return out


def _check(spark, rows, most=M.BLOCK_LEVELS):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string").repartition(3)
    third = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    found = M.verified(df, F.when(third, M.lowered(F.col("text"))).otherwise(F.col("text")), most).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(_expected(rows), key=repr)


@pytest.mark.parametrize("step", [1, 2, 3])
@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 100, 511, 513])
def test_walks_give_the_paths_of_the_whole_tree(n, step):
    leaves = [H(str(i)) for i in range(n)]
    levels = _tree(leaves)
    walk = M.Walk(leaves, M.height(n), step)
    assert walk.root() == levels[-1][0]
    for i, path in enumerate(walk):
        assert path == _siblings(levels, i)
        assert M.folded(leaves[i], path) == levels[-1][0]
        held = sum(len(x) for s in (*walk.now[:-1], *walk.next[:-1]) for x in (*s.nodes, *s.open))
        assert held <= 2 * 2 * 8**step * 8 // 7 * len(walk.now)  # what a walk keeps below its last subtree
    assert i == n - 1


def test_blocks_of_blocks(spark):
    """Several levels of blocks, a hot language, null and empty values, repeated ids and rows, and a language of one row."""
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "", None]), rng.choice(["en", "en", "en", "de", None, "fr", "é", "zz"]), rng.choice([None, 5, -1]), rng.choice(["Some Text", "", None, "ÄB c"]) ) for i in range(600)]
    rows += [(7, "s", "en", 1, "B"), (7, "s", "en", 1, "A"), (7, "s", "en", 1, "A"), (None, None, None, None, None), (None, "s", "en", 1, "A"), (1, "x", "only", 1, "Q" * 300_000)]
    rows += [(2000 + i, "x", f"lang{i}", 1, "T") for i in range(70)]
    _check(spark, rows, 1)


def test_few_rows(spark):
    _check(spark, [(5, "a", "en", 3, "ABC")])
    _check(spark, [(5, "a", None, 3, "ABC"), (3, "a", "", 3, "ABC")])
    empty = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert M.verified(empty, F.col("text")).collect() == []
    assert M.authenticated(empty).collect() == []


def test_paths_lead_to_the_root(spark):
    rows = [(i, "a", "en" if i % 3 else "de", i, f"text {i}") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    found = M.authenticated(df).collect()
    assert len(found) == 100
    for r in found:
        assert M.folded(r.leaf, list(zip(r["at"], r.others, strict=True))) == r.root
