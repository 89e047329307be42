"""The fuzzy join against brute force."""

import random
import time

from framewise.operators import entities


def osa(a: str, b: str) -> int:
    rows = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            rows[i][j] = min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                rows[i][j] = min(rows[i][j], rows[i - 2][j - 2] + 1)
    return rows[-1][-1]


def brute(terms, keys):
    out = {}
    for t in terms:
        if len(t) < 4:
            continue
        most = 1 if len(t) <= 6 else 2
        best = min(((osa(t, k), p, k) for p, k in enumerate(keys) if abs(len(k) - len(t)) <= most), default=(9,))
        if best[0] <= most:
            out[t] = (best[2], best[0])
    return out


def mangled(rng, word, edits, letters):
    for _ in range(edits):
        i, kind = rng.randrange(len(word) + 1), rng.randrange(4)
        if kind == 0:
            word = word[:i] + rng.choice(letters) + word[i:]
        elif kind == 1:
            word = word[:i] + word[i + 1 :]
        elif kind == 2:
            word = word[:i] + rng.choice(letters) + word[i + 1 :]
        else:
            word = word[:i] + word[i + 1 : i + 2] + word[i : i + 1] + word[i + 2 :]
    return word


def test_distances_within_a_limit():
    rng = random.Random(7)
    for _ in range(4_000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(2))
        b = mangled(rng, a, rng.randint(0, 3), "abc") if rng.random() < 0.7 else b
        for most in (1, 2):
            assert entities.osa_within(a, b, most) == (osa(a, b) if osa(a, b) <= most else None), (a, b)


def _found(spark, terms, keys):
    t = spark.createDataFrame([(x,) for x in terms], "term string")
    k = spark.createDataFrame([(x, i) for i, x in enumerate(keys)], "key string, pos int")
    return {r.term: (r.key, r.d) for r in entities.corrected(t, k).collect()}


def test_equals_brute_force(spark):
    """Few letters, so that many keys are near; lengths on both sides of every bound; other scripts; empty and blank words."""
    rng = random.Random(8)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    keys = [word("ab", n) for n in range(12) for _ in range(5)] + [word("abcdeé東🙂 ", n) for n in (3, 6, 7, *range(24, 36), 60, 300) for _ in range(2)]
    keys += ["x" * 26, "x" * 29 + "y", "same start " * 4 + "one", "same start " * 4 + "two", ""]
    keys = list(dict.fromkeys(keys))
    terms = list(dict.fromkeys(mangled(rng, k, rng.randrange(4), "abcé") for k in keys for _ in range(2)))
    assert _found(spark, terms, keys) == brute(terms, keys)


def test_no_terms_and_no_keys(spark):
    assert _found(spark, [], ["mill"]) == {} and _found(spark, ["mlil"], []) == {}


def test_many_names(spark):
    """60,000 names and 1,000 terms: each term is a name with one or two edits, and finds one as near at least."""
    rng = random.Random(9)
    parts = ["ber", "an", "ton", "li", "sk", "gro", "vi", "mar", "el", "dun", "os", "pa"]
    name = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(2, 4))) + " " + "".join(rng.choice(parts) for _ in range(rng.randint(2, 5)))
    keys = list(dict.fromkeys(name() for _ in range(70_000)))[:60_000]
    pairs = {mangled(rng, k, rng.randint(1, 2), "abcdefgh"): k for k in rng.sample(keys, 1_200)}
    terms = [t for t, k in pairs.items() if len(t) > 6 and osa(t, k) <= 2][:1_000]
    assert len(terms) == 1_000
    began = time.time()
    found = _found(spark, terms, keys)
    assert time.time() - began < 60
    assert set(found) == set(terms) and all(osa(t, k) == d <= 2 for t, (k, d) in found.items())
    few = rng.sample(terms, 12)
    assert {t: found[t] for t in few} == brute(few, keys)
