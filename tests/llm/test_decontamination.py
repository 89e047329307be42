import hashlib
import random
import re

from framewise.llm import decontamination as dec

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return WORD.findall(low)


def brute(docs, items, k=10):
    out = []
    for doc_id, text in docs:
        w, mask, found = words(text), set(), set()
        for item_id, t in items:
            v = words(t)
            n = min(k, len(v))
            wins = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
            for i in range(len(w) - n + 1) if v else ():
                if tuple(w[i : i + n]) in wins:
                    mask.update(range(i, i + n))
                    found.add(item_id)
        ids = sorted(str(x) for x in found if x is not None)
        out.append((doc_id, len(w), len(mask), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(mask)))
    return sorted(out, key=repr)


def run(spark, docs, items):
    d = spark.createDataFrame([(*r, 9, "x") for r in docs], "doc_id long, text string, item_id long, hit_runs string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, dec.report(d, b).collect()), key=repr)


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocab = ["a", "B", "été", "d1", "x_y", "Z"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 9, 10, 11, 14, 30]) if i > 3 else 12)) for i in range(12)]
    docs = [(i, text(rng.randint(0, 60)) + " " + (items[i % 12][1] if i % 3 == 0 else "")) for i in range(60)]
    docs += [(7, None), (7, ""), (None, items[0][1]), (8, "... !!"), (9, items[5][1] * 40)]
    items += [(3, items[3][1]), (20, None), (21, " ,"), (None, items[2][1])]
    assert run(spark, docs, items) == brute(docs, items)


def test_long_windows_only(spark):
    item = [(1, " ".join(f"w{i}" for i in range(25)))]
    docs = [(1, "x " + " ".join(f"w{i}" for i in range(3, 12))), (2, "y " + " ".join(f"W{i}" for i in range(3, 13)) + " z"), (3, " ".join(f"w{i}." for i in range(25)))]
    assert run(spark, docs, item) == brute(docs, item)


def test_empty_tables_and_several_automata(spark):
    docs = [(1, "one two three four five six seven eight nine ten eleven"), (2, None), (1, "one two")]
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, docs, []) == brute(docs, [])
    items = [(i, f"k{i} " + docs[0][1]) for i in range(6)] + [(7, "two"), (8, docs[0][1][4:])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert len(list(dec.automata(b, limit=100))) > 2
    whole, parted = (sorted(map(tuple, dec.find_hits(d, b, limit=n).collect()), key=repr) for n in (1 << 20, 100))
    assert whole == parted and any(r[3] for r in whole)


def test_several_automata_clean_the_same(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.randint(10, 16))) for i in range(8)]
    # a cut of one item brings together what another one finds
    docs = [(i, f"{text(30)} {items[i % 8][1][:20]} {items[(i + 3) % 8][1]} {items[i % 8][1][21:]} {text(30)}") for i in range(30)] + [(40, items[0][1]), (41, None), (42, "")]
    d, b = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, n int, cuts int"), spark.createDataFrame(items, "item_id long, text string")
    out = {r.doc_id: r for r in dec.decontaminate(d, b, limit=120).collect()}
    grams = {tuple(words(t)[i : i + 10]) for _, t in items for i in range(len(words(t)) - 9)}
    assert 40 not in out and out[41].text is None and out[42].text == "" and out[0].n == 1
    for r in out.values():
        w = words(r.text)
        assert not any(tuple(w[i : i + 10]) in grams for i in range(len(w)))
    assert sorted(map(tuple, out.values())) == sorted(map(tuple, dec.decontaminate(d, b).collect()))


def test_overlapping_items_clean_the_same(spark):
    """Two items that share words: whatever the number of automata, all that either covers goes at once."""
    w = [f"w{i}" for i in range(20)]
    items = [(1, " ".join(w[:12])), (2, " ".join(w[8:]))]
    docs = [(1, "a b c d e " * 10 + " ".join(w) + " f g"), (1, "a b c d e " * 10 + " ".join(w) + " f g"), (None, " ".join(w)), (2, "clean, as it is"), (3, None)]
    d, b = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, round int, row_id string"), spark.createDataFrame(items, "item_id long, text string")
    assert len(list(dec.automata(b, limit=40))) > 1
    one, several = (sorted(map(tuple, dec.decontaminate(d, b, limit=n).collect()), key=repr) for n in (1 << 20, 40))
    assert one == several and [r for r in one if r[0] == 1][0][1].split() == ("a b c d e " * 10 + "f g").split()
    assert [r[0] for r in one].count(None) == 0 and len(one) == 4
    assert dec.decontaminate(d.limit(0), b, limit=40).collect() == []


def test_a_text_of_megabytes(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    docs = [(1, "word " * 300_000 + item + " word" * 300_000), (2, "x")]
    assert [(r[0], r[1], r[2]) for r in run(spark, docs, [(1, item)])] == [(1, 600_011, 11), (2, 1, 0)]


def test_cut_leaves_clean_text_alone(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    clean = "Nothing to see, here.\n" * 5
    docs = [(1, clean), (2, clean + item.upper() + "! " + clean), (3, item), (4, None), (5, "")]
    d = spark.createDataFrame([(*r, "s") for r in docs], "doc_id long, text string, source string")
    out = {r.doc_id: r.text for r in dec.decontaminate(d, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert out == {1: clean, 2: clean + "! " + clean, 4: None, 5: ""}
