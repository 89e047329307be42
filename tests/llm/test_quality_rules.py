import random
import re
from collections import Counter

import numpy as np
import pytest
from framewise.llm import quality_rules as qr


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    wins = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {j for i, w in enumerate(wins) if wins.count(w) > 1 for j in range(i, i + 5)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), n < 10 or 100 * len(hit) > 20 * n


def corpus():
    rng = random.Random(6)
    vocab = {"en": ["the", "of", "and", "house", "tree", "river", "light"], "fr": ["le", "la", "été", "maison", "arbre", "où"]}
    rows = []
    for i in range(120):
        lang = ["en", "fr"][i % 2]
        words = [rng.choice(vocab[lang]) + rng.choice(["", "", "s", str(rng.randrange(9))]) for _ in range(rng.randint(3, 120))]
        text = " ".join(w + (".\n" if rng.random() < 0.1 else "") for w in words)
        if i % 30 == 0:
            text = " ".join(w + "###$$$" for w in words)
        if i % 10 == 1:
            text = text + "\n" + text
        rows.append((i, lang if i % 7 else None, text))
    return rows + [(200, "en", None), (201, "xx", ""), (202, None, " \n\t"), (None, "en", "a b"), (5, "en", "same line\n\n\nsame line\nsame line "), (203, "en", "w " * 30_000)]


def test_counts_against_brute_force(spark):
    rows = [r for r in corpus() if r[0] != 203]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, lang string, text string, kept int")
    out = qr.judge(df, qr.references(df)).collect()
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out), key=repr)
    assert got == sorted(((d, *brute(t)) for d, _, t in rows), key=repr)
    assert not any(r.kept for r in out if r.base_failed)
    for r in out:
        if r.doc_id is not None and r.doc_id < 120 and r.n_words >= qr.MIN_WORDS and not r.base_failed:
            assert r.kept == (r.doc_id % 30 != 0), (r, "symbols after each word are far from both languages")


def plain_references(rows):
    """Plain sums over all texts, with the words counted one by one."""
    classes, words = {}, {}
    for _, lang, text in rows:
        if lang and text:
            classes[lang] = classes.get(lang, 0) + qr.class_counts(text.encode())
            low = "".join(c.lower() if c.isascii() else c for c in text)
            words.setdefault(lang, Counter()).update(w.encode() for w in re.findall(r"[a-z0-9\u0080-\U0010ffff]+", low))
    out = qr.References()
    for lang in sorted(classes):
        best = sorted(words[lang].items(), key=lambda x: (-x[1], x[0]))[: qr.COMMON]
        out.add(lang, classes[lang], best, sum(words[lang].values()))
    return out


@pytest.mark.parametrize("bits,counted", [(12, 256), (3, 1), (6, 4)])
def test_references_equal_a_plain_sum(spark, monkeypatch, bits, counted):
    monkeypatch.setattr(qr, "HASH_BITS", bits)
    monkeypatch.setattr(qr, "_BINS", 1 << bits)
    monkeypatch.setattr(qr, "COUNTED_BINS", counted)
    rows = corpus()
    known = qr.references(spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(5))
    plain = plain_references(rows)
    assert known.names == plain.names and known.common == plain.common
    assert all(np.array_equal(a, b) for a, b in zip(known.classes + known.words, plain.classes + plain.words, strict=True))


def test_verdicts_against_brute_force(spark):
    """Both distances and limits worked out anew from the plain references."""
    rows = corpus()
    plain = plain_references(rows)
    out = {}
    for r in qr.judge_all(spark.createDataFrame(rows, "doc_id long, lang string, text string")).collect():
        out.setdefault(r.doc_id, []).append(r)
    js = lambda p, q: sum(sum(u * np.log2(2 * u / (u + v)) for u, v in zip(x, y, strict=True) if u) for x, y in ((p, q), (q, p))) / 2
    for d, lang, text in rows:
        n, *_, failed = brute(text)
        near = []
        for name in [lang] if lang in plain.names else plain.names:
            i = plain.at[name]
            words = qr.words_of((text or "").encode())
            shares = [words.count(w) / max(len(words), 1) for w in plain.common[i]]
            classes = qr.class_counts((text or "").encode())
            near.append((js(classes / max(classes.sum(), 1), plain.classes[i]) ** 0.5, max(0, js([*shares, max(0.0, 1 - sum(shares))], plain.words[i])) ** 0.5))
        c, w = min(near, key=sum)
        fine = n < qr.MIN_WORDS or (c <= qr.CLASS_LIMIT + qr.CLASS_SLACK / n**0.5 and w <= qr.WORD_LIMIT + qr.WORD_SLACK / n**0.5)
        if d != 5:
            (r,) = out[d]
            assert r.kept == (fine and not failed), (d, c, w, r)
            assert r.class_distance is None if n < qr.MIN_WORDS else abs(r.class_distance - c) < 1e-6 and abs(r.word_distance - w) < 1e-6


def test_distance():
    p, q = np.array([1.0, 0, 0]), np.array([0, 0.5, 0.5])
    assert qr.distance(p, p) == 0 and abs(qr.distance(p, q) - 1) < 1e-12
    a, b = np.array([0.2, 0.8]), np.array([0.6, 0.4])
    m = (a + b) / 2
    kl = lambda x, y: sum(u * np.log2(u / v) for u, v in zip(x, y, strict=True))
    assert abs(qr.distance(a, b) - np.sqrt((kl(a, m) + kl(b, m)) / 2)) < 1e-12


def test_empty_table_and_no_language(spark):
    empty = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert qr.judge(empty, qr.references(empty)).collect() == []
    df = spark.createDataFrame([(1, None, "one two three four five six seven eight nine ten " * 9)], "doc_id long, lang string, text string")
    assert qr.judge(df, qr.references(df)).first().word_distance == 0.0
