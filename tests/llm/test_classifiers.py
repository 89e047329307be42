import random
import zlib

import numpy as np
import pytest
from framewise.llm import labelled, quality_classifier, toxicity
from pyspark.sql import functions as F

RUDE = ["blockhead", "nitwit", "scoundrel", "vermin"]


def _corpus(n=420, seed=2):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice(["ba", "ne", "ti", "lo", "gru", "sh", "or"]) for _ in range(rng.randint(1, 4))) for _ in range(500)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(30, 120))]
        bad = i % 3 == 0
        rude = i % 4 == 0
        if rude:
            for k in range(0, len(words), 12):
                words[k] = rng.choice(RUDE)
        text = " | ".join(w + "###" for w in words) if bad else " ".join(words) + "."
        docs.append((i, text, "score", 1.0))
        labels.append((i, 0 if bad else 1, int(rude)))
    return docs, labels


ODD = [(None, "ba ne ti", "x", None), (10_001, None, "x", None), (10_002, "", "x", None), (10_003, "a", "x", None), (10_004, "nitwit " * 30_000, "x", None), (5, "ba lo", None, None)]


@pytest.fixture(scope="module")
def frames(spark):
    docs, labels = _corpus()
    d = spark.createDataFrame(docs + ODD, "doc_id long, text string, label string, score double").repartition(3)
    extra = [(1, 1, 0), (None, 1, 1), (2, None, None), (99_999, 0, 1), (3, 5, 7)]
    return d, spark.createDataFrame(labels + extra, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module,label,modulus,remainder", [(toxicity, "toxic", 3, 1), (quality_classifier, "quality", 4, 2)])
def test_held_out_accuracy_and_odd_rows(frames, module, label, modulus, remainder):
    docs, labels = frames
    out = module.score(docs, module.fit(docs, labels)).collect()
    assert len(out) == docs.count()
    truth = {i: (q, t)[label == "toxic"] for i, q, t in _corpus()[1]}
    held = [r for r in out if r.held_out and r.doc_id in truth and r.doc_id != 5]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    for r in out:
        assert 0.0 <= r.score <= 1.0 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % modulus == remainder)


@pytest.mark.parametrize("module", [toxicity, quality_classifier])
def test_no_labels_and_no_documents(frames, module):
    docs, labels = frames
    assert {r.score for r in module.score(docs, module.fit(docs, labels.limit(0))).collect()} == {0.0}
    one = labels.filter("quality = 1 AND toxic = 1")
    assert {r.score for r in module.score(docs, module.fit(docs, one)).collect()} == {1.0}
    assert module.score(docs.limit(0), module.fit(docs.limit(0), labels)).collect() == []


def test_labels_of_held_out_rows_change_nothing(frames):
    docs, labels = frames
    held = labelled.held_out(F.col("doc_id"), 4, 2)
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((str(r.doc_id), r.score) for r in quality_classifier.score(docs, quality_classifier.fit(docs, x)).collect()) for x in (labels, flipped))
    assert a == b


def test_votes_equal_brute_force():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 103, 80).astype(np.uint8)) for _ in range(60)]
    counts = np.stack([quality_classifier.histogram(t) for t in texts])
    idf = np.log(61 / (1 + (counts > 0).sum(0))).astype(np.float32)
    x = quality_classifier.features(counts, idf, np.stack([quality_classifier.shares(t) for t in texts]))
    axes = quality_classifier.latent_axes(x, 8)
    y = (np.arange(60) % 3 > 0).astype(np.int8)
    model = quality_classifier.Model(idf, axes, quality_classifier.unit(x @ axes), y, np.ones(60, np.float32), 0.5)
    got = quality_classifier.vote(model, [*texts[:9], None, b"ab"])
    for i in range(9):
        cos = model.vectors @ model.vectors[i]
        near = np.argsort(-cos)[: quality_classifier.NEIGHBOURS]
        w = np.maximum(cos[near], 1e-6) ** quality_classifier.POWER
        assert abs(got[i] - (w * y[near]).sum() / w.sum()) < 1e-4
    assert got[9] == got[10] == 0.5


def test_repetition_counts(spark):
    """One word, or one line, again and again is bad, though its trigrams are those of good texts; in two languages."""
    rng = random.Random(12)
    vocab = [[f"{a}{b}{c}" for a in "bdgk" for b in vowels for c in ("n", "rt", "lo", "mi")] for vowels in ("aeiou", "äöüßé")]
    text = lambda k, n: " ".join(rng.choice(vocab[k]) for _ in range(n))
    good = [text(k, rng.randint(15, 90)) for k in (0, 1) for _ in range(150)]
    bad = [" ".join([rng.choice(vocab[k])] * rng.randint(15, 60)) if i % 2 else "\n".join([text(k, 6)] * rng.randint(4, 12)) for k in (0, 1) for i in range(60)]
    rows = [(i, t, int(i < len(good))) for i, t in enumerate(good + bad)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = quality_classifier.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int"))
    out = [r for r in quality_classifier.score(docs, model).collect() if r.held_out]
    assert np.mean([r.predicted for r in out if r.doc_id >= len(good)]) < 0.1
    assert np.mean([r.predicted for r in out if r.doc_id < len(good)]) > 0.95
    assert quality_classifier.shares(None).tolist() == quality_classifier.shares(b" \n ").tolist() == [0, 0, 0, 0]


def test_accepted_keeps_columns(frames):
    docs, labels = frames
    kept = quality_classifier.accepted(docs, labels)
    assert kept.columns == docs.columns
    assert 200 < kept.count() < docs.count()


def test_margins_need_a_shared_string():
    margins = toxicity.Margins(b" blockhead  nitwit ", b" ordinary  words ")
    found = list(margins.of([[b"blockhead", b"zzz"], [], [b"nitwit", b"ordinary"]]))
    assert found[0][0] >= 3 and found[0][1] == 0 and found[1] == [] and found[2][0] >= 3 and found[2][1] == 0


def test_windows_are_judged_once_for_all_parts(monkeypatch):
    parts = [toxicity.Part(b" blockhead  nitwit ", b" ordinary  words ", 1, 3), toxicity.Part(b" scoundrel  nitwit ", b" ordinary  words ", 1, 2)]
    texts = [toxicity.windows(t) for t in (b"a Blockhead and a nitwit and a nitwit", b"", b"ordinary words", b"scoundrel nitwits")]
    want = [[sum(m >= p.threshold for m in ms) for ms in toxicity.Margins(p.toxic, p.ordinary).of(texts)] for p in parts]
    judged, margin = [], toxicity.Margins.margin
    monkeypatch.setattr(toxicity.Margins, "margin", lambda self, w: judged.append(w) or margin(self, w))
    hits = toxicity.Hits(parts)
    assert hits.of(texts).T.tolist() == want == hits.of(texts).T.tolist() and sum(want[0]) > 0 < sum(want[1])
    assert sorted(set(judged)) == [b"blockhead", b"nitwit", b"nitwits", b"scoundrel"] and len(judged) == 8
    monkeypatch.setattr(toxicity, "CACHE_ENTRIES", 2)
    assert [toxicity.Hits(parts).of([t])[0].tolist() for t in texts] == hits.of(texts).tolist()


def test_passages_are_what_toxic_documents_share():
    rng = random.Random(4)
    plain = lambda: " ".join(rng.choice(["alder", "birch", "cedar", "elm", "fir", "oak"]) for _ in range(40))
    toxic = [f"{plain()} snarlface {plain()}".encode() for _ in range(12)]
    ordinary = [plain().encode() for _ in range(40)]
    found = toxicity.passages(toxic, ordinary, 6, 15.0)
    assert found and all(b"snarlface" in p for p in found) and max(map(len, found)) < 30
    assert toxicity.passages(toxic, toxic, 6, 15.0) == [] and toxicity.passages([], ordinary, 6, 15.0) == []
    assert toxicity.likelihood_ratio(5, 10, 5, 10) == 0.0 < toxicity.likelihood_ratio(5, 10, 4, 10) < toxicity.likelihood_ratio(9, 10, 0, 10)


def test_scores_equal_brute_force(frames):
    """Every window's margin computed anew, by plain calls of the compressors."""
    docs, labels = frames
    model = toxicity.fit(docs, labels)
    assert model.parts
    size = lambda c, w: len(c.compress(toxicity.HEAD + b" " + w + b" " + toxicity.TAIL))
    fresh = [(p, toxicity.Margins(p.toxic, p.ordinary)) for p in model.parts]

    def brute(text):
        words, excess = (text or "").encode().lower().split(), 0.0
        for part, m in fresh:
            own = [b" ".join(words[i : i + part.words]) for i in range(0, len(words), part.words)]
            hits = 0
            for w in own:
                shares = any((b" " + w + b" ")[i : i + 5] in m.strings for i in range(len(w) - 2))
                hits += shares and size(m.ordinary, w) - size(m.toxic, w) >= part.threshold
            excess = max(excess, 1000 * hits / max(len(own), 1) / part.limit)
        return excess, model.scores[sum(excess > x for x in toxicity.EXCESSES)]

    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(brute(r.text))
    for r in toxicity.score(docs, model).collect():
        assert any(abs(r.excess - e) < 1e-9 and abs(r.score - s) < 1e-12 for e, s in texts[r.doc_id])


STEMS = {"en": ["blockhead", "scoundrel"], "de": ["achlich", "dummel"], "fr": ["réeux", "crétou"], "es": ["bomente", "tontaz"], None: ["vlegel"]}


def test_every_language_is_caught(spark):
    """Stems with random endings, one or two to a text, in languages of very different size; the column lang only steers training."""
    rng = random.Random(6)
    syllables = {"en": "the er on an re he in ed nd ha at en es of or".split(), "de": "ung keit lich sch ein ge ver be ach en".split(), "fr": "eux ment oui aux elle tion ré pa vi".split(), "es": "ción mente dad ado os es bo rr ta ja".split(), None: "aa ij oe ui sch ge ver lijk".split()}
    rows, labels = [], []
    for i in range(1_900):
        lang = rng.choices(list(STEMS), [60, 14, 14, 10, 2])[0]
        word = lambda: "".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4)))  # noqa: E731, B023
        words = [word() for _ in range(rng.randint(30, 120))]
        toxic = rng.random() < 0.25
        for _ in range(rng.randint(2, 5) if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(STEMS[lang]) + (word() if lang != "en" else "")
        rows.append((i, " ".join(words), lang))
        labels.append((i, int(toxic)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, known)
    out = {r.doc_id: r for r in toxicity.score(docs.drop("lang"), model).collect()}
    for lang in ("en", "de", "fr", "es"):
        own = [out[i] for i, _, g in rows if g == lang and out[i].held_out]
        caught = [r.predicted for r in own if labels[r.doc_id][1]]
        false = [r.predicted for r in own if not labels[r.doc_id][1]]
        assert np.mean(caught) >= 0.8 and np.mean(false) <= 0.06, lang


def test_a_text_of_a_megabyte(frames):
    docs, labels = frames
    long = docs.sparkSession.createDataFrame([(50_000, "ba ne " * 200_000), (50_001, "x" * 1_000_000)], "doc_id long, text string")
    assert [r.predicted for r in toxicity.score(long, toxicity.fit(docs, labels)).collect()] == [0, 0]


def test_ties_go_to_the_first_and_blocks_change_nothing():
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 100, 60).astype(np.uint8)) for _ in range(20)]
    counts = np.stack([quality_classifier.histogram(t) for t in texts])
    idf = np.ones(quality_classifier.FEATURES, np.float32)
    x = quality_classifier.features(counts, idf, np.stack([quality_classifier.shares(t) for t in texts]))
    axes = quality_classifier.latent_axes(x, 6)
    vector = quality_classifier.unit(x @ axes)[:1]
    y = (np.arange(300) < quality_classifier.NEIGHBOURS).astype(np.int8)  # the first of 300 equal neighbours are of class 1
    model = quality_classifier.Model(idf, axes, np.repeat(vector, 300, axis=0), y, np.ones(300, np.float32), 0.5)
    got = quality_classifier.vote(model, texts)
    assert (got == 1.0).all()
    assert all(quality_classifier.vote(model, [t])[0] == g for t, g in zip(texts, got, strict=True))


def test_accepted_with_clashing_names(frames):
    docs, labels = frames
    named = docs.withColumn("quality_score", F.lit(2)).withColumn("_quality_score", F.lit("x"))
    assert quality_classifier.accepted(named, labels).columns == named.columns
    assert quality_classifier.accepted(named, labels).count() == quality_classifier.accepted(docs, labels).count()
