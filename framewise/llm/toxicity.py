"""Toxicity by compression distance: zstandard dictionaries trained on toxic text against ones trained on ordinary text.

A window of a text is compressed with the ordinary dictionary, and with the toxic one, which is the ordinary one and then
what zstandard trained on toxic text. Its margin is how many bytes the latter saves. Windows with a margin at or over a
calibrated threshold are toxic, and a text's rate of toxic windows is held against a calibrated limit. What counts as ordinary
or toxic differs from language to language, so labelled texts are grouped by language for training: each language has toxic
dictionaries, a threshold and a limit of its own. Scoring knows no languages: every text is held against all dictionaries, and
the greatest rate over its limit decides. The score is the calibrated share of toxic documents among those with a like excess.

Toxic documents are mostly ordinary text. So the toxic dictionaries are trained on those passages alone whose strings occur in
significantly more toxic than ordinary documents (log-likelihood ratio). Dictionaries come from one half of the
labelled sample. Several sizes, string lengths, significances, windows, thresholds and limits are tried on the other half; of each
language the ones that catch most of its toxic documents are kept, a share of false alarms counting FALSE_COST times as much.

Defined results: a null or empty text has no windows and gets the score of a zero rate; with no label of one class, or
too little text to train on, every score is the training share of label 1 (0 without labels); a null doc_id is not held
out; rows that share a doc_id are scored each on its own; languages with few toxic training documents, or none named, are
grouped together; documents without a column lang are one group; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_column, discard, mapped, materialize, no_gc, slices, table
from .labelled import ROWS_PER_CLASS, held_out, training_sample

MODULUS, REMAINDER = 3, 1
#: A document is predicted toxic from this score on.
THRESHOLD = 0.7
#: Bytes of a language's dictionaries (ordinary: those tried), and of the samples that ordinary texts are dealt into.
TOXIC_BYTES, ORDINARY_BYTES, SAMPLE_BYTES = 512, (8_192, 16_384), 200
#: Length of zstandard's training segments, and of the strings whose frequency it counts.
SEGMENT, STRING = 16, 6
#: Lengths of the strings that are told apart by their documents, the least log-likelihood ratios, and fewest toxic documents.
CONTRAST_STRINGS, SIGNIFICANCE, LEAST_DOCUMENTS = (6, 7), (15.0, 25.0), 3
#: Toxic training documents from which on a language is a group of its own, and words of a window.
LEAST_TOXIC, WINDOW_WORDS = 8, (1, 2)
#: Thresholds (bytes saved) and limits (toxic windows in 1,000) that are tried; excesses (rate over limit) that bins begin after.
BYTES, LIMITS, EXCESSES = tuple(range(2, 9)), (0.5, 3.0, 6.0, 12.0, 25.0, 50.0), (0.0, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0)
#: What a share of false alarms costs against a share of toxic documents caught: in the same language, and in all others.
FALSE_COST, OTHER_COST = 8.0, 4.0
#: Shortest match of the compressors; a window that shares no string of SHARED bytes with what toxic text added has no margin.
MATCH, SHARED = 4, 5
CACHE_ENTRIES, CHUNK_BYTES = 200_000, 256
#: Bytes before and after each window, and at the end of all dictionaries: a block that saves too little would be
#: stored plain, and its last bytes are never matched, so the margin shows only between these.
HEAD, TAIL = bytes(range(1, 32)), bytes(range(128, 144))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def windows(text: bytes | None, words: int = 1) -> list[bytes]:
    """The text, lower-cased in ASCII, in windows of so many words; a word of over CHUNK_BYTES is cut into several."""
    chunks = text.translate(_LOWER).split() if text else []
    if any(len(c) > CHUNK_BYTES for c in chunks):
        chunks = [c[i : i + CHUNK_BYTES] for c in chunks for i in range(0, len(c), CHUNK_BYTES)]
    return chunks if words == 1 else [b" ".join(chunks[i : i + words]) for i in range(0, len(chunks), words)]


class Margins:
    """Margins of windows under an ordinary dictionary and what toxic text adds to it; those of recent windows are kept."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        def compressor(content: bytes) -> zstandard.ZstdCompressor:
            content += HEAD + TAIL
            trained = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            options = zstandard.ZstdCompressionParameters.from_level(3, dict_size=len(content), source_size=128, min_match=MATCH, write_content_size=0, write_checksum=0, write_dict_id=0)
            trained.precompute_compress(compression_params=options)
            return zstandard.ZstdCompressor(dict_data=trained, compression_params=options)

        self.toxic, self.ordinary = compressor(ordinary + toxic), compressor(ordinary)
        self.strings = {toxic[i : i + SHARED] for i in range(len(toxic) - SHARED + 1)}
        self.kept: dict[bytes, int] = {}

    def margin(self, window: bytes) -> int:
        """Bytes saved."""
        padded = b" " + window + b" "
        strings = self.strings
        if not any(padded[i : i + SHARED] in strings for i in range(len(padded) - SHARED + 1)):
            return 0
        framed = HEAD + padded + TAIL
        return max(0, len(self.ordinary.compress(framed)) - len(self.toxic.compress(framed)))

    def of(self, found: list[list[bytes]]) -> Iterator[list[int]]:
        """The margins of the windows of each text of a batch."""
        used = {w for ws in found for w in ws}
        missing = used - self.kept.keys()
        if len(self.kept) + len(missing) > CACHE_ENTRIES:
            self.kept = {w: self.kept[w] for w in used - missing}
        self.kept.update((w, self.margin(w)) for w in missing)
        get = self.kept.__getitem__
        for ws in found:
            yield list(map(get, ws))


class Hits:
    """Which windows of one length are toxic under each of several parts. Most share no string with what any toxic text added
    and are told at once for all parts; recent windows are not judged again."""

    def __init__(self, parts: list[Part]):
        self.parts = [(Margins(p.toxic, p.ordinary), p.threshold) for p in parts]
        self.strings = {s for m, _ in self.parts for s in m.strings}
        self.judged: set[bytes] = set()
        self.toxic: dict[bytes, list[int]] = {}

    def of(self, found: list[list[bytes]]) -> np.ndarray:
        """How many windows of each text (a row) are toxic under each part (a column)."""
        used = set().union(*found)
        missing = used - self.judged
        if len(self.judged) + len(missing) > CACHE_ENTRIES:
            self.judged = used - missing
            self.toxic = {w: own for w, own in self.toxic.items() if w in self.judged}
        strings = self.strings
        for w in missing:
            padded = b" " + w + b" "
            if any(padded[i : i + SHARED] in strings for i in range(len(padded) - SHARED + 1)):
                if own := [k for k, (margins, threshold) in enumerate(self.parts) if margins.margin(w) >= threshold]:
                    self.toxic[w] = own
        self.judged |= missing
        out = np.zeros((len(found), len(self.parts)), np.int64)
        for row, ws in enumerate(found):
            for w in filter(self.toxic.__contains__, ws):
                out[row, self.toxic[w]] += 1
        return out


def train(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary of the samples; b"" where they are too few to train on."""
    try:
        return zstandard.train_dictionary(max(256, min(size, sum(map(len, samples)) // 2)), samples, k=SEGMENT, d=STRING).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def likelihood_ratio(toxic: int, toxics: int, ordinary: int, ordinaries: int) -> float:
    """How surely (G squared) a string's share of the toxic documents is above that of the ordinary ones; 0 where it is not."""
    if toxic * ordinaries <= ordinary * toxics:
        return 0.0
    p = (toxic + ordinary) / (toxics + ordinaries)

    def fit_(k: int, n: int) -> float:
        return (k * math.log(k / (n * p)) if k else 0.0) + ((n - k) * math.log((n - k) / (n * (1 - p))) if n - k else 0.0)

    return 2 * (fit_(toxic, toxics) + fit_(ordinary, ordinaries)) if ordinaries and p < 1 else float(toxic)


def passages(toxic: list[bytes], ordinary: list[bytes], length: int, least: float) -> list[bytes]:
    """The runs of toxic texts whose strings of `length` bytes are in significantly more toxic documents than ordinary ones."""
    plain = lambda t: b" " + b" ".join(t.translate(_LOWER).split()) + b" "
    held = lambda b: {b[i : i + length] for i in range(len(b) - length + 1)}
    texts = [plain(t) for t in toxic]
    in_toxic = Counter(s for t in texts for s in held(t))
    frequent = {s for s, n in in_toxic.items() if n >= LEAST_DOCUMENTS}
    in_ordinary = Counter(s for t in ordinary for s in held(plain(t)) & frequent)
    telling = {s for s in frequent if likelihood_ratio(in_toxic[s], len(texts), in_ordinary[s], len(ordinary)) >= least}
    out = []
    for t in texts:
        i, last = 0, len(t) - length
        while i <= last:
            if t[i : i + length] not in telling:
                i += 1
                continue
            j = i
            while j < last and t[j + 1 : j + 1 + length] in telling:
                j += 1
            out.append(t[i : j + length])
            i = j + length
    return out


def learn_toxic(toxic: list[bytes], ordinary: list[bytes], length: int, least: float) -> bytes:
    """What zstandard trains on the telling passages; the distinct passages themselves where they are too short to train on."""
    found = passages(toxic, ordinary, length, least)
    return train(found, TOXIC_BYTES) or b"".join(dict.fromkeys(found))[:TOXIC_BYTES]


def learn_ordinary(texts: dict[str, list[bytes]], size: int) -> bytes:
    """The dictionaries of each group's ordinary texts, one after another."""
    lower = {g: [t.translate(_LOWER) for t in ts] for g, ts in texts.items()}
    return b"".join(train([t[i : i + SAMPLE_BYTES] for t in lower[g] for i in range(0, len(t), SAMPLE_BYTES)], size) for g in sorted(lower))


class Part:
    """One group's toxic dictionary, the ordinary one it adds to, words of a window, threshold and limit."""

    def __init__(self, toxic: bytes, ordinary: bytes, words: int, threshold: int = 1, limit: float = 1.0):
        self.toxic, self.ordinary, self.words, self.threshold, self.limit = toxic, ordinary, words, threshold, limit


class Model:
    """The groups' parts, and the score of each bin of excesses."""

    def __init__(self, parts: list[Part], scores: list[float]):
        self.parts, self.scores = parts, scores


def excess_bin(excess: np.ndarray) -> np.ndarray:
    return np.searchsorted(EXCESSES, excess, side="left")


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS_PER_CLASS) -> Model:
    """Learn from the rows that are not held out, at most `rows` of each class."""
    spark = docs.sparkSession
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    chosen, sizes = training_sample(docs, labels, "toxic", MODULUS, REMAINDER, rows, (lang.alias("_lang"),))
    total = sum(sizes.values())
    prior = sizes.get(1, 0) / total if total else 0.0
    flat = Model([], [prior] * (len(EXCESSES) + 1))
    if not sizes.get(0) or not sizes.get(1):
        return flat
    chosen = materialize(chosen.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))), "labelled")
    # at most 2 * rows texts; the dictionaries learn from one half, thresholds, limits and scores from the other
    sample = sorted({(r.doc_id, r.label, r.text or "", r._lang) for r in chosen.filter("half = 0").collect()})
    toxic_of = Counter(g for _, label, _, g in sample if label == 1)
    groups = {g for g, n in toxic_of.items() if n >= LEAST_TOXIC}
    texts: dict[int, dict[str, list[bytes]]] = {0: defaultdict(list), 1: defaultdict(list)}
    for _, label, text, g in sample:
        texts[label][f"={g}" if g in groups else ""].append(text.encode())
    given = spark.sparkContext.broadcast(texts)

    def learn_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, ordinary = given.value[1], given.value[0]
        for batch in batches:
            for group, length, least in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                content = learn_ordinary(ordinary, length) if group is None else learn_toxic(toxic[group], ordinary.get(group, []), length, least)
                yield pa.RecordBatch.from_pydict({"group": pa.array([group], pa.string()), "length": pa.array([length], pa.int32()), "least": pa.array([least], pa.float64()), "content": pa.array([content], pa.binary())})

    plans = [(None, size, 0.0) for size in ORDINARY_BYTES] + [(g, n, x) for g in sorted(texts[1]) for n in CONTRAST_STRINGS for x in SIGNIFICANCE]
    dealt = spark.createDataFrame(plans, "group string, length int, least double").repartition(len(plans))
    learned = mapped(dealt, learn_all, "group string, length int, least double, content binary").collect()  # small dictionaries
    ordinaries = [bytes(r.content) for r in sorted((r for r in learned if r.group is None), key=lambda r: r.length)]
    toxics = dict.fromkeys((r.group, bytes(r.content)) for r in sorted((r for r in learned if r.group is not None and r.content), key=lambda r: (r.group, r.length, r.least)))
    tried = [(g, Part(t, o, words)) for g, t in toxics for o in ordinaries for words in WINDOW_WORDS]
    if not tried:
        return flat
    sent = spark.sparkContext.broadcast([p for _, p in tried])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            own = binary_column(batch, "text")
            found = {words: [windows(t, words) for t in own] for words in WINDOW_WORDS}
            counts: list[list[int]] = [[] for _ in own]
            for part in sent.value:
                for row, ws, ms in zip(counts, found[part.words], Margins(part.toxic, part.ordinary).of(found[part.words]), strict=True):
                    saved = Counter(ms)
                    row += [len(ws), *(sum(n for m, n in saved.items() if m >= x) for x in BYTES)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.list_(pa.int64()))], names=["label", "_lang", "counts"])

    judged = chosen.filter("half = 1").select("label", "_lang", "text").repartition(spark.sparkContext.defaultParallelism)
    measured = mapped(judged, measure, "label int, _lang string, counts array<long>").collect()  # at most 2 * rows rows
    discard(chosen)
    y = np.array([r.label == 1 for r in measured], bool)
    if y.all() or not y.any():
        return flat
    counts = np.array([r.counts for r in measured], np.int64).reshape(len(y), len(tried), 1 + len(BYTES))
    rates = 1000.0 * counts[:, :, 1:] / np.maximum(counts[:, :, :1], 1)
    group_of = np.array([f"={r._lang}" if r._lang in groups else "" for r in measured])
    parts, excess = [], np.zeros(len(y))
    for group in sorted(texts[1]):
        own = group_of == group
        best = max(((quality(rates[:, p, x] > limit, y, own), -p, -x, -k) for p, (g, _) in enumerate(tried) if g == group for x in range(len(BYTES)) for k, limit in enumerate(LIMITS)), default=(0.0,))
        if best[0] > 0:
            p, x, k = (-i for i in best[1:])
            found = tried[p][1]
            parts.append(Part(found.toxic, found.ordinary, found.words, BYTES[x], LIMITS[k]))
            excess = np.maximum(excess, rates[:, p, x] / LIMITS[k])
    if not parts:
        return flat
    weight = np.where(y, sizes[1] / y.sum(), sizes[0] / (~y).sum())  # the sample's classes count as in the labels
    return Model(parts, calibrate(excess_bin(excess), y, weight, prior))


def quality(hit: np.ndarray, y: np.ndarray, own: np.ndarray) -> float:
    """The share of a group's toxic documents that are hit, less what false alarms cost."""
    share = lambda rows: float(hit[rows].mean()) if rows.any() else 0.0
    return share(own & y) - FALSE_COST * share(own & ~y) - OTHER_COST * share(~own & ~y)


def calibrate(bins: np.ndarray, y: np.ndarray, weight: np.ndarray, prior: float) -> list[float]:
    """The score of each bin: its share of toxic documents, never below a lower bin's."""
    scores, low = [], 0.0
    for b in range(len(EXCESSES) + 1):
        own = bins == b
        low = max(low, (weight[own & y].sum() + prior) / (weight[own].sum() + 1))
        scores.append(float(low))
    return scores


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, and the greatest excess."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        parts_of = {words: [p for p in m.parts if p.words == words] for words in {p.words for p in m.parts}}
        hits_of = {words: Hits(parts) for words, parts in parts_of.items()}
        with no_gc():
            for batch in slices(batches, 1_000):
                texts = binary_column(batch, "text")
                excess = np.zeros(len(texts))
                for words, parts in parts_of.items():
                    found = [windows(t, words) for t in texts]
                    n = np.maximum([len(ws) for ws in found], 1)
                    for part, hits in zip(parts, hits_of[words].of(found).T, strict=True):
                        excess = np.maximum(excess, 1000.0 * hits / n / part.limit)
                scores = np.array(m.scores)[excess_bin(excess)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(excess)], names=["doc_id", "score", "excess"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = mapped(docs.select("doc_id", "text"), scan, f"doc_id {kind}, score double, excess double")
    return scored.select("doc_id", held_out(F.col("doc_id"), MODULUS, REMAINDER).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "excess")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
