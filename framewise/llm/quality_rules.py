"""Quality rules by distribution divergence, beside a few plain counts.

A document's histograms of character classes and of common words are compared with those of its language, summed over
all documents of that language, by the Jensen-Shannon distance. A language's common words are its COMMON most frequent
folded words, ties by their bytes; all other words are one more bin. They are counted in two passes: the first sums up
bins of hashed words, the second counts the words of the largest bins alone. No word of another bin can be as frequent
as the last one kept, or else more bins are counted. A document whose language is missing is compared with the nearest
of all. Beyond BLOCK languages, documents are judged against one block of languages after another. Texts under MIN_WORDS
words are too short to be judged; the limit of a longer one falls with its length towards a constant. References hold
what the corpus holds: they presume that odd documents are a small part of a language.

Defined results: a null, empty or blank text has no words and fails the base rules; n_dup_lines counts lines that hold a
word; rows that share a doc_id are judged each on its own; an empty table gives no rows; other columns are ignored or
carried along.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import binary_column, discard, mapped, materialize, slices, table

#: Base rules: fewest words, and the percentage of words in repeated windows of WINDOW words.
MIN_BASE_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Shortest text whose distributions are judged, common words of a language, and languages that are sent at once.
MIN_WORDS, COMMON, BLOCK = 40, 48, 4096
#: Bins of hashed words, and those whose words are counted at first.
HASH_BITS, COUNTED_BINS = 12, 256
#: Languages, and words, that a task sums up before it hands them on.
HELD_LANGUAGES, HELD_WORDS = 256, 100_000
#: Limits of the two distances: a constant, and what is added over the root of the number of words.
CLASS_LIMIT, CLASS_SLACK, WORD_LIMIT, WORD_SLACK = 0.16, 0.9, 0.05, 4.0

_SYMBOLS = b"#*$%&|<>"


def _class_of(b: int) -> int:
    if 97 <= b <= 122:
        return 0
    if 65 <= b <= 90:
        return 1
    if 48 <= b <= 57:
        return 2
    if b == 32 or b == 9:
        return 3
    if b in (10, 13):
        return 4
    if b in b".,;:!?":
        return 5
    if b in _SYMBOLS:
        return 6
    if 128 <= b < 192:
        return 9  # a continuation byte, not counted
    return 8 if b >= 192 else 7


#: Lower, upper, digit, blank, line end, sentence mark, symbol, other ASCII, other letter.
CLASSES = 9
_CLASS = np.array([_class_of(b) for b in range(256)], np.uint8)
_BLANK = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_SYMBOL = np.array([b in _SYMBOLS for b in range(256)])
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BINS = 1 << HASH_BITS


def class_counts(text: bytes) -> np.ndarray:
    return np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=CLASSES + 1)[:CLASSES]


def words_of(text: bytes) -> list[bytes]:
    """Folded words: A-Z in lower case, parted by all of ASCII but letters and digits."""
    return text.translate(_FOLD).split()


def base_counts(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    b = np.frombuffer(text, np.uint8)
    words = text.split()
    chars = int(((b & 0xC0) != 0x80).sum() - _BLANK[b].sum())
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    repeat = 0
    if len(words) > WINDOW:
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        n = len(h) - WINDOW + 1
        mixed = np.zeros(n, np.uint64)
        for k in range(WINDOW):
            mixed = (mixed ^ h[k : k + n]) * _MIX
            mixed ^= mixed >> np.uint64(29)
        _, inverse, counts = np.unique(mixed, return_inverse=True, return_counts=True)
        steps = np.zeros(len(words) + 1, np.int32)
        hits = np.flatnonzero(counts[inverse] > 1)
        steps[hits] += 1
        steps[hits + WINDOW] -= 1
        repeat = int((np.cumsum(steps[:-1]) > 0).sum())
    return len(words), chars, int(_SYMBOL[b].sum()), len(lines) - len(set(lines)), repeat


class References:
    """Class and common-word distributions of each language."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.at: dict[str, int] = {}
        self.common: list[dict[bytes, int]] = []
        self.classes: list[np.ndarray] = []
        self.words: list[np.ndarray] = []

    def add(self, name: str, classes: np.ndarray, words: list[tuple[bytes, int]], total: int) -> None:
        """A language by the counts of its classes, of its common words in order, and of all its words."""
        self.at[name] = len(self.names)
        self.names.append(name)
        self.common.append({w: i for i, (w, _) in enumerate(words)})
        self.classes.append(classes / max(classes.sum(), 1))
        self.words.append(_with_rest(np.array([n for _, n in words], np.int64), total))

    def distances(self, lang: str | None, text: bytes) -> tuple[float, float]:
        """Class and word distance to the language's own reference, or to the nearest one."""
        own = [self.at[lang]] if lang in self.at else range(len(self.names))
        classes, words = class_counts(text), words_of(text)
        p = classes / max(classes.sum(), 1)
        found = []
        for i in own:
            common = self.common[i]
            counts = np.bincount(np.fromiter((common.get(w, len(common)) for w in words), np.int64, len(words)), minlength=len(common) + 1)[: len(common)]
            found.append((distance(p, self.classes[i]), distance(_with_rest(counts, len(words)), self.words[i])))
        return min(found, key=sum, default=(0.0, 0.0))


def _with_rest(counts: np.ndarray, total: int) -> np.ndarray:
    shares = counts / max(total, 1)
    return np.append(shares, max(0.0, 1.0 - shares.sum()))


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance in base 2: 0 for equal distributions, 1 for disjoint ones."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left, right = np.where(p > 0, p * np.log2(p / m), 0.0).sum(), np.where(q > 0, q * np.log2(q / m), 0.0).sum()
    return float(np.sqrt(max(0.0, (left + right) / 2)))


def _bin_counts(docs: DataFrame) -> DataFrame:
    """lang, bin and n: the sum of each class (bins below CLASSES) and of each bin of words, of all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def rows() -> pa.RecordBatch:
            at = [np.flatnonzero(v) for v in sums.values()]
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(at, pa.list_(pa.int64())), pa.array([v[i] for v, i in zip(sums.values(), at, strict=True)], pa.list_(pa.int64()))], names=["lang", "bins", "counts"])

        for batch in slices(batches, 1_000):
            for lang, text in zip(batch.column(0).to_pylist(), binary_column(batch, "text"), strict=True):
                if text:
                    if lang not in sums:
                        if len(sums) >= HELD_LANGUAGES:  # what a task holds stays bounded
                            yield rows()
                            sums.clear()
                        sums[lang] = np.zeros(CLASSES + _BINS, np.int64)
                    words = words_of(text)
                    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
                    sums[lang][:CLASSES] += class_counts(text)
                    sums[lang][CLASSES:] += np.bincount((h >> np.uint64(64 - HASH_BITS)).view(np.int64), minlength=_BINS)
        yield rows()

    parts = mapped(docs, count, "lang string, bins array<long>, counts array<long>")
    return parts.select("lang", F.explode(F.arrays_zip("bins", "counts")).alias("x")).groupBy("lang", F.col("x.bins").alias("bin")).agg(F.sum("x.counts").alias("n"))


def _common_words(docs: DataFrame, wanted: dict[str, set[int]]) -> dict[str, list[tuple[bytes, int]]]:
    """Of each language its COMMON most frequent words (and counts) of the wanted bins, counted in all documents."""
    sent, shift = docs.sparkSession.sparkContext.broadcast(wanted), 64 - HASH_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[tuple[str, bytes]] = Counter()
        known: dict[bytes, int] = {}

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.binary()), pa.array(list(held.values()), pa.int64())], names=["lang", "word", "n"])

        for batch in slices(batches, 1_000):
            for lang, text in zip(batch.column(0).to_pylist(), binary_column(batch, "text"), strict=True):
                bins = sent.value.get(lang)
                if not text or not bins:
                    continue
                for word, n in Counter(words_of(text)).items():
                    b = known.get(word)
                    if b is None:
                        if len(known) >= HELD_WORDS:
                            known.clear()
                        b = known[word] = xxhash.xxh3_64_intdigest(word) >> shift
                    if b in bins:
                        held[lang, word] += n
                if len(held) >= HELD_WORDS:
                    yield rows()
                    held.clear()
        yield rows()

    counted = mapped(docs, count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    best = counted.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= COMMON).collect()  # COMMON words a language
    out: dict[str, list[tuple[bytes, int]]] = {name: [] for name in wanted}
    for r in sorted(best, key=lambda r: r.place):
        out[r.lang].append((bytes(r.word), r.n))
    return out


def reference_blocks(docs: DataFrame) -> Iterator[tuple[int, int, References]]:
    """Number of blocks, block, and its references, from all documents that name a language; block _block(lang) holds lang."""
    named = docs.filter("lang IS NOT NULL").select("lang", "text")
    summed = materialize(_bin_counts(named), "word-bins")
    blocks = max(1, -(-summed.select("lang").distinct().count() // BLOCK))
    for k in range(blocks):
        mine = summed if blocks == 1 else summed.filter(_block(blocks) == k)
        is_word = F.col("bin") >= CLASSES
        bins = F.sort_array(F.collect_list(F.when(is_word, F.struct((-F.col("n")).alias("n"), (F.col("bin") - CLASSES).alias("bin")))))
        tables = mine.groupBy("lang").agg(F.collect_list(F.when(~is_word, F.struct("bin", "n"))).alias("classes"), bins.alias("bins"), F.sum(F.when(is_word, F.col("n"))).alias("total"))
        most, common, size = {}, {}, COUNTED_BINS
        todo = {r.lang: r for r in tables.withColumn("bins", F.slice("bins", 1, size + 1)).collect()}  # about BLOCK rows
        rows = dict(todo)
        while todo:
            found = _common_words(named if blocks == 1 else named.filter(_block(blocks) == k), {n: {b for _, b in r.bins[:size]} for n, r in todo.items()})
            for name, words in found.items():
                common[name] = words
                most[name] = -todo[name].bins[size].n if len(todo[name].bins) > size else 0
            # a word of a bin that was not counted could be as frequent as the last one: count more bins
            short = [n for n in todo if most[n] and (len(common[n]) < COMMON or most[n] >= common[n][-1][1])]
            size *= 4
            todo = {r.lang: r for r in tables.filter(F.col("lang").isin(short)).withColumn("bins", F.slice("bins", 1, size + 1)).collect()} if short else {}
        out = References()
        for name in sorted(rows):
            classes = np.zeros(CLASSES, np.int64)
            for b, n in rows[name].classes:
                classes[b] = n
            out.add(name, classes, common[name], rows[name].total or 0)
        yield blocks, k, out
    discard(summed)


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("lang"), F.lit(blocks))


def references(docs: DataFrame) -> References:
    """The references of all languages at once."""
    out = References()
    parts = [p for *_, p in reference_blocks(docs)]
    for name, part in sorted(((n, p) for p in parts for n in p.names), key=lambda x: x[0]):
        i = part.at[name]
        out.at[name] = len(out.names)
        out.names.append(name)
        for kind in ("common", "classes", "words"):
            getattr(out, kind).append(getattr(part, kind)[i])
    return out


def judge(docs: DataFrame, known: References) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and both distances (null where they are not judged)."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1_000):
            rows = []
            for lang, text in zip(batch.column(1).to_pylist(), binary_column(batch, "text"), strict=True):
                n, *rest, repeat = base_counts(text)
                failed = n < MIN_BASE_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
                classes = words = None
                good = not failed
                if n >= MIN_WORDS:
                    classes, words = sent.value.distances(lang, text)
                    good = good and classes <= CLASS_LIMIT + CLASS_SLACK / n**0.5 and words <= WORD_LIMIT + WORD_SLACK / n**0.5
                rows.append((n, *rest, repeat, failed, good, classes, words))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 9
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=_NAMES)

    kind = docs.schema["doc_id"].dataType.simpleString()
    kinds = [kind, *["long"] * 5, *["boolean"] * 2, *["double"] * 2]
    return mapped(docs.select("doc_id", "lang", "text"), scan, ", ".join(f"{n} {k}" for n, k in zip(_NAMES, kinds, strict=True)))


_NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"]


def judge_all(docs: DataFrame) -> DataFrame:
    """judge() against every language: named documents against their own block, others against the nearest of all blocks."""
    named, other = None, None
    for blocks, k, known in reference_blocks(docs):
        if blocks == 1:
            return judge(docs, known)
        own = judge(docs.filter(F.col("lang").isNotNull() & (_block(blocks) == k)), known)
        named = own if named is None else named.unionByName(own)
        if other is None:
            other = materialize(docs.filter("lang IS NULL").select("doc_id", "lang", "text").withColumn("_id", F.monotonically_increasing_id()), "unnamed")
        found = judge(other.withColumnRenamed("doc_id", "_doc").withColumnRenamed("_id", "doc_id"), known).withColumnRenamed("doc_id", "_id")
        nearest = found if k == 0 else nearest.unionByName(found)
    order = Window.partitionBy("_id").orderBy(F.col("class_distance") + F.col("word_distance"), "class_distance")
    best = nearest.withColumn("_place", F.row_number().over(order)).filter("_place = 1")
    return named.unionByName(best.join(other.select("_id", "doc_id"), "_id").select(*_NAMES))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_all(table(spark, sf_dir, "documents"))
