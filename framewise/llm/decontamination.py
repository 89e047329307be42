"""Benchmark decontamination with a generalised suffix automaton of the test items' words.

The items' words are built into one automaton that recognises every substring of every item. The words of a
document run through it; the state and the longest matching length after each word tell whether a window of
the benchmark ends there, and which items hold it.

Defined results: a null text has no words (0 hits); items without words match nothing; an item with a null id
marks words but is not listed; rows that share an item id count as one item; rows that share a doc_id are
judged each on its own; empty tables give no rows or no hits; other columns are ignored or carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary_column, discard, fresh, mapped, materialize, reading, slices, table

#: Words in a window of the benchmark.
WINDOW = 10
#: A document that loses more than this share of its words goes as a whole.
MAX_COVERAGE = 0.5
#: Bytes of item text in one automaton (some 200 bytes of memory each byte); more items are looked for in several scans.
MAX_AUTOMATON_BYTES = 1 << 20

#: Lower-cases A-Z and blanks what is in no word: all of ASCII but digits and letters. UTF-8 bytes over 0x7F stay.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


class ItemAutomaton:
    """Suffix automaton over the words of many items; each item starts anew at the root."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = []
        for item, words in items:
            if words:
                codes = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
                coded.append((item, codes))
                last = 0
                for code in codes:
                    last = self._extend(last, code)
        self.shortest = min([window, *(len(c) for _, c in coded)])
        #: state whose strings include the match's last `window` words -> items that hold that window
        self.window_items: dict[int, set] = {}
        #: state -> (words, items) of the short items that are among its strings
        self.short_items: dict[int, dict[int, set]] = {}
        self._mark(coded)

    def _extend(self, last: int, code: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if code in nxt[last]:
            q = nxt[last][code]
            return q if length[q] == length[last] + 1 else self._clone(last, code, q)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and code not in nxt[p]:
            nxt[p][code] = new
            p = link[p]
        if p != -1:
            q = nxt[p][code]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, code, q)
        return new

    def _clone(self, p: int, code: int, q: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = copy
        while p != -1 and self.next[p].get(code) == q:
            self.next[p][code] = copy
            p = self.link[p]
        return copy

    def _mark(self, coded: list[tuple[str | None, list[int]]]) -> None:
        for item, codes in coded:
            size = min(self.window, len(codes))
            state = matched = 0
            for i, code in enumerate(codes):
                state, matched = self.step(state, matched, code)
                if i + 1 >= size:
                    owner = state
                    while self.length[self.link[owner]] >= size:
                        owner = self.link[owner]
                    if size == self.window:
                        self.window_items.setdefault(owner, set()).add(item)
                    else:
                        self.short_items.setdefault(owner, {}).setdefault(size, set()).add(item)
        #: for every state, the ancestor that holds the window, and all short items that end there
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        self.owner = [0] * len(self.next)
        self.shorts: list[tuple] = [()] * len(self.next)
        for s in order:
            up = self.link[s]
            if self.length[s] >= self.window:
                self.owner[s] = s if self.length[up] < self.window else self.owner[up]
            own = tuple((size, frozenset(ids)) for size, ids in self.short_items.get(s, {}).items())
            self.shorts[s] = self.shorts[up] + own if own else self.shorts[up]

    def step(self, state: int, matched: int, code: int) -> tuple[int, int]:
        nxt = self.next
        while state and code not in nxt[state]:
            state = self.link[state]
            matched = self.length[state]
        to = nxt[state].get(code)
        return (0, 0) if to is None else (to, matched + 1)

    def hits(self, words: list[bytes], mask: np.ndarray, found: set) -> None:
        """Set mask over the words inside any occurrence of a window, and add the items they come from."""
        codes = list(map(self.vocab.get, words))
        known = np.fromiter((c is not None for c in codes), bool, len(codes))
        # only runs of known words that are long enough can hold a window
        edges = np.flatnonzero(np.diff(np.concatenate(([False], known, [False]))))
        nxt, link, length, owner, shorts, window = self.next, self.link, self.length, self.owner, self.shorts, self.window
        for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if end - begin < self.shortest:
                continue
            state = matched = 0
            for i in range(begin, end):
                code = codes[i]
                to = nxt[state].get(code)
                while to is None and state:
                    state = link[state]
                    matched = length[state]
                    to = nxt[state].get(code)
                if to is None:
                    continue
                state = to
                matched += 1
                if matched >= window and (ids := self.window_items.get(owner[state])):
                    mask[i - window + 1 : i + 1] = True
                    found |= ids
                if shorts[state]:
                    for size, ids in shorts[state]:
                        if size <= matched:
                            mask[i - size + 1 : i + 1] = True
                            found |= ids


def n_automata(items: DataFrame, limit: int = MAX_AUTOMATON_BYTES) -> int:
    total = items.agg(F.coalesce(F.sum(F.length(F.col("text").cast("binary"))), F.lit(0))).first()[0]
    return max(1, -(-total // limit))


def automata(items: DataFrame, window: int = WINDOW, limit: int = MAX_AUTOMATON_BYTES) -> Iterator[tuple[int, int, ItemAutomaton]]:
    """The number of automata over the items, and one after another: each of at most about `limit` bytes of text."""
    items = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text"))
    parts = n_automata(items, limit)
    for k in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == k).collect()
        yield parts, k, ItemAutomaton([(r.item_id, words_of(bytes(r.text) if r.text is not None else None)) for r in rows], window)


def _runs(mask: np.ndarray) -> list[int]:
    return np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])))).tolist() if mask.any() else []


_FOUND = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_runs", T.ArrayType(T.LongType())),
    T.StructField("items", T.ArrayType(T.StringType())),
]


def _spans(mask: np.ndarray, runs: list[int] | None) -> np.ndarray:
    """mask, with the words of runs set too."""
    for begin, end in zip((runs or [])[::2], (runs or [])[1::2], strict=True):
        mask[begin:end] = True
    return mask


def _look(rows: DataFrame, parts: Iterator[tuple[int, int, ItemAutomaton]], every: bool, keep: tuple[str, ...]) -> list[DataFrame]:
    """For each automaton: the kept columns, n_words, hit_runs and items of the rows (kept columns and _text) that it finds
    something in; with `every`, of all rows from the first one. Several are written: a worker then holds one automaton at a time."""
    schema, at, out = T.StructType([*(rows.schema[c] for c in keep), *_FOUND]), len(keep), []
    for n, k, automaton in parts:
        sent = rows.sparkSession.sparkContext.broadcast(automaton)

        def scan(batches: Iterator[pa.RecordBatch], sent=sent, whole=every and k == 0) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 500):
                counts, runs, lists = [], [], []
                for text in binary_column(batch, "_text"):
                    words = words_of(text)
                    mask, found = np.zeros(len(words), bool), set()
                    sent.value.hits(words, mask, found)
                    counts.append(len(words))
                    runs.append(_runs(mask))
                    lists.append(sorted(x for x in found if x is not None))
                columns = [*batch.columns[:at], pa.array(counts, pa.int64()), pa.array(runs, pa.list_(pa.int64())), pa.array(lists, pa.list_(pa.string()))]
                found = pa.RecordBatch.from_arrays(columns, names=schema.names)
                yield found if whole else found.filter(pa.array([bool(r) for r in runs], pa.bool_()))

        hits = mapped(rows.select(*keep, "_text"), scan, schema)
        if n > 1:
            hits = materialize(hits, "hits")
            sent.unpersist()
        out.append(hits)
    return out


def _merged(hits: list[DataFrame]) -> DataFrame:
    """_id, n_words, hit_runs and items over all automata; runs of one row may overlap."""
    rows = hits[0]
    for more in hits[1:]:
        rows = rows.unionByName(more)
    lists = lambda c: F.flatten(F.collect_list(c))  # noqa: E731  at most a row for each automaton
    return rows.groupBy("_id").agg(F.max("n_words").alias("n_words"), lists("hit_runs").alias("hit_runs"), F.array_sort(F.array_distinct(lists("items"))).alias("items"))


def find_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ("doc_id",), limit: int = MAX_AUTOMATON_BYTES) -> DataFrame:
    """For every document: the kept columns, n_words, hit_runs (begin, end, begin, end ... in words), items.

    Items that need several automata are looked for in as many scans of texts that are written once, with an id; each scan
    writes only what it finds.
    """
    if n_automata(items, limit) == 1:
        return _look(docs.select(*keep, F.col("text").alias("_text")), automata(items, window, limit), True, keep)[0]
    base = materialize(docs.select(*keep, F.col("text").alias("_text"), F.monotonically_increasing_id().alias("_id")), "texts")
    hits = _look(base, automata(items, window, limit), True, ("_id",))
    found = _merged(hits)

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [_runs(_spans(np.zeros(n, bool), r)) if r else [] for n, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield batch.set_column(2, "hit_runs", pa.array(runs, pa.list_(pa.int64())))

    out = base.drop("_text").join(mapped(found, tidy, found.schema), "_id").select(*keep, "n_words", "hit_runs", "items")
    return reading(out, base, *hits)


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the hit runs and items themselves."""
    found = find_hits(docs, items, window)
    # runs alternate begin and end, so the hit words are the sum with alternating signs
    n_hit = F.expr("aggregate(transform(hit_runs, (x, i) -> if(i % 2 = 1, x, -x)), 0L, (a, x) -> a + x)")
    out = found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("hit_runs") > 0).alias("contaminated"),
    )
    return reading(out, *getattr(found, "_held", ()))


def _cut(text: bytes, mask: np.ndarray) -> bytes:
    """The text without the bytes of masked words and what separates words of one masked run."""
    plain = np.frombuffer(text.translate(_TABLE), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([False], plain, [False]))))
    begins, ends = edges[::2], edges[1::2]
    runs = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False]))))
    out, at = [], 0
    for first, last in zip(runs[::2], runs[1::2], strict=True):
        out.append(text[at : begins[first]])
        at = int(ends[last - 1])
    out.append(text[at:])
    return b"".join(out)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, limit: int = MAX_AUTOMATON_BYTES) -> DataFrame:
    """The documents' own columns, texts without the spans that benchmark windows cover.

    A document of which more than max_coverage is covered goes as a whole; documents without a hit stay as
    they are, to the byte. After a cut the rest is scanned again, until no window is left. All automata look at a text
    before it is cut, so the result does not hang on how many there are.
    """
    if n_automata(items, limit) > 1:
        return _decontaminate_in_rounds(docs, items, window, max_coverage, limit)
    at = docs.columns.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(next(automata(items, window, limit))[2])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            texts, stay = [], []
            for text in binary_column(batch, "text"):
                n = lost = 0
                while text:
                    words = words_of(text)
                    n = n or len(words)
                    mask = np.zeros(len(words), bool)
                    sent.value.hits(words, mask, set())
                    lost += int(mask.sum())
                    if not mask.any() or lost > max_coverage * n:
                        break
                    text = _cut(text, mask)
                texts.append(text)
                stay.append(lost <= max_coverage * n)
            yield _with_texts(batch, at, texts).filter(pa.array(stay, pa.bool_()))

    return mapped(docs, clean, docs.schema)


def _with_texts(batch: pa.RecordBatch, at: int, texts: list[bytes | None]) -> pa.RecordBatch:
    field = batch.schema.field(at)
    return batch.set_column(at, field, pa.array(texts, pa.large_binary()).cast(pa.large_string()).cast(field.type))


def _decontaminate_in_rounds(docs: DataFrame, items: DataFrame, window: int, max_coverage: float, limit: int) -> DataFrame:
    """decontaminate() for items that need several automata. Texts are written once, with an id; each round, every automaton
    scans what the round before has cut (at first all), the runs found are put together, and only these texts are cut."""
    name, round_, gone = (fresh(docs, n) for n in ("row_id", "round", "gone"))
    base = materialize(docs.withColumn(name, F.monotonically_increasing_id()), "texts")
    live = base.select(F.col(name).alias("_id"), F.col("text").alias("_text"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("lost"))
    schema = T.StructType([*live.schema.fields, T.StructField("gone", T.BooleanType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            texts, state = [], []
            for text, n, lost, words, runs in zip(binary_column(batch, "_text"), *(batch.column(c).to_pylist() for c in ("n", "lost", "n_words", "hit_runs")), strict=True):
                mask = _spans(np.zeros(words, bool), runs)
                n, lost = n or words, lost + int(mask.sum())
                state.append((n, lost, lost > max_coverage * n))
                texts.append(text if state[-1][2] else _cut(text, mask))
            n, lost, over = zip(*state, strict=True) if state else ((), (), ())
            text = pa.array(texts, pa.large_binary()).cast(pa.large_string()).cast(batch.schema.field("_text").type)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), text, pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(over, pa.bool_())], names=schema.names)

    rounds: list[DataFrame] = []
    while True:
        hits = _look(live, automata(items, window, limit), False, ("_id",))
        done = materialize(mapped(live.join(_merged(hits), "_id"), cut, schema), "cut")
        discard(*hits)
        if not done.head(1):
            discard(done)
            break
        rounds.append(done)
        live = done.filter("NOT gone").drop("gone")
    if not rounds:
        return reading(base.drop(name), base)
    cuts = None
    for k, done in enumerate(rounds):  # as many as a text takes until no window is left
        own = done.select(F.col("_id").alias(name), F.lit(k).alias(round_), F.col("_text"), F.col("gone").alias(gone))
        cuts = own if cuts is None else cuts.unionByName(own)
    last = cuts.groupBy(name).agg(F.max_by(F.struct(F.col("_text").alias("t"), F.col(gone).alias("g")), round_).alias(round_))
    out = base.join(last, name, "left").filter(F.col(round_).isNull() | ~F.col(f"{round_}.g"))
    text = F.when(F.col(round_).isNotNull(), F.col(f"{round_}.t")).otherwise(F.col("text"))
    return reading(out.withColumn("text", text).select(*docs.columns), base, *rounds)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Joins the windows themselves, on their words; a document word is hit if a matched window covers it.
SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT k FROM win),
grams AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS gram
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)
), hit AS (SELECT doc_id, i, g.k, item_id FROM grams g JOIN win USING (gram) WHERE win.k = g.k),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hit)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
