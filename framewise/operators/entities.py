"""Entities: vocabularies, matches in shots, and typo-tolerant resolution of query terms."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.functions import text as T
from framewise.session import ship


def quote(term: Column) -> Column:
    """A literal pattern for a term."""
    return F.regexp_replace(term, r"([\\.^$|?*+()\[\]{}\-])", r"\\$1")


def mentions(entities: Column, text: Column, term: Column) -> Column:
    """Whether a shot lists the entity, or says it between word bounds; the plain test guards the pattern."""
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), quote(term), F.lit(r"(?![\p{L}\p{N}_])"))
    return F.array_contains(F.transform(entities, F.lower), term) | (F.contains(text, term) & F.regexp_like(text, pattern))


def scores(shots: DataFrame, terms: list[str]) -> DataFrame:
    """row and entity: the share of the query's entities that a shot mentions."""
    if not terms:
        return shots.select("row", F.lit(0.0).alias("entity"))
    text = F.lower(F.concat_ws(" ", "dialogue_en", "ocr_text"))
    hits = sum((mentions(F.col("entities"), text, F.lit(t.lower())).cast("int") for t in terms), F.lit(0))
    return shots.select("row", (hits / float(len(terms))).alias("entity"))


def vocabulary(forms: DataFrame) -> DataFrame:
    """content_id, pos, key and form: each key's most frequent casing, ties by first sight. forms: content_id, pos, form."""
    counted = forms.groupBy("content_id", "form").agg(F.count("*").alias("n"), F.min("pos").alias("first")).withColumn("key", F.lower("form"))
    best = counted.groupBy("content_id", "key").agg(F.max(F.struct("n", (-F.col("first")).alias("f"), "form")).alias("b"))
    order = Window.partitionBy("content_id").orderBy(F.desc("b.n"), F.desc("b.f"))
    return best.select("content_id", (F.row_number().over(order) - 1).alias("pos"), "key", F.col("b.form").alias("form"))


def shown(forms: DataFrame) -> DataFrame:
    """key, pos and form over all rows (pos, form): as vocabulary() of one content, but pos only orders keys, so no task sorts
    them all."""
    counted = forms.groupBy("form").agg(F.count("*").alias("n"), F.min("pos").alias("first")).withColumn("key", F.lower("form"))
    best = counted.groupBy("key").agg(F.max(F.struct("n", (-F.col("first")).alias("f"), "form")).alias("b"))
    return best.select("key", F.struct((-F.col("b.n")).alias("n"), (-F.col("b.f")).alias("first")).alias("pos"), F.col("b.form").alias("form"))


def merged(vocabularies: DataFrame, contents: DataFrame) -> DataFrame:
    """key and form over several contents; the first content in order wins. contents: content_id and place."""
    placed = vocabularies.join(contents, "content_id")
    return placed.groupBy("key").agg(F.min(F.struct("place", "pos", "form")).alias("b")).select("key", F.col("b.form").alias("form"), F.col("b.place").alias("place"), F.col("b.pos").alias("pos"))


#: Strings up to so many characters are spread whole; longer ones by so many characters at both ends. Two edits more tell
#: the two kinds of spreading apart, and the ends of the shortest longer string stay two edits clear of each other.
WHOLE, END = 28, 11
#: Keys shorter than this are one edit from a term at most, and those shorter than the least from none.
TWO_EDITS_FROM, LEAST_KEY = T.FUZZY_SHORT_LEN - 1, T.FUZZY_MIN_LEN - 1


def _without(text: str, n: int) -> set[str]:
    """The strings left when n (0 to 2) characters are deleted from a text."""
    if n == 0:
        return {text}
    if n == 1:
        return {text[:i] + text[i + 1 :] for i in range(len(text))}
    return {text[:i] + text[i + 1 : j] + text[j + 1 :] for j in range(1, len(text)) for i in range(j)}


def left_of(text: str, most: int, whole: bool) -> set[str]:
    """What is left of a text after up to `most` deletions; of a long one, what is left of its two ends."""
    if whole:
        return set().union(*(_without(text, n) for n in range(most + 1)))
    head, tail = ([_without(part, n) for n in range(most + 1)] for part in (text[:END], text[-END:]))
    return {f"{h}\0{t}" for i in range(most + 1) for j in range(most + 1 - i) for h in head[i] for t in tail[j]}


def _spread(text: Column, kinds: Callable[[str], list[tuple[int, bool]]]) -> Column:
    """Hashes of what is left of a text in each of its kinds of spreading (deletions, whole or not)."""

    @F.pandas_udf("array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashed = lambda x, whole: int.from_bytes(blake2b(x.encode(), digest_size=8, salt=b"w" if whole else b"e").digest(), "little", signed=True)
        for texts in batches:
            yield pd.Series([[hashed(x, whole) for most, whole in kinds(t) for x in left_of(t, most, whole)] for t in texts])

    return run(text)


def osa_within(a: str, b: str, most: int) -> int | None:
    """The optimal string alignment distance of two strings, if it is at most `most`; only cells that near the diagonal count."""
    begin, end = 0, 0
    while begin < min(len(a), len(b)) and a[begin] == b[begin]:
        begin += 1
    while end < min(len(a), len(b)) - begin and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[begin : len(a) - end], b[begin : len(b) - end]
    if abs(len(a) - len(b)) > most:
        return None
    far = most + 1
    before: dict[int, int] = {}
    last = {j: j for j in range(min(len(b), most) + 1)}
    for i, x in enumerate(a, 1):
        row = {0: i} if i <= most else {}
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            best = min(last.get(j, far) + 1, row.get(j - 1, far) + 1, last.get(j - 1, far) + (x != b[j - 1]))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, before.get(j - 2, far) + 1)
            row[j] = best
        if min(row.values(), default=far) > most:
            return None
        before, last = last, row
    found = last.get(len(b), far)
    return found if found <= most else None


def _distance(term: Column, key: Column, limit: Column) -> Column:
    """osa_within of each row; null beyond the limit."""

    @F.pandas_udf("int")
    def run(terms: pd.Series, keys: pd.Series, limits: pd.Series) -> pd.Series:
        return pd.Series([osa_within(*x) for x in zip(terms, keys, limits, strict=True)], dtype="Int32")

    return run(term, key, limit)


def _key_kinds(key: str) -> list[tuple[int, bool]]:
    n = len(key)
    return [(1 if n < TWO_EDITS_FROM else 2, True)] * (n <= WHOLE + 2) + [(2, False)] * (n > WHOLE - 2)


def _term_kinds(term: str) -> list[tuple[int, bool]]:
    return [(2, False)] if len(term) > WHOLE else [(1 if len(term) <= T.FUZZY_SHORT_LEN else 2, True)]


def deletion_index(keys: DataFrame) -> DataFrame:
    """h, key and pos: each key under the hash of every string that up to two deletions leave of it.

    Two strings within d edits (swaps of neighbours count once) leave a common string after d deletions each: each edit
    leaves at most one character of either side without a partner. The same holds for their first and last END characters,
    with the edits shared out between both ends, so long keys make no more rows than short ones. keys: key and pos.
    """
    ship(keys.sparkSession)
    return keys.filter(F.length("key") >= LEAST_KEY).select(F.explode(_spread(F.col("key"), _key_kinds)).alias("h"), "key", "pos")


def corrected(terms: DataFrame, keys: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """term, key and d: the nearest key within the term's limit of edits, the first key winning ties.

    An equi-join of the terms' hashes with the keys' (deletion_index(keys), or a stored one) finds all keys that can be
    near; the distance of these alone is worked out. terms: term; keys: key and pos, which orders them.
    """
    ship(terms.sparkSession)
    limited = terms.select("term").distinct().withColumn("limit", T.fuzzy_limit(F.col("term"))).filter("limit IS NOT NULL")
    asked = limited.select("term", "limit", F.explode(_spread(F.col("term"), _term_kinds)).alias("h"))
    found = asked.join(deletion_index(keys) if index is None else index, "h").filter(F.abs(F.length("term") - F.length("key")) <= F.col("limit"))
    like = found.groupBy("term", "limit", "key").agg(F.min("pos").alias("pos"))
    near = like.withColumn("d", _distance(F.col("term"), F.col("key"), F.col("limit"))).filter("d IS NOT NULL")
    return near.groupBy("term").agg(F.min(F.struct("d", "pos", "key")).alias("b")).select("term", F.col("b.key").alias("key"), F.col("b.d").alias("d"))


def query_entities(query: str, vocab: DataFrame, recogniser: Callable[[list[str]], list[list[str]]], index: DataFrame | None = None) -> list[str]:
    """Keys that a query names: what the recogniser finds as typed (trusted), in title case (if known), then word runs.

    The query's few terms are resolved in one job; vocab: key and pos; index: its deletion_index, where there is one.
    """
    import regex

    spark = vocab.sparkSession
    typed, titled = recogniser([query, query.title()])
    tokens = regex.findall(T.WORD, query.lower())
    runs = [" ".join(tokens[i : i + n]) for n in range(T.NGRAM_MAX, 0, -1) for i in range(len(tokens) - n + 1)]
    runs = [g for g in runs if " " in g or (g not in T.STOPWORDS and len(g) >= T.UNIGRAM_MIN_LEN)]
    asked = [e.lower() for e in typed] + [e.lower() for e in titled] + runs
    if not asked:
        return []
    terms = spark.createDataFrame([(t,) for t in dict.fromkeys(asked)], "term string")
    exact = vocab.join(F.broadcast(terms), vocab["key"] == terms["term"]).select("term", "key")
    found = {r.term: r.key for r in exact.collect()}
    missing = terms.filter(~F.col("term").isin(list(found)) if found else F.lit(True))
    found |= {r.term: r.key for r in corrected(missing, vocab, index).collect()}
    out = [found.get(e.lower(), e.lower()) for e in typed]
    out += [found[t] for t in [e.lower() for e in titled] + runs if t in found]
    return list(dict.fromkeys(out))
