"""The labelled rows that the two classifiers learn from: never held-out ones, and a bounded number a class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents of each class that a classifier learns from at most.
ROWS_PER_CLASS = 1_500


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True where crc32(doc_id as text) mod modulus is the remainder; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, rows: int = ROWS_PER_CLASS, also: tuple[Column, ...] = ()) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, text, label, and `also`, of up to `rows` documents of each class, fixed by a hash, and each class's size.

    A document that is labelled twice has the greater label; labels that are null or not 0 or 1 are ignored.
    """
    y = F.col(label).cast("int")
    usable = labels.filter(F.col("doc_id").isNotNull() & y.isin(0, 1) & ~held_out(F.col("doc_id"), modulus, remainder))
    usable = usable.groupBy("doc_id").agg(F.max(y).alias("label"))
    sizes = {r.label: r["count"] for r in usable.groupBy("label").count().collect()}
    chosen = None
    for value in (0, 1):
        part = usable.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        chosen = part if chosen is None else chosen.union(part)
    return docs.select("doc_id", "text", *also).join(F.broadcast(chosen), "doc_id"), sizes  # at most 2 * rows ids
