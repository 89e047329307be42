"""Interval joins by time buckets, and window-like operations on spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap(left: DataFrame, right: DataFrame, key: str, bucket: float = 16.0, closed: bool = False) -> DataFrame:
    """Pairs of rows of one key whose spans (t0, t1) and (start, end) overlap.

    Open bounds by default: spans that only touch do not meet; closed bounds let them. Both sides are spread
    over the buckets they touch, so the join is an equi-join; a pair is kept in its first common bucket alone.
    """
    spread = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor(F.greatest(F.col(a), F.col(b)) / bucket)))
    lhs, rhs = left.withColumn("_bucket", spread("t0", "t1")), right.withColumn("_bucket", spread("start", "end"))
    first = F.greatest(F.floor(F.col("t0") / bucket), F.floor(F.col("start") / bucket))
    meets = (F.col("end") >= F.col("t0")) & (F.col("start") <= F.col("t1")) if closed else (F.col("end") > F.col("t0")) & (F.col("start") < F.col("t1"))
    return lhs.join(rhs, [key, "_bucket"]).filter(meets & (F.col("_bucket") == first)).drop("_bucket")


def segment_text(text: Column, words: Column, t0: Column, t1: Column) -> Column:
    """A segment's share of a window: its words that overlap, or all of it where it has no timed words.

    Words that carry their own blanks, and texts without blanks, are put together as they are.
    """
    inside = F.transform(F.filter(words, lambda w: (w["end"] > t0) & (w["start"] < t1)), lambda w: w["word"])
    glued = F.exists(words, lambda w: w["word"].rlike(r"(?U)^\s")) | ~F.contains(text, F.lit(" "))
    return F.when(F.coalesce(F.size(words), F.lit(0)) <= 0, F.concat(F.lit(" "), text)).when(glued, F.array_join(inside, "")).otherwise(F.concat(F.lit(" "), F.array_join(inside, " ")))


def text_in_window(spans: DataFrame, segments: DataFrame, key: str, ids: tuple[str, ...], bucket: float = 16.0) -> DataFrame:
    """ids and said: the words of each span's window in segment order, blanks collapsed; "" where there are none."""
    met = overlap(spans.select(key, *ids, "t0", "t1"), segments, key, bucket)
    part = segment_text(F.col("text"), F.col("words"), F.col("t0"), F.col("t1"))
    joined = met.groupBy(key, *ids).agg(F.array_sort(F.collect_list(F.struct("seg_id", part.alias("part")))).alias("parts"))
    said = F.regexp_replace(F.regexp_replace(F.array_join(F.transform("parts", lambda p: p["part"]), ""), r"(?U)\s+", " "), "^ | $", "")
    return spans.select(key, *ids).join(joined.select(key, *ids, said.alias("said")), [key, *ids], "left").withColumn("said", F.coalesce("said", F.lit("")))


def merge_spans(spans: DataFrame, key: str) -> DataFrame:
    """key, start, end and score: spans that touch or overlap made one, the greatest score kept. Unknown ends come last."""
    order = Window.partitionBy(key).orderBy(F.asc_nulls_last("start"), F.asc_nulls_last("end"))
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") <= before, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return spans.withColumn("_island", island).groupBy(key, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("score").alias("score")).drop("_island")


def split_spans(scenes: DataFrame, longest: float = 8.0) -> DataFrame:
    """Scenes (start, end) cut into equal parts of at most `longest`: adds part, t0 and t1."""
    parts = F.greatest(F.lit(1), F.ceil((F.col("end") - F.col("start")) / longest - 1e-6)).cast("int")
    step = (F.col("end") - F.col("start")) / F.col("_parts")
    cut = scenes.withColumn("_parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return cut.withColumns({"t0": F.col("start") + F.col("part") * step, "t1": F.col("start") + (F.col("part") + 1) * step}).drop("_parts")
