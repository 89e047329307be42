"""The data model's tables derived from the generic test tables, by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewise.functions import text as T
from framewise.operators.captions import propagate

#: Shots of a content, shots of a scene, and the distance of representatives.
PER_CONTENT, PER_SCENE, PER_REP = 100, 5, 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row and v."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.col("embedding").alias("v"))


def text_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shot per document, with or without an embedding: ids, texts and entities."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row"), "text", "source")
    masked = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row")).distinct().withColumn("_m", F.lit(True))
    shot = (F.col("row") % PER_CONTENT).cast("int")
    return docs.join(masked, "row", "left").select(
        "row",
        F.concat(F.lit("c"), F.lpad(F.floor(F.col("row") / PER_CONTENT).cast("string"), 15, "0")).alias("content_id"),
        shot.alias("shot_id"),
        F.floor(shot / PER_SCENE).cast("int").alias("scene_id"),
        F.col("text").alias("dialogue_en"),
        F.col("source").alias("ocr_text"),
        F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{5,}"), F.lit(0))).alias("entities"),
        F.coalesce("_m", F.lit(False)).alias("d_mask"),
    )


def plain_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shots without captions: ids, texts, entities, and the visual and dialogue vectors."""
    emb = vectors(spark, sf_dir)
    n = emb.agg(F.count("*").alias("n"))
    base = text_shots(spark, sf_dir).join(emb, "row").join(F.broadcast(n), how="cross")  # one row
    base = base.withColumn("_next", (F.col("row") + 1) % F.col("n")).join(emb.select(F.col("row").alias("_next"), F.col("v").alias("d")), "_next")
    return base.select("row", "content_id", "shot_id", "scene_id", "dialogue_en", "ocr_text", "entities", "v", "d", "d_mask")


def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rep and rv: every PER_REP-th shot."""
    return vectors(spark, sf_dir).filter(F.col("row") % PER_REP == 0).select(F.col("row").alias("rep"), F.col("v").alias("rv"))


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full shots: captions come from the nearest representative, whose vector stands for the caption's."""
    base = plain_shots(spark, sf_dir)
    near = propagate(base, representatives(spark, sf_dir)).select("row", "rep", F.col("confidence").alias("caption_conf"))
    captions = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rep"), F.col("text").alias("caption"))
    c = vectors(spark, sf_dir).select(F.col("row").alias("rep"), F.col("v").alias("c"))
    out = base.join(near, "row").join(captions, "rep").join(c, "rep")
    none = F.array().cast("array<string>")
    return out.withColumn("tokens", T.tokenize(T.search_text(F.col("dialogue_en"), F.col("caption"), F.col("ocr_text"), F.col("entities"), none, F.col("dialogue_en"))))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A segment per turn of a conversation, five seconds long, one each four seconds; its words share its time."""
    c = table(spark, sf_dir, "conversations")
    words = F.filter(F.split("text", " "), lambda w: w != "")
    timed = F.transform(words, lambda w, i: F.struct(w.alias("word"), (F.col("start") + 5.0 * i / F.size(words)).alias("start"), (F.col("start") + 5.0 * (i + 1) / F.size(words)).alias("end")))
    base = c.select("conv_id", F.col("turn").alias("seg_id"), "text", (4.0 * F.col("turn")).alias("start"), (4.0 * F.col("turn") + 5.0).alias("end"))
    return base.withColumn("words", F.when(F.col("seg_id") % 2 == 0, timed))


def grid(spark: SparkSession, sf_dir: str, pad: float = 0.0) -> DataFrame:
    """Spans of eight seconds over each conversation, widened by pad on both sides."""
    ends = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max(4.0 * F.col("turn") + 5.0).alias("last"))
    spans = ends.select("conv_id", F.explode(F.sequence(F.lit(0), F.floor((F.col("last") - 1e-9) / 8.0).cast("int"))).alias("shot_id"))
    return spans.select("conv_id", "shot_id", (8.0 * F.col("shot_id") - pad).alias("t0"), (8.0 * F.col("shot_id") + 8.0 + pad).alias("t1"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An observation per event: footage is the user, size the whole part of the value over 25."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("footage"), F.struct("ts", "event_id").alias("seq"), F.col("event_id"), F.floor(F.col("value") / 25).cast("long").alias("size"), F.lit(1).cast("long").alias("mtime_ns"))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entry per customer: states and pending stats by remainders of the key."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    state = F.when(k % 11 == 0, "stale").when(k % 7 == 0, "error").when(k % 3 == 0, "indexing").otherwise("ready")
    path = F.concat(F.lit("/footage/"), F.col("c_name"))
    return c.select(
        T.footage_key(path).alias("footage_key"),
        path.alias("path"),
        F.concat(F.lit("c"), F.lpad((k % 40).cast("string"), 15, "0")).alias("content_id"),
        F.floor(F.abs("c_acctbal")).cast("long").alias("size"),
        (k * 1000).cast("long").alias("mtime_ns"),
        k.cast("long").alias("item_id"),
        F.lit(25.0).alias("frame_rate"),
        F.when(k % 13 == 0, 1).otherwise(2).alias("format_version"),
        state.alias("state"),
        (k % 50).cast("int").alias("shot_count"),
        ((k % 90) * 10.0).alias("duration_s"),
        F.when(k % 5 == 0, F.floor(F.abs("c_acctbal")).cast("long") + 1).alias("pending_size"),
        F.when(k % 5 == 0, k * 1000).cast("long").alias("pending_mtime_ns"),
        F.when(k % 5 == 0, 1).cast("int").alias("pending_hits"),
    )


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a project shows of those customers: some gone, some changed, some unreadable, and new footage."""
    c = table(spark, sf_dir, "customer")
    k, size = F.col("c_custkey"), F.floor(F.abs("c_acctbal")).cast("long")
    seen = c.filter(k % 17 != 0).select(
        F.concat(F.lit("/footage/"), F.col("c_name")).alias("path"),
        F.when(k % 19 == 0, -1).when(k % 4 == 0, size + 1).otherwise(size).cast("long").alias("size"),
        F.when(k % 19 == 0, 0).otherwise(k * 1000).cast("long").alias("mtime_ns"),
        k.cast("long").alias("item_id"),
        F.lit(25.0).alias("frame_rate"),
    )
    s = table(spark, sf_dir, "supplier")
    new = s.select(F.concat(F.lit("/new/"), F.col("s_name")).alias("path"), F.floor(F.abs("s_acctbal")).cast("long").alias("size"), F.col("s_suppkey").cast("long").alias("mtime_ns"), F.col("s_suppkey").cast("long").alias("item_id"), F.lit(30.0).alias("frame_rate"))
    return seen.unionByName(new).withColumn("footage_key", T.footage_key(F.col("path")))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job per order: its content, state and time by remainders of the key."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    state = F.when(k % 5 == 0, "running").when(k % 7 == 0, "queued").when(k % 11 == 0, "error").otherwise("done")
    return o.select(F.concat(F.lit("j"), k.cast("string")).alias("job_id"), (F.col("o_custkey") % 500).cast("long").alias("content_id"), state.alias("state"), (F.col("o_custkey") % 97).cast("double").alias("created_at"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk per order and line, in order of seq: each order is an upload whose chunks start where the running sum of
    quantities ends, but some are shifted, sent twice, too early and again, or with another size."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum(F.col("l_quantity").cast("long")).alias("length"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    length = F.col("length")
    start = F.coalesce(F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = li.select(F.col("l_orderkey").alias("content_id"), "l_linenumber", length.alias("length"), start.alias("_start"), F.sum(length).over(Window.partitionBy("l_orderkey")).alias("size"))
    of, line = F.col("content_id"), F.col("l_linenumber")
    shifted = (of % 3 == 0) & (line == 3)
    arrivals = F.when((of % 7 == 2) & (line == 3), F.array(F.lit(16), F.lit(35))).when((of % 5 == 1) & (line == 1), F.array(F.lit(10), F.lit(15))).otherwise(F.array((line * 10).cast("int")))
    sent = base.withColumn("seq", F.explode(arrivals))
    return sent.select("content_id", "seq", F.when(shifted, F.col("_start") + 1).otherwise(F.col("_start")).alias("offset"), "length", F.when((of % 11 == 3) & (line == 2), F.col("size") + 1).otherwise(F.col("size")).alias("size"))
