"""Snapshot sync as a stream: each micro-batch of snapshots is diffed and merged into the stored registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from framewise import schemas
from framewise.functions import text as T
from framewise.operators import sync
from framewise.sources.files import read_registry, write_registry
from framewise.sources.store import written


def sync_once(spark: SparkSession, root: str, version: int, snapshot: DataFrame, confirmations: int = 2) -> int:
    """Merge one snapshot into the registry of a version; returns the next version."""
    keyed = snapshot.withColumn("footage_key", T.footage_key(F.col("path")))
    before = read_registry(spark, f"{root}/registry/v={version}")
    buckets = sync.diff(keyed, before, confirmations=confirmations)
    after = sync.apply(keyed, buckets, before)
    write_registry(after, f"{root}/registry/v={version + 1}")
    return version + 1


def sync_stream(snapshots: DataFrame, root: str, checkpoint: str, confirmations: int = 2) -> StreamingQuery:
    """snapshots: a stream of the snapshot schema and `seq`; each seq is one whole snapshot, taken in order.

    A micro-batch that is repeated after a failure finds the versions it has written, and writes them no more.
    """

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        for row in batch.select("seq").distinct().orderBy("seq").collect():  # the few snapshots of one micro-batch
            version = int(row.seq)
            if written(spark, f"{root}/registry/v={version + 1}"):
                continue
            sync_once(spark, root, version, batch.filter(F.col("seq") == row.seq).drop("seq"), confirmations)
        batch.unpersist()

    return snapshots.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Snapshots from JSON lines of a folder."""
    return spark.readStream.schema(StructType([*schemas.SNAPSHOT.fields, StructField("seq", LongType())])).json(path)
