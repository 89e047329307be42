"""Files and stored tables: content identities, registries, indexes and stage results."""

from __future__ import annotations

import io
import re
import tarfile
from collections.abc import Callable, Iterable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from framewise import schemas
from framewise.config import stage_key
from framewise.functions import text as T
from framewise.sources.store import Store, written


#: Names of thumbnails: up to seven digits, in no folder.
THUMBNAIL = re.compile(r"[0-9]{1,7}\.jpg")


def contents_of(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, size and content_id of each file of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", F.col("length").alias("size"), T.content_id(F.col("content")).alias("content_id"))


def packed(named: Iterable[tuple[str, bytes]]) -> bytes:
    """An uncompressed tar of files."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        for name, data in named:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    return out.getvalue()


def unpacked(archive: bytes) -> Iterator[tuple[str, bytes]]:
    """The thumbnails in a tar; whatever else it holds, or holds in folders, is left there."""
    with tarfile.open(fileobj=io.BytesIO(archive)) as tar:
        for member in tar:
            if member.isfile() and THUMBNAIL.fullmatch(member.name):
                yield member.name, tar.extractfile(member).read()


def read_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A stored table, or an empty one where there is none that can be read."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """A stored registry; an empty one where it is missing, half written, or no registry."""
    if written(spark, path):
        try:
            found = spark.read.parquet(path)
            if {"footage_key", "path", "state"} <= set(found.columns):
                return spark.read.schema(schemas.REGISTRY).parquet(path)
        except AnalysisException:
            pass
    return spark.createDataFrame([], schemas.REGISTRY)


def write_registry(registry: DataFrame, path: str) -> None:
    """Write a whole registry, in key order, to a new folder; one that was left half written is replaced."""
    registry.orderBy("footage_key").write.mode("errorifexists" if written(registry.sparkSession, path) else "overwrite").parquet(path)


def read_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs from one JSON file each, oldest first; files that cannot be read, or that are not named for their job, go."""
    schema = StructType.fromJson(schemas.JOBS.jsonValue()).add("_bad", "string")
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("multiLine", "true").option("pathGlobFilter", "*.json").json(folder)
    named = F.col("_metadata.file_name") == F.concat("job_id", F.lit(".json"))
    return rows.filter(F.col("_bad").isNull() & F.col("job_id").isNotNull() & named).drop("_bad").orderBy("created_at", "job_id")


def ready(contents: DataFrame, signature: str) -> DataFrame:
    """Contents of a signature, with a well-formed id, by id."""
    return contents.filter((F.col("signature") == signature) & T.valid_content_id(F.col("content_id"))).orderBy("content_id")


#: The stored tables of an index, each in folders by content and build, and their schemas.
INDEX = {"shots": StructType([*schemas.SHOTS.fields, StructField("row", LongType())]), "blocks": schemas.BLOCKS, "terms": schemas.TERMS, "statistics": schemas.STATISTICS}


def save_index(root: str, contents: DataFrame, **tables: DataFrame) -> None:
    """Store the tables of a build (each with content_id and build), then the contents that name it.

    A build has folders of its own, so readers of the one before are not disturbed until the contents name the new one, and a
    build that was stopped half-way is never read. Builds that no content names any more are deleted last.
    """
    for name, table in tables.items():
        table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("content_id", "build").parquet(f"{root}/{name}")
    contents.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("content_id").parquet(f"{root}/contents")
    store = Store(contents.sparkSession, root)
    for row in contents.select("content_id", "build").collect():  # the contents of one call
        for name in INDEX:
            folder = f"{name}/content_id={row.content_id}"
            for build in store.names(folder):
                if build.startswith("build=") and build != f"build={row.build}":
                    store.delete(f"{folder}/{build}")


def load_index(spark: SparkSession, root: str, name: str, contents: DataFrame) -> DataFrame:
    """A stored table's rows of the contents (content_id, build, and whatever else is joined to them); the join's keys are the
    folders that are read."""
    schema = StructType([*INDEX[name].fields, *(f for f in (StructField("content_id", StringType()), StructField("build", StringType())) if f.name not in INDEX[name].names)])
    return read_or_empty(spark, f"{root}/{name}", schema).join(F.broadcast(contents), ["content_id", "build"])  # a row per content


def stage(spark: SparkSession, root: str, name: str, dependencies: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """A stage's stored result for these dependencies, made and stored where there is none, or only a torn one."""
    path = f"{root}/stages/{name}_{stage_key(dependencies)}"
    if written(spark, path):
        try:
            return spark.read.parquet(path)
        except AnalysisException:
            pass
    made = make()
    made.write.mode("overwrite").parquet(path)
    return spark.read.schema(made.schema).parquet(path)
