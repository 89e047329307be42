"""A registry kept as a base and the changes since: a sync writes what it changed, not the whole.

The manifest, one small file that is replaced in one step, names the base, the changes in order, and their rows. A reader takes each
footage's last entry. Changes are put into a new base once they come to COMPACT of its rows, so what is written
over time stays in proportion to what changed. Folders that no manifest names were left by a writer that stopped; nobody reads
them, and the next new base removes them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise import schemas
from framewise.sources.store import Store

#: Changed rows over the base's rows from which on a new base is written, and changes that are kept apart at most.
COMPACT, MOST_CHANGES = 0.5, 64
MANIFEST = "manifest.json"


class Registry:
    """The registry at a root; one writer at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.store = spark, root.rstrip("/"), Store(spark, root)

    def manifest(self) -> dict:
        """base and changes, each a folder's name and its rows; empty where there is none that can be read."""
        found = self.store.read_json(MANIFEST)
        return found if found and "changes" in found else {"base": None, "changes": []}

    def read(self) -> DataFrame:
        """Each footage's last entry."""
        found = self.manifest()
        names = [x["name"] for x in [found["base"], *found["changes"]] if x]
        if not names:
            return self.spark.createDataFrame([], schemas.REGISTRY)
        parts = [self.spark.read.schema(schemas.REGISTRY).parquet(f"{self.root}/{n}").withColumn("_seq", F.lit(i)) for i, n in enumerate(names)]
        if len(parts) == 1:
            return parts[0].drop("_seq")
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        last = rows.groupBy("footage_key").agg(F.max_by(F.struct(*schemas.REGISTRY.names), "_seq").alias("e"))
        return last.select("e.*")

    def _write(self, kind: str, rows: DataFrame) -> dict:
        name = f"{kind}-{uuid.uuid4().hex}"
        rows.select(*schemas.REGISTRY.names).write.parquet(f"{self.root}/{name}")
        return {"name": name, "rows": self.spark.read.parquet(f"{self.root}/{name}").count()}

    def replace(self, rows: DataFrame) -> None:
        """All of rows as a new base; folders that the new manifest does not name go."""
        base = self._write("base", rows.orderBy("footage_key"))
        self.store.write_json(MANIFEST, {"base": base, "changes": []})
        for name in self.store.names(""):
            if name.startswith(("base-", "change-")) and name != base["name"]:
                self.store.delete(name)

    def merge(self, after: DataFrame, before: DataFrame) -> int:
        """Make `after` the registry's rows, given that they are `before` now; writes the rows that differ, and returns how many.
        Entries are never taken away, only marked; use replace() to prune."""
        same = F.lit(True)
        for c in schemas.REGISTRY.names[1:]:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        old = before.select("footage_key", *(F.col(c).alias(f"_{c}") for c in schemas.REGISTRY.names[1:]), F.lit(True).alias("_known"))
        changed = after.join(old, "footage_key", "left").filter(F.col("_known").isNull() | ~same)
        found = self.manifest()
        change = self._write("change", changed)
        if not change["rows"]:
            self.store.delete(change["name"])
            return 0
        changes = [*found["changes"], change]
        self.store.write_json(MANIFEST, {"base": found["base"], "changes": changes})
        rows = found["base"]["rows"] if found["base"] else 0
        if sum(c["rows"] for c in changes) > COMPACT * rows or len(changes) > MOST_CHANGES:
            self.replace(self.read())
        return change["rows"]
