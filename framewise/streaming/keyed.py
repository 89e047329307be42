"""Snapshot sync as keyed state: one state row for each footage, in place of a registry that is written anew.

A snapshot is seen as one sighting of each footage it lists, with the snapshot's number. A footage's state holds its registry
entry and the number of the last snapshot that listed it. What is missing from a snapshot sends nothing: an entry is stale if
newer snapshots have not listed it, which its state finds out when it is listed again, and a reader by the newest number of all.
Each sighting gives one row; registry_at puts these together to the registry after a snapshot. States have no time limit: with
one, a run over all that is available would wait for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StringType, StructField, StructType

from framewise import schemas
from framewise.functions import text as T
from framewise.session import ship

ENTRY = StructType([*(f for f in schemas.REGISTRY.fields if f.name != "footage_key"), StructField("seq", LongType())])
SIGHTINGS = StructType([StructField("footage_key", StringType()), *ENTRY.fields, StructField("bucket", StringType())])
_NAMES = ENTRY.names


def advanced(entry: dict | None, seen: dict, version: int = 2, confirmations: int = 2) -> tuple[dict | None, str]:
    """A footage's entry after a snapshot lists it, and the bucket it falls into; by the rules of sync.diff and sync.apply.

    An entry that a snapshot in between did not list has become stale there. A footage that is unknown and unreadable stays so.
    """
    readable = (seen["size"] or 0) > 0 and (seen["mtime_ns"] or 0) > 0
    if entry is not None and entry["seq"] < seen["seq"] - 1 and entry["state"] != "stale":
        entry = {**entry, "state": "stale", "pending_size": None, "pending_mtime_ns": None, "pending_hits": None}
    stats = (seen["size"], seen["mtime_ns"])
    again = entry is not None and (entry["pending_size"], entry["pending_mtime_ns"]) == stats
    if entry is None or entry["state"] == "stale":
        bucket = "added" if readable else "pending"
    elif not readable or (entry["format_version"] == version and (entry["size"], entry["mtime_ns"]) == stats):
        bucket = "unchanged"
    elif entry["format_version"] != version or (again and (entry["pending_hits"] or 0) + 1 >= confirmations):
        bucket = "changed"
    else:
        bucket = "pending"
    none = {"pending_size": None, "pending_mtime_ns": None, "pending_hits": None}
    if bucket in ("added", "changed"):
        fresh = {"content_id": "", "format_version": version, "state": "indexing", "shot_count": 0, "duration_s": 0.0}
        return {**{c: seen[c] for c in ("path", "size", "mtime_ns", "item_id", "frame_rate", "seq")}, **fresh, **none}, bucket
    if entry is None:
        return None, bucket
    if bucket == "pending":
        none = {"pending_size": stats[0], "pending_mtime_ns": stats[1], "pending_hits": (entry["pending_hits"] or 0) + 1 if again else 1}
    return {**entry, **none, "seq": seen["seq"]}, bucket


def _moved(version: int, confirmations: int):
    """What moves a footage's state on by its sightings in order of their snapshots; an older snapshot than the last is ignored."""

    def move(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        entry = dict(zip(_NAMES, state.get, strict=True)) if state.exists else None
        out = []
        for seen in sorted((r for part in parts for r in _rows(part)), key=lambda r: r["seq"]):  # the sightings of one footage in a batch
            if entry is not None and seen["seq"] <= entry["seq"]:
                continue
            entry, bucket = advanced(entry, seen, version, confirmations)
            out.append((key[0], *((entry or {"seq": seen["seq"]}).get(c) for c in _NAMES), bucket))
        if entry is not None:
            state.update(tuple(entry[c] for c in _NAMES))
        found = pd.DataFrame(out, columns=SIGHTINGS.names)
        for field in SIGHTINGS.fields:  # whole numbers with gaps
            if field.dataType.simpleString() in ("bigint", "int"):
                found[field.name] = found[field.name].astype("Int64")
        yield found

    return move


def _rows(part: pd.DataFrame) -> list[dict]:
    """Rows as dicts of plain values, None for what is missing."""
    plain = lambda v: None if v is None or v is pd.NA or v != v else v.item() if hasattr(v, "item") else v
    whole = {"size", "mtime_ns", "item_id", "format_version", "shot_count", "pending_size", "pending_mtime_ns", "pending_hits", "seq"}
    out = []
    for row in part.to_dict("records"):
        out.append({k: int(p) if (p := plain(v)) is not None and k in whole else p for k, v in row.items()})
    return out


def sightings(snapshots: DataFrame, version: int = 2, confirmations: int = 2) -> DataFrame:
    """A row for each footage and snapshot: its entry after it, and its bucket. snapshots: a stream of the snapshot schema and `seq`,
    which counts the snapshots of a project from its first one; a footage's rows of one batch may come in any order."""
    ship(snapshots.sparkSession)
    keyed = snapshots.withColumn("footage_key", T.footage_key(F.col("path"))).groupBy("footage_key")
    return keyed.applyInPandasWithState(_moved(version, confirmations), SIGHTINGS, ENTRY, "update", GroupStateTimeout.NoTimeout)


def keyed_stream(snapshots: DataFrame, root: str, checkpoint: str, confirmations: int = 2) -> StreamingQuery:
    """Run sightings() into root, each batch in a folder of its own that a repeated batch overwrites."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={number}")

    rows = sightings(snapshots, confirmations=confirmations)
    return rows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def registry_at(seen: DataFrame, seq: int) -> DataFrame:
    """The registry after a snapshot: each footage's last entry up to it, stale if that is of an older snapshot. seen: sightings."""
    rows = seen.filter((F.col("seq") <= seq) & F.col("state").isNotNull()).select(*schemas.REGISTRY.names, "seq")
    last = rows.groupBy("footage_key").agg(F.max_by(F.struct(*rows.columns), "seq").alias("e")).select("e.*")
    gone = (F.col("seq") < seq) & (F.col("state") != "stale")
    cleared = {c: F.when(~gone, F.col(c)) for c in ("pending_size", "pending_mtime_ns", "pending_hits")}
    return last.withColumns({**cleared, "state": F.when(gone, F.lit("stale")).otherwise(F.col("state"))}).drop("seq")
