"""Snapshots of a project against the registry of its footage: diff, merge, owners and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Footage and minutes that each plan allows.
PLANS = {"free": (3, 120), "pro": (50, 600), "studio": (500, 6000)}
NEEDS_ATTENTION = ("error", "indexing", "uploading")


def readable(size: Column, mtime: Column) -> Column:
    return F.coalesce((size > 0) & (mtime > 0), F.lit(False))


def diff(snapshot: DataFrame, registry: DataFrame, keys: tuple[str, ...] = ("footage_key",), version: int = 2, confirmations: int = 2) -> DataFrame:
    """keys and bucket (added, changed, removed, unchanged or pending) of each footage of either side.

    A full outer join; the tests are tried in order: unknown, stale, unreadable, equal, other format, drift.
    A drift is confirmed when the same stats have been pending before, `confirmations` sightings in all.
    """
    s = snapshot.select(*keys, "size", "mtime_ns", F.lit(True).alias("seen"))
    r = registry.select(*keys, F.col("size").alias("r_size"), F.col("mtime_ns").alias("r_mtime"), F.col("format_version").alias("r_format"), "state", "pending_size", "pending_mtime_ns", "pending_hits", F.lit(True).alias("known"))
    ok = readable(F.col("size"), F.col("mtime_ns"))
    same = F.col("r_size").eqNullSafe(F.col("size")) & F.col("r_mtime").eqNullSafe(F.col("mtime_ns"))
    again = F.col("pending_size").eqNullSafe(F.col("size")) & F.col("pending_mtime_ns").eqNullSafe(F.col("mtime_ns"))
    bucket = (
        F.when(F.col("seen").isNull(), F.when(F.col("state").eqNullSafe("stale"), None).otherwise("removed"))
        .when(F.col("known").isNull() | F.col("state").eqNullSafe("stale"), F.when(ok, "added").otherwise("pending"))
        .when(~ok, "unchanged")
        .when(~F.col("r_format").eqNullSafe(F.lit(version)), "changed")
        .when(same, "unchanged")
        .when(again & (F.coalesce("pending_hits", F.lit(0)) + 1 >= confirmations), "changed")
        .otherwise("pending")
    )
    return s.join(r, list(keys), "full_outer").select(*keys, bucket.alias("bucket")).filter("bucket IS NOT NULL")


def apply(snapshot: DataFrame, buckets: DataFrame, registry: DataFrame, keys: tuple[str, ...] = ("footage_key",), version: int = 2) -> DataFrame:
    """The registry after a sync: added and changed entries anew, removed ones stale, pending ones counted."""
    s = snapshot.select(*keys, *(F.col(c).alias(f"s_{c}") for c in ("path", "size", "mtime_ns", "item_id", "frame_rate")))
    joined = registry.withColumn("_known", F.lit(True)).join(buckets, list(keys), "full_outer").join(s, list(keys), "left").filter("_known OR bucket IN ('added', 'changed')")
    fresh = F.coalesce(F.col("bucket").isin("added", "changed"), F.lit(False))
    again = F.col("pending_size").eqNullSafe(F.col("s_size")) & F.col("pending_mtime_ns").eqNullSafe(F.col("s_mtime_ns"))
    pending = F.coalesce(F.col("bucket") == "pending", F.lit(False))
    kept = ~F.coalesce(F.col("bucket").isin("added", "changed", "removed", "unchanged"), F.lit(False))
    new = {"path": F.col("s_path"), "content_id": F.lit(""), "size": F.col("s_size"), "mtime_ns": F.col("s_mtime_ns"), "item_id": F.col("s_item_id"), "frame_rate": F.col("s_frame_rate"), "format_version": F.lit(version), "shot_count": F.lit(0), "duration_s": F.lit(0.0)}
    out = {c: F.when(fresh, v).otherwise(F.col(c)) for c, v in new.items() if c in registry.columns}
    out["state"] = F.when(fresh, "indexing").when(F.col("bucket") == "removed", "stale").otherwise(F.col("state"))
    out["pending_size"] = F.when(pending, F.col("s_size")).when(kept, F.col("pending_size"))
    out["pending_mtime_ns"] = F.when(pending, F.col("s_mtime_ns")).when(kept, F.col("pending_mtime_ns"))
    out["pending_hits"] = F.when(pending, F.when(again, F.coalesce("pending_hits", F.lit(0)) + 1).otherwise(1)).when(kept, F.col("pending_hits"))
    return joined.select(*(out[c].cast(registry.schema[c].dataType).alias(c) if c in out else F.col(c) for c in registry.columns))


def pruned(registry: DataFrame) -> DataFrame:
    """The registry without stale entries."""
    return registry.filter("state IS NULL OR state <> 'stale'")


def owners(registry: DataFrame, wanted: list[str] | DataFrame | None = None) -> DataFrame:
    """content_id and footage_key, path of its first ready footage by key; of all footage, or of the wanted keys alone (a few, or
    a table of footage_key)."""
    ready = registry.filter("state = 'ready' AND content_id <> ''")
    if isinstance(wanted, DataFrame):
        ready = ready.join(wanted.select("footage_key"), "footage_key", "left_semi")
    elif wanted:
        ready = ready.filter(F.col("footage_key").isin(wanted))
    return ready.groupBy("content_id").agg(F.min(F.struct("footage_key", "path")).alias("o")).select("content_id", "o.footage_key", F.col("o.path").alias("source_path"))


def owned(results: DataFrame, registry: DataFrame, wanted: list[str] | DataFrame | None = None) -> DataFrame:
    """Results with their owner; those of unknown contents go."""
    return results.join(owners(registry, wanted), "content_id")


def allowed_work(work: DataFrame, plans: DataFrame, tenant: str = "tenant") -> DataFrame:
    """tenant, n_active, minutes and allowed: whether new work fits the tenant's plan.

    work: tenant, footage_key, bucket, state, duration_s; plans: tenant, plan. Unknown plans count as free;
    without added or changed footage all is allowed; pending and removed footage does not count.
    """
    active = F.col("bucket").isin("added", "changed", "unchanged")
    minutes = F.sum(F.when(active & (F.col("state") == "ready"), F.coalesce("duration_s", F.lit(0.0))).otherwise(0.0)) / 60.0
    facts = work.groupBy(tenant).agg(F.count_distinct(F.when(active, F.col("footage_key"))).alias("n_active"), minutes.alias("minutes"), F.bool_or(F.col("bucket").isin("added", "changed")).alias("has_new"))
    limit = lambda i: F.coalesce(F.element_at(F.create_map(*(x for k, v in PLANS.items() for x in (F.lit(k), F.lit(v[i])))), F.coalesce("plan", F.lit(""))), F.lit(PLANS["free"][i]))
    judged = facts.join(plans.select(tenant, "plan"), tenant, "left")
    return judged.select(tenant, "n_active", "minutes", (~F.col("has_new") | ((F.col("n_active") <= limit(0)) & (F.col("minutes") <= limit(1)))).alias("allowed"))


def debounced(observations: DataFrame, confirmations: int = 2) -> DataFrame:
    """observations (footage, seq, size, mtime_ns) with `confirmed`: as many equal sightings in a row, this one last."""
    order = Window.partitionBy("footage").orderBy("seq")
    equal = F.lit(True)
    for k in range(1, confirmations):
        equal = equal & F.coalesce((F.lag("size", k).over(order) == F.col("size")) & (F.lag("mtime_ns", k).over(order) == F.col("mtime_ns")), F.lit(False))
    return observations.withColumn("confirmed", equal)


def stranded(footage: DataFrame, jobs: DataFrame) -> DataFrame:
    """Footage that needs attention and that no live job covers; none at all while a job has no footage_key."""
    unclear = jobs.filter("footage_key IS NULL OR footage_key = ''").limit(1)
    open_ = footage.filter(F.col("state").isin(*NEEDS_ATTENTION)).join(jobs.select("footage_key"), "footage_key", "left_anti")
    return open_.join(F.broadcast(unclear.select(F.lit(1).alias("_unclear"))), how="left_anti", on=F.lit(True))  # one row at most
