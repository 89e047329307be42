"""Jobs, uploads and the state of the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIVE = ("queued", "running")
#: Reply codes of a link that failed, the one that is waited out, and misses until a call has failed.
TRANSPORT, ASLEEP, MISSES = ("UNREACHABLE", "ASLEEP", "TIMEOUT"), "ASLEEP", 5
ERROR_CHARS = 500


def latest(jobs: DataFrame, key: str = "content_id", live: bool = False) -> DataFrame:
    """Each key's newest job, or newest live one; equal times go by job_id."""
    rows = jobs.filter(F.col("state").isin(*LIVE)) if live else jobs
    order = Window.partitionBy(key).orderBy(F.desc("created_at"), F.desc("job_id"))
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def _stage(s: Column, state: Column, done: Column | None = None, total: Column | None = None) -> Column:
    return F.struct(s["name"].alias("name"), state.alias("state"), (s["done"] if done is None else done).alias("done"), (s["total"] if total is None else total).alias("total"))


def recovered_stages(stages: Column) -> Column:
    """Stages of a job found live after a restart: what ran is pending again, with its counts; the rest stays."""
    return F.transform(stages, lambda s: _stage(s, F.when(s["state"] == "running", "pending").otherwise(s["state"])))


def recover(jobs: DataFrame) -> DataFrame:
    """Jobs after a restart, oldest first: live ones are queued again."""
    live = F.col("state").isin(*LIVE)
    return jobs.withColumns({"stages": F.when(live, recovered_stages(F.col("stages"))).otherwise(F.col("stages")), "state": F.when(live, "queued").otherwise(F.col("state"))}).orderBy("created_at", "job_id")


def lifecycle(events: DataFrame, stages: tuple[str, ...], key: str = "job_id") -> DataFrame:
    """key, state, error and stages of each job after its events, taken in order of seq.

    events: key, seq, kind (submit, start, progress, stage_done, finish, fail, cancel or restart), stage, done, total,
    error. A job is cancelled only while it is queued, and ends only while it runs; a stage's progress may go back.
    """
    kinds = ("kind", "stage", "done", "total", "error")
    listed = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", *kinds))).alias("events"))
    fresh = F.array(*(F.struct(F.lit(n).alias("name"), F.lit("pending").alias("state"), F.lit(0).cast("long").alias("done"), F.lit(0).cast("long").alias("total")) for n in stages))
    start = F.struct(F.lit("queued").alias("state"), F.lit(None).cast("string").alias("error"), fresh.alias("stages"))

    def step(job: Column, e: Column) -> Column:
        kind, running = e["kind"], job["state"] == "running"
        fails, ends = (kind == "fail") & running, (kind == "finish") & running
        restarts = (kind == "restart") & job["state"].isin(*LIVE)
        state = F.when((kind == "start") & (job["state"] == "queued"), "running").when(ends, "done").when(fails, "error").when((kind == "cancel") & (job["state"] == "queued"), "cancelled").when(restarts, "queued").otherwise(job["state"])

        def stage(s: Column) -> Column:
            mine, busy = s["name"].eqNullSafe(e["stage"]), s["state"] == "running"
            full = (s["total"] > 0) & (s["done"] < s["total"])
            return (
                F.when(mine & (kind == "progress"), _stage(s, F.lit("running"), F.coalesce(e["done"], F.lit(0).cast("long")), F.coalesce(e["total"], F.lit(0).cast("long"))))
                .when(mine & (kind == "stage_done"), _stage(s, F.lit("done"), F.when(full, s["total"]).otherwise(s["done"])))
                .when(ends, _stage(s, F.lit("done")))
                .when(busy & fails, _stage(s, F.lit("error")))
                .when(busy & restarts, _stage(s, F.lit("pending")))
                .otherwise(s)
            )

        error = F.when(fails, clipped_error(e["error"])).when((kind == "cancel") & (job["state"] == "queued"), "cancelled by user").otherwise(job["error"])
        return F.struct(state.alias("state"), error.alias("error"), F.transform(job["stages"], stage).alias("stages"))

    return listed.select(key, F.aggregate("events", start, step).alias("job")).select(key, "job.state", "job.error", "job.stages")


def clipped_error(error: Column, most: int = ERROR_CHARS) -> Column:
    return F.substring(error, 1, most)


def cancelled(state: Column) -> Column:
    """What a request to cancel comes to: only a queued job can be; null is an unknown job."""
    return F.when(state.isNull(), "missing").when(state.isin("done", "error", "cancelled"), "terminal").when(state == "queued", "cancelled").otherwise("running")


def statuses(jobs: DataFrame) -> DataFrame:
    """What a client sees of a job."""
    return jobs.select("job_id", "footage_key", "state", F.coalesce("reused", F.lit(False)).alias("reused"), "stages", "error", "reason")


def handed_off(state: Column, job_id: Column, needs_upload: Column, received_: Column) -> Column:
    """The next step of handing footage to the engine, and the offset an upload goes on from."""
    action = F.when(state == "ready", "reuse").when((state == "indexing") & job_id.isNotNull(), "attach").when(F.coalesce(needs_upload, F.lit(False)), "upload").otherwise("index")
    offset = F.when((action == "upload") & (state == "partial"), F.coalesce(received_, F.lit(0))).otherwise(0).cast("long")
    return F.struct(action.alias("action"), offset.alias("offset"))


def called(replies: Column, misses: int = MISSES) -> Column:
    """answered, failed or waiting, after the replies to one call in order: a sleeping engine is waited for without end,
    other failures of the link count as misses, which sleep does not undo, and any other reply is an answer."""

    def step(s: Column, code: Column) -> Column:
        missed = s["n"] + F.when(code.isin(*TRANSPORT) & (code != ASLEEP), 1).otherwise(0)
        outcome = F.when(s["outcome"] != "waiting", s["outcome"]).when(~code.isin(*TRANSPORT), "answered").when(missed >= misses, "failed").otherwise("waiting")
        return F.struct(outcome.alias("outcome"), missed.alias("n"))

    return F.aggregate(replies, F.struct(F.lit("waiting").alias("outcome"), F.lit(0).alias("n")), step, lambda s: s["outcome"])


def received(chunks: DataFrame, key: str = "content_id") -> DataFrame:
    """key, received, size and complete of each upload. chunks: key, seq (the order of arrival), offset, length, size.

    A chunk is accepted where it starts at what has been received, has the size that the first one declared, and does not
    run past it; any other is refused and changes nothing, so a client may send it again. The first chunk declares the
    size anew as long as nothing has been received. size is 0 where no chunk was accepted.
    """
    listed = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", F.col("offset").cast("long").alias("offset"), F.col("length").cast("long").alias("length"), F.col("size").cast("long").alias("size")))).alias("chunks"))
    zero = F.lit(0).cast("long")

    def step(s: Column, c: Column) -> Column:
        fits = (c["offset"] == s["received"]) & ((s["received"] == 0) | (c["size"] == s["size"])) & (c["offset"] + c["length"] <= c["size"]) & ((s["size"] == 0) | (s["received"] < s["size"]))
        return F.struct(F.when(fits, s["received"] + c["length"]).otherwise(s["received"]).alias("received"), F.when(fits, c["size"]).otherwise(s["size"]).alias("size"))

    out = listed.select(key, F.aggregate("chunks", F.struct(zero.alias("received"), zero.alias("size")), step).alias("s"))
    return out.select(key, "s.received", "s.size", ((F.col("s.size") > 0) & (F.col("s.received") == F.col("s.size"))).alias("complete"))


def library_state(live: Column, index: Column, last_error: Column, complete: Column, received_: Column) -> Column:
    """indexing, ready, error, stale, uploaded, partial or missing: the first that applies."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(yes(live), "indexing")
        .when(index.eqNullSafe("ready"), "ready")
        .when(yes(last_error), "error")
        .when(index.eqNullSafe("stale"), "stale")
        .when(yes(complete), "uploaded")
        .when(F.coalesce(received_, F.lit(0)) > 0, "partial")
        .otherwise("missing")
    )


def screen(ready: Column, indexing: Column, searching: Column, error: Column, n_results: Column) -> Column:
    """Which screen a client shows: the first that applies."""
    return (
        F.when(~ready & indexing, "job")
        .when(searching, "searching")
        .when(error & (n_results == 0), "error")
        .when(~ready, "empty")
        .when(n_results == 0, "nomatch")
        .otherwise("results")
    )


def step_order(stages: DataFrame, key: str = "job_id") -> DataFrame:
    """Display places of a job's stages: running in declared order, done and then others latest first; pending hidden.

    stages: key, name, state, pos (its place in the job), declared (its place in the fixed list, null if unlisted).
    """
    kind = F.when(F.col("declared").isNotNull() & (F.col("state") == "running"), 0).when(F.col("declared").isNotNull() & (F.col("state") == "done"), 1).otherwise(2)
    place = F.when(F.col("_kind") == 0, F.col("declared")).when(F.col("_kind") == 1, -F.col("declared")).otherwise(-F.col("pos"))
    shown = stages.filter("state <> 'pending'").withColumn("_kind", kind).withColumn("_place", place)
    return shown.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("_kind", "_place"))).drop("_kind", "_place")
