"""Cuts between scenes from a table of frames: where a frame differs far more from the one before than its neighbours do.

A frame is a candidate if its score is at least `least`, and at least `ratio` times the mean of the `width` scores on both sides.
A candidate is a cut if the last cut (at first the content's first frame) is `gap` frames back or more. The first test looks at a
few neighbours, so contents are dealt in chunks of frames whose edges carry their neighbours' frames with them. The second
one hangs on all cuts before, but only by how many frames the last one is back, up to `gap`: each chunk is summed up as a
table from what comes in to what goes out, the small tables of a content are followed in order, and each chunk then
finds its own cuts. No task holds more than a chunk's frames, or a content's tables.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Frames of a chunk; fixed default values of the detector: ratio, least score, frames on each side, frames between cuts.
CHUNK_FRAMES, RATIO, LEAST, WIDTH, GAP = 4_096, 3.0, 15.0, 2, 15
#: The ratio where neighbours do not differ at all, and the mean that counts as none.
MOST_RATIO, NO_MEAN = 255.0, 1e-5


def candidates(frames: DataFrame, ratio: float = RATIO, least: float = LEAST, width: int = WIDTH, chunk: int = CHUNK_FRAMES) -> DataFrame:
    """content_id and frame of the candidates. frames: content_id, frame (0, 1, 2 ... without gaps) and score (null counts as 0).

    Frames too near to either end to have all neighbours are none.
    """
    home = F.floor(F.col("frame") / chunk)
    spread = F.array_distinct(F.array(home, F.floor((F.col("frame") - width) / chunk), F.floor((F.col("frame") + width) / chunk)))
    dealt = frames.select("content_id", F.col("frame").cast("long").alias("frame"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"), F.explode(spread).alias("chunk"))
    order = Window.partitionBy("content_id", "chunk").orderBy("frame")
    around = lambda a, b: F.sum("score").over(order.rowsBetween(a, b))
    sides = F.count("*").over(order.rowsBetween(-width, width)) == 2 * width + 1
    mean = (around(-width, -1) + around(1, width)) / (2 * width)
    judged = dealt.withColumns({"mean": mean, "whole": sides}).filter(F.col("chunk") == F.floor(F.col("frame") / chunk))
    times = F.when(F.abs("mean") < NO_MEAN, F.lit(MOST_RATIO)).otherwise(F.least(F.col("score") / F.col("mean"), F.lit(MOST_RATIO)))
    return judged.filter(F.col("whole") & (F.col("score") >= least) & (times >= ratio)).select("content_id", "frame")


def followed(found: list[int], begin: int, back: int, gap: int) -> tuple[list[int], int]:
    """The cuts among a chunk's candidates (in order), if the last cut is `back` frames before its first one; and the last cut."""
    last, out = begin - back, []
    for frame in found:
        if frame - last >= gap:
            out.append(frame)
            last = frame
    return out, last


def _table(found: Column, chunk: Column, gap: int, size: int) -> Column:
    """For each number of frames back up to `gap` (which stands for all beyond), the number that the chunk's end hands on."""

    @F.pandas_udf("array<int>")
    def run(lists: pd.Series, chunks: pd.Series) -> pd.Series:
        return pd.Series([[min(gap, (c + 1) * size - followed(sorted(x), c * size, back, gap)[1]) for back in range(gap + 1)] for x, c in zip(lists, chunks, strict=True)])

    return run(found, chunk)


def cuts(frames: DataFrame, ratio: float = RATIO, least: float = LEAST, width: int = WIDTH, gap: int = GAP, chunk: int = CHUNK_FRAMES) -> DataFrame:
    """content_id and frame of each cut."""
    from framewise.session import ship

    ship(frames.sparkSession)
    own = candidates(frames, ratio, least, width, chunk).groupBy("content_id", F.floor(F.col("frame") / chunk).alias("chunk")).agg(F.collect_list("frame").alias("found")).persist()  # a chunk's at most

    def follow(key: tuple, tables: pa.Table) -> pa.Table:
        tables = tables.sort_by("chunk")
        state, next_, out = 0, 0, []
        for c, table in zip(tables.column("chunk").to_pylist(), tables.column("table").to_pylist(), strict=True):
            state = min(gap, state + (c - next_) * chunk)  # chunks without candidates only move on
            out.append(state)
            state, next_ = table[state], c + 1
        return pa.table({"content_id": [key[0].as_py()] * len(out), "chunk": tables.column("chunk"), "back": pa.array(out, pa.int32())})

    kind = frames.schema["content_id"].dataType.simpleString()
    tables = own.select("content_id", "chunk", _table(F.col("found"), F.col("chunk"), gap, chunk).alias("table"))
    states = tables.groupBy("content_id").applyInArrow(follow, f"content_id {kind}, chunk long, back int")

    @F.pandas_udf("array<long>")
    def resolved(lists: pd.Series, chunks: pd.Series, backs: pd.Series) -> pd.Series:
        return pd.Series([followed(sorted(x), c * chunk, back, gap)[0] for x, c, back in zip(lists, chunks, backs, strict=True)])

    found = own.join(states, ["content_id", "chunk"])
    return found.select("content_id", F.explode(resolved("found", "chunk", "back")).alias("frame"))


def scenes(frames: DataFrame, **settings: float) -> DataFrame:
    """content_id, scene_id, start_frame and end_frame (not included): the spans between cuts; one for a content without cuts."""
    ends = frames.groupBy("content_id").agg(F.max("frame").alias("last"))
    starts = cuts(frames, **settings).unionByName(ends.select("content_id", F.lit(0).cast("long").alias("frame")))
    order = Window.partitionBy("content_id").orderBy("frame")
    placed = starts.select("content_id", (F.row_number().over(order) - 1).alias("scene_id"), F.col("frame").alias("start_frame"), F.lead("frame").over(order).alias("_next"))
    return placed.join(ends, "content_id").select("content_id", "scene_id", "start_frame", F.coalesce("_next", F.col("last") + 1).cast("long").alias("end_frame"))
