"""Representatives of many contents at once: clusters of each content's shots by grouped rounds of Lloyd's algorithm.

A content's shots are dealt into groups of some thousand, each packed as one matrix that stays where it is. Every round sends
each group its content's centres, for all starts together, and gets back sums and counts for each centre, which are added up
by content: one job for all contents, however many, and no task ever holds a whole content. Starts are drawn as k-means++ does,
with numbers from a hash, on a bounded sample of each content (SAMPLE shots, fixed by a hash); all later rounds use all shots.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewise.session import ship

from .nearest import matrix

#: Shots of a group, and shots of a content that starts are drawn from. Rounds at most; decimals that distances are told apart by.
GROUP_SHOTS, SAMPLE, ROUNDS, DIGITS = 4_096, 2_048, 30, 9


def uniform(*key: object) -> float:
    """A number from 0 up to 1 that follows from the key."""
    return int.from_bytes(hashlib.blake2b(repr(key).encode(), digest_size=8).digest(), "big") / 2**64


def drawn(x: np.ndarray, k: int, content: str, start: int, seed: int) -> np.ndarray:
    """k rows of x as first centres: each next one with a chance as the squared distance to the nearest one before."""
    rows = [int(uniform(seed, content, start, 0) * len(x))]
    near = ((x - x[rows[0]]) ** 2).sum(1)
    for i in range(1, k):
        total = np.cumsum(np.round(near, DIGITS))
        place = np.searchsorted(total, uniform(seed, content, start, i) * total[-1], side="right") if total[-1] > 0 else i
        rows.append(min(int(place), len(x) - 1))
        near = np.minimum(near, ((x - x[rows[-1]]) ** 2).sum(1))
    return x[rows]


def assigned(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, the first of equals, and its squared distance."""
    d = np.round((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1), DIGITS)
    best = d.argmin(1)
    return best, np.maximum(d[np.arange(len(x)), best], 0.0)


def _groups(shots: DataFrame) -> DataFrame:
    """content_id, part, rows and x (matrices, packed): each content's shots in groups of about GROUP_SHOTS."""
    counts = shots.groupBy("content_id").agg(F.ceil(F.count("*") / GROUP_SHOTS).alias("_parts"))
    dealt = shots.join(counts, "content_id").withColumn("part", F.pmod(F.xxhash64("row"), F.col("_parts")))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("row").combine_chunks()
        x = matrix(table.column("v").combine_chunks() if isinstance(table.column("v"), pa.ChunkedArray) else table.column("v"))
        return pa.table({"content_id": [key[0].as_py()], "part": [key[1].as_py()], "rows": [table.column("row").to_numpy().astype(np.int64).tobytes()], "x": [x.tobytes()]}, schema=pa.schema([("content_id", pa.string()), ("part", pa.int64()), ("rows", pa.binary()), ("x", pa.binary())]))

    return dealt.groupBy("content_id", "part").applyInArrow(pack, "content_id string, part long, rows binary, x binary")


def _starts(shots: DataFrame, k: int, starts: int, seed: int) -> DataFrame:
    """content_id and c: the first centres of all starts, packed."""
    order = Window.partitionBy("content_id").orderBy(F.xxhash64("row"), "row")
    sample = shots.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= SAMPLE).drop("_place")

    def draw(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("row").combine_chunks()
        x, content = matrix(table.column("v").combine_chunks()), key[0].as_py()
        found = np.concatenate([drawn(x, k, content, s, seed) for s in range(starts)])
        return pa.table({"content_id": [content], "c": pa.array([found.tobytes()], pa.binary())})

    return sample.groupBy("content_id").applyInArrow(draw, "content_id string, c binary")


def _round(groups: DataFrame, centres: DataFrame, k: int, starts: int) -> DataFrame:
    """content_id, c (moved), cost (of each start, before the move) and moved (whether any centre did)."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                c = np.frombuffer(batch.column("c")[i].as_buffer()).reshape(starts * k, -1)
                x = np.frombuffer(batch.column("x")[i].as_buffer()).reshape(-1, c.shape[1])
                total, cost = np.zeros((starts * k, c.shape[1] + 1)), np.zeros(starts)
                for s in range(starts):
                    best, far = assigned(x, c[s * k : (s + 1) * k])
                    one = np.zeros((k, len(x)))
                    one[best, np.arange(len(x))] = 1.0
                    total[s * k : (s + 1) * k, :-1], total[s * k : (s + 1) * k, -1], cost[s] = one @ x, one.sum(1), far.sum()
                yield pa.RecordBatch.from_pydict({"content_id": batch.column("content_id")[i : i + 1], "part": batch.column("part")[i : i + 1], "c": batch.column("c")[i : i + 1], "sums": pa.array([np.append(total.ravel(), cost).tobytes()], pa.binary())})

    def move(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("part").combine_chunks()
        c = np.frombuffer(table.column("c")[0].as_buffer()).reshape(starts * k, -1)
        found = sum(np.frombuffer(s.as_buffer()) for s in table.column("sums"))
        cost, total = found[-starts:], found[:-starts].reshape(starts * k, -1)
        new = np.where(total[:, -1:] > 0, total[:, :-1] / np.maximum(total[:, -1:], 1), c)  # an empty cluster stays where it is
        return pa.table({"content_id": [key[0].as_py()], "c": pa.array([new.tobytes()], pa.binary()), "cost": pa.array([cost.tolist()], pa.list_(pa.float64())), "moved": pa.array([bool(np.abs(new - c).max(initial=0) > 1e-9)])})

    found = groups.select("content_id", "part", "x").join(centres.select("content_id", "c"), "content_id")
    parts = found.mapInArrow(sums, "content_id string, part long, c binary, sums binary")
    return parts.groupBy("content_id").applyInArrow(move, "content_id string, c binary, cost array<double>, moved boolean")


def representatives(shots: DataFrame, budget: int, starts: int = 10, seed: int = 42) -> DataFrame:
    """content_id and row of each content's representatives: all shots within the budget, else of each of `budget` clusters the shot
    nearest to its unit mean vector, the first of equals; the clusters are the tightest of several starts.

    shots: content_id, row and v. Same shots, same result, however they are dealt. Shots without a vector are left out.
    """
    ship(shots.sparkSession)
    shots = shots.filter("v IS NOT NULL").select("content_id", F.col("row").cast("long").alias("row"), "v")
    sizes = shots.groupBy("content_id").agg((F.count("*") <= budget).alias("_few"))
    split = shots.join(sizes, "content_id")
    few, many = split.filter("_few").select("content_id", "row"), split.filter("NOT _few").drop("_few")
    groups = _groups(many).persist()
    centres = _starts(many, budget, starts, seed).persist()
    for _ in range(ROUNDS):
        after = _round(groups, centres, budget, starts).persist()
        moved = after.agg(F.bool_or("moved")).first()[0]
        centres.unpersist()
        centres = after
        if not moved:
            break
    chosen = centres.select("content_id", "c", F.expr("array_position(cost, array_min(cost)) - 1").cast("int").alias("start"))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                start = batch.column("start")[i].as_py()
                c = np.frombuffer(batch.column("c")[i].as_buffer()).reshape(starts * budget, -1)[start * budget : (start + 1) * budget]
                x, rows = np.frombuffer(batch.column("x")[i].as_buffer()).reshape(-1, c.shape[1]), np.frombuffer(batch.column("rows")[i].as_buffer(), np.int64)
                label, _ = assigned(x, c)
                unit = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-8)
                near = np.round((x * unit[label]).sum(1), DIGITS)
                order = np.lexsort((rows, -near, label))
                first = order[np.unique(label[order], return_index=True)[1]]
                yield pa.RecordBatch.from_pydict({"content_id": pa.array([batch.column("content_id")[i].as_py()] * len(first), pa.string()), "label": pa.array(label[first], pa.int64()), "row": pa.array(rows[first]), "near": pa.array(near[first])})

    found = groups.join(chosen, "content_id").mapInArrow(nearest, "content_id string, label long, row long, near double")
    best = found.groupBy("content_id", "label").agg(F.max(F.struct("near", (-F.col("row")).alias("r"))).alias("b"))
    return few.unionByName(best.select("content_id", (-F.col("b.r")).alias("row")))
