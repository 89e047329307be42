"""Whitening of embeddings by a compensated covariance and a tridiagonal divide-and-conquer eigen-solve.

Entries become whole numbers, so sums and the mean of each dimension are exact. Each task centres its vectors as pairs of
doubles (value and remainder, by error-free sums), cuts them into slices of few bits, and multiplies slices as matrices:
each such product of up to ROWS vectors is exact in a double, whatever the order of its sums. The products are added up as
double-doubles (high and low parts, with the error of each sum carried on). A task hands on one pair of matrices; pairs are
merged in groups, then all together, high and low parts alike. The driver holds one pair, of the size of a vector squared. It is
brought to tridiagonal form and solved by divide and conquer (LAPACK's syevd, behind numpy's eigh), and the vectors are refined
against the high and low parts in extended precision, so they are unit eigenvectors to double precision.

Defined results: vectors that are null, empty, or hold null, NaN, infinite or huge entries (from 2**40 on) are dropped; so are those of
another length than most vectors have (of equally frequent lengths, the longest counts). Rows that share a vec_id are
each whitened. Equal vectors are told apart by nothing: their rows are the same. Components without variance (eigenvalues at most
1e-12 of the greatest) cannot be whitened and are left out, so equal vectors alone give no rows; of equal eigenvalues any basis is
right. deviation is null where it does not fit into a long. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, slices, table

#: Components that are returned, what an entry is multiplied by, and what is added to it.
COMPONENTS, SCALE, SHIFT = 32, 64.0, 1_000_000
#: Bits of a slice and slices of a number; rows whose products of slices are summed exactly: 2 * BITS + log2(ROWS) <= 53.
BITS, SLICES, ROWS = 20, 4, 4_096
#: Entries from here on do not keep their fraction; eigenvalues up to this share of the greatest count as none.
HUGE, NO_VARIANCE = 2.0**40, 1e-12
#: Steps of refinement at most; each squares the error, so that close eigenvalues take more than one.
REFINED = 4

Pair = tuple[np.ndarray, np.ndarray]


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    """The rounded sum and its exact error."""
    s = a + b
    v = s - a
    return s, (a - (s - v)) + (b - v)


def added(a: Pair, b: Pair) -> Pair:
    """The sum of two double-doubles."""
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    s, e = _renewed(s, e + t)
    return _renewed(s, e + f)


def _renewed(s: np.ndarray, e: np.ndarray) -> Pair:
    high = s + e
    return high, e - (high - s)


def as_pair(values: list[Fraction]) -> Pair:
    """Exact numbers as double-doubles."""
    high = [float(v) for v in values]
    return np.array(high), np.array([float(v - Fraction(h)) for v, h in zip(values, high, strict=True)])


def centred(x: np.ndarray, mean: Pair) -> Pair:
    """Rows less the mean, as double-doubles."""
    s, e = two_sum(x, np.broadcast_to(-mean[0], x.shape))
    return _renewed(s, e - mean[1])


def cut(c: Pair) -> list[np.ndarray]:
    """Slices of BITS bits that add up to c, the greatest first; a column's slices are multiples of one power of two each."""
    high, low = c
    most = np.abs(high).max(0)
    unit = np.ldexp(1.0, np.frexp(np.where(most > 0, most, 1.0))[1] - BITS)
    out = []
    for _ in range(SLICES):
        part = np.rint(high / unit) * unit
        out.append(part)
        high, low = _renewed(high - part, low)
        unit = unit / (1 << BITS)
    return out


def outer_sum(c: Pair) -> Pair:
    """The sum of the outer products of up to ROWS rows, as a double-double: each product of slices is exact."""
    parts = cut(c)
    total = (np.zeros((c[0].shape[1],) * 2), np.zeros((c[0].shape[1],) * 2))
    for i in range(SLICES):
        for j in range(SLICES):
            product = parts[i].T @ parts[j]
            total = added(total, (product, np.zeros_like(product)))
    return total


Vectors = Iterator[tuple[pa.Array, np.ndarray]]


def _vectors(rows: DataFrame, size: int, work: Callable[[Vectors], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What work makes of a task's ids and whole-number vectors, up to ROWS rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (whole(batch, size) for batch in slices(batches, ROWS))
        yield from work((ids, x) for ids, x in found if len(ids))

    return mapped(rows.select("vec_id", "embedding"), run, schema)


def whole(batch: pa.RecordBatch, size: int) -> tuple[pa.Array, np.ndarray]:
    """Ids and vectors (whole numbers, as doubles) of those rows that count."""
    ids, column = batch.column(0), batch.column(1)
    kept = pc.fill_null(pc.equal(pc.list_value_length(column), size), False)
    ids, column = ids.filter(kept), column.filter(kept)
    c = column.flatten().cast(pa.float64())
    values = pc.fill_null(c, float("nan")).to_numpy(zero_copy_only=False).reshape(-1, size)
    good = (np.abs(values) < HUGE).all(1)  # neither is NaN
    return ids.filter(pa.array(good)), np.floor(SCALE * values[good]) + SHIFT


def vector_size(rows: DataFrame) -> int:
    """The length that most vectors have."""
    sizes = rows.filter(F.size("embedding") > 0).groupBy(F.size("embedding").alias("size")).count()
    best = sizes.orderBy(F.desc("count"), F.desc("size")).first()
    return best["size"] if best else 0


def exact_sums(rows: DataFrame, size: int) -> tuple[int, list[int]]:
    """How many vectors count, and the sum of each dimension. A task sums up whole numbers and hands on their decimal digits."""

    def add(vectors: Vectors) -> Iterator[pa.RecordBatch]:
        numbers = [0] * (size + 1)
        for _, x in vectors:  # entries are below 2**47, so the sum of ROWS of them fits
            numbers = [a + b for a, b in zip(numbers, [len(x), *x.astype(np.int64).sum(0).tolist()], strict=True)]
        yield pa.RecordBatch.from_pydict({"k": pa.array(range(size + 1), pa.int32()), "v": pa.array([str(v) for v in numbers], pa.string())})

    parts = _vectors(rows, size, add, "k int, v string")
    total = {r.k: int(r.v) for r in parts.groupBy("k").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()}  # a row a dimension
    return total.get(0, 0), [total.get(k + 1, 0) for k in range(size)]


def _summed(parts: DataFrame, size: int) -> Pair:
    """Pairs of square matrices (part, high, low) merged in groups, then all together."""
    schema = "part long, high binary, low binary"

    def read(rows: pa.RecordBatch, i: int) -> Pair:
        return tuple(np.frombuffer(rows.column(k)[i].as_buffer(), np.float64) for k in (1, 2))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for i in range(batch.num_rows):
                own = read(batch, i)
                total = own if total is None else added(total, own)
        if total is not None:
            yield _pair_row(0, total)  # one part for the second merge

    groups = max(1, int(parts.sparkSession.sparkContext.defaultParallelism))
    partial = parts.groupBy(F.pmod(F.xxhash64("part"), F.lit(groups)).alias("g")).applyInArrow(merge, schema)
    found = partial.groupBy("part").applyInArrow(merge, schema).first()
    return tuple(np.frombuffer(bytes(x)).reshape(size, size) for x in (found.high, found.low))


def _pair_row(part: int, pair: Pair) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([pair[0].tobytes()], pa.binary()), pa.array([pair[1].tobytes()], pa.binary())], names=["part", "high", "low"])


def _outer_products(rows: DataFrame, size: int, width: int, prepare: Callable[[np.ndarray], Pair]) -> Pair:
    """The sum over all vectors of the outer products of what prepare makes of them (double-doubles of `width`)."""

    def add(vectors: Vectors) -> Iterator[pa.RecordBatch]:
        total = (np.zeros((width, width)), np.zeros((width, width)))
        for _, x in vectors:
            total = added(total, outer_sum(prepare(x)))
        yield _pair_row(TaskContext.get().partitionId(), total)

    return _summed(_vectors(rows, size, add, "part long, high binary, low binary"), width)


def divided(pair: Pair, n: int) -> Pair:
    """A double-double over a whole number."""
    q = pair[0] / n
    # the remainder of the division, exactly: q * n by an error-free product
    p, e = two_product(q, np.full_like(q, float(n)))
    s, f = two_sum(pair[0], -p)
    return _renewed(q, (s + (f - e + pair[1])) / n)


def two_product(a: np.ndarray, b: np.ndarray) -> Pair:
    """The rounded product and its exact error, by halves of 26 bits."""

    def halves(x: np.ndarray) -> Pair:
        t = x * 134217729.0
        high = t - (t - x)
        return high, x - high

    p = a * b
    (ah, al), (bh, bl) = halves(a), halves(b)
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def eigen(covariance: Pair) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric double-double matrix.

    eigh reduces to tridiagonal form and solves by divide and conquer; a few steps of refinement follow, whose residuals are
    taken in extended precision from both parts of the matrix.
    """
    if not covariance[0].size:
        return np.zeros(0), np.zeros((0, 0))
    values, vectors = np.linalg.eigh((covariance[0] + covariance[0].T) / 2)
    wide = np.longdouble
    a = covariance[0].astype(wide) + covariance[1].astype(wide)
    a, x = (a + a.T) / 2, vectors.astype(wide)
    for _ in range(REFINED):
        r = np.eye(len(values), dtype=wide) - x.T @ x
        s = x.T @ (a @ x)
        found = np.diag(s) / (1 - np.diag(r))
        gap = found[None, :] - found[:, None]
        least = 2 * (np.abs(s - np.diag(np.diag(s))).max() + np.abs(found).max() * np.abs(r).max())
        near = np.abs(gap) <= least
        step = np.where(near, r / 2, (s + found[None, :] * r) / np.where(near, 1, gap))
        x = x + x @ step
        if np.abs(step).max() < 1e-18:
            break
    x = x / np.sqrt((x * x).sum(0))
    order = np.argsort(-found, kind="stable")
    return found[order].astype(np.float64), x[:, order].astype(np.float64)


class Whitening:
    """What is fitted: the number of vectors, exact sums, the mean as a double-double, and the components."""

    def __init__(self, n: int, sums: list[int], covariance: Pair, components: int = COMPONENTS):
        self.n, self.sums = n, sums
        self.mean = as_pair([Fraction(s, max(n, 1)) for s in sums])
        values, vectors = eigen(covariance)
        kept = int((values > NO_VARIANCE * values.max(initial=0.0)).sum()) if values.max(initial=0.0) > 0 else 0
        kept = min(kept, components)
        self.trace = float(np.trace(covariance[0]) + np.trace(covariance[1])) if len(sums) else 0.0
        self.values, self.vectors = values[:kept], vectors[:, :kept]

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows."""
        high, low = centred(x, self.mean)
        return (high @ self.vectors + low @ self.vectors) / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """sum of (n * x - S)**2 over the dimensions, exactly; None beyond a long."""
        whole_ = x.astype(np.int64)
        near = np.array([s // max(self.n, 1) for s in self.sums], np.int64)
        rest = [s - int(m) * self.n for s, m in zip(self.sums, near, strict=True)]
        gap = whole_ - near  # n * x - S = n * gap - rest
        if self.n * (int(np.abs(gap).max(initial=0)) + 1) < (1 << 31) // max(1, int(np.sqrt(len(rest))) + 1):
            d = self.n * gap - np.array(rest, np.int64)
            return (d * d).sum(1).tolist()
        found = [sum((self.n * g - r) ** 2 for g, r in zip(row, rest, strict=True)) for row in gap.tolist()]
        return [v if v < 1 << 63 else None for v in found]


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening:
    """The whitening of all vectors (vec_id, embedding)."""
    size = vector_size(rows)
    n, sums = exact_sums(rows, size) if size else (0, [])
    if not n:
        return Whitening(0, [], (np.zeros((0, 0)), np.zeros((0, 0))), components)
    mean = as_pair([Fraction(s, n) for s in sums])
    return Whitening(n, sums, divided(_outer_products(rows, size, size, lambda x: centred(x, mean)), n), components)


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance, less the identity."""
    size, width = len(model.sums), len(model.values)
    if not width:
        return 0.0
    zero = np.zeros(width)

    def add(vectors: Vectors) -> Iterator[pa.RecordBatch]:
        total = (zero, zero)
        for _, x in vectors:
            total = added(total, (model.project(x).sum(0), zero))
        yield pa.RecordBatch.from_pydict({"k": pa.array(range(width), pa.int32()), "v": pa.array(total[0], pa.float64())})

    parts = _vectors(rows, size, add, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()  # a row a component
    mean = np.array([v for _, v in sorted((r.k, r.v) for r in parts)]) / model.n
    found = divided(_outer_products(rows, size, width, lambda x: centred(model.project(x), (mean, zero))), model.n)
    return float(np.abs((found[0] - np.eye(width)) + found[1]).max())


def whitened(rows: DataFrame, model: Whitening, error: float) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of each vector and component."""
    sent, width = rows.sparkSession.sparkContext.broadcast(model), len(model.values)
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"

    if not width:
        return rows.sparkSession.createDataFrame([], schema)

    def work(vectors: Vectors) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for ids, x in vectors:
            k = len(ids)
            at = pa.array(np.repeat(np.arange(k), width))
            columns = [
                ids.take(at), np.tile(np.arange(1, width + 1, dtype=np.int32), k), np.full(k * width, own.n, np.int64), pa.array(own.deviations(x), pa.int64()).take(at),
                own.project(x).ravel(), np.tile(own.values / own.trace, k), np.full(k * width, error),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=names)

    return _vectors(rows, len(model.sums), work, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = fit(rows)
    return whitened(rows, model, identity_error(rows, model))
