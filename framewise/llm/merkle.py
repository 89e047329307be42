"""Merkle manifest of a dataset: a digest for each row, trees of eight over them, and each row's authentication path.

Rows are ordered by language and id with one range shuffle, and numbered within their language. A language's tree is cut
into aligned blocks of ARITY**BLOCK_LEVELS leaves. A task first reduces each block to its root; roots are numbered nodes again, and so on
until each language has one, and then the languages' roots go the same way. Paths are made from the top down: each block
gets the path of its own root, and walks over its nodes in order (a fractal traversal): for each of the stacked levels of
subtrees it keeps the one that holds the current leaf and the next one, which grows by one leaf a step and is whole when its
turn comes. So a walk keeps a few dozen digests beside the block's leaves, and no path is put together twice.

Defined results: rows of one language are ordered by doc_id (null first), rows that share one by their leaf; repeated rows are
leaves of their own; null and empty values differ; an empty table gives no rows; columns beside the manifest's five are
ignored; texts are hashed by the JVM as they are, however long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import discard, materialize, reading, table

#: Children of a node, levels of a block and of each of a walk's subtrees (parameters of the layout, not of the result).
ARITY, BLOCK_LEVELS, SUBTREE_LEVELS = 8, 4, 1
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_HEX = 64


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def height(n: int) -> int:
    """Levels above n leaves until one node is left."""
    out = 0
    while n > 1:
        n, out = -(-n // ARITY), out + 1
    return out


class Subtree:
    """The nodes of the levels from `bottom` up to `top` (not included) under one node, made from leaves one by one."""

    def __init__(self, bottom: int, top: int):
        self.bottom, self.top = bottom, top
        self.nodes: list[list[str]] = [[] for _ in range(top - bottom)]
        self.open: list[list[str]] = [[] for _ in range(top)]

    def add(self, node: str, level: int = 0) -> None:
        if level >= self.bottom:
            self.nodes[level - self.bottom].append(node)
        if level + 1 < self.top:
            run = self.open[level]
            run.append(node)
            if len(run) == ARITY:
                self.open[level] = []
                self.add(digest("".join(run)), level + 1)

    def end(self) -> None:
        """No more leaves: what is left of each level's last run becomes its node."""
        for level in range(self.top - 1):
            if run := self.open[level]:
                self.open[level] = []
                self.add(digest("".join(run)), level + 1)


class Walk:
    """The authentication paths of a block's leaves, one after another.

    path: for each level of the block (at, others), the node's place in its run and the run's other nodes, put together.
    """

    def __init__(self, leaves: list[str], levels: int, step: int = SUBTREE_LEVELS):
        self.leaves, self.levels, self.step = leaves, levels, step
        bounds = [(b, min(b + step, levels)) for b in range(0, levels, step)]
        self.spans = [ARITY**top for _, top in bounds]
        self.now = [self._whole(b, top) for b, top in bounds]
        self.next = [Subtree(b, top) for b, top in bounds]
        self.path: list[tuple[int, str]] = [(0, "")] * levels

    def _whole(self, bottom: int, top: int) -> Subtree:
        out = Subtree(bottom, top)
        for leaf in self.leaves[: ARITY**top]:
            out.add(leaf)
        out.end()
        return out

    def root(self) -> str:
        """What the block's leaves come to."""
        return digest("".join(self.now[-1].nodes[-1])) if self.levels else self.leaves[0]

    def __iter__(self) -> Iterator[list[tuple[int, str]]]:
        n = len(self.leaves)
        for i in range(n):
            for s, span in enumerate(self.spans):
                if i and i % span == 0:
                    done = self.next[s]
                    self.now[s], self.next[s] = done, Subtree(done.bottom, done.top)
            for level in range(self.levels):
                if i % ARITY**level:
                    break  # this level's node, and all above, are the last leaf's too
                tree = self.now[level // self.step]
                place = i % ARITY**tree.top // ARITY**level
                first, at = place - place % ARITY, place % ARITY
                run = tree.nodes[level - tree.bottom][first : first + ARITY]
                self.path[level] = at, "".join(run[:at] + run[at + 1 :])
            yield self.path
            for s, span in enumerate(self.spans[:-1]):  # each next subtree takes one leaf
                ahead = i + span
                if ahead < n:
                    self.next[s].add(self.leaves[ahead])
                    if ahead % span == span - 1 or ahead == n - 1:
                        self.next[s].end()


def folded(node: str, path: list[tuple[int, str]]) -> str:
    """What a node and its path come to."""
    for at, others in path:
        node = digest(others[: _HEX * at] + node + others[_HEX * at :])
    return node


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """rows with idx, their place in their group, and n, the group's size; written in order of group and `order`."""
    mark = F.monotonically_increasing_id()
    tied = rows.withColumn("_tie", mark).repartitionByRange(group, *order, "_tie").sortWithinPartitions(group, *order, "_tie")
    placed = materialize(tied.drop("_tie").withColumn("_at", mark), "numbered")  # ids rise with the partition, and in it with the row
    part = F.shiftright("_at", 33).alias("_part")
    runs = placed.groupBy(group, part).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(group, "_part", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_rows").over(Window.partitionBy(group)).alias("n"))
    out = placed.withColumn("_part", part).join(runs, [group, "_part"]).withColumn("idx", F.col("_before") + F.col("_at") - F.col("_first"))
    done = materialize(out.drop("_part", "_at", "_before", "_first"), "leaves")
    discard(placed)
    return done


def _block(most: int) -> Column:
    """The block of a node, for blocks of so many levels."""
    return F.floor(F.col("idx") / ARITY**most).cast("long").alias("block")


def _in_order(rows: pa.Table, most: int) -> tuple[pa.Table, Walk]:
    rows = rows.sort_by("idx")
    return rows, Walk(rows.column("digest").to_pylist(), min(most, height(rows.column("n")[0].as_py())))


def block_roots(nodes: DataFrame, most: int) -> DataFrame:
    """g, idx, n and digest: each block of nodes (g, idx, n, digest) as one node."""

    def reduce(key: tuple, rows: pa.Table) -> pa.Table:
        g, block = key
        rows, walk = _in_order(rows, most)
        n = -(-rows.column("n")[0].as_py() // ARITY**most)
        return pa.table({"g": [g.as_py()], "idx": [block.as_py()], "n": pa.array([n], pa.int64()), "digest": [walk.root()]})

    return nodes.select("g", "idx", "n", "digest", _block(most)).groupBy("g", "block").applyInArrow(reduce, "g string, idx long, n long, digest string")


def climbed(nodes: DataFrame, most: int) -> list[DataFrame]:
    """The nodes, those of their blocks, and so on, up to one node for each g."""
    levels = [nodes]
    while True:
        levels.append(materialize(block_roots(levels[-1], most), "nodes"))
        if (levels[-1].agg(F.max("n")).first()[0] or 0) <= 1:
            return levels


_PATH = "at array<int>, others array<string>"


def walked(nodes: DataFrame, above: DataFrame, most: int, emit: Callable[[dict, list[tuple[int, str]], list[tuple[int, str]], dict], tuple], schema: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """What emit makes of each node: its row, its path in its block, the path above, and the row of `above` (g, idx, at, others
    and extra) that holds this."""

    def walk(rows: pa.Table, up: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return empty
        rows, steps = _in_order(rows, most)
        top = up.to_pylist()[0]
        upper = list(zip(top["at"], top["others"], strict=True))
        names = [c for c in rows.column_names if c != "block"]
        columns = [rows.column(c).to_pylist() for c in names]
        out = [emit(dict(zip(names, row, strict=True)), path, upper, top) for row, path in zip(zip(*columns, strict=True), steps, strict=True)]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=empty.schema.names)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(nodes.sparkSession.createDataFrame([], schema).schema)
    kinds, empty = arrow.types, arrow.empty_table()
    ship(nodes.sparkSession)
    left = nodes.select("*", _block(most)).groupBy("g", "block")
    return left.cogroup(above.select("g", F.col("idx").alias("block"), "at", "others", *extra).groupBy("g", "block")).applyInArrow(walk, schema)


def paths(levels: list[DataFrame], most: int) -> DataFrame:
    """g, idx and path (at, others) of the nodes of levels[0]; of each tree's own root it is empty."""
    found = levels[-1].select("g", "idx", F.array().cast("array<int>").alias("at"), F.array().cast("array<string>").alias("others"))
    if len(levels) == 1:
        return found

    def emit(row: dict, path: list, upper: list, _: dict) -> tuple:
        whole = path + upper
        return row["g"], row["idx"], [a for a, _ in whole], [o for _, o in whole]

    for nodes in reversed(levels[:-1]):
        found = walked(nodes, found, most, emit, f"g string, idx long, {_PATH}")
    return found


def leaf(columns: tuple[str, ...] = COLUMNS, **instead: Column) -> Column:
    """A row's digest: of each column "-" for null, else its length in bytes, a colon, and itself."""
    parts = [instead.get(c, F.col(c)).cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts)), 256)


def lowered(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def _group() -> Column:
    """A language as a group that sorts null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))


def manifest(rows: DataFrame, emit: Callable[[dict, list[tuple[int, str]], list[tuple[int, str]], dict], tuple], schema: str, most: int = BLOCK_LEVELS) -> DataFrame:
    """What emit makes of each row (g, doc_id, digest and whatever else, then idx and n): called with the row, its path in its
    block, the path above that up to the root of all, and a dict with the subroot and the root."""
    hashed = materialize(rows, "digests")
    leaves = numbered(hashed, "g", "doc_id", "digest")
    discard(hashed)
    levels = climbed(leaves, most)
    tops = numbered(levels[-1].select(F.lit("").alias("g"), F.col("g").alias("name"), "digest"), "g", "name")
    top_levels = climbed(tops, most)
    root = top_levels[-1].select(F.col("digest").alias("root"))  # one row
    top_paths = paths(top_levels, most).withColumnsRenamed({"at": "_at", "others": "_others"})
    languages = tops.select("g", "idx", "name", F.col("digest").alias("subroot")).join(top_paths, ["g", "idx"]).select(F.col("name").alias("g"), "subroot", "_at", "_others")
    languages = materialize(languages.join(F.broadcast(root), how="cross"), "languages")  # one row
    blocks = paths(levels[1:], most).join(languages, "g")
    above = materialize(blocks.select("g", "idx", F.concat("at", "_at").alias("at"), F.concat("others", "_others").alias("others"), "subroot", "root"), "above")
    discard(tops, languages, *levels[1:], *top_levels[1:])
    return reading(walked(leaves, above, most, emit, schema, ("subroot", "root")), leaves, above)


def authenticated(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root and path (at and others of each level) of every row."""

    def emit(row: dict, path: list, upper: list, top: dict) -> tuple:
        whole = path + upper
        return row["doc_id"], row["digest"], top["subroot"], top["root"], [a for a, _ in whole], [o for _, o in whole]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return manifest(docs.select(_group().alias("g"), "doc_id", leaf().alias("digest")), emit, f"doc_id {kind}, leaf string, subroot string, root string, {_PATH}")


def verified(docs: DataFrame, tampered: Column, most: int = BLOCK_LEVELS) -> DataFrame:
    """Each row's leaf, subroot, root, the digest of its path, and what its path makes of the leaf with `tampered` as its text:
    folded_root, and whether that is the root."""

    def emit(row: dict, path: list, upper: list, top: dict) -> tuple:
        proof = digest("".join([o for _, o in path] + [o for _, o in upper]))
        found = folded(folded(row["other"] or row["digest"], path), upper)
        return row["doc_id"], row["digest"], top["subroot"], top["root"], proof, found, found == top["root"]

    kind = docs.schema["doc_id"].dataType.simpleString()
    other = leaf(text=tampered)
    rows = docs.select(_group().alias("g"), "doc_id", leaf().alias("digest"), F.when(~tampered.eqNullSafe(F.col("text")), other).alias("other"))
    return manifest(rows, emit, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean", most)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    return verified(table(spark, sf_dir, "documents"), F.when(third, lowered(F.col("text"))).otherwise(F.col("text")))


_ENC = "coalesce(CAST(strlen({0}) AS VARCHAR) || ':' || {0}, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_ENC.format(c) for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)) + ")"


#: DuckDB has no crc32; its 256 table entries follow from the polynomial.
SQL = f"""
WITH RECURSIVE
crc_bits AS (
  SELECT CAST(range AS BIGINT) AS k, CAST(range AS BIGINT) AS c, 0 AS s FROM range(256)
  UNION ALL SELECT k, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, s + 1 FROM crc_bits WHERE s < 8
), crc_table AS (SELECT list(c ORDER BY k) AS t FROM crc_bits WHERE s = 8),
base AS (
  SELECT doc_id, lang, {_leaf_sql("text")} AS leaf,
    CASE WHEN xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda p: CAST(ascii(substr(CAST(doc_id AS VARCHAR), p, 1)) AS BIGINT))),
        lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS BIGINT) + 1])), 4294967295) % 3 = 0
      THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS other
  FROM documents, crc_table
), leaves AS (
  SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST, doc_id NULLS FIRST, leaf) AS r, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM base
), nodes AS (
  SELECT lang, 0 AS lev, i, leaf AS h, n FROM leaves
  UNION ALL
  SELECT lang, lev + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM nodes WHERE n > 1 GROUP BY lang, lev, i // 8, n
), subs AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS lev, i, subroot AS h, n FROM subs
  UNION ALL
  SELECT lev + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM tops WHERE n > 1 GROUP BY lev, i // 8, n
), steps AS (
  SELECT a.lang, a.lev, a.i, a.i % 8 AS spot, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i <> a.i), '') AS others
  FROM nodes a JOIN nodes b ON a.lang IS NOT DISTINCT FROM b.lang AND a.lev = b.lev AND a.i // 8 = b.i // 8 WHERE a.n > 1 GROUP BY ALL
), top_steps AS (
  SELECT s.lang, 1000 + a.lev AS lev, a.i % 8 AS spot, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i <> a.i), '') AS others
  FROM subs s JOIN tops a ON s.i // (8 ** a.lev)::BIGINT = a.i JOIN tops b ON a.lev = b.lev AND a.i // 8 = b.i // 8 WHERE a.n > 1 GROUP BY s.lang, a.lev, a.i
), path AS (
  SELECT r, row_number() OVER (PARTITION BY r ORDER BY lev) AS k, spot, others FROM (
    SELECT l.r, s.lev, s.spot, s.others FROM leaves l JOIN steps s ON l.lang IS NOT DISTINCT FROM s.lang AND l.i // (8 ** s.lev)::BIGINT = s.i
    UNION ALL SELECT l.r, t.lev, t.spot, t.others FROM leaves l JOIN top_steps t ON l.lang IS NOT DISTINCT FROM t.lang)
), proofs AS (SELECT r, sha256(string_agg(others, '' ORDER BY k)) AS proof_sha256, count(*) AS steps FROM path GROUP BY r),
fold AS (
  SELECT r, 0 AS k, coalesce(other, leaf) AS h FROM leaves
  UNION ALL
  SELECT f.r, p.k, sha256(substr(p.others, 1, 64 * p.spot) || f.h || substr(p.others, 64 * p.spot + 1)) FROM fold f JOIN path p ON f.r = p.r AND p.k = f.k + 1
)
SELECT l.doc_id, l.leaf, s.subroot, t.h AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified
FROM leaves l JOIN subs s ON l.lang IS NOT DISTINCT FROM s.lang JOIN (SELECT h FROM tops WHERE n = 1) t ON true
LEFT JOIN proofs p ON l.r = p.r JOIN fold f ON l.r = f.r AND f.k = coalesce(p.steps, 0)
"""
