"""N-gram Jaccard join of documents with themselves, by a token-group matrix.

1. Every text becomes its set of hashed five-word shingles; texts with the same set are one class.
2. Classes are partitioned into groups of similar ones. A class that links to the least class that shares its
   min-hashes is in that one's component, and a component is a pure group: no link within it is looked for.
   Other classes are grouped by the min-hashes alone. Large groups are dealt into blocks of bounded size.
3. The matrix holds, for each block, the union of its members' prefix tokens, the part of the group's token union that
   can decide. In a fixed order of tokens (rare
   before frequent, then by hash) the prefix of a set is so long that two sets that link share at least
   SHARED of their prefix tokens.
4. The matrix bounds what the members of two blocks can share; only pairs of blocks that reach SHARED are opened,
   and all their sets compared at once, exactly. An opened pair yields at most one link for each set it joins.
5. Links, and the components they make, give the result.

A group of near copies is thus a few rows of the matrix, and no pairs within it are made. The order of tokens
comes from a count sketch of all texts; it steers the work alone, never the result.

Defined results: a null, empty or blank text has an empty set and is alone; a text of fewer than five words is
one shingle; equal texts link; a doc_id is one node, so rows that repeat it join what each of them links to; a
null doc_id has its n_shingles but a null component; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_column, discard, fresh, mapped, materialize, reading, release, slices, table
from .components import components

#: Words in a shingle; two sets link when 100 * intersection >= PERCENT * union.
WORDS, PERCENT = 5, 75
#: Prefix tokens that two linking sets share at least.
SHARED = 3
#: Min-hashes of a class, and how many of them two classes of a group have in common.
KEYS, AGREE = 6, 2
#: Cells of the count sketch (a byte each is broadcast), its chunks, and the least excess of a frequent token.
CELL_BITS, CHUNKS, FREQUENT = 23, 64, 3
#: Sets, tokens and bytes of text of a block, on average; a larger set is a block of its own.
BLOCK_SETS, BLOCK_TOKENS, BLOCK_BYTES = 256, 100_000, 4 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SALTS = [np.uint64(int.from_bytes(xxhash.xxh3_128_digest(bytes([k]))[:8], "little") | 1) for k in range(KEYS)]


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    found = text.lower().split() if text else []  # bytes: only A-Z are lowered, only ASCII blanks split
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    width = min(words, len(h))
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = (out ^ h[k : k + n]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def needed(n: int, percent: int = PERCENT) -> int:
    """Tokens that a set of n shares with any set that it links to."""
    return -(-percent * n // 100)


def links(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sets link."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * both >= percent * (len(a) + len(b) - both)


def frequency_levels(docs: DataFrame, bits: int = CELL_BITS, least: int = FREQUENT) -> bytes:
    """A level for each cell of hashes: 0 up to the usual count, then a step for each quarter of a doubling."""
    cells, per = 1 << bits, (1 << bits) // CHUNKS
    shift = np.uint64(64 - bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, pending, n = np.zeros(cells, np.uint32), [], 0

        def add_pending() -> None:
            found, times = np.unique(np.concatenate(pending), return_counts=True)
            counts[found] += times.astype(np.uint32)

        for batch in slices(batches, 1_000):
            for text in binary_column(batch, "text"):
                pending.append((shingles(text) >> shift).astype(np.uint32))
                n += len(pending[-1])
                if n > 1 << 20:
                    add_pending()
                    pending, n = [], 0
        if n:
            add_pending()
        if counts.any():
            packed = [zlib.compress(counts[k * per : (k + 1) * per].tobytes(), 1) for k in range(CHUNKS)]
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(range(CHUNKS), pa.int32()), "part": pa.array([0] * CHUNKS, pa.int32()), "counts": pa.array(packed, pa.binary())})

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(per, np.uint64)
        for batch in batches:
            for data in batch.column(batch.schema.get_field_index("counts")).to_pylist():
                total += np.frombuffer(zlib.decompress(data), np.uint32)
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([key[0].as_py()], pa.int32()), "total": pa.array([int(total.sum())], pa.int64()), "counts": pa.array([zlib.compress(np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes(), 1)], pa.binary())})

    schema = "chunk int, part int, counts binary"
    summed = mapped(docs.select("text"), count, schema).groupBy("chunk").applyInArrow(add, "chunk int, total long, counts binary").collect()
    usual = sum(r.total for r in summed) / cells
    out = np.zeros(cells, np.uint8)
    for r in summed:
        excess = (np.frombuffer(zlib.decompress(r.counts), np.uint32) - usual) / least
        out[r.chunk * per : (r.chunk + 1) * per] = np.floor(4 * np.log2(np.maximum(excess, 1)) + (excess > 1)).clip(0, 255)
    return zlib.compress(out.tobytes(), 1)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n, n_bytes, sig (a digest of the set), keys (min-hashes) and prefix (tokens) of every document."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(frequency_levels(docs))
    shift = np.uint64(64 - CELL_BITS)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = np.frombuffer(zlib.decompress(sent.value), np.uint8)
        for batch in slices(batches, 1_000):
            sizes, lengths, sigs, keys, prefixes = [], [], [], [], []
            for text in binary_column(batch, "text"):
                lengths.append(len(text or b""))
                s = shingles(text)
                n = len(s)
                level = levels[s >> shift]
                ordered = s[np.argsort(level, kind="stable")]
                sizes.append(n)
                sigs.append(xxhash.xxh3_128_digest(s.tobytes()) if n else None)
                keys.append([int((s * m).min().view(np.int64)) for m in _SALTS] if n else [])
                prefixes.append(ordered[: min(n, n - needed(n) + SHARED)].view(np.int64))
            offsets = np.concatenate(([0], np.cumsum([len(p) for p in prefixes]))).astype(np.int32)
            flat = pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array(offsets), flat)],
                names=["doc_id", "n", "n_bytes", "sig", "keys", "prefix"],
            )

    out = mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), sign, "doc_id long, n long, n_bytes long, sig binary, keys array<long>, prefix array<long>")
    return materialize(out, "signatures")


def verify(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """Those pairs (a, b) of doc_ids whose texts' sets link; the texts of b are dealt in lots, each with a's text once."""
    sized = pairs.join(sets.groupBy(F.col("doc_id").alias("b")).agg(F.max("n_bytes").alias("n_bytes")), "b")
    lots = sized.groupBy("a").agg(_shares("n_bytes", BLOCK_BYTES).alias("lots"))
    dealt = materialize(sized.join(lots, "a").select("a", "b", F.pmod(F.xxhash64("b"), "lots").alias("lot")), "pairs")
    texts = docs.select(F.col("doc_id").cast("long").alias("b"), F.col("text").cast("binary").alias("text"))
    held = texts.join(dealt, "b").groupBy("a", "lot").agg(F.collect_list(F.struct("b", "text")).alias("members"))
    met = held.join(texts.select(F.col("b").alias("a"), F.col("text").alias("head")), "a").select("a", "head", "members")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            a, head = batch.column(0)[0].as_py(), shingles(batch.column(1)[0].as_py())
            ok = [m["b"] for m in batch.column(2)[0].as_py() if links(head, shingles(m["text"]))]
            yield pa.RecordBatch.from_arrays([pa.array([a] * len(ok), pa.int64()), pa.array(ok, pa.int64())], names=["a", "b"])

    out = materialize(mapped(met, compare, "a long, b long").distinct(), "verified")
    discard(dealt)
    return out


def _shares(of: str, most: int) -> Column:
    """Into how many parts a group is dealt, by its rows and the sum of a column."""
    return F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum(of) / most))


def similar(sets: DataFrame) -> DataFrame:
    """doc_id and head: for each class, the least class that shares most (AGREE at least) of its min-hashes."""
    keyed = sets.select("doc_id", F.posexplode("keys").alias("k", "key"))
    heads = keyed.groupBy("k", "key").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("last")).filter("head < last")
    arcs = keyed.join(heads.select("k", "key", "head"), ["k", "key"]).filter("doc_id > head")
    agreed = arcs.groupBy("doc_id", "head").agg(F.count("*").alias("agree")).filter(F.col("agree") >= AGREE)
    return materialize(agreed.groupBy("doc_id").agg(F.max(F.struct("agree", (-F.col("head")).alias("h"))).alias("x")).select("doc_id", (-F.col("x.h")).alias("head")), "similar")


def blocks(sets: DataFrame, pure: DataFrame, heads: DataFrame) -> DataFrame:
    """doc_id, its block (named by its least doc_id), whether that is pure, and the block's kin: of a pure one its
    component's id, else its own. Blocks of one kin need no comparison.

    A group of sets is a component (pure) or shares a head; large ones are dealt out. Each doc_id is in one block, so
    names of blocks and of components never meet by chance.
    """
    sizes = sets.groupBy("doc_id").agg(F.sum("n").alias("n"), F.sum("n_bytes").alias("n_bytes"))
    named = sizes.join(pure.withColumnRenamed("id", "doc_id"), "doc_id", "left").join(heads, "doc_id", "left")
    grouped = materialize(named.select("doc_id", "n", "n_bytes", F.col("component").isNotNull().alias("pure"), F.coalesce("component", "head", "doc_id").alias("g")), "grouped")
    shares = F.greatest(_shares("n", BLOCK_TOKENS), _shares("n_bytes", BLOCK_BYTES))
    large = grouped.groupBy("pure", "g").agg(shares.alias("shares")).filter("shares > 1")
    dealt = grouped.join(large, ["pure", "g"], "left").select("doc_id", "pure", "g", F.pmod(F.xxhash64("doc_id"), F.coalesce("shares", F.lit(1))).alias("salt"))
    dealt = materialize(dealt, "salted")
    ids = dealt.groupBy("pure", "g", "salt").agg(F.min("doc_id").alias("block"))
    out = dealt.join(ids, ["pure", "g", "salt"]).select("doc_id", "block", F.when(F.col("pure"), F.col("g")).otherwise(F.col("block")).alias("kin"), "pure")
    out = materialize(out, "dealt")
    discard(grouped, dealt)
    return out


def block_pairs(dealt: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs of blocks (a and b) whose unions share enough; a block with itself unless it is pure."""
    held = materialize(sets.select("doc_id", "n", "prefix").join(dealt.select("doc_id", "block", "kin"), "doc_id").select("n", "block", "kin", "prefix"), "placed-sets")
    tokens = held.select("n", "block", "kin", F.explode("prefix").alias("token"))
    # a token of one block alone, or of one component, tells nothing; two ends of its kins show it, with no list of blocks
    bridging = materialize(tokens.groupBy("token").agg(F.min("kin").alias("first"), F.max("kin").alias("last")).filter("first < last").select("token"), "bridging")
    matrix = materialize(tokens.join(bridging, "token", "left_semi").groupBy("token", "block", "kin").agg(F.min("n").alias("lo"), F.max("n").alias("hi")), "matrix")
    discard(held, bridging)
    side = lambda c: matrix.select("token", F.col("block").alias(c), F.col("kin").alias(f"kin_{c}"), F.col("lo").alias(f"lo_{c}"), F.col("hi").alias(f"hi_{c}"))
    meet = side("a").join(side("b"), "token").filter((F.col("a") < F.col("b")) & (F.col("kin_a") != F.col("kin_b")) & (100 * F.col("hi_a") >= PERCENT * F.col("lo_b")) & (100 * F.col("hi_b") >= PERCENT * F.col("lo_a")))
    bound = meet.groupBy("a", "b").agg(F.count("*").alias("shared"), F.min(F.least("lo_a", "lo_b")).alias("least"))
    across = bound.filter(F.col("shared") >= F.least(F.lit(SHARED), F.ceil(F.col("least") * PERCENT / 100))).select("a", "b")
    within = dealt.filter("NOT pure").groupBy("block").count().filter("count > 1").select(F.col("block").alias("a"), F.col("block").alias("b"))
    out = materialize(across.unionByName(within), "block-pairs")
    discard(matrix)
    return out


def compare_blocks(a: list[np.ndarray], b: list[np.ndarray], same: bool) -> list[tuple[int, int]]:
    """Links between the sets of two blocks: those that join what was apart, found from all pairs at once."""
    ta, tb = np.concatenate(a), np.concatenate(b)
    oa, ob = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    common = np.intersect1d(ta, tb)
    both = np.zeros((len(a), len(b)), np.float32)
    width = max(1, 4_000_000 // max(len(a), len(b)))
    for at in range(0, len(common), width):
        part = common[at : at + width]
        sides = []
        for tokens, owner, n in ((ta, oa, len(a)), (tb, ob, len(b))):
            k = np.searchsorted(part, tokens)
            hit = part[np.minimum(k, len(part) - 1)] == tokens
            m = np.zeros((n, len(part)), np.float32)
            m[owner[hit], k[hit]] = 1
            sides.append(m)
        both += sides[0] @ sides[1].T
    na, nb = np.array([len(x) for x in a])[:, None], np.array([len(x) for x in b])[None, :]
    linked = 100 * both >= PERCENT * (na + nb - both)
    parent = list(range(len(a) + len(b)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(linked)), strict=True):
        x, y = root(i), root(j if same else len(a) + j)
        if x != y:
            parent[y] = x
            out.append((i, j))
    return out


def open_blocks(pairs: DataFrame, dealt: DataFrame, docs: DataFrame) -> DataFrame:
    """Verified links between the members of the blocks of each pair."""
    wanted = pairs.select(F.col("a").alias("block")).union(pairs.select("b")).distinct()
    places = dealt.select("doc_id", "block").join(wanted, "block")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    held = materialize(texts.join(places, "doc_id").groupBy("block").agg(F.collect_list(F.struct("doc_id", "text")).alias("members")), "blocks")
    side = lambda c: held.select(F.col("block").alias(c), F.col("members").alias(f"members_{c}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "members_a", "members_b")

    def loaded(members: pa.Scalar) -> tuple[list[int], list[np.ndarray]]:
        found = members.as_py()
        return [m["doc_id"] for m in found], [shingles(m["text"]) for m in found]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, ([], [])
        for batch in slices(batches, 1):
            (a, b), (first, second) = (batch.column(i)[0].as_py() for i in (0, 1)), (batch.column(i)[0] for i in (2, 3))
            if b != last:  # rows come sorted by b
                last, kept = b, loaded(second)
            ids, sets = kept if a == b else loaded(first)
            out = [(ids[i], kept[0][j]) for i, j in compare_blocks(sets, kept[1], a == b)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    out = materialize(mapped(met, compare, "a long, b long").filter("a <> b").distinct(), "opened")
    discard(held)
    return out


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    signed = signatures(docs)
    named = signed.filter("n > 0 AND doc_id IS NOT NULL")
    classes = named.groupBy("sig").agg(F.min("doc_id").alias("head"))
    members = materialize(named.select("doc_id", "sig").distinct().join(classes, "sig"), "classes")
    copies = members.filter("doc_id <> head").select("doc_id", "sig")
    sets = materialize(named.join(copies, ["doc_id", "sig"], "left_anti").select("doc_id", "n", "n_bytes", "keys", "prefix"), "sets")
    heads = similar(sets)
    first = verify(heads.select(F.col("head").alias("a"), F.col("doc_id").alias("b")).distinct(), sets, docs)
    pure = components(first)
    dealt = blocks(sets, pure, heads)
    release(pure)
    pairs = block_pairs(dealt, sets)
    discard(sets, heads)
    second = open_blocks(pairs, dealt, docs)
    discard(dealt, pairs)
    # a doc_id with several texts ties their classes together
    repeated = members.groupBy("doc_id").agg(F.count("*").alias("texts")).filter("texts > 1").select("doc_id")
    ties = members.join(repeated, "doc_id").select(F.col("doc_id").alias("a"), F.col("head").alias("b"))
    whole = components(first.unionByName(second).unionByName(ties))
    ends = members.select("doc_id", "sig", "head").join(whole.withColumnRenamed("id", "head"), "head", "left")
    named_out = ends.select("doc_id", "sig", F.coalesce("component", "head").alias("component_id"))
    out = signed.select("doc_id", F.col("n").alias("n_shingles"), "sig").join(named_out, ["doc_id", "sig"], "left")
    discard(first, second)
    return reading(out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")), signed, members, *whole._held)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents' own columns: one row of each component, in full.

    It is the row with the least doc_id; of several rows with that id, the one whose columns' hash is least. Rows
    without a doc_id stay, as does each text without words.
    """
    joined = join(docs.select("doc_id", "text"))
    found = joined.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.min("component_id") < F.col("doc_id")).alias("copy"), F.count("*").alias("rows"))
    found = materialize(found.filter("copy OR rows > 1"), "near-copies")
    release(joined)
    key, names = fresh(docs, "key"), docs.columns
    gone, several = (found.filter(x).select(F.col("doc_id").alias(key)) for x in ("copy", "NOT copy"))
    keyed = docs.withColumn(key, F.col("doc_id").cast("long")).join(gone, key, "left_anti")
    lone = keyed.join(several, key, "left_anti").select(names)
    repeats = keyed.join(several, key, "left_semi")
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    row, mark = fresh(docs, "row"), fresh(docs, "mark")
    one = repeats.filter(worded).select(key, F.struct(*names).alias(row), F.xxhash64(*names).alias(mark)).groupBy(key).agg(F.min_by(row, mark).alias(row))
    return reading(lone.unionByName(repeats.filter(~worded).select(names)).unionByName(one.select(f"{row}.*")), found)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


#: Compares all pairs that share a shingle, and follows the links.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + least(len(w), 5) - 1], ' ')) AS x
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 75 * (na.n + nb.n - shared)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a) USING (doc_id)
"""
