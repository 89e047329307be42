"""BPE encoding and decoding with a contiguous rank array, by the rules of a word-level tokenizer file.

The symbols of a pre-token and the ranks of its adjacent pairs lie in two short rows. The smallest rank is found
by a scan, its boundary deleted and the two neighbouring ranks looked up anew, until no pair has a rank; the
distinct pre-tokens of a batch go through these steps together, as the rows of two matrices. Runs longer than
SCAN_LIMIT bytes take the same merges from a heap, in the same order. What white space separates is encoded
once and kept in a bounded cache of each worker.

Defined results: a null or empty text has no tokens (and decodes to the empty text); special tokens written
out in a text become their ids, as the tokenizer library does; rows that share a doc_id are encoded each on
its own; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from .common import mapped, no_gc, slices, table

#: Bytes up to which the rank array is scanned; beyond, a heap gives the same order in n log n.
SCAN_LIMIT = 128
#: Encoded chunks that a worker keeps between batches.
CACHE_ENTRIES = 500_000
TOKENIZER_FILE = "word_bpe_49k.json"
_NONE, _ID = 1 << 60, (1 << 20) - 1
#: Characters that str.split() takes as white space and the tokenizer does not.
_ODD_SPACES = regex.compile("[\x1c-\x1f]")


def tokenizer_path(name: str = TOKENIZER_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable Latin-1, else from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class PairRanks:
    """rank << 20 | merged id of a pair, looked up for whole arrays: an open-addressed table."""

    def __init__(self, merges: dict[tuple[int, int], int]):
        bits = max(4, (8 * len(merges)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, _NONE, np.int64)
        self.probes = 1
        keys = np.array([a << 32 | b for a, b in merges], np.int64)
        for key, at, value in zip(keys.tolist(), self._home(keys).tolist(), merges.values(), strict=True):
            probes = 1
            while self.keys[at] >= 0:
                at, probes = (at + 1) & self.mask, probes + 1
            self.keys[at], self.values[at] = key, value
            self.probes = max(self.probes, probes)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = np.ascontiguousarray(a.astype(np.int64) << 32 | b)  # a padded b of -1 makes the key -1: no pair
        at = self._home(keys)
        out = np.where((self.keys[at] == keys) & (keys >= 0), self.values[at], _NONE)
        for _ in range(self.probes - 1):
            at = (at + 1) & self.mask
            out = np.where((self.keys[at] == keys) & (keys >= 0), self.values[at], out)
        return out


class RankArrayTokenizer:
    """Encodes and decodes as a word-level tokenizer file says: NFC, white space, lower case, split, bytes, BPE.

    A file without word ends and without a split of its own needs the pattern that splits its texts; then only
    encode_pieces() applies, for there is no normalisation.
    """

    def __init__(self, spec: dict, pattern: str | None = None):
        model = spec["model"]
        if model["type"] != "BPE" or not (pattern or model.get("end_of_word_suffix")):
            raise ValueError("a BPE model with word ends, or a pattern, is needed")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens |= {i: t for t, i in self.specials.items()}
        self.id_names = {i: str(i) for i in self.tokens}
        #: pair -> rank << 20 | merged id
        self.merges: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            self.merges[self.vocab[a], self.vocab[b]] = rank << 20 | self.vocab[a + b]
        pattern = pattern or next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.split = regex.compile(pattern)
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        symbols = byte_symbols()
        self.inner = [self.vocab[s] for s in symbols]
        self.last = [self.vocab[s + self.suffix] for s in symbols]
        self.ranks = PairRanks(self.merges)
        self.inner_array, self.last_array = np.array(self.inner, np.int64), np.array(self.last, np.int64)
        self.cache: dict[str, tuple[str, str, int]] = {}

    @classmethod
    def from_file(cls, path: str, pattern: str | None = None) -> RankArrayTokenizer:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f), pattern)

    def merge(self, ids: list[int]) -> list[int]:
        """Merge the symbols of one pre-token."""
        if len(ids) > SCAN_LIMIT:
            return self._merge_long(ids)
        get, none = self.merges.get, _NONE
        ranks = [get(pair, none) for pair in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            at = ranks.index(best)
            ids[at] = best & _ID
            del ids[at + 1], ranks[at]
            if at:
                ranks[at - 1] = get((ids[at - 1], ids[at]), none)
            if at < len(ranks):
                ranks[at] = get((ids[at], ids[at + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.merges.get
        heap = [(m >> 20, i, m & _ID, ids[i], ids[i + 1]) for i in range(n - 1) if (m := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (m := get((new, ids[after[i]]))) is not None:
                    heapq.heappush(heap, (m >> 20, i, m & _ID, new, ids[after[i]]))
            if (h := before[i]) >= 0 and (m := get((ids[h], new))) is not None:
                heapq.heappush(heap, (m >> 20, h, m & _ID, ids[h], new))
        return [x for x in ids if x >= 0]

    def encode_piece(self, piece: str) -> list[int]:
        data = piece.encode("utf-8")
        ids = [self.inner[b] for b in data]
        ids[-1] = self.last[data[-1]]
        return self.merge(ids)

    def merge_many(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of many pre-tokens of like length: one row of boundaries and one of ranks for each."""
        n, width = len(pieces), max(map(len, pieces))
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        ids = np.where(np.arange(width) < lengths[:, None], self.inner_array[raw], -1)
        row = np.arange(n)
        ids[row, lengths - 1] = self.last_array[raw[row, lengths - 1]]
        ranks = self.ranks(ids[:, :-1], ids[:, 1:])
        out: list = [None] * n
        while True:
            at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(row), np.int64)
            every = np.arange(len(row))
            best = ranks[every, at] if ranks.shape[1] else np.full(len(row), _NONE)
            live = best < _NONE
            if not live.all():
                for i, found in zip(row[~live].tolist(), ids[~live].tolist(), strict=True):
                    out[i] = [x for x in found if x >= 0]
                row, ids, ranks, at, best = row[live], ids[live], ranks[live], at[live], best[live]
                every = np.arange(len(row))
            if not len(row):
                return out
            # delete the boundary after `at`, then look up the ranks on both sides of the merged part
            ids[every, at] = best & _ID
            columns = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, columns + (columns > at[:, None]), 1)
            columns = columns[:-1]
            ranks = np.take_along_axis(ranks, columns + (columns >= at[:, None]), 1)
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.ranks(ids[left, at[left] - 1], ids[left, at[left]])
            right = np.flatnonzero(at < ranks.shape[1])
            ranks[right, at[right]] = self.ranks(ids[right, at[right]], ids[right, at[right] + 1])

    def encode_pieces(self, pieces: list[str]) -> dict[str, list[int]]:
        """The ids of distinct pre-tokens: short ones by the array, in groups of like length."""
        found, groups = {}, defaultdict(list)
        for piece in pieces:
            data = piece.encode("utf-8")
            if len(data) > SCAN_LIMIT:
                found[piece] = self.encode_piece(piece)
            else:
                groups[(len(data) + 3) // 4 if len(data) <= 32 else 9].append((piece, data))
        for group in groups.values():
            for i in range(0, len(group), 50_000):
                part = group[i : i + 50_000]
                for (piece, _), ids in zip(part, self.merge_many([d for _, d in part]), strict=True):
                    found[piece] = ids
        return found

    def learn(self, chunks: set[str]) -> None:
        """Put the entries of chunks into the cache; what this batch doesn't use goes when the cache is full."""
        missing = chunks - self.cache.keys()
        if len(self.cache) + len(missing) > CACHE_ENTRIES:
            self.cache = {c: self.cache[c] for c in chunks - missing}
        split = self.split.findall
        parts = {c: [c] if c.isalpha() and len(c) > 0 else split(c) for c in missing}
        ids_of = self.encode_pieces(list({p for ps in parts.values() for p in ps}))
        names, tokens = self.id_names, self.tokens
        for chunk, pieces in parts.items():
            ids = ids_of[pieces[0]] if len(pieces) == 1 else [i for p in pieces for i in ids_of[p]]
            self.cache[chunk] = (" ".join([names[i] for i in ids]), " ".join([tokens[i] for i in ids]), len(ids))

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space, as the library does for a file without a decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))

    def chunks(self, text: str) -> list[str]:
        """The normalised text in parts that no pre-token crosses: what white space separates."""
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # lower-cased letter by letter, so without the final sigma
        text = text.lower()
        return self.split.findall(text) if _ODD_SPACES.search(text) else text.split()

    def entries(self, texts: list[str | None]) -> Iterator[list[tuple[str, str, int]]]:
        """For each text, (ids as text, decoded text, number) of its chunks and special tokens."""
        parts = []
        for text in texts:
            if not text:
                parts.append([])
            elif self.special_split and any(s in text for s in self.specials):
                parts.append([(p, self.specials[p]) if p in self.specials else self.chunks(p) for p in self.special_split.split(text)])
            else:
                parts.append([self.chunks(text)])
        self.learn({c for text in parts for part in text if isinstance(part, list) for c in part})
        get = self.cache.__getitem__
        for text in parts:
            out: list[tuple[str, str, int]] = []
            for part in text:
                if isinstance(part, tuple):
                    out.append((str(part[1]), part[0], 1))
                else:
                    out += map(get, part)
            yield [e for e in out if e[2]]

    def encode(self, text: str | None) -> list[int]:
        return [int(x) for ids, _, _ in next(self.entries([text])) for x in ids.split(" ")]


_LOADED: dict[tuple, RankArrayTokenizer] = {}


def load(path: str, pattern: str | None = None) -> RankArrayTokenizer:
    """The tokenizer of this worker; a path that Spark has distributed is found by its name."""
    if (path, pattern) not in _LOADED:
        try:
            _LOADED[path, pattern] = RankArrayTokenizer.from_file(path, pattern)
        except FileNotFoundError:
            _LOADED[path, pattern] = RankArrayTokenizer.from_file(SparkFiles.get(path.rsplit("/", 1)[-1]), pattern)
    return _LOADED[path, pattern]


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    path = path or tokenizer_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        with no_gc():
            for batch in slices(batches, 1_000):
                counts, ids_sha, decoded_sha = [], [], []
                for found in tokenizer.entries(batch.column(1).to_pylist()):
                    ids, decoded, n = zip(*found, strict=True) if found else ((), (), ())
                    counts.append(sum(n))
                    ids_sha.append(hashlib.sha256(" ".join(ids).encode()).hexdigest())
                    decoded_sha.append(hashlib.sha256(" ".join(decoded).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        tokenizer.cache.clear()  # workers are kept for other work

    kind = docs.schema["doc_id"].dataType.simpleString()
    return mapped(docs.select("doc_id", "text"), encode, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
