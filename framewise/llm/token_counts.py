"""Edit-aware token counts: a segment tree of pre-token counts for each document.

The pre-tokens of a text, some LEAF to a leaf, have their BPE counts summed up in a tree, beside the numbers of
characters. An edit re-encodes the leaves that it touches, from the leaf that holds the CONTEXT characters
before it up to the first leaf boundary that is a pre-token boundary again, and updates the sums on the paths
above. All else stays as it was counted.

Defined results: a null or empty text has no tokens and no edits; edits of one document may touch or be empty
but not overlap, and positions are those of the original text; rows that share a doc_id are counted each on
its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .bpe import load, tokenizer_path
from .common import mapped, no_gc, slices, table

TOKENIZER_FILE = "byte_bpe_50k.json"
#: Pre-tokens in a leaf; characters that a pre-token's end can depend on beyond itself; pre-tokens kept counted.
LEAF, CONTEXT, CACHE_ENTRIES = 48, 2, 500_000
#: What the query edits: mail addresses and long numbers are masked.
MASKS = ((regex.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"), "<email>"), (regex.compile(r"\d{9,}"), "<number>"))

Edit = tuple[int, int, str]


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Counter:
    """Token counts of pre-tokens, by the rank array; those of recent ones are kept."""

    def __init__(self, path: str, pattern: str):
        self.tokenizer = load(path, pattern)
        self.split = self.tokenizer.split.findall
        self.kept: dict[str, int] = {}

    def learn(self, pieces: set[str]) -> None:
        missing = pieces - self.kept.keys()
        if len(self.kept) + len(missing) > CACHE_ENTRIES:
            self.kept = {p: self.kept[p] for p in pieces - missing}
        self.kept.update((p, len(ids)) for p, ids in self.tokenizer.encode_pieces(list(missing)).items())

    def count(self, pieces: list[str]) -> int:
        try:
            return sum(map(self.kept.__getitem__, pieces))
        except KeyError:
            self.learn(set(pieces))
            return sum(map(self.kept.__getitem__, pieces))


class TokenTree:
    """A document's leaves and, for each node of a binary tree over them, its characters and tokens."""

    def __init__(self, pieces: list[str], counter: Counter):
        self.counter = counter
        groups = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]]
        self.leaves = ["".join(g) for g in groups]
        self.size = 1 << (len(groups) - 1).bit_length()
        pad = [0] * (self.size - len(groups))
        self.chars = [0] * self.size + [len(x) for x in self.leaves] + pad
        self.tokens = [0] * self.size + [counter.count(g) for g in groups] + pad
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
        self.reencoded = 0

    @property
    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(self.leaves)

    def find(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character, and where in the text the leaf starts; the last one at the end."""
        node, start = 1, 0
        position = min(position, self.chars[1] - 1)
        if position < 0:
            return 0, 0
        while node < self.size:
            node *= 2
            if position - start >= self.chars[node]:
                start += self.chars[node]
                node += 1
        return node - self.size, start

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.leaves[leaf] = text
        node = leaf + self.size
        dc, dt = len(text) - self.chars[node], tokens - self.tokens[node]
        while node:
            self.chars[node] += dc
            self.tokens[node] += dt
            node //= 2

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Replace the characters from start up to end."""
        if not 0 <= start <= end <= self.chars[1]:
            raise ValueError(f"the edit {start}:{end} is outside a text of {self.chars[1]} characters")
        low, at = self.find(start - CONTEXT if start > CONTEXT else 0)
        high, high_at = self.find(max(end - 1, start - CONTEXT, 0))
        region = "".join(self.leaves[low : high + 1])
        region = region[: start - at] + replacement + region[end - at :]
        while True:
            ahead, k = "", high + 1
            while k < len(self.leaves) and len(ahead) <= 4 * CONTEXT:
                ahead += self.leaves[k]
                k += 1
            pieces, done = [], 0
            for piece in self.counter.split(region + ahead):
                if done >= len(region):
                    break
                pieces.append(piece)
                done += len(piece)
            if done == len(region):
                break
            high += 1  # the last pre-token runs on into the next leaf
            region += self.leaves[high]
        self.reencoded += len(region)
        # spread the new pre-tokens over the leaves they replace
        n = high - low + 1
        step = -(-len(pieces) // n)
        for i in range(n):
            part = pieces[i * step : (i + 1) * step]
            self._set(low + i, "".join(part), self.counter.count(part))


def mask_edits(text: str) -> list[Edit]:
    """The edits that mask mail addresses and long numbers; of overlapping ones the first, then the longest."""
    found: list[Edit] = []
    for pattern, replacement in MASKS:
        found += [(m.start(), m.end(), replacement) for m in pattern.finditer(text)]
    out: list[Edit] = []
    for edit in sorted(found, key=lambda e: (e[0], -e[1])):
        if not out or edit[0] >= out[-1][1]:
            out.append(edit)
    return out


def count_documents(docs: DataFrame, edits: Callable[[str], list[Edit]] = mask_edits, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_edits, n_tokens_edited and n_reencoded (characters encoded again) of every document."""
    path, pattern = path or tokenizer_path(TOKENIZER_FILE), pattern or split_pattern()
    names = ["doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_reencoded"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, pattern)
        with no_gc():
            for batch in slices(batches, 500):
                rows = []
                found = [counter.split(t) if t else [] for t in batch.column(1).to_pylist()]
                counter.learn({p for pieces in found for p in pieces})
                for k, text in enumerate(batch.column(1).to_pylist()):
                    tree = TokenTree(found[k], counter)
                    before, todo = tree.total, edits(text) if text else []
                    for edit in reversed(todo):  # from the end, so that positions stay those of the original
                        tree.edit(*edit)
                    rows.append((before, len(todo), tree.total, tree.reencoded))
                columns = list(zip(*rows, strict=True)) if rows else [()] * 4
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return mapped(docs.select("doc_id", "text"), count, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names[1:]))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_documents(table(spark, sf_dir, "documents"))
