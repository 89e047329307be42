"""SentencePiece encoding and decoding (merge-type models) through a table of each prefix's last token.

A merge-type model joins, again and again, the two neighbouring symbols whose piece scores best, the first of equals.
What it makes of a text is one sequence of tokens, and what it makes of a prefix that ends with one of these tokens is
the same sequence up to there: so each prefix has one last token. It is found from left to right: of the pieces that an
Aho-Corasick automaton matches at a prefix's end, it is the one that stays apart from the last token of the prefix before
it. Two tokens stay apart if, while both are put together from characters in order of rank, no merge across their border
ever comes first. The ids then follow backwards from the whole text's last token. Nothing is merged at encoding time.

Pieces that the model's own merges never form are left out of the automaton. Characters without a piece become the ids of
their bytes. Text is cut where no piece of the model reaches across: before each run of blanks, around line ends, and between
characters (letters and marks, say) that no chain of neighbours in pieces joins. The parts are kept in a bounded cache of each worker.

Defined results: a null or empty text has no ids and decodes to the empty text; a "▁" written in a text decodes to a blank,
as the library does; rows that share a doc_id are encoded each on its own; an empty table gives no rows; other columns are
ignored. Models of another type, with user-defined or unused pieces, with a character map, or without byte pieces are refused.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import mapped, no_gc, slices, table

MODEL_FILE = "piece_bpe_32k.model"
#: Encoded parts, and answers on pairs of tokens, that a worker keeps; parts beyond so many characters are not kept.
CACHE_ENTRIES, PAIR_ENTRIES, CACHED_CHARS = 500_000, 1_000_000, 200
#: Fixed values of the model format: kinds of pieces, the merge type, and the mark that stands for a blank.
NORMAL, UNKNOWN, CONTROL, BYTE, MERGE_TYPE, BLANK = 1, 2, 3, 6, 2, "▁"
_NEVER = 1 << 60


def model_path(name: str = MODEL_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(tag & 7) or varint()
        yield tag >> 3, data[at : at + size]
        at += size


def alphabets(pieces: Iterable[str]) -> list[str]:
    """Characters that neighbours in pieces join, directly or through others; those that stay alone are left out."""
    above: dict[str, str] = {}

    def top(c: str) -> str:
        while (up := above.setdefault(c, c)) != c:
            above[c] = above[up]
            c = above[c]
        return c

    for p in pieces:
        for a, b in pairwise(p):
            above[top(a)] = top(b)
    groups = defaultdict(list)
    for c in above:
        groups[top(c)].append(c)
    return ["".join(sorted(g)) for g in sorted(groups.values(), key=len, reverse=True) if len(g) > 1]


class _Kept(dict):
    """Answers by key; `ask` is called for one that is missing, and may keep it here."""

    def __init__(self, ask: Callable):
        self.ask = ask

    def __missing__(self, key):
        return self.ask(key)


class PrefixTokenizer:
    """Encodes and decodes as the model file says."""

    def __init__(self, model: bytes):
        import struct

        pieces, trainer, normaliser = [], {}, {}
        for number, value in fields(model):
            if number == 1:
                piece = dict(fields(value))
                pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normaliser = dict(fields(value))
        kinds = {kind for *_, kind in pieces}
        if trainer.get(3) != MERGE_TYPE or trainer.get(24) or not trainer.get(35) or not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("a merge-type model with byte pieces, and without user-defined or unused ones, is needed")
        if normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(5, 1):
            raise ValueError("the model rewrites its texts; only blanks may be marked")
        self.prefix = BLANK if normaliser.get(3, 1) else ""
        self.pieces = [p for p, *_ in pieces]
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.controls = {i for i, (*_, kind) in enumerate(pieces) if kind == CONTROL}
        self.byte_ids = [i for _, i in sorted((int(p[1:-1], 16), i) for i, (p, _, kind) in enumerate(pieces) if kind == BYTE)]
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        #: what an id spells by itself, and how it is written; bytes spell nothing by themselves
        self.spelling = {i: "" if i in self.controls else p.replace(BLANK, " ") for i, p in enumerate(self.pieces) if i not in self.byte_of}
        self.names = [str(i) for i in range(len(pieces))]
        order = {s: r for r, s in enumerate(sorted({s for _, s, kind in pieces if kind == NORMAL}, reverse=True))}
        #: piece -> its place in the order of merges; pieces of equal score share one
        self.rank = {p: order[s] for p, s, kind in pieces if kind == NORMAL and len(p) > 1}
        self.right: dict[str, list[tuple[str, int]]] = {}
        self.left: dict[str, list[tuple[str, int]]] = {}
        self.automaton = ahocorasick.Automaton()
        for p in {*self.ids, *(c for p in self.ids for c in p)}:
            if self._formed(p):
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        inner = any(b == BLANK != a for p in self.ids for a, b in pairwise(p))
        line = "\n" if not any("\n" in p for p in self.ids) else ""
        joined = alphabets(p.lstrip(BLANK) for p in self.ids)
        runs = [*(f"[{re.escape(a)}]+" for a in joined), f"[^{re.escape(BLANK + line + ''.join(joined))}]+"]
        self.cut = re.compile(r"(?s).+" if inner else rf"{BLANK}*(?:{'|'.join(runs)})|{BLANK}+|[{line or BLANK}]")
        self.apart: dict[tuple[str, str], bool] = _Kept(self._judge)
        self.cache: dict[str, tuple[str, str]] = _Kept(self._entry)

    def _formed(self, piece: str) -> bool:
        """Whether the merges make a piece of its own characters; if so, note the parts at both its ends, each with the rank
        of the merge that takes it up."""
        parts, right, left, before = list(piece), [], [], -1
        while len(parts) > 1:
            best, at = min((self.rank.get(a + b, _NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best == _NEVER:
                return False
            if best < before:  # the pair test takes ranks for the order of merges
                raise ValueError(f"the piece {piece!r} is not formed in the order of its scores")
            before = best
            if at == 0:
                left.append((parts[0], best))
            if at == len(parts) - 2:
                right.append((parts[-1], best))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        self.left[piece], self.right[piece] = [*left, (piece, _NEVER)], [*right, (piece, _NEVER)]
        return True

    def stay_apart(self, a: str, b: str) -> bool:
        """Whether neighbouring tokens a and b are what the merges make of their characters together.

        The parts on either side of the border are followed in the order in which merges take them up. At one rank, merges
        inside a come before one across the border, and that one before merges inside b: the first from the left wins.
        """
        return self.apart[a, b]

    def _judge(self, pair: tuple[str, str]) -> bool:
        a, b = pair
        ends, starts = self.right.get(a, [(a, _NEVER)]), self.left.get(b, [(b, _NEVER)])
        i = j = 0
        found = True
        while a:  # nothing is merged with the emptiness before a text
            (x, x_until), (y, y_until) = ends[i], starts[j]
            across = self.rank.get(x + y, _NEVER)
            if across < x_until and across <= y_until and across < _NEVER:
                found = False
                break
            if x_until == y_until == _NEVER:
                break
            if x_until <= y_until:
                i += 1
            else:
                j += 1
        if len(self.apart) >= PAIR_ENTRIES:
            self.apart.clear()
        self.apart[pair] = found
        return found

    def tokens(self, part: str) -> list[str]:
        """The tokens of normalised text: the last one of each prefix, then those that the whole text's lead back to."""
        # by a prefix's last place, and "" for the emptiness before all; a character that no piece holds is its own last token
        last: list[str | None] = [None] * len(part)
        last.append("")
        apart, found = self.apart, -1
        for end, token in self.automaton.iter(part):  # of one end, the longest first
            if end != found:
                before = last[end - len(token)]
                if before is None:
                    before = part[end - len(token)]
                if apart[before, token]:
                    last[end] = token
                    found = end
        out, end = [], len(part) - 1
        while end >= 0:
            out.append(last[end] or part[end])
            end -= len(out[-1])
        out.reverse()
        return out

    def encode_part(self, part: str) -> list[int]:
        tokens = self.tokens(part)
        try:
            return [self.ids[token] for token in tokens]
        except KeyError:  # some character is spelt in bytes
            return [i for token in tokens for i in ([self.ids[token]] if token in self.ids else [self.byte_ids[b] for b in token.encode()])]

    def spelt(self, ids: list[int]) -> str:
        """What ids spell: runs of bytes are read as UTF-8, marks become blanks, controls vanish."""
        try:
            return "".join([self.spelling[i] for i in ids])
        except KeyError:  # some are bytes
            pass
        out, held = [], bytearray()
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                held.append(b)
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(self.spelling[i])
        return "".join(out) + held.decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the blank that encoding puts in front."""
        text = self.spelt(ids)
        first = next((i for i in ids if i not in self.controls), None)
        return text[1:] if self.prefix and first is not None and self.pieces[first].startswith(BLANK) else text

    def _entry(self, part: str) -> tuple[str, str]:
        """The ids of a part, as text, and what they spell."""
        ids = self.encode_part(part)
        entry = ",".join([self.names[i] for i in ids]), self.spelt(ids)
        if len(part) <= CACHED_CHARS:
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache.clear()
            self.cache[part] = entry
        return entry

    def _entries(self, text: str) -> list[tuple[str, str]]:
        return list(map(self.cache.__getitem__, self.cut.findall(self.prefix + text.replace(" ", BLANK))))

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, and digests of the ids and of the decoded text."""
        found = self._entries(text) if text else []
        ids = ",".join([i for i, _ in found])
        decoded = "".join([d for _, d in found])
        decoded = decoded[1:] if found and self.prefix else decoded
        return ids.count(",") + bool(ids), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    def encode(self, text: str | None) -> list[int]:
        return [int(x) for ids, _ in (self._entries(text) if text else []) for x in ids.split(",")]


_LOADED: dict[bytes, PrefixTokenizer] = {}


def loaded(model: bytes) -> PrefixTokenizer:
    """The tokenizer of this worker."""
    key = hashlib.sha256(model).digest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = PrefixTokenizer(model)
    return _LOADED[key]


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document. The driver reads the model file and broadcasts it."""
    with open(path or model_path(), "rb") as f:
        model = f.read()
    loaded(model)  # a model that cannot be used is refused here
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = loaded(sent.value)
        with no_gc():
            for batch in slices(batches, 1_000):
                found = [tokenizer.digests(text.as_py()) for text in batch.column(1)]
                columns = list(zip(*found, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True))], names=names)
        tokenizer.cache.clear()  # workers are kept for other work
        tokenizer.apart.clear()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return mapped(docs.select("doc_id", "text"), encode, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
