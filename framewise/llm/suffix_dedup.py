"""Removal of repeated byte strings, by a prefix-free parse of the corpus and its suffix arrays.

1. Parse. A rolling hash of TRIGGER bytes has its least value in every string of LENGTH bytes at one place, the
   string's trigger. Neighbouring strings with one trigger make a phrase. Phrases overlap by LENGTH - 1 bytes, so each
   string of LENGTH bytes starts in one phrase and lies wholly in it, and equal strings have equal triggers. The parse
   of a text is the list of its phrases.
2. Dictionary. The texts are packed into blocks (blocks.py). A block first sends its distinct triggers, and those that
   one document alone holds are left out of what follows: no string of theirs repeats. Then it sends its distinct
   phrases, each with its least and greatest doc_id, to the bucket of the phrase's trigger. Of a text that an earlier
   document has as a whole (told by a 128-bit digest) no phrase is sent.
3. Parse array. A bucket sorts the phrases it got by trigger and content. That orders the parse by its phrases, which
   is as deep as LENGTH bytes reach: the occurrences of a phrase stand side by side, its first document among them.
4. Dictionary array. The suffixes of LENGTH bytes at least of all phrases whose trigger has several phrases are sorted
   by their first LENGTH bytes. (The suffixes of a trigger's only phrase are equal to no others.)
5. Order of the corpus. Each run of suffixes whose common prefix is LENGTH bytes or more is combined with the runs of
   its phrases in the parse array: the least doc_id over them all is where the string first starts. What a block's
   documents have from an earlier one goes back to it as ranges of phrases, and the block cuts its texts.

Phrases with a trigger that more than HOT documents may hold are cut into their single strings, which are dealt by
their own content: no bucket gets all that follows or precedes one common line. Buckets are as many as the texts'
bytes ask for. Strings are compared by their bytes; hashes only deal them out.

Defined results: a null or empty text has no bytes; a text shorter than LENGTH keeps all; rows that share a doc_id are
judged each on its own text and never remove from each other; a row with a null doc_id keeps all and removes nothing
elsewhere; an empty table gives no rows; other columns are ignored or carried along, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import Block, answered, packed
from .common import mapped, materialize, reading, table, trimmed

#: Bytes of a string that is removed where it repeats, and of the rolling hash's window.
LENGTH, TRIGGER = 50, 24
#: Bytes of text whose triggers and phrases make a bucket, on average.
BUCKET_BYTES = 8 << 20
#: Blocks, or a block's parts for a bucket, that go to a Python worker at once.
ROWS_AT_ONCE = 4
#: Documents that may hold a trigger before its phrases are cut into single strings.
HOT = 256
#: Places where the strings of one trigger can start, and the bytes from the first one's start to the last one's end.
SPAN = LENGTH - TRIGGER + 1
REACH = SPAN - 1 + LENGTH
#: A record: REACH bytes, of which those outside the phrase are zero, then the first and last start in it.
RECORD = REACH + 4
#: Texts are hashed in pieces of so many starts, and records made and suffixes sorted so many at a time.
PIECE, ROWS = 1 << 17, 1 << 16
_POSITIONS = np.uint64(20)  # low bits of a packed minimum: the position within a piece


def rolling(text: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the `size` bytes from each position on."""
    n = len(text) - size + 1
    part, width, factor = text.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    h, done = np.zeros(n, np.uint64), 0
    while True:  # double the width; where size has its bit, append that many bytes
        if size & width:
            h = h * np.uint64(factor) + part[done : done + n]
            done += width
        if done == size:
            break
        part = part[:-width] * np.uint64(factor) + part[width:]
        factor = factor * factor % (1 << 64)
        width *= 2
    return _mixed(h)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Phrases:
    """Phrases by place: first and last start of their strings, the trigger's place, its hash, and the text's row."""

    def __init__(self, first: np.ndarray, last: np.ndarray, owner: np.ndarray, hashes: np.ndarray, row: np.ndarray):
        self.first, self.last, self.owner, self.hashes, self.row = first, last, owner, hashes, row

    def at(self, chosen: np.ndarray) -> Phrases:
        return Phrases(self.first[chosen], self.last[chosen], self.owner[chosen], self.hashes[chosen], self.row[chosen])


def parse(text: np.ndarray, offsets: np.ndarray, usable: np.ndarray) -> Phrases:
    """The phrases of the usable ones of the texts that lie between the offsets."""
    n, width = len(text) - LENGTH + 1, int(SPAN)
    long = usable & (np.diff(offsets) >= LENGTH)
    if n < 1 or not long.any():
        none = np.zeros(0, np.int64)
        return Phrases(none, none, none, none.astype(np.uint64), none)
    edge = np.zeros(n + 1, np.int8)
    edge[offsets[:-1][long]] = 1
    edge[offsets[1:][long] - LENGTH + 1] = -1
    valid = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
    firsts, lasts, owners, hashes = [], [], [], []
    for at in range(0, n, PIECE):
        own = valid[at : at + PIECE]
        if not own.any():
            continue
        h = rolling(text[at : at + len(own) + LENGTH - 1], TRIGGER)
        low = (h >> _POSITIONS << _POSITIONS) | np.arange(len(h), dtype=np.uint64)
        reach = 1
        while 2 * reach <= width:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if width > reach:
            low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
        owner = (low & np.uint64((1 << int(_POSITIONS)) - 1)).astype(np.int64)
        owner[~own] = -1
        begins = np.concatenate(([True], owner[1:] != owner[:-1]))
        first = np.flatnonzero(begins)
        last = np.concatenate((first[1:], [len(owner)])) - 1
        held = owner[first] >= 0
        first, last = first[held], last[held]
        firsts.append(first + at)
        lasts.append(last + at)
        owners.append(owner[first] + at)
        hashes.append(h[owner[first]])
    first, last, owner, h = (np.concatenate(x) for x in (firsts, lasts, owners, hashes))
    new = np.concatenate(([True], (first[1:] != last[:-1] + 1) | (owner[1:] != owner[:-1])))  # a piece's end cuts no phrase
    end = np.concatenate((new[1:], [True]))
    first, last, owner, h = first[new], last[end], owner[new], h[new]
    h = _mixed(h * np.uint64(0x9E3779B97F4A7C15))  # triggers are least hashes; mixed again they are spread evenly
    return Phrases(first, last, owner, h, np.searchsorted(offsets, first, "right") - 1)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each key; it grows with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where the rows of sorted columns differ from the row before."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _members(starts: np.ndarray, n: int) -> np.ndarray:
    """The number of the run that each of n rows is in, where runs begin at starts."""
    out = np.zeros(n, np.int64)
    out[starts[1:]] = 1
    return np.cumsum(out)


def _expanded(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row of each, and the values first, first + 1, ... of `count` each."""
    row = np.repeat(np.arange(len(first)), count)
    return row, first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)


def _words(records: np.ndarray) -> list[np.ndarray]:
    """Columns of 8 bytes, most significant first, so that their order is that of the bytes."""
    return list(records.view(np.uint64).byteswap().T)


def _sorted_by(words: list[np.ndarray], *before: np.ndarray) -> np.ndarray:
    """The order of rows by `before` and then the words."""
    return np.lexsort((*words[::-1], *before[::-1]))


class Triggers:
    """The distinct triggers of a block, in order, with the documents that may hold each; its whole texts' digests."""

    def __init__(self, block: Block):
        long = block.named & (np.diff(block.offsets) >= LENGTH)
        self.phrases = parse(block.text, block.offsets, block.named)
        self.keys, self.of = np.unique(self.phrases.hashes, return_inverse=True)
        order = np.argsort(self.of, kind="stable")
        starts = _starts(self.of[order]) if len(order) else order
        ids = block.ids[self.phrases.row[order]]
        several = np.minimum.reduceat(ids, starts) < np.maximum.reduceat(ids, starts) if len(order) else np.zeros(0, bool)
        self.holders = np.where(several, np.minimum(np.diff(np.append(starts, len(order))), 255), 1).astype(np.uint8)
        digests = b"".join(xxhash.xxh3_128_digest(block.bytes_of(r)) for r in np.flatnonzero(long))
        halves = np.frombuffer(digests, np.uint64).reshape(-1, 2)
        order = np.lexsort((halves[:, 1], halves[:, 0]))
        halves, rows = halves[order], np.flatnonzero(long)[order]
        starts = _starts(halves[:, 0], halves[:, 1])
        self.texts = halves[starts]
        self.least = np.minimum.reduceat(block.ids[rows], starts) if len(rows) else np.zeros(0, np.int64)
        self.rows, self.text_of = rows, _members(starts, len(rows))


def _squeeze(data: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(data).tobytes())


def _loose(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _cuts(keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """The buckets of sorted keys, with the first and past-the-last place of their keys."""
    if not len(keys):
        return []
    own = _bucket(keys, buckets)
    starts = _starts(own)
    return list(zip(own[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True))


_SENT = "bucket int, block long, keys binary, holders binary, texts binary, least binary"
_STATES = "block long, bucket int, states binary, least binary"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def shared_triggers(blocks: DataFrame, at: int, buckets: int) -> DataFrame:
    """For each block and bucket: the state of each trigger (0: of one document, 1: shared, 2: hot), and the least
    doc_id of each whole text."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(_column(batch, "block"), batch.column(batch.schema.get_field_index("data")), strict=True):
                own = Triggers(Block(data.as_py(), at))
                keys, texts = _cuts(own.keys, buckets), _cuts(own.texts[:, 0], buckets)
                rows = {b: [b, name, own.keys[x:y].tobytes(), _squeeze(own.holders[x:y]), b"", b""] for b, x, y in keys}
                for b, x, y in texts:
                    row = rows.setdefault(b, [b, name, b"", _squeeze(own.holders[:0]), b"", b""])
                    row[4:] = [own.texts[x:y].tobytes(), own.least[x:y].tobytes()]
                yield _batch([tuple(r) for r in rows.values()], _SENT)

    @trimmed
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, names, keys, holders, texts, least = 0, [], [], [], [], []
        for batch in batches:
            if batch.num_rows:
                bucket = batch.column(batch.schema.get_field_index("bucket"))[0].as_py()
            names += _column(batch, "block")
            keys += [np.frombuffer(x, np.uint64) for x in _column(batch, "keys")]
            holders += [_loose(x, np.uint8) for x in _column(batch, "holders")]
            texts += [np.frombuffer(x, np.uint64).reshape(-1, 2) for x in _column(batch, "texts")]
            least += [np.frombuffer(x, np.int64) for x in _column(batch, "least")]
        known, of = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(of, np.concatenate(holders), len(known))
        states = ((total > 1).astype(np.uint8) + (total > HOT))[of]
        both, docs = np.concatenate(texts), np.concatenate(least)
        order = np.lexsort((both[:, 1], both[:, 0]))
        starts = _starts(both[order, 0], both[order, 1])
        first = np.zeros(len(docs), np.int64)
        if len(docs):
            first[order] = np.minimum.reduceat(docs[order], starts)[_members(starts, len(docs))]
        k, t = np.cumsum([0, *map(len, keys)]), np.cumsum([0, *map(len, texts)])
        for i, name in enumerate(names):
            yield _batch([(name, bucket, _squeeze(states[k[i] : k[i + 1]]), first[t[i] : t[i + 1]].tobytes())], _STATES)

    sent = mapped(blocks.select("block", "data"), send, _SENT)
    return materialize(sent.groupBy("bucket").applyInArrow(meet, _STATES), "trigger-states", rows=ROWS_AT_ONCE)


class Dictionary:
    """The distinct phrases of a block and where each occurs; its entries, in the order of their buckets, which are
    phrases or, for hot triggers, strings; and the phrases that each entry is (in)."""

    def __init__(self, block: Block, answers: list[dict]):
        found = Triggers(block)
        answers = sorted(answers, key=lambda a: a["bucket"])
        states = np.concatenate([np.zeros(0, np.uint8), *(_loose(a["states"], np.uint8) for a in answers)])
        least = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(a["least"], np.int64) for a in answers)])
        self.copies = np.zeros(len(block.ids), bool)
        if len(found.rows):
            self.copies[found.rows] = least[found.text_of] < block.ids[found.rows]
        own = states[found.of] if len(found.of) else states
        chosen = np.flatnonzero((own > 0) & ~self.copies[found.phrases.row])
        phrases, hot = found.phrases.at(chosen), own[chosen] > 1
        del found, own
        records = _records(block.text, phrases)
        words = _words(records)
        order = _sorted_by(words, phrases.hashes)
        starts = _starts(phrases.hashes[order], *(w[order] for w in words))
        self.begin, self.row = phrases.owner[order] - SPAN + 1, phrases.row[order]  # of the occurrences, by phrase
        self.places = np.append(starts, len(order))
        ids = block.ids[self.row]
        least = np.minimum.reduceat(ids, starts) if len(starts) else ids
        most = np.maximum.reduceat(ids, starts) if len(starts) else ids
        keys, hot, records = phrases.hashes[order][starts], hot[order][starts], records[order[starts]]
        plain, cut = np.flatnonzero(~hot), np.flatnonzero(hot)
        strings, within = _strings(records[cut])
        words = _words(strings)
        content = np.zeros(len(strings), np.uint64)
        for w in words:
            content = _mixed(content * np.uint64(0x9E3779B97F4A7C15) + w)
        order = _sorted_by(words, content)
        starts = _starts(content[order], *(w[order] for w in words))
        within = cut[within[order]]
        merged = np.argsort(np.concatenate((keys[plain], content[order[starts]])), kind="stable")
        joined = lambda of_phrases, of_strings: np.concatenate((of_phrases, of_strings))[merged]
        self.keys, self.records = joined(keys[plain], content[order[starts]]), joined(records[plain], strings[order[starts]])
        self.least = joined(least[plain], np.minimum.reduceat(least[within], starts) if len(starts) else least[:0])
        self.most = joined(most[plain], np.maximum.reduceat(most[within], starts) if len(starts) else most[:0])
        self.phrases = np.concatenate((plain, within))
        self.phrase_at = joined(np.arange(len(plain)), len(plain) + starts)
        self.n_phrases = joined(np.ones(len(plain), np.int64), np.diff(np.append(starts, len(within))))

    def occurrences(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places of entries' phrases: which entry, where its record begins in the text, and the text's row."""
        which, at = _expanded(self.phrase_at[entry], self.n_phrases[entry])
        phrase = self.phrases[at]
        of, place = _expanded(self.places[phrase], self.places[phrase + 1] - self.places[phrase])
        return which[of], self.begin[place], self.row[place]


def _strings(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A record for each single string of the phrases, and the phrase it is of."""
    first, last = records[:, REACH].astype(np.int64), records[:, REACH + 1].astype(np.int64)
    within, start = _expanded(first, last - first + 1)
    out, column = records[within], np.arange(REACH)
    for x in range(0, len(out), ROWS):
        own = slice(x, x + ROWS)
        out[own, :REACH] *= (column >= start[own, None]) & (column < start[own, None] + LENGTH)
    out[:, REACH] = out[:, REACH + 1] = start
    return out, within


def _records(text: np.ndarray, phrases: Phrases) -> np.ndarray:
    """The phrases' bytes, each where it lies about its trigger."""
    padded = np.concatenate((np.zeros(SPAN - 1, np.uint8), text, np.zeros(LENGTH, np.uint8)))
    out = np.zeros((len(phrases.first), RECORD), np.uint8)
    column = np.arange(REACH)
    if not len(out):
        return out
    windows = np.lib.stride_tricks.sliding_window_view(padded, REACH)
    first, last = phrases.first - (phrases.owner - SPAN + 1), phrases.last - (phrases.owner - SPAN + 1)
    for x in range(0, len(out), ROWS):
        own = slice(x, x + ROWS)
        inside = (column >= first[own, None]) & (column < last[own, None] + LENGTH)
        out[own, :REACH] = windows[phrases.owner[own]] * inside
        out[own, REACH], out[own, REACH + 1] = first[own], last[own]
    return out


_ENTRIES = "bucket int, block long, records binary, keys binary, least binary, most binary"
_REPEATS = "block long, bucket int, entry binary, range binary, origin binary"


def origins(records: np.ndarray, keys: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For phrases that got to a bucket: ranges of strings of an entry that start in one document before the entry's
    greatest. Gives the entry, the range (first and last start), and the document."""
    words = _words(records)
    # the parse array: entries by key and content, so that the occurrences of a phrase are one run
    order = _sorted_by(words, keys)
    starts = _starts(keys[order], *(w[order] for w in words))
    phrase_of = _members(starts, len(order))
    dictionary, key = records[order[starts]], keys[order][starts]
    first_doc = np.minimum.reduceat(least[order], starts)
    begin, end = dictionary[:, REACH].astype(np.int64), dictionary[:, REACH + 1].astype(np.int64)
    groups = _starts(key)
    size = np.diff(np.append(groups, len(key)))
    alone = np.repeat(size, size) == 1
    found = [(np.flatnonzero(alone), begin[alone], end[alone], first_doc[alone])]
    # the dictionary array: suffixes of the other phrases, some whole groups at a time
    other = np.flatnonzero(~alone)
    group = np.repeat(np.arange(len(groups)), size)[other]
    strings = np.cumsum(end[other] - begin[other] + 1)
    at = 0
    while at < len(other):
        stop = int(np.searchsorted(strings, (strings[at - 1] if at else 0) + ROWS, "right"))
        stop = int(np.searchsorted(group, group[min(max(stop, at + 1), len(other)) - 1], "right"))
        part = other[at:stop]
        at = stop
        row, start = _expanded(begin[part], end[part] - begin[part] + 1)
        suffixes = np.zeros((len(row), -(-LENGTH // 8) * 8), np.uint8)
        suffixes[:, :LENGTH] = np.lib.stride_tricks.sliding_window_view(dictionary[part], LENGTH, axis=1)[row, start]
        columns = _words(suffixes)
        array = _sorted_by(columns)
        runs = _starts(*(c[array] for c in columns))  # the common prefix of neighbours falls below LENGTH
        origin = np.zeros(len(row), np.int64)
        origin[array] = np.minimum.reduceat(first_doc[part][row[array]], runs)[_members(runs, len(row))]
        ranges = _starts(row, origin)
        stops = np.append(ranges[1:], len(row)) - 1
        found.append((part[row[ranges]], start[ranges], start[stops], origin[ranges]))
    phrase, begin, end, origin = (np.concatenate(x) for x in zip(*found, strict=True))
    # both combined: a range holds for every occurrence of its phrase that has a later document
    places = np.append(starts, len(order))
    which, place = _expanded(places[phrase], places[phrase + 1] - places[phrase])
    entry = order[place]
    later = origin[which] < most[entry]
    entry, which = entry[later], which[later]
    return entry, np.stack((begin[which], end[which]), axis=1).astype(np.uint8), origin[which]


def repeats(blocks: DataFrame, states: DataFrame, at: int, buckets: int) -> DataFrame:
    """For each block and bucket: entries of the block's dictionary, ranges of their strings, and where those start."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data, answers in zip(_column(batch, "block"), batch.column(1), batch.column(2), strict=True):
                own = Dictionary(Block(data.as_py(), at), answers.as_py() or [])
                order = np.argsort(_bucket(own.keys, buckets), kind="stable")
                for b, x, y in _cuts(own.keys[order], buckets):
                    part = order[x:y]
                    yield _batch([(b, name, _squeeze(own.records[part]), own.keys[part].tobytes(), own.least[part].tobytes(), own.most[part].tobytes())], _ENTRIES)

    @trimmed
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, names, records, columns = 0, [], [], ([], [], [])
        for batch in batches:
            if batch.num_rows:
                bucket = batch.column(batch.schema.get_field_index("bucket"))[0].as_py()
            names += _column(batch, "block")
            records += [_loose(x, np.uint8).reshape(-1, RECORD) for x in _column(batch, "records")]
            for held, name, kind in zip(columns, ("keys", "least", "most"), (np.uint64, np.int64, np.int64), strict=True):
                held += [np.frombuffer(x, kind) for x in _column(batch, name)]
        offsets = np.cumsum([0, *map(len, records)])
        joined, records = np.concatenate(records), []
        entry, span, origin = origins(joined, *map(np.concatenate, columns))
        order = np.argsort(entry, kind="stable")
        cuts = np.searchsorted(entry[order], offsets)
        for i, name in enumerate(names):
            own = order[cuts[i] : cuts[i + 1]]
            if len(own):
                yield _batch([(name, bucket, _squeeze((entry[own] - offsets[i]).astype(np.int32)), _squeeze(span[own]), _squeeze(origin[own]))], _REPEATS)

    sent = mapped(answered(blocks.select("block", "data"), states), send, _ENTRIES)
    return materialize(sent.groupBy("bucket").applyInArrow(meet, _REPEATS), "repeats", rows=ROWS_AT_ONCE)


def removed(block: Block, states: list[dict], found: list[dict], buckets: int) -> np.ndarray:
    """Which bytes of a block's texts go."""
    steps = np.zeros(len(block.text) + 1, np.int32)
    own = Dictionary(block, states)
    np.add.at(steps, block.offsets[:-1][own.copies], 1)
    np.add.at(steps, block.offsets[1:][own.copies], -1)
    base = {b: x for b, x, _ in _cuts(own.keys, buckets)}
    for a in found:
        entry, span, origin = _loose(a["entry"], np.int32) + base[a["bucket"]], _loose(a["range"], np.uint8).reshape(-1, 2).astype(np.int64), _loose(a["origin"], np.int64)
        which, begin, row = own.occurrences(entry)
        later = origin[which] < block.ids[row]
        which, begin = which[later], begin[later]
        np.add.at(steps, begin + span[which, 0], 1)
        np.add.at(steps, begin + span[which, 1] + LENGTH, -1)
    return np.cumsum(steps[:-1]) > 0


class Cut:
    """What is left of a block's texts: its bytes with offsets, and the numbers of bytes and of maximal runs removed."""

    def __init__(self, block: Block, gone: np.ndarray):
        heads = block.offsets[:-1]
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        filled = heads[np.diff(block.offsets) > 0]
        begins[filled] = gone[filled]  # a run ends with its text
        total = lambda marks: np.diff(np.append(0, np.cumsum(marks, dtype=np.int64))[block.offsets])
        self.removed, self.spans = total(gone), total(begins)
        self.kept = block.text[~gone]
        self.offsets = block.offsets - np.append(0, np.cumsum(self.removed))

    def bytes_of(self, row: int) -> bytes:
        return self.kept[self.offsets[row] : self.offsets[row + 1]].tobytes()


def cut_blocks(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """Blocks with the answers to both questions (the second's states are null), the text's place, and the buckets."""
    at = docs.columns.index("text")
    blocks = packed(docs)
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = 1 + total // BUCKET_BYTES
    states = shared_triggers(blocks, at, buckets)
    found = repeats(blocks, states, at, buckets)
    columns = ("bucket", "states", "least", "entry", "range", "origin")
    answers = states.unionByName(found, allowMissingColumns=True).select("block", *columns)
    return reading(answered(blocks.select("block", "data"), answers), blocks, states, found), at, buckets


def _opened(batches: Iterator[pa.RecordBatch], at: int, buckets: int) -> Iterator[tuple[Block, Cut]]:
    for batch in batches:
        for data, answers in zip(batch.column(1), batch.column(2), strict=True):
            block, listed = Block(data.as_py(), at), answers.as_py() or []
            yield block, Cut(block, removed(block, [a for a in listed if a["states"] is not None], [a for a in listed if a["states"] is None], buckets))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks, at, buckets = cut_blocks(docs.select("doc_id", "text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, cut in _opened(batches, at, buckets):
            digests = [hashlib.sha256(cut.bytes_of(r)).hexdigest() for r in range(len(block.ids))]
            ids = block.rows.column(0).combine_chunks()
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(block.offsets)), pa.array(cut.removed), pa.array(cut.spans), pa.array(digests, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return reading(mapped(blocks, judge, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"), *blocks._held)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents' own columns, texts without their repeated strings; a character cut in two goes as a whole."""
    schema = docs.schema
    blocks, at, buckets = cut_blocks(docs)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, cut in _opened(batches, at, buckets):
            held = block.rows.column(at).combine_chunks()
            texts = [cut.bytes_of(r).decode("utf-8", "ignore") if n else held[r].as_py() for r, n in enumerate(cut.removed.tolist())]
            columns = [pa.array(texts, held.type) if i == at else block.rows.column(i).combine_chunks() for i in range(block.rows.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return reading(mapped(blocks, keep, schema), *blocks._held)


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
