"""Documents packed into blocks: some megabytes of rows each, as one value of a table in the shared folder.

A block keeps every column of its rows, whatever their names. Work on texts then needs a row for each block, or for
each pair of a block and a bucket of keys, instead of one for each key, and texts cross the network as compressed
blocks. Blocks are cut in the order in which a task reads its rows, so packing shuffles nothing. A block has the id
that the task which wrote it drew; the table is written before anything reads it, so the ids stay as they are.

Defined results: an empty table gives no blocks; a row is never cut, so one text may make a larger block; null texts
count as empty; a doc_id that is no whole number is null.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, mapped, materialize

#: Bytes of text in a block, as soon as which it is closed, and documents that go to a Python worker at once.
BLOCK_BYTES, ROWS_AT_ONCE = 4 << 20, 1_000


def _as_bytes(column: pa.Array) -> pa.Array:
    wide = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column
    return wide.cast(pa.large_binary())


def packed(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """block (an id), n_bytes (of its texts) and data (its rows, with doc_id as a long after them)."""
    at = docs.columns.index("text")

    def row(held: list[pa.RecordBatch], n: int) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for batch in held:
                out.write_batch(batch)
        name = int.from_bytes(os.urandom(8), "little") >> 1
        return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([n], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "n_bytes", "data"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy().astype(np.int64))
            begun, done = 0, 0
            while begun < batch.num_rows:
                stop = min(batch.num_rows, int(np.searchsorted(ends, done + block_bytes - n)) + 1)
                held.append(batch.slice(begun, stop - begun))
                n += int(ends[stop - 1]) - done
                begun, done = stop, int(ends[stop - 1])
                if n >= block_bytes:
                    yield row(held, n)
                    held, n = [], 0
        if held:
            yield row(held, n)

    rows = docs.select(*[docs[c] for c in docs.columns], docs["doc_id"].try_cast("long").alias(fresh(docs, "id")))
    return materialize(mapped(rows, pack, "block long, n_bytes long, data binary"), "blocks", rows=ROWS_AT_ONCE)


class Block:
    """The rows of a block; their texts as one array of bytes with offsets; their ids, and whether they have one."""

    def __init__(self, data: bytes, at: int):
        table = pa.ipc.open_stream(data).read_all().combine_chunks()
        self.rows = table.select(range(table.num_columns - 1))
        text = pc.fill_null(_as_bytes(table.column(at).combine_chunks()), b"")
        self.offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        raw = text.buffers()[2]
        self.text = np.frombuffer(raw, np.uint8)[: self.offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        ids = table.column(table.num_columns - 1).combine_chunks()
        self.named = ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy()

    def bytes_of(self, row: int) -> bytes:
        return self.text[self.offsets[row] : self.offsets[row + 1]].tobytes()


def answered(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """The blocks with `answers`: a list of all columns of their rows in the table of answers; null if they have none."""
    listed = answers.groupBy("block").agg(F.collect_list(F.struct(*[c for c in answers.columns if c != "block"])).alias("answers"))
    return blocks.join(listed, "block", "left")
