"""Packed id matrices by best-fit-decreasing.

Documents become token ids with an end token, those longer than a row are cut
without loss, and pieces are dealt by hash to blocks of bounded size. Each block
is packed on its own: pieces from long to short, each into the open row with the
least room that still holds it, found in a segment tree over room sizes. A row of
the output is one line of the id matrix with its cumulative segment lengths and
the places where positions start again at 0.

Defined cases: a null text is an empty document and still has its end token;
repeated rows are packed each for itself; no documents give no rows; other
columns of the input are not looked at. Unused places at a row's end hold
``pad_id`` and belong to no segment.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skyweft.llm.common import prepare, spread
from skyweft.llm.slack_packing import CAPACITY, token_pieces

#: A token has at least one byte, so a block of so many bytes has no more tokens.
BLOCK_BYTES = 16 << 20
ROW_SCHEMA = (
    "sequence_id long, n_tokens int, input_ids binary, cu_seqlens array<int>, position_resets array<int>, "
    "doc_ids array<long>, pieces array<int>, starts array<long>"
)


class RoomTree:
    """Open rows by their room; finds the least room of at least a given size in O(log capacity)."""

    def __init__(self, capacity: int):
        self.leaves = 1 << (capacity + 1).bit_length()
        self.open = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _change(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.open[node] += by
            node >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, row) with the least room >= ``size``, taken out; None where no open row has it."""
        node = size + self.leaves
        if not self.open[node]:
            while node > 1 and (node & 1 or not self.open[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.open[2 * node] else 2 * node + 1
        room = node - self.leaves
        row = self.rows[room].pop()
        self._change(room, -1)
        return room, row


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indices of the pieces in each row, longest first; ``lengths`` come sorted from long to short."""
    tree, rows = RoomTree(capacity), []
    for index, length in enumerate(lengths):
        room, row = tree.take(length) or (capacity, len(rows))
        if row == len(rows):
            rows.append([])
        rows[row].append(index)
        tree.put(room - length, row)
    return rows


def _packed_block(table: pa.Table, capacity: int, pad_id: int) -> pa.Table:
    table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
    doc_ids, pieces, starts, lengths = (table.column(c).to_pylist() for c in ("doc_id", "piece", "start", "length"))
    ids, block = table.column("ids"), table.column("_block")[0].as_py()
    rows = []
    for number, members in enumerate(best_fit_decreasing(lengths, capacity)):
        ends = np.cumsum([0, *(lengths[i] for i in members)]).tolist()
        body = b"".join(ids[i].as_py() for i in members)
        body += np.full(capacity - ends[-1], pad_id, "<u4").tobytes()
        rows.append((
            (block << 32) + number, ends[-1], body, ends, ends[:-1],
            [doc_ids[i] for i in members], [pieces[i] for i in members], [starts[i] for i in members],
        ))
    schema = pa.schema([
        ("sequence_id", pa.int64()), ("n_tokens", pa.int32()), ("input_ids", pa.binary()),
        ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())),
        ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())), ("starts", pa.list_(pa.int64())),
    ])
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def pack_matrix(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, pad_id: int = 0,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Rows of the packed id matrix: ``input_ids`` holds ``capacity`` little-endian unsigned 32-bit ids."""
    prepare(docs.sparkSession)
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(1)).alias("size")
    total = docs.agg(size).first()[0] or 1
    blocks = F.lit(-(-total // block_bytes))
    pieces = token_pieces(docs, tokenizer_path, capacity, end_id)
    return (
        pieces.withColumn("_block", spread(["doc_id", "piece", "ids"], blocks))
        .groupBy("_block")
        .applyInArrow(lambda table: _packed_block(table, capacity, pad_id), ROW_SCHEMA)
    )


def write_matrix(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet files whose ``input_ids`` column, read in order, is the packed id matrix."""
    rows.write.mode(mode).parquet(path)


def position_ids(cu_seqlens: list[int], capacity: int) -> np.ndarray:
    """Positions of one row: they start again at 0 with each segment and in the unused rest."""
    starts = np.zeros(capacity, dtype=np.int32)
    inner = [s for s in cu_seqlens if 0 < s < capacity]
    starts[inner] = inner
    return np.arange(capacity, dtype=np.int32) - np.maximum.accumulate(starts)
