"""Token-id output: best-fit-decreasing packing of documents into rows of fixed length.

Each document becomes its ids and an end identifier. A document longer than a row is cut into pieces of one row each
and a rest; nothing is lost, as every segment names its document and where in the document it starts. Pieces are placed
longest first, each into the open row with the least room that still holds it; a segment tree over the room finds that
row in logarithmic time. Packing is done within blocks of a bounded number of tokens of one task, so rows never
cross tasks, nothing is shuffled, and a lost task is simply run again.

Output per row: ``shard`` and ``row`` (their pair is unique), ``input_ids`` (little-endian unsigned 16-bit ids, 32-bit
where the vocabulary needs them; unused places hold ``pad``), ``n_tokens`` (used places), ``cu_seqlens`` (cumulative
segment lengths from 0 to ``n_tokens``), ``position_ids`` (same width as ``input_ids``, or 32-bit where a row is longer
than 65,536; from 0 again at every segment, 0 in unused places), ``doc_ids`` and ``starts`` (per segment its document and
the place of its first token in that document).

A null or empty text has the end identifier alone. Repeated rows are packed as often as they occur; null ids stay null.
An empty table gives no rows. Other columns are not used, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from evenkeel.llm.common import binary_rows, list_rows, text_slices, vocabulary_path
from evenkeel.llm.tokens import END, VOCABULARY, Encoder, dtype_for

ROW_TOKENS = 2048
BLOCK_TOKENS = 2 << 20

SCHEMA = (
    "shard int, row long, input_ids binary, n_tokens int, cu_seqlens array<int>, position_ids binary, "
    "doc_ids array<long>, starts array<long>"
)


class RoomTree:
    """Open rows by the room they have left; each node knows whether any row lies below it."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(self.leaves)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        node = room + self.leaves
        while node and not self.any[node]:
            self.any[node] = 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, row) of the row with the least room of at least ``need``."""
        node = need + self.leaves
        while not self.any[node]:
            while node & 1:  # a right child has nothing further to its right
                node >>= 1
            if node == 0:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node if self.any[2 * node] else 2 * node + 1
        room = node - self.leaves
        row = self.rows[room].pop()
        if not self.rows[room]:
            self.any[node] = 0
            node >>= 1
            while node:
                self.any[node] = self.any[2 * node] | self.any[2 * node + 1]
                node >>= 1
        return room, row


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Row of each piece (all of at least 1 and at most ``capacity``), longest pieces first, and the number of rows."""
    rows, used, tree = np.zeros(len(lengths), np.int64), 0, RoomTree(capacity)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = tree.take(need) if need < capacity else None
        room, row = found or (capacity, used)
        used += found is None
        rows[i] = row
        if room > need:
            tree.put(room - need, row)
    return rows, used


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, .. of every run, one run after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def pack_block(doc_ids: list, documents: list[np.ndarray], capacity: int, pad: int, dtype: np.dtype, shard: int, first: int) -> pa.RecordBatch:
    sizes = np.array([len(d) for d in documents])
    parts = -(-sizes // capacity)
    doc = np.repeat(np.arange(len(documents)), parts)
    start = spread(np.zeros(len(parts), np.int64), parts) * capacity
    length = np.minimum(capacity, sizes[doc] - start)
    row, rows = best_fit(length, capacity)
    order = np.argsort(row, kind="stable")  # within a row longest first is not kept, document order is
    doc, start, length, row = doc[order], start[order], length[order], row[order]
    per_row, filled = np.bincount(row, minlength=rows), np.bincount(row, length, minlength=rows).astype(np.int64)
    before = np.cumsum(length) - length
    offset = before - np.repeat(np.cumsum(filled) - filled, per_row)  # of a segment in its row
    place = spread(row * capacity + offset, length)
    flat, begin = np.concatenate(documents), np.cumsum(sizes) - sizes
    ids = np.full(rows * capacity, pad, dtype)
    ids[place] = flat[spread(begin[doc] + start, length)]
    positions = np.zeros(rows * capacity, dtype_for(capacity - 1) if dtype.itemsize == 2 else np.dtype("<u4"))
    positions[place] = spread(np.zeros(len(length), np.int64), length)
    bounds = np.insert(offset + length, np.cumsum(per_row) - per_row, 0)
    docs = pa.array(doc_ids, pa.int64()).take(pa.array(doc))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(rows, shard, np.int32)),
            pa.array(np.arange(first, first + rows)),
            binary_rows(ids.reshape(rows, capacity)),
            pa.array(filled.astype(np.int32)),
            list_rows(pa.array(bounds.astype(np.int32)), per_row + 1),
            binary_rows(positions.reshape(rows, capacity)),
            list_rows(docs, per_row),
            list_rows(pa.array(start), per_row),
        ],
        ["shard", "row", "input_ids", "n_tokens", "cu_seqlens", "position_ids", "doc_ids", "starts"],
    )


def pack(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    row_tokens: int = ROW_TOKENS,
    block_tokens: int = BLOCK_TOKENS,
    vocabulary: str | None = None,
    end: int = END,
    pad: int = END,
    largest: int = END,
) -> DataFrame:
    """Packed rows of all documents; see the module's description."""
    path, dtype = vocabulary or vocabulary_path(VOCABULARY), dtype_for(max(largest, end, pad))

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        encoder, shard, row = Encoder(path), TaskContext.get().partitionId(), 0
        ids, documents, held = [], [], 0

        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                ids += part.column("doc_id").to_pylist()
                for value in texts:
                    documents.append(np.append(encoder.ids(value), end).astype(dtype))
                    held += len(documents[-1])
                if held >= block_tokens:
                    packed = pack_block(ids, documents, row_tokens, pad, dtype, shard, row)
                    row, ids, documents, held = row + packed.num_rows, [], [], 0
                    yield from in_slices(packed)
        if documents:
            yield from in_slices(pack_block(ids, documents, row_tokens, pad, dtype, shard, row))

    chosen = docs.selectExpr(f"CAST(`{doc_id}` AS LONG) AS doc_id", f"CAST(`{text}` AS STRING) AS text")
    return chosen.mapInArrow(run, SCHEMA)


def in_slices(batch: pa.RecordBatch, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def unpack(row, dtype: str = "<u2") -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, start, ids) of every segment of one packed row."""
    ids = np.frombuffer(row["input_ids"], dtype)
    for k, (doc, start) in enumerate(zip(row["doc_ids"], row["starts"], strict=True)):
        yield doc, start, ids[row["cu_seqlens"][k] : row["cu_seqlens"][k + 1]]
