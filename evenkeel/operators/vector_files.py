"""Token vectors in flat files of the shared folder, found by key and read in place.

Every task writes the vectors it holds to a file of its own, 32-bit numbers row after row, and reports which token lies where. An index leads
from a token's key, the 128 bits of its MD5, to file and row: keys are dealt to parts by their highest bits, and a part is one file with its
keys in order. Only keys and places are shuffled, so vectors lie on disk once, and whoever needs some reads these and sends none along.
A task that is run again writes another file; places lead to the files of the tasks that reported them.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.workspace import file_system, new_path, settle

# Keys of one part of the index.
PART_KEYS = 250_000
# Rows of an Arrow batch while vectors are written; tokens may be taken from whole texts in the same stage.
WRITE_ROWS = 2500
# Where files are not mapped, rows that lie as near as this are read at once, up to so many bytes.
NEAR_BYTES, READ_BYTES = 8192, 8 << 20
PLACE = np.dtype([("low", "<u8"), ("file", "<i8"), ("row", "<i8")])


def write_vectors(vectors: DataFrame) -> tuple[DataFrame, str]:
    """Write (token, vector) to files; returns (token, file, row, width) of every vector and the folder. A null vector is none."""
    folder = new_path(vectors.sparkSession, "vectors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, row, name = None, 0, TaskContext.get().taskAttemptId()
        try:
            for batch in batches:
                n = batch.num_rows
                if not n:
                    continue
                if out is None:
                    store, place = file_system(f"{folder}/{name}")
                    store.create_dir(place.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(place)
                column = batch.column("vector")
                flat = column.flatten().to_numpy(zero_copy_only=False)
                out.write(np.ascontiguousarray(flat, np.float32).tobytes())
                places = [pa.array(np.full(n, name, np.int64)), pa.array(np.arange(row, row + n)), column.value_lengths()]
                yield pa.RecordBatch.from_arrays([batch.column("token"), *places], ["token", "file", "row", "width"])
                row += n
        finally:
            if out is not None:
                out.close()

    chosen = vectors.select("token", F.col("vector").cast("array<float>").alias("vector")).where("vector is not null")
    return settle(chosen.mapInArrow(run, "token string, file long, row long, width int"), "vector-places", WRITE_ROWS), folder


def keys_of(tokens: Sequence[str]) -> np.ndarray:
    """High and low half of every token's key."""
    return np.frombuffer(b"".join([hashlib.md5(t.encode()).digest() for t in tokens]), "<u8").reshape(-1, 2)


def part_of(high: np.ndarray, parts: int) -> np.ndarray:
    return ((high >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


def write_index(places: DataFrame, rows: int, vectors: str, width: int) -> VectorFiles:
    """Write the index of settled places of so many rows in the folder ``vectors``."""
    folder, parts = new_path(places.sparkSession, "vector-index"), max(1, -(-rows // PART_KEYS))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = keys_of(batch.column("token").to_pylist())
            halves = [pa.array(keys[:, i].astype(np.int64)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part_of(keys[:, 0], parts)), *halves, batch.column("file"), batch.column("row")], ["part", "high", "low", "file", "row"]
            )

    def write(part: int, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        high, low = (table[c].to_numpy().astype(np.uint64) for c in ("high", "low"))
        order = np.lexsort((low, high))
        values = np.empty(len(order), PLACE)
        values["low"], values["file"], values["row"] = low[order], table["file"].to_numpy()[order], table["row"].to_numpy()[order]
        path = f"{folder}/{uuid.uuid4().hex}"
        store, place = file_system(path)
        store.create_dir(place.rpartition("/")[0], recursive=True)
        with store.open_output_stream(place) as out:
            out.write(high[order].tobytes())
            out.write(values.tobytes())
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([path]), pa.array([len(order)], pa.int64())], ["part", "path", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = None, []
        for batch in batches:
            numbers = batch.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                if rows and numbers[start] != part:
                    yield write(part, rows)
                    rows = []
                part = int(numbers[start])
                rows.append(batch.slice(start, end - start))
        if rows:
            yield write(part, rows)

    known = places.where("token is not null").select("token", "file", "row").mapInArrow(keyed, "part int, high long, low long, file long, row long")
    dealt = known.repartition(parts, "part").sortWithinPartitions("part")
    index = {r.part: (r.path, r.n) for r in settle(dealt.mapInArrow(run, "part int, path string, n long"), "vector-parts").collect()}
    return VectorFiles(vectors, index, parts, width)


def read_rows(path: str, rows: np.ndarray, width: int) -> np.ndarray:
    """Rows of one file, given in order."""
    store, place = file_system(path)
    size, out = 4 * width, np.empty((len(rows), width), np.float32)
    with store.open_input_file(place) as source:
        if store.type_name == "local":  # mapped: only the pages that are touched are read
            cuts = np.array([0, len(rows)])
        else:
            apart = (np.diff(rows) * size > NEAR_BYTES) | (np.diff(rows * size // READ_BYTES) > 0)
            cuts = np.concatenate([[0], np.flatnonzero(apart) + 1, [len(rows)]])
        for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if start == end:
                continue
            first, last = int(rows[start]), int(rows[end - 1])
            source.seek(first * size)
            part = np.frombuffer(source.read_buffer((last + 1 - first) * size), np.float32).reshape(-1, width)
            out[start:end] = part[rows[start:end] - first]
    return out


class VectorFiles:
    """Vectors of tokens by the index; travels with the job as names of files only."""

    def __init__(self, folder: str, index: dict[int, tuple[str, int]], parts: int, width: int):
        self.folder, self.index, self.parts, self.width = folder, index, parts, width

    def find(self, tokens: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """File and row of every token, -1 for none."""
        keys = keys_of(tokens)
        order = np.argsort(keys[:, 0])
        high, low = keys[order, 0], keys[order, 1]
        files, rows = np.full(len(order), -1, np.int64), np.full(len(order), -1, np.int64)
        owner = part_of(high, self.parts)
        cuts = [0, *(np.flatnonzero(np.diff(owner)) + 1).tolist(), len(owner)]
        for start, end in zip(cuts, cuts[1:]):
            path, n = self.index.get(int(owner[start]), ("", 0)) if start < end else ("", 0)
            if not n:
                continue
            store, place = file_system(path)
            with store.open_input_file(place) as source:
                known = np.frombuffer(source.read_buffer(8 * n), "<u8")
                values = np.frombuffer(source.read_buffer(PLACE.itemsize * n), PLACE)
                at = np.searchsorted(known, high[start:end])
                open_ = np.flatnonzero(at < n)
                while len(open_):  # more than one step only where the high halves of two keys are equal
                    open_ = open_[known[at[open_]] == high[start:end][open_]]
                    right = values["low"][at[open_]] == low[start:end][open_]
                    hit = order[start:end][open_[right]]
                    files[hit], rows[hit] = values["file"][at[open_[right]]], values["row"][at[open_[right]]]
                    open_ = open_[~right]
                    at[open_] += 1
                    open_ = open_[at[open_] < n]
        return files, rows

    def read(self, tokens: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Which tokens have a vector, by their positions, and these vectors."""
        files, rows = self.find(tokens)
        order = np.lexsort((rows, files))
        order = order[files[order] >= 0]
        cuts = [0, *(np.flatnonzero(np.diff(files[order])) + 1).tolist(), len(order)]
        parts = [read_rows(f"{self.folder}/{files[order[a]]}", rows[order[a:b]], self.width) for a, b in zip(cuts, cuts[1:]) if a < b]
        return order, np.concatenate(parts) if parts else np.zeros((0, max(self.width, 1)), np.float32)
