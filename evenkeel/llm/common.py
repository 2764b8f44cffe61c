"""What the training-data operators share: Arrow batches, word codes, the shared folder and the held-out split."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folder of the public vocabularies; never copied into the repository.
TOKENIZERS = "/opt/tokenizers"
#: Texts are handled in slices of a batch that hold about this many bytes.
SLICE_BYTES = 2 << 20
#: Entries of a per-task cache before it is emptied.
CACHE_ENTRIES = 300_000

#: Lower-cases A-Z and leaves every other byte.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Lower-cases A-Z and turns every ASCII byte that is no digit or letter into a blank.
LOWER_WORDS = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def vocabulary_path(name: str, folder: str = TOKENIZERS) -> str:
    return os.path.join(folder, name)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def text_slices(batch: pa.RecordBatch, column: str, slice_bytes: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Parts of a batch with their texts as UTF-8 bytes (None for null), each part about ``slice_bytes`` long."""
    texts = batch.column(column).cast(pa.binary()) if batch.num_rows else []
    start, size = 0, 0
    for i in range(batch.num_rows):
        value = texts[i]
        size += len(value.as_buffer()) if value.is_valid else 0
        if size >= slice_bytes or i == batch.num_rows - 1:
            yield batch.slice(start, i + 1 - start), texts.slice(start, i + 1 - start).to_pylist()
            start, size = i + 1, 0


class WordCodes(dict):
    """64-bit code of a word's bytes, remembered for words seen before."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        code = self[word] = xxhash.xxh64_intdigest(word)
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(function, schema)


def binary_rows(matrix: np.ndarray) -> pa.Array:
    """Each row of a matrix as one binary value."""
    rows = np.ascontiguousarray(matrix)
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def list_rows(values: pa.Array, lengths: np.ndarray) -> pa.Array:
    """Consecutive values as one list per row."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)
