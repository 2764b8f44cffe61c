"""Tokens of Arrow batches as integers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def token_codes(*columns: pa.Array) -> tuple[list[list[np.ndarray]], pa.Array]:
    """Per column the token codes of every text, and the distinct tokens that the codes stand for.

    A text has its tokens with one blank between them; an empty or null one has none. Codes are the same in all columns of the batch.
    """
    lists = [pc.split_pattern(pc.fill_null(pa.array(c.to_pylist(), pa.string()), ""), " ") for c in columns]
    lengths = [x.value_lengths().to_numpy(zero_copy_only=False) for x in lists]
    flat = pa.concat_arrays([x.flatten() for x in lists])
    empty = pc.equal(flat, "").to_numpy(zero_copy_only=False)  # the only piece of an empty text
    # A null has no code.
    coded = pc.if_else(pa.array(empty), pa.scalar(None, pa.string()), flat).dictionary_encode()
    codes, rows, start = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False), [], 0
    for own in lengths:
        ends = start + np.cumsum(own)
        rows.append([codes[e - n : e] if n > 1 or codes[e - 1] >= 0 else codes[:0] for e, n in zip(ends, own)])
        start = int(ends[-1]) if len(ends) else start
    return rows, coded.dictionary
