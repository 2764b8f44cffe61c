"""Token ids of texts in a public byte-level vocabulary."""

from __future__ import annotations

import base64
from unicodedata import category

import numpy as np

#: Fixed value: the word pattern that the vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Identifier that ends a document; free in the vocabulary.
END = 50256
#: Texts are encoded in parts of at least this many characters, so that memory stays small for a text of any length.
PART = 100_000


def cuts(text: str, part: int = PART) -> list[int]:
    """Ends of the parts of a text, about ``part`` characters apart, such that the parts' ids together are those of the whole text.

    A run of letters, or of digits, ends where another kind of character follows, and the pattern always begins a new piece there. There is no
    other cut: a text without such a place is one part.
    """
    out, at = [], part
    while at < len(text):
        kind, following = category(text[at - 1])[0], category(text[at])[0]
        if kind in "LN" and kind != following:
            out.append(at)
            at += part
        else:
            at += 1
    return [*out, len(text)]


class Encoder:
    """Lossless ids: the pieces of a text's ids, put together, are its UTF-8 bytes."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: bytes | None) -> np.ndarray:
        """Ids of a text; none for an empty or null text."""
        decoded = (text or b"").decode("utf-8", "replace")
        parts, start = [], 0
        for end in cuts(decoded) if decoded else ():
            parts.append(self.encoding.encode_to_numpy(decoded[start:end], disallowed_special=()))
            start = end
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def text(self, ids) -> str:
        return self.encoding.decode_bytes([int(i) for i in ids]).decode("utf-8", "replace")


def dtype_for(largest: int) -> np.dtype:
    """The smallest little-endian type that holds the identifiers."""
    return np.dtype("<u2") if largest < 1 << 16 else np.dtype("<u4")
