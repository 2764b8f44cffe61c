"""Language identification by segmentation-marginalised unigrams.

Every language has its own probabilities for the pieces of one fixed public byte-level vocabulary. The probability of a
word is the sum over all ways to cut it into pieces, found by a forward pass; a text is scored by the sum of its
words' logarithms. The piece probabilities are fitted by expectation maximisation over all segmentations of the words of
a bounded sample of labelled rows. Every byte is a piece, so every text has a score in every language.

Words are the white-space separated parts of the lower-cased text with a blank before them; a word of more than ``WORD_BYTES`` bytes, as in
scripts without spaces, is cut between characters into parts of at most so many, and no segmentation crosses such a cut. Texts that are null or hold no letter are ``und``
with score 0, as is every text when nothing could be learned. Rows with a null language teach nothing; languages that
differ in any character are different; between equal scores the first in code-point order wins; equal texts get equal
predictions.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import CACHE_ENTRIES, text_slices, vocabulary_path
from evenkeel.workspace import settle

UNDETERMINED = "und"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Expected number of labelled rows taken per language; above it, rows are chosen by the hash of key and text.
ROWS_PER_LANGUAGE = 4_000
#: The model and its counts have one number per piece and language; this bounds what reaches the driver, about 1,300 languages.
MODEL_BYTES = 512 << 20
WORD_BYTES = 48
LETTER = re.compile(r"[^\W\d_]")


BASE, MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
TABLE_BITS = 20


@dataclass
class Pieces:
    """The vocabulary with a hash table that finds the pieces of many substrings at once.

    A substring is known by a 64-bit rolling hash; that of the vocabulary's pieces are checked to be different.
    """

    pieces: list[bytes]
    longest: int = field(init=False)

    def __post_init__(self):
        self.none = len(self.pieces)
        self.longest = max(map(len, self.pieces), default=1)
        #: Hash of each piece; the last, which no substring has, stands for no piece.
        self.hashes = np.zeros(self.none + 1, np.uint64)
        for i, piece in enumerate(self.pieces):
            h = 0
            for c in piece:
                h = (h * int(BASE) + c + 1) & 0xFFFFFFFFFFFFFFFF
            self.hashes[i] = h
        if len(np.unique(self.hashes)) != self.none + 1:
            raise ValueError("two pieces share a hash")
        #: First piece of each slot, and the next piece in the same slot.
        self.table = np.full(1 << TABLE_BITS, self.none, np.int32)
        self.next = np.full(self.none + 1, self.none, np.int32)
        for i, slot in enumerate((self.hashes[:-1] * MIX >> np.uint64(64 - TABLE_BITS)).tolist()):
            self.next[i] = self.table[slot]
            self.table[slot] = i

    @classmethod
    def load(cls, path: str) -> Pieces:
        with open(path, "rb") as lines:
            pieces = [base64.b64decode(line.split()[0]) for line in lines if line.strip()]
        return cls(list(dict.fromkeys([*pieces, *(bytes([b]) for b in range(256))])))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Id of the piece with each hash, ``none`` if there is none."""
        wanted = np.ravel(hashes)
        ids = self.table[wanted * MIX >> np.uint64(64 - TABLE_BITS)]
        open_ = np.flatnonzero(self.hashes[ids] != wanted)
        while len(open_):
            ids[open_] = self.next[ids[open_]]
            open_ = open_[(ids[open_] != self.none) & (self.hashes[ids[open_]] != wanted[open_])]
        return ids.reshape(hashes.shape)


def words_of(text: bytes) -> list[bytes]:
    words = [b" " + w for w in text.decode("utf-8", "replace").lower().encode().split()]
    if max(map(len, words), default=0) > WORD_BYTES:
        words = [part for w in words for part in character_parts(w)]
    return words


def character_parts(word: bytes) -> Iterator[bytes]:
    """A word in parts of at most ``WORD_BYTES`` bytes, cut between characters."""
    start = 0
    while start < len(word):
        end = min(len(word), start + WORD_BYTES)
        while end < len(word) and word[end] & 0xC0 == 0x80:
            end -= 1
        yield word[start:end]
        start = end


def spans(words: list[bytes], pieces: Pieces) -> np.ndarray:
    """For words of one length: piece id of [start, start + size] at [size - 1, start, word], ``none`` if there is none."""
    n = len(words[0])
    letters = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), n).T.astype(np.uint64) + np.uint64(1)
    table = np.full((min(n, pieces.longest), n, len(words)), pieces.none, np.int32)
    hashes = np.zeros_like(letters)
    for k in range(len(table)):
        hashes = hashes[: n - k] * BASE + letters[k:]
        table[k, : n - k] = pieces.find(hashes)
    return table


def forward(table: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward sums [word, position, language] and the logarithm of each word's probability.

    ``p`` has a last row of zeros for substrings that are no piece.
    """
    wide, n, m = table.shape
    alpha = np.zeros((n + 1, m, p.shape[1]))
    alpha[0] = 1.0
    log = np.zeros((m, p.shape[1]))
    for end in range(1, n + 1):
        for k in range(1, min(end, wide) + 1):
            alpha[end] += alpha[end - k] * p[table[k - 1, end - k]]
        if end % 8 == 0:  # keep long words from underflowing
            scale = alpha[end].copy()
            alpha[max(0, end - wide) : end + 1] /= scale
            log += np.log(scale)
    return alpha, log + np.log(alpha[n])


def by_length(words: list[bytes]) -> Iterator[list[int]]:
    """Positions of the words of each length, in groups of bounded size."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for n, places in groups.items():
        step = max(1, 2_000_000 // (n * n))
        yield from (places[i : i + step] for i in range(0, len(places), step))


def expected_counts(words: list[bytes], languages: np.ndarray, counts: np.ndarray, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in each language over all segmentations of the words.

    Sums are kept as logarithms, so words of rare pieces do not underflow.
    """
    total = np.zeros(p.shape)
    for places in by_length(words):
        own = np.array(places)
        lang, table = languages[own], spans([words[i] for i in places], pieces)
        wide, n, m = table.shape
        with np.errstate(divide="ignore"):
            q = np.log(p[table, lang])
        alpha, beta = np.full((n + 1, m), -np.inf), np.full((n + 1, m), -np.inf)
        alpha[0] = beta[n] = 0.0
        for end in range(1, n + 1):
            for k in range(1, min(end, wide) + 1):
                alpha[end] = np.logaddexp(alpha[end], alpha[end - k] + q[k - 1, end - k])
        for start in range(n - 1, -1, -1):
            for k in range(1, min(n - start, wide) + 1):
                beta[start] = np.logaddexp(beta[start], beta[start + k] + q[k - 1, start])
        for start in range(n):
            for k in range(1, min(n - start, wide) + 1):
                uses = counts[own] * np.exp(alpha[start] + q[k - 1, start] + beta[start + k] - alpha[n])
                np.add.at(total, (table[k - 1, start], lang), uses)
    total[-1] = 0
    return total


@dataclass
class LanguageModel:
    languages: list[str]
    pieces: Pieces
    p: np.ndarray  # [piece, language], last row zero


def sample_rows(rows: DataFrame, by: str, key: Column, most: int, groups: int) -> DataFrame:
    """Per group all rows, or about ``most`` of them chosen by the hash of ``key``; groups beyond the bound are an error."""
    sizes = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).limit(groups + 1).collect()
    if len(sizes) > groups:
        raise ValueError(f"more than {groups} values of {by}")
    rates = {r[by]: min(1.0, most / r["n"]) for r in sizes}
    if not rates:
        return rows.limit(0)
    rate = F.create_map(*[F.lit(x) for kv in rates.items() for x in kv])[F.col(by)]
    return rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < rate * (1 << 30))


def fit(
    rows: DataFrame,
    text: str = "text",
    lang: str = "lang",
    key: Column | None = None,
    rows_per_language: int = ROWS_PER_LANGUAGE,
    rounds: int = 3,
    smoothing: float = 0.05,
    vocabulary: str | None = None,
    max_languages: int | None = None,
) -> LanguageModel:
    """Fit the piece probabilities on labelled rows; a bounded sample of rows per language is enough for its pieces."""
    pieces = Pieces.load(vocabulary or vocabulary_path(VOCABULARY))
    max_languages = max_languages or MODEL_BYTES // (8 * pieces.none)
    rows = rows.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), (key if key is not None else F.col(text)).alias("key"))
    chosen = sample_rows(rows.where("text is not null and lang is not null"), "lang", F.col("key"), rows_per_language, max_languages)

    def count_words(batches):
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                counts: dict = {}
                for language, value in zip(part.column("lang").to_pylist(), texts, strict=True):
                    if LETTER.search(value.decode("utf-8", "replace")):
                        for word in words_of(value):
                            counts[language, word] = counts.get((language, word), 0) + 1
                yield pa.RecordBatch.from_pydict(
                    {"lang": [a for a, _ in counts], "word": pa.array([w for _, w in counts], pa.binary()), "n": pa.array(counts.values(), pa.int64())},
                    schema=pa.schema([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64())]),
                )

    counted = settle(chosen.mapInArrow(count_words, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "word-counts")
    languages = sorted((r[0] for r in counted.select("lang").distinct().limit(max_languages + 1).collect()), key=lambda s: s.encode())
    p = np.full((pieces.none + 1, len(languages)), 1.0 / pieces.none)
    p[-1] = 0
    context = rows.sparkSession.sparkContext
    for _ in range(rounds if languages else 0):
        shared = context.broadcast((pieces, languages, p))

        def expect(batches, shared=shared):
            pieces, languages, p = shared.value
            at = {name: i for i, name in enumerate(languages)}
            total = np.zeros(p.shape)
            for batch in batches:
                lang = np.array([at[x] for x in batch.column("lang").to_pylist()], np.int64)
                total += expected_counts(batch.column("word").to_pylist(), lang, batch.column("n").to_numpy().astype(float), pieces, p)
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(lang), pa.array(total[piece, lang])], ["piece", "lang", "n"])

        uses = counted.mapInArrow(expect, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow()
        p = np.full(p.shape, smoothing)
        p[uses["piece"].to_numpy(), uses["lang"].to_numpy()] += uses["n"].to_numpy()
        p[-1] = 0
        p /= p.sum(axis=0)
        shared.unpersist()
    return LanguageModel(languages, pieces, p)


class Scorer:
    """Log-probabilities of words per language, remembered for words seen before."""

    def __init__(self, model: LanguageModel):
        self.model, self.rows, self.known = model, np.zeros((0, len(model.languages))), {}

    def learn(self, words: set[bytes]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > CACHE_ENTRIES:
            self.known, self.rows, new = {}, self.rows[:0], list(words)
        values = np.zeros((len(new), len(self.model.languages)))
        for places in by_length(new):
            values[places] = forward(spans([new[i] for i in places], self.model.pieces), self.model.p)[1]
        self.known.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
        self.rows = np.concatenate([self.rows, values])

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if not self.model.languages:
            return names, scores
        words = [words_of(t) if t and LETTER.search(t.decode("utf-8", "replace")) else [] for t in texts]
        flat = [w for own in words for w in own]
        self.learn(set(flat))
        values = self.rows[np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))]
        start = 0
        for i, own in enumerate(words):
            if own:
                total = values[start : start + len(own)].sum(axis=0)
                best = int(total.argmax())
                names[i], scores[i] = self.model.languages[best], float(1 / np.exp(total - total[best]).sum())
            start += len(own)
        return names, scores


def predict(rows: DataFrame, model: LanguageModel, text: str = "text", name: str = "lang_pred", score: str = "score") -> DataFrame:
    """Rows with the likeliest language and its posterior probability under equal priors; columns of these names are replaced."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in rows.columns if c not in (name, score)]

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            for part, texts in text_slices(batch, text):
                names, scores = scorer.predict(texts)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept if c != text), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*(c for c in kept if c != text), name, score])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema if f.name != text]
    return rows.select(*kept).mapInArrow(run, ", ".join([*fields, f"`{name}` string", f"`{score}` double"]))
