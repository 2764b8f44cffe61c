"""Greedy token matching (the published BERTScore formula) over pluggable token vectors.

Every token takes its best cosine against the other text; precision and recall are the means over the
paraphrase's and the original's tokens. Equal tokens match with 1.0; a token without a vector matches only
itself. A text without tokens scores 0.0.

Inside a task tokens are integers: every text is split and counted once (an original once for all the pairs that follow one another), and a
token's code leads to its place in one flat buffer of 32-bit vectors. Only tokens that are missing in the other text are compared. Products
are taken block by block in 32 bits and merged by maximum; the cosine of the best partner is then taken in double precision.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.operators.vector_files import VectorFiles, read_rows, write_index, write_vectors
from evenkeel.workspace import measure, settle, spread_small, within_bounds

# A vector table is sent to the Python workers only up to these measured sizes.
VECTOR_ROWS = 200_000
VECTOR_BYTES = 128 * 1024 * 1024
# Beyond them a task reads the vectors that its pairs need. It forgets what it knows when its texts have so many distinct tokens.
BATCH_TOKENS = 80_000
# Rows of an Arrow batch where scores are written down.
TEXT_ROWS = 400
# Pairs of a small input that stay together when it is dealt over the cores; those of one original mostly follow one another.
DEALT_ROWS = 64
# Rows and columns of one block of the similarity matrix.
BLOCK = 2048


class Vectors:
    """Token vectors in one flat buffer; ``places`` tells by a token's code where its vector lies, -1 for none."""

    def __init__(self, places: np.ndarray, rows: np.ndarray):
        self.rows, self.norms, self.size = rows[:0], np.zeros(0), 0
        self.add(rows)
        self.with_places(places)

    def add(self, rows: np.ndarray) -> None:
        """Take further vectors in behind those at hand. The buffers grow by half and are used again after ``clear``."""
        end = self.size + len(rows)
        if end > len(self.rows):
            room = max(end, len(self.rows) * 3 // 2)
            self.rows, before = np.empty((room, rows.shape[1]), np.float32), self.rows[: self.size]
            self.norms, norms = np.empty(room), self.norms[: self.size]
            self.rows[: self.size], self.norms[: self.size] = before, norms
        norms = np.sqrt(np.einsum("ij,ij->i", rows, rows, dtype=np.float64))
        self.rows[self.size : end], self.norms[self.size : end] = rows, np.where(norms > 0, norms, 1.0)
        self.size = end

    def clear(self) -> None:
        self.size = 0
        self.with_places(np.zeros(0, np.int64))

    def with_places(self, places: np.ndarray) -> Vectors:
        """The same vectors for tokens of other codes."""
        self.places, self.present = places, np.zeros(len(places), bool)
        return self

    def units(self, at: np.ndarray) -> np.ndarray:
        return self.rows[at] / self.norms[at, None].astype(np.float32)

    def best(self, ours: np.ndarray, theirs: np.ndarray) -> np.ndarray:
        """Highest cosine of each of our vectors against theirs."""
        most, at = np.full(len(ours), -np.inf, np.float32), np.zeros(len(ours), np.int64)
        for j in range(0, len(theirs), BLOCK):
            part = theirs[j : j + BLOCK]
            columns = self.units(part).T
            for i in range(0, len(ours), BLOCK):
                own = slice(i, i + BLOCK)
                product = self.units(ours[own]) @ columns
                where = product.argmax(axis=1)
                value = product[np.arange(len(where)), where]
                better = value > most[own]
                most[own], at[own] = np.where(better, value, most[own]), np.where(better, part[where], at[own])
        dots = np.einsum("ij,ij->i", self.rows[ours].astype(np.float64), self.rows[at].astype(np.float64))
        return dots / self.norms[ours] / self.norms[at]

    def matched_mean(self, kinds: np.ndarray, counts: np.ndarray, others: np.ndarray) -> float:
        """Mean over a text's tokens of the best match in the other text; both given by distinct codes."""
        self.present[others] = True
        lone = ~self.present[kinds]
        self.present[others] = False
        best = np.ones(len(kinds))
        if lone.any():
            own, theirs = self.places[kinds[lone]], self.places[others]
            theirs, found = theirs[theirs >= 0], np.zeros(len(own))
            if len(theirs) and (own >= 0).any():
                found[own >= 0] = np.maximum(self.best(own[own >= 0], theirs), 0.0)
            best[lone] = found
        return float(best @ counts / counts.sum())

    def score(self, ours: np.ndarray, theirs: np.ndarray) -> float:
        """F1 of two texts, each given by its distinct codes and, in a second row, their counts."""
        if not ours.size or not theirs.size:
            return 0.0
        return f1(self.matched_mean(*ours, theirs[0]), self.matched_mean(*theirs, ours[0]))


def f1(precision: float, recall: float) -> float:
    return 2 * precision * recall / (precision + recall) if precision + recall > 0 else 0.0


def new_codes() -> defaultdict:
    """Tokens and their codes; a token that is asked for the first time gets the next one."""
    codes: defaultdict = defaultdict()
    codes.default_factory = codes.__len__
    return codes


def counted(text: str | None, codes: defaultdict, near: dict | None = None) -> tuple[np.ndarray, dict]:
    """Distinct codes of a lower-case text's tokens, in a second row how often each occurs; and its tokens' codes.

    ``near`` has the codes of a text that shares many tokens: they are found there faster than among those of all texts.
    """
    counts = Counter((text or "").split())  # white space as in ``SPACE_CLASS``
    if near is None:
        found = list(map(codes.__getitem__, counts))
    else:
        found = list(map(near.get, counts))
        if None in found:
            found = [codes[t] if c is None else c for t, c in zip(counts, found)]
    return np.array([found, list(counts.values())], np.int32).reshape(2, -1), dict(zip(counts, found)) if near is None else near


def _answer(pairs: pa.Array, values: np.ndarray) -> pa.RecordBatch:
    """The pairs' own columns and their scores."""
    names = [pairs.type.field(i).name for i in range(pairs.type.num_fields)]
    return pa.RecordBatch.from_arrays([*pairs.flatten(), pa.array(values)], [*names, "score"])


def _with_texts(pairs: DataFrame, hypothesis: str, reference: str, keep: Sequence[str]) -> DataFrame:
    whole = F.struct(*[F.col(c) for c in keep]).alias("_pair")
    return pairs.select(whole, F.lower(F.col(hypothesis)).alias("_ours"), F.lower(F.col(reference)).alias("_theirs"))


def _scored_schema(pairs: DataFrame, keep: Sequence[str]) -> T.StructType:
    return T.StructType([*(pairs.schema[c] for c in keep), T.StructField("score", T.DoubleType())])


def _collected(places: DataFrame, folder: str, width: int) -> tuple[list[str], np.ndarray]:
    """Tokens and vectors of a written table of proven small size."""
    local = places.select("token", "file", "row").toArrow()
    files, rows = local["file"].to_numpy(), local["row"].to_numpy()
    matrix = np.zeros((len(rows), max(width, 1)), np.float32)
    for file in np.unique(files):
        at = np.flatnonzero(files == file)
        at = at[np.argsort(rows[at])]
        matrix[at] = read_rows(f"{folder}/{file}", rows[at], width)
    return local["token"].to_pylist(), matrix


def score_by_broadcast(pairs: DataFrame, vectors: tuple[list[str], np.ndarray], hypothesis: str, reference: str, keep: Sequence[str]) -> DataFrame:
    """Map-only: every task holds the vector table of proven small size."""
    shared = pairs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, rows = shared.value
        place, table = {token: i for i, token in enumerate(tokens)}, Vectors(np.zeros(0, np.int64), rows)
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, last, theirs, coded = new_codes(), None, None, []
            for own, text in zip(batch.column("_ours").to_pylist(), batch.column("_theirs").to_pylist()):
                if theirs is None or text != last:
                    last, (theirs, near) = text, counted(text, codes)
                coded.append((counted(own, codes, near)[0], theirs))
            table.with_places(np.fromiter((place.get(t, -1) for t in codes), np.int64, len(codes)))
            yield _answer(batch.column("_pair"), np.array([table.score(*both) for both in coded]))

    return _with_texts(pairs, hypothesis, reference, keep).mapInArrow(run, _scored_schema(pairs, keep))


def compared(coded: Sequence[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """By code, whether a token occurs in a pair whose texts differ in their tokens; no other token's vector is looked at."""
    needed = np.zeros(size, bool)
    for ours, theirs in coded:
        if ours.size and theirs.size and (ours.shape != theirs.shape or not np.array_equal(np.sort(ours[0]), np.sort(theirs[0]))):
            needed[ours[0]] = True
            needed[theirs[0]] = True
    return needed


def score_by_files(pairs: DataFrame, files: VectorFiles, hypothesis: str, reference: str, keep: Sequence[str]) -> DataFrame:
    """For a written vector table of any size. Map-only: texts and codes stay in their task, which reads the vectors it needs.
    Only an input that is too small for all cores as it lies is dealt out first.

    A task holds the vectors of at most ``BATCH_TOKENS`` distinct tokens and those of one pair; it reads each of them once.
    Rows of ``_batch`` hold the scored pairs that were worked on together.
    """
    schema = T.StructType([T.StructField("_batch", T.ArrayType(_scored_schema(pairs, keep)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, asked, table = new_codes(), np.zeros(0, bool), Vectors(np.zeros(0, np.int64), np.zeros((0, max(files.width, 1)), np.float32))

        def scored(coded: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
            nonlocal asked
            old, new = len(asked), compared(coded, len(codes))
            places = np.concatenate([table.places, np.full(len(codes) - old, -1, np.int64)])
            new[:old] &= ~asked
            at = np.flatnonzero(new)
            if len(at):
                tokens = list(islice(codes, int(at[-1]) + 1))
                found, values = files.read([tokens[i] for i in at.tolist()])
                places[at[found]] = np.arange(table.size, table.size + len(found))
                table.add(values)
            new[:old] |= asked
            asked = new
            table.with_places(places)
            return np.array([table.score(*both) for both in coded])

        def answer(part: pa.Array, coded: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            rows = pa.StructArray.from_arrays([*part.flatten(), pa.array(scored(coded))], fields=fields)
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)], ["_batch"])

        for batch in batches:
            whole, last, theirs, coded, start = batch.column("_pair"), None, None, [], 0
            fields = [*(whole.type.field(i) for i in range(whole.type.num_fields)), pa.field("score", pa.float64())]
            for i, (own, text) in enumerate(zip(batch.column("_ours").to_pylist(), batch.column("_theirs").to_pylist())):
                if len(codes) >= BATCH_TOKENS:
                    if coded:
                        yield answer(whole.slice(start, i - start), coded)
                    codes, asked = new_codes(), np.zeros(0, bool)
                    table.clear()
                    theirs, coded, start = None, [], i
                if theirs is None or text != last:
                    last, (theirs, near) = text, counted(text, codes)
                coded.append((counted(own, codes, near)[0], theirs))
            if coded:
                yield answer(whole.slice(start), coded)

    texts = _with_texts(pairs, hypothesis, reference, keep).withColumn("_batch", F.expr(f"monotonically_increasing_id() div {DEALT_ROWS}"))
    # Nothing is known of the parts of rows that come from no file.
    dealt = spread_small(texts, "_batch") if texts.inputFiles() else texts.repartition(texts.sparkSession.sparkContext.defaultParallelism, "_batch")
    return dealt.drop("_batch").mapInArrow(run, schema)


def matcher(vectors: DataFrame, max_rows: int = VECTOR_ROWS, keep: Sequence[str] | None = None):
    """A pair scorer over ``vectors`` (token string, vector array<float>), one row per token. A null vector is none.

    It adds ``score`` to pairs. The vectors are written to files. A table of proven small size goes to the workers; of a larger one every task
    reads what its pairs need. Texts and codes are not shuffled at all. With ``keep`` the pairs come back with these columns only. If these are
    without texts, the scores of a larger table are written down, so the texts are gone through once and are not sent along.
    """
    places, folder = write_vectors(vectors)
    rows, size, least, width = measure(places, F.min("width"), F.max("width"))
    if least != width:
        raise ValueError(f"vectors of {least} and of {width} numbers")
    fits = within_bounds(rows, size + 4 * rows * (width or 0), max_rows, VECTOR_BYTES)
    if fits:
        known = _collected(places, folder, width or 0)
    else:
        known = write_index(places, rows, folder, width)

    def score(
        pairs: DataFrame, pair_id: Sequence[str] = (), hypothesis: str = "paraphrase", reference: str = "original"
    ) -> DataFrame:
        pairs = pairs.drop("score")
        kept = pairs.columns if keep is None else list(keep)
        if fits:
            return score_by_broadcast(pairs, known, hypothesis, reference, kept)
        scored = score_by_files(pairs, known, hypothesis, reference, kept)
        if hypothesis not in kept and reference not in kept:
            scored = settle(scored, "scored-pairs", TEXT_ROWS)
        return scored.select(F.inline("_batch"))

    return score


def greedy_match_f1(
    pairs: DataFrame,
    vectors: DataFrame,
    pair_id: Sequence[str] = (),
    hypothesis: str = "paraphrase",
    reference: str = "original",
    max_rows: int = VECTOR_ROWS,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add ``score`` to the pairs."""
    return matcher(vectors, max_rows, keep)(pairs, pair_id, hypothesis, reference)
