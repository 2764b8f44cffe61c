"""Benchmark decontamination by suffix arrays over the training texts.

Every task turns its documents, in blocks of bounded size, into a suffix array: the positions from which a match may start,
sorted by the words that follow. Every suffix of every benchmark item is then looked up by binary search, and the
range of positions that share a whole window of words with it gives all places where that window occurs. Places that
continue one another are put together to the longest verbatim match.

Words are lower-cased (A-Z only) runs of digits, Latin letters and non-ASCII characters. A window is ``window`` consecutive
words of an item; an item with fewer words, but not none, is one window as a whole. Only positions in runs of benchmark words
that are as long as the shortest window enter the array: no window can start anywhere else, so nothing is missed.

Windows with the same words are looked up once, whatever the number of their places. Only places where a match begins or
ends are paired, those whose neighbouring words differ on that side: a text that repeats a few words costs what it has of matches,
not places times occurrences.

Tasks turn the benchmark into blocks of at most ``block_words`` words (or one longer item), written to the shared folder. The documents pass
by one block after the other, map-only, and only that block is broadcast and in memory. With several blocks the matches of all but the last are
written under a hash of the text and joined to the last pass. Documents are never compared pairwise. Null texts and texts without words match
nothing; repeated items are reported once per item row; a null item id is the empty string; repeated documents are
reported as often as they occur; an empty benchmark or table matches nothing. Columns other than those named are not
used.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import LOWER_WORDS, list_rows, text_slices
from evenkeel.operators.joining import attach_settled
from evenkeel.workspace import fits_broadcast, settle

WINDOW = 10
BLOCK_WORDS = 1 << 20
#: Bytes of text that one suffix array covers.
ARRAY_BYTES = 4 << 20
#: Blocks that one task makes of the benchmark, about.
BLOCKS_PER_TASK = 8
#: The neighbour of an item's first or last word; equal to no word, known or not.
NO_WORD = -2

MATCHES = "array<struct<item_id:string,item_start:int,start:int,length:int>>"


class Items:
    """One block of the benchmark: word ids, and by length of window the distinct windows and their places."""

    def __init__(self, item_ids: list[str], texts: list[bytes], window: int):
        self.item_ids, self.ids = item_ids, {}
        words = [t.translate(LOWER_WORDS).split() for t in texts]
        coded = [np.array([self.ids.setdefault(w, len(self.ids)) for w in own], np.int32) for own in words]
        #: Length, distinct windows as rows of ids, and of every place: row, item, place in the item, word before, word after.
        self.windows: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for size in sorted({min(window, len(c)) for c in coded} - {0}):
            own = [i for i, c in enumerate(coded) if min(window, len(c)) == size and (size == window or len(c) == size)]
            item = np.concatenate([np.full(len(coded[i]) - size + 1, i) for i in own])
            place = np.concatenate([np.arange(len(coded[i]) - size + 1) for i in own])
            before = np.concatenate([np.append(NO_WORD, coded[i][: len(coded[i]) - size]) for i in own])
            after = np.concatenate([np.append(coded[i][size:], NO_WORD) for i in own])
            rows, which = np.unique(np.concatenate([np.lib.stride_tricks.sliding_window_view(coded[i], size) for i in own]), axis=0, return_inverse=True)
            self.windows.append((size, rows, which.reshape(-1), item, place, before, after))
        self.shortest = min((w[0] for w in self.windows), default=0)
        self.longest = max((w[0] for w in self.windows), default=0)

    def packed(self) -> bytes:
        return pickle.dumps(vars(self), protocol=5)

    @classmethod
    def unpacked(cls, content: bytes) -> Items:
        items = cls.__new__(cls)
        vars(items).update(pickle.loads(content))
        return items


def suffix_array(ids: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` sorted by the (non-negative) ids that follow; -1 ends a run. Order beyond ``depth`` ids is left open.

    Prefix doubling: ranks by 2k ids come from pairs of ranks by k ids.
    """
    rank, size = ids.astype(np.int64) + 1, 1
    while size < depth:
        later = np.zeros(len(rank), np.int64)
        later[:-size] = rank[size:]
        later[rank == 0] = 0
        both = rank * (int(rank.max(initial=0)) + 1) + later
        both[rank == 0] = 0
        values, rank = np.unique(both, return_inverse=True)
        rank = rank.astype(np.int64) + (0 if len(values) and values[0] == 0 else 1)
        size *= 2
    return starts[np.argsort(rank[starts], kind="stable")]


def bounds(ids: np.ndarray, array: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary search of all rows at once: first and end of the suffixes that begin with each row."""

    def search(after: bool) -> np.ndarray:
        low, high = np.zeros(len(rows), np.int64), np.full(len(rows), len(array), np.int64)
        while True:
            open_ = low < high
            if not open_.any():
                return low
            middle = (low + high) // 2
            at = array[np.minimum(middle, len(array) - 1)]
            order, ended = np.zeros(len(rows), np.int8), np.zeros(len(rows), bool)
            for k in range(rows.shape[1]):
                place = at + k
                here = np.where(place < len(ids), ids[np.minimum(place, len(ids) - 1)], -1)
                here[ended] = -1
                ended |= here < 0
                order = np.where(order == 0, np.sign(here - rows[:, k]), order)
            right = open_ & ((order < 0) | (after & (order == 0)))
            low = np.where(right, middle + 1, low)
            high = np.where(open_ & ~right, middle, high)

    return search(False), search(True)


def expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and the range each is from."""
    count = high - low
    which = np.repeat(np.arange(len(low)), count)
    return which, np.repeat(low - (np.cumsum(count) - count), count) + np.arange(len(which))


def differing(which: np.ndarray, word: np.ndarray, other_which: np.ndarray, other_word: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of an entry and another one with the same ``which`` but another word, without visiting pairs with the same word."""
    code = lambda group, w: group.astype(np.int64) * (words - NO_WORD) + (w - NO_WORD)
    codes = code(other_which, other_word)
    order = np.argsort(codes, kind="stable")
    codes, groups, own = codes[order], other_which[order], code(which, word)
    ranges = [
        (np.searchsorted(groups, which, "left"), np.searchsorted(codes, own, "left")),
        (np.searchsorted(codes, own, "right"), np.searchsorted(groups, which, "right")),
    ]
    pairs = [expand(low, high) for low, high in ranges]
    return np.concatenate([entry for entry, _ in pairs]), order[np.concatenate([other for _, other in pairs])]


def find(items: Items, ids: np.ndarray, document: np.ndarray, begin: np.ndarray) -> dict[str, np.ndarray]:
    """Longest verbatim matches: document, item, place in the item, place in the document, length; sorted by document.

    ``ids`` holds the documents' word ids one after the other, -1 for a word that no item has and after each document. A match begins
    where item and document have a window in common and different words before it, and ends at the next place on
    its diagonal where the words after the window differ.
    """
    known = np.concatenate([[False], ids >= 0, [False]])
    edge = np.diff(known.astype(np.int8))
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - first >= items.shortest
    first, end = first[long], end[long]
    # The runs that are long enough, copied together with one stop between them.
    size = end - first + 1
    origin = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
    runs = ids[np.minimum(origin, len(ids) - 1)] if len(ids) else ids
    stops = np.cumsum(size) - 1
    runs[stops] = -1
    left = np.repeat(stops, size) - np.arange(len(runs))
    array = suffix_array(runs, np.flatnonzero(left >= items.shortest), items.longest)
    starts, ends = [np.zeros((4, 0), np.int64)], [np.zeros((4, 0), np.int64)]
    for window, rows, which, item, place, before, after in items.windows if len(array) else []:
        row, at = expand(*bounds(runs, array, rows))
        at = array[at]
        for parts, word, neighbour in ((starts, before, np.where(at > 0, runs[at - 1], -1)), (ends, after, runs[np.minimum(at + window, len(runs) - 1)])):
            entry, other = differing(which, word, row, neighbour, len(items.ids))
            parts.append(np.stack([item[entry], place[entry], origin[at[other]], np.full(len(entry), window)]))

    def ordered(parts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        item, place, at, window = np.concatenate(parts, axis=1)
        doc = document[at] if len(document) else at
        order = np.lexsort((at, at - place, item, doc))
        return doc[order], item[order], place[order], at[order], window[order]

    doc, item, place, at, window = ordered(starts)
    last = ordered(ends)[3]  # on every diagonal a match ends before the next one begins
    return {"document": doc, "item": item, "item_start": place, "start": at - begin[doc] if len(begin) else at, "length": last - at + window}


def benchmark_blocks(benchmark: DataFrame, item_id: str, text: str, window: int, block_words: int) -> Iterator[Items]:
    """The items in blocks of bounded size that tasks make and write; the driver reads one at a time."""
    chosen = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item_id"), F.col(text).cast("string").alias("text")).where("text is not null")
    most = F.sum(F.floor(F.length("text") / 2) + 1)  # no text has more words
    parts = math.ceil((chosen.agg(most).first()[0] or 0) / (BLOCKS_PER_TASK * block_words))

    def run(batches):
        ids, texts, size = [], [], 0

        def block():
            return pa.RecordBatch.from_arrays([pa.array([Items(ids, texts, window).packed()], pa.binary())], ["content"])

        for batch in batches:
            for name, value in zip(batch.column("item_id"), batch.column("text").cast(pa.binary())):
                words = value.as_py().translate(LOWER_WORDS).split()
                if ids and size + len(words) > block_words:
                    yield block()
                    ids, texts, size = [], [], 0
                ids.append(name.as_py())
                texts.append(b" ".join(words))
                size += len(words)
        if ids:
            yield block()

    if not parts:
        return
    made = chosen.repartition(parts).mapInArrow(run, "content binary").withColumn("number", F.monotonically_increasing_id())
    made = settle(made, "benchmark-blocks")
    for row in made.select("number").sort("number").collect():
        yield Items.unpacked(made.where(F.col("number") == row["number"]).first()["content"])


def passed(rows: DataFrame, block: Items, text: str, kept: list[str], results: tuple[str, str], digest: str | None, matched_only: bool):
    """(broadcast, rows that have passed by one block): the kept columns, the number of words, the matches, and the text's hash if ``digest`` names it."""
    shared = rows.sparkSession.sparkContext.broadcast(block)
    kind = pa.struct([("item_id", pa.string()), ("item_start", pa.int32()), ("start", pa.int32()), ("length", pa.int32())])
    names = [*kept, *results, *([digest] if digest else [])]

    def run(batches):
        items = shared.value
        get = items.ids.get
        for batch in batches:
            for part, texts in text_slices(batch, text, ARRAY_BYTES):
                words = [(t or b"").translate(LOWER_WORDS).split() for t in texts]
                size = np.array([len(w) for w in words], np.int64)
                ids = np.fromiter((get(w, -1) for own in words for w in (*own, b"")), np.int32, int(size.sum()) + len(size))
                begin = np.cumsum(size + 1) - (size + 1)
                found = find(items, ids, np.repeat(np.arange(len(size)), size + 1), begin)
                values = pa.StructArray.from_arrays(
                    [pa.array(items.item_ids, pa.string()).take(pa.array(found["item"])), *(pa.array(found[c], pa.int32()) for c in ("item_start", "start", "length"))],
                    fields=list(kind),
                )
                number = np.bincount(found["document"], minlength=len(size))
                columns = [*(part.column(c) for c in kept), pa.array(size), list_rows(values, number)]
                if digest:
                    columns.append(pa.array([None if t is None else hashlib.sha256(t).digest() for t in texts], pa.binary()))
                out = pa.RecordBatch.from_arrays(columns, names)
                yield out.filter(pa.array(number > 0)) if matched_only else out

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema] if kept else []
    fields += [f"`{results[0]}` long", f"`{results[1]}` {MATCHES}", *([f"`{digest}` binary"] if digest else [])]
    return shared, rows.mapInArrow(run, ", ".join(fields))


def match(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    keep: tuple[str, ...] = (),
    results: tuple[str, str] = ("n_words", "matches"),
) -> DataFrame:
    """Per document: its id, the columns in ``keep``, ``n_words`` and ``matches`` (item, place there, place here, length, all in words).

    ``results`` are the names of the last two.
    """
    names = list(dict.fromkeys([doc_id, *keep]))
    free = "_" * (1 + max(map(len, [*names, *results])))  # no column has this name
    # A text that is kept anyway is not sent twice.
    own = text if text in names and dict(docs.dtypes)[text] == "string" else free
    rows = docs.select(*names, *([] if own == text else [F.col(text).cast("string").alias(own)]))
    blocks = benchmark_blocks(benchmark, item_id, item_text, window, block_words)
    block, earlier = next(blocks, None) or Items([], [], window), []
    while (following := next(blocks, None)) is not None:
        texts = docs.select(F.col(text).cast("string").alias("text")).where("text is not null")
        shared, found = passed(texts, block, "text", [], ("n", "matches"), "digest", True)
        earlier.append(settle(found.select("digest", "matches").dropDuplicates(["digest"]), "block-matches"))
        shared.destroy()
        block = following
    if not earlier:
        return passed(rows, block, own, names, results, None, False)[1]
    merged = earlier[0]
    for one in earlier[1:]:
        merged = merged.unionByName(one)
    # One row per block and text: a list is as long as the matches of one text.
    merged = settle(merged.groupBy(F.col("digest").alias(free)).agg(F.flatten(F.collect_list("matches")).alias(free + "m")), "earlier-matches")
    last, fits = passed(rows, block, own, names, results, free, False)[1], fits_broadcast(merged)
    joined = attach_settled(last if fits else settle(last, "last-matches"), merged, [free], "left", fits=fits)
    both = F.concat(F.coalesce(F.col(free + "m"), F.array().cast(MATCHES)), F.col(results[1]))
    return joined.select(*names, results[0], both.alias(results[1]))


def hit_words(matches: str = "matches") -> Column:
    """Number of words of a document that lie inside any match."""
    sorted_ = F.array_sort(F.transform(matches, lambda m: F.struct(m["start"].alias("a"), (m["start"] + m["length"]).alias("b"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    return F.aggregate(
        sorted_,
        start,
        lambda acc, m: F.struct(
            (acc["n"] + F.greatest(F.lit(0), m["b"] - F.greatest(m["a"], acc["to"]))).cast("long").alias("n"),
            F.greatest(acc["to"], m["b"]).alias("to"),
        ),
        lambda acc: acc["n"],
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents, with all their columns, in which no window of the benchmark occurs."""
    names = tuple(docs.columns)
    free = "_" * max(map(len, names))  # no column of theirs has these names
    matched = match(docs, benchmark, doc_id=text, text=text, keep=names, results=(free + "n", free + "m"), **options)
    return matched.where(F.size(free + "m") == 0).select(*names)
