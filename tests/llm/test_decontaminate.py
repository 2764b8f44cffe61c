import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.llm import decontaminate as dc

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, window=10):
    out = []
    for d, t in docs:
        own, hit, ids = words(t), set(), set()
        for item, text in items:
            w = words(text)
            size = min(window, len(w))
            for k in range(len(w) - size + 1) if size else ():
                for i in range(len(own) - size + 1):
                    if own[i : i + size] == w[k : k + size]:
                        hit.update(range(i, i + size))
                        ids.add(item or "")
        out.append((str(d), len(own), len(hit), tuple(sorted(ids))))
    return sorted(out)


def found(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, 1, "m") for i, t in docs], "doc_id long, text string, item_id int, matches string")
    b = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id string, text string, doc_id int")
    rows = dc.match(d, b, **options).select("doc_id", "n_words", dc.hit_words().alias("n_hit"), "matches").collect()
    for r in rows:  # every match is verbatim
        own, texts = words(dict(docs)[r["doc_id"]]) if len(dict(docs)) == len(docs) else None, dict(items)
        for m in r["matches"] if own is not None and len(texts) == len(items) else ():
            assert own[m["start"] : m["start"] + m["length"]] == words(texts[m["item_id"]])[m["item_start"] : m["item_start"] + m["length"]]
    return sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], tuple(sorted({m["item_id"] for m in r["matches"]}))) for r in rows)


def cases(seed=0):
    rng = random.Random(seed)
    few, many = [f"w{i}" for i in range(4)], [f"u{i}" for i in range(300)]
    items = [(f"i{k}", " ".join(rng.choice(few if k % 3 == 0 else many) for _ in range(rng.choice((2, 9, 10, 11, 30))))) for k in range(15)]
    items += [("one", "Ünique"), ("empty", "  "), ("none", None), ("signs", "--- !!!")]
    docs = []
    for d in range(40):
        parts = [rng.choice(few if d % 2 else many) for _ in range(60)]
        for _ in range(rng.choice((0, 1, 3))):
            own = words(rng.choice(items)[1])
            at, cut = rng.randrange(len(parts)), rng.choice((0, 0, 1, 2))
            parts[at:at] = own[cut:]
        docs.append((d, rng.choice((" ", ", ", "\n- ")).join(parts)))
    docs += [(100, None), (101, ""), (102, "Ünique"), (103, "ÜNIQUE ünique"), (104, "w1 " * 30_000)]
    return docs, items


def test_equals_brute_force(spark):
    docs, items = cases()
    assert found(spark, docs, items) == plain(docs, items)


def test_several_blocks_and_small_arrays(spark, monkeypatch):
    docs, items = cases(4)
    want = plain(docs, items)
    assert found(spark, docs, items, block_words=40) == want
    monkeypatch.setattr(dc, "ARRAY_BYTES", 200)
    assert found(spark, docs, items) == want


def test_repeats_nulls_and_empty_tables(spark):
    items = [("a", "x y z"), ("a", "x y z"), (None, "q r")]
    docs = [(1, "x y z q r"), (1, "x y z q r"), (None, "q r")]
    assert found(spark, docs, items) == plain(docs, items)
    assert found(spark, docs, []) == plain(docs, [])
    assert found(spark, [], items) == []


@pytest.mark.parametrize("block_words", [dc.BLOCK_WORDS, 3])
def test_removal_keeps_rows_whole(spark, block_words):
    d = spark.createDataFrame([(1, "a b c", "k"), (2, "c b a", None), (None, None, "n")], "doc_id long, text string, matches string")
    b = spark.createDataFrame([("i", "b c"), ("j", "z z z")], "item_id string, text string")
    kept = dc.remove_contaminated(d, b, block_words=block_words)
    assert kept.columns == d.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, d.where("doc_id is null or doc_id = 2").collect()))


def test_suffixes_are_sorted():
    ids = np.random.default_rng(1).integers(0, 3, 400).astype(np.int32)
    ids[::37] = -1
    starts = np.flatnonzero(ids >= 0)
    array = dc.suffix_array(ids, starts, 400)

    def tail(i):
        end = np.flatnonzero(ids[i:] < 0)
        return ids[i : i + end[0] if len(end) else None].tolist()

    assert [tail(i) for i in array] == sorted(tail(i) for i in starts)


def test_longest_matches(spark):
    d = spark.createDataFrame([(1, "p q " + " ".join(f"w{i}" for i in range(25)) + " r")], "doc_id long, text string")
    b = spark.createDataFrame([("i", "start " + " ".join(f"w{i}" for i in range(20)))], "item_id string, text string")
    (m,) = dc.match(d, b).select(F.explode("matches").alias("m")).select("m.*").collect()
    assert (m["item_start"], m["start"], m["length"]) == (1, 2, 20)


def plain_matches(docs, items, window=10):
    """All longest matches: runs on a diagonal that hold a window and cannot be made longer."""
    out = []
    for d, t in docs:
        own = words(t)
        for item, text in items:
            w = words(text)
            size = min(window, len(w))
            for p in range(len(w) if size else 0):
                for s in range(len(own)):
                    if size < window and own[s : s + size] == w and p == 0:
                        out.append((str(d), item, 0, s, size))
                    elif size == window and not (p and s and w[p - 1] == own[s - 1]):
                        n = 0
                        while p + n < len(w) and s + n < len(own) and w[p + n] == own[s + n]:
                            n += 1
                        if n >= size:
                            out.append((str(d), item, p, s, n))
    return sorted(out)


@pytest.mark.parametrize("block_words", [dc.BLOCK_WORDS, 25])
def test_longest_matches_equal_brute_force(spark, block_words):
    rng = random.Random(7)
    items = [(f"i{k}", " ".join(rng.choice("ab") for _ in range(rng.choice((1, 3, 10, 14, 40))))) for k in range(8)]
    items += [("same", "a " * 25), ("turns", "a b " * 12)]
    docs = [(k, " ".join(rng.choice("ab" if k % 2 else "abc") for _ in range(90))) for k in range(6)] + [(7, "a " * 60), (8, "b a " * 30), (9, "a " * 9)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id string, text string")
    rows = dc.match(d, b, block_words=block_words).select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*").collect()
    assert sorted((str(r["doc_id"]), *r[1:]) for r in rows) == plain_matches(docs, items)


def test_repeated_words_cost_what_they_match():
    """An item of 5,000 equal words against a text of 20,000: as many matches as diagonals, in little memory."""
    items = dc.Items(["same"], [b"a " * 5_000], dc.WINDOW)
    ids = np.append(np.zeros(20_000, np.int32), -1).astype(np.int32)
    tracemalloc.start()
    found = dc.find(items, ids, np.zeros(len(ids), np.int64), np.zeros(1, np.int64))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found["length"]) == 20_000 + 5_000 - 2 * dc.WINDOW + 1
    assert found["length"].max() == 5_000 and found["length"].min() == dc.WINDOW
    assert peak < 40 << 20


def test_blocks_are_bounded_and_read_one_by_one(spark):
    benchmark = spark.createDataFrame([(f"i{k}", f"u{k} v{k} w{k} " * 4) for k in range(50)] + [("long", "x " * 100)], "item_id string, text string")
    blocks = dc.benchmark_blocks(benchmark, "item_id", "text", dc.WINDOW, 30)
    assert iter(blocks) is blocks  # the driver holds none but the one it asks for
    sizes = [(len(b.item_ids), sum(len(w[2]) for w in b.windows)) for b in blocks]
    assert sum(n for n, _ in sizes) == 51 and max(n for n, _ in sizes) == 2


def test_earlier_matches_beyond_the_broadcast_bound(spark, monkeypatch):
    docs, items = cases(9)
    monkeypatch.setattr(dc, "fits_broadcast", lambda settled: False)
    assert found(spark, docs, items, block_words=60) == plain(docs, items)


def test_a_kept_column_may_have_any_name(spark):
    d = spark.createDataFrame([(1, "b c", "k")], "doc_id long, text string, _text string")
    b = spark.createDataFrame([("i", "b c"), ("j", "q r")], "item_id string, text string")
    for block_words in (dc.BLOCK_WORDS, 2):
        (row,) = dc.match(d, b, keep=("_text",), block_words=block_words).collect()
        assert row["_text"] == "k" and len(row["matches"]) == 1
