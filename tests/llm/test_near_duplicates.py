import random

import numpy as np
import pytest

from evenkeel.llm import near_duplicates as nd
from evenkeel.llm.graph import components

SCHEMA = "doc_id long, text string, f string, component_id int, s string"


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def plain(rows, threshold=85):
    sets = [shingles(t) for _, t in rows]
    part = list(range(len(rows)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                part[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(d, least[r])
    return sorted((str(d), len(sets[i]), str(least[find(i)])) for i, (d, _) in enumerate(rows))


def found(spark, rows, **options):
    df = spark.createDataFrame([(d, t, "x", 1, "y") for d, t in rows], SCHEMA)
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in nd.near_duplicates(df, **options).collect())


def variants(seed=1):
    """Groups of texts around the threshold, chains, short texts and repeated rows."""
    rng = random.Random(seed)
    rows, words = [], [f"w{i}" for i in range(5000)]
    for group in range(12):
        base = [rng.choice(words) for _ in range(rng.choice((8, 40, 120)))]
        for _ in range(rng.choice((2, 5, 12))):
            for _ in range(rng.choice((0, 1, 1, 2))):
                base[rng.randrange(len(base))] = rng.choice(words)
            rows.append((rng.randrange(10_000), " ".join(base)))
    texts = [None, "", " \n\t", "a b", "A  b", "a b c d e", "a b c d e f", "x " * 40_000, "x " * 39_999]
    return rows + [(20_000 + i, t) for i, t in enumerate(texts)] + [rows[0], (None, rows[3][1]), (None, "alone on its own without an id")]


@pytest.mark.parametrize("block", [512, 2])
def test_equals_all_pairs(spark, block):
    rows = variants()
    assert found(spark, rows, block=block) == plain(rows)


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(5)
    base, rows = [f"b{i}" for i in range(60)], []
    for i in range(150):
        own = list(base)
        for _ in range(rng.choice((1, 1, 2))):
            own[rng.randrange(60)] = f"z{rng.randrange(10_000)}"
        rows.append((i, " ".join(own)))
    assert found(spark, rows, block=16) == plain(rows)


def test_empty_table_and_keeping_one(spark):
    assert found(spark, []) == []
    rows = [(3, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None), (4, ""), (None, "a b c d e f"), (None, "q r s t u"), (7, "q r s t u"), (7, "other words under that id"), (7, "q r s t u")]
    df = spark.createDataFrame([(d, t, "x", 1, "y") for d, t in rows], SCHEMA)
    kept = nd.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((str(r[0]), str(r[1])) for r in kept.collect()) == sorted([("1", "a b c d e f"), ("2", "None"), ("4", ""), ("7", "q r s t u"), ("7", "other words under that id")])


def test_sketches_estimate_high_similarities():
    sampler, rng = nd.Sampler(20, 5), np.random.default_rng(2)
    for similarity in (0.95, 0.85, 0.5):
        union = rng.integers(0, 1 << 63, 1000, np.uint64)
        apart = round(1000 * (1 - similarity) / 2)
        samples = np.stack([sampler.samples(union[: 1000 - apart]), sampler.samples(union[apart:])])
        a, b = sampler.sketches(samples).view(np.uint64)
        bits = int(np.bitwise_count(a ^ b).sum())
        assert abs(bits - nd.bits_for(similarity, 100)) < 40
        assert (bits <= nd.most_bits(0.85, 100)) == (similarity > 0.6)


def test_components(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(60)] + [(100, 100), (7, None)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    part = {}

    def find(x):
        while part.setdefault(x, x) != x:
            x = part[x]
        return x

    for a, b in pairs:
        if b is not None and a != b:
            x, y = find(a), find(b)
            part[max(x, y)] = min(x, y)
    df = spark.createDataFrame(pairs, "a long, b long")
    assert {r[0]: r[1] for r in components(df).collect()} == {x: find(x) for x in list(part)}
    assert components(df.limit(0)).count() == 0
