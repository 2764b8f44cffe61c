import math

import numpy as np
import pytest

from evenkeel.llm import embeddings as em

SCHEMA = "vec_id long, label int, embedding array<float>, f string, component_id string"


def plain(rows, threshold=0.98):
    ok = [r[1] is not None and r[2] is not None and len(r[2]) > 0 and all(x is not None and math.isfinite(x) for x in r[2]) and any(r[2]) for r in rows]
    part, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][1] == rows[j][1] and len(rows[i][2]) == len(rows[j][2]):
                a, b = np.float32(rows[i][2]).astype(float), np.float32(rows[j][2]).astype(float)
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    part[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), 1 << 60), r[0])
    return sorted((r[0], links[i], least[find(i)]) for i, r in enumerate(rows))


def found(spark, rows, **options):
    df = spark.createDataFrame([(a, b, c, "x", "y") for a, b, c in rows], SCHEMA)
    return sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in em.near_duplicates(df, **options).collect())


@pytest.mark.parametrize("block", [512, 8])
def test_equals_all_pairs(spark, block):
    rng, rows = np.random.default_rng(4), []
    for group in range(12):
        base = rng.standard_normal(16)
        for _ in range(int(rng.integers(1, 15))):
            rows.append((len(rows), group % 3, (base + rng.standard_normal(16) * rng.choice([0.02, 0.1, 0.2])).tolist()))
    base = rng.standard_normal(16).tolist()
    rows += [(1000 + i, 1, base) for i in range(40)] + [(1100 + i, 1, (np.array(base) * 3).tolist()) for i in range(3)]
    rows += [(1200, None, base), (1201, 2, base), (1202, 1, None), (1203, 1, []), (1204, 1, [0.0] * 16), (1205, 1, [float("nan")] * 16)]
    rows += [(1206, 1, [None] + base[1:]), (1207, 1, [float("inf")] + base[1:]), (1208, 1, base[:8]), (1209, 1, base[:8]), rows[0]]
    assert found(spark, rows, block=block) == plain(rows)


def test_empty_and_tiny_values(spark):
    assert found(spark, []) == []
    rows = [(1, 0, [1e-38, 0.0]), (2, 0, [3e38, 0.0]), (3, 0, [0.0, 1.0])]
    assert found(spark, rows) == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]


def test_tables_follow_from_the_rows():
    for rows in (10, 10**5, 10**9, 10**11):
        bits = em.key_bits(rows)
        tables = em.table_count(0.98, bits, 1e-6)
        assert (1 - em.same_sign(0.98) ** bits) ** tables <= 1e-6
