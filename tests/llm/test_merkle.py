import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from evenkeel.llm import merkle
from evenkeel.llm.queries import LLM_QUERIES, LLM_SQL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string"


def H(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climb(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """Root of the nodes, and for each its (before, after) siblings from the bottom up."""
    ways, owners, level = [[] for _ in nodes], [[i] for i in range(len(nodes))], nodes
    while len(level) > 1:
        parents, heirs = [], []
        for start in range(0, len(level), 16):
            run = level[start : start + 16]
            for k in range(len(run)):
                for leaf in owners[start + k]:
                    ways[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
            parents.append(H("".join(run)))
            heirs.append(sum(owners[start : start + 16], []))
        level, owners = parents, heirs
    return level[0], ways


def plain(rows) -> list[tuple]:
    """The query's rows for tuples (doc_id, text, lang, source, n_chars)."""

    def leaf(row, text):
        return H("".join(map(field, (row[0], row[3], row[2], row[4], text))))

    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    out, subroots, ways = [], [], []
    for source in sources:
        own = sorted(((r, leaf(r, r[1])) for r in rows if r[3] == source), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        top, way = climb([d for _, d in own])
        subroots.append(top)
        ways.append(list(zip(own, way)))
    root, upper = climb(subroots)
    for subroot, own, above in zip(subroots, ways, upper):
        for (row, digest), way in own:
            text, path = row[1], way + above
            if text is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = leaf(row, text)
            for before, after in path:
                folded = H(before + folded + after)
            out.append((row[0], digest, subroot, root, H("".join(b + a for b, a in path)), folded, folded == root))
    return out


def run(spark, tmp_path, rows):
    data = [(*r, "clash") for r in rows]
    spark.createDataFrame(data, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return [tuple(r) for r in LLM_QUERIES["op11_merkle"](spark, str(tmp_path)).collect()]


def key(row):
    return tuple(map(str, row))


@pytest.mark.parametrize("sizes", [[1], [16], [1, 2, 17], [300, 1] + [1] * 20])
def test_proofs_equal_a_plain_tree(spark, tmp_path, sizes):
    rows, doc = [], 0
    for s, size in enumerate(sizes):
        for _ in range(size):
            doc += 1
            rows.append((doc * 7 % 1009, f"Text ÄB {doc}", "de", f"s{s}", doc))
    assert sorted(run(spark, tmp_path, rows), key=key) == sorted(plain(rows), key=key)


def test_nulls_empty_texts_repeats_and_ties(spark, tmp_path):
    rows = [(None, "A", None, None, None), (5, None, "en", None, 3), (5, "", "en", "", 0), (6, "LONG " * 50_000, "en", "é", 9)]
    rows += [(7, "Same", "en", "z", 4)] * 40 + [(7, "Other", "en", "z", 4)] * 2 + [(-3, "x", "fr", "Z", 1)]
    assert sorted(run(spark, tmp_path, rows), key=key) == sorted(plain(rows), key=key)


def test_sql_handles_the_same_cases(spark, tmp_path):
    rows = [(None, "A", None, None, None), (5, None, "en", None, 3), (15, "", "en", "", 0)] + [(i, f"T {i}", "en", "a", i) for i in range(40)]
    ours = run(spark, tmp_path, rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    theirs = con.execute(LLM_SQL["op11_merkle"]).fetchall()
    assert sorted(ours, key=key) == sorted(theirs, key=key)
    assert sum(not r[-1] for r in ours) > 0


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert LLM_QUERIES["op11_merkle"](spark, str(tmp_path)).collect() == []


def test_some_requests_with_another_fan_out(spark):
    leaves = spark.range(200).select(
        F.when(F.col("id") < 150, "a").otherwise("b").alias("source"), F.col("id").alias("doc_id"), merkle.leaf_digest(F.col("id")).alias("digest")
    )
    dag = merkle.build(leaves, ["doc_id"], fan_out=3)
    proved = merkle.prove(dag, dag.requests.where("doc_id in (0, 77, 149, 150, 199)").drop("digest"))
    found = proved.select("doc_id", merkle.hex_text(F.col("digest")), merkle.fold(merkle.hex_text(F.col("digest")), F.col("segments"))).collect()
    assert {r[0] for r in found} == {0, 77, 149, 150, 199}
    assert all(r[1] == H(field(r[0])) and r[2] == dag.root for r in found)


def test_records_are_found_by_their_content(spark):
    leaves = spark.range(100).select(F.lit("a").alias("source"), F.col("id").alias("doc_id"), merkle.leaf_digest(F.col("id")).alias("digest"))
    store = merkle.build(leaves, ["doc_id"]).store
    assert store.where(F.col("digest") != merkle.digest_of(F.col("children"))).count() == 0
    assert store.count() == store.select("digest").distinct().count() == 8
