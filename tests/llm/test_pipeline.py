"""The stages on a small corpus, each against what it must do."""

import random

import numpy as np
import pytest

import corpus_pipeline
from evenkeel.llm import packing
from evenkeel.llm.common import vocabulary_path
from evenkeel.llm.queries import LLM_QUERIES, LLM_SQL
from evenkeel.llm.tokens import VOCABULARY, Encoder

SF = "/root/testdata/sf0.001"


def test_stages_are_in_order_and_return_documents(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "mix", "pack"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns
        rows = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert all(rows[r["doc_id"]] == r["text"] for r in after.collect())
        docs = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    encoder = Encoder(vocabulary_path(VOCABULARY))
    tokens = sum(len(encoder.ids(r["text"].encode())) + 1 for r in docs.collect())
    assert sum(r["n_tokens"] for r in packed) == tokens


def test_planted_cases(tmp_path, spark):
    rng = random.Random(1)
    words = [f"word{i}" for i in range(3000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, marks = [], []
    for i in range(300):
        bad = i % 4 == 0
        body = " ".join(w.upper() + "!!" for w in text(120).split()) if bad else text(120)
        rows.append((i, body, "en", "s", len(body)))
        marks.append((i, 0 if bad else 1, 0))
    clean = [r for r in rows if marks[r[0]][1]]
    for k in range(20):  # near copies of clean documents
        own = clean[k][1].split()
        own[rng.randrange(len(own))] = "changed"
        rows.append((1000 + k, " ".join(own), "en", "s", 0))
    passage = text(25)
    rows += [(2000 + k, text(30) + " " + passage + " " + text(30), "en", "s", 0) for k in range(5)]
    rows += [(3000, None, None, None, None)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([("b", passage)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {d for r in out for d in r["doc_ids"]}
    assert ids <= {r[0] for r in clean} | {3000} and len(ids) >= 0.95 * len(clean)
    assert all(len(np.frombuffer(r["input_ids"], "<u2")) == packing.ROW_TOKENS for r in out)


@pytest.mark.parametrize("n", range(1, 11))
def test_every_operator_is_registered(n):
    assert len([q for q in LLM_QUERIES if q.startswith(f"op{n}_")]) == 1
    assert set(LLM_SQL) <= set(LLM_QUERIES)
