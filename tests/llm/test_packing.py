import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evenkeel.llm import packing
from evenkeel.llm.common import vocabulary_path
from evenkeel.llm.tokens import END, VOCABULARY, Encoder

SCHEMA = "doc_id long, text string, input_ids string"


@pytest.fixture(scope="module")
def encoder():
    return Encoder(vocabulary_path(VOCABULARY))


def restored(rows):
    parts = {}
    for row in rows:
        for doc, start, ids in packing.unpack(row):
            parts.setdefault(doc, []).append((start, ids.tolist()))
    return {doc: [i for _, ids in sorted(own) for i in ids] for doc, own in parts.items()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60), st.integers(50, 64))
def test_best_fit_equals_a_plain_search(lengths, capacity):
    lengths = np.array(lengths, np.int64)
    rows, used = packing.best_fit(lengths, capacity)
    assert (np.bincount(rows, lengths, minlength=used) <= capacity).all() if len(rows) else used == 0
    room = []
    for n in sorted(lengths.tolist(), reverse=True):
        fits = [i for i in range(len(room)) if room[i] >= n]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= n
        else:
            room.append(capacity - n)
    assert used == len(room)
    assert sorted(capacity - np.bincount(rows, lengths, minlength=used).astype(int)) == sorted(room) if used else True


def test_every_text_comes_back(spark, encoder):
    texts = ["", None, "one", "a b c " * 500, "é中\U0001f600 <|endoftext|>", " " * 3000, "one"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)
    rows = packing.pack(docs, row_tokens=64, block_tokens=100).collect()
    back = restored(rows)
    assert {d: encoder.text(ids[:-1]) for d, ids in back.items()} == {i: t or "" for i, t in enumerate(texts)}
    assert all(ids[-1] == END and END not in ids[:-1] for ids in back.values())
    assert len({(r["shard"], r["row"]) for r in rows}) == len(rows)
    for r in rows:
        bounds, positions = r["cu_seqlens"], np.frombuffer(r["position_ids"], "<u2")
        assert bounds[0] == 0 and bounds[-1] == r["n_tokens"] <= 64 and bounds == sorted(set(bounds))
        assert positions.tolist() == [k for a, b in zip(bounds, bounds[1:]) for k in range(b - a)] + [0] * (64 - r["n_tokens"])
        assert (np.frombuffer(r["input_ids"], "<u2")[r["n_tokens"] :] == END).all()


def test_repeated_rows_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a", ""), (1, "a", ""), (None, "b", "")], SCHEMA)
    rows = packing.pack(docs, row_tokens=8).collect()
    assert sorted((d or 0 for r in rows for d in r["doc_ids"])) == [0, 1, 1]
    assert packing.pack(docs.limit(0)).count() == 0


def test_large_vocabularies_use_wider_ids(spark):
    docs = spark.createDataFrame([(1, "a b", "")], SCHEMA)
    row = packing.pack(docs, row_tokens=8, end=70_000, pad=70_000).first()
    assert len(row["input_ids"]) == 32 and np.frombuffer(row["input_ids"], "<u4")[row["n_tokens"] - 1] == 70_000
