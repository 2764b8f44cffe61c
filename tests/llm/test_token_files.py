import numpy as np
import pytest

from evenkeel.llm import token_files
from evenkeel.llm.common import vocabulary_path
from evenkeel.llm.tokens import VOCABULARY, Encoder


def counted(spark, tmp_path, arrays, width=2, end=7, block_bytes=8):
    for name, ids in arrays.items():
        (tmp_path / name).write_bytes(np.array(ids, f"<u{width}").tobytes())
    files = token_files.list_token_files(spark, str(tmp_path))
    rows = token_files.count_tokens(files, end, width, block_bytes).collect()
    return sorted((r["path"].rpartition("/")[2], r["ordinal"], r["n_tokens"], r["ended"]) for r in rows)


def plain(arrays, end=7):
    out = []
    for name, ids in arrays.items():
        k = n = 0
        for x in ids:
            if x == end:
                out.append((name, k, n, True))
                k, n = k + 1, 0
            else:
                n += 1
        if n:
            out.append((name, k, n, False))
    return sorted(out)


@pytest.mark.parametrize("width, block_bytes", [(2, 2), (2, 7), (2, 8), (4, 12), (2, 1 << 20)])
def test_boundaries_anywhere(spark, tmp_path, width, block_bytes):
    rng = np.random.default_rng(1)
    arrays = {
        "a": rng.integers(6, 9, 60).tolist(),
        "b": [1] * 25 + [7] + [1] * 30,
        "c": [7, 7, 7],
        "d": [1, 2],
        "e": [],
        "f": rng.integers(0, 8, 41).tolist() + [7],
    }
    assert counted(spark, tmp_path, arrays, width, 7, block_bytes) == plain(arrays)


def test_counts_of_documents(spark):
    texts = ["", None, "one two", "é " * 3000, "one two"]
    docs = spark.createDataFrame([(i if i != 2 else None, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, path int")
    index = token_files.write_token_files(docs.repartition(2))
    files = index.groupBy("path").agg({"n_bytes": "max"}).withColumnRenamed("max(n_bytes)", "n_bytes")
    rows = index.join(token_files.count_tokens(files, block_bytes=100), ["path", "ordinal"]).collect()
    encoder = Encoder(vocabulary_path(VOCABULARY))
    found = {r["doc_id"]: r["n_tokens"] for r in rows}
    assert found == {i if i != 2 else None: len(encoder.ids((t or "").encode())) for i, t in enumerate(texts)}
    assert token_files.write_token_files(docs.limit(0)).count() == 0
    assert len(rows) == 5 and all(r["ended"] for r in rows)


def test_long_texts_have_the_ids_of_the_whole_text():
    import random

    from evenkeel.llm import tokens
    from evenkeel.llm.common import vocabulary_path

    rng, encoder = random.Random(8), tokens.Encoder(vocabulary_path(tokens.VOCABULARY))
    bits = ["word", " ", "  ", "\n", "\n\n ", "it's", "42", "1.5", "\u4e2d\u56fd", "\u0661\u0662", "!?", "\u00e9t\u00e9", "\t", "x'", "'ll", "\u2167", "\U0001f600"]
    for part in (1, 7, 50):
        for _ in range(40):
            text = "".join(rng.choices(bits, k=rng.randint(0, 200)))
            ends = tokens.cuts(text, part) if text else []
            pieces = [encoder.encoding.encode_ordinary(text[a:b]) for a, b in zip([0, *ends], ends)]
            assert sum(pieces, []) == encoder.encoding.encode_ordinary(text)
    long = "some words and 'more, 12.5 of them " * 9_000
    assert encoder.ids(long.encode()).tolist() == encoder.encoding.encode_ordinary(long)
