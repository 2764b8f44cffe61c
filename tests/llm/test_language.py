import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.llm import language
from evenkeel.llm.common import held_out, vocabulary_path

SF = "/root/testdata/sf0.01"


def all_cuts(word):
    for marks in itertools.product((False, True), repeat=len(word) - 1):
        at = [0, *(i + 1 for i, m in enumerate(marks) if m), len(word)]
        yield [word[a:b] for a, b in zip(at, at[1:])]


@pytest.fixture(scope="module")
def toy():
    pieces = language.Pieces([bytes([c]) for c in b" abc"] + [b"ab", b"bc", b" a", b"abc", b"ca"])
    p = np.random.default_rng(3).random((pieces.none + 1, 2))
    p[-1] = 0
    return pieces, p / p.sum(axis=0)


def test_forward_sums_all_segmentations(toy):
    pieces, p = toy
    ids = {w: i for i, w in enumerate(pieces.pieces)}
    words = [b" abca", b" bcab", b" aaaa"]
    log = language.forward(language.spans(words, pieces), p)[1]
    for k, word in enumerate(words):
        for lang in (0, 1):
            total = sum(math.prod(p[ids[c], lang] if c in ids else 0 for c in cut) for cut in all_cuts(word))
            assert log[k, lang] == pytest.approx(math.log(total))
    long = [b" " + b"abcab" * 9]
    assert np.isfinite(language.forward(language.spans(long, pieces), p * 1e-8)[1]).all()


def test_expected_counts_equal_a_plain_sum(toy):
    pieces, p = toy
    ids = {w: i for i, w in enumerate(pieces.pieces)}
    words, lang, counts = [b" abc", b" bca", b" abc"], np.array([0, 1, 1]), np.array([2.0, 1.0, 5.0])
    want = np.zeros(p.shape)
    for word, own, n in zip(words, lang, counts):
        cuts = [(c, math.prod(p[ids[x], own] if x in ids else 0 for x in c)) for c in all_cuts(word)]
        total = sum(w for _, w in cuts)
        for cut, w in cuts:
            for piece in cut if w else ():
                want[ids[piece], own] += n * w / total
    assert language.expected_counts(words, lang, counts, pieces, p) == pytest.approx(want)


def test_lookup_of_the_real_vocabulary():
    pieces = language.Pieces.load(language.vocabulary_path(language.VOCABULARY))
    ids = {w: i for i, w in enumerate(pieces.pieces)}
    words = [w for w in pieces.pieces if len(w) == 7][:300] + [b"zq#%zz9", b"abcdefg"]
    table = language.spans(words, pieces)
    for i, w in enumerate(words):
        for k in range(7):
            for a in range(7):
                assert table[k, a, i] == (ids.get(w[a : a + k + 1], pieces.none) if a + k < 7 else pieces.none)


def test_unseen_documents_are_recognised(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs.where(~held_out()), key=F.col("doc_id"))
    rows = language.predict(docs.where(held_out()).select("doc_id", "lang", "text"), model)
    right = rows.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97 and model.languages == ["de", "en", "es", "fr"]


def test_odd_texts(spark):
    schema = "doc_id long, text string, lang string, score string"
    train = spark.createDataFrame([(i, "the cat sat on the mat", "en", "") for i in range(3)] + [(9, "der hund und die katze", "de", ""), (10, None, "de", ""), (11, "x", None, "")], schema)
    model = language.fit(train)
    texts = [None, "", "12 3!", "the mat", "und die", "the " * 50_000, "z" * 5_000]
    rows = language.predict(spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], schema).drop("lang"), model).collect()
    found = {r["doc_id"]: r["lang_pred"] for r in rows}
    assert [found[i] for i in range(6)] == ["und", "und", "und", "en", "de", "en"] and found[6] in ("en", "de")
    assert all(0 <= r["score"] <= 1 for r in rows)
    empty = language.fit(train.limit(0))
    assert [r["lang_pred"] for r in language.predict(train, empty).collect()] == ["und"] * 6
    assert language.predict(train.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        language.fit(train, max_languages=1)


def test_rare_long_words_do_not_underflow():
    pieces = language.Pieces.load(vocabulary_path(language.VOCABULARY))
    common, rare = b" the", " \u1200\u1348\u1290".encode() + "\u1240\u1350".encode() * 7
    p = np.full((pieces.none + 1, 1), 1e-11)
    p[pieces.find(np.array([pieces.hashes[0]]))] = 0.5
    p[-1] = 0
    counts = language.expected_counts([common, rare], np.zeros(2, int), np.array([3e7, 1.0]), pieces, p)
    assert np.isfinite(counts).all() and counts.sum() > 3e7
    # With a vanishing probability for every piece the counts are still those of the likeliest cuts: every byte is used once.
    lengths = np.array([len(x) for x in pieces_of(pieces)])
    assert counts[:-1, 0] @ lengths == pytest.approx(3e7 * len(common) + len(rare))


def pieces_of(pieces):
    import base64

    with open(vocabulary_path(language.VOCABULARY), "rb") as lines:
        own = [base64.b64decode(line.split()[0]) for line in lines if line.strip()]
    return list(dict.fromkeys([*own, *(bytes([b]) for b in range(256))]))


def test_long_words_are_cut_between_characters():
    word = (" " + "\u4e2d\u56fd" * 100 + "a\U0001f600" * 30).encode()
    parts = list(language.character_parts(word))
    assert b"".join(parts) == word and max(map(len, parts)) <= language.WORD_BYTES
    assert all(part.decode() for part in parts)
