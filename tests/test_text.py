import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evenkeel.functions import text as txt
from evenkeel.operators.hooks import cut_prompt, tokenizer_hook
from evenkeel.operators.quality import keep_valid, paraphrase_features


def evaluate(spark, values, expression):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, t string").select("i", expression(F.col("t")).alias("out"))
    return [r.out for r in df.orderBy("i").collect()]


def test_unicode_spaces_split_like_python(spark):
    samples = ["a b\u001cc d\u0085e f", "  A  B\tc\n", "", " 　 ", "x​y", " q r s"]
    assert evaluate(spark, samples, txt.ws_tokens) == [s.lower().split() for s in samples]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", exclude_categories=["Cs", "Lu", "Lt"])), min_size=30))
def test_words_equal_python_split(spark, samples):
    samples = [s.replace("\x00", "") for s in samples]
    assert evaluate(spark, samples, txt.split_words) == [s.split() for s in samples]


def test_content_words_keep_punctuation_and_drop_stop_words(spark):
    out = evaluate(spark, ["The cat, the CAT and a x dog. dog."], txt.content_words)
    assert sorted(out[0]) == ["cat", "cat,", "dog."]


ORIGINAL_TEN = "red blue green pink gold teal gray lime navy plum"


@pytest.mark.parametrize(
    "original, paraphrase, valid",
    [
        ("", "anything", True),
        ("  ", "", True),
        ("the of and", "other words here", True),
        ("the of and it", "", False),
        ("one1 two2 three3 four4 five5 six6 seven7 eight8", "one1 two2", True),
        ("one1 two2 three3 four4 five5 six6 seven7 eight8", "one1", False),
        (ORIGINAL_TEN, "red other words here", True),
        (ORIGINAL_TEN, "some other words here", False),
        ("Good Album", "good ALBUM", True),
    ],
)
def test_validity_edges(spark, original, paraphrase, valid):
    pairs = spark.createDataFrame([(original, paraphrase)], "original string, paraphrase string")
    row = paraphrase_features(pairs).first()
    assert row.is_valid is valid
    direct = pairs.select(txt.is_valid_paraphrase(F.col("paraphrase"), F.col("original")).alias("v")).first()
    assert direct.v is valid
    assert keep_valid(pairs).count() == int(valid)


def test_prompt_is_cut_only_over_budget(spark):
    short, long = "Two  words\there", " ".join(f"w{i}" for i in range(txt.prompt_budget() + 5))
    out = evaluate(spark, [short, long], txt.build_prompt)
    assert short in out[0]
    assert f"w{txt.prompt_budget() - 1}\"" in out[1] and f"w{txt.prompt_budget()} " not in out[1]


def test_prompt_with_a_subword_tokenizer(spark):
    def load():
        return lambda texts: [[ord(c) for c in t] for t in texts], lambda rows: ["".join(map(chr, ids)) for ids in rows]

    room = len(txt.PROMPT_PREFIX) + len(txt.PROMPT_SUFFIX) + 4
    out = evaluate(spark, ["abcdef", "abc", None], cut_prompt(load, room))
    assert out[0] == txt.PROMPT_PREFIX + "abcd" + txt.PROMPT_SUFFIX
    assert out[1] == txt.PROMPT_PREFIX + "abc" + txt.PROMPT_SUFFIX
    assert out[2] == txt.PROMPT_PREFIX + txt.PROMPT_SUFFIX
    assert evaluate(spark, ["ab", None], tokenizer_hook(lambda: load()[0])) == [[97, 98], []]


def test_generation_ends_at_the_first_stop_string(spark):
    raw = ["  a b <turn|> c", "first\n\nsecond<turn|>", "one\nline ", "<turn|>x", "  t 　"]
    assert evaluate(spark, raw, txt.clean_generation) == ["a b", "first", "one\nline", "", "t"]


def test_bleu_tokens_split_punctuation(spark):
    samples = ["Hello, world.", "It costs 3.50, or 1,000-2 (ok)!", 'say &quot;hi&quot; &amp; go', "word-\nbreak"]
    assert evaluate(spark, samples, txt.bleu_tokens) == [
        ["Hello", ",", "world", "."],
        ["It", "costs", "3.50", ",", "or", "1,000", "-", "2", "(", "ok", ")", "!"],
        ["say", '"', "hi", '"', "&", "go"],
        ["wordbreak"],
    ]


def test_cheap_space_tests_equal_the_whole_class(spark):
    import re

    from evenkeel.constants import SPACE_CLASS, STOP_MARKS, STOP_PATTERN, WHITE_SPACE

    pattern = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", SPACE_CLASS))
    assert set(WHITE_SPACE) == {chr(c) for c in range(0xD800) if pattern.match(chr(c))} and re.split(STOP_PATTERN, "a".join(STOP_MARKS)) == ["", "a", ""]
    samples = [f"{chr(c)}a{chr(c)}b {chr(c)}c{chr(c)} {chr(c)}" for c in [*range(1, 0x180), *range(0x1670, 0x1690), *range(0x1FF0, 0x2070), *range(0x2FF0, 0x3010)]]
    assert evaluate(spark, samples, txt.split_words) == [s.split() for s in samples]
    assert evaluate(spark, samples, txt.joined_words) == [" ".join(s.split()) for s in samples]
    assert evaluate(spark, samples, txt.strip_space) == [s.strip() for s in samples]
    raw = ["\n\n<turn|>a", "a <turn|>b\n\nc", " a\n\nb<turn|>c", "<turn|", " \n", None]
    assert evaluate(spark, raw, txt.clean_generation) == [None if r is None else re.split(STOP_PATTERN, r)[0].strip() for r in raw]
    # Patterns over whole texts took most of the time of the queries on generated texts.
    plan = spark.range(1).select(txt.clean_generation(F.concat("id", F.lit(""))))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and "split(" not in plan
