"""Text expressions: tokens, paraphrase checks, prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evenkeel.constants import (
    BLEU_ENTITIES,
    BLEU_REPLACEMENTS,
    BLEU_RULES,
    MAX_INPUT_TOKENS,
    MIN_LENGTH_RATIO,
    MIN_WORD_OVERLAP,
    PROMPT_PREFIX,
    PROMPT_SUFFIX,
    STOP_MARKS,
    STOP_WORDS,
    WHITE_SPACE,
)

# ``SPACE_CLASS`` as Java tests it fastest: a table for the first 256 characters, and one range test that rules out nearly all others.
LOW_SPACE = r"\t\n\x{0b}\f\r\x{1c}\x{1d}\x{1e}\x{1f}\x{85}\x{a0}"
HIGH_SPACE = r"[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]"
SPACE = rf"[{LOW_SPACE}\x{{20}}{HIGH_SPACE}]"
# The same without the blank.
OTHER_SPACE = f"[{LOW_SPACE}{HIGH_SPACE}]"


def split_words(text: Column) -> Column:
    """Words between runs of Unicode white space, case kept, none of them empty."""
    return F.array_remove(F.split(text, SPACE + "+"), "")


def joined_words(text: Column) -> Column:
    """The words of ``split_words`` with one blank between them: the same tokens without an array."""
    # A single blank, which is most white space, is left as it is instead of being replaced by itself.
    return F.trim(F.regexp_replace(text, rf"{OTHER_SPACE}{SPACE}*|\x{{20}}{SPACE}+", " "))


def joined_tokens(text: Column) -> Column:
    """The tokens of ``ws_tokens`` with one blank between them."""
    return joined_words(F.lower(text))


def ws_tokens(text: Column) -> Column:
    return split_words(F.lower(text))


def content_of(tokens: Column) -> Column:
    """Set of the tokens that are no stop words and longer than one character."""
    stop = F.expr("array('" + "', '".join(STOP_WORDS) + "')")
    return F.filter(F.array_except(tokens, stop), lambda w: F.char_length(w) > 1)


def content_words(text: Column) -> Column:
    return content_of(ws_tokens(text))


def length_ratio(tokens: Column, original_tokens: Column) -> Column:
    """Token count of the paraphrase over that of the original; null for an original without tokens."""
    return F.try_divide(F.size(tokens), F.size(original_tokens))


def content_overlap(words: Column, original_words: Column) -> Column:
    """Share of the original's content words that the paraphrase keeps; null when there are none."""
    return F.try_divide(F.size(F.array_intersect(words, original_words)), F.size(original_words))


def is_valid_from(ratio: Column, overlap: Column) -> Column:
    """Length test, then content test. An original with nothing to compare accepts any paraphrase."""
    return (
        F.when(ratio.isNull(), True)
        .when(ratio < MIN_LENGTH_RATIO, False)
        .when(overlap.isNull(), True)
        .otherwise(overlap >= MIN_WORD_OVERLAP)
    )


def is_valid_paraphrase(paraphrase: Column, original: Column) -> Column:
    """``is_valid_from`` on two texts. ``mark_valid`` does the same and splits each text only once."""
    ours, theirs = ws_tokens(paraphrase), ws_tokens(original)
    return is_valid_from(length_ratio(ours, theirs), content_overlap(content_of(ours), content_of(theirs)))


def prompt_budget() -> int:
    """Tokens left for the text, counting prefix and suffix in white-space tokens."""
    return MAX_INPUT_TOKENS - len(PROMPT_PREFIX.split()) - len(PROMPT_SUFFIX.split())


def wrap_prompt(text: Column, prefix: str = PROMPT_PREFIX, suffix: str = PROMPT_SUFFIX) -> Column:
    return F.concat(F.lit(prefix), text, F.lit(suffix))


def build_prompt(
    text: Column, prefix: str = PROMPT_PREFIX, suffix: str = PROMPT_SUFFIX, budget: int | None = None
) -> Column:
    """Prompt around the text. Only a text over the token budget is cut, and then re-joined by spaces."""
    budget = prompt_budget() if budget is None else budget
    words = split_words(text)
    fitted = F.when(F.size(words) > budget, F.array_join(F.slice(words, 1, budget), " ")).otherwise(text)
    return wrap_prompt(fitted, prefix, suffix)


def strip_space(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def clean_generation(output: Column) -> Column:
    """Generated text up to its first stop string, without outer white space."""
    for mark in STOP_MARKS:
        output = F.substring_index(output, mark, 1)
    return strip_space(output)


def bleu_tokens(text: Column) -> Column:
    """Case-sensitive tokens by the mteval-v13a rules, punctuation split off."""
    for old, new in BLEU_REPLACEMENTS + BLEU_ENTITIES:
        text = F.replace(text, F.lit(old), F.lit(new))
    for pattern, template in BLEU_RULES:
        text = F.regexp_replace(text, pattern, template)
    return split_words(text)
