"""Every number, word and pattern here must be as it is for results to be right."""

from __future__ import annotations

# Experiment settings.
TRAIN_RATIO = 0.8
VALIDATION_FRACTION = 0.1
SEED = 42
MAX_LENGTH = 256

# Paraphrase filters and the pass limit.
MIN_LENGTH_RATIO = 0.25
MIN_WORD_OVERLAP = 0.10
SCORE_THRESHOLD = 0.85
MAX_PASSES = 15

# Prompt text and token budget: context window less new tokens less a margin.
PROMPT_PREFIX = (
    "<|turn>user\nParaphrase the following review while preserving its "
    "sentiment and meaning. Provide only the paraphrased text.\n"
    'Review: "'
)
PROMPT_SUFFIX = '"<turn|>\n<|turn>model\n'
MAX_INPUT_TOKENS = 4096 - 256 - 10

# Words that carry no content.
STOP_WORDS = [
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for",
    "of", "with", "by", "from", "is", "was", "are", "were", "be", "been",
    "being", "have", "has", "had", "do", "does", "did", "will", "would",
    "could", "should", "may", "might", "shall", "can", "that", "this",
    "these", "those", "it", "its", "i", "me", "my", "we", "our", "you",
    "your", "he", "she", "his", "her", "they", "their", "them", "what",
    "which", "who", "not", "no", "so", "if", "as", "up", "out", "about",
    "into", "than", "then", "just", "also", "more", "very", "only", "s",
]

# Unicode white space (the characters that Python's str.split() splits on). The \x{..} form is read the
# same way by Java and by RE2, so one pattern serves the Spark expression and the SQL check.
SPACE_CLASS = (
    r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

# The same characters as one string.
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

# Line breaks besides \n, \r\n and \r that Python's str.splitlines() knows.
EXTRA_LINE_BREAKS = r"[\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"

# A generation ends at the first of these: the turn marker or a blank line.
STOP_PATTERN = r"<turn\|>|\n\n"
STOP_MARKS = ("<turn|>", "\n\n")

# The mteval-v13a tokenisation rules used by the standard BLEU implementations, in order.
BLEU_REPLACEMENTS = [("<skipped>", ""), ("-\n", ""), ("\n", " ")]
BLEU_ENTITIES = [("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]
BLEU_RULES = [
    (r"([{-~\[-` -&(-+:-@/])", r" $1 "),
    (r"([^0-9])([.,])", r"$1 $2 "),
    (r"([.,])([^0-9])", r" $1 $2"),
    (r"([0-9])(-)", r"$1 $2 "),
]
BLEU_ORDER = 4
