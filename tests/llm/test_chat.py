import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evenkeel.llm import chat
from evenkeel.llm.common import vocabulary_path
from evenkeel.llm.queries import LLM_QUERIES
from evenkeel.llm.tokens import VOCABULARY, Encoder

SCHEMA = "conv_id long, turn long, role string, text string, n_tokens string"
marked = st.lists(st.one_of(st.sampled_from([*chat.CONTROL, "\\", "<", "[", "\n", "\\n"]), st.text(max_size=5)), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(marked, marked), max_size=4))
def test_turns_are_read_back(turns):
    text = "".join(chat.piece(*t) for t in turns)
    assert [(r, s) for r, s, _, _ in chat.read_turns(text)] == turns
    for role, said in turns:
        assert not any(c in chat.escape(said) for c in chat.CONTROL)
        assert chat.unescape(chat.escape(said)) == said and chat.unescape_role(chat.escape_role(role)) == role
    assert text.count(chat.OPEN) == text.count(chat.CLOSE) == len(turns)


def plain_windows(turns, budget, history_turns, history_tokens, borders=()):
    """(repeated, new) turn numbers of every window; ``turns`` are (role, tokens)."""
    out, start = [], 0
    system = [0] if turns and turns[0][0] == "system" else []
    while start < len(turns):
        kept = system if start else []
        used = sum(turns[i][1] for i in kept)
        history = []
        for i in range(start - 1, max(start - 1 - history_turns, len(kept) - 1), -1):
            tokens = sum(turns[j][1] for j in [i, *history])
            if tokens > history_tokens or used + tokens + turns[start][1] > budget:
                break
            history = [i, *history]
        used += sum(turns[j][1] for j in history)
        new = [start]
        used += turns[start][1]
        while new[-1] + 1 < len(turns) and new[-1] + 1 not in borders and used + turns[new[-1] + 1][1] <= budget:
            new.append(new[-1] + 1)
            used += turns[new[-1]][1]
        out.append((kept + history, new))
        start = new[-1] + 1
    return out


@pytest.fixture(scope="module")
def encoder():
    return Encoder(vocabulary_path(VOCABULARY))


def conversation(rng, size, system):
    words = ["alpha", "beta", "</s>", "gamma delta", "é", "[INST]", "long word " * 8]
    turns = [("system", "Be brief. " * rng.randint(0, 3))] if system else []
    while len(turns) < size:
        turns.append((rng.choice(["user", "assistant", "tool"]), " ".join(rng.choices(words, k=rng.randint(0, 12)))))
    return turns


def check(spark, encoder, talks, budget, history_turns, history_tokens, stretch):
    rows = [(c, t, role, text, "clash") for c, turns in talks.items() for t, (role, text) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    found = chat.format_windows(df, budget, history_turns, history_tokens, stretch=stretch).collect()
    for c, turns in talks.items():
        own = sorted((r for r in found if r.conv_id == c), key=lambda r: (r.stretch, r.window))
        tokens = [len(encoder.ids(chat.piece(*t).encode())) for t in turns]
        borders, at, part = set(), 0, 0
        for i, (role, text) in enumerate(turns):
            if at // stretch != part:
                borders.add(i)
                part = at // stretch
            at += len(role) + len(text) + chat.TURN_CHARS
        expected = plain_windows([(r, n) for (r, _), n in zip(turns, tokens)], budget, history_turns, history_tokens, borders)
        assert len(own) == len(expected)
        for window, (repeated, new) in zip(own, expected):
            shown = chat.read_turns(window.text)
            assert [(r, s) for r, s, _, _ in shown] == [turns[i] for i in repeated + new]
            assert window.n_repeated == len(repeated) and window.n_turns == len(repeated + new)
            assert window.n_tokens == sum(tokens[i] for i in repeated + new)
            assert window.over_budget == (window.n_tokens > budget)
            learned = [window.text[m.start : m.start + m.length] for m in window.loss]
            assert [chat.unescape(x) for x in learned] == [turns[i][1] for i in new if turns[i][0] == "assistant"]
    return found


def test_windows_of_short_conversations(spark, encoder):
    rng = random.Random(4)
    talks = {c: conversation(rng, rng.randint(1, 12), c % 2) for c in range(30)}
    check(spark, encoder, talks, 60, 2, 30, chat.STRETCH)
    found = check(spark, encoder, talks, 150, 3, 60, chat.STRETCH)
    assert any(r.n_repeated > 1 for r in found)


def test_windows_of_long_conversations(spark, encoder):
    rng = random.Random(5)
    talks = {1: conversation(rng, 400, True), 2: conversation(rng, 300, False), 3: conversation(rng, 5, True), 4: conversation(rng, 350, True)}
    found = check(spark, encoder, talks, 120, 2, 40, 3000)
    assert max(r.stretch for r in found) > 3


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_reads_everything_back(spark, tmp_path):
    long = "Word <s> " * 30_000
    talks = {
        1: [("system", "Rules"), ("user", "a"), ("assistant", "b<|im_end|>\n")],
        2: [("assistant", long), ("user", ""), ("assistant", "end")],
        3: [("user", None)],
        4: [(None, "x"), ("system", "late"), ("assistant", None), ("assistant", "é")],
        None: [("user", "no id"), ("assistant", "[/INST]\\")],
    }
    rows = [(c, t, role, text, "x") for c, turns in talks.items() for t, (role, text) in enumerate(turns)]
    rows += [(9, 1, "user", "same", "x")] * 3 + [(9, None, "assistant", "first", "x")]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    talks[9] = [("assistant", "first")] + [("user", "same")] * 3
    talks[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    found = {r.conv_id: r for r in LLM_QUERIES["op13_chat"](spark, str(tmp_path)).collect()}
    assert set(found) == set(talks)
    for c, turns in talks.items():
        row, plain = found[c], [(r or "", t or "") for r, t in turns]
        learned = "".join(t for r, t in plain if r == "assistant")
        assert row.n_turns == len(turns)
        assert row.turns_sha256 == digest("".join(f"{r}\n{t}\n" for r, t in plain))
        assert (row.loss_chars, row.loss_sha256) == (len(learned), digest(learned))
        assert row.formatted_chars >= sum(len(t) for _, t in plain)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r.conv_id for r in LLM_QUERIES["op13_chat"](spark, str(tmp_path)).collect()] == [-7]
    assert chat.format_windows(spark.createDataFrame([], SCHEMA)).count() == 0
