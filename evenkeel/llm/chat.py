"""Chat formatting: conversations as windows of whole turns within a token budget, with a loss mask.

Every turn is a piece of formatted text: an opening mark, the role, a line feed, the text and a closing mark. Control strings inside roles and
texts are escaped by a backslash after their first character (one more where there are some), which is undone by taking one
away, so any text comes back unchanged and no text can open or close a turn.

Prefix sums of the turns' tokens choose the windows: a window takes as many new turns as fit in what the budget leaves after the system
turn, which every window retains, and after up to ``history_turns`` of the turns just before, of up to ``history_tokens`` tokens,
which are repeated. History gives way to a new turn that would not fit otherwise. Every turn is new in exactly one window. The loss mask
covers the texts of new assistant turns; repeated ones are masked. A turn that is longer than the budget leaves is a window of its own,
whole, marked ``over_budget``.

A conversation's turns are handled in stretches of ``stretch`` characters of the running total, so that a conversation of any length is shared out
over tasks. Short conversations are one stretch. Long ones are sorted by a range sort, and windows end at the border of a stretch, where
the history goes on and the system turn is retained as in any other window. Nothing else depends on the length.

Defined cases: null texts and roles are empty; turns are ordered by turn (null first), then by role, then by a hash of the text; equal rows are
turns of their own; a null conversation is one conversation; an empty table gives no windows. The system turn is the first turn, if
its role is ``system``; other system turns are like any other. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.llm.common import vocabulary_path
from evenkeel.llm.tokens import VOCABULARY, Encoder
from evenkeel.operators.joining import attach_settled
from evenkeel.workspace import settle, shuffle_partitions

#: The marks of this template and the control strings of other common ones, all escaped in texts.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
CONTROL = (OPEN, CLOSE, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

SYSTEM, TARGET = "system", "assistant"
BUDGET, HISTORY_TURNS, HISTORY_TOKENS = 512, 2, 128
#: Characters of a stretch. A turn counts ``TURN_CHARS`` besides its text, so a stretch has a bounded number of turns.
STRETCH, TURN_CHARS = 1 << 20, 16
#: Characters before a border among which the history of the next stretch is looked for; no piece of the vocabulary has more than HALO / HISTORY_TOKENS.
HALO = 1 << 17

_inside = "|".join(f"{re.escape(c[0])}(?=\\\\*{re.escape(c[1:])})" for c in CONTROL)
_ESCAPE = re.compile(f"(?:{_inside})")
_UNESCAPE = re.compile(f"({_inside})\\\\")
_TURN = re.compile(f"{re.escape(OPEN)}(.*?)\n(.*?){re.escape(CLOSE)}\n", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def escape_role(role: str) -> str:
    """A role on one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def piece(role: str, text: str) -> str:
    return f"{OPEN}{escape_role(role)}\n{escape(text)}{CLOSE}\n"


def read_turns(text: str) -> list[tuple[str, str, int, int]]:
    """The turns of a formatted window: role, text, and where the escaped text begins and ends in the window."""
    return [(unescape_role(m[1]), unescape(m[2]), m.start(2), m.end(2)) for m in _TURN.finditer(text)]


@dataclass
class Turn:
    role: str
    text: str  # the formatted piece
    loss: tuple[int, int]  # where the turn's own text begins in the piece, and its length
    tokens: int


@dataclass
class Span:
    """A window: the retained system turn, repeated turns from ``history``, new turns from ``start`` to ``end``."""

    history: int
    start: int
    end: int
    tokens: int


def spans(tokens: list[int], first: int, system: int, budget: int, history_turns: int, history_tokens: int, floor: int = 0) -> Iterator[Span]:
    """Windows over the turns from ``first`` on; those before are there to be repeated only.

    ``system`` is the number of tokens of the system turn, which windows that begin at ``floor`` or later retain; turns before ``floor`` are
    not repeated.
    """
    upto = [0, *accumulate(tokens)]
    start = first
    while start < len(tokens):
        kept = system if start >= floor else 0
        history = start
        while history > max(floor, start - history_turns):
            repeated = upto[start] - upto[history - 1]
            if repeated > history_tokens or kept + repeated + tokens[start] > budget:
                break
            history -= 1
        room = budget - kept - (upto[start] - upto[history])
        end = max(start + 1, bisect_right(upto, upto[start] + room) - 1)
        yield Span(history, start, end, kept + upto[end] - upto[history])
        start = end


def stretches(rows: DataFrame, stretch: int) -> DataFrame:
    """``rows`` (_conv, conv_id, turn, role, text, _hash) with their ``stretch`` and ``kind``: 2 new, 1 there to be repeated, 0 the retained system turn."""
    length = F.char_length("role") + F.char_length("text") + TURN_CHARS
    rows = rows.withColumn("_length", length.cast("long"))
    totals = rows.groupBy("_conv").agg(F.sum("_length").alias("_total"))
    long = settle(totals.where(F.col("_total") > stretch).select("_conv", F.lit(True).alias("_long")), "long-conversations")
    marked = attach_settled(rows, long, ["_conv"], "left")
    columns = ["_conv", "conv_id", "turn", "role", "text", "_hash"]
    short = marked.where("_long is null").select(*columns, F.lit(0).cast("long").alias("stretch"), F.lit(2).alias("kind"))
    if not long.count():
        return short
    # Equal rows are told apart, so that a crowd of them can be cut into ranges.
    numbered = marked.where("_long").drop("_long").withColumn("_row", F.monotonically_increasing_id())
    ordered = settle(numbered.orderBy("_conv", "turn", "role", "_hash", "_row").drop("_row"), "long-conversations")
    placed = ordered.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    part_no = F.regexp_extract("_file", r"^part-(\d+)", 1).cast("long")
    earlier = Window.partitionBy("_conv").orderBy(part_no, "_file").rowsBetween(Window.unboundedPreceding, -1)
    per_file = placed.groupBy("_conv", "_file").agg(F.sum("_length").alias("_total"))
    shifts = per_file.select("_conv", "_file", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_shift"))
    before = Window.partitionBy("_conv", "_file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    running = placed.withColumn("_before", F.coalesce(F.sum("_length").over(before), F.lit(0)))
    located = attach_settled(running, settle(shifts, "shifts"), ["_conv", "_file"]).withColumn("_start", F.col("_before") + F.col("_shift"))
    located = located.withColumn("_own", F.call_function("div", F.col("_start"), F.lit(stretch)))
    end, border = F.col("_start") + F.col("_length"), (F.col("_own") + 1) * stretch
    new = F.array(F.struct(F.col("_own").alias("stretch"), F.lit(2).alias("kind")))
    repeated = F.array(F.struct((F.col("_own") + 1).alias("stretch"), F.lit(1).alias("kind")))
    both = F.when(end >= border - HALO, F.concat(new, repeated)).otherwise(new)
    dealt = settle(located.withColumn("_to", F.explode(both)).select(*columns, "_start", "_to.*"), "stretches")
    system = dealt.where((F.col("_start") == 0) & (F.col("kind") == 2) & (F.col("role") == SYSTEM)).select(*columns)
    later = dealt.where("stretch > 0").select("_conv", "stretch").distinct()
    retained = system.join(later, "_conv").select(*columns, "stretch", F.lit(0).alias("kind"))
    # The system turn itself is retained, not repeated.
    again = (F.col("kind") == 1) & (F.col("_start") == 0) & (F.col("role") == SYSTEM)
    return short.unionByName(dealt.where(~again).drop("_start")).unionByName(retained)


def format_windows(
    conversations: DataFrame,
    budget: int = BUDGET,
    history_turns: int = HISTORY_TURNS,
    history_tokens: int = HISTORY_TOKENS,
    vocabulary: str | None = None,
    stretch: int = STRETCH,
) -> DataFrame:
    """(conv_id, stretch, window, text, n_tokens, n_turns, n_repeated, over_budget, loss) of every window.

    The first ``n_repeated`` of a window's turns, the system turn among them, were new in an earlier one. ``loss`` has (start, length) of
    the parts of ``text``, in characters, that are to be learned.
    """
    path = vocabulary or vocabulary_path(VOCABULARY)
    # A key that is never null.
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(key.alias("_conv"), "conv_id", "turn", role.alias("role"), text.alias("text")).withColumn("_hash", F.xxhash64("text"))
    dealt = stretches(rows, stretch).repartition(shuffle_partitions(rows.sparkSession), "_conv", "stretch")
    dealt = dealt.sortWithinPartitions("_conv", "stretch", "kind", "turn", "role", "_hash")
    schema = rows.schema["conv_id"].dataType.simpleString()

    def windows_of(group: list[tuple[int, str, str]], encoder: Encoder, begins: bool):
        """The windows of one stretch, whose rows are (kind, role, text)."""
        turns, kinds = [], [k for k, _, _ in group]
        for _, role, said in group:
            formatted = piece(role, said)
            own = len(escape(said))
            start = len(formatted) - len(CLOSE) - 1 - own
            turns.append(Turn(role, formatted, (start, own), len(encoder.ids(formatted.encode("utf-8", "surrogatepass")))))
        retained = None
        if kinds[0] == 0:
            retained, turns, kinds = turns[0], turns[1:], kinds[1:]
        first, floor = kinds.index(2) if 2 in kinds else len(kinds), 0
        if begins and first < len(turns) and turns[first].role == SYSTEM:
            retained, floor = turns[first], 1
        tokens = [t.tokens for t in turns]
        for span in spans(tokens, first, retained.tokens if retained else 0, budget, history_turns, history_tokens, floor):
            shown = [retained] if retained and span.start >= floor else []
            shown += turns[span.history : span.start]
            repeated = len(shown)
            shown += turns[span.start : span.end]
            loss, at = [], 0
            for i, turn in enumerate(shown):
                if i >= repeated and turn.role == TARGET:
                    loss.append({"start": at + turn.loss[0], "length": turn.loss[1]})
                at += len(turn.text)
            yield "".join(t.text for t in shown), span.tokens, len(shown), repeated, span.tokens > budget, loss

    names = ["conv_id", "stretch", "window", "text", "n_tokens", "n_turns", "n_repeated", "over_budget", "loss"]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))]

    def run(batches):
        encoder, out, size = Encoder(path), [], 0
        id_type = None
        for (conv, conv_id, part), group in groups(batches):
            id_type = conv_id.type
            for i, window in enumerate(windows_of(group, encoder, part == 0)):
                out.append((conv_id, part, i, *window))
                size += len(window[0])
                if size > 1 << 20:
                    yield batch_of(out, id_type)
                    out, size = [], 0
        if out:
            yield batch_of(out, id_type)

    def batch_of(out, id_type):
        columns = list(zip(*out))
        ids = pa.array([c.as_py() for c in columns[0]], id_type)
        return pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns[1:], kinds))], names)

    return dealt.mapInArrow(
        run,
        f"conv_id {schema}, stretch long, window int, text string, n_tokens long, n_turns int, n_repeated int, over_budget boolean, loss array<struct<start:long,length:long>>",
    )


def groups(batches):
    """((_conv, conv_id, stretch), rows (kind, role, text)) of consecutive rows of one stretch."""
    name, group = None, []
    for batch in batches:
        convs, parts = batch.column("_conv").to_pylist(), batch.column("stretch").to_pylist()
        ids = batch.column("conv_id")
        rows = zip(batch.column("kind").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist())
        for i, row in enumerate(rows):
            if name is None or (convs[i], parts[i]) != (name[0], name[2]):
                if group:
                    yield name, group
                name, group = (convs[i], ids[i], parts[i]), []
            group.append(row)
    if group:
        yield name, group


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, stretch, window, n_turns, turns, n_loss, loss, n_chars) of every window, read from its text and mask alone.

    ``turns`` has role, line feed, text and line feed of every new turn, ``loss`` all text under the mask, unescaped; both in UTF-8.
    """
    kind = windows.schema["conv_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = []
            for text, repeated, mask in zip(*(batch.column(c).to_pylist() for c in ("text", "n_repeated", "loss"))):
                turns = read_turns(text)[repeated:]
                said = "".join(f"{role}\n{own}\n" for role, own, _, _ in turns)
                learned = "".join(unescape(text[m["start"] : m["start"] + m["length"]]) for m in mask)
                out.append((len(turns), said.encode("utf-8", "surrogatepass"), len(learned), learned.encode("utf-8", "surrogatepass"), len(text)))
            columns = list(zip(*out)) if out else [[]] * 5
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("stretch"), batch.column("window"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                ["conv_id", "stretch", "window", "n_turns", "turns", "n_loss", "loss", "n_chars"],
            )

    narrow = windows.select("conv_id", "stretch", "window", "text", "n_repeated", "loss")
    return narrow.mapInArrow(run, f"conv_id {kind}, stretch long, window int, n_turns long, turns binary, n_loss long, loss binary, n_chars long")


def digests(windows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of every conversation, read back from its windows.

    A digest over a whole conversation is taken in its order: the windows of a conversation go through one task, one after the other, and only the state of
    the hash is kept.
    """
    spark = windows.sparkSession
    kind = windows.schema["conv_id"].dataType.simpleString()
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    read = read_back(windows).withColumn("_conv", key).repartition(shuffle_partitions(spark), "_conv").sortWithinPartitions("_conv", "stretch", "window")

    def run(batches):
        name, own, out = None, None, []
        id_type = None

        def finished():
            return (own[0].as_py(), own[1], own[2].hexdigest(), own[3], own[4].hexdigest(), own[5])

        def batch_of(rows):
            columns = list(zip(*rows))
            kinds = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            ids, id_type = batch.column("conv_id"), batch.column("conv_id").type
            convs, turns, loss = (batch.column(c) for c in ("_conv", "turns", "loss"))
            counts = [batch.column(c).to_pylist() for c in ("n_turns", "n_loss", "n_chars")]
            for i in range(batch.num_rows):
                if name != convs[i].as_py():
                    if own is not None:
                        out.append(finished())
                    name, own = convs[i].as_py(), [ids[i], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                own[1], own[3], own[5] = own[1] + counts[0][i], own[3] + counts[1][i], own[5] + counts[2][i]
                own[2].update(turns[i].as_buffer())
                own[4].update(loss[i].as_buffer())
            if len(out) > 10_000:
                yield batch_of(out)
                out = []
        if own is not None:
            out.append(finished())
        if out:
            yield batch_of(out)

    return read.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
