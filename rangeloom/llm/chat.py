"""Chat formatting by incremental black-box rendering.

A template is a function from messages to a string; nothing is known of its inside. Successive prefixes of a
conversation are rendered and consecutive outputs compared: what a prefix adds to the one before is its last turn's
span. Where an output doesn't begin with the one before, the template rewrites history; the conversation is then
rendered once as a whole and each text's span is found by rendering it again with a probe in the text's place. The
same probe gives an assistant text's place inside its span, which is the loss mask.

Positions of turns are two-level ranks over a range partitioning. Where a template states how many turns back it looks
(`memory`), conversations are cut into blocks of `BLOCK` turns, each with so many turns before it, so a conversation
with a third of all rows is dealt out to many tasks; a conversation of which any block shows rewritten history is
rendered again as a whole. Of a template that states nothing every conversation is rendered as a whole. Formatted blocks are written; reading back parses them in parallel, and only the
digests, which are sequential by nature, stream a conversation's blocks through one task, in constant memory.

Defined results: a null text or role is an empty one; rows of equal turn are ordered by role and text, null turns come
first; a null conv_id is a conversation; repeated rows are turns of their own; a conversation without assistant
turns has an empty loss text; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts, written

Message = tuple[str, str]  # role, text
BLOCK = 16
#: Most turns, about, of a range partition.
RANGE_ROWS = 1 << 18
PROBE = "qzxjprobejxzq"
ASSISTANT = "assistant"


@dataclass(frozen=True)
class Template:
    """render: a black box. memory: how many turns before a turn may change how it is rendered; None: all of them, or unknown.
    parse: from an output back to the messages. plain: an escaped text as it was."""

    render: Callable[[list[Message]], str]
    parse: Callable[[str], list[Message]]
    plain: Callable[[str], str]
    memory: int | None = None


_OPEN = re.compile(r"[<\[\]]")
_OPENED = re.compile(r"([<\[\]])\\")


def escape(text: str) -> str:
    """A backslash after every character that begins or ends a control string."""
    return _OPEN.sub(r"\g<0>\\", text)


def unescape(text: str) -> str:
    return _OPENED.sub(r"\1", text)


def render_marked(messages: list[Message]) -> str:
    return "".join(f"<s>[{escape(role)}] {escape(text)}</s>" for role, text in messages)


def parse_marked(output: str) -> list[Message]:
    found = []
    for turn in output.split("</s>")[:-1]:
        if not turn.startswith("<s>["):
            raise ValueError("not a formatted conversation")
        role, _, text = turn[4:].partition("] ")
        found.append((unescape(role), unescape(text)))
    return found


MARKED = Template(render_marked, parse_marked, unescape, 1)


@dataclass
class Rendered:
    text: str
    loss: list[tuple[int, int]]  # spans of the assistants' texts
    turns: list[tuple[int, int]]  # spans of the turns; empty where history is rewritten
    rewrites: bool


def _within(render: Callable[[list[Message]], str], messages: list[Message], at: int, whole: str) -> tuple[int, int]:
    """The span of one text in the output of all messages."""
    probed = render([*messages[:at], (messages[at][0], PROBE), *messages[at + 1 :]])
    # the probe may also stand in other texts: it is where the output without it first differs
    begin = next((m.start() for m in re.finditer(PROBE, probed) if probed[: m.start()] == whole[: m.start()] and (rest := probed[m.end() :]) == whole[len(whole) - len(rest) :]), -1)
    if begin < 0:
        raise ValueError("the template does not keep texts in one piece")
    return begin, len(whole) - (len(probed) - begin - len(PROBE))


def render_block(render: Callable[[list[Message]], str], context: list[Message], messages: list[Message]) -> Rendered:
    """Render messages that follow the context; spans are relative to what they add."""
    before = render(context) if context else ""
    start = len(before)
    turns, loss, prefix = [], [], list(context)
    for role, text in messages:
        prefix.append((role, text))
        now = render(prefix)
        if not now.startswith(before):
            return _rewritten(render, context, messages)
        if role == ASSISTANT:
            a, b = _within(render, prefix, len(prefix) - 1, now)
            if a < len(before):
                return _rewritten(render, context, messages)
            loss.append((a - start, b - start))
        turns.append((len(before) - start, len(now) - start))
        before = now
    return Rendered(before[start:], loss, turns, False)


def _rewritten(render: Callable[[list[Message]], str], context: list[Message], messages: list[Message]) -> Rendered:
    """One output of all messages; a text's span is of what the template has kept of it."""
    every = [*context, *messages]
    whole = render(every)
    loss = []
    for i in range(len(context), len(every)):
        if every[i][0] == ASSISTANT:
            try:
                loss.append(_within(render, every, i, whole))
            except ValueError:
                continue  # the template has dropped this text: nothing of it is trained on
    return Rendered(whole, loss, [], True)


def positions(conversations: DataFrame) -> DataFrame:
    """conv_id, role, text, pos (of the turn in its conversation, from 0)."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    order = ["conv_id", "turn", "role", "text"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            more = [pa.array([part] * b.num_rows, pa.int32()), pa.array(range(at, at + b.num_rows), pa.int64())]
            at += b.num_rows
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("conv_id", "role", "text")), *more], names=["conv_id", "role", "text", "part", "at"])

    dealt = rows.repartitionByRange(parts(conversations.sparkSession, rows.count(), RANGE_ROWS), *order).sortWithinPartitions(*order)
    dealt = written(dealt.mapInArrow(number, "conv_id long, role string, text string, part int, at long"), "turns")
    counts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row for each range partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = written(counts.select("part", before.alias("before")), "turn-offsets")
    ranked = dealt.join(offsets, "part").withColumn("at", F.col("before") + F.col("at"))
    firsts = ranked.groupBy(F.col("conv_id").alias("__c")).agg(F.min("at").alias("first"))
    return ranked.join(firsts, F.col("conv_id").eqNullSafe(F.col("__c"))).select("conv_id", "role", "text", (F.col("at") - F.col("first")).alias("pos"))


def format_blocks(conversations: DataFrame, template: Template = MARKED, block: int = BLOCK) -> DataFrame:
    """conv_id, block, n_turns, formatted, loss (flat list of begins and ends), turns (the same), rewrites. Written."""
    rows = positions(conversations)
    got = written(_rendered(rows, template, block), "formatted")
    if template.memory is None:
        return got
    again = got.where("rewrites").select(F.col("conv_id").alias("__c")).distinct()
    if again.isEmpty():
        return got
    of_again = F.col("conv_id").eqNullSafe(F.col("__c"))
    whole = _rendered(rows.join(again, of_again, "left_semi"), replace(template, memory=None), block)
    return written(got.join(again, of_again, "left_anti").union(whole), "formatted-whole")


def _rendered(rows: DataFrame, template: Template, block: int) -> DataFrame:
    """From positions: a row for each block, or for each conversation where the template may look at all turns."""
    if template.memory is None:
        rows = rows.withColumn("blocks", F.array(F.lit(0).cast("long")))
    else:
        own, last = F.floor(F.col("pos") / block), F.floor((F.col("pos") + template.memory) / block)
        rows = rows.withColumn("blocks", F.sequence(own, last))
    rows = rows.select("conv_id", F.explode("blocks").alias("block"), "pos", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> list[tuple]:
            conv, number = key
            own = [(r, t) for p, r, t in held if template.memory is None or p // block == number]
            if not own:  # only what a next block, which isn't there, would look at
                return []
            context = [(r, t) for p, r, t in held][: len(held) - len(own)]
            got = render_block(template.render, context, own)
            return [(conv, number, len(own), got.text, [x for s in got.loss for x in s], [x for s in got.turns for x in s], got.rewrites)]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", "block", "n_turns", "formatted", "loss", "turns", "rewrites"])

        for b in batches:
            out = []
            for conv, number, pos, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != (conv, number):
                    out += done() if held else []
                    key, held = (conv, number), []
                held.append((pos, role, text))
            if out:
                yield batch(out)
        if held and (out := done()):
            yield batch(out)

    dealt = rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "pos")
    return dealt.mapInArrow(run, "conv_id long, block long, n_turns long, formatted string, loss array<long>, turns array<long>, rewrites boolean")


def read_back(blocks: DataFrame, template: Template = MARKED) -> DataFrame:
    """Per conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, rewrites."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                turns = template.parse(r["formatted"])
                loss = [template.plain(r["formatted"][a:e]) for a, e in zip(r["loss"][::2], r["loss"][1::2], strict=True)]
                rows.append((r["conv_id"], r["block"], len(turns), "".join(f"{role}\n{text}\n" for role, text in turns), "".join(loss), len(r["formatted"]), r["rewrites"]))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", "block", "n", "turns", "loss", "chars", "rewrites"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def row() -> tuple:
            conv, n, turns, chars, loss, formatted, rewrites = state
            return (conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted, rewrites)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites"])

        for b in batches:
            out = []
            for conv, _, n, turns, loss, chars, rewrites in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if state is None or state[0] != conv:
                    if state is not None:
                        out.append(row())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, False]
                state[1] += n
                state[2].update(turns.encode())
                state[3] += len(loss)
                state[4].update(loss.encode())
                state[5] += chars
                state[6] |= rewrites
            if out:
                yield batch(out)
        if state is not None:
            yield batch([row()])

    parsed = blocks.select("conv_id", "block", "formatted", "loss", "rewrites").mapInArrow(parse, "conv_id long, block long, n long, turns string, loss string, chars long, rewrites boolean")
    dealt = parsed.repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return dealt.mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean")


def format_conversations(conversations: DataFrame, template: Template = MARKED, block: int = BLOCK) -> DataFrame:
    """Format, write, read back."""
    return read_back(format_blocks(conversations, template, block), template)
