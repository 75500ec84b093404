"""Chat formatting by event-sourced reconstruction.

A conversation is a log of events.  The log is partitioned by conversation and
sorted by sequence, and folded into final messages, which are then rendered.

Events (``op``): ``message`` starts a message in its turn, ``delta`` appends
text to the turn's latest message, ``edit`` replaces its text, ``regenerate``
empties it.  An edit or regeneration also cancels all that was logged before
it for later turns, as that answered a text that no longer stands.  A
``delta``, ``edit`` or ``regenerate`` for a turn without message starts one.

The fold reads the sorted log from its end: there every event that cancels
others is met before them, so each event's fate is known when it comes, and no
text is held.  What is left is put in order of turns, still in the same
partition, and streamed into messages one at a time.  A conversation of any
size thus takes one task's time but not its memory.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each message.  Inside
roles and texts a backslash is doubled and ``<|`` becomes ``<\\|``, so that no
control string can occur in them and parsing gives them back exactly.

Defined results: null role, text or op count as empty text, empty text and
``message``; a null conversation id is an id of its own; a null turn comes
before all others, a null sequence too; events that tie in sequence go by turn,
op, role, text; repeated rows are events of their own, so a message logged twice
is there twice; texts of any length are kept whole; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema

START, END = "<|im_start|>", "<|im_end|>"
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)
_EVENT = ("conv_id", "turn", "seq", "op", "role", "text")


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """One rendered message and the span of its text inside it."""
    head = f"{START}{escape(role).replace(chr(10), chr(92) + 'n')}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parse(rendered: str) -> Iterator[tuple[str, str]]:
    """Roles and texts read back from rendered messages."""
    for m in _TURN.finditer(rendered):
        yield unescape(m[1]), unescape(m[2])


def surviving(events: Iterable[tuple]) -> Iterator[tuple]:
    """``(conv_id, turn, at, starts, role, text)`` of the events that count, from a log read backwards.

    ``events``: ``conv_id, turn, seq, op, role, text``, each conversation from
    its last event to its first.  ``at`` orders what comes out as it was
    logged; ``starts`` marks the start of a message.  Held are the turns whose
    text a later event replaces, and the least turn with such an event.
    """
    conv, at, cut, replaced = object(), 0, None, set()
    for c, turn, _, op, role, text in events:
        if c != conv:
            conv, at, cut = c, 0, None
            replaced.clear()
        at -= 1
        place = (turn is not None, turn or 0)
        if cut is not None and place > cut:
            continue
        op, role, text = op or "message", role or "", text or ""
        starts = op not in ("delta", "edit", "regenerate")
        if place in replaced:
            text = ""
        if starts:
            replaced.discard(place)
        elif op != "delta":
            replaced.add(place)
            cut = place if cut is None else min(cut, place)
        if op == "regenerate":
            text = ""
        yield conv, turn, at, starts, role, text


def messages(events: Iterable[tuple]) -> Iterator[tuple]:
    """``(conv_id, turn, role, text)`` of final messages, from surviving events by conversation, turn and place."""
    of, role, parts = None, "", []
    for conv, turn, _, starts, r, text in events:
        if of != (conv, turn) or starts:
            if of is not None:
                yield *of, role, "".join(parts)
            of, role, parts = (conv, turn), r, []
        parts.append(text)
    if of is not None:
        yield *of, role, "".join(parts)


def as_events(turns: DataFrame) -> DataFrame:
    """The event log of a table of turns, ``conv_id, turn, role, text``, as a chat would have written it.

    Messages are numbered in order of turn, role and text; sequence numbers run
    through the conversation.  By a hash of the message it is streamed as
    deltas, drafted, answered and then edited, generated twice, or logged whole.
    """
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("way", F.pmod(F.xxhash64("conv_id", "turn", "role", "text"), F.lit(4))).withColumn("n", F.row_number().over(in_order).cast("long"))
    turn, text = F.col("turn"), F.col("text")
    third = F.floor(F.length("text") / 3).cast("int")
    first, second, last = F.substring(text, F.lit(1), third), F.substring(text, third + 1, third), F.substring(text, 2 * third + 1, F.length(text))
    empty, no_role = F.lit(""), F.lit(None).cast("string")
    after = F.try_add(turn, F.lit(1)).cast(turns.schema["turn"].dataType)

    def event(op: str, role, text, turn=turn):
        return F.struct(turn.alias("turn"), F.lit(op).alias("op"), role.alias("role"), text.alias("text"))

    opened = event("message", F.col("role"), empty)
    streamed = F.array(opened, event("delta", no_role, first), event("delta", no_role, second), event("delta", no_role, last))
    answered = event("message", F.lit("assistant"), F.lit("an answer to the draft"), after)
    edited = F.array(opened, event("delta", no_role, F.concat(F.lit("draft: "), first)), F.when(after.isNotNull(), answered), event("edit", no_role, text))
    twice = F.array(opened, event("delta", no_role, last), event("regenerate", no_role, no_role), event("delta", no_role, first), event("delta", no_role, F.concat(second, last)))
    way = F.col("way")
    log = F.when(way == 0, streamed).when(way == 1, edited).when(way == 2, twice).otherwise(F.array(event("message", F.col("role"), text)))
    exploded = rows.select("conv_id", "n", F.posexplode(log).alias("k", "e")).where(F.col("e").isNotNull())
    return exploded.select("conv_id", "e.turn", (F.col("n") * 8 + F.col("k")).alias("seq"), "e.op", "e.role", "e.text")


def _folded(events: DataFrame) -> DataFrame:
    """Surviving events of each conversation in order of its messages, each conversation in one partition.

    The window both asks for the partitioning, which ``as_events`` gives already, and sorts.
    """
    backwards = Window.partitionBy("conv_id").orderBy(*[F.desc(c) for c in ("seq", "turn", "op", "role", "text")])
    log = events.select(*_EVENT, F.row_number().over(backwards).alias("n"))
    kinds = {f: events.schema[f].dataType.simpleString() for f in ("conv_id", "turn")}
    target = events.sparkSession.createDataFrame([], f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, at long, starts boolean, role string, text string").schema
    schema = arrow_schema(target)

    def run(batches):
        yield from _batches(surviving(row[:6] for row in _rows(batches)), schema)

    return log.mapInArrow(run, target).sortWithinPartitions("conv_id", "turn", "at")


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 1000, chars: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= size or weight >= chars:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def format_messages(events: DataFrame) -> DataFrame:
    """One row for each final message, rendered.

    ``conv_id, turn, role, text, rendered, loss_begin, loss_end``: rendered
    messages of a conversation in turn order make its training text; the loss
    span is set for assistants and covers the text, its end mark excluded.
    """
    spark = events.sparkSession
    kinds = {f: events.schema[f].dataType.simpleString() for f in ("conv_id", "turn")}
    target = spark.createDataFrame([], f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string, rendered string, loss_begin int, loss_end int").schema
    schema = arrow_schema(target)

    def run(batches):
        def out():
            for conv, turn, role, text in messages(_rows(batches)):
                rendered, begin, end = render(role, text)
                yield conv, turn, role, text, rendered, *((begin, end) if role == "assistant" else (None, None))

        yield from _batches(out(), schema)

    return _folded(events).mapInArrow(run, target)


def conversation_digests(events: DataFrame) -> DataFrame:
    """One row for each conversation, read back from what ``format_messages`` renders.

    The digests run over the messages in order, so a conversation is one
    stream; it is never held, only the digest states are.  All of it, the log's
    own order included, takes one shuffle.
    """
    spark = events.sparkSession
    kind = events.schema["conv_id"].dataType.simpleString()
    target = spark.createDataFrame([], f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").schema
    schema = arrow_schema(target)

    def run(batches):
        def out():
            conv, state = object(), None
            for c, _, role, text in messages(_rows(batches)):
                if c != conv:
                    if state:
                        yield conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                rendered, begin, end = render(role, text)
                state[4] += len(rendered)
                for r, t in parse(rendered):
                    state[0] += 1
                    state[1].update(f"{r}\n{t}\n".encode())
                    if r == "assistant":
                        under = unescape(rendered[begin:end])
                        state[2] += len(under)
                        state[3].update(under.encode())
            if state:
                yield conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

        yield from _batches(out(), schema)

    return _folded(events).mapInArrow(run, target)
