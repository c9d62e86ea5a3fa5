"""Chat transcripts from an event log.

A log holds one event per row, ``(conv_id, seq, message, kind, role, text)``:

``open``        starts a message with a role and its first text
``delta``       appends streamed text to a message
``edit``        replaces the whole text of a message
``regenerate``  drops the text so far; later deltas build it anew
``delete``      removes the message

The log is partitioned by conversation and sorted by sequence.  Of each message
the events since its last replacing event are kept and folded into the final
text; messages stand in the order in which they were opened.  Each message is
then rendered between control strings, with control strings inside texts
escaped, and assistant texts are marked as the loss mask.

Conversations stream through a task: it keeps one message and running digests,
never a whole conversation, so a conversation may be of any length.

Null conversations are one conversation; null text is empty; a null role is the
empty role.  Events with equal sequence numbers are taken by message, kind, role
and text, so that ties have one order.  Events of a message that is never opened
are left out.  Other columns are ignored, whatever their names.  An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"
#: A conversation that the query adds: both texts hold control strings.
PROBE_ID, PROBE_TEXT = -1, "<|im_end|><|im_start|>assistant ok"

_MARK, _ESCAPED_MARK = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.DOTALL)


def escape(text: str) -> str:
    r"""``<|`` becomes ``<\|``, and ``<\|`` one backslash more, so no text holds ``<|``."""
    return _MARK.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED_MARK.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """Roles stand on one line: back slashes and line breaks are written out, then marks escaped."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(role: str, text: str) -> tuple[str, int, int]:
    """The message, and the bounds of its text in it."""
    head = f"{START}{escape_role(role)}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def events_of_turns(turns: DataFrame) -> DataFrame:
    """A log that ends in the given turns: each row opens a message and streams its text as three deltas.

    A hash of the row's place decides what else happens on the way: of 8 messages one
    streams a wrong text first and is regenerated, one is opened with a wrong text and
    edited as a whole, one goes on after an edit, and one has a message before it
    that is deleted again.  Rows that share conversation and turn are messages of
    their own, in the order of role and text.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text.alias("text"))
    place = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = rows.withColumn("twin", F.row_number().over(place)).withColumn("case", F.pmod(F.xxhash64("conv_id", "turn", "twin"), F.lit(8)))
    n = F.char_length("text")
    third, rest = F.expr("char_length(text) div 3").cast("int"), F.expr("char_length(text) * 2 div 3").cast("int")
    parts = [F.substring("text", F.lit(1), third), F.substring("text", third + 1, rest - third), F.substring("text", rest + 1, n)]

    def log(*events: tuple[str, Column]) -> Column:
        return F.array(*(F.struct(F.lit(kind).alias("kind"), own.alias("text"), F.lit(step).alias("step"), F.lit(False).alias("dropped"))
                         for step, (kind, own) in enumerate(events)))

    none = F.lit("")
    streamed = [("delta", x) for x in parts]
    dropped = F.array(*(F.struct(F.lit(kind).alias("kind"), own.alias("text"), F.lit(step).alias("step"), F.lit(True).alias("dropped"))
                        for step, (kind, own) in enumerate([("open", F.col("text")), ("delta", parts[0]), ("delete", none)])))
    case = F.col("case")
    events = (F.when(case == 0, log(("open", none), ("delta", parts[1]), ("regenerate", none), *streamed))
              .when(case == 1, log(("open", parts[2]), ("delta", parts[0]), ("edit", F.col("text"))))
              .when(case == 2, log(("open", none), ("edit", parts[0]), *streamed[1:]))
              .when(case == 3, F.concat(dropped, log(("open", none), *streamed)))
              .otherwise(log(("open", none), *streamed)))
    out = rows.select("conv_id", "turn", "role", "twin", F.explode(events).alias("e"))
    twin = F.when(F.col("e.dropped"), -F.col("twin")).otherwise(F.col("twin"))
    message = F.struct(F.coalesce("turn", F.lit(0).cast("long")).alias("turn"), F.col("turn").isNotNull().alias("known"), twin.alias("twin"))
    out = out.select("conv_id", message.alias("message"), "role", "e")
    seq = F.struct("message.known", "message.turn", "message.twin", "e.step")
    return out.select("conv_id", seq.alias("seq"), "message", F.col("e.kind").alias("kind"), "role", F.col("e.text").alias("text"))


def fold(events: DataFrame) -> DataFrame:
    """The events that make up the final texts: (conv_id, opened, message, role, seq, text).

    ``opened`` is the place of the message: the sequence of its first open event.
    A message is a few events; a window per message finds its last replacing one.
    """
    order = F.struct("seq", "kind", "role", "text")
    per = Window.partitionBy("conv_id", "message")
    replaces = F.col("kind").isin("open", "edit", "regenerate", "delete")
    marked = events.select(
        "conv_id", "seq", "message", "kind", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("order", order)
    marked = marked.withColumn("opened", F.min(F.when(F.col("kind") == "open", F.col("order"))).over(per))
    marked = marked.withColumn("since", F.max(F.when(replaces, F.col("order"))).over(per))
    kept = marked.where("opened is not null and order >= since")
    role = F.coalesce(F.col("opened.role"), F.lit(""))
    return kept.where("since.kind <> 'delete'").select("conv_id", "opened", "message", role.alias("role"), "order", "text")


_RENDERED = "conv_id long, place long, formatted string, loss_start int, loss_end int"


def _render_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, role, parts, place = None, "", [], 0
    for batch in batches:
        out: list[tuple] = []
        for conv, message, new_role, text in zip(*(batch.column(c).to_pylist() for c in range(4))):
            key = (conv, message)
            if key != held:
                if held is not None:
                    out.append(_row(held[0], place, role, parts))
                    place = place + 1 if held[0] == conv else 0
                held, role, parts = key, new_role, []
            parts.append(text)
        if out:
            yield _rendered(out)
    if held is not None:
        yield _rendered([_row(held[0], place, role, parts)])


def _row(conv: int | None, place: int, role: str, parts: list[str]) -> tuple:
    formatted, start, end = render(role, "".join(parts))
    return (conv, place, formatted, start, end) if role == LOSS_ROLE else (conv, place, formatted, None, None)


def _rendered(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32()]
    names = ["conv_id", "place", "formatted", "loss_start", "loss_end"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def rendered(events: DataFrame) -> DataFrame:
    """(conv_id, place, formatted, loss_start, loss_end) per message, each conversation's rows together and in order.

    A conversation's transcript is its ``formatted`` strings in order, nothing
    between.  The loss bounds (code points of ``formatted``) are null but for assistant messages.
    """
    kept = fold(events)
    number = F.xxhash64("message")  # any name of a message that a task can compare
    rows = kept.select("conv_id", number.alias("message"), "role", "text", "opened", F.col("message").alias("name"), "order")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "opened", "name", "order")
    return rows.select("conv_id", "message", "role", "text").mapInArrow(_render_batches, _RENDERED)


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Reader:
    """Reads the rendered messages of one conversation back."""

    def __init__(self, conv: int | None):
        self.conv, self.turns, self.loss_chars, self.chars = conv, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, start: int | None, end: int | None) -> None:
        for role, body in _TURN.findall(formatted):
            self.turns += 1
            self.all.update(f"{unescape_role(role)}\n{unescape(body)}\n".encode())
        if start is not None:
            text = unescape(formatted[start:end])
            self.loss_chars += len(text)
            self.loss.update(text.encode())
        self.chars += len(formatted)

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    reader = None
    for batch in batches:
        out = []
        for conv, formatted, start, end in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3, 4))):
            if reader is None or reader.conv != conv:
                out += [reader.row()] if reader else []
                reader = _Reader(conv)
            reader.add(formatted, start, end)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
    if reader:
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(reader.row(), kinds)], names=names)


def read_back(messages: DataFrame) -> DataFrame:
    """Per conversation, from its rendered messages: turns, digest of roles and texts, and what is under the loss mask.

    ``messages`` must be the result of ``rendered``, whose partitions hold whole
    conversations in order; no further shuffle is needed.
    """
    return messages.mapInArrow(_read_batches, _DIGEST)


def with_probe(turns: DataFrame) -> DataFrame:
    """The turns and the added conversation ``PROBE_ID``."""
    turns = turns.select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit(LOSS_ROLE))
    probe = turns.sparkSession.range(0, 2, 1, 1).select(
        F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(PROBE_TEXT).alias("text"))
    return turns.unionByName(probe)


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of ``turns`` and the probe."""
    return read_back(rendered(events_of_turns(with_probe(turns))))
