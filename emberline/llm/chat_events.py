"""Chats rebuilt from event logs and rendered for training.

A log has ``conv_id, seq, message, kind, role, text``: ``open`` (a message with its role), ``delta`` (text to append), ``edit`` (the
text so far is replaced), ``regenerate`` (what was streamed so far is thrown away). The log is partitioned by conversation
and message, sorted by sequence, and folded; a message is the unit, so a conversation with a third of all events spreads over
many tasks, and only one message's text is held at a time. Rendered messages are then put in order within their conversation.

The template is ``<|im_start|>role``, a line break, the text, ``<|im_end|>`` and a line break. In roles and texts a backslash stands before every
backslash, and behind the first character of every control string, so no control string of the template or of other
templates survives inside a text; ``unescape`` is the exact inverse. The loss mask covers the texts of assistants.

Defined results: null texts and roles are empty; events of a message before its ``open`` count as well; several ``open`` events: the last
role counts; a message without events does not exist; equal sequence numbers are ordered by kind and text; an empty log gives none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BEGIN, END = "<|im_start|>", "<|im_end|>\n"
# fixed values: control strings of common chat templates
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
FORBIDDEN = re.compile("|".join(re.escape(c) for c in CONTROL))
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
MASKED = "assistant"
EVENT_TEXT = 200


def escape(text: str) -> str:
    return FORBIDDEN.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\\n")


def render(role: str, text: str) -> tuple[str, int, int]:
    """A rendered message, and where its text begins and ends."""
    head = f"{BEGIN}{escape_role(role)}\n"
    body = escape(text)
    return f"{head}{body}{END}", len(head), len(head) + len(body)


def read_message(rendered: str) -> tuple[str, str]:
    """Role and text of one rendered message."""
    if not rendered.startswith(BEGIN) or not rendered.endswith(END):
        raise ValueError("not a rendered message")
    at = len(BEGIN)
    while rendered[at] != "\n":
        at += 2 if rendered[at] == "\\" else 1
    return unescape(rendered[len(BEGIN) : at]), unescape(rendered[at + 1 : -len(END)])


def fold(events: Iterator[tuple[str, str | None, str | None]]) -> tuple[str, str]:
    """Role and text of a message after its events ``(kind, role, text)`` in order."""
    role, parts = "", []
    for kind, who, text in events:
        if kind == "open":
            role = who or ""
        elif kind == "delta":
            parts.append(text or "")
        elif kind == "edit":
            parts = [text or ""]
        elif kind == "regenerate":
            parts = []
        else:
            raise ValueError(f"unknown kind of event: {kind}")
    return role, "".join(parts)


def messages(log: DataFrame) -> DataFrame:
    """``conv_id, message, role, text, rendered, mask_start, mask_end`` (null where no loss is taken) of every message."""
    kind_of = {name: log.schema[name].dataType.simpleString() for name in ("conv_id", "message")}
    streams = log.select("conv_id", "message", "seq", "kind", "role", "text").repartition("conv_id", "message").sortWithinPartitions("conv_id", "message", "seq", "kind", "text")
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, events = None, []

        def close() -> None:
            role, text = fold(iter(events))
            rendered, begin, end = render(role, text)
            mask = (begin, end) if role == MASKED else (None, None)
            out.append((*key, role, text, rendered, *mask))

        def batch_of() -> pa.RecordBatch:
            kinds = [arrow[kind_of["conv_id"]], arrow[kind_of["message"]], pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            columns = list(zip(*out, strict=True)) or [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "message", "role", "text", "rendered", "mask_start", "mask_end"])

        for batch in batches:
            for conv, message, kind, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "message", "kind", "role", "text")], strict=True):
                if key != (conv, message):
                    if key is not None:
                        close()
                    key, events = (conv, message), []
                events.append((kind, role, text))
                if kind in ("edit", "regenerate"):  # what came before matters no more but for the role
                    events = [("open", fold(iter(events))[0], None), (kind, None, text)]
            if len(out) >= 500:
                yield batch_of()
                out.clear()
        if key is not None:
            close()
        yield batch_of()

    shape = f"conv_id {kind_of['conv_id']}, message {kind_of['message']}, role string, text string, rendered string, mask_start long, mask_end long"
    return streams.mapInArrow(build, shape)


def conversation_digests(rendered: DataFrame) -> DataFrame:
    """One row per conversation, read back from its rendered messages in order; nothing but running digests is held.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``.
    """
    kind = rendered.schema["conv_id"].dataType.simpleString()
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    streams = rendered.select("conv_id", "message", "rendered", "mask_start", "mask_end").repartition("conv_id").sortWithinPartitions("conv_id", "message")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, state, begun = None, None, False

        def close() -> None:
            out.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [arrow, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            for conv, text, a, b in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "rendered", "mask_start", "mask_end")], strict=True):
                if not begun or key != conv:
                    if begun:
                        close()
                    key, state, begun = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0], True
                role, said = read_message(text)
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
                if a is not None:
                    loss = unescape(text[a:b])
                    state[2] += len(loss)
                    state[3].update(loss.encode())
                state[4] += len(text)
            if len(out) >= 5000:
                yield batch_of()
                out.clear()
        if begun:
            close()
        yield batch_of()

    shape = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return streams.mapInArrow(digest, shape)


def event_log(turns: DataFrame, chunk: int = EVENT_TEXT) -> DataFrame:
    """A log whose fold is the given turns (``conv_id, turn, role, text``): texts stream in deltas of ``chunk`` characters.

    Assistants first stream a draft and regenerate; other roles send a first version and edit it. Rows that share conversation and
    turn are messages of their own, ordered by role and text. Message numbers follow ``turn``; nulls come first.
    """
    text = F.coalesce("text", F.lit(""))
    rank = F.xxhash64("role", "text")
    rows = turns.select("conv_id", "turn", "role", text.alias("text"), rank.alias("_rank"))
    twice = rows.groupBy("conv_id", "turn").agg(F.count("*").alias("_n")).filter("_n > 1 or conv_id is null or turn is null").limit(1)
    plain = rows.withColumn("message", F.struct("turn", F.lit(0).cast("long").alias("n")))
    if not twice.isEmpty():
        from pyspark.sql import Window

        order = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
        plain = rows.withColumn("message", F.struct("turn", F.row_number().over(order).cast("long").alias("n")))
    key = F.format_string("%020d.%020d", F.coalesce(F.col("message.turn"), F.lit(-(1 << 62))) + F.lit(1 << 62), F.col("message.n"))
    draft = F.when(F.col("role") == MASKED, "regenerate").otherwise("edit")
    event = lambda kind, role, said: F.struct(kind.alias("kind"), role.alias("role"), said.alias("text"))
    none = F.lit(None).cast("string")
    head = F.array(
        event(F.lit("open"), F.col("role"), none),
        event(F.lit("delta"), none, F.reverse(F.substring("text", 1, 40))),
        event(draft, none, F.when(draft == "edit", F.lit(""))),
    )
    # one pass over the text, however long
    parts = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))
    deltas = F.transform(F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(parts), lambda said: event(F.lit("delta"), none, said))
    log = plain.select("conv_id", key.alias("message"), F.posexplode(F.concat(head, deltas)).alias("_at", "_event"))
    return log.select("conv_id", "message", F.concat(F.col("message"), F.format_string(".%010d", "_at")).alias("seq"), "_event.kind", "_event.role", "_event.text")
