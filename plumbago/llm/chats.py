"""Chat formatting: event logs of conversations folded into messages, rendered by a template, and read back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import named, schema_with, tune

#: The template: OPEN role MIDDLE text CLOSE for each message.
OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
#: What is escaped by a backslash put in front: a backslash, all but the first of adjacent #,
#: the slash of </turn>, and in roles the colon. So no text holds ## or </turn>.
_IN_TEXT = re.compile(r"\\|(?<=#)#|(?<=<)/(?=turn>)")
_IN_ROLE = re.compile(r"[\\:]|(?<=#)#|(?<=<)/(?=turn>)")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_ROLE = re.compile(r"### ((?:[^\\:]|\\.)*): ", re.DOTALL)

#: Kinds of events, in the order in which they are taken at equal sequence numbers.
KINDS = ("open", "regenerate", "edit", "delta")


def escape(text: str, pattern: re.Pattern = _IN_TEXT) -> str:
    return pattern.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """One formatted message, and the range of its text in it."""
    head, body = OPEN + escape(role, _IN_ROLE) + MIDDLE, escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def parse(formatted: str) -> Iterator[tuple[str, int, int]]:
    """Role and text range of each message of a formatted string."""
    at = 0
    while at < len(formatted):
        head = _ROLE.match(formatted, at)
        end = formatted.index(CLOSE, head.end())
        yield unescape(head[1]), head.end(), end
        at = end + len(CLOSE)


class _Fold:
    """Messages of one sorted log: only the message being folded is held.

    Events come by conversation, message and sequence number. A regeneration drops
    the later messages that were opened before it, so the highest sequence number of
    one in an earlier message decides about a message at its opening.
    """

    def __init__(self):
        self.conversation = self.message = self.role = None
        self.begun = self.alive = False
        self.parts, self.cut, self.regenerated = [], None, None

    def take(self, conversation, message, seq, kind, role, text) -> tuple | None:
        """Take one event; gives the message before it where that is done."""
        done = None
        if not self.begun or conversation != self.conversation or message != self.message:
            done = self.finish()
            if not self.begun or conversation != self.conversation:
                self.cut = None
            self.begun, self.conversation, self.message = True, conversation, message
            self.role, self.parts, self.regenerated = None, [], None
            self.alive = self.cut is None or seq > self.cut
        if self.alive:
            if kind == "open":
                self.role = role
                self.parts.append(text)
            elif kind == "delta":
                self.parts.append(text)
            elif kind == "edit":
                self.parts = [text]
            elif kind == "regenerate":
                self.parts, self.regenerated = [], seq
        return done

    def finish(self) -> tuple | None:
        if not (self.begun and self.alive):
            return None
        if self.regenerated is not None and (self.cut is None or self.regenerated > self.cut):
            self.cut = self.regenerated
        return self.conversation, self.role or "", "".join(self.parts)


def rendered(log: DataFrame, *, conversation: str = "conv_id", message: tuple[str, ...] = ("msg",), seq: tuple[str, ...] = ("seq",),
             kind: str = "kind", role: str = "role", text: str = "text") -> DataFrame:
    """conversation, formatted, loss_from, loss_to: the final messages of a log, rendered, in order.

    The log is partitioned by conversation and sorted by message and sequence
    number (one or more columns each) inside each partition; events are folded as they stream by. `open` gives a
    message's role and first text, `delta` adds to the text, `edit` puts another in
    its place, `regenerate` empties it and drops the later messages opened up
    to then, with all their events. Other kinds do nothing. The loss range (code points in
    `formatted`) is an assistant's text; others have an empty one at 0.

    A null text or role reads as ''. The conversation may be null (one more
    conversation), numbers of messages and sequence numbers too (they come first). Events of equal number go by KINDS, then by text. A message without
    `open` has the role ''. Other columns aren't read. A task holds one message
    at a time, however long its conversation; its rows leave in order.
    """
    tune(log.sparkSession)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.coalesce(named(kind), F.lit(""))).cast("int")
    keys = list(dict.fromkeys([*message, *seq]))
    events = log.select(
        named(conversation).alias("c"), *[named(key).alias(f"o{i}") for i, key in enumerate(keys)], rank.alias("k"),
        F.coalesce(named(role).cast("string"), F.lit("")).alias("r"), F.coalesce(named(text).cast("string"), F.lit("")).alias("t"),
    )
    order = [f"o{i}" for i in range(len(keys))]
    events = events.repartition("c").sortWithinPartitions("c", *order, "k", "t")
    number, sequence = len(message), [keys.index(s) for s in seq]
    names = ("",) + KINDS
    schema = schema_with(events.withColumnRenamed("c", conversation), [conversation], "formatted string, loss_from long, loss_to long")
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, out, size = _Fold(), [], 0
        for batch in batches:
            for c, *o, k, r, t in zip(*(col.to_pylist() for col in batch.columns)):
                done = fold.take(c, o[:number], [(o[i] is not None, o[i]) for i in sequence], names[k], r, t)
                if done:
                    out.append(_message(*done))
                    size += len(out[-1][1])
                if size > 1 << 20:
                    yield _batch(out, arrow)
                    out, size = [], 0
        done = fold.finish()
        if done:
            out.append(_message(*done))
        if out:
            yield _batch(out, arrow)

    return events.mapInArrow(run, schema)


def _message(conversation, role: str, text: str) -> tuple:
    formatted, a, b = render(role, text)
    return (conversation, formatted, a, b) if role == "assistant" else (conversation, formatted, 0, 0)


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(col, f.type) for col, f in zip(zip(*rows), arrow)], schema=arrow)


def _arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def read_back(formatted: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """conversation, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: what the rendered rows say, one row a conversation.

    Roles and texts are parsed out of `formatted` and unescaped. turns_sha256 is of
    role, line break, text, line break for each message; the loss columns are of what the loss
    ranges hold. Rows must come as `rendered` gives them: each conversation in
    one partition, its rows together and in order. Digests grow as rows stream
    by, so that no conversation is held whole.
    """
    kept = formatted.select(named(conversation), "formatted", "loss_from", "loss_to")
    schema = schema_with(formatted, [conversation], "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, begun, now = [], False, None
        for batch in batches:
            for c, text, a, b in zip(*(col.to_pylist() for col in batch.columns)):
                if not begun or c != now:
                    if begun:
                        out.append((now, turns, whole.hexdigest(), loss_chars, loss.hexdigest(), chars))
                    begun, now, turns, loss_chars, chars = True, c, 0, 0, 0
                    whole, loss = hashlib.sha256(), hashlib.sha256()
                for role, start, end in parse(text):
                    turns += 1
                    whole.update(f"{role}\n{unescape(text[start:end])}\n".encode())
                plain = unescape(text[a:b])
                loss_chars += len(plain)
                loss.update(plain.encode())
                chars += len(text)
            if len(out) > 1000:
                yield _batch(out, arrow)
                out = []
        if begun:
            out.append((now, turns, whole.hexdigest(), loss_chars, loss.hexdigest(), chars))
        if out:
            yield _batch(out, arrow)

    return kept.mapInArrow(run, schema)


def logged(turns: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conversation, turn, role, digest, row, seq, kind, text: an event log that ends in just these turns.

    Its messages are numbered by (turn, role, digest, row), its events by those and seq. Texts are streamed sentence
    by sentence. An assistant's turn has a draft of 24 characters that is
    regenerated, a user's one that is edited. Turns of equal number go by role, then by
    the text's MD5 digest; repeated rows are turns of their own.
    """
    rows = turns.select(named(conversation).alias("c"), named(turn).alias("turn"), F.coalesce(named(role).cast("string"), F.lit("")).alias("role"),
                        F.coalesce(named(text).cast("string"), F.lit("")).alias("t"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("pieces", F.split("t", r"(?<=[.\n])"))

    def event(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"))

    first, rest = F.element_at("pieces", 1), F.slice("pieces", 2, F.size("pieces"))
    opened, draft = event("open", F.lit("")), event("delta", F.substring("t", 1, 24))
    start = (
        F.when(F.col("role") == "assistant", F.array(opened, draft, event("regenerate", F.lit("")), event("delta", first)))
        .when(F.col("role") == "user", F.array(opened, draft, event("edit", first)))
        .otherwise(F.array(opened, event("delta", first)))
    )
    events = F.concat(start, F.transform(rest, lambda x: event("delta", x)))
    rows = rows.select("c", "turn", "role", F.unhex(F.md5("t")).alias("digest"), "row", F.posexplode(events).alias("seq", "event"))
    return rows.select(F.col("c").alias(conversation), "turn", "role", "digest", "row", F.col("seq").cast("long").alias("seq"), "event.kind", "event.text")


def format_turns(turns: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rendered messages of a table of turns, by way of its event log; see logged and rendered."""
    log = logged(turns, conversation=conversation, turn=turn, role=role, text=text)
    message = ("turn", "role", "digest", "row")
    return rendered(log, conversation=conversation, message=message, seq=(*message, "seq"))
