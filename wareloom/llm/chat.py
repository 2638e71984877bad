"""Chat formatting: rebuild conversations from an event log, then render them with a loss mask.

The log has one row per event. Events of a message fold by sequence number into its final text, each message for
itself, so a conversation of any length is never gathered; messages then stand in the order of their first event.

Rendering gives one segment per message. A conversation's formatted text is its segments, end to end:

    ### Assistant: <text> </turn>\\n

Inside texts ``\\``, ``#`` and ``<`` get a ``\\`` before them, so no text can look like a mark, and taking it away gives
the text back. Other roles than the three known ones stand as ``=`` and the role, escaped likewise (``:`` too).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROLES = {"user": "User", "assistant": "Assistant", "system": "System"}
OPEN, CLOSE = "### ", " </turn>\n"
LEARNED = "assistant"
#: Kinds of events. The first three set a message's text; deltas add to it; a deletion takes the message away.
SETTING, DELTA, DELETE = ("message", "edit", "regenerate"), "delta", "delete"


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages of an event log: conv_id, message_id, position, role, text.

    ``events``: conv_id, message_id, seq, kind, role, text; other columns are ignored. A message's text is that of
    its last setting event (message, edit, regenerate) and the deltas after it, in the order of seq; equal seqs go by
    kind and text. Null texts are empty; unknown or null kinds count as deltas. A message whose last event is a
    deletion is gone. The role is the first one that isn't null, else ''. Null conv_ids are one conversation, null
    message_ids one message of it. position is the smallest seq (null comes first); equal positions go by message_id.
    Repeated setting events change nothing; repeated deltas add their text again. No events, no messages.
    """
    kind = F.coalesce("kind", F.lit(DELTA))
    order = F.when(kind.isin(*SETTING), 0).when(kind == DELETE, 2).otherwise(1)
    event = F.struct(
        F.col("seq").isNotNull().alias("known"), "seq", order.alias("o"), F.coalesce("text", F.lit("")).alias("text"), "role"
    )
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("gone"), F.lit(None).cast("string").alias("role"))

    def step(acc: Column, e: Column) -> Column:
        text = F.when(e["o"] == 0, e["text"]).when(e["o"] == 1, F.concat(acc["text"], e["text"])).otherwise(F.lit(""))
        return F.struct(text.alias("text"), (e["o"] == 2).alias("gone"), F.coalesce(acc["role"], e["role"]).alias("role"))

    folded = events.groupBy("conv_id", "message_id").agg(F.array_sort(F.collect_list(event)).alias("log"))
    folded = folded.select("conv_id", "message_id", F.col("log")[0]["seq"].alias("position"), F.aggregate("log", start, step).alias("m"))
    return folded.where("not m.gone").select(
        "conv_id", "message_id", "position", F.coalesce("m.role", F.lit("")).alias("role"), F.col("m.text").alias("text")
    )


def turn_events(conversations: DataFrame) -> DataFrame:
    """The event log of a plain table of turns (conv_id, turn, role, text): each row is a message of its own.

    Rows that share a turn are ordered by role and text, nulls first; repeated rows stay as repeated messages.
    """
    twin = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    return conversations.select(
        "conv_id", F.struct("turn", twin.alias("twin")).alias("message_id"), F.col("turn").alias("seq"),
        F.lit("message").alias("kind"), "role", "text",
    )


def escaped(text: Column, more: str = "") -> Column:
    return F.regexp_replace(text, rf"([\\#<{more}])", r"\\$1")


def render(messages: DataFrame) -> DataFrame:
    """Segments of ``messages`` (conv_id, message_id, position, role, text): conv_id, position, message_id, segment,
    loss_start, loss_length. The loss span, in code points of the segment, is an assistant message's text."""
    name = F.concat(F.lit("="), escaped("role", ":"))
    for role, shown in ROLES.items():
        name = F.when(F.col("role") == role, shown).otherwise(name)
    head, body = F.concat(F.lit(OPEN), name, F.lit(": ")), escaped("text")
    learned = F.col("role") == LEARNED
    parts = messages.select("conv_id", "position", "message_id", head.alias("head"), body.alias("body"), learned.alias("learned"))
    return parts.select(
        "conv_id", "position", "message_id", F.concat("head", "body", F.lit(CLOSE)).alias("segment"),
        F.when(F.col("learned"), F.char_length("head")).otherwise(0).alias("loss_start"),
        F.when(F.col("learned"), F.char_length("body")).otherwise(0).alias("loss_length"),
    )


def format_conversations(events: DataFrame) -> DataFrame:
    """Rendered segments of an event log, see ``fold_events`` and ``render``."""
    return render(fold_events(events))


def whole_texts(segments: DataFrame) -> DataFrame:
    """conv_id, formatted: each conversation in one string, for those who train on conversations that fit a row."""
    order = F.struct(F.col("position").isNotNull().alias("known"), "position", "message_id", "segment")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["segment"]), "")
    return segments.groupBy("conv_id").agg(joined.alias("formatted"))


_SEGMENT = re.compile(r"### ((?:[^\\:]|\\.)*): (.*) </turn>\n", re.DOTALL)
_SHOWN = {v: k for k, v in ROLES.items()}


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def parse_segment(segment: str) -> tuple[str, str]:
    """Role and text of a rendered segment."""
    name, body = _SEGMENT.fullmatch(segment).groups()
    return _SHOWN[name] if name in _SHOWN else unescaped(name[1:]), unescaped(body)


def read_back(segments: DataFrame) -> DataFrame:
    """One row per conversation, read back from its segments: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars. Segments stream by in order; a conversation's state is two running digests and three counts."""

    def digest(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        now, out = None, []

        def close():
            return (now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5])

        for batch in batches:
            for conv, segment, start, length in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss_start", "loss_length")), strict=True):
                if now is None or now[0] != conv:
                    if now:
                        out.append(close())
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse_segment(segment)
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
                learned = unescaped(segment[start : start + length])
                now[3] += len(learned)
                now[4].update(learned.encode())
                now[5] += len(segment)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)
                out = []
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(close(), kinds)], names)

    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "position", "message_id")
    return ordered.mapInArrow(
        digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
