"""Chat texts from logs of events: fold the events of each message, then render the messages as marked turns.

A log has rows (conv_id, message, seq, kind, role, text). ``delta`` adds its text to the message, ``edit`` replaces the text, and ``regenerate``
clears it, so that later deltas write it anew; ``delete`` takes the message away. Events are dealt by conversation and message - one very long
conversation is many small groups - sorted by ``seq``, and folded in one pass that holds one message at a time. The messages of a
conversation are in the order of their first events.

A turn is ``### role: text</turn>`` and a line break. Inside roles and texts a backslash goes before every backslash, ``###`` and ``</turn>``,
and in roles also before every ``:``, so a turn ends only where the template ends it and the texts can be read back exactly (:func:`read_turn`).

Defined results: null roles and texts are empty; unknown kinds count as ``delta``; events with equal ``seq`` go by kind and text; messages with
equal first events go by role, text and message; a message with no text is a turn with an empty text; null conversations are one conversation;
an empty log gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters in a streamed delta of :func:`log_of`.
DELTA_CHARS = 200
_TURN = re.compile(r"### ((?:\\.|[^\\:])*): ((?:\\.|[^\\<]|<(?!/turn>))*)</turn>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def fold(log: DataFrame) -> DataFrame:
    """(conv_id, first_seq, message, role, text) of every message of a log."""
    rows = log.select(
        "conv_id", "message", F.col("seq").cast("long").alias("seq"), F.coalesce("kind", F.lit("delta")).alias("kind"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    dealt = rows.repartition("conv_id", "message").sortWithinPartitions("conv_id", "message", "seq", "kind", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, role, parts, there = None, 0, "", [], False
        done: list[tuple] = []
        for batch in batches:
            for conv, message, seq, kind, who, text in zip(*(column.to_pylist() for column in batch.columns)):
                if key != (conv, message):
                    if there:
                        done.append((key[0], first, key[1], role, "".join(parts)))
                    key, first, role, parts, there = (conv, message), seq, who, [], True
                role = who or role
                if kind == "delete":
                    there = False
                elif kind == "regenerate":
                    parts = []
                elif kind == "edit":
                    parts = [text]
                else:
                    parts.append(text)
            if done:
                yield pa.RecordBatch.from_arrays(_columns(done), names=_NAMES)
                done = []
        if there:
            yield pa.RecordBatch.from_arrays(_columns([(key[0], first, key[1], role, "".join(parts))]), names=_NAMES)

    return dealt.mapInArrow(run, "conv_id long, first_seq long, message long, role string, text string")


_NAMES = ["conv_id", "first_seq", "message", "role", "text"]


def _columns(rows: list[tuple]) -> list[pa.Array]:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return [pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds)]


def escaped(text: Column, also: str = "") -> Column:
    return F.regexp_replace(text, f"(\\\\|###|</turn>{'|' + also if also else ''})", "\\\\$1")


def render(messages: DataFrame) -> DataFrame:
    """The messages with ``turn``, their text in the template; the formatted conversation is its turns end to end."""
    turn = F.concat(F.lit("### "), escaped(F.col("role"), ":"), F.lit(": "), escaped(F.col("text")), F.lit("</turn>\n"))
    return messages.withColumn("turn", turn)


def read_turn(turn: str) -> tuple[str, str]:
    """(role, text) of a rendered turn."""
    found = _TURN.fullmatch(turn)
    if not found:
        raise ValueError(f"not a turn: {turn[:80]!r}")
    return _ESCAPED.sub(r"\1", found[1]), _ESCAPED.sub(r"\1", found[2])


def read_back(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all read from the rendered turns.

    The turns of a conversation pass one after the other through running digests; none is kept.
    """
    rows = turns.select("conv_id", "first_seq", "role", "text", "message", "turn")
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "first_seq", "role", "text", "message").select("conv_id", "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, n, chars, loss_chars, every, loss = None, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
        done: list[tuple] = []
        for batch in batches:
            for now, turn in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if n and now != conv:
                    done.append((conv, n, every.hexdigest(), loss_chars, loss.hexdigest(), chars))
                    n, chars, loss_chars, every, loss = 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                conv = now
                role, text = read_turn(turn)
                n, chars = n + 1, chars + len(turn)
                every.update(f"{role}\n{text}\n".encode())
                if role == "assistant":
                    loss_chars += len(text)
                    loss.update(text.encode())
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(_DIGESTS, row)) for row in done], schema=_DIGEST_TYPES)
                done = []
        if n:
            yield pa.RecordBatch.from_pylist([dict(zip(_DIGESTS, (conv, n, every.hexdigest(), loss_chars, loss.hexdigest(), chars)))], schema=_DIGEST_TYPES)

    return dealt.mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


_DIGESTS = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
_DIGEST_TYPES = pa.schema(list(zip(_DIGESTS, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))))


def log_of(conversations: DataFrame, chars: int = DELTA_CHARS) -> DataFrame:
    """A table of finished turns (conv_id, turn, role, text) as the log that led to it.

    Assistant turns are streamed: a first try of one delta, a regeneration, then deltas of ``chars`` characters. The others are typed: a
    delta, then an edit with the whole text.
    """
    rows = conversations.select(
        "conv_id", "turn", F.monotonically_increasing_id().alias("message"), "role", F.coalesce("text", F.lit("")).alias("text")
    )
    starts = F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), F.lit(chars))
    deltas = F.transform(starts, lambda at: F.struct(F.lit("delta").alias("kind"), F.substring(F.col("text"), at, F.lit(chars)).alias("text")))

    def event(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"))

    begin = F.substring("text", 1, chars)
    streamed = F.concat(F.array(event("delta", begin), event("regenerate", F.lit(""))), deltas)
    typed = F.array(event("delta", begin), event("edit", F.col("text")))
    events = rows.select("*", F.posexplode(F.when(F.col("role") == "assistant", streamed).otherwise(typed)).alias("k", "event"))
    seq = F.coalesce(F.col("turn"), F.lit(-1)) * F.lit(1 << 24) + F.col("k")
    return events.select("conv_id", "message", seq.alias("seq"), "event.kind", "role", "event.text")
