"""Chat formatting by event-sourced reconstruction.

A log holds, per conversation, events in sequence: ``delta`` appends to a message, ``edit`` replaces its text,
``regenerate`` clears it for the deltas that follow, ``retract`` removes it. The log is partitioned by conversation
and sorted by sequence, once; within that partitioning events are brought to their messages, and each message is
folded from its own events as a stream, rendered by one expression and read back into the conversation's digests.
A task holds one message at a time, whatever the length of a conversation; as one digest of one conversation is
sequential, a conversation is one task's work.

Nulls: a null text or role is empty, a null seq comes first, a null conv_id is a conversation of its own. Messages
stand in order of their first event. Equal rows of a table of turns, at one turn or at several, are messages of
their own. Messages whose last event is ``retract`` are left out. Empty logs give no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.llm.storage import map_batches, only

OPEN, SEPARATOR, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
#: Strings that chat models take as control; a backslash goes behind the first character of each in a text.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>")
_CONTROL_JAVA = "|".join(rf"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL)
_PIECE = re.compile(re.escape(OPEN) + "(.*?)" + re.escape(SEPARATOR) + "(.*?)" + re.escape(CLOSE), re.S)
#: Turns of a table of whole texts enter the log as deltas of at most so many characters.
DELTA_CHARS = 2000
#: What every message of such a log begins with; nothing of it may be left.
DRAFT = "draft </s> that goes"
#: Characters of messages that are gathered before they are passed on.
FLUSH_CHARS = 1 << 20


def escaped(text: Column) -> Column:
    """Doubles backslashes, then breaks every control string with one backslash."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, _CONTROL_JAVA, "$0\\\\")


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def log_of_turns(turns: DataFrame, delta_chars: int = DELTA_CHARS) -> DataFrame:
    """Reads a table (conv_id, turn, role, text) as a log (conv_id, seq, part, message, role, kind, text).

    Each row is a message of its own, numbered in the order of turn, role and text. It opens with a draft; what an
    assistant drafts is regenerated, what others draft is edited, and both only after the next message has opened.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / delta_chars)).cast("int")
    written = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring("text", i * delta_chars + 1, F.lit(delta_chars)))
    assistant = F.col("role") == "assistant"

    def event(after: int, part: Column, kind: Column, text: Column) -> Column:
        return F.struct((F.col("message") * 4 + after).alias("seq"), part.cast("int").alias("part"), kind.alias("kind"), text.alias("text"))

    draft = event(0, F.lit(0), F.lit("delta"), F.lit(DRAFT))
    again = F.when(assistant, F.array(event(5, F.lit(0), F.lit("regenerate"), F.lit("")))).otherwise(F.array().cast("array<struct<seq:bigint,part:int,kind:string,text:string>>"))
    final = F.transform(written, lambda x, i: event(5, i + 1, F.when(assistant | (i > 0), F.lit("delta")).otherwise(F.lit("edit")), x))
    events = F.concat(F.array(draft), again, final)
    return rows.withColumn("message", place.cast("long")).select("conv_id", "message", "role", F.explode(events).alias("e")).select("conv_id", "e.seq", "e.part", "message", "role", "e.kind", "e.text")


_MESSAGE = "conv_id long, place long, role string, text string"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events in order of conversation, message and sequence; holds the pieces of one message."""
    names = ("conv_id", "place", "role", "text")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
    key, role, pieces, kind, out = None, "", [], None, []

    def flushed():
        batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)
        out.clear()
        return batch

    for batch in batches:
        held = 0
        for conv, place, of, kind_, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "kind", "text"))):
            if key != (conv, place):
                if key is not None and kind != "retract":
                    out.append((*key, role, "".join(pieces)))
                    held += len(out[-1][3])
                key, role, pieces = (conv, place), of, []
                if held > FLUSH_CHARS:
                    yield flushed()
                    held = 0
            kind = kind_
            if kind in ("edit", "regenerate"):
                pieces = []
            if kind in ("edit", "delta"):
                pieces.append(text)
        if out:
            yield flushed()
    if key is not None and kind != "retract":
        out.append((*key, role, "".join(pieces)))
        yield flushed()


def reconstruct(log: DataFrame) -> DataFrame:
    """Folds a log (conv_id, seq, part, message, role, kind, text) into messages: conv_id, place (of the first event), role, text.

    The rows of a conversation stand in one partition, in order of place; ties of seq and part go by message and kind.
    """
    events = log.select("conv_id", "seq", "part", "message", F.coalesce("role", F.lit("")).alias("role"), "kind", F.coalesce("text", F.lit("")).alias("text"))
    by_sequence = Window.partitionBy("conv_id").orderBy(F.col("seq").asc_nulls_first(), F.col("part").asc_nulls_first(), "message", "kind", "text")
    numbered = events.withColumn("at", F.row_number().over(by_sequence).cast("long"))
    placed = numbered.withColumn("place", F.min("at").over(Window.partitionBy("conv_id", "message")))
    ordered = placed.sortWithinPartitions("conv_id", "place", "at")
    return map_batches(ordered.select(F.col("conv_id").cast("long").alias("conv_id"), "place", "role", "kind", "text"), _fold, _MESSAGE)


def render(messages: DataFrame) -> DataFrame:
    """Adds ``formatted``, the message's piece of the output, and the code points [mask_start, mask_end) in it that carry loss."""
    role, text = escaped(F.col("role")), escaped(F.col("text"))
    piece = F.concat(F.lit(OPEN), role, F.lit(SEPARATOR), text, F.lit(CLOSE))
    start = F.when(F.col("role") == "assistant", F.length(role) + len(OPEN) + len(SEPARATOR)).cast("long")
    return messages.withColumn("formatted", piece).withColumn("mask_start", start).withColumn("mask_end", start + F.length(text))


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads formatted pieces back, in order; holds one conversation's digests and counts, never its texts."""
    names = [x.split()[0] for x in _DIGEST.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    current, state, out = object(), None, []

    def closed():
        n, turns, loss_chars, loss, chars = state
        return (current, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)

    for batch in batches:
        cols = batch.to_pydict()
        for conv, piece, start, end in zip(cols["conv_id"], cols["formatted"], cols["mask_start"], cols["mask_end"]):
            if state is None or conv != current:
                if state is not None:
                    out.append(closed())
                current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            found = _PIECE.fullmatch(piece)
            role, text = unescaped(found[1]), unescaped(found[2])
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            if start is not None:
                under = unescaped(piece[start:end])
                state[2] += len(under)
                state[3].update(under.encode())
            state[4] += len(piece)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)
            out = []
    if state is not None:
        row = closed()
        yield pa.RecordBatch.from_arrays([pa.array([row[i]], k) for i, k in enumerate(kinds)], names)


def conversation_digests(rendered: DataFrame) -> DataFrame:
    """One row per conversation, read back from the formatted pieces, which stand as ``reconstruct`` leaves them."""
    return map_batches(rendered.select("conv_id", "formatted", "mask_start", "mask_end"), _digests, _DIGEST)


def planted(spark: SparkSession) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")


def formatted_conversations(turns: DataFrame) -> DataFrame:
    """All conversations of a table of turns and conversation -7, formatted and read back."""
    rows = only(turns, "conv_id", "turn", "role", "text").unionByName(planted(turns.sparkSession))
    return conversation_digests(render(reconstruct(log_of_turns(rows))))
