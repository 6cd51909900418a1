"""Chat formatting from event logs.

A log has events (conv_id, seq, kind, turn, role, text). Partitioned by conversation and sorted by sequence they are
folded into final messages: ``message`` and ``edit`` put a turn's text, ``delta`` appends to it, ``regenerate`` empties
a turn and drops the turns after it, which later events may fill anew. The fold is two windows: an event counts unless
a later event resets its turn or a later regeneration of a lower turn drops it.

Messages are rendered as ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside a text or role every ``<``, backslashes, ``|``
gets one backslash more, so a control string never appears there, and taking one away gives the text back. A role
spells a backslash as ``\\e`` and a line feed as ``\\n``.

A formatted conversation is one row for each message: its segment, where it starts, and the span under the loss mask
(the escaped text of an assistant). The segments in order are the conversation. No conversation is gathered in one
value; sorted rows stream through digests.

Cases: null texts and roles are empty, a null kind is ``message``, null turns come first and are one turn. Events of
equal sequence go by kind (message, edit, regenerate, delta), turn and text. Repeated events of a turn apply again.
Other columns are not used. An empty log gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
KINDS = ("message", "edit", "regenerate", "delta")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\e")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\e"), F.lit("\\"))


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the final messages of each log; the last role that an event of the turn names."""
    kind = F.coalesce(F.col("kind"), F.lit("message"))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)
    ordered = Window.partitionBy("conv_id").orderBy("seq", "_rank", "turn", "text")
    later = Window.partitionBy("conv_id").orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, -1)
    of_turn = Window.partitionBy("conv_id", "turn")
    place = F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63)))  # a null turn stands before all others
    placed = (events.select("conv_id", "seq", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), kind.alias("_kind"), rank.alias("_rank"))
              .withColumn("_at", F.row_number().over(ordered))
              .withColumn("_dropped", F.min(F.when(F.col("_kind") == "regenerate", place)).over(later))
              .where(F.col("_dropped").isNull() | (place <= F.col("_dropped")))
              .withColumn("role", F.max_by("role", F.when(F.col("role").isNotNull(), F.col("_at"))).over(of_turn))
              .withColumn("_reset", F.max(F.when(F.col("_kind") != "delta", F.col("_at"))).over(of_turn))
              .where("_reset is null or _at >= _reset"))
    said = F.array_sort(F.collect_list(F.struct("_at", F.when(F.col("_kind") == "regenerate", "").otherwise(F.col("text")).alias("text"))))
    return placed.groupBy("conv_id", "turn").agg(
        F.coalesce(F.max("role"), F.lit("")).alias("role"),
        F.array_join(F.transform(said, lambda s: s["text"]), "").alias("text"))


def render(messages: DataFrame, assistant: str = "assistant") -> DataFrame:
    """(conv_id, turn, position, segment, start, mask_start, mask_end): offsets in code points of the conversation's
    formatted text; the mask is null outside the assistant's turns."""
    along = Window.partitionBy("conv_id").orderBy("turn")
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    rows = (messages.withColumn("_head", F.length(head)).withColumn("_body", escape(F.col("text")))
            .withColumn("segment", F.concat(head, F.col("_body"), F.lit(END + "\n"))))
    start = F.sum(F.length("segment").cast("long")).over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.length("segment")
    mine = F.col("role") == assistant
    return (rows.withColumn("position", F.row_number().over(along)).withColumn("start", start)
            .withColumn("mask_start", F.when(mine, F.col("start") + F.col("_head")))
            .withColumn("mask_end", F.col("mask_start") + F.length("_body"))
            .select("conv_id", "turn", "position", "segment", "start", "mask_start", "mask_end"))


def read_back(segments: DataFrame) -> DataFrame:
    """Role, text and masked text of each segment, from the segment and its mask alone."""
    part = r"(?s)^<\|im_start\|>([^\n]*)\n(.*)<\|im_end\|>\n$"
    masked = F.substring("segment", (F.col("mask_start") - F.col("start") + 1).cast("int"), (F.col("mask_end") - F.col("mask_start")).cast("int"))
    return (segments.withColumn("role", unescape_role(F.regexp_extract("segment", part, 1)))
            .withColumn("text", unescape(F.regexp_extract("segment", part, 2)))
            .withColumn("masked", F.when(F.col("mask_start").isNotNull(), unescape(masked))))


DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def digests(segments: DataFrame) -> DataFrame:
    """One row a conversation: hashes of what is read back, fed turn by turn in order."""
    rows = read_back(segments).select("conv_id", "position", "role", "text", "masked", F.length("segment").alias("n")).sortWithinPartitions("conv_id", "position")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(conv, turns, said, loss, chars, size) -> tuple:
            return conv, turns, said.hexdigest(), chars, loss.hexdigest(), size

        def batch_of(rows_: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = [c.split()[0] for c in DIGEST.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows_], k) for i, k in enumerate(kinds)], names)

        now = None
        for batch in batches:
            done = []
            for conv, _, role, text, masked, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        done.append(row(*now))
                    now = [conv, 0, hashlib.sha256(), hashlib.sha256(), 0, 0]
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if masked is not None:
                    now[3].update(masked.encode("utf-8", "surrogatepass"))
                    now[4] += len(masked)
                now[5] += n
            yield batch_of(done)
        if now is not None:
            yield batch_of([row(*now)])

    return rows.mapInArrow(run, DIGEST)


def as_events(conversations: DataFrame) -> DataFrame:
    """Plain turns as a log: every row is the message of its own turn, in the order of turn, role and text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return (conversations.withColumn("seq", F.row_number().over(order))
            .select("conv_id", "seq", F.lit("message").alias("kind"), F.col("seq").alias("turn"), "role", "text"))
