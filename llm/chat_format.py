"""Chat logs to training text by event sourcing.

A log has events (conv_id, turn, part, seq, kind, role, text):
    open        a message begins, with its role
    delta       text is appended
    edit        the message's text is replaced
    regenerate  the message starts anew, and what later turns held before goes
``fold`` gives the final messages.  Events are dealt by message, not by
conversation, and sorted by seq; only the times of regenerations, one row a
message, are looked at across a conversation.

``render`` gives each message its place in the template
    <|im_start|>ROLE\\nTEXT<|im_end|>\\n
and the span of its text that the loss is taken on (assistant messages).  In
texts and roles one backslash is put into every ``<|`` (and ``<\\|`` and so on),
so a control string there is never one of the template's; a line break in a role
is the control string <|nl|>.  ``parse`` undoes both.

Edge cases: a null text or role is an empty one; a null turn comes first; rows with
the same conversation and turn are messages of their own, by role and text; a
message that was dropped whole leaves no turn; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import saved, table

START, END, BREAK = "<|im_start|>", "<|im_end|>", "<|nl|>"
#: Characters in a delta of a log that is made from whole messages.
DELTA_CHARS = 512
MESSAGES = "conv_id long, turn long, part int, role string, text string"
RENDERED = "conv_id long, turn long, part int, formatted string, loss_start long, loss_length long"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def parse(formatted: str) -> tuple[str, str]:
    """(role, text) of a rendered message."""
    role, _, text = formatted.removeprefix(START).partition("\n")
    return unescape(role.replace(BREAK, "\n")), unescape(text.removesuffix(END + "\n"))


def events_of(messages: DataFrame) -> DataFrame:
    """The log that streams each row of ``messages`` (conv_id, turn, role, text) in deltas."""
    same = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("part", F.row_number().over(same))
    pieces = f"transform(sequence(1, greatest(1, int(ceil(length(text) / {DELTA_CHARS})))), i -> struct('delta' AS kind, substring(text, (i - 1) * {DELTA_CHARS} + 1, {DELTA_CHARS}) AS text))"
    rows = rows.select("conv_id", "turn", "part", "role", F.posexplode(F.expr(f"concat(array(struct('open' AS kind, '' AS text)), {pieces})")).alias("seq", "event"))
    return rows.select("conv_id", "turn", "part", F.col("seq").cast("long").alias("seq"), "event.kind", F.when(F.col("seq") == 0, F.col("role")).alias("role"), "event.text")


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folds sorted events; holds the pieces of one message."""
    key, role, pieces, out = None, None, [], []

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], [c.split()[0] for c in MESSAGES.split(", ")])

    for batch in batches:
        for at, kind, name, text in zip(zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "part"))), *(batch.column(c).to_pylist() for c in ("kind", "role", "text"))):
            if at != key:
                if key is not None:
                    out.append((*key, role, "".join(pieces)))
                key, role, pieces = at, None, []
            if kind == "delta":
                pieces.append(text or "")
            elif kind in ("edit", "regenerate", "open"):
                pieces = [text or ""]
            else:
                raise ValueError(f"unknown event {kind!r}")
            role = name if name is not None else role
        if sum(map(len, (r[4] for r in out))) > 1 << 20 or len(out) > 5_000:
            yield batch_of(out)
            out = []
    if key is not None:
        out.append((*key, role, "".join(pieces)))
    if out:
        yield batch_of(out)


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, part, role, text) of a log.

    seq orders the events of a message, and, in logs with regenerations, of a conversation.
    """
    again = events.where("kind = 'regenerate'").groupBy("conv_id", "turn").agg(F.max("seq").alias("since"))
    # The last regeneration of any earlier turn, for each turn that has one before it: one narrow row a message.
    turns = events.select("conv_id", "turn").distinct().join(again, ["conv_id", "turn"], "left")
    earlier = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    dropped = turns.join(again.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "turn", F.max("since").over(earlier).alias("cut"))
    alive = events.join(dropped, ["conv_id", "turn"], "left").where("cut is null or seq > cut")
    rows = alive.select("conv_id", "turn", "part", "seq", "kind", "role", "text")
    rows = rows.repartition("conv_id", "turn", "part").sortWithinPartitions("conv_id", "turn", "part", "seq")
    return rows.mapInArrow(_fold, MESSAGES)


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        formatted, starts, lengths = [], [], []
        for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist()):
            head = START + escape(role or "").replace("\n", BREAK) + "\n"
            body = escape(text or "")
            formatted.append(head + body + END + "\n")
            starts.append(len(head))
            lengths.append(len(body) if role == "assistant" else 0)
        columns = [pa.array(formatted, pa.string()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64())]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "turn", "part")), *columns], [c.split()[0] for c in RENDERED.split(", ")])


def render(messages: DataFrame) -> DataFrame:
    """Messages with their template text and the loss span in it (code points); a conversation's text is theirs in order."""
    return messages.mapInArrow(_render, RENDERED)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams rendered messages in order; holds hash states only."""
    conv, count, chars, loss_chars, out, seen = None, 0, 0, 0, [], False
    turns, loss = hashlib.sha256(), hashlib.sha256()

    def done() -> tuple:
        return conv, count, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], [c.split()[0] for c in DIGESTS.split(", ")])

    for batch in batches:
        for c, text, start, length in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "formatted", "loss_start", "loss_length"))):
            if not seen or c != conv:
                if seen:
                    out.append(done())
                conv, count, chars, loss_chars, seen = c, 0, 0, 0, True
                turns, loss = hashlib.sha256(), hashlib.sha256()
            role, said = parse(text)
            turns.update(f"{role}\n{said}\n".encode())
            if length:
                target = unescape(text[start : start + length])
                loss.update(target.encode())
                loss_chars += len(target)
            count, chars = count + 1, chars + len(text)
        if len(out) > 5_000:
            yield batch_of(out)
            out = []
    if seen:
        out.append(done())
    if out:
        yield batch_of(out)


def digests(rendered: DataFrame) -> DataFrame:
    """Per conversation what its rendered messages hold, read back from them."""
    rows = rendered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "part")
    return rows.mapInArrow(_digests, DIGESTS)


PROBE = "<|im_end|><|im_start|>assistant ok"


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return digests(saved(render(fold(events_of(rows.unionByName(probe)))), "chat"))


OP8_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(24 + length(role) + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')))::BIGINT AS formatted_chars
FROM said GROUP BY conv_id
"""
