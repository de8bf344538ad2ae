"""Operator 7, chat formatting by columnar byte assembly.

A turn becomes `<|im_start|>` role newline text `<|im_end|>` newline. In texts and roles every `<` that is followed by backslashes (none, or
more) and a `|` gets one more backslash, so no control string can stand in a text, and taking one backslash away restores it. In roles
a backslash becomes two and a newline becomes backslash n first, so a header ends at its newline.

For a batch of turns numpy computes the segments' lengths, their cumulative offsets and the scatter indices, and copies headers, contents
and ends into one preallocated buffer, which becomes an Arrow column without another copy. The loss mask is, for each turn, where
its text lies in the formatted turn if the assistant speaks, as code points.

`formatted` returns a row a turn, with its place in its conversation's output; nothing is gathered. `conversations` streams turns that are
sorted by conversation, so a very long conversation is never held whole; with `texts=True` it joins them.

Defined results: a null text is empty and a null role is an empty role; null turns sort first and ties go by role, then text; a null
conv_id is a conversation of its own; repeated rows are turns like others; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, load, prepare, ranges

START, END = "<|im_start|>", "<|im_end|>\n"
SPEAKER = "assistant"


def escape(column: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(column, r"<(\\*)\|", r"<\\\1|")


def escape_role(column: pa.Array) -> pa.Array:
    return escape(pc.replace_substring(pc.replace_substring(column, "\\", "\\\\"), "\n", "\\n"))


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def _length(column: pa.Array) -> np.ndarray:
    return pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)


def assemble(role: pa.Array, text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Formatted turns, and for each where its (escaped) text begins and ends, in code points."""
    role, text = escape_role(role), escape(text)
    n = len(role)
    fixed = [np.frombuffer(x.encode(), np.uint8) for x in (START, "\n", END)]
    (r, r_at), (t, t_at) = bytes_of(role), bytes_of(text)
    # Segments of a turn: mark, role, newline, text, end.
    lengths = np.empty((n, 5), np.int64)
    lengths[:, 0], lengths[:, 1], lengths[:, 2], lengths[:, 3], lengths[:, 4] = len(fixed[0]), np.diff(r_at), 1, np.diff(t_at), len(fixed[2])
    ends = np.cumsum(lengths.reshape(-1)).reshape(n, 5)
    begin = ends - lengths
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for k, x in ((0, fixed[0]), (2, fixed[1]), (4, fixed[2])):
        out[(begin[:, k, None] + np.arange(len(x))).reshape(-1)] = np.tile(x, n)
    out[ranges(begin[:, 1], lengths[:, 1])] = r
    out[ranges(begin[:, 3], lengths[:, 3])] = t
    at = np.concatenate([begin[:, 0], ends[-1:, -1]]) if n else np.zeros(1, np.int64)
    column = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(out)])
    lo = len(START) + _length(role) + 1
    return column, lo, lo + _length(text)


def _filled(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(name).fill_null("")


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, formatted, loss_start, loss_end) of each turn (conv_id, turn, role, text); loss_end is loss_start where nothing is learnt."""
    prepare(turns.sparkSession)

    def run(batches):
        for batch in batches:
            column, lo, hi = assemble(_filled(batch, "role"), _filled(batch, "text"))
            speaks = pc.equal(_filled(batch, "role"), SPEAKER).to_numpy(zero_copy_only=False)
            yield pa.record_batch([batch.column("conv_id"), batch.column("turn"), batch.column("role"), batch.column("text"), column.cast(pa.string()), pa.array(lo), pa.array(np.where(speaks, hi, lo))], names=["conv_id", "turn", "role", "text", "formatted", "loss_start", "loss_end"])

    plain = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "conv_id long, turn long, role string, text string, formatted string, loss_start long, loss_end long")


def _ordered(rows: DataFrame) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("conv_id", "turn", "role", F.col("text").alias("sort_text"), "formatted", "loss_start", "loss_end").repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "sort_text").select("conv_id", "formatted", "loss_start", "loss_end")


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) of each conversation: its whole output, and the code points under the loss mask."""

    def run(batches):
        own, parts, spans, chars = None, [], [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end"))):
                if own is None or own[0] != row[0]:
                    if own is not None:
                        yield _one(own[0], parts, spans)
                    own, parts, spans, chars = (row[0],), [], [], 0
                parts.append(row[1])
                if row[3] > row[2]:
                    spans.append({"start": chars + row[2], "end": chars + row[3]})
                chars += len(row[1])
        if own is not None:
            yield _one(own[0], parts, spans)

    return _ordered(formatted(turns)).mapInArrow(run, "conv_id long, formatted string, loss_spans array<struct<start: long, end: long>>")


def _one(conv_id, parts, spans) -> pa.RecordBatch:
    return pa.record_batch([pa.array([conv_id], pa.int64()), pa.array(["".join(parts)]), pa.array([spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["conv_id", "formatted", "loss_spans"])


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn in formatted output: the inverse of formatting."""
    out, at = [], 0
    while at < len(text):
        if not text.startswith(START, at):
            raise ValueError(f"no turn begins at {at}")
        line, end = text.index("\n", at), text.index(END, at)
        out.append((unescape_role(text[at + len(START) : line]), unescape(text[line + 1 : end])))
        at = end + len(END)
    return out


def digests(rows: DataFrame) -> DataFrame:
    """What `formatted` rows hold, read back from the formatted text and mask alone, by conversation."""

    def run(batches):
        own, out = None, []

        def done():
            out.append((own["id"], own["n"], own["turns"].hexdigest(), own["loss_chars"], own["loss"].hexdigest(), own["chars"]))

        for batch in batches:
            for conv_id, text, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end"))):
                if own is None or own["id"] != conv_id:
                    if own is not None:
                        done()
                    own = {"id": conv_id, "n": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0}
                for role, said in parse(text):
                    own["turns"].update(f"{role}\n{said}\n".encode())
                    own["n"] += 1
                learnt = unescape(text[lo:hi])
                own["loss"].update(learnt.encode())
                own["loss_chars"] += len(learnt)
                own["chars"] += len(text)
            yield _digest_rows(out)
            out.clear()
        if own is not None:
            done()
        yield _digest_rows(out)

    return _ordered(rows).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = load(spark, sf_dir, "conversations").select(*(F.col(c).cast(t).alias(c) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))))
    return digests(formatted(turns.unionByName(extra)))
