"""Operator 8, token-ID output: Arrow stream files of fixed-size-list batches.

Documents are range-partitioned and sorted by doc_id (ties by text), and each partition becomes Arrow IPC stream
files of about FILE_IDS ids (one document more at most), so rows of one doc_id are no single file. Record batches have three columns: `ids`
fixed_size_list<uint16 or uint32>[seq_len], `mask` fixed_size_list<bool>[seq_len] (false in the padding of the last sequence) and `ends`
list<struct<doc_id, end>>, the documents that end in a sequence. Sequences have equal length, so sequence k of a mapped file lies at a fixed place
of the ids and mask buffers of batch k div BATCH. `SequenceFile` finds the batches by their headers alone and hands out views without
copying: ids as numbers, a mask as its packed bits.

Files are written by Spark's own writer and commit protocol to any file system that Spark can write, one row a file;
the writer adds one newline, which stands behind the stream's end mark, where Arrow's readers don't look. A task that
is lost with its executor is run again and its half-written file never appears.

Defined results: null text is empty and gets only the end id; a null doc_id sorts first; rows with equal doc_id are
ordered by text; extra columns are ignored; an empty table gives no files and no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, load, new_path, prepare, text_or_empty
from .tokens import encoder, vocabulary

SEQ_LEN, END_ID = 1024, 0
#: Sequences in a record batch; bytes of text in a range of doc_ids, about; ids at which a file ends, whatever the range holds.
BATCH, FILE_TEXT, FILE_IDS = 1024, 12 << 20, 4 << 20
INDEX = "file_index long, ordinal long, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def stream_bytes(docs: list[tuple[int | None, np.ndarray]], seq_len: int, wide: bool, meta: dict[str, str]) -> bytes:
    """An Arrow stream of the documents' ids (each with its end id), in the given order."""
    kind = pa.uint32() if wide else pa.uint16()
    lengths = np.array([len(x) for _, x in docs], np.int64)
    flat = np.concatenate([x for _, x in docs]).astype(np.uint32 if wide else np.uint16) if docs else np.zeros(0, np.uint16)
    n_seq = -(-len(flat) // seq_len)
    mask = np.zeros(n_seq * seq_len, bool)
    mask[: len(flat)] = True
    flat = np.concatenate([flat, np.zeros(n_seq * seq_len - len(flat), flat.dtype)])
    ends = np.cumsum(lengths)
    cut = np.searchsorted(ends, np.arange(n_seq + 1) * seq_len, side="right")
    cut[0] = 0
    ids = pa.array([d for d, _ in docs], pa.int64())
    schema = pa.schema([("ids", pa.list_(kind, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len)), ("ends", pa.list_(pa.struct([("doc_id", pa.int64()), ("end", pa.int64())])))], metadata=meta)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        for a in range(0, n_seq, BATCH):
            b = min(n_seq, a + BATCH)
            x, y = cut[a], cut[b]
            done = pa.StructArray.from_arrays([ids[x:y], pa.array(ends[x:y])], names=["doc_id", "end"])
            out.write_batch(pa.record_batch([
                pa.FixedSizeListArray.from_arrays(pa.array(flat[a * seq_len : b * seq_len], kind), seq_len),
                pa.FixedSizeListArray.from_arrays(pa.array(mask[a * seq_len : b * seq_len]), seq_len),
                pa.ListArray.from_arrays(pa.array((cut[a : b + 1] - x).astype(np.int32)), done),
            ], schema=schema))
    return sink.getvalue().to_pybytes()


class SequenceFile:
    """Zero-copy random access to a file's bytes or a memory map. Opening reads batch headers; the data are touched by access only."""

    def __init__(self, source):
        reader = pa.ipc.open_stream(source)
        self.batches = list(reader)
        self.meta = {k.decode(): v.decode() for k, v in (reader.schema.metadata or {}).items()}
        self.seq_len = reader.schema.field("ids").type.list_size
        self.per = self.batches[0].num_rows if self.batches else 1  # as in all batches but the last

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def ids(self, k: int) -> np.ndarray:
        """View of sequence k."""
        flat = self.batches[k // self.per]["ids"].flatten().to_numpy(zero_copy_only=True)
        return flat[k % self.per * self.seq_len :][: self.seq_len]

    def mask(self, k: int) -> np.ndarray:
        """View of the packed bits (least significant first) of sequence k's mask; seq_len must be a multiple of 8."""
        bits = np.frombuffer(self.batches[k // self.per]["mask"].flatten().buffers()[1], np.uint8)
        return bits[k % self.per * self.seq_len // 8 :][: self.seq_len // 8]


def sequences(source) -> tuple[dict[str, str], list[np.ndarray], list[np.ndarray], list[pa.Array]]:
    """Of a file's bytes or a memory map: its metadata, and per record batch a view of the ids (n, seq_len), the unpacked masks and the ends."""
    f = SequenceFile(source)
    ids = [b["ids"].flatten().to_numpy(zero_copy_only=True).reshape(-1, f.seq_len) for b in f.batches]
    masks = [b["mask"].flatten().to_numpy(zero_copy_only=False).reshape(-1, f.seq_len) for b in f.batches]
    return f.meta, ids, masks, [b["ends"] for b in f.batches]


def read_documents(source):
    """file_index, then (doc_id, start in the file, ids) of each document."""
    meta, ids, masks, ends = sequences(source)
    flat = np.concatenate([a[m] for a, m in zip(ids, masks)]) if ids else np.zeros(0, np.uint16)
    rows = [(x["doc_id"], x["end"]) for e in ends for x in e.flatten().to_pylist()]
    start = 0
    out = []
    for doc_id, end in rows:
        out.append((doc_id, start, flat[start:end]))
        start = end
    return int(meta["file_index"]), out


def write_files(docs: DataFrame, path: str, tokenizer: str | None = None, seq_len: int = SEQ_LEN, end_id: int = END_ID, file_ids: int = FILE_IDS) -> None:
    """Write `docs` (doc_id, text) to Arrow stream files below path, in ascending order of doc_id."""
    spark = docs.sparkSession
    prepare(spark)
    tokenizer = tokenizer or vocabulary()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // FILE_TEXT), 1)
    ordered = docs.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches):
        from pyspark import TaskContext

        enc, out, held, files = encoder(tokenizer), [], 0, TaskContext.get().partitionId() << 32
        kind = np.uint32 if enc.size > 65536 else np.uint16

        def file():
            blob = stream_bytes(out, seq_len, enc.size > 65536, {"file_index": str(files), "tokenizer": tokenizer.rpartition("/")[2], "end_id": str(end_id)})
            return pa.record_batch([pa.array([blob], pa.binary())], names=["value"])

        for batch in batches:
            ids, at = enc.encode(batch.column("text").to_pylist())
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                out.append((doc_id, np.append(ids[at[i] : at[i + 1]], np.uint32(end_id)).astype(kind)))
                held += len(out[-1][1])
                if held >= file_ids:
                    yield file()
                    out, held, files = [], 0, files + 1
        if out:
            yield file()

    # The text writer copies the bytes of a string as they are, whatever they hold. A row is a file of its own.
    ordered.mapInArrow(write, "value binary").select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).text(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document in the files below path, with its crc32 and its place in its file."""

    def parse(batches):
        for batch in batches:
            for content in batch.column("content"):
                if not len(buf := content.as_buffer()):
                    continue
                index, docs = read_documents(buf)
                yield pa.record_batch([
                    pa.array([index] * len(docs), pa.int64()), pa.array(range(len(docs)), pa.int64()), pa.array([d for d, _, _ in docs], pa.int64()), pa.array([s for _, s, _ in docs], pa.int64()),
                    pa.array([len(x) for _, _, x in docs], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for _, _, x in docs], pa.int64()),
                ], names=["file_index", "ordinal", "doc_id", "local_start", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(parse, INDEX)


def with_starts(index: DataFrame) -> DataFrame:
    """Add `start`, the ids of all documents before; the only table that meets in one task has a row for each file."""
    totals = index.groupBy("file_index").agg(F.sum("n_tokens").alias("ids"))
    before = totals.select(F.col("file_index").alias("f"), (F.sum("ids").over(Window.orderBy("file_index")) - F.col("ids")).alias("before"))
    return index.join(before, F.col("file_index") == F.col("f")).select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", "file_index")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = load(spark, sf_dir, "documents")
    path = new_path(spark, "token-files")
    scratch.paths["files"] = path
    write_files(docs, path)
    index = scratch.table(read_index(spark, path), "token-index")
    scratch.drop("files")
    return with_starts(index)
