"""Operator 3, mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of units of UNIT tokens. In each round a source's deficit grows by its quantum, it sends whole
units while the deficit lasts, and what is left is carried to the next round; the stream of units, in order of
(round, source, unit), is cut into windows of `seq_len` tokens. The quantum is the source's share of a window, so a
window holds the target proportions to within the carried deficits. By default the target is each source's share of
all tokens, the only one that lasts until every queue is empty; `weights` sets another, and a queue that runs dry
drops out of the rounds.

With quantum q (in 2^-20 units) unit k leaves in round ceil((k + 1) / q) - 1: the deficits that a sequential scheduler
would carry are known in closed form, so windows and partitions are scheduled independently and agree. k counts through
all partitions: each partition cuts its documents into units by itself, and a sum over the partitions before gives the
offset. What a partition has left of a source (under a unit) keeps its ids and fills windows behind the units, cut
freely. Only the very last sequence can hold padding.

Ranks are taken in blocks of rounds (at least 1024), never over a source: a source with a third of all rows is no
single group anywhere. Texts are tokenised once and never shuffled.

Defined results: null text is empty (its end id is packed); a null source is a source of its own; null doc_ids and
repeated rows are packed like any other; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, load, prepare, ranges, row_runs, text_or_empty
from .tokens import encoder, vocabulary

SEQ_LEN, UNIT, END_ID = 1024, 128, 0
#: Deficits are kept in units of 2^-20; rounds are ranked in this many blocks at least, of about so many units at most.
FIXED, BLOCKS, BLOCK_UNITS = 1 << 20, 1024, 100_000
PIECE = "part int, skey string, k long, off long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


class _Cutter:
    """Cuts the documents of one partition into units by source. Pieces of a unit that isn't full yet wait with their ids."""

    def __init__(self, part: int, unit: int, keep_ids: bool):
        self.part, self.unit, self.keep = part, unit, keep_ids
        self.pos: dict[str, int] = {}
        self.open: dict[str, list[tuple]] = {}

    def batch(self, skeys: list[str], doc_ids: list[int | None], ids: np.ndarray, at: np.ndarray) -> pa.RecordBatch | None:
        n = np.diff(at)
        pos = np.zeros(len(n), np.int64)
        for i, (s, m) in enumerate(zip(skeys, n.tolist())):
            pos[i] = self.pos.get(s, 0)
            self.pos[s] = int(pos[i]) + m
        first, last = pos // self.unit, (pos + n - 1) // self.unit
        doc = np.repeat(np.arange(len(n)), last - first + 1)
        u = ranges(first, last - first + 1)
        lo, hi = np.maximum(pos[doc], u * self.unit), np.minimum(pos[doc] + n[doc], (u + 1) * self.unit)
        start, length = lo - pos[doc], hi - lo
        view, b = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B"), (at[doc] + start) * 4
        e = b + length * 4
        full = np.array([self.pos[s] // self.unit for s in skeys], np.int64)[doc]  # units that are complete by now
        done, rows = u < full, []
        for s in dict.fromkeys(skeys):
            if (held := self.open.get(s)) and held[0][2] < self.pos[s] // self.unit:
                rows += [(*x[:-1], x[-1] if self.keep else None) for x in self.open.pop(s)]
        for j in np.flatnonzero(~done).tolist():
            d, blob = doc[j], bytes(view[b[j] : e[j]])
            s = skeys[d]
            self.open.setdefault(s, []).append((self.part, s, int(u[j]), int(lo[j] - u[j] * self.unit), doc_ids[d], int(start[j]), int(length[j]), zlib.crc32(blob), int(n[d]), blob))
        j = np.flatnonzero(done)
        d, crc = doc[j], [zlib.crc32(view[x:y]) for x, y in zip(b[j].tolist(), e[j].tolist())]
        skeys, doc_ids = np.array(skeys, object), np.array(doc_ids, object)
        blobs = [bytes(view[x:y]) for x, y in zip(b[j].tolist(), e[j].tolist())] if self.keep else [None] * len(j)
        columns = [[self.part] * len(j), skeys[d], u[j], lo[j] - u[j] * self.unit, doc_ids[d], start[j], length[j], crc, n[d], blobs]
        return self._rows([[*x, *(y[i] for y in rows)] for i, x in enumerate(columns)])

    def rest(self) -> pa.RecordBatch:
        """What is left: k null marks a piece of a unit that never filled."""
        rows = [(x[0], x[1], None, *x[3:]) for held in self.open.values() for x in held]
        return self._rows([[x[i] for x in rows] for i in range(10)])

    def _rows(self, columns: list[list]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.string(), *[pa.int64()] * 7, pa.binary()]
        return pa.record_batch([pa.array(x, k) for x, k in zip(columns, kinds)], names=[x.split()[0] for x in PIECE.split(", ")])


def pack(docs: DataFrame, tokenizer: str | None = None, weights: dict[str | None, float] | None = None, seq_len: int = SEQ_LEN, unit: int = UNIT, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pieces of the documents (doc_id, source, text) in sequences of seq_len tokens.

    weights: target proportion of tokens by source (1 where a source has none); keep_ids: return each piece's ids too,
    as little-endian unsigned 32-bit integers.
    """
    if seq_len % unit:
        raise ValueError("seq_len must be a multiple of unit")
    spark = prepare(docs.sparkSession)
    scratch, tokenizer = Scratch(spark), tokenizer or vocabulary()
    skey = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))

    def cut(batches):
        from pyspark import TaskContext

        enc, cutter = encoder(tokenizer), _Cutter(TaskContext.get().partitionId(), unit, keep_ids)
        for batch in batches:
            texts, skeys, doc_ids = (batch.column(c).to_pylist() for c in ("text", "skey", "doc_id"))
            for i, j in row_runs(np.concatenate([[0], np.cumsum([len(t) for t in texts])])):
                ids, at = enc.encode(texts[i:j])
                ids = np.insert(ids, at[1:], np.uint32(end_id))
                yield cutter.batch(skeys[i:j], doc_ids[i:j], ids, at + np.arange(len(at)))
        yield cutter.rest()

    pieces = scratch.table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), skey.alias("skey"), text_or_empty().alias("text")).mapInArrow(cut, PIECE), "pieces", "zstd")
    out = [F.col("doc_id"), "start", "length", "ids_crc32", "doc_tokens", F.expr(f"pos div {seq_len}").alias("sequence_id"), F.expr(f"pos % {seq_len}").alias("offset"), F.expr("if(skey = 'n', null, substr(skey, 2))").alias("source"), *(["ids"] if keep_ids else [])]

    # Units: their number by partition and source, then the offset of each partition's units in its source's queue.
    full = pieces.where(F.col("k").isNotNull())
    by_part = scratch.table(full.groupBy("part", "skey").agg((F.max("k") + 1).alias("units")), "units")
    total = by_part.agg(F.coalesce(F.sum("units"), F.lit(0))).first()[0]
    sources = by_part.groupBy("skey").agg(F.sum("units").alias("queue"))
    if weights is None:
        share = F.col("queue") / F.lit(max(total, 1))
    else:
        given = [x for k, v in weights.items() for x in (F.lit("n" if k is None else f"s{k}"), F.lit(float(v)))]
        weight = F.coalesce(F.create_map(*given)[F.col("skey")], F.lit(1.0)) if given else F.lit(1.0)
        sources = sources.withColumn("weight", weight)
        share = F.col("weight") / F.lit(sources.agg(F.sum("weight")).first()[0] or 1.0)
    sources = sources.select("skey", "queue", F.greatest(F.lit(1), F.floor(share * (seq_len // unit) * FIXED)).cast("long").alias("quantum"))
    queues = Window.partitionBy("skey").orderBy("part")
    offsets = scratch.table(by_part.join(sources, "skey").select("part", "skey", "queue", "quantum", (F.sum("units").over(queues) - F.col("units")).alias("base")), "queues")
    in_round = f"((kk + 1) * {FIXED} + quantum - 1) div quantum - 1"
    rounds = (offsets.select(F.max(F.expr(in_round.replace("kk", "(queue - 1)")))).first()[0] or 0) + 1
    blocks = max(BLOCKS, -(-total // BLOCK_UNITS))
    units = full.join(offsets, ["part", "skey"]).withColumn("kk", F.col("base") + F.col("k")).withColumn("round", F.expr(in_round)).withColumn("block", F.expr(f"cast(floor(round * {blocks / rounds!r}d) as int)"))
    units = scratch.table(units.select("block", "round", "skey", "kk", "off", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"), "scheduled", "zstd")
    # One row a block: `blocks` bounds what is broadcast.
    sizes = units.where("off = 0").groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("before"))
    rank = F.dense_rank().over(Window.partitionBy("block").orderBy("round", "skey", "kk")) - 1
    placed = units.withColumn("rank", rank).join(F.broadcast(before), "block").withColumn("pos", (F.col("before") + F.col("rank")) * unit + F.col("off")).select(*out)

    # Rests: one stream behind the units, in order of partition and source.
    rests = pieces.where(F.col("k").isNull())
    inside = Window.partitionBy("part").orderBy("skey", "off")
    by_part = rests.groupBy("part").agg(F.sum("length").alias("n"))
    before = by_part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rests = rests.withColumn("inside", F.sum("length").over(inside) - F.col("length")).join(before, "part").withColumn("pos", F.col("before") + F.col("inside") + total * unit)

    def split(batches):
        """Cut at window edges; a piece is shorter than a window, so it crosses at most one."""
        for batch in batches:
            t = batch.to_pydict()
            rows = []
            for skey, doc_id, start, n, pos, doc_tokens, ids in zip(t["skey"], t["doc_id"], t["start"], t["length"], t["pos"], t["doc_tokens"], t["ids"]):
                a = 0
                while a < n:
                    m = min(n - a, seq_len - (pos + a) % seq_len)
                    blob = ids[4 * a : 4 * (a + m)]
                    rows.append((skey, doc_id, start + a, m, zlib.crc32(blob), doc_tokens, pos + a, blob))
                    a += m
            kinds = [pa.string(), *[pa.int64()] * 6, pa.binary()]
            yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["skey", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "pos", "ids"])

    rests = rests.select("skey", "doc_id", "start", "length", "pos", "doc_tokens", "ids").mapInArrow(split, "skey string, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, pos long, ids binary")
    return placed.unionByName(rests.select(*out))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"))
