"""Operator 5, mixing sources to target weights by a low-discrepancy schedule.

Targets: sources in code-point order (null last) weigh 5, 2, 1, 5, 2, 1, ...; they share 150% of all words by weight,
no source gets more than twice its words, and what it would get beyond is reshared by weight (water-filling, found
from running sums over the sources in order of cap / weight).

Schedule: a source's documents are shuffled by the md5 of seed and doc_id, laid end to end (twice, for two epochs) and
cut into blocks of BLOCK words up to the target. Source s owns as many of the 2^m cells of [0, 1) as it has blocks, cell after
cell in cumulative order; the van der Corput point of slot i, its bits reversed, names a cell and so a source. The
first 2^m points visit each cell once, so every source gets exactly its blocks, evenly spread at every prefix of the
schedule; cells that nobody owns are skipped. Slots are ranked by source, and slot number r of a source is joined to
its block r.

Running sums go through hash buckets of (source, first digits of the md5) and ranks through chunks of slots, so a
source with a third of all rows is many groups; buckets and chunks grow in number with the documents and the slots.

Defined results: null text has no words; documents without words are taken 0 times; a null source is a source of its
own and the last; null doc_ids and repeated rows are documents like others (ties by size); extra columns are
ignored by `schedule`; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, load, prepare

WEIGHTS, SHARE, MOST, SEED, BLOCK = (5, 2, 1), 1.5, 2, 7, 1024
#: Hex digits of the shuffle key that make a bucket, and chunks of the schedule in which slots are ranked: at least so many; and documents of a bucket and
#: slots of a chunk, about, where there are more.
DIGITS, CHUNKS, GROUP = 3, 2048, 1 << 16
#: What WORD doesn't match.
BLANKS = r"[\x20\x09-\x0D]*"


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Of (source, source_size), one row a source: adds target double. Water-filling; most * size caps each source."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("weight"))
    everything, up_to = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(up_to), F.lit(0.0))
    sharing = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(up_to), F.lit(0.0))
    t = t.withColumn("level", left / sharing)
    # The water level: at the first source, by ratio, whose cap isn't below it.
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"]
    return t.select("source", "source_size", F.least(F.col("cap"), F.coalesce(level, F.col("ratio")) * F.col("weight")).alias("target"))


def schedule(docs: DataFrame, scratch: Scratch, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Of (rid, doc_id, source, size): the documents with source_size and target, and the schedule.

    The schedule has a row for each piece of a document in a block: slot (place in the mix), skey, block, rid, epoch (which of its
    repeats), lo, hi (the words [lo, hi) of the document). rid must be unique and must not change when docs is read again.
    """
    # The order within a source doesn't turn on the number of digits: a bucket is a range of shuffle keys.
    digits = max(DIGITS, math.ceil(math.log(max(docs.count(), 1) / GROUP, 16)))
    skey = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source")))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    docs = docs.select("rid", "doc_id", "source", F.col("size").cast("long").alias("size"), skey.alias("skey"), digest.alias("digest")).withColumn("bucket", F.substring("digest", 1, digits))
    by_bucket = scratch.table(docs.groupBy("source", "skey", "bucket").agg(F.sum("size").alias("words")), "buckets")
    sources = targets(by_bucket.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    # Words taken of a source: its target, to the nearest word; and the blocks that hold them.
    sources = sources.withColumn("skey", skey).withColumn("quota", F.least(F.col("source_size") * most, F.floor(F.col("target") + 0.5).cast("long"))).withColumn("blocks", F.ceil(F.col("quota") / block).cast("long"))
    sources = sources.withColumn("cell", F.sum("blocks").over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - F.col("blocks"))
    sources = scratch.table(sources.drop("source"), "sources")
    cells = sources.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    bits = max(1, (cells - 1).bit_length())

    # Slots: cells in runs, then one by one; their number is the cell's bits reversed.
    run = 4096
    slots = sources.where("blocks > 0").select("skey", "cell", "blocks", F.explode(F.expr(f"sequence(0L, (blocks - 1) div {run})")).alias("run"))
    slots = slots.repartition("skey", "run").select("skey", F.explode(F.expr(f"sequence(cell + run * {run}, cell + least(blocks, (run + 1) * {run}) - 1)")).alias("c"))
    slots = slots.select("skey", F.expr(f"cast(conv(reverse(lpad(bin(c), {bits}, '0')), 2, 10) as bigint)").alias("slot")).withColumn("chunk", F.expr(f"slot div {max(1, min((1 << bits) // CHUNKS, GROUP))}"))
    slots = scratch.table(slots, "slots")
    counts = slots.groupBy("skey", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("skey", "chunk", (F.sum("n").over(Window.partitionBy("skey").orderBy("chunk")) - F.col("n")).alias("before"))
    ranked = slots.join(before, ["skey", "chunk"]).select("skey", "slot", (F.col("before") + F.row_number().over(Window.partitionBy("skey", "chunk").orderBy("slot")) - 1).alias("block"))

    # Documents: where each begins in its source's shuffled order.
    before = by_bucket.select("skey", "bucket", (F.sum("words").over(Window.partitionBy("skey").orderBy("bucket")) - F.col("words")).alias("words_before"))
    inside = F.sum("size").over(Window.partitionBy("skey", "bucket").orderBy("digest", "size", "rid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    docs = docs.join(before, ["skey", "bucket"]).withColumn("begin", F.col("words_before") + inside)
    docs = scratch.table(docs.join(sources.select("skey", "source_size", "target", "quota"), "skey").select("rid", "doc_id", "source", "skey", "size", "begin", "source_size", "target", "quota"), "placed")
    laid = docs.where("size > 0").select("rid", "skey", "quota", "size", F.explode(F.expr(f"transform(sequence(0, {most - 1}), e -> struct(e as epoch, begin + e * source_size as begin))")).alias("at")).select("rid", "skey", "quota", "size", "at.*")
    laid = laid.where("begin < quota").withColumn("end", F.expr("least(begin + size, quota)"))
    pieces = laid.select("rid", "skey", "epoch", "begin", "end", F.explode(F.expr(f"sequence(begin div {block}, (end - 1) div {block})")).alias("block"))
    pieces = pieces.select("rid", "skey", "epoch", "block", F.expr(f"greatest(begin, block * {block}) - begin").alias("lo"), F.expr(f"least(end, (block + 1) * {block}) - begin").alias("hi"))
    return docs, pieces.join(ranked, ["skey", "block"])


def taken(docs: DataFrame, mix: DataFrame) -> DataFrame:
    """Words that the mix takes of each document, repeats counted, and the first of its slots in the schedule (-1 where nothing is taken)."""
    words = mix.groupBy("rid").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"), F.min("slot").alias("first_slot"))
    return docs.join(words, "rid", "left").withColumn("taken", F.coalesce(F.col("taken"), F.lit(0).cast("long"))).withColumn("first_slot", F.coalesce(F.col("first_slot"), F.lit(-1).cast("long")))


def sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """Documents in the mix, with their own columns, in the order of the schedule: a row for each time that a document is taken, to the word. The quota of
    a source ends in one document at most, of which the first words are taken; its text is cut behind them, and n_chars is of the cut text."""
    spark = prepare(docs.sparkSession)
    scratch, names = Scratch(spark), [f"c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names))
    kept = scratch.table(docs.toDF(*names).withColumn("rid", F.monotonically_increasing_id()), "mix-input", "zstd")
    sizes = scratch.table(sized(kept.select("rid", F.col(at["doc_id"]).alias("doc_id"), F.col(at["source"]).alias("source"), F.col(at["text"]).alias("text"))).drop("text"), "mix-sizes")
    placed, mix = schedule(sizes, scratch)
    copies = scratch.table(mix.groupBy("rid", "epoch").agg(F.sum(F.col("hi") - F.col("lo")).alias("words"), F.min("slot").alias("slot")).join(placed.select("rid", "size"), "rid"), "copies")
    scratch.drop("mix-sizes", "buckets", "sources", "slots", "placed")
    rows = kept.join(copies, "rid").repartitionByRange("slot", "rid", "epoch").sortWithinPartitions("slot", "rid", "epoch")
    part, text = F.col("words") < F.col("size"), F.col(at["text"])
    first = F.slice(F.regexp_extract_all(text, F.lit(BLANKS + WORD), F.lit(0)), F.lit(1), F.col("words").cast("int"))
    rows = rows.withColumn(at["text"], F.when(part, F.array_join(first, "")).otherwise(text))
    if "n_chars" in at:
        rows = rows.withColumn(at["n_chars"], F.when(part, F.length(at["text"]).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(at["n_chars"])))
    return rows.select(*names).toDF(*docs.columns)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = sized(load(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text"))
    docs = scratch.table(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "source", "size"), "sizes")
    return taken(*schedule(docs, scratch)).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


#: The same rows for DuckDB: `taken` is the overlap of a document's two places with the source's quota, and slots are the reversed bits of cells.
OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), s AS (
  SELECT source, sum(size)::DOUBLE AS n, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source
), r AS (
  SELECT *, 2 * n / w AS ratio, sum(n) OVER () * 1.5 AS goal, sum(w) OVER () AS all_w,
    coalesce(sum(2 * n) OVER (ORDER BY 2 * n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
    coalesce(sum(w) OVER (ORDER BY 2 * n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_before
  FROM s
), l AS (
  SELECT arg_min((goal - cap_before) / (all_w - w_before), ratio) AS level FROM r WHERE (goal - cap_before) / (all_w - w_before) <= ratio
), t AS (
  SELECT source, n, least(2 * n, level * w) AS target FROM r, l
), p AS (
  SELECT d.*, t.n, t.target, least(2 * t.n, floor(t.target + 0.5)) AS quota,
    sum(size) OVER (PARTITION BY d.source ORDER BY md5(concat('7:', doc_id)), size, doc_id ROWS UNBOUNDED PRECEDING) - size AS b
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), x AS (
  SELECT doc_id, size, source, n, target, b, greatest(0, least(b + size, quota) - b) + greatest(0, least(n + b + size, quota) - (n + b)) AS taken FROM p
), k AS (
  SELECT source, ceil(least(2 * n, floor(target + 0.5)) / 1024)::BIGINT AS blocks FROM t
), c AS (
  SELECT source, blocks, sum(blocks) OVER (ORDER BY source NULLS LAST) - blocks AS cell, greatest(1, length(bin((sum(blocks) OVER () - 1)::BIGINT))) AS bits FROM k
), e AS (
  SELECT source, bits, unnest(range(cell::BIGINT, (cell + blocks)::BIGINT)) AS cell FROM c
), v AS (
  SELECT source, list_sum(list_transform(range(0, bits), lambda i: ((cell >> i) & 1) * (1::BIGINT << (bits - 1 - i))))::BIGINT AS slot FROM e
), o AS (
  SELECT source, slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS block FROM v
)
SELECT doc_id, size::BIGINT AS size, x.n::BIGINT AS source_size, target, taken::BIGINT AS taken, coalesce(o.slot, -1) AS first_slot
FROM x LEFT JOIN o ON x.source IS NOT DISTINCT FROM o.source AND x.taken > 0 AND o.block = x.b // 1024
"""
