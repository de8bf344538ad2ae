"""Operator 1, media columns: content-defined chunks, deduplicated by digest, and ordered chunk lists that restore payloads.

Stored form. A payload's bytes are cut where the rolling gear hash of the last 32 bytes has its top CUT_BITS bits zero
(chunks of LEAST to MOST bytes), so an edit moves only nearby cuts. The chunk store holds each distinct chunk once, as 8-bit samples
packed by zstd, under the first 16 bytes of its SHA-256; a recipe lists a payload's chunk digests and lengths in order. Payloads with equal recipes are one.

1. A pass over the texts writes recipes: narrow rows.
2. A second pass emits chunks, each once per task, hash-partitioned by digest: one chunk per digest goes to the store, written in
   buckets of the digest. Digests already in an earlier store drop out by an anti join.
3. Distinct recipes, exploded, are joined to the store on the digest; the store's buckets spare it a shuffle. Chunks meet again by
   recipe, in order, are unpacked, checked against their digests and hashed as one payload. Features join back to documents by recipe.

   A payload of one chunk needs no meeting.

Chunk bytes are shuffled twice at most, packed; a hot chunk or text is one row of the store after the first task-side step, and is broadcast to the
recipes that share it (`_with_bytes`). The shuffle files of step 2 are freed before step 3.

Defined results: null text is empty; an empty text is 64 zero bytes; equal texts have equal values; a null doc_id and repeated rows
are documents like others; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bytes_of, free_shuffles, load, new_path, prepare, ranges, text_or_empty

UNIT, LEAST, CUT_BITS, MOST, SEED, LEVEL = 64, 1024, 12, 16384, 20_01, 9
#: A chunk is hot if more than one in MOST_HOT of the rows that need chunks need it, and more than HOT_USES do.
MOST_HOT, HOT_USES = 1024, 1000
WINDOW = 32
MAGIC = b"CDC1"


def digest(data) -> bytes:
    """The first 128 bits of SHA-256: two of 10^11 chunks agree by chance with probability 1.5e-17."""
    return hashlib.sha256(data).digest()[:16]


def gear(seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 32, 256, np.uint64).astype(np.uint32)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """At each byte, sum of gear[byte] << age over the last 32 bytes (mod 2^32), by doubling the window five times."""
    h = gear()[data]
    age = 1
    while age < WINDOW:
        h[age:] += h[:-age].copy() << np.uint32(age)
        age *= 2
    return h


def payloads(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text with zero bytes up to a positive multiple of UNIT."""
    n = np.diff(at)
    size = np.maximum(-(-n // UNIT), 1) * UNIT
    to = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(to[-1], np.uint8)
    out[ranges(to[:-1], n)] = data
    return out, to


def chunk_ends(data: np.ndarray, at: np.ndarray) -> list[list[int]]:
    """Of each payload, where its chunks end. No window reaches over a chunk's start: LEAST is at least WINDOW."""
    cuts = np.flatnonzero(gear_hash(data) >> np.uint32(32 - CUT_BITS) == 0) + 1
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        own, ends = cuts[np.searchsorted(cuts, a + LEAST) : np.searchsorted(cuts, b)], []
        while b - a > LEAST:
            i = np.searchsorted(own, a + LEAST)
            end = min(int(own[i]) if i < len(own) else b, a + MOST, b)
            ends.append(end)
            a = end
        if a < b:
            ends.append(b)
        out.append(ends)
    return out


def _chunked(batches, column):
    for batch in batches:
        data, at = payloads(*bytes_of(batch.column(column)))
        view = memoryview(data)
        for i, ends in enumerate(chunk_ends(data, at)):
            starts = [int(at[i]), *ends[:-1]]
            yield batch, i, [view[a:b] for a, b in zip(starts, ends)]


def recipes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, recipe, digests, lengths) of each document (doc_id, text)."""

    def run(batches):
        for batch in batches:
            n = np.diff(bytes_of(batch.column("text"))[1])
            rows = []
            for _, _, chunks in _chunked([batch], "text"):
                digests = [digest(c) for c in chunks]
                lengths = [len(c) for c in chunks]
                rows.append((sum(lengths), digest(b"".join(digests) + struct.pack(f"<{len(lengths)}I", *lengths)), digests, lengths))
            yield pa.record_batch([
                batch.column("doc_id"), pa.array(n, pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()),
                pa.array([r[2] for r in rows], pa.list_(pa.binary())), pa.array([r[3] for r in rows], pa.list_(pa.int32())),
            ], names=["doc_id", "n_bytes", "payload_bytes", "recipe", "digests", "lengths"])

    return docs.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, recipe binary, digests array<binary>, lengths array<int>")


def chunks(docs: DataFrame) -> DataFrame:
    """(digest, packed) of the documents' chunks, each once per task."""

    def run(batches):
        import zstandard

        pack, seen = zstandard.ZstdCompressor(level=LEVEL), set()
        digests, packed = [], []
        for batch in batches:
            for _, _, found in _chunked([batch], "text"):
                for c in found:
                    if (d := digest(c)) not in seen:
                        seen.add(d)
                        digests.append(d)
                        packed.append(pack.compress(c))
            yield pa.record_batch([pa.array(digests, pa.binary()), pa.array(packed, pa.binary())], names=["digest", "packed"])
            digests, packed = [], []

    return docs.mapInArrow(run, "digest binary, packed binary")


def store(docs: DataFrame, path: str, existing: DataFrame | None = None, name: str | None = None) -> DataFrame:
    """Write the documents' distinct chunks below path, in buckets of the digest, without those that `existing` has. name: the table's in the catalog."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    new = chunks(docs).repartition(buckets, "digest").dropDuplicates(["digest"])
    if existing is not None:
        new = new.join(existing.select("digest"), "digest", "left_anti")
    name = name or f"chunk_store_{uuid.uuid4().hex}"
    new.write.bucketBy(buckets, "digest").sortBy("digest").option("path", path).option("compression", "uncompressed").format("parquet").saveAsTable(name)
    return spark.table(name)


def _with_bytes(rows: DataFrame, chunk_store: DataFrame) -> DataFrame:
    """rows (.., digest) with the packed bytes of their chunks.

    The store's buckets fix which task a digest goes to, so chunks that very many recipes share would each fill one. A sketch of the digests' counts
    (MOST_HOT * 16 entries a task, no shuffle) names those with more than one in MOST_HOT of all rows: fewer than MOST_HOT chunks of MOST bytes, which
    are broadcast, and their rows stay where they are. All other rows meet the store. Whichever way a row takes, it gets the same bytes.
    """
    top = rows.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(hex(digest), {MOST_HOT}, {MOST_HOT * 16})").alias("top")).first()
    least = max(top.n / MOST_HOT, HOT_USES)
    hot = [bytes.fromhex(x["item"]) for x in top.top or [] if x["item"] and x["count"] > least][:MOST_HOT]
    if not hot:
        return rows.join(chunk_store, "digest")
    is_hot = F.col("digest").isin([F.lit(d) for d in hot])
    return rows.where(~is_hot).join(chunk_store, "digest").unionByName(rows.where(is_hot).join(F.broadcast(chunk_store.where(is_hot)), "digest"))


def distinct_recipes(recipe_rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(recipe, digests), each recipe once, as a table of its own."""
    return scratch.table(recipe_rows.groupBy("recipe").agg(F.first("digests").alias("digests")), "distinct-recipes", "zstd")


def restored(recipe_rows: DataFrame, chunk_store: DataFrame) -> DataFrame:
    """Payload facts of each distinct recipe, from the stored chunks: (recipe, payload_sha256, tail_crc32, media_bytes, media_sha256, feature)."""
    return restored_distinct(distinct_recipes(recipe_rows, Scratch(chunk_store.sparkSession)), chunk_store)


def restored_distinct(listed: DataFrame, chunk_store: DataFrame) -> DataFrame:
    """`restored` of rows (recipe, digests) that are distinct, and that may be read several times."""
    n = int(chunk_store.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def parts(where: str) -> DataFrame:
        rows = listed.where(where).select("recipe", F.posexplode("digests").alias("seq", "digest"))
        # Recipes are distinct: one chunk alone is a recipe once.
        met = rows.join(chunk_store, "digest") if where == "size(digests) = 1" else _with_bytes(rows, chunk_store)
        return met.select("recipe", "seq", "digest", "packed")

    def run(batches):
        import zstandard

        unpack, own = zstandard.ZstdDecompressor(), None
        out: list[tuple] = []

        def begin(recipe):
            # Sums run along the payload: a very long one is never held whole.
            return {"recipe": recipe, "sha": hashlib.sha256(), "head": [], "media": hashlib.sha256(MAGIC), "bytes": len(MAGIC), "tail": b"", "hist": np.zeros(256, np.int64), "chunks": 0, "n": 0}

        def done(s):
            p = s["hist"][s["hist"] > 0] / max(s["n"], 1)
            feature = f"chunks={s['chunks']};mean={float(np.arange(256) @ s['hist']) / max(s['n'], 1):.4f};entropy={float(-(p * np.log2(p)).sum()) + 0.0:.4f};zeros={int(s['hist'][0])}"
            out.append((s["recipe"], s["sha"].hexdigest(), zlib.crc32(s["tail"]), s["bytes"], s["media"].hexdigest(), feature))

        for batch in batches:
            for recipe, name, packed in zip(*(batch.column(c).to_pylist() for c in ("recipe", "digest", "packed"))):
                if own is None or own["recipe"] != recipe:
                    if own is not None:
                        done(own)
                    own = begin(recipe)
                raw = unpack.decompress(packed)
                if digest(raw) != name:
                    raise ValueError(f"chunk {name.hex()} is damaged")
                own["sha"].update(raw)
                header = struct.pack("<I", len(raw)) + name
                own["media"].update(header + packed)
                own["bytes"] += len(header) + len(packed)
                own["tail"] = (own["tail"] + raw)[-64:]
                own["hist"] += np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
                own["chunks"] += 1
                own["n"] += len(raw)
            yield _facts(out)
            out.clear()
        if own is not None:
            done(own)
        yield _facts(out)

    facts = "recipe binary, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    # A payload of one chunk is restored where its chunk lies; only longer ones bring chunks together.
    whole = parts("size(digests) = 1").mapInArrow(run, facts)
    return whole.unionByName(parts("size(digests) > 1").repartition(n, "recipe").sortWithinPartitions("recipe", "seq").mapInArrow(run, facts))


def _facts(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["recipe", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def restore_payloads(recipe_rows: DataFrame, chunk_store: DataFrame) -> DataFrame:
    """(recipe, payload binary) of each distinct recipe: the verified media themselves."""
    listed = recipe_rows.groupBy("recipe").agg(F.first("digests").alias("digests")).select("recipe", F.posexplode("digests").alias("seq", "digest"))

    def join(key, t):
        import zstandard

        t = t.sort_by("seq")
        raw = [zstandard.ZstdDecompressor().decompress(x) for x in t.column("packed").to_pylist()]
        for x, d in zip(raw, t.column("digest").to_pylist()):
            if digest(x) != d:
                raise ValueError(f"chunk {d.hex()} is damaged")
        return pa.table({"recipe": pa.array([key[0].as_py()], pa.binary()), "payload": pa.array([b"".join(raw)], pa.binary())})

    return _with_bytes(listed, chunk_store).groupBy("recipe").applyInArrow(join, "recipe binary, payload binary")


def op1_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    scratch = Scratch(spark)
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    listed = scratch.table(recipes(docs), "recipes", "zstd")
    distinct = distinct_recipes(listed, scratch)
    free_shuffles(spark)
    path = new_path(spark, "chunks")
    scratch.paths["chunks"] = path
    name = f"chunk_store_{uuid.uuid4().hex}"
    chunk_store = store(docs.select("text"), path, name=name)
    free_shuffles(spark)
    time.sleep(1)  # the JVM's cleaner removes files in the background
    facts = scratch.table(restored_distinct(distinct, chunk_store), "facts", "zstd")
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    scratch.drop("chunks", "distinct-recipes")
    return listed.select("doc_id", "n_bytes", "payload_bytes", "recipe").join(facts, "recipe").drop("recipe")
