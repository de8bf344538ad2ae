"""Operator 4, embedding near-duplicates by randomised-rotation binary codes.

A unit vector o, turned by a random rotation, keeps the signs of its D components (the code, x = signs / sqrt(D)) and the factor f = <x, o>. For
any unit q, <x, q> / f estimates <o, q> without bias, within SURE * sqrt((1 - f^2) / f^2) / sqrt(D - 1) but for a chance that falls as exp(-c
SURE^2). A pair whose upper bound is under the threshold is dropped; every other pair is recomputed exactly, in double precision.

Candidates are pairs that agree in all k sign bits of one of L more rotations. With n vectors, k = ceil(log2 n) - 2 keeps chance buckets at about
four vectors, and L is what makes a pair at the threshold share a bucket with probability RECALL: a power of about 1.15 of n in all, and no
comparison of all with all. Equal vectors are one class first. Buckets of any size are compared whole, large ones as pairs of blocks of bounded
size. A pair that meets in several tables counts in the first only. Tasks return sums of links by class and forests of links, never all pairs.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing (0 links, their own component); vectors of
different lengths don't link; repeated rows are vectors like others; a null vec_id names no component unless there is no other; labels and
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks
from .common import Scratch, free_shuffles, load, mix64, prepare
from .components import components

THRESHOLD, RECALL, SURE, SEED = 0.95, 0.9995, 5.0, 20_04


@functools.lru_cache(maxsize=16)
def rotations(dim: int, rows: int, count: int, seed: int = SEED) -> np.ndarray:
    """(count * rows, dim): `rows` rows each of `count` random rotations (independent directions where rows > dim)."""
    rng = np.random.default_rng([seed, dim, rows])
    out = []
    for _ in range(count):
        g = rng.normal(size=(max(dim, rows), dim))
        out.append(np.linalg.qr(g[:dim])[0][:rows] if rows <= dim else g[:rows] / np.linalg.norm(g[:rows], axis=1, keepdims=True))
    return np.concatenate(out)


def tables(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a table and number of tables for n vectors."""
    k = max(4, math.ceil(math.log2(max(n, 2))) - 2)
    p = (1 - math.acos(threshold) / math.pi) ** k
    return k, math.ceil(math.log(1 - recall) / math.log(1 - p))


def codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signs (n, D) as +-1, factors (n,) and the turned vectors (n, D)."""
    dim = unit.shape[1]
    turned = unit @ rotations(dim, dim, 1).T
    signs = np.where(turned >= 0, 1.0, -1.0)
    return signs, (np.abs(turned).sum(1) / math.sqrt(dim)), turned


def upper_bounds(signs: np.ndarray, factor: np.ndarray, turned: np.ndarray, sure: float = SURE) -> np.ndarray:
    """Of each row: the estimate of the inner product of the coded and the turned vector, plus its error bound."""
    dim = signs.shape[1]
    return np.einsum("ij,ij->i", signs, turned) / math.sqrt(dim) / factor + sure * np.sqrt(np.maximum(1 - factor**2, 0)) / factor / math.sqrt(max(dim - 1, 1))


def bucket_codes(unit: np.ndarray, k: int, count: int) -> np.ndarray:
    """(n, count) of int64: the bucket of each vector in each table, distinct across tables and lengths."""
    n, dim = unit.shape
    bits = (unit @ rotations(dim, k, count, SEED + 1).T >= 0).reshape(n, count, k)
    out = np.zeros((n, count), np.uint64)
    for i in range(k):
        out = (out << np.uint64(1)) | bits[:, :, i].astype(np.uint64)
    with np.errstate(over="ignore"):
        return mix64(out * np.uint64(0x9E3779B97F4A7C15) + mix64(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(1009) + np.uint64(dim))).view(np.int64)


def _matrix(blobs: list[bytes], kind: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of rows of any length: (places, unit vectors in double precision) for each length."""
    by_size: dict[int, list[int]] = {}
    for i, b in enumerate(blobs):
        by_size.setdefault(len(b), []).append(i)
    out = []
    for rows in by_size.values():
        x = np.frombuffer(b"".join(blobs[i] for i in rows), kind).reshape(len(rows), -1).astype(np.float64)
        # Largest component first: squares of very large or small numbers stay finite.
        x = x / np.abs(x).max(1, keepdims=True)
        out.append((np.array(rows), x / np.linalg.norm(x, axis=1, keepdims=True)))
    return out


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept of each vector (vec_id, embedding)."""
    spark = prepare(vectors.sparkSession)
    scratch = Scratch(spark)
    element = vectors.schema["embedding"].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding") if kind == "<f4" else F.col("embedding").cast("array<double>"))

    def keyed(batches):
        for batch in batches:
            keys, blobs = [], []
            for v in batch.column("embedding"):
                x = v.values
                ok = x is not None and len(x) and not x.null_count
                a = x.to_numpy(zero_copy_only=False).astype(kind) if ok else None
                ok = ok and bool(np.isfinite(a).all()) and bool(np.any(a))
                # -0.0 and 0.0 are equal components.
                blobs.append((a + np.zeros(1, kind)).astype(kind).tobytes() if ok else None)
                keys.append(hashlib.blake2b(blobs[-1], digest_size=16).digest() if ok else None)
            yield pa.record_batch([batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(blobs, pa.binary())], names=["vec_id", "key", "vec"])

    rows = scratch.table(vectors.mapInArrow(keyed, "vec_id long, key binary, vec binary"), "vectors")
    classes = scratch.table(rows.where("key is not null").groupBy("key").agg(F.min("vec").alias("vec"), F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("members")), "classes")
    k, count = tables(classes.count(), threshold, recall)

    def place(batches):
        for batch in batches:
            blobs, keys = batch.column("vec").to_pylist(), batch.column("key")
            for at, unit in _matrix(blobs, kind):
                yield pa.record_batch([keys.take(pa.array(np.repeat(at, count))), pa.array(bucket_codes(unit, k, count).reshape(-1)), pa.array(np.tile(np.arange(count, dtype=np.int32), len(at)))], names=["key", "bucket", "tab"])

    def index(batches):
        """The stored codes and correction factors."""
        for batch in batches:
            blobs = batch.column("vec").to_pylist()
            code, factor = [None] * len(blobs), np.zeros(len(blobs))
            for at, unit in _matrix(blobs, kind):
                signs, f, _ = codes(unit)
                factor[at] = f
                for i, b in zip(at.tolist(), np.packbits(signs > 0, axis=1)):
                    code[i] = b.tobytes()
            yield pa.record_batch([batch.column("key"), batch.column("vec"), batch.column("members"), pa.array(code, pa.binary()), pa.array(factor)], names=["key", "vec", "members", "code", "factor"])

    coded = scratch.table(classes.select("key", "vec", "members").mapInArrow(index, "key binary, vec binary, members long, code binary, factor double"), "codes")
    placed = scratch.table(classes.select("key", "vec").mapInArrow(place, "key binary, bucket long, tab int"), "placed")
    sizes = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = blocks.block_pairs(placed.join(sizes, "bucket"), "key", "size")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = shared.join(coded, "key").repartition(n, "bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj")

    def compare(batches):
        for t, at in blocks.whole_groups(batches, ["bucket", "bi", "bj"]):
            blobs, keys, members = t.column("vec").to_pylist(), t.column("key").to_pylist(), t.column("members").to_numpy()
            factor, tab = t.column("factor").to_numpy(), t.column("tab").to_numpy()
            blk, bi, bj = (t.column(c).to_numpy() for c in ("blk", "bi", "bj"))
            code = t.column("code").to_pylist()
            links, ends = np.zeros(len(keys), np.int64), [[], []]
            place_of, row_of = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
            by_size = []
            for g, (where, unit) in enumerate(_matrix(blobs, kind)):
                dim = unit.shape[1]
                signs = np.unpackbits(np.frombuffer(b"".join(code[i] for i in where), np.uint8).reshape(len(where), -1), axis=1)[:, :dim] * 2.0 - 1.0
                by_size.append((unit, signs, unit @ rotations(dim, dim, 1).T, bucket_codes(unit, k, count)))
                place_of[where], row_of[where] = g, np.arange(len(where))
            for x, y in blocks.pairs(at, blk, bi, bj):
                for g, (unit, signs, turned, buckets) in enumerate(by_size):
                    same = (place_of[x] == g) & (place_of[y] == g)
                    a, b = x[same], y[same]
                    for i in range(0, len(a), 1 << 16):
                        p, q = a[i : i + (1 << 16)], b[i : i + (1 << 16)]
                        u, v = row_of[p], row_of[q]
                        may = upper_bounds(signs[u], factor[p], turned[v]) >= threshold
                        p, q, u, v = p[may], q[may], u[may], v[may]
                        near = np.einsum("ij,ij->i", unit[u], unit[v]) >= threshold
                        p, q, u, v = p[near], q[near], u[near], v[near]
                        # Only in the first table where both share a bucket.
                        first = (buckets[u] == buckets[v]).argmax(1) == tab[p]
                        p, q = p[first], q[first]
                        links += np.bincount(p, members[q], len(keys)).astype(np.int64) + np.bincount(q, members[p], len(keys)).astype(np.int64)
                        keep = blocks.forest(p.tolist(), q.tolist())
                        ends[0] += p[keep].tolist()
                        ends[1] += q[keep].tolist()
            linked = np.flatnonzero(links)
            keep = blocks.forest([keys[i] for i in ends[0]], [keys[i] for i in ends[1]])
            edges = [(keys[ends[0][i]], keys[ends[1][i]]) for i in keep.tolist()]
            yield pa.record_batch([pa.array([*(keys[i] for i in linked), *(a for a, _ in edges)], pa.binary()), pa.array([*[None] * len(linked), *(b for _, b in edges)], pa.binary()), pa.array([*links[linked].tolist(), *[None] * len(edges)], pa.int64())], names=["a", "b", "links"])

    found = scratch.table(tasks.mapInArrow(compare, "a binary, b binary, links long"), "links")
    free_shuffles(spark)
    roots = scratch.table(components(found.where("b is not null").select("a", "b"), scratch), "roots")
    links = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    facts = classes.select("key", "low", "members").join(roots, F.col("key") == F.col("node"), "left").select("key", "low", "members", F.coalesce("root", "key").alias("root"))
    facts = scratch.table(facts.join(links, F.col("key") == F.col("a"), "left").select("key", "low", "root", (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("links")), "facts")
    least = facts.groupBy("root").agg(F.min("low").alias("component"))
    facts = facts.join(least, "root").select("key", "links", "component")
    out = rows.select("vec_id", "key").join(facts, "key", "left").withColumn("component_id", F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(load(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
