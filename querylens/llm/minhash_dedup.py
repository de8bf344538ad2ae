"""Operator 10, MinHash near-duplicates.

1. One pass over the texts: words, distinct shingles as 64-bit hashes, BANDS * ROWS minima of universal hash functions
   (a x + b mod 2^64, a odd), kept as 16 bits each, and a 128-bit key of the set. Texts with equal sets are one class
   from here on, so copies cost no pairs.
2. Bands of ROWS minima go to buckets. In each bucket of several classes all are compared with the class that shares
   most buckets (a base text and its edited copies meet there), and with the bucket's least key.
3. A comparison is a signature estimate first, and then the full sets of both texts: 100 * common >= threshold * union.
4. Large-star and small-star give components. Buckets with more than one component left are compared across components
   only (the largest with the others, and the others among themselves), in pairs of blocks of bounded rows and bytes: by signature alone, and then, for the
   classes that have a likely partner there, on full sets, in the first bucket that the two share, until the two components are joined. So every pair of
   classes that shares a bucket is either in one component by confirmed links or has been compared: nothing is capped.

A pair of similarity 0.8 misses all 40 bands of 6 with probability 5e-6, and fails the estimate (which must be under
`threshold` by five standard deviations) about as rarely.

Defined results: a text without words has n_shingles 0 and is linked with nothing; fewer words than a shingle are one
shingle; a null doc_id takes part in links but names no component unless it has no other member; repeated rows stay
rows; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks
from .common import RUN_BYTES, RunHasher, Scratch, bytes_of, free_shuffles, load, mix64, prepare, ranges, row_runs, sieve
from .components import components

BANDS, ROWS, SEED = 40, 6, 20_11
#: Shingles are hashed in runs of about this many, which stay in a core's cache.
RUN = 1 << 15
#: Edges of a centre that are confirmed in one group; bytes of text in a block.
STAR, BLOCK_BYTES = 128, 2 << 20

_hasher = RunHasher()


@functools.cache
def _lower_spread() -> np.ndarray:
    """Of each byte, its share in a hash, A-Z as a-z."""
    x = np.arange(256, dtype=np.uint64)
    with np.errstate(over="ignore"):
        return mix64(x + np.where((x >= 65) & (x <= 90), np.uint64(32), np.uint64(0)) + np.uint64(1))


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of several texts (A-Z in lower case), and n + 1 offsets."""
    starts, ends = [], []
    for a in range(0, len(data), RUN_BYTES):
        b = min(a + RUN_BYTES, len(data))
        # One more byte on either side, blank beyond the ends.
        part = np.full(b - a + 2, 32, np.uint8)
        part[1:-1] = data[a:b]
        part[0], part[-1] = data[a - 1] if a else 32, data[b] if b < len(data) else 32
        word = (part != 32) & ((part < 9) | (part > 13))
        edge = np.zeros(b - a + 1, bool)
        edge[at[np.searchsorted(at, a) : np.searchsorted(at, b, side="right")] - a] = True
        starts.append(np.flatnonzero(word[1:-1] & (~word[:-2] | edge[:-1])) + a)
        ends.append(np.flatnonzero(word[1:-1] & (~word[2:] | edge[1:])) + a + 1)
    starts, ends = (np.concatenate(x or [np.zeros(0, np.int64)]) for x in (starts, ends))
    return _hasher(data, starts, ends - starts, _lower_spread()), np.searchsorted(starts, at)


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct 64-bit hashes of the k-word shingles of each text, one text after the other, and n + 1 offsets."""
    words, w = word_hashes(data, at)
    n = np.diff(w)
    count = np.where(n == 0, 0, np.maximum(n - k, 0) + 1)
    to = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(to[-1], np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(len(words), np.uint64)
        for j in range(min(k, int(n.max(initial=0)))):
            # h[i] is the hash of words i to i + j.
            h = mix64(h[: len(words) - j] * np.uint64(0x9E3779B97F4A7C15) + words[j:] + np.uint64(j + 1))
            if j + 1 < k:
                short = np.flatnonzero(n == j + 1)
                out[to[short]] = h[w[short]]
    full = np.flatnonzero(n >= k)
    if len(full):
        out[ranges(to[full], count[full])] = h[ranges(w[full], count[full])]
    for a, b in zip(to[:-1].tolist(), to[1:].tolist()):
        out[a:b].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[to[:-1][count > 0]] = True
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[to]


def sets_of(column, k: int) -> list[np.ndarray]:
    """The shingle set of each text of an Arrow column, made from about RUN_BYTES at once."""
    data, at = bytes_of(column)
    out: list[np.ndarray] = []
    for i, j in row_runs(at):
        h, s = shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i], k)
        out += [h[a:b] for a, b in zip(s[:-1].tolist(), s[1:].tolist())]
    return out


def set_keys(h: np.ndarray, at: np.ndarray) -> list[bytes | None]:
    """128-bit keys of sets, from sums of two mixes; None for an empty set."""
    with np.errstate(over="ignore"):
        sums = []
        for c in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB):
            s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(h ^ np.uint64(c)))])
            sums.append(s[at[1:]] - s[at[:-1]])
        n = np.diff(at).astype(np.uint64)
        both = np.stack([mix64(sums[0] + n), mix64(sums[1] ^ (n << np.uint64(32)))], 1).astype(">u8")
    return [both[i].tobytes() if m else None for i, m in enumerate(n.tolist())]


def functions(count: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, count, np.uint64) * np.uint64(2)


def signatures(h: np.ndarray, at: np.ndarray, count: int) -> np.ndarray:
    """(texts, count) of uint16: 16 bits of each minimum. Empty sets get zeros."""
    a, b = functions(count)
    n = np.diff(at)
    out = np.zeros((len(n), count), np.uint16)
    full = np.flatnonzero(n)
    done = 0
    with np.errstate(over="ignore"):
        while done < len(full):
            end = max(int(np.searchsorted(at[full] + n[full], at[full[done]] + RUN, side="right")), done + 1)
            part = full[done:end]
            x = h[at[part[0]] : at[part[-1]] + n[part[-1]]]
            starts = at[part] - at[part[0]]
            v = np.empty_like(x)
            low = np.empty((count, len(part)), np.uint64)
            for i in range(count):
                np.multiply(x, a[i], out=v)
                np.add(v, b[i], out=v)
                low[i] = np.minimum.reduceat(v, starts)
            out[part] = (mix64(low) & np.uint64(0xFFFF)).astype(np.uint16).T
            done = end
    return out


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts, bands) of int64; the band's number is hashed too."""
    parts = sig.reshape(len(sig), bands, rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        h = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=np.uint64)), (len(sig), bands)).copy()
        for j in range(rows):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j] + np.uint64(1))
    return h.view(np.int64)


def _confirmed(star: DataFrame, k: int, threshold: int, count: int) -> DataFrame:
    """Links among (centre, salt, member, is_member, sig, text) rows, streamed with the centre of each group first."""
    low = threshold / 100 - 5 * (threshold / 100 * (1 - threshold / 100) / count) ** 0.5

    def confirm(batches):
        centre, centre_set, centre_sig = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            sets = sets_of(batch.column("text"), k)
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, count)
            a, b, found = batch.column("centre").to_pylist(), batch.column("member").to_pylist(), []
            for i, is_member in enumerate(batch.column("is_member").to_pylist()):
                own = sets[i]
                if not is_member:
                    centre, centre_set, centre_sig = a[i], own, sig[i]
                elif a[i] == centre and (sig[i] == centre_sig).mean() >= low:
                    common = len(np.intersect1d(own, centre_set, assume_unique=True))
                    if 100 * common >= threshold * (len(own) + len(centre_set) - common):
                        found.append(i)
            yield pa.record_batch([pa.array([a[i] for i in found], pa.binary()), pa.array([b[i] for i in found], pa.binary())], names=["a", "b"])

    return star.mapInArrow(confirm, "a binary, b binary")


def _verify(edges: DataFrame, content: DataFrame, k: int, threshold: int, count: int, scratch: Scratch, name: str) -> DataFrame:
    """Those of the edges (centre, member) that hold on full sets. content: (key, sig, text) of all their ends."""
    edges = scratch.table(edges, f"{name}-edges")
    degree = edges.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("salts"))
    salted = edges.join(degree, "centre").withColumn("salt", F.pmod(F.xxhash64("member"), F.col("salts")).cast("int"))
    members = salted.select("centre", "salt", "member").join(content, F.col("member") == F.col("key")).select("centre", "salt", "member", F.lit(True).alias("is_member"), "sig", "text")
    centres = degree.join(content, F.col("centre") == F.col("key")).select("centre", F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"), F.col("centre").alias("member"), F.lit(False).alias("is_member"), "sig", "text")
    star = members.unionByName(centres).repartition("centre", "salt").sortWithinPartitions("centre", "salt", "is_member")
    return _confirmed(star, k, threshold, count)


def sketch(docs: DataFrame, k: int, count: int) -> DataFrame:
    """(rid, doc_id, text_hash, n_shingles, key, sig) of each document (rid, doc_id, text)."""

    def run(batches):
        for batch in batches:
            data, at = bytes_of(batch.column("text"))
            for i, j in row_runs(at):
                h, s = shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i], k)
                sig = signatures(h, s, count)
                yield pa.record_batch([*(batch.column(c).slice(i, j - i) for c in ("rid", "doc_id", "text_hash")), pa.array(np.diff(s), pa.int64()), pa.array(set_keys(h, s), pa.binary()), pa.array([x.tobytes() for x in sig], pa.binary())], names=["rid", "doc_id", "text_hash", "n_shingles", "key", "sig"])

    return docs.select("rid", "doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "rid long, doc_id long, text_hash long, n_shingles long, key binary, sig binary")


def link_classes(docs: DataFrame, sketches: DataFrame, scratch: Scratch, k: int, threshold: int, bands: int, rows: int) -> DataFrame:
    """(node, root) among the keys of sketches, which is a table of its own already."""
    spark, count = docs.sparkSession, bands * rows

    def explode(batches):
        for batch in batches:
            keys = batch.column("key")
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, count)
            yield pa.record_batch([keys.take(pa.array(np.repeat(np.arange(len(keys)), bands))), pa.array(band_hashes(sig, bands, rows).reshape(-1))], names=["key", "bucket"])

    # One row a class: the least document of each has the text and the signature that stand for it.
    own = F.struct("doc_id", "text_hash")
    classes = sketches.where("key is not null").groupBy("key").agg(F.min_by("sig", own).alias("sig"), F.min(own).alias("own"))
    classes = scratch.table(classes.select("key", "sig", F.col("own.doc_id").alias("own_id"), F.col("own.text_hash").alias("own_hash")), "classes")
    placed = classes.select("key", "sig").mapInArrow(explode, "key binary, bucket long")
    sizes = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("key").alias("least")).where("size > 1")
    shared = scratch.table(placed.join(sizes, "bucket"), "shared")
    free_shuffles(spark)
    popular = shared.groupBy("key").agg(F.sum("size").alias("shares"))
    best = shared.join(popular, "key").groupBy("bucket").agg(F.max(F.struct("shares", "key"))["key"].alias("centre"))
    stars = shared.join(best, "bucket").select(F.explode(F.array("centre", "least")).alias("centre"), F.col("key").alias("member")).where("centre <> member")
    stars = stars.select(F.greatest("centre", "member").alias("x"), F.least("centre", "member").alias("y"), "centre").groupBy("x", "y").agg(F.min("centre").alias("centre")).select("centre", F.expr("if(centre = x, y, x)").alias("member"))

    # Texts of the classes that share a bucket, by the document that stands for the class.
    wanted = scratch.table(popular.select("key").join(classes, "key"), "wanted")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).where(sieve(wanted, "own_hash", "own_id")("text_hash", "doc_id"))
    content = texts.join(wanted, (F.col("text_hash") == F.col("own_hash")) & F.col("doc_id").eqNullSafe(F.col("own_id")))
    content = scratch.table(content.select("key", "sig", "text").dropDuplicates(["key"]), "content", "zstd")
    scratch.drop("wanted")
    free_shuffles(spark)
    links = scratch.table(_verify(stars, content, k, threshold, count, scratch, "star"), "star-links")
    roots = scratch.table(components(links, scratch, "first"), "first-roots")
    free_shuffles(spark)

    # What a bucket still holds of different components: every pair of them, confirmed where the two lie.
    more = scratch.table(_apart(shared, classes, content, roots, scratch, k, threshold, bands, rows), "apart-links")
    scratch.drop("shared", "content", "mixed", "likely")
    free_shuffles(spark)
    if more.isEmpty():
        return roots
    return components(roots.toDF("a", "b").unionByName(more), scratch, "second")


def _faced(rows: DataFrame) -> DataFrame:
    """Send rows (bucket, key, root, is_main, bytes) to pairs of blocks: each block of a bucket's main component meets each block of the others
    (bi < 0), and the others' blocks meet each other (0 <= bi <= bj). A block has about BLOCK rows and BLOCK_BYTES bytes at most."""
    n = lambda side: F.greatest(F.lit(1), F.ceil(F.greatest(F.count_if(side) / blocks.BLOCK, F.coalesce(F.sum(F.when(side, F.col("bytes"))), F.lit(0)) / BLOCK_BYTES))).cast("int")
    sizes = rows.groupBy("bucket").agg(n(F.col("is_main")).alias("mains"), n(~F.col("is_main")).alias("others"))
    rows = rows.join(sizes, "bucket").withColumn("own", F.pmod(F.xxhash64(F.lit(11), "key"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    facing = F.expr("if(is_main, transform(sequence(0, others - 1), o -> named_struct('blk', 0, 'bi', -1 - o, 'bj', own)), transform(sequence(0, mains - 1), m -> named_struct('blk', 1, 'bi', -1 - own, 'bj', m)))")
    among = F.expr("if(is_main, array(), transform(sequence(0, others - 1), o -> named_struct('blk', own, 'bi', least(o, own), 'bj', greatest(o, own))))")
    return rows.select("bucket", "key", "root", "is_main", F.explode(F.concat(facing, among)).alias("at")).select("bucket", "key", "root", "is_main", "at.blk", "at.bi", "at.bj")


def _apart(shared: DataFrame, classes: DataFrame, content: DataFrame, roots: DataFrame, scratch: Scratch, k: int, threshold: int, bands: int, rows: int) -> DataFrame:
    """Confirmed links (a, b) between classes that share a bucket and are in different components.

    Signatures come first: they tell which classes of a bucket have a likely partner in another component there. Only these bring their texts.
    """
    count = bands * rows
    low = threshold / 100 - 5 * (threshold / 100 * (1 - threshold / 100) / count) ** 0.5
    labelled = shared.select("key", "bucket").join(roots, F.col("key") == F.col("node"), "left").select("key", "bucket", F.coalesce("root", "key").alias("root"))
    held = labelled.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    most = held.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("most"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("bucket", F.col("most.root").alias("main"))
    mixed = scratch.table(labelled.join(most, "bucket").select("bucket", "key", "root", (F.col("root") == F.col("main")).alias("is_main")), "mixed")

    def read(t: pa.Table, at: np.ndarray):
        """Of whole groups: keys, roots as numbers, and likely pairs (p, q, similarity) of different roots, in the first bucket that the two share."""
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, count)
        root = pd.factorize(t.column("root").to_pandas())[0]
        blk, bi, bj, bucket = (t.column(c).to_numpy() for c in ("blk", "bi", "bj", "bucket"))
        buckets = band_hashes(sig, bands, rows)

        def likely():
            for x, y in blocks.pairs(at, blk, bi, bj):
                far = root[x] != root[y]
                x, y = x[far], y[far]
                for i in range(0, len(x), 8192):
                    p, q = x[i : i + 8192], y[i : i + 8192]
                    same = (sig[p] == sig[q]).mean(1)
                    near = np.flatnonzero(same >= low)
                    p, q, same = p[near], q[near], same[near]
                    first = buckets[p, (buckets[p] == buckets[q]).argmax(1)] == bucket[p]
                    yield p[first], q[first], same[first]

        return root, likely()

    def partnered(batches):
        for t, at in blocks.whole_groups(batches, ["bucket", "bi", "bj"]):
            some = np.zeros(t.num_rows, bool)
            for p, q, _ in read(t, at)[1]:
                some[p] = some[q] = True
            yield from t.select(["bucket", "key", "root", "is_main"]).filter(pa.array(some)).combine_chunks().to_batches()

    def across(batches):
        for t, at in blocks.whole_groups(batches, ["bucket", "bi", "bj"]):
            root, found = read(t, at)
            p, q, same = (np.concatenate(x) for x in zip(*found, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))))
            keys, sets = t.column("key").to_pylist(), sets_of(t.column("text"), k)
            ends, parent = [], np.arange(int(root.max(initial=0)) + 1)

            def find(i):
                while parent[i] != i:
                    parent[i] = i = parent[parent[i]]
                return i

            # The likeliest first: components that have been joined need no other link.
            for i in np.argsort(-same, kind="stable").tolist():
                x, y = int(p[i]), int(q[i])
                a, b = find(root[x]), find(root[y])
                if a == b:
                    continue
                common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if 100 * common >= threshold * (len(sets[x]) + len(sets[y]) - common):
                    parent[a] = b
                    ends.append((keys[x], keys[y]))
            yield pa.record_batch([pa.array([e[0] for e in ends], pa.binary()), pa.array([e[1] for e in ends], pa.binary())], names=["a", "b"])

    group = ["bucket", "bi", "bj"]
    by_sig = _faced(mixed.withColumn("bytes", F.lit(0))).join(classes.select("key", "sig"), "key").repartition(*group).sortWithinPartitions(*group)
    likely = scratch.table(by_sig.mapInArrow(partnered, "bucket long, key binary, root binary, is_main boolean").distinct(), "likely")
    sizes = content.select("key", F.octet_length("text").cast("long").alias("bytes"))
    by_text = _faced(likely.join(sizes, "key")).join(content, "key").repartition(*group).sortWithinPartitions(*group)
    return by_text.mapInArrow(across, "a binary, b binary")


def labelled(docs: DataFrame, scratch: Scratch, k: int = 5, threshold: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """rid, doc_id, n_shingles, root, component of each document (rid, doc_id, text): root is the same in a group, and null for texts without words."""
    sketches = scratch.table(sketch(docs, k, bands * rows), "sketches")
    roots = scratch.table(link_classes(docs, sketches, scratch, k, threshold, bands, rows), "roots")
    narrow = sketches.select("rid", "doc_id", "n_shingles", "key")
    # The least doc_id by class, then by component, then back: groups of copies only meet in partial aggregates.
    classes = narrow.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("low")).join(roots, F.col("key") == F.col("node"), "left").select("key", F.coalesce("root", "key").alias("root"), "low")
    classes = scratch.table(classes, "class-roots")
    least = classes.groupBy("root").agg(F.min("low").alias("component"))
    names = scratch.table(classes.join(least, "root").select("key", "root", "component"), "names")
    return narrow.join(names, "key", "left").drop("key")


def near_duplicates(docs: DataFrame, k: int = 5, threshold: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each document (doc_id, text)."""
    spark = prepare(docs.sparkSession)
    docs = docs.select(F.lit(None).cast("long").alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = labelled(docs, Scratch(spark), k, threshold, bands, rows).withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """One document of each group, that of least doc_id, with all its columns. Texts without words all stay."""
    spark = prepare(docs.sparkSession)
    scratch, names = Scratch(spark), [f"c{i}" for i in range(len(docs.columns))]
    stored = scratch.table(docs.toDF(*names).withColumn("rid", F.monotonically_increasing_id()), "dedup-input", "zstd")
    doc_id, text = names[docs.columns.index("doc_id")], names[docs.columns.index("text")]
    groups = scratch.table(labelled(stored.select("rid", F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), scratch, k, threshold), "groups")
    scratch.drop(*(x for x in scratch.paths if x not in ("dedup-input", "groups")))
    first = groups.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid"))["rid"].alias("first"))
    dropped = scratch.table(groups.join(first, "root").where("rid <> first").select("rid"), "dropped")
    # Most documents stay where they are: only those that the sieve holds back meet the list of dropped ones.
    held = sieve(dropped, "rid")
    kept = stored.where(~held("rid")).unionByName(stored.where(held("rid")).join(dropped, "rid", "left_anti"))
    return kept.select(*names).toDF(*docs.columns)


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"), k=2)
