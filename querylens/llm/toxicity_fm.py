"""Operator 9, toxicity by a factorization machine over hashed terms.

score(x) = sigmoid(b + sum_i w_i + 1/2 sum_f [(sum_i v_if)^2 - sum_i v_if^2]), over the distinct terms i of a text.
Terms are words and word beginnings (the first 4 and 6 characters) in lower case, hashed into 2^BITS slots with numpy, all
words of a batch at once. The pairwise part learns pairs of terms, such as an insult with the mention of a group, that
additive weights miss.

Training takes at most `max_rows` doc_ids, chosen by a hash of doc_id among those labelled whose crc32(doc_id) mod 5 isn't 0, and of each the
distinct hashed terms of its whole text, MAX_TERMS at most (those of least hash; the least such list where a doc_id has several texts). They go to the
driver with that bound, MAX_ROWS * MAX_TERMS * 4 bytes, where mini-batch Adagrad fits the model. Most terms are noise, so slots enter the model by
either of two tests:
* alone: in at least MIN_ROWS training rows, with a chi-square against the label of CHI2 or more (p = 1e-4);
* as a pair: among the PAIR_SLOTS slots that best split the rows (of slots in the same rows one counts), the interaction of two slots is the contrast
  p11 - p10 - p01 + p00 of the label's share with both, one, the other and neither; PAIR_CHI2 is p = 5e-11, 1e-4 over all pairs. So slots
  whose effect is only in pairs enter too, where a test of each alone sees nothing.
Scoring is one pass without a shuffle; the model is of fixed size. Labels, lang, source and doc_id are never inputs.

Defined results: null and empty texts have no terms and score sigmoid(b); a null doc_id or null label isn't trained
on, and a null doc_id isn't held out; several labels of a doc_id count as toxic if any is; repeated rows change neither the fit nor its size; without
labels of both classes every score is the share of positives (0.0 without any); extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import RUN_BYTES, RunHasher, bytes_of, load, mix64, prepare, ranges, row_runs

BITS, FACTORS, STEMS, MIN_ROWS, CHI2, PAIR_CHI2, PAIR_SLOTS = 20, 8, (4, 6), 4, 15.1, 43.0, 2048
#: The bounds of the training sample: documents, and terms of each.
MAX_ROWS, MAX_TERMS = 12_000, 4096
EPOCHS, BATCH, RATE, L2, SPREAD, SEED = 20, 128, 0.2, 1e-5, 0.1, 5

_hasher = RunHasher()


def terms(data: np.ndarray, at: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct slots of each text's terms, one text after the other, and n + 1 offsets.

    wanted: a mask of slots; others are left out.

    A word is a run of ASCII letters, digits and bytes over 127; its beginning ends at a whole character.
    """
    low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    # Upper case of two-byte Latin letters, U+00C0 to U+00DE: second byte 80 to 9E after C3.
    second = np.zeros(len(low), bool)
    second[1:] = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
    low = np.where(second, low + np.uint8(32), low)
    word = ((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57)) | (low >= 128)
    edge = np.zeros(len(low) + 1, bool)
    edge[at] = True
    before, after = np.zeros(len(low), bool), np.zeros(len(low), bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    head = (low & 0xC0) != 0x80  # first byte of a character
    chars = np.concatenate([[0], np.cumsum(head)])
    place = np.append(np.flatnonzero(head), len(low))
    doc = np.searchsorted(at, starts, side="right") - 1
    h = [_hasher(low, starts, ends - starts)]
    for n in STEMS:
        stem = np.minimum(ends, place[np.minimum(chars[starts] + n, len(place) - 1)])
        h.append(mix64(_hasher(low, starts, stem - starts) ^ np.uint64(n)))
    slots = [(x >> np.uint64(64 - BITS)).astype(np.int64) for x in h]
    if wanted is None:
        slot = np.concatenate([doc << BITS | x for x in slots])
    else:
        slot = np.concatenate([doc[m] << BITS | x[m] for x in slots for m in (np.flatnonzero(wanted[x]),)])
    slot = np.unique(slot)
    return (slot & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(slot >> BITS, np.arange(len(at)))


def terms_of(column, wanted: np.ndarray | None = None):
    """Runs of an Arrow column's rows: (i, j, slots, offsets). A text of several RUN_BYTES is cut at blanks, and its parts' slots are united."""
    data, at = bytes_of(column)
    for i, j in row_runs(at):
        a, b = int(at[i]), int(at[j])
        if b - a <= 2 * RUN_BYTES:
            yield i, j, *terms(data[a:b], at[i : j + 1] - a, wanted)
            continue
        found = [np.zeros(0, np.int32)]
        while a < b:
            blank = np.flatnonzero(data[min(a + RUN_BYTES, b) : b] == 32)[:1]
            end = min(a + RUN_BYTES, b) + int(blank[0]) if len(blank) else b
            found.append(terms(data[a:end], np.array([0, end - a]), wanted)[0])
            a = end
        one = np.unique(np.concatenate(found))
        yield i, j, one, np.array([0, len(one)])


@dataclass
class Model:
    bias: float
    w: np.ndarray  # (slots,)
    v: np.ndarray  # (slots, FACTORS)

    def score(self, slots: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Between 0 and 1 for each text."""
        n = len(at) - 1
        doc = np.repeat(np.arange(n), np.diff(at))
        raw = self.bias + np.bincount(doc, self.w[slots], n)
        v = self.v[slots].astype(np.float64)
        for f in range(v.shape[1]):
            raw += 0.5 * (np.bincount(doc, v[:, f], n) ** 2 - np.bincount(doc, v[:, f] ** 2, n))
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def _used(slots: np.ndarray, at: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slots that the model is fitted on, ascending: those that tell something alone, and those that do in a pair."""
    size, n, share = 1 << BITS, len(y), float(y.mean())
    held, toxic, rows = np.zeros(size), np.zeros(size), np.zeros(size, np.uint64)
    for i in range(0, n, 500):
        part, count = slots[at[i] : at[min(i + 500, n)]], np.diff(at[i : min(i + 500, n) + 1])
        held += np.bincount(part, minlength=size)
        toxic += np.bincount(part, np.repeat(y[i : i + 500], count), size)
        with np.errstate(over="ignore"):
            np.add.at(rows, part, np.repeat(mix64(np.arange(i + 1, i + 1 + len(count), dtype=np.uint64)), count))
    spread = held * (n - held) * share * (1 - share)
    chi2 = np.divide(n * (toxic - held * share) ** 2, spread, out=np.zeros(size), where=spread > 0)
    alone = np.flatnonzero((held >= MIN_ROWS) & (chi2 >= CHI2))
    # Slots of the same rows are the same term; those that split the rows best come first.
    some = np.flatnonzero((held >= MIN_ROWS) & (n - held >= MIN_ROWS))
    some = some[np.unique(rows[some], return_index=True)[1]]
    some = np.sort(some[np.argsort(-np.minimum(held[some], n - held[some]), kind="stable")][:PAIR_SLOTS])
    m = len(some)
    small = np.full(size, -1, np.int32)
    small[some] = np.arange(m)
    both, bad = np.zeros((m, m), np.float32), np.zeros((m, m), np.float32)
    for i in range(0, n, 500):
        part, count = small[slots[at[i] : at[min(i + 500, n)]]], np.diff(at[i : min(i + 500, n) + 1])
        x = np.zeros((len(count), m), np.float32)
        x[np.repeat(np.arange(len(count)), count)[part >= 0], part[part >= 0]] = 1
        both += x.T @ x
        x = x[y[i : i + 500] > 0]
        bad += x.T @ x
    best = np.zeros(m)
    for i in range(m):
        n11, t11 = both[i].astype(np.float64), bad[i].astype(np.float64)
        cells = [(n11, t11, 1), (held[some[i]] - n11, toxic[some[i]] - t11, -1), (held[some] - n11, toxic[some] - t11, -1), (n - held[some[i]] - held[some] + n11, y.sum() - toxic[some[i]] - toxic[some] + t11, 1)]
        contrast, error = np.zeros(m), np.zeros(m)
        for count, hits, sign in cells:
            p = (hits + 0.5) / (count + 1)
            contrast, error = contrast + sign * p, error + p * (1 - p) / (count + 1)
        z = contrast**2 / error
        z[i] = 0
        best[i] = z.max(initial=0)
    return np.union1d(alone, some[best >= PAIR_CHI2])


def fit(slots: np.ndarray, at: np.ndarray, y: np.ndarray, seed: int = SEED) -> Model:
    """Logistic loss, Adagrad in mini-batches, the same result for the same rows."""
    size = 1 << BITS
    w, v = np.zeros(size, np.float32), np.zeros((size, FACTORS), np.float32)
    share = float(y.mean()) if len(y) else 0.0
    if not 0 < share < 1:
        return Model(30.0 if share else -30.0, w, v)
    rng = np.random.default_rng(seed)
    used = _used(slots, at, y)
    small = np.full(size, -1, np.int32)
    small[used] = np.arange(len(used))
    ww, vv = np.zeros(len(used)), rng.normal(0, SPREAD, (len(used), FACTORS))
    gw, gv, bias, gb = np.full(len(used), 1e-3), np.full((len(used), FACTORS), 1e-3), float(np.log(share / (1 - share))), 1e-3
    keep = small[slots] >= 0
    doc = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(at))[keep]
    slots = small[slots[keep]]
    at = np.searchsorted(doc, np.arange(len(y) + 1)).astype(np.int64)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for i in range(0, len(order), BATCH):
            rows = order[i : i + BATCH]
            n = at[rows + 1] - at[rows]
            s, d = slots[ranges(at[rows], n)], np.repeat(np.arange(len(rows)), n)
            x = vv[s]
            total = np.stack([np.bincount(d, x[:, f], len(rows)) for f in range(FACTORS)], 1)
            raw = bias + np.bincount(d, ww[s], len(rows)) + 0.5 * ((total**2).sum(1) - np.bincount(d, (x**2).sum(1), len(rows)))
            g = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[rows]) / len(rows)
            u, back = np.unique(s, return_inverse=True)
            dw = np.bincount(back, g[d], len(u)) + L2 * ww[u]
            per = g[d][:, None] * (total[d] - x)
            dv = np.stack([np.bincount(back, per[:, f], len(u)) for f in range(FACTORS)], 1) + L2 * vv[u]
            gw[u] += dw**2
            gv[u] += dv**2
            gb += g.sum() ** 2
            ww[u] -= RATE * dw / np.sqrt(gw[u])
            vv[u] -= RATE * dv / np.sqrt(gv[u])
            bias -= RATE * g.sum() / np.sqrt(gb)
    w[used], v[used] = ww, vv
    return Model(float(bias), w, v)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, label: str = "toxic") -> Model:
    """Fit on labelled documents that aren't held out."""
    prepare(docs.sparkSession)
    labels = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    labels = labels.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id").select("doc_id", "y", F.coalesce("text", F.lit("")).alias("text"))

    def bounded(slots: np.ndarray) -> bytes:
        if len(slots) > MAX_TERMS:
            slots = np.sort(slots[np.argsort(mix64(slots.astype(np.uint64) + np.uint64(SEED)))[:MAX_TERMS]])
        return slots.astype(np.int32).tobytes()

    def extract(batches):
        for batch in batches:
            for i, j, slots, at in terms_of(batch.column("text")):
                yield pa.record_batch([batch.column("doc_id").slice(i, j - i), batch.column("y").slice(i, j - i), pa.array([bounded(slots[a:b]) for a, b in zip(at, at[1:])], pa.binary())], names=["doc_id", "y", "slots"])

    # One row a doc_id, however often it is there.
    got = rows.mapInArrow(extract, "doc_id long, y int, slots binary").groupBy("doc_id").agg(F.max("y").alias("y"), F.min("slots").alias("slots"))
    got = got.toArrow().sort_by([("doc_id", "ascending")])
    slots = np.frombuffer(b"".join(got.column("slots").to_pylist()), np.int32)
    at = np.concatenate([[0], np.cumsum([len(x) // 4 for c in got.column("slots").chunks for x in map(pa.Scalar.as_py, c)])]).astype(np.int64)
    return fit(slots, at, got.column("y").to_numpy().astype(np.float64))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, label: str = "toxic") -> Model:
    """Fit on labelled rows that aren't held out."""
    prepare(docs.sparkSession)
    labels = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    labels = labels.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id").select("doc_id", "y", F.coalesce("text", F.lit("")).alias("text"))

    def extract(batches):
        for batch in batches:
            slots, at = terms(*bytes_of(batch.column("text")))
            yield pa.record_batch([batch.column("doc_id"), batch.column("y"), pa.array([slots[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())], names=["doc_id", "y", "slots"])

    got = rows.mapInArrow(extract, "doc_id long, y int, slots binary").toArrow().sort_by([("doc_id", "ascending")])
    parts = [np.frombuffer(x, np.int32) for x in got.column("slots").to_pylist()]
    at = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
    return fit(np.concatenate(parts or [np.zeros(0, np.int32)]), at, got.column("y").to_numpy().astype(np.float64))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs, then score double."""
    spark = prepare(docs.sparkSession)
    used = np.flatnonzero((model.w != 0) | model.v.any(1))
    sent = spark.sparkContext.broadcast((model.bias, used.astype(np.int32), model.w[used], model.v[used]))
    names = [f"c{i}" for i in range(len(docs.columns))]
    kinds = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields))

    def run(batches):
        bias, slot, w, v = sent.value
        # Only the model's own slots are kept, numbered in their order.
        wanted, number = np.zeros(1 << BITS, bool), np.zeros(1 << BITS, np.int32)
        wanted[slot], number[slot] = True, np.arange(len(slot))
        m = Model(bias, w, v)
        for batch in batches:
            for i, j, slots, at in terms_of(batch.column("text_"), wanted):
                yield pa.record_batch([*(batch.column(n).slice(i, j - i) for n in names), pa.array(m.score(number[slots], at))], names=[*names, "score_"])

    plain = docs.toDF(*names)
    text = F.coalesce(F.col(names[docs.columns.index("text")]), F.lit("")).alias("text_")
    return plain.select("*", text).mapInArrow(run, f"{kinds}, score_ double").toDF(*docs.columns, "score")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Documents that score under the threshold, with their own columns."""
    out = scored(docs.toDF(*docs.columns), train(docs, labels))
    inner = out.toDF(*[f"c{i}" for i in range(len(docs.columns))], "score_")
    return inner.where(F.col("score_") < threshold).drop("score_").toDF(*docs.columns)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, load(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    out = scored(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
