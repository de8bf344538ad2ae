"""What the operators of this subpackage share: scratch tables, table loading, Arrow batch settings."""

from __future__ import annotations

import atexit
import functools
import os
import re
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python sees at most this many rows, and about this many bytes, of a table at once; and works on about so many bytes of text at once.
BATCH_ROWS, BATCH_BYTES, RUN_BYTES = 1024, 4 << 20, 1 << 20
#: `[^\x20\x09-\x0D]+`: a word is a run of anything but these six characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches that go to Python, by rows and by bytes; let Python workers import this package as the driver does."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset and driver and executors are one process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="querylens-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/querylens/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables written to the shared folder. A lost executor costs no more than the step that was running."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def table(self, df: DataFrame, name: str, codec: str = "snappy", partition_by: tuple[str, ...] = ()) -> DataFrame:
        path = new_path(self.spark, name)
        df.write.option("compression", codec).partitionBy(*partition_by).parquet(path)
        self.paths[name] = path
        _written.setdefault(self.spark.sparkContext.applicationId, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:  # those that are there
            if path := self.paths.pop(name, None):
                drop_path(self.spark, path)


_written: dict[str, list[str]] = {}


@atexit.register
def _clean() -> None:
    """At the end of the program, what is left of the scratch tables goes."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    try:
        for path in _written.get(spark.sparkContext.applicationId, []):
            drop_path(spark, path)
    except Exception:  # noqa: BLE001  the JVM may be gone already
        return


def free_shuffles(spark: SparkSession) -> None:
    """Shuffle files of steps whose results are written go once the JVM's cleaner sees that nothing refers to them."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def sieve(df: DataFrame, *keys: str, bits: int = 1 << 23):
    """A test of columns that is false only where no row of df has these keys, as a set of `bits` bits, whatever the size of df.

    Rows that fail it needn't go to a join on the keys. A df of many more rows than bits lets everything pass. The bits are a scalar subquery of
    bits / 8 bytes.
    """
    place = lambda columns: F.pmod(F.xxhash64(F.lit(23), *columns), F.lit(bits))
    words = df.select(place(keys).alias("place")).groupBy(F.expr("place div 64").alias("i")).agg(F.expr("bit_or(shiftleft(1L, cast(place % 64 as int)))").alias("w"))
    words = df.sparkSession.range(bits // 64).join(words, F.col("id") == F.col("i"), "left")
    one = words.agg(F.expr("transform(sort_array(collect_list(struct(id, coalesce(w, 0L) as w))), x -> x.w)").alias("words"))
    # Shifts, not divisions: places are under 2^31.
    return lambda *columns: F.bit_get(F.get(one.scalar(), F.shiftright(place(columns), 6).cast("int")), (place(columns) % 64).cast("int")) == 1


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def bytes_of(column: pa.Array) -> tuple["np.ndarray", "np.ndarray"]:
    """One uint8 buffer with the UTF-8 of all strings (or bytes of all binaries), and the n + 1 offsets. Nulls are empty."""
    import numpy as np

    kind = pa.large_binary()
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    column = column.cast(kind) if column.type != kind else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(column) and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def ranges(starts, lengths):
    """The concatenation of arange(start, start + length) of each pair."""
    import numpy as np

    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)


def mix64(x):
    """A bijection of uint64 that spreads all bits (the finaliser with two multiplications)."""
    import numpy as np

    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def row_runs(at, most: int = RUN_BYTES):
    """Of n + 1 offsets: (i, j) of consecutive rows that hold about `most` together, one row at least."""
    import numpy as np

    i, n = 0, len(at) - 1
    while i < n:
        j = max(int(np.searchsorted(at, at[i] + most, side="right")) - 1, i + 1)
        yield i, j
        i = j


@functools.cache
def _powers(n: int):
    import numpy as np

    one = np.ones(1, np.uint64)
    return tuple(np.cumprod(np.concatenate([one, np.full(n, b, np.uint64)])) for b in (RunHasher.BASE, pow(RunHasher.BASE, -1, 1 << 64)))


class RunHasher:
    """64-bit hashes of runs of a sequence, many at once, from prefix sums of a polynomial with an odd base (mod 2^64).

    The sums begin anew every WINDOW values, so memory doesn't grow with the sequence; a longer run is summed window by window.
    """

    BASE, WINDOW = 0x9E3779B97F4A7C15, 1 << 16

    def __call__(self, values, starts, lengths, spread=None):
        """Equal runs get equal hashes wherever they stand; the length is hashed too. Neither starts nor ends may descend.

        spread: a table by value (of bytes) instead of mix64(value + 1).
        """
        import numpy as np

        power, inverse = _powers(self.WINDOW)
        starts, ends = np.asarray(starts, np.int64), np.asarray(starts, np.int64) + np.asarray(lengths, np.int64)
        h, i = np.zeros(len(starts), np.uint64), 0

        def terms(a, b):
            # Each value is spread first: the low bits of a plain polynomial would mix badly.
            x = values[a:b]
            x = mix64(x.astype(np.uint64) + np.uint64(1)) if spread is None else spread[x]
            x *= power[: b - a]
            return x

        with np.errstate(over="ignore"):
            while i < len(starts):
                a = int(starts[i])
                j = int(np.searchsorted(ends, a + self.WINDOW, side="right"))
                if j <= i:
                    h[i] = sum(int(terms(b, min(b + self.WINDOW, int(ends[i]))).sum()) * pow(self.BASE, b - a, 1 << 64) for b in range(a, int(ends[i]), self.WINDOW)) % (1 << 64)
                    i += 1
                    continue
                b = int(ends[j - 1])
                sums = np.zeros(b - a + 1, np.uint64)
                np.cumsum(terms(a, b), out=sums[1:])
                first = starts[i:j] - a
                h[i:j] = (sums[ends[i:j] - a] - sums[first]) * inverse[first]
                i = j
            return mix64(h ^ (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
