"""All pairs within groups of any size, in bounded memory: large groups become pairs of blocks, small ones share a pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members of a block; pairs held at once; about so many bytes of rows at once.
BLOCK, PAIRS, BYTES = 256, 1 << 18, 6 << 20


def block_pairs(df: DataFrame, member: str, size: str, block: int = BLOCK) -> DataFrame:
    """Send each row to every pair of blocks (bi <= bj) of its group that its own block `blk` is in.

    size: the number of rows in the row's group. Groups of up to one block are one task key (0, 0).
    """
    n = F.ceil(F.col(size) / block).cast("int")
    df = df.withColumn("blk", F.pmod(F.xxhash64(F.lit(11), F.col(member)), F.greatest(n, F.lit(1))).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1))
    return df.withColumn("other", other).withColumn("bi", F.least("blk", "other")).withColumn("bj", F.greatest("blk", "other")).drop("other")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 8192) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches sorted by keys, cut anew so that no group is split: tables, and where groups begin (with the end)."""
    held: list[pa.RecordBatch] = []
    count = size = 0

    def edges(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for k in keys:
            c = t.column(k).combine_chunks()
            x = c.to_numpy(zero_copy_only=False)
            new[1:] |= x[1:] != x[:-1]
        return np.append(np.flatnonzero(new), t.num_rows)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        size += batch.nbytes
        if count < rows and size < BYTES:
            continue
        t = pa.Table.from_batches(held)
        at = edges(t)
        if len(at) > 2:
            yield t.slice(0, at[-2]), at[:-1]
            held = t.slice(at[-2]).to_batches()
            count = t.num_rows - at[-2]
            size = t.slice(at[-2]).nbytes
    if held:
        t = pa.Table.from_batches(held)
        yield t, edges(t)


def pairs(at: np.ndarray, blk: np.ndarray, bi: np.ndarray, bj: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs (x < y) of each group; where a group is a pair of different blocks, only those across."""
    sizes = np.diff(at)
    row = np.repeat(at[:-1], sizes)
    after = np.repeat(at[1:], sizes) - np.arange(at[-1]) - 1  # later rows in the group of each row
    del row
    done = 0
    sums = np.concatenate([[0], np.cumsum(after)])
    while done < at[-1]:
        end = max(int(np.searchsorted(sums, sums[done] + PAIRS, side="right")) - 1, done + 1)
        n = after[done:end]
        x = np.repeat(np.arange(done, end), n)
        y = x + 1 + (np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n))
        keep = (bi[x] == bj[x]) | (blk[x] != blk[y])
        yield x[keep], y[keep]
        done = end


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Indices of edges that join what wasn't joined before: at most one fewer than there are nodes."""
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, (x, y) in enumerate(zip(a, b)):
        x, y = find(x), find(y)
        if x != y:
            parent[x] = y
            out.append(i)
    return np.array(out, np.int64)


Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
