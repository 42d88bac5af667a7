"""Helpers shared by the training-data operators: columns, sorted runs, hot groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epiweave.sources.shared import shared_dir, stage, unstage

__all__ = ["binary_column", "bounded", "portions", "shared_dir", "sorted_runs", "spanning", "split_hot", "stage", "table", "text_column", "unstage"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def binary_column(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    return [b"" if x is None else x for x in batch.column(name).cast(pa.binary()).to_pylist()]


def text_column(batch: pa.RecordBatch, name: str) -> list[str]:
    return ["" if x is None else x for x in batch.column(name).to_pylist()]


def portions(texts: pa.Array, most_bytes: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """(first, number) of runs of texts of about `most_bytes` together, so that long texts don't add up.

    Arrow's free memory goes back after each, as workers live on and count against their executor.
    """
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most_bytes, "right")))
        yield at, to - at
        at = to
        pa.default_memory_pool().release_unused()


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[dict, np.ndarray]]:
    """Batches of a partition sorted by keys, regrouped so that no run of equal keys is cut.

    Yields the columns (name -> Arrow array) and the starts of the runs, the end included. Memory:
    one batch plus the longest run; callers split longer runs with `split_hot` beforehand.
    """

    def bounds(t: pa.Table) -> np.ndarray:
        new = np.zeros(len(t), bool)
        new[:1] = True
        for k in keys:
            v = t.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.append(np.flatnonzero(new), len(t))

    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        if rest is not None:
            t = pa.concat_tables([rest, t])
        cut = bounds(t)
        rest = t.slice(cut[-2]) if len(cut) > 1 else t
        if len(cut) > 2:
            head = t.slice(0, cut[-2])
            yield {n: head.column(n).combine_chunks() for n in head.column_names}, cut[:-1]
    if rest is not None and len(rest):
        yield {n: rest.column(n).combine_chunks() for n in rest.column_names}, bounds(rest)


def bounded(df: DataFrame, most_rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most most_rows rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def split_hot(rows: DataFrame, keys: list[str], member: str, most: int) -> DataFrame:
    """Adds chunk, cell_i, cell_j: groups of over `most` rows become pairs of chunks of about `most` rows.

    Every two rows of a group meet in at least one cell (rows of one chunk in several), so a task never
    holds more than two chunks. Ordinary groups keep one cell (0, 0). The counts are pre-aggregated;
    the hot keys are joined, broadcast only if there are at most 10,000 of them.
    """
    hot = rows.groupBy(*keys).count().where(F.col("count") > most)
    hot = stage(hot.select(*keys, F.ceil(F.col("count") / most).cast("int").alias("chunks")), "hot")
    if hot.isEmpty():
        return rows.withColumns({c: F.lit(0) for c in ("chunk", "cell_i", "cell_j")})
    joined = rows.join(bounded(hot, 10_000), keys, "left")
    n = F.coalesce("chunks", F.lit(1))
    chunk = F.pmod(F.xxhash64(member), n.cast("bigint")).cast("int")
    return (
        joined.withColumns({"chunk": chunk, "other": F.explode(F.sequence(F.lit(0), n - 1))})
        .withColumns({"cell_i": F.least("chunk", "other"), "cell_j": F.greatest("chunk", "other")})
        .drop("other", "chunks")
    )


def spanning(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, int]]:
    """Spanning forest of a group of n members: near(i, js) tells which of js link with i. At most n - 1 edges."""
    left = np.arange(n)
    queue: list[int] = []
    while len(left) or queue:
        if not queue:
            queue.append(int(left[0]))
            left = left[1:]
        i = queue.pop()
        if len(left):
            hit = near(i, left)
            if hit.any():
                found = left[hit]
                left = left[~hit]
                for j in found.tolist():
                    yield i, j
                    queue.append(j)
