"""Series stored by buckets of their key, sorted by week: windows, groups and joins by series need no exchange.

A store is a folder of Parquet files and an entry in the session's catalog that says how they are dealt out;
`open_series` makes that entry in another session. Appends add files to the buckets and rewrite none.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epiweave.sources.shared import stage, unstage

WEEK = ("epi_year", "epi_week")


@dataclass(frozen=True)
class Series:
    spark: SparkSession
    name: str
    path: str
    k: tuple[str, ...]
    buckets: int

    def read(self) -> DataFrame:
        return self.spark.table(self.name)


def open_series(spark: SparkSession, path: str, schema: str, k: Sequence[str], buckets: int) -> Series:
    """The store at path, made if it is not there; schema (a DDL string), k and buckets are those it was made with."""
    name = f"series_{uuid.uuid4().hex[:12]}"
    order = ", ".join(f"`{c}`" for c in [*k, *WEEK])
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({', '.join(f'`{c}`' for c in k)}) SORTED BY ({order}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return Series(spark, name, path, tuple(k), buckets)


def append(store: Series, rows: DataFrame) -> int:
    """Adds the rows whose (k, week) is not stored yet and returns their number; of repeated ones the first by all columns.

    The stored side of the comparison is read bucket by bucket where it lies; only the new rows are dealt out.
    Rows are written once to a table of their own before, so a failed append leaves what was stored.
    Null keys or weeks are refused.
    """
    names = store.read().columns
    keys = [*store.k, *WEEK]
    if not rows.where(" or ".join(f"`{c}` is null" for c in keys)).isEmpty():
        raise ValueError("a row without its series or week")
    one = rows.select(*names).groupBy(*keys).agg(F.min(F.struct(*(c for c in names if c not in keys))).alias("_rest"))
    with _partial_keys(store.spark):
        new = one.join(store.read().select(*keys), keys, "left_anti").select(*keys, "_rest.*").select(*names)
        new = stage(new, "append")
    n = new.count()
    new.repartition(store.buckets, *store.k).write.insertInto(store.name)
    store.spark.catalog.refreshTable(store.name)
    unstage(new)
    return n


@contextmanager
def _partial_keys(spark: SparkSession):
    """Lets a join on (k, week) use sides that are dealt out by k alone."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    was = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def against(store: Series, other: Series, how: str = "inner") -> DataFrame:
    """Both stores joined by series and week; if they have the same buckets neither is moved."""
    keys = [*store.k, *WEEK]
    right = other.read().select(*keys, *(F.col(c).alias(f"other_{c}") for c in other.read().columns if c not in keys))
    return store.read().join(right, keys, how)
