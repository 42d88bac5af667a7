"""Evidence board: upsert with greatest scores and merged metadata, decay, counts, lists by type."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DECAY = 0.97


def decay(items: DataFrame, score: str = "score", rate: float = DECAY) -> DataFrame:
    return items.withColumn("decay_score", F.col(score) * rate)


def upsert(board: DataFrame, updates: DataFrame, k: Sequence[str]) -> DataFrame:
    """(k, state, score, metadata): new state replaces, the greater score stays, metadata merge and the new value wins."""
    new = updates.select(*k, *(F.col(c).alias(f"_{c}") for c in ("state", "score", "metadata")))
    both = board.join(new, list(k), "full")
    merged = F.when(F.col("_metadata").isNull(), F.col("metadata")).when(F.col("metadata").isNull(), F.col("_metadata")).otherwise(F.map_zip_with("metadata", "_metadata", lambda _, x, y: F.coalesce(y, x)))
    return both.select(*k, F.coalesce("_state", "state").alias("state"), F.greatest("score", "_score").alias("score"), merged.alias("metadata"))


def counts(board: DataFrame, by: Sequence[str]) -> DataFrame:
    return board.groupBy(*by).agg(F.count("*").alias("n"))


def by_type(board: DataFrame, column: str, value: str, fields: Sequence[str]) -> DataFrame:
    """Items of a type with fields of their metadata, the greatest score first."""
    return board.where(F.col(column) == value).select("*", *(F.col("metadata")[f].alias(f"meta_{f}") for f in fields)).orderBy(F.desc("score"))
