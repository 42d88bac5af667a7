"""Lag, rolling and calendar features of weekly series, targets, labels and class weights.

Positions, not calendar weeks, decide lags: run `curation.missing_weeks` first where weeks may be missing.
All windows of a call share one partitioning and one sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epiweave.functions import calendar as cal

WEEK = ["epi_year", "epi_week"]
NINE = ("lag1", "lag2", "lag4", "lag8", "roll4", "roll8", "trend", "dry", "epi_week")


def _w(k: Sequence[str]):
    return Window.partitionBy(*k).orderBy(*WEEK)


def lags(weekly: DataFrame, k: Sequence[str], steps: Sequence[int] = (1, 2, 4, 8), value: str = "confirmed") -> DataFrame:
    """lag<n>: the value n rows before, 0 where there is none."""
    return weekly.withColumns({f"lag{n}": F.coalesce(F.lag(value, n).over(_w(k)), F.lit(0)) for n in steps})


def rolling(weekly: DataFrame, k: Sequence[str], widths: Sequence[int] = (4, 8), value: str = "confirmed") -> DataFrame:
    """roll<n>: mean of the up to n rows before (never the row itself), 0.0 where there is none."""
    return weekly.withColumns({f"roll{n}": F.coalesce(F.avg(value).over(_w(k).rowsBetween(-n, -1)), F.lit(0.0)) for n in widths})


def future_sum(weekly: DataFrame, k: Sequence[str], lead: int = 1, weeks: int = 4, value: str = "confirmed", name: str = "f4") -> DataFrame:
    """Sum of rows lead ... lead + weeks - 1 ahead; null unless all exist."""
    w = _w(k).rowsBetween(lead, lead + weeks - 1)
    return weekly.withColumn(name, F.when(F.count(value).over(w) == weeks, F.sum(value).over(w)))


def vector(weekly: DataFrame, k: Sequence[str]) -> DataFrame:
    """The nine features and t, the row's number in its series."""
    out = rolling(lags(weekly, k), k).withColumn("t", F.row_number().over(_w(k)))
    return out.withColumns({"trend": F.col("roll4") - F.col("roll8"), "dry": cal.dry_season("epi_week")})


def threshold(features: DataFrame, k: Sequence[str], last_year: int, expected: dict | float | None = None) -> DataFrame:
    """Exact median of f4 up to last_year for each series; a different expected value fails the job."""
    out = features.where(F.col("epi_year") <= last_year).groupBy(*k).agg(F.percentile("f4", 0.5).alias("threshold"))
    if expected is not None:
        wrong = F.abs(F.col("threshold") - F.lit(expected)) > 1e-9
        out = out.withColumn("threshold", F.when(wrong, F.raise_error(F.lit("threshold drifted"))).otherwise(F.col("threshold")))
    return out


def label(features: DataFrame, thresholds: DataFrame, k: Sequence[str]) -> DataFrame:
    """y: f4 strictly above the threshold; null without a full horizon."""
    return features.join(thresholds, list(k)).withColumn("y", (F.col("f4") > F.col("threshold")).cast("int"))


def history_filter(labelled: DataFrame, least: int = 8) -> DataFrame:
    return labelled.where((F.col("t") > least) & F.col("f4").isNotNull())


def split(labelled: DataFrame, last_train: int, test: int) -> DataFrame:
    return labelled.withColumn("part", F.when(F.col("epi_year") <= last_train, "train").when(F.col("epi_year") == test, "test").otherwise("reserve"))


def class_weight(labelled: DataFrame, k: Sequence[str]) -> DataFrame:
    """Negatives for each positive: the weight of positive rows in a fit."""
    n = labelled.groupBy(*k).agg(F.count_if(F.col("y") == 0).alias("negatives"), F.count_if(F.col("y") == 1).alias("positives"))
    return n.withColumn("weight", F.col("negatives") / F.greatest("positives", F.lit(1)))


def base_rate(labelled: DataFrame, k: Sequence[str]) -> DataFrame:
    parts = [F.count_if(F.col("part") == p).alias(f"n_{p}") for p in ("train", "test", "reserve")]
    return labelled.groupBy(*k).agg(F.count("*").alias("usable"), F.avg("y").alias("positive_rate"), *parts)
