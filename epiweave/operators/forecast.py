"""Shaping of forecasts: bands, alerts, records, weekly changes, counts, top lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epiweave.functions import calendar as cal

WEEK = ["epi_year", "epi_week"]
BANDS = ((0.75, "VERY HIGH"), (0.50, "HIGH"), (0.25, "MODERATE"))


def risk_band(p: str) -> Column:
    out = F.lit("LOW")
    for cut, name in reversed(BANDS):
        out = F.when(F.col(p) >= cut, name).otherwise(out)
    return out


def alert(p: str, cut: float = 0.5) -> Column:
    return F.col(p) >= cut


def window_is_future(week_end: Column, as_of: Column) -> Column:
    return cal.forecast_window(week_end)[1] > as_of


def week_change(probs: DataFrame, k: Sequence[str], p: str = "p", least: float = 0.01) -> DataFrame:
    c = F.col(p) - F.lag(p).over(Window.partitionBy(*k).orderBy(*WEEK))
    return probs.withColumn("change", c).withColumn("direction", F.when(F.col("change") >= least, "up").when(F.col("change") <= -least, "down").otherwise("flat"))


def risk_counts(probs: DataFrame, by: Sequence[str], place: str = "k", p: str = "p") -> DataFrame:
    """By week: places, places by band, and the high ones as a sorted list (one entry a place, so bounded)."""
    band = risk_band(p)
    high = band.isin("HIGH", "VERY HIGH")
    names = F.array_join(F.array_sort(F.collect_list(F.when(high, F.col(place)))), ",")
    return probs.groupBy(*by).agg(F.count("*").alias("n_states"), F.count_if(high).alias("n_high"), F.count_if(band == "MODERATE").alias("n_medium"), F.count_if(band == "LOW").alias("n_low"), names.alias("high"))


def top_k(probs: DataFrame, by: Sequence[str], n: int, place: str = "k", p: str = "p") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(p), place)
    return probs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def record(scored: DataFrame, p: str, features: Sequence[str]) -> DataFrame:
    """Adds record: the nested forecast record, rounded half to even (4 for probabilities, 3 for features)."""
    start, end = cal.forecast_window(cal.sunday(*WEEK))
    values = F.map_from_arrays(F.array(*map(F.lit, features)), F.array(*(F.bround(F.col(f).cast("double"), 3) for f in features)))
    through = F.struct(*WEEK, cal.sunday(*WEEK).alias("week_end_date"))
    window = F.struct(start.alias("start"), end.alias("end"), F.lit(4).alias("horizon_weeks"))
    return scored.withColumn("record", F.struct(through.alias("data_through"), window.alias("forecast_window"), F.bround(p, 4).alias("probability"), risk_band(p).alias("risk"), values.alias("feature_values")))
