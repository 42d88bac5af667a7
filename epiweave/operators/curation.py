"""From cumulative reports to a weekly series: last report wins, differences, gaps, cross-checks, versions.

`k` is the list of key columns of a series; weeks are (epi_year, epi_week).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epiweave.functions import calendar as cal

WEEK = ["epi_year", "epi_week"]


def last_wins(reports: DataFrame, k: Sequence[str], order: str) -> DataFrame:
    """One report for each key and week: that with the greatest `order`."""
    rest = [c for c in reports.columns if c not in (*k, *WEEK)]
    best = reports.groupBy(*k, *WEEK).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return best.select(*k, *WEEK, *(F.col(f"_r.{c}").alias(c) for c in rest))


def year_scope(df: DataFrame, first: int, last: int) -> DataFrame:
    """The years first to last; a plain filter, so it reaches the scan and its partitions."""
    return df.where(F.col("epi_year").between(first, last))


def _with_previous(reports: DataFrame, k: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Adds prev_<measure>: the cumulative value a week before in the same year, 0 before week 1, null if missing.

    A window on (k, year) whose last row counts only if it is the week just before: one shuffle and one
    sort, no self-join.
    """
    w = Window.partitionBy(*k, "epi_year").orderBy("epi_week")
    follows = F.lag("epi_week").over(w) == F.col("epi_week") - 1
    return reports.withColumns(
        {f"prev_{m}": F.when(F.col("epi_week") == 1, F.lit(0)).when(follows, F.lag(f"cum_{m}").over(w)) for m in measures}
    )


def _status(measures: Sequence[str]) -> Column:
    changes = [F.col(f"cum_{m}") - F.col(f"prev_{m}") for m in measures]
    negative = F.least(*changes) < 0 if len(changes) > 1 else changes[0] < 0
    return F.when(F.col(f"prev_{measures[0]}").isNull(), "missing predecessor").when(negative, "negative difference")


def cumulative_difference(reports: DataFrame, k: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Weekly counts: differences of consecutive weeks of a year; weeks without predecessor or with a fall are left out."""
    rows = _with_previous(reports, k, measures).withColumn("_s", _status(measures)).where("_s is null")
    return rows.select(*k, *WEEK, *((F.col(f"cum_{m}") - F.col(f"prev_{m}")).alias(m) for m in measures))


def gap_report(reports: DataFrame, k: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """The weeks that cumulative_difference leaves out, with the reason."""
    rows = _with_previous(reports, k, measures).withColumn("reason", _status(measures)).where("reason is not null")
    return rows.select(*k, *WEEK, "reason")


def append_new(existing: DataFrame, new: DataFrame, k: Sequence[str]) -> DataFrame:
    """The rows of new whose key and week existing does not hold."""
    return new.join(existing.select(*k, *WEEK).distinct(), [*k, *WEEK], "left_anti")


def crosscheck(existing: DataFrame, new: DataFrame, reports: DataFrame, k: Sequence[str], measure: str = "confirmed") -> DataFrame:
    """By year: the sum of weekly counts up to the latest reported week against the reported cumulative."""
    latest = reports.groupBy(*k, "epi_year").agg(F.max("epi_week").alias("latest_week"), F.max_by(f"cum_{measure}", "epi_week").alias("reported"))
    every = existing.select(*k, *WEEK, measure).union(new.select(*k, *WEEK, measure))
    sums = every.join(latest, [*k, "epi_year"]).groupBy(*k, "epi_year").agg(F.sum(F.when(F.col("epi_week") <= F.col("latest_week"), F.col(measure)).otherwise(0)).alias("reconstructed"))
    out = latest.join(sums, [*k, "epi_year"], "left").withColumn("reconstructed", F.coalesce("reconstructed", F.lit(0)))
    return out.withColumn("status", F.when(F.col("reconstructed") == F.col("reported"), "OK").otherwise("MISMATCH"))


def reconcile(reports: DataFrame, narrative: DataFrame, k: Sequence[str], measure: str = "confirmed") -> DataFrame:
    """Cumulative difference against the count told in the text: difference, discrepancy, agrees or differs."""
    diff = cumulative_difference(reports, k, [measure]).withColumnRenamed(measure, "difference")
    out = diff.join(narrative.select(*k, *WEEK, "narrative"), [*k, *WEEK]).withColumn("discrepancy", F.col("difference") - F.col("narrative"))
    return out.withColumn("status", F.when(F.col("discrepancy") == 0, "agrees").otherwise("differs"))


def annual_totals(weekly: DataFrame, k: Sequence[str], measure: str = "confirmed") -> DataFrame:
    return weekly.groupBy(*k, "epi_year").agg(F.sum(measure).alias("total"))


def two_source(a: DataFrame, b: DataFrame, k: Sequence[str], measure: str = "confirmed", tolerance: float = 0.01) -> DataFrame:
    """Annual totals of two extractions: relative difference to b and whether it is within the tolerance."""
    left, right = annual_totals(a, k, measure).withColumnRenamed("total", "a"), annual_totals(b, k, measure).withColumnRenamed("total", "b")
    both = left.join(right, [*k, "epi_year"], "full")
    return both.withColumn("rel_diff", F.when(F.col("b") != 0, F.abs(F.col("a") - F.col("b")) / F.col("b"))).withColumn("within", F.col("rel_diff") <= tolerance)


def coverage(reports: DataFrame, k: Sequence[str], measure: str = "confirmed") -> DataFrame:
    return reports.groupBy(*k, "epi_year").agg(F.count("*").alias("weeks"), F.max_by(f"cum_{measure}", "epi_week").alias("latest_cumulative"))


def seasonal_profile(weekly: DataFrame, k: Sequence[str], measure: str = "confirmed") -> DataFrame:
    return weekly.where("epi_week <= 52").groupBy(*k, "epi_week").agg(F.avg(measure).alias("mean_count"))


def line_list_weekly(rows: DataFrame, place: str, day: str) -> DataFrame:
    return rows.groupBy(F.col(place).alias("k"), cal.iso_year(day).alias("epi_year"), cal.iso_week(day).alias("epi_week")).agg(F.count("*").alias("n"))


def place_rank(rows: DataFrame, place: str, day: str) -> DataFrame:
    """Places by their number of cases, and their peak month (the earlier among equals)."""
    months = rows.groupBy(F.col(place).alias("k"), F.month(day).alias("month")).agg(F.count("*").alias("n"))
    places = months.groupBy("k").agg(F.sum("n").alias("n"), F.max_by("month", F.struct("n", -F.col("month"))).alias("peak_month"))
    return places.withColumn("rank", F.rank().over(Window.orderBy(F.desc("n"))))  # one row a place: a small table


def weather_weekly(daily: DataFrame, place: str, day: str) -> DataFrame:
    """daily(place, day, temperature, humidity, rain, dew_point, wind) -> weeks: means, the sum of rain, the strongest wind, days observed."""
    return daily.groupBy(F.col(place).alias("k"), cal.iso_year(day).alias("epi_year"), cal.iso_week(day).alias("epi_week")).agg(
        F.avg("temperature").alias("temperature"), F.avg("humidity").alias("humidity"), F.sum("rain").alias("rain"), F.avg("dew_point").alias("dew_point"), F.max("wind").alias("wind"), F.count_distinct(F.to_date(day)).alias("obs_days")
    )


def outer_merge(cases: DataFrame, weather: DataFrame, k: Sequence[str]) -> DataFrame:
    """Full outer join on key and week with has_cases and has_weather."""
    a, b = cases.withColumn("_a", F.lit(True)), weather.withColumn("_b", F.lit(True))
    both = a.join(b, [*k, *WEEK], "full")
    return both.withColumns({"has_cases": F.col("_a").isNotNull(), "has_weather": F.col("_b").isNotNull()}).drop("_a", "_b")


def missing_weeks(weekly: DataFrame, k: Sequence[str]) -> DataFrame:
    """Weeks between a series' first and last without a row: never interpolated, only listed."""
    days = weekly.select(*k, cal.monday(*WEEK).alias("day"))
    spine = days.groupBy(*k).agg(F.min("day").alias("a"), F.max("day").alias("b")).select(*k, F.explode(F.sequence("a", "b", F.expr("interval 7 days"))).alias("day"))
    return spine.join(days, [*k, "day"], "left_anti").select(*k, cal.iso_year("day").alias("epi_year"), cal.iso_week("day").alias("epi_week"))


def first_published(versions: DataFrame, k: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    return versions.groupBy(*k).agg(F.min_by(value, F.struct(*order)).alias("first_value"), F.min(order[0]).alias("first_published"))


def revised(versions: DataFrame, k: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """First and latest value and the revision between them: one aggregation, no sort."""
    out = versions.groupBy(*k).agg(F.min_by(value, F.struct(*order)).alias("first_value"), F.max_by(value, F.struct(*order)).alias("last_value"))
    return out.withColumn("delta", F.col("last_value") - F.col("first_value"))


def as_of(events: DataFrame, versions: DataFrame, k: Sequence[str], t: str, value: str, order: Sequence[str]) -> DataFrame:
    """Each event with the latest version published strictly before it; null where there is none.

    Both sides are stacked and a window keeps the last version seen: one shuffle on the key and one sort,
    instead of a join of all earlier pairs. Events come before versions of the same instant.
    """
    keys = [F.col(c) for c in k]
    left = events.select(*keys, F.col(t).alias("_t"), F.lit(0).alias("_kind"), F.struct(*events.columns).alias("_e"), F.lit(None).cast(versions.schema[value].dataType).alias("_v"), *(F.lit(None).cast(versions.schema[c].dataType).alias(f"_{i}") for i, c in enumerate(order[1:])))
    right = versions.select(*keys, F.col(order[0]).alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast(left.schema["_e"].dataType).alias("_e"), F.col(value).alias("_v"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(order[1:])))
    w = Window.partitionBy(*k).orderBy("_t", "_kind", *(f"_{i}" for i in range(len(order) - 1)))
    last = F.last(F.when(F.col("_kind") == 1, F.struct("_v")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return left.unionByName(right).withColumn("_last", last).where("_kind = 0").select("_e.*", F.col("_last._v").alias("known_value"))
