"""Publication lag, coverage by lead, eligibility of forecasts, first observation of releases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epiweave.functions import calendar as cal

WEEK = ["epi_year", "epi_week"]


def lag_days(week_end: str, published: str) -> Column:
    return F.datediff(F.col(published), F.col(week_end))


def lag_stats(lags: DataFrame, by: Sequence[str], lag: str = "lag") -> DataFrame:
    """n, min, median, mean, p75, p90, max and sample deviation; quantiles are linear."""
    q = F.percentile(lag, F.array(F.lit(0.5), F.lit(0.75), F.lit(0.9)))
    out = lags.groupBy(*by).agg(F.count("*").alias("n"), F.min(lag).alias("min"), q.alias("_q"), F.avg(lag).alias("mean"), F.max(lag).alias("max"), F.stddev_samp(lag).alias("sd"))
    return out.select(*by, "n", "min", F.col("_q")[0].alias("median"), "mean", F.col("_q")[1].alias("p75"), F.col("_q")[2].alias("p90"), "max", "sd")


def explicit_year(label: str) -> Column:
    """The year only from a four-digit token of the label; otherwise unknown."""
    return F.regexp_extract(F.col(label), r"\b(19\d{2}|20\d{2})\b", 1).try_cast("int")


def lag_status(label: str, lag: str) -> Column:
    return F.when(explicit_year(label).isNull(), "unknown year").when(F.col(lag) < 0, "negative lag").otherwise("ok")


def zero_variance(lags: DataFrame, by: Sequence[str], lag: str = "lag") -> DataFrame:
    out = lags.groupBy(*by).agg(F.count("*").alias("n"), F.stddev_samp(lag).alias("sd"))
    return out.select(*by, "n", F.coalesce((F.col("sd") == 0) & (F.col("n") > 1), F.lit(False)).alias("warning"))


def batches(reports: DataFrame, by: Sequence[str], published: str = "published") -> DataFrame:
    """Release days with the weeks they cover, as a sorted list of keys."""
    return reports.groupBy(*by, published).agg(F.count("*").alias("n_weeks"), F.array_join(F.array_sort(F.collect_set(cal.week_key(*WEEK))), ",").alias("weeks"))


def boundary(reports: DataFrame, by: Sequence[str], published: str = "published") -> DataFrame:
    """Each week with its decision: the latest week of a batch is the boundary, the others are skipped."""
    rank = F.row_number().over(Window.partitionBy(*by, published).orderBy(F.desc("epi_year"), F.desc("epi_week")))
    return reports.withColumn("decision", F.when(rank == 1, "boundary").otherwise("skipped"))


def most_lag(lead: Column) -> Column:
    """A report is in time for a lead if its lag is below this number of days."""
    return 1 + 7 * (lead - 1)


def lag_coverage(lags: DataFrame, leads: Sequence[int], by: Sequence[str] = (), lag: str = "lag") -> DataFrame:
    """Share of reports in time, for each lead: one pass, a column a lead, then unpivoted."""
    hits = [F.count_if(F.col(lag) < 1 + 7 * (n - 1)).alias(f"_{n}") for n in leads]
    wide = lags.groupBy(*by).agg(F.count("*").alias("n"), *hits)
    long = wide.select(*by, "n", F.expr(f"stack({len(leads)}, " + ", ".join(f"{n}, _{n}" for n in leads) + ") AS (lead, eligible)"))
    return long.withColumn("coverage", F.col("eligible") / F.col("n"))


def boundary_yield(coverage: DataFrame, season_weeks: int = 25) -> DataFrame:
    return coverage.withColumn("per_season", F.col("coverage") * season_weeks)


def choose_lead(coverage: DataFrame, by: Sequence[str], target: float) -> DataFrame:
    """The smallest lead that reaches the declared coverage; null if none does."""
    return coverage.groupBy(*by).agg(F.min(F.when(F.col("coverage") >= target, F.col("lead"))).alias("lead"))


def windows(weeks: DataFrame, lead: int = 1) -> DataFrame:
    """By data week: target window and the last day on which a forecast may be logged."""
    start, end = cal.lead_window(cal.monday(*WEEK), lead)
    return weeks.select(*WEEK, start.alias("window_start"), end.alias("window_end"), F.date_sub(start, 1).alias("last_loggable_day"))


def scenarios(weeks: DataFrame, lags: dict[str, int], lead: int = 1, least: int = 10) -> DataFrame:
    """By named lag: how many windows could be logged in time, and the readout that follows."""
    w = windows(weeks, lead).withColumn("_end", cal.sunday(*WEEK))
    hits = [F.count_if(F.date_add("_end", n) <= F.col("last_loggable_day")).alias(s) for s, n in lags.items()]
    wide = w.agg(F.count("*").alias("of"), *hits)
    long = wide.select("of", F.expr(f"stack({len(lags)}, " + ", ".join(f"'{s}', {n}, `{s}`" for s, n in lags.items()) + ") AS (scenario, lag_days, eligible)"))
    return long.withColumn("readout", F.when(F.col("eligible") < least, "neutral_inconclusive_underpowered").otherwise("scoreable"))


#: Day, optional time (hour, minute, optional second and fraction) behind T or a blank, optional offset.
ISO_TIME = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2})(?::(\d{2})(?:[.,](\d{1,6})\d*)?)?(?:([Zz])|([+-]\d{2})(?::?(\d{2}))?)?)?$"


def iso_time(text: str) -> tuple[Column, Column]:
    """(instant, whether an offset is given) of an ISO 8601 time; the instant is null where it can't be read.

    Taken are a day, alone or with a time behind T or one blank: hh:mm, hh:mm:ss or hh:mm:ss with a fraction
    (microseconds count), then nothing, Z, +hh, +hhmm or +hh:mm. Days and times must exist; 24:00 does not.
    """
    part = lambda i: F.regexp_extract(F.trim(F.col(text)), ISO_TIME, i)
    or_ = lambda c, default: F.when(c == "", F.lit(default)).otherwise(c)
    offset = F.when(part(6) != "", F.concat(part(6), F.lit(":"), or_(part(7), "00"))).otherwise("Z")
    full = F.concat(part(1), F.lit("T"), or_(part(2), "00:00"), F.lit(":"), or_(part(3), "00"), F.lit("."), F.rpad(part(4), 6, "0"), offset)
    return F.try_to_timestamp(F.when(part(1) != "", full)), F.coalesce((part(5) != "") | (part(6) != ""), F.lit(False))


def guard(requests: DataFrame, by: Sequence[str], lead: int) -> DataFrame:
    """requests(by, epi_year, epi_week, issued_at text) -> reason: null if the forecast is eligible.

    Refused are times that are null or can't be read (`iso_time` says which can), then those without an
    offset, then weeks their year does not have, then a second request for one week (by the instant, among
    times that could be read), then requests not before Monday 00:00 UTC of the target's first week. lead has
    no default.
    """
    issued, offset = iso_time("issued_at")
    start = cal.monday(*WEEK)
    first = Window.partitionBy(*by, *WEEK).orderBy(F.desc(issued.isNotNull() & offset), issued, "issued_at")
    again = F.row_number().over(first) > 1
    opens = F.to_timestamp(F.concat(F.date_format(F.date_add(start, 7 * lead), "yyyy-MM-dd"), F.lit("T00:00:00Z")))
    reason = (
        F.when(issued.isNull(), "malformed_timestamp").when(~offset, "naive_timestamp_rejected").when(start.isNull(), "malformed_source_week")
        .when(again, "duplicate_data_through_week").when(issued >= opens, "target_already_started")
    )
    return requests.withColumn("reason", reason)


def first_observation(checks: DataFrame, by: Sequence[str]) -> DataFrame:
    """checks(by, week_end, checked_on, visible) -> bounds of the lag: last check in vain, first that saw it."""
    seen = checks.groupBy(*by, "week_end").agg(F.min(F.when(F.col("visible"), F.col("checked_on"))).alias("_first"), F.max(F.when(~F.col("visible"), F.col("checked_on"))).alias("_last"))
    return seen.select(*by, "week_end", F.datediff("_last", "week_end").alias("lag_lower"), F.datediff("_first", "week_end").alias("lag_upper"), F.col("_first").isNull().alias("open"))
