"""Lag and eligibility queries: publication days of the region panel's weeks."""

from __future__ import annotations

from pyspark.sql import functions as F

from epiweave.operators import lags as lg

from .bindings import MONDAY, WEEK, bucket, sql_bucket, weekly, with_
from .registry import query

K = ["k"]
LEADS = (2, 3, 4, 5, 6)
_B = sql_bucket("CAST(k AS VARCHAR)", "CAST(epi_year AS VARCHAR)", "CAST(epi_week AS VARCHAR)")
_LAGS = {"lags": "SELECT k, epi_year, epi_week, published, week_end, CAST(published - week_end AS INTEGER) AS lag FROM weekly"}
_COVER = {**_LAGS, "cover": "SELECT k, lead, count(*) AS n, count(*) FILTER (WHERE lag < 1 + 7 * (lead - 1)) AS eligible, CAST(count(*) FILTER (WHERE lag < 1 + 7 * (lead - 1)) AS DOUBLE) / count(*) AS coverage FROM lags, (SELECT CAST(range AS INTEGER) AS lead FROM range(2, 7)) GROUP BY 1, 2"}


def _b():
    return bucket(*(F.col(c).cast("string") for c in ("k", *WEEK)))


def rows(spark, d):
    return weekly(spark, d).select("k", *WEEK, "published", "week_end", lg.lag_days("week_end", "published").alias("lag"))


def r6(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("lag_days", with_("weekly", "SELECT k, epi_year, epi_week, lag FROM lags", **_LAGS))
def lag_days(spark, d):
    return rows(spark, d).select("k", *WEEK, "lag")


@query("lag_stats", with_("weekly", "SELECT k, count(*) AS n, min(lag) AS min, quantile_cont(lag, 0.5) AS median, round(avg(lag), 6) AS mean, quantile_cont(lag, 0.75) AS p75, round(quantile_cont(lag, 0.9), 6) AS p90, max(lag) AS max, round(stddev_samp(lag), 6) AS sd FROM lags GROUP BY k", **_LAGS))
def lag_stats(spark, d):
    return r6(lg.lag_stats(rows(spark, d), K), "mean", "p90", "sd")


@query("lag_bad_year", with_("weekly", f"SELECT k, epi_year, epi_week, TRY_CAST(regexp_extract(label, '\\b(19\\d{{2}}|20\\d{{2}})\\b', 1) AS INTEGER) AS year, CASE WHEN regexp_extract(label, '\\b(19\\d{{2}}|20\\d{{2}})\\b', 1) = '' THEN 'unknown year' WHEN lag < 0 THEN 'negative lag' ELSE 'ok' END AS status FROM (SELECT k, epi_year, epi_week, lag - CASE WHEN {_B} % 9 = 0 THEN 60 ELSE 0 END AS lag, 'Week ' || epi_week || CASE WHEN {_B} % 5 = 0 THEN ' report' ELSE ' ' || epi_year || ' report' END AS label FROM lags)", **_LAGS))
def bad_year(spark, d):
    label = F.concat(F.lit("Week "), F.col("epi_week").cast("string"), F.when(_b() % 5 == 0, F.lit(" report")).otherwise(F.concat(F.lit(" "), F.col("epi_year").cast("string"), F.lit(" report"))))
    out = rows(spark, d).withColumns({"label": label, "lag": F.col("lag") - F.when(_b() % 9 == 0, 60).otherwise(0)})
    return out.select("k", *WEEK, lg.explicit_year("label").alias("year"), lg.lag_status("label", "lag").alias("status"))


@query("lag_zero_variance", with_("weekly", "SELECT k, epi_week, count(*) AS n, coalesce(stddev_samp(lag) = 0 AND count(*) > 1, false) AS warning FROM (SELECT k, epi_week, lag // 20 AS lag FROM lags) GROUP BY 1, 2", **_LAGS))
def zero_variance(spark, d):
    return lg.zero_variance(rows(spark, d).withColumn("lag", F.expr("lag div 20")), ["k", "epi_week"])


@query("lag_batches", with_("weekly", "SELECT k, published, count(*) AS n_weeks, string_agg(epi_year || '-W' || lpad(CAST(epi_week AS VARCHAR), 2, '0'), ',' ORDER BY epi_year, epi_week) AS weeks FROM weekly GROUP BY 1, 2"))
def batches(spark, d):
    return lg.batches(rows(spark, d), K)


@query("lag_boundary", with_("weekly", "SELECT k, epi_year, epi_week, CASE WHEN row_number() OVER (PARTITION BY k, published ORDER BY epi_year DESC, epi_week DESC) = 1 THEN 'boundary' ELSE 'skipped' END AS decision FROM weekly"))
def boundary(spark, d):
    return lg.boundary(rows(spark, d), K).select("k", *WEEK, "decision")


@query("lag_coverage", with_("weekly", "SELECT k, lead, n, eligible, round(coverage, 6) AS coverage FROM cover", **_COVER))
def coverage(spark, d):
    return r6(lg.lag_coverage(rows(spark, d), LEADS, K), "coverage")


@query("lag_boundary_yield", with_("weekly", "SELECT k, lead, n, eligible, round(coverage, 6) AS coverage, round(coverage * 25, 6) AS per_season FROM cover", **_COVER))
def boundary_yield(spark, d):
    return r6(lg.boundary_yield(lg.lag_coverage(rows(spark, d), LEADS, K)), "coverage", "per_season")


@query("lag_choose_lead", with_("weekly", "SELECT k, min(lead) FILTER (WHERE coverage >= 0.7) AS lead FROM cover GROUP BY k", **_COVER))
def choose_lead(spark, d):
    return lg.choose_lead(lg.lag_coverage(rows(spark, d), LEADS, K), K, 0.7)


_WEEKS = "SELECT DISTINCT epi_year, epi_week FROM panel"


@query("elig_windows", with_("panel", f"SELECT epi_year, epi_week, {MONDAY} + 7 AS window_start, {MONDAY} + 34 AS window_end, {MONDAY} + 6 AS last_loggable_day FROM ({_WEEKS})"))
def windows(spark, d):
    return lg.windows(weekly(spark, d).select(*WEEK).distinct())


_SCENARIOS = {"same_day": 0, "measured": 6, "typical": 17, "worst": 44}


@query("elig_scenarios", with_("panel", " UNION ALL ".join(f"SELECT '{s}' AS scenario, {n} AS lag_days, count(*) AS \"of\", count(*) FILTER (WHERE {MONDAY} + 6 + {n} <= {MONDAY} + 13) AS eligible, CASE WHEN count(*) FILTER (WHERE {MONDAY} + 6 + {n} <= {MONDAY} + 13) < 10 THEN 'neutral_inconclusive_underpowered' ELSE 'scoreable' END AS readout FROM ({_WEEKS})" for s, n in _SCENARIOS.items())))
def scenarios(spark, d):
    return lg.scenarios(weekly(spark, d).select(*WEEK).distinct(), _SCENARIOS, lead=2)


_KIND = "CASE WHEN b % 7 = 0 THEN 'naive' WHEN b % 29 = 1 THEN 'none' WHEN b % 31 = 2 THEN 'rubbish' WHEN b % 5 = 0 THEN 'east' ELSE 'utc' END"
_REQ = {
    "base": f"SELECT k, epi_year, CASE WHEN b % 19 = 0 THEN 54 ELSE epi_week END AS epi_week, published, {_KIND} AS kind, b FROM (SELECT *, {_B} AS b FROM weekly)",
    # minute: the instant in UTC, as the day's minutes
    "req": """SELECT k, epi_year, epi_week, published, CASE kind WHEN 'naive' THEN strftime(published, '%Y-%m-%d') || 'T10:00:00' WHEN 'rubbish' THEN 'rubbishZ' WHEN 'east' THEN strftime(published, '%Y-%m-%d') || 'T10:00:00+05:00' WHEN 'utc' THEN strftime(published, '%Y-%m-%d') || ['T10:00:00Z', 'T10:00Z', ' 10:00:00+00:00', 'T15:30:00.0+0530'][b % 4 + 1] END AS issued_at,
        CASE kind WHEN 'east' THEN 300 WHEN 'utc' THEN 600 END AS minute, kind FROM base UNION ALL SELECT k, epi_year, epi_week, published, strftime(published, '%Y-%m-%d') || 'T12:00:00+05:00', 420, 'again' FROM base WHERE b % 23 = 0""",
}


@query("elig_guard", with_("weekly", f"""SELECT k, epi_year, epi_week, issued_at, CASE WHEN kind IN ('none', 'rubbish') THEN 'malformed_timestamp' WHEN kind = 'naive' THEN 'naive_timestamp_rejected' WHEN epi_week > week(make_date(epi_year, 12, 28)) THEN 'malformed_source_week'
    WHEN row_number() OVER (PARTITION BY k, epi_year, epi_week ORDER BY minute IS NULL, published, minute) > 1 THEN 'duplicate_data_through_week' WHEN published >= {MONDAY} + 28 THEN 'target_already_started' END AS reason FROM req""", **_REQ))
def guard(spark, d):
    day = F.date_format("published", "yyyy-MM-dd")
    b = F.col("b")
    kind = F.when(b % 7 == 0, F.concat(day, F.lit("T10:00:00"))).when(b % 29 == 1, F.lit(None)).when(b % 31 == 2, F.lit("rubbishZ"))
    stamp = kind.when(b % 5 == 0, F.concat(day, F.lit("T10:00:00+05:00"))).otherwise(F.concat(day, F.element_at(F.array(*map(F.lit, ("T10:00:00Z", "T10:00Z", " 10:00:00+00:00", "T15:30:00.0+0530"))), (b % 4 + 1).cast("int"))))
    req = weekly(spark, d).withColumn("b", _b()).withColumns({"issued_at": stamp, "epi_week": F.when(b % 19 == 0, 54).otherwise(F.col("epi_week"))})
    again = req.where("b % 23 = 0").withColumn("issued_at", F.concat(day, F.lit("T12:00:00+05:00")))
    c = ["k", *WEEK, "issued_at"]
    return lg.guard(req.select(*c).union(again.select(*c)), K, lead=4)


@query("elig_first_obs", with_("weekly", """SELECT k, week_end, CAST(max(day) FILTER (WHERE NOT visible) - week_end AS INTEGER) AS lag_lower, CAST(min(day) FILTER (WHERE visible) - week_end AS INTEGER) AS lag_upper, count(*) FILTER (WHERE visible) = 0 AS open
    FROM (SELECT k, week_end, week_end + 5 * i AS day, week_end + 5 * i >= published AS visible FROM weekly, (SELECT CAST(range AS INTEGER) AS i FROM range(1, 9))) GROUP BY k, week_end"""))
def first_obs(spark, d):
    w = weekly(spark, d).select("k", "week_end", "published", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("i"))
    checks = w.select("k", "week_end", F.date_add("week_end", (5 * F.col("i")).cast("int")).alias("checked_on"), "published").withColumn("visible", F.col("checked_on") >= F.col("published"))
    return lg.first_observation(checks, K)
