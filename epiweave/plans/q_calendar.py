"""Calendar queries: over the distinct days, weeks and years of the orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from epiweave.functions import calendar as cal

from .bindings import MONDAY, WEEK, panel, read, with_
from .registry import query

_WEEKS = "SELECT DISTINCT epi_year, epi_week FROM panel"


def _weeks(spark, d):
    return panel(spark, d).select(*WEEK).distinct()


def _days(spark, d):
    return read(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()


@query("cal_iso_bounds", with_("panel", f"SELECT epi_year, w AS epi_week, CASE WHEN w <= week(make_date(epi_year, 12, 28)) THEN {MONDAY.replace('epi_week', 'w')} END AS monday, CASE WHEN w <= week(make_date(epi_year, 12, 28)) THEN {MONDAY.replace('epi_week', 'w')} + 6 END AS sunday FROM (SELECT DISTINCT epi_year FROM panel), (SELECT CAST(range AS INTEGER) AS w FROM range(1, 54))"))
def iso_bounds(spark, d):
    years = panel(spark, d).select("epi_year").distinct().withColumn("epi_week", F.explode(F.sequence(F.lit(1), F.lit(53))))
    return years.select(*WEEK, cal.monday(*WEEK).alias("monday"), cal.sunday(*WEEK).alias("sunday"))


@query("cal_iso_week", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, CAST(isoyear(o_orderdate) AS INTEGER) AS epi_year, CAST(week(o_orderdate) AS INTEGER) AS epi_week FROM orders")
def iso_week(spark, d):
    return _days(spark, d).select("day", cal.iso_year("day").alias("epi_year"), cal.iso_week("day").alias("epi_week"))


@query("cal_long_year", with_("panel", "SELECT DISTINCT epi_year, week(make_date(epi_year, 12, 28)) = 53 AS long_year FROM panel"))
def long_year(spark, d):
    return panel(spark, d).select("epi_year").distinct().select("epi_year", cal.is_long_year("epi_year").alias("long_year"))


@query("cal_dry_season", with_("panel", "SELECT DISTINCT epi_year, epi_week, CAST(epi_week <= 17 OR epi_week >= 45 AS INTEGER) AS dry FROM panel"))
def dry_season(spark, d):
    return _weeks(spark, d).select(*WEEK, cal.dry_season("epi_week").alias("dry"))


@query("cal_season_id", with_("panel", "SELECT DISTINCT epi_year, epi_week, CASE WHEN epi_week >= 45 THEN epi_year WHEN epi_week <= 17 THEN epi_year - 1 END AS season FROM panel"))
def season_id(spark, d):
    return _weeks(spark, d).select(*WEEK, cal.season_id(*WEEK).alias("season"))


@query("cal_season_member", with_("panel", "SELECT DISTINCT epi_year, epi_week FROM panel WHERE epi_year * 100 + epi_week BETWEEN 199845 AND 199917"))
def season_member(spark, d):
    return _weeks(spark, d).where(cal.in_window(*WEEK, 199845, 199917))


@query("cal_harmonics", with_("panel", "SELECT DISTINCT epi_week, round(sin(2 * pi() * (epi_week - 1) / 52), 6) AS s1, round(cos(2 * pi() * (epi_week - 1) / 52), 6) AS c1, round(sin(4 * pi() * (epi_week - 1) / 52), 6) AS s2, round(cos(4 * pi() * (epi_week - 1) / 52), 6) AS c2 FROM panel"))
def harmonics(spark, d):
    return panel(spark, d).select("epi_week").distinct().select("epi_week", *(F.round(c, 6).alias(n) for n, c in cal.harmonics("epi_week").items()))


@query("cal_forecast_window", with_("panel", f"SELECT DISTINCT epi_year, epi_week, {MONDAY} + 7 AS window_start, {MONDAY} + 34 AS window_end FROM panel"))
def forecast_window(spark, d):
    start, end = cal.forecast_window(cal.sunday(*WEEK))
    return _weeks(spark, d).select(*WEEK, start.alias("window_start"), end.alias("window_end"))


@query("cal_target_weeks", with_("panel", f"SELECT epi_year, epi_week, CAST(i + 1 AS INTEGER) AS step, CAST(isoyear({MONDAY} + 7 + 7 * i) AS INTEGER) AS target_year, CAST(week({MONDAY} + 7 + 7 * i) AS INTEGER) AS target_week FROM ({_WEEKS}), (SELECT CAST(range AS INTEGER) AS i FROM range(4))"))
def target_weeks(spark, d):
    start, _ = cal.forecast_window(cal.sunday(*WEEK))
    rows = _weeks(spark, d).select(*WEEK, F.posexplode(cal.target_weeks(start)).alias("i", "day"))
    return rows.select(*WEEK, (F.col("i") + 1).alias("step"), cal.iso_year("day").alias("target_year"), cal.iso_week("day").alias("target_week"))


@query("cal_lead_window", with_("panel", f"SELECT epi_year, epi_week, l AS lead, {MONDAY} + 7 * l AS target_start, {MONDAY} + 7 * l + 27 AS target_end FROM ({_WEEKS}), (SELECT CAST(range AS INTEGER) AS l FROM range(1, 7))"))
def lead_window(spark, d):
    weeks = _weeks(spark, d).withColumn("start", cal.monday(*WEEK))
    out = None
    for lead in range(1, 7):
        a, b = cal.lead_window("start", lead)
        part = weeks.select(*WEEK, F.lit(lead).alias("lead"), a.alias("target_start"), b.alias("target_end"))
        out = part if out is None else out.union(part)
    return out


@query("cal_mmwr_offset", with_("panel", f"SELECT epi_year, epi_week, m + 5 AS mmwr_end, CAST((m + 6) - (m + 5) AS INTEGER) AS offset_days, year(m + 5) <> epi_year AS other_year FROM (SELECT *, {MONDAY} AS m FROM ({_WEEKS}))"))
def mmwr_offset(spark, d):
    end = cal.mmwr_end(cal.monday(*WEEK))
    return _weeks(spark, d).select(*WEEK, end.alias("mmwr_end"), F.datediff(cal.sunday(*WEEK), end).alias("offset_days"), (F.year(end) != F.col("epi_year")).alias("other_year"))


@query("ext_week_key", with_("panel", "SELECT DISTINCT epi_year || '-W' || lpad(CAST(epi_week AS VARCHAR), 2, '0') AS week_key, epi_year AS year, epi_week AS week FROM panel"))
def week_key(spark, d):
    keys = _weeks(spark, d).select(cal.week_key(*WEEK).alias("week_key"))
    y, w = cal.parse_week_key("week_key")
    return keys.select("week_key", y.alias("year"), w.alias("week"))
