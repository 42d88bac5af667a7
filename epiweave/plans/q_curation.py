"""Curation queries over the cumulative reports and weekly panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from epiweave.functions import calendar as cal
from epiweave.operators import curation as cur

from .bindings import MEASURES, MONDAY, WEEK, bucket, panel, read, reports, revisions, sql_bucket, weekly, with_
from .registry import query

K = ["k"]
_B = sql_bucket("CAST(k AS VARCHAR)", "CAST(epi_year AS VARCHAR)", "CAST(epi_week AS VARCHAR)")


def _bucket():
    return bucket(*(F.col(c).cast("string") for c in ("k", *WEEK)))


def _latest(spark, d):
    return cur.last_wins(reports(spark, d), K, "archive_pos")


@query("cur_last_wins", with_("latest", "SELECT * FROM latest"))
def last_wins(spark, d):
    return _latest(spark, d)


@query("cur_year_scope", with_("latest", "SELECT k, epi_year, epi_week, cum_confirmed FROM latest WHERE epi_year BETWEEN 1999 AND 2000"))
def year_scope(spark, d):
    return cur.year_scope(_latest(spark, d), 1999, 2000).select("k", *WEEK, "cum_confirmed")


_CHANGES = ", ".join(f"c.cum_{m} - CASE WHEN c.epi_week = 1 THEN 0 ELSE p.cum_{m} END AS {m}" for m in MEASURES)
_DIFF = f"SELECT c.k, c.epi_year, c.epi_week, {_CHANGES} FROM latest c LEFT JOIN latest p ON p.k = c.k AND p.epi_year = c.epi_year AND p.epi_week = c.epi_week - 1"


@query("cur_cumdiff", with_("latest", "SELECT * FROM diff WHERE least(suspected, confirmed, probable, deaths) >= 0 AND confirmed IS NOT NULL", diff=_DIFF))
def cumdiff(spark, d):
    return cur.cumulative_difference(_latest(spark, d), K, MEASURES)


@query("cur_gap_report", with_("latest", "SELECT k, epi_year, epi_week, CASE WHEN confirmed IS NULL THEN 'missing predecessor' ELSE 'negative difference' END AS reason FROM diff WHERE confirmed IS NULL OR least(suspected, confirmed, probable, deaths) < 0", diff=_DIFF))
def gap_report(spark, d):
    return cur.gap_report(_latest(spark, d), K, MEASURES)


def _split(spark, d):
    rows = panel(spark, d)
    return rows.where(_bucket() % 3 == 0), rows.where(_bucket() % 2 == 0)


@query("cur_append_new", with_("panel", f"SELECT * FROM panel WHERE {_B} % 2 = 0 AND {_B} % 3 <> 0"))
def append_new(spark, d):
    existing, new = _split(spark, d)
    return cur.append_new(existing, new, K)


@query("cur_crosscheck", with_("latest weekly", """SELECT l.k, l.epi_year, latest_week, reported, CAST(coalesce(sum(w.confirmed) FILTER (WHERE w.epi_week <= latest_week), 0) AS BIGINT) AS reconstructed,
    CASE WHEN coalesce(sum(w.confirmed) FILTER (WHERE w.epi_week <= latest_week), 0) = reported THEN 'OK' ELSE 'MISMATCH' END AS status
    FROM l LEFT JOIN kept w ON w.k = l.k AND w.epi_year = l.epi_year GROUP BY 1, 2, 3, 4""", l="SELECT k, epi_year, max(epi_week) AS latest_week, arg_max(cum_confirmed, epi_week) AS reported FROM latest GROUP BY 1, 2", kept=f"SELECT k, epi_year, epi_week, confirmed FROM weekly WHERE {_B} % 97 <> 0"))
def crosscheck(spark, d):
    rows = weekly(spark, d).where(_bucket() % 97 != 0)
    return cur.crosscheck(rows.where("epi_week < 20"), rows.where("epi_week >= 20"), _latest(spark, d), K)


@query("cur_reconcile", with_("latest weekly", "SELECT d.k, d.epi_year, d.epi_week, d.confirmed AS difference, narrative, d.confirmed - narrative AS discrepancy, CASE WHEN d.confirmed = narrative THEN 'agrees' ELSE 'differs' END AS status FROM diff d JOIN told n ON n.k = d.k AND n.epi_year = d.epi_year AND n.epi_week = d.epi_week WHERE d.confirmed >= 0", diff=_DIFF, told=f"SELECT k, epi_year, epi_week, confirmed + {_B} % 3 - 1 AS narrative FROM panel"))
def reconcile(spark, d):
    told = panel(spark, d).withColumn("narrative", F.col("confirmed") + _bucket() % 3 - 1)
    return cur.reconcile(_latest(spark, d), told, K)


@query("cur_annual_totals", with_("panel", "SELECT k, epi_year, CAST(sum(confirmed) AS BIGINT) AS total FROM panel GROUP BY 1, 2"))
def annual_totals(spark, d):
    return cur.annual_totals(panel(spark, d), K)


@query("cur_two_source", with_("panel", f"""SELECT coalesce(x.k, y.k) AS k, coalesce(x.epi_year, y.epi_year) AS epi_year, x.a, y.b, round(CASE WHEN y.b <> 0 THEN abs(x.a - y.b) / CAST(y.b AS DOUBLE) END, 6) AS rel_diff, CASE WHEN y.b <> 0 THEN abs(x.a - y.b) / CAST(y.b AS DOUBLE) END <= 0.01 AS within
    FROM (SELECT k, epi_year, CAST(sum(confirmed) AS BIGINT) AS a FROM panel WHERE {_B} % 61 <> 0 GROUP BY 1, 2) x FULL JOIN (SELECT k, epi_year, CAST(sum(confirmed) AS BIGINT) AS b FROM panel WHERE epi_year < 2001 GROUP BY 1, 2) y ON x.k = y.k AND x.epi_year = y.epi_year"""))
def two_source(spark, d):
    rows = panel(spark, d)
    return cur.two_source(rows.where(_bucket() % 61 != 0), rows.where("epi_year < 2001"), K).withColumn("rel_diff", F.round("rel_diff", 6))


@query("cur_coverage", with_("latest", "SELECT k, epi_year, count(*) AS weeks, arg_max(cum_confirmed, epi_week) AS latest_cumulative FROM latest GROUP BY 1, 2"))
def coverage(spark, d):
    return cur.coverage(_latest(spark, d), K)


@query("cur_seasonal_profile", with_("panel", "SELECT k, epi_week, round(avg(confirmed), 6) AS mean_count FROM panel WHERE epi_week <= 52 GROUP BY 1, 2"))
def seasonal_profile(spark, d):
    return cur.seasonal_profile(panel(spark, d), K).withColumn("mean_count", F.round("mean_count", 6))


def _patients(spark, d):
    o, c = read(spark, d, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("day")), read(spark, d, "customer").select("c_custkey", "c_nationkey")
    return o.join(c, o.o_custkey == c.c_custkey)


@query("cur_line_list_weekly", with_("panel_nation", "SELECT k, epi_year, epi_week, confirmed AS n FROM panel_nation"))
def line_list_weekly(spark, d):
    return cur.line_list_weekly(_patients(spark, d), "c_nationkey", "day")


@query("cur_state_rank", """WITH m AS (SELECT c_nationkey AS k, CAST(month(o_orderdate) AS INTEGER) AS month, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
    p AS (SELECT k, CAST(sum(n) AS BIGINT) AS n FROM m GROUP BY 1), b AS (SELECT k, month FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, month) AS r FROM m) WHERE r = 1)
    SELECT p.k, p.n, b.month AS peak_month, CAST(rank() OVER (ORDER BY p.n DESC) AS INTEGER) AS rank FROM p JOIN b ON p.k = b.k""")
def state_rank(spark, d):
    return cur.place_rank(_patients(spark, d), "c_nationkey", "day")


_DAILY = "SELECT event_type AS k, CAST(ts AS DATE) AS day, avg(value) AS temperature, max(value) AS humidity, sum(value) AS rain, min(value) AS dew_point, max(value) - min(value) AS wind FROM events GROUP BY 1, 2"
_WEATHER = f"SELECT k, CAST(isoyear(day) AS INTEGER) AS epi_year, CAST(week(day) AS INTEGER) AS epi_week, round(avg(temperature), 6) AS temperature, round(avg(humidity), 6) AS humidity, round(sum(rain), 4) AS rain, round(avg(dew_point), 6) AS dew_point, round(max(wind), 6) AS wind, count(DISTINCT day) AS obs_days FROM ({_DAILY}) GROUP BY 1, 2, 3"


def _weather(spark, d):
    """Five measures a day and event type, by week."""
    days = read(spark, d, "events").groupBy(F.col("event_type"), F.to_date("ts").alias("day")).agg(
        F.avg("value").alias("temperature"), F.max("value").alias("humidity"), F.sum("value").alias("rain"), F.min("value").alias("dew_point"), (F.max("value") - F.min("value")).alias("wind")
    )
    rows = cur.weather_weekly(days, "event_type", "day")
    return rows.withColumns({c: F.round(c, 4 if c == "rain" else 6) for c in ("temperature", "humidity", "rain", "dew_point", "wind")})


@query("cur_weather_weekly", _WEATHER)
def weather_weekly(spark, d):
    return _weather(spark, d)


@query("cur_outer_merge", f"""WITH w AS ({_WEATHER}), c AS (SELECT event_type AS k, CAST(isoyear(ts + INTERVAL 7 DAY) AS INTEGER) AS epi_year, CAST(week(ts + INTERVAL 7 DAY) AS INTEGER) AS epi_week, count(*) AS cases FROM events GROUP BY 1, 2, 3)
    SELECT coalesce(c.k, w.k) AS k, coalesce(c.epi_year, w.epi_year) AS epi_year, coalesce(c.epi_week, w.epi_week) AS epi_week, cases, temperature, c.k IS NOT NULL AS has_cases, w.k IS NOT NULL AS has_weather
    FROM c FULL JOIN w ON c.k = w.k AND c.epi_year = w.epi_year AND c.epi_week = w.epi_week""")
def outer_merge(spark, d):
    """All events as cases, reported a week after the weather they met: the first and last weeks have one side only."""
    told = read(spark, d, "events").select(F.col("event_type").alias("k"), F.date_add(F.to_date("ts"), 7).alias("day"))
    cases = told.groupBy("k", cal.iso_year("day").alias("epi_year"), cal.iso_week("day").alias("epi_week")).agg(F.count("*").alias("cases"))
    return cur.outer_merge(cases, _weather(spark, d).select("k", *WEEK, "temperature"), K)


@query("cur_missing_weeks", with_("panel_nation", f"""SELECT s.k, CAST(isoyear(s.day) AS INTEGER) AS epi_year, CAST(week(s.day) AS INTEGER) AS epi_week FROM spine s WHERE NOT EXISTS (SELECT 1 FROM days d WHERE d.k = s.k AND d.day = s.day)""",
    days=f"SELECT k, {MONDAY} AS day FROM panel_nation", spine="SELECT k, CAST(unnest(generate_series(CAST(min(day) AS TIMESTAMP), CAST(max(day) AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS day FROM days GROUP BY k"))
def missing_weeks(spark, d):
    return cur.missing_weeks(panel(spark, d, "n_nationkey"), K)


_ORDER = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
_BY = ", ".join(_ORDER)


@query("cur_first_published", with_("revisions", f"SELECT l_orderkey, value AS first_value, CAST(l_shipdate AS DATE) AS first_published FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_BY}) AS r FROM revisions) WHERE r = 1"))
def first_published(spark, d):
    return cur.first_published(revisions(spark, d), ["l_orderkey"], "value", _ORDER).withColumn("first_published", F.to_date("first_published"))


@query("cur_revised", with_("revisions", f"SELECT l_orderkey, arg_min(value, r) AS first_value, arg_max(value, r) AS last_value, arg_max(value, r) - arg_min(value, r) AS delta FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_BY}) AS r FROM revisions) GROUP BY 1"))
def revised(spark, d):
    return cur.revised(revisions(spark, d), ["l_orderkey"], "value", _ORDER)


@query("cur_as_of", with_("revisions", f"""SELECT o_orderkey, o_orderstatus, (SELECT value FROM revisions v WHERE v.l_orderkey = o_orderkey AND v.l_shipdate < o_orderdate ORDER BY {', '.join(c + ' DESC' for c in _ORDER)} LIMIT 1) AS known_value FROM orders"""))
def as_of(spark, d):
    orders = read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate", F.col("o_orderkey").alias("l_orderkey"))
    out = cur.as_of(orders, revisions(spark, d), ["l_orderkey"], "o_orderdate", "value", _ORDER)
    return out.select("o_orderkey", "o_orderstatus", "known_value")
