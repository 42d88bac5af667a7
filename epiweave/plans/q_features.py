"""Feature and label queries on the region panel; train up to 1998, test 1999, later years in reserve."""

from __future__ import annotations

from pyspark.sql import functions as F

from epiweave.operators import features as fea

from .bindings import WEEK, panel, with_
from .registry import query

K = ["k"]
LAST_TRAIN, TEST = 1998, 1999
_LABELLED = {
    "th": f"SELECT k, quantile_cont(f4, 0.5) AS threshold FROM features WHERE epi_year <= {LAST_TRAIN} GROUP BY k",
    "labelled": f"SELECT f.*, threshold, CAST(f4 > threshold AS INTEGER) AS y, CASE WHEN epi_year <= {LAST_TRAIN} THEN 'train' WHEN epi_year = {TEST} THEN 'test' ELSE 'reserve' END AS part FROM features f JOIN th ON th.k = f.k",
    "usable": "SELECT * FROM labelled WHERE t > 8 AND f4 IS NOT NULL",
}


def features(spark, d):
    return fea.future_sum(fea.vector(panel(spark, d), K), K)


def labelled(spark, d):
    f = features(spark, d)
    return fea.split(fea.label(f, fea.threshold(f, K, LAST_TRAIN), K), LAST_TRAIN, TEST)


def usable(spark, d):
    return fea.history_filter(labelled(spark, d))


@query("fea_lag", with_("features", "SELECT k, epi_year, epi_week, lag1, lag2, lag4, lag8 FROM features"))
def lag(spark, d):
    return fea.lags(panel(spark, d), K).drop("confirmed")


@query("fea_roll", with_("features", "SELECT k, epi_year, epi_week, round(roll4, 6) AS roll4, round(roll8, 6) AS roll8 FROM features"))
def roll(spark, d):
    return fea.rolling(panel(spark, d), K).select("k", *WEEK, F.round("roll4", 6).alias("roll4"), F.round("roll8", 6).alias("roll8"))


@query("fea_trend", with_("features", "SELECT k, epi_year, epi_week, round(roll4 - roll8, 6) AS trend FROM features"))
def trend(spark, d):
    return fea.vector(panel(spark, d), K).select("k", *WEEK, F.round("trend", 6).alias("trend"))


@query("fea_vector", with_("features", "SELECT k, epi_year, lag1, lag2, lag4, lag8, round(roll4, 6) AS roll4, round(roll8, 6) AS roll8, round(roll4 - roll8, 6) AS trend, CAST(epi_week <= 17 OR epi_week >= 45 AS INTEGER) AS dry, epi_week FROM features"))
def vector(spark, d):
    rows = fea.vector(panel(spark, d), K)
    return rows.select("k", "epi_year", *(F.round(c, 6).alias(c) if c in ("roll4", "roll8", "trend") else F.col(c) for c in fea.NINE))


@query("fea_future4", with_("features", "SELECT k, epi_year, epi_week, f4 FROM features"))
def future4(spark, d):
    return fea.future_sum(panel(spark, d), K).select("k", *WEEK, "f4")


@query("fea_lead_target", with_("panel", " UNION ALL ".join(f"SELECT k, epi_year, epi_week, {n} AS lead, CAST(CASE WHEN count(*) OVER w = 4 THEN sum(confirmed) OVER w END AS BIGINT) AS target FROM panel WINDOW w AS (PARTITION BY k ORDER BY epi_year, epi_week ROWS BETWEEN {n} FOLLOWING AND {n + 3} FOLLOWING)" for n in range(1, 7))))
def lead_target(spark, d):
    wide = panel(spark, d)
    for n in range(1, 7):
        wide = fea.future_sum(wide, K, lead=n, name=f"t{n}")
    return wide.select("k", *WEEK, F.expr("stack(6, " + ", ".join(f"{n}, t{n}" for n in range(1, 7)) + ") AS (lead, target)"))


@query("fea_threshold", with_("features", f"SELECT k, quantile_cont(f4, 0.5) AS threshold FROM features WHERE epi_year <= {LAST_TRAIN} GROUP BY k"))
def threshold(spark, d):
    return fea.threshold(features(spark, d), K, LAST_TRAIN)


@query("fea_label", with_("features", "SELECT k, epi_year, epi_week, f4, threshold, y FROM labelled", **_LABELLED))
def label(spark, d):
    return labelled(spark, d).select("k", *WEEK, "f4", "threshold", "y")


@query("fea_history_filter", with_("features", "SELECT k, epi_year, epi_week, t, y FROM usable", **_LABELLED))
def history(spark, d):
    return usable(spark, d).select("k", *WEEK, F.col("t").cast("long").alias("t"), "y")


@query("fea_split", with_("features", "SELECT k, epi_year, epi_week, part FROM usable", **_LABELLED))
def split(spark, d):
    return usable(spark, d).select("k", *WEEK, "part")


@query("fea_class_weight", with_("features", "SELECT k, count(*) FILTER (WHERE y = 0) AS negatives, count(*) FILTER (WHERE y = 1) AS positives, round(CAST(count(*) FILTER (WHERE y = 0) AS DOUBLE) / greatest(count(*) FILTER (WHERE y = 1), 1), 6) AS weight FROM usable WHERE part = 'train' GROUP BY k", **_LABELLED))
def class_weight(spark, d):
    return fea.class_weight(usable(spark, d).where("part = 'train'"), K).withColumn("weight", F.round("weight", 6))


@query("fea_base_rate", with_("features", "SELECT k, count(*) AS usable, round(avg(y), 6) AS positive_rate, count(*) FILTER (WHERE part = 'train') AS n_train, count(*) FILTER (WHERE part = 'test') AS n_test, count(*) FILTER (WHERE part = 'reserve') AS n_reserve FROM usable GROUP BY k", **_LABELLED))
def base_rate(spark, d):
    return fea.base_rate(usable(spark, d), K).withColumn("positive_rate", F.round("positive_rate", 6))


@query("mod_persist_recent4", with_("features", "SELECT k, epi_year, epi_week, round(roll4, 6) AS score FROM features"))
def persist_recent4(spark, d):
    return features(spark, d).select("k", *WEEK, F.round("roll4", 6).alias("score"))


@query("mod_persist_lag1", with_("features", "SELECT k, epi_year, epi_week, lag1 AS score FROM features"))
def persist_lag1(spark, d):
    return features(spark, d).select("k", *WEEK, F.col("lag1").alias("score"))
