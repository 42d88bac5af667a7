"""Board and forecast-shaping queries: documents as the board, labels as updates; weekly probabilities by nation."""

from __future__ import annotations

from pyspark.sql import functions as F

from epiweave.functions import calendar as cal
from epiweave.operators import board as bd
from epiweave.operators import forecast as fc

from .bindings import MONDAY, WEEK, panel, read, with_
from .registry import query


def board(spark, d):
    docs = read(spark, d, "documents")
    meta = F.create_map(F.lit("lang"), F.col("lang"), F.lit("tier"), (F.col("n_chars") % 3).cast("string"))
    return docs.select(F.col("doc_id").alias("object_id"), F.col("source").alias("object_type"), F.lit("open").alias("state"), (F.col("n_chars") / 1000.0).alias("score"), meta.alias("metadata"))


def updates(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "source")
    rows = read(spark, d, "labels").select("doc_id", "quality", "toxic").unionByName(read(spark, d, "benchmark").select((-1 - F.col("item_id")).alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic")))
    rows = rows.join(docs, "doc_id", "left")
    return rows.select(F.col("doc_id").alias("object_id"), F.coalesce("source", F.lit("new")).alias("object_type"), F.when(F.col("quality") == 1, "kept").otherwise("dropped").alias("state"), (2.0 * F.col("quality") + F.col("toxic")).alias("score"), F.create_map(F.lit("tier"), F.lit("9"), F.lit("toxic"), F.col("toxic").cast("string")).alias("metadata"))


_BOARD = {
    "b": "SELECT doc_id AS object_id, source AS object_type, 'open' AS state, n_chars / CAST(1000 AS DOUBLE) AS score, lang, CAST(n_chars % 3 AS VARCHAR) AS tier FROM documents",
    "u": "SELECT l.doc_id AS object_id, coalesce(source, 'new') AS object_type, CASE WHEN quality = 1 THEN 'kept' ELSE 'dropped' END AS state, CAST(2 * quality + toxic AS DOUBLE) AS score, CAST(toxic AS VARCHAR) AS toxic FROM (SELECT doc_id, quality, toxic FROM labels UNION ALL SELECT -1 - item_id, 1, 0 FROM benchmark) l LEFT JOIN documents d ON d.doc_id = l.doc_id",
    "m": "SELECT coalesce(b.object_id, u.object_id) AS object_id, coalesce(b.object_type, u.object_type) AS object_type, coalesce(u.state, b.state) AS state, greatest(b.score, u.score) AS score, lang, CASE WHEN u.object_id IS NULL THEN tier ELSE '9' END AS tier, toxic FROM b FULL JOIN u ON b.object_id = u.object_id AND b.object_type = u.object_type",
}


@query("board_upsert", with_("", "SELECT * FROM m", **_BOARD))
def upsert(spark, d):
    out = bd.upsert(board(spark, d), updates(spark, d), ["object_id", "object_type"])
    return out.select("object_id", "object_type", "state", "score", *(F.col("metadata")[f].alias(f) for f in ("lang", "tier", "toxic")))


@query("board_decay", with_("", "SELECT object_id, round(score * 0.97, 6) AS decay_score FROM b", **_BOARD))
def decay(spark, d):
    return bd.decay(board(spark, d)).select("object_id", F.round("decay_score", 6).alias("decay_score"))


@query("board_counts", with_("", "SELECT object_type, state, count(*) AS n FROM m GROUP BY 1, 2", **_BOARD))
def counts(spark, d):
    return bd.counts(bd.upsert(board(spark, d), updates(spark, d), ["object_id", "object_type"]), ["object_type", "state"])


@query("board_by_type", with_("", "SELECT object_id, score, tier AS meta_tier FROM b WHERE object_type = 'src1'", **_BOARD))
def by_type(spark, d):
    return bd.by_type(board(spark, d), "object_type", "src1", ["tier"]).select("object_id", "score", "meta_tier")


# --- forecasts: probability of a nation-week is count / (count + 3)

_P = {"p": f"SELECT k, epi_year, epi_week, CAST(confirmed AS DOUBLE) / (confirmed + 3) AS p, {MONDAY} AS monday FROM panel_nation"}
_BANDS = "CASE WHEN p >= 0.75 THEN 'VERY HIGH' WHEN p >= 0.5 THEN 'HIGH' WHEN p >= 0.25 THEN 'MODERATE' ELSE 'LOW' END"


def probs(spark, d):
    return panel(spark, d, "n_nationkey").select("k", *WEEK, (F.col("confirmed") / (F.col("confirmed") + 3)).alias("p"))


@query("fc_risk_band", with_("panel_nation", f"SELECT k, epi_year, epi_week, {_BANDS} AS risk FROM p", **_P))
def risk_band(spark, d):
    return probs(spark, d).select("k", *WEEK, fc.risk_band("p").alias("risk"))


@query("fc_alert", with_("panel_nation", "SELECT k, epi_year, epi_week FROM p WHERE p >= 0.5", **_P))
def alert(spark, d):
    return probs(spark, d).where(fc.alert("p")).select("k", *WEEK)


@query("fc_future_flag", with_("panel_nation", "SELECT k, epi_year, epi_week, monday + 34 > DATE '1999-06-01' AS window_is_future FROM p", **_P))
def future_flag(spark, d):
    return probs(spark, d).select("k", *WEEK, fc.window_is_future(cal.sunday(*WEEK), F.lit("1999-06-01").cast("date")).alias("window_is_future"))


@query("fc_wow_change", with_("panel_nation", "SELECT k, epi_year, epi_week, round(c, 6) AS change, CASE WHEN c >= 0.01 THEN 'up' WHEN c <= -0.01 THEN 'down' ELSE 'flat' END AS direction FROM (SELECT *, p - lag(p) OVER (PARTITION BY k ORDER BY epi_year, epi_week) AS c FROM p)", **_P))
def wow_change(spark, d):
    return fc.week_change(probs(spark, d), ["k"]).select("k", *WEEK, F.round("change", 6).alias("change"), "direction")


@query("fc_risk_counts", with_("panel_nation", f"SELECT epi_year, epi_week, count(*) AS n_states, count(*) FILTER (WHERE r IN ('HIGH', 'VERY HIGH')) AS n_high, count(*) FILTER (WHERE r = 'MODERATE') AS n_medium, count(*) FILTER (WHERE r = 'LOW') AS n_low, coalesce(string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) FILTER (WHERE r IN ('HIGH', 'VERY HIGH')), '') AS high FROM (SELECT *, {_BANDS} AS r FROM p) GROUP BY 1, 2", **_P))
def risk_counts(spark, d):
    return fc.risk_counts(probs(spark, d), WEEK)


@query("fc_top_k", with_("panel_nation", "SELECT epi_year, epi_week, k, r AS \"rank\" FROM (SELECT *, CAST(row_number() OVER (PARTITION BY epi_year, epi_week ORDER BY p DESC, k) AS INTEGER) AS r FROM p) WHERE r <= 5", **_P))
def top_k(spark, d):
    return fc.top_k(probs(spark, d), WEEK, 5).select(*WEEK, "k", "rank")


@query("fc_record", with_("features", f"SELECT k, epi_year, epi_week, window_start, round_even(p, 4) AS probability, risk, round_even(roll4, 3) AS roll4, lag1 FROM (SELECT *, {MONDAY} + 7 AS window_start, CASE WHEN p >= 0.75 THEN 'VERY HIGH' WHEN p >= 0.5 THEN 'HIGH' WHEN p >= 0.25 THEN 'MODERATE' ELSE 'LOW' END AS risk FROM (SELECT *, roll4 / (roll4 + 8) AS p FROM features))"))
def record(spark, d):
    from epiweave.operators import features as fea

    rows = fea.vector(panel(spark, d), ["k"]).withColumn("p", F.col("roll4") / (F.col("roll4") + 8))
    rec = fc.record(rows, "p", fea.NINE)
    return rec.select("k", *WEEK, "record.forecast_window.start", "record.probability", "record.risk", F.col("record.feature_values")["roll4"].alias("roll4"), F.col("record.feature_values")["lag1"].cast("long").alias("lag1")).withColumnRenamed("start", "window_start")


