"""Evaluation queries on the scores of a model and its four comparators on the region panel."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from epiweave.functions import calendar as cal
from epiweave.operators import evaluation as ev
from epiweave.operators import ledgers as led

from .bindings import WEEK, bucket, scored, sql_bucket, with_, zero_filled
from .q_ledgers import _CHAINED
from .registry import query

K = ["k"]
KM = ["k", "model"]
REPS, BLOCK, SEED = 4000, 4, "readout"
LEAST_VALID = max(500, REPS // 4)


def r6(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def auroc_sql(keys: str, source: str, score: str = "score", times: str = "1") -> str:
    """Mann-Whitney by counts below and equal, over distinct scores."""
    return f"""SELECT {keys}, sum(p * (below + q / 2.0)) / nullif(sum(p) * sum(q), 0) AS auroc, CAST(sum(p + q) AS BIGINT) AS n, CAST(sum(p) AS BIGINT) AS positives FROM (
        SELECT *, coalesce(sum(q) OVER (PARTITION BY {keys} ORDER BY {score} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (
        SELECT {keys}, {score}, CAST(sum(CASE WHEN y = 1 THEN {times} ELSE 0 END) AS DOUBLE) AS p, CAST(sum(CASE WHEN y = 0 THEN {times} ELSE 0 END) AS DOUBLE) AS q FROM {source} GROUP BY {keys}, {score})) GROUP BY {keys}"""


_ROC = """SELECT k, model, score, sum(p) OVER w / nullif(sum(p) OVER e, 0) AS tpr, sum(q) OVER w / nullif(sum(q) OVER e, 0) AS fpr FROM (SELECT k, model, score, CAST(sum(y) AS DOUBLE) AS p, CAST(sum(1 - y) AS DOUBLE) AS q FROM scored GROUP BY 1, 2, 3)
    WINDOW w AS (PARTITION BY k, model ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), e AS (PARTITION BY k, model)"""
_LOSS = "-avg(CASE WHEN y = 1 THEN ln(least(greatest(prob, 1e-15), 1 - 1e-15)) ELSE ln(1 - least(greatest(prob, 1e-15), 1 - 1e-15)) END)"
_BIN = "CASE WHEN prob < 0.2 THEN 1 WHEN prob < 0.4 THEN 2 WHEN prob < 0.6000000000000001 THEN 3 WHEN prob < 0.8 THEN 4 ELSE 5 END"
_CURVE = f"""SELECT s.k, s.model, s.bin, coalesce(n, 0) AS n, mean_p, observed FROM (SELECT k, model, bin FROM (SELECT DISTINCT k, model FROM scored), (SELECT CAST(range AS INTEGER) AS bin FROM range(1, 6))) s
    LEFT JOIN (SELECT k, model, {_BIN} AS bin, count(*) AS n, avg(prob) AS mean_p, avg(y) AS observed FROM scored GROUP BY 1, 2, 3) f ON f.k = s.k AND f.model = s.model AND f.bin = s.bin"""
_METRICS = {
    "area": auroc_sql("k, model", "scored"),
    "metrics": f"SELECT a.k, a.model, auroc, n, brier, log_loss, ord FROM area a JOIN (SELECT k, model, avg((prob - y) * (prob - y)) AS brier, {_LOSS} AS log_loss, min(ord) AS ord FROM scored GROUP BY 1, 2) b ON a.k = b.k AND a.model = b.model",
    "best": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY auroc DESC, ord) AS r FROM metrics WHERE model <> 'model') WHERE r = 1",
}
_GAIN = {"gain": "SELECT m.k, m.auroc AS model_auroc, m.brier AS model_brier, m.n, b.model AS best, b.auroc AS best_auroc, b.brier AS best_brier, m.auroc - b.auroc AS auroc_gain, m.brier - b.brier AS brier_delta FROM metrics m JOIN best b ON b.k = m.k WHERE m.model = 'model'"}


@query("evl_auroc", with_("scored", "SELECT k, round(auroc, 6) AS auroc, n, positives FROM area", area=auroc_sql("k", "(SELECT * FROM scored WHERE model = 'recent4')")))
def auroc(spark, d):
    return r6(ev.wide_auroc(scored(spark, d).where("model = 'recent4'"), K), "auroc")


@query("evl_roc_curve", with_("scored", "SELECT k, model, round(score, 6) AS score, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round((fpr - coalesce(lag(fpr) OVER w, 0)) * (tpr + coalesce(lag(tpr) OVER w, 0)) / 2, 6) AS area FROM roc WINDOW w AS (PARTITION BY k, model ORDER BY score DESC)", roc=_ROC))
def roc_curve(spark, d):
    return r6(ev.roc_curve(scored(spark, d), KM), "score", "tpr", "fpr", "area")


@query("evl_confusion", with_("scored", "SELECT *, round(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 6) AS precision, round(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 6) AS recall, round(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 6) AS f1 FROM c", c="SELECT k, model, count(*) FILTER (WHERE prob >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE prob >= 0.5 AND y = 0) AS fp, count(*) FILTER (WHERE prob < 0.5 AND y = 1) AS fn, count(*) FILTER (WHERE prob < 0.5 AND y = 0) AS tn FROM scored GROUP BY 1, 2"))
def confusion(spark, d):
    return r6(ev.confusion(scored(spark, d), KM), "precision", "recall", "f1")


@query("evl_brier", with_("scored", "SELECT k, model, round(avg((prob - y) * (prob - y)), 6) AS brier FROM scored GROUP BY 1, 2"))
def brier(spark, d):
    return r6(scored(spark, d).groupBy(*KM).agg(ev.brier().alias("brier")), "brier")


@query("evl_logloss", with_("scored", f"SELECT k, model, round({_LOSS}, 6) AS log_loss FROM scored GROUP BY 1, 2"))
def logloss(spark, d):
    return r6(scored(spark, d).groupBy(*KM).agg(ev.log_loss().alias("log_loss")), "log_loss")


@query("evl_reliability", with_("scored", "SELECT k, model, bin, n, round(mean_p, 6) AS mean_p, round(observed, 6) AS observed FROM curve", curve=_CURVE))
def reliability(spark, d):
    return r6(ev.reliability(scored(spark, d), KM), "mean_p", "observed")


@query("evl_ece", with_("scored", "SELECT k, model, round(sum(n * abs(observed - mean_p)) / sum(n), 6) AS ece FROM curve GROUP BY 1, 2", curve=_CURVE))
def ece(spark, d):
    return r6(ev.ece(ev.reliability(scored(spark, d), KM), KM), "ece")


@query("evl_comparators", with_("scored", "SELECT k, model, n, ord, round(auroc, 6) AS auroc, round(brier, 6) AS brier, round(log_loss, 6) AS log_loss FROM metrics", **_METRICS))
def comparators(spark, d):
    return r6(ev.comparators(scored(spark, d), K), "auroc", "brier", "log_loss")


@query("evl_strongest", with_("scored", "SELECT k, model, round(auroc, 6) AS auroc FROM best", **_METRICS))
def strongest(spark, d):
    return r6(ev.strongest(ev.comparators(scored(spark, d), K), K).select("k", "model", "auroc"), "auroc")


@query("evl_gain", with_("scored", "SELECT k, best, n, round(model_auroc, 6) AS model_auroc, round(best_auroc, 6) AS best_auroc, round(model_brier, 6) AS model_brier, round(best_brier, 6) AS best_brier, round(auroc_gain, 6) AS auroc_gain, round(brier_delta, 6) AS brier_delta FROM gain", **_METRICS, **_GAIN))
def gain(spark, d):
    return r6(ev.gain(ev.comparators(scored(spark, d), K), K), "model_auroc", "best_auroc", "model_brier", "best_brier", "auroc_gain", "brier_delta")


# --- bootstrap: the model against the comparators, by position in the test years

_BASE = "scored WHERE epi_year >= 1999"


def test_rows(spark, d):
    """(k, base, i, y, score, prob, base_score, base_prob): the model beside each comparator, numbered by week."""
    rows = scored(spark, d).where("epi_year >= 1999")
    own = rows.where("model = 'model'").select("k", "t", "y", "score", "prob")
    base = rows.where("model <> 'model'").select("k", "t", F.col("model").alias("base"), F.col("score").alias("base_score"), F.col("prob").alias("base_prob"))
    first = own.groupBy("k").agg(F.min("t").alias("t0"))
    return own.join(base, ["k", "t"]).join(first, "k").withColumn("i", F.col("t") - F.col("t0") + 1).drop("t", "t0")


def _boot(block: int, size: str = "n") -> dict[str, str]:
    u = f"CAST(CAST('0x' || substr(md5(concat_ws('|', '{SEED}', CAST(k AS VARCHAR), CAST(rep AS VARCHAR), CAST(b AS VARCHAR))), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0"
    return {
        "pairs": f"SELECT a.k, b.model AS base, a.t - min(a.t) OVER (PARTITION BY a.k) + 1 AS i, a.y, a.score, a.prob, b.score AS base_score, b.prob AS base_prob FROM (SELECT * FROM {_BASE} AND model = 'model') a JOIN (SELECT * FROM {_BASE} AND model <> 'model') b ON a.k = b.k AND a.t = b.t",
        "lengths": "SELECT k, max(i) AS n FROM pairs GROUP BY 1",
        "blocks": f"SELECT k, n, rep, b, CAST(floor({u} * (n - {block} + 1)) AS BIGINT) AS s FROM (SELECT k, n, CAST(unnest(range(CAST(ceil(n / {block}.0) AS BIGINT))) AS BIGINT) AS b FROM lengths WHERE n >= {2 * block}), (SELECT range AS rep FROM range({REPS}))",
        "drawn": f"SELECT k, rep, s + o + 1 AS i, count(*) AS times FROM blocks, (SELECT range AS o FROM range({block})) WHERE b * {block} + o < n GROUP BY 1, 2, 3",
        "d": "SELECT p.*, rep, times FROM drawn JOIN pairs p ON p.k = drawn.k AND p.i = drawn.i",
        "aa": auroc_sql("k, base, rep", "d", "score", "times"),
        "ab": auroc_sql("k, base, rep", "d", "base_score", "times"),
        "bb": "SELECT k, base, rep, sum(times * ((prob - y) * (prob - y) - (base_prob - y) * (base_prob - y))) / sum(times) AS d_brier FROM d GROUP BY 1, 2, 3",
        "boot": "SELECT aa.k, aa.base, aa.rep, aa.auroc - ab.auroc AS d_auroc, d_brier FROM aa JOIN ab ON aa.k = ab.k AND aa.base = ab.base AND aa.rep = ab.rep JOIN bb ON aa.k = bb.k AND aa.base = bb.base AND aa.rep = bb.rep WHERE aa.auroc IS NOT NULL",
    }


def replicates(spark, d, block: int = BLOCK, reps: int = REPS):
    """The same drawn weeks for every comparator."""
    return ev.block_bootstrap(test_rows(spark, d), ["k", "base"], reps, block, SEED, drawn_by=K)


@query("evl_block_bootstrap", with_("scored", "SELECT k, rep, round(d_auroc, 6) AS d_auroc, round(d_brier, 6) AS d_brier FROM boot WHERE base = 'lag1'", **_boot(BLOCK)))
def block_bootstrap(spark, d):
    pairs = test_rows(spark, d).where("base = 'lag1'").drop("base")
    return r6(ev.block_bootstrap(pairs, K, REPS, BLOCK, SEED), "d_auroc", "d_brier")


def _ci_sql(extra: str = "") -> str:
    q = lambda c, a: f"round(CASE WHEN count(*) >= {LEAST_VALID} THEN quantile_cont({c}, {a}) END, 6)"
    return f"SELECT k, {extra}count(*) AS valid, {q('d_auroc', 0.025)} AS auroc_lo, {q('d_auroc', 0.975)} AS auroc_hi, {q('d_brier', 0.025)} AS brier_lo, {q('d_brier', 0.975)} AS brier_hi FROM boot"


@query("evl_paired_ci", with_("scored", _ci_sql() + " WHERE base = 'lag1' GROUP BY k", **_boot(8)))
def paired_ci(spark, d):
    pairs = test_rows(spark, d).where("base = 'lag1'").drop("base")
    return r6(ev.paired_ci(ev.block_bootstrap(pairs, K, REPS, 8, SEED), K, LEAST_VALID), "auroc_lo", "auroc_hi", "brier_lo", "brier_hi")


@query("evl_multi_comparator_ci", with_("scored", _ci_sql("base, ") + " GROUP BY k, base", **_boot(BLOCK)))
def multi_comparator_ci(spark, d):
    return r6(ev.paired_ci(replicates(spark, d), ["k", "base"], LEAST_VALID), "auroc_lo", "auroc_hi", "brier_lo", "brier_hi")


_SIZES = (13, 52, 104, 150, 300)
_PLAN_REPS = 5000


def _plan_sql() -> dict[str, str]:
    u = f"CAST(CAST('0x' || substr(md5(concat_ws('|', '{SEED}', CAST(k AS VARCHAR), CAST(size AS VARCHAR), CAST(rep AS VARCHAR), CAST(b AS VARCHAR))), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0"
    first = _boot(BLOCK)
    return {
        "pairs": first["pairs"],
        "lengths": f"SELECT k, n, size FROM ({first['lengths']}), (SELECT unnest([{', '.join(map(str, _SIZES))}]) AS size) WHERE n >= {2 * BLOCK}",
        "blocks": f"SELECT k, n, size, rep, b, CAST(floor({u} * (n - {BLOCK} + 1)) AS BIGINT) AS s FROM (SELECT k, n, size, CAST(unnest(range(CAST(ceil(size / {BLOCK}.0) AS BIGINT))) AS BIGINT) AS b FROM lengths), (SELECT range AS rep FROM range({_PLAN_REPS}))",
        "drawn": f"SELECT k, size, rep, s + o + 1 AS i, count(*) AS times FROM blocks, (SELECT range AS o FROM range({BLOCK})) WHERE b * {BLOCK} + o < size GROUP BY 1, 2, 3, 4",
        "bb": "SELECT d.k, d.size, d.rep, sum(times * ((prob - y) * (prob - y) - (base_prob - y) * (base_prob - y))) / sum(times) AS d_brier FROM drawn d JOIN pairs p ON p.k = d.k AND p.i = d.i WHERE base = 'lag1' GROUP BY 1, 2, 3",
        "ci": "SELECT k, size, quantile_cont(d_brier, 0.025) AS lo, quantile_cont(d_brier, 0.975) AS hi FROM bb GROUP BY 1, 2",
    }


@query("evl_cohort_planning", with_("scored", "SELECT k, CAST(size AS INTEGER) AS size, round(size / 13.2, 6) AS seasons, round(lo, 6) AS lo, round(hi, 6) AS hi, CASE WHEN hi < 0 THEN 'below' WHEN lo > 0 THEN 'above' ELSE 'crosses' END AS sign FROM ci", **_plan_sql()))
def cohort_planning(spark, d):
    """Sign of the Brier interval if a cohort had `size` weeks: blocks resampled to that length."""
    pairs = test_rows(spark, d).where("base = 'lag1'")
    lengths = pairs.groupBy("k").agg(F.max("i").alias("n")).withColumn("size", F.explode(F.array(*map(F.lit, _SIZES))))
    per = ev.replicates(pairs.drop("base"), lengths, K, K, _PLAN_REPS, BLOCK, SEED, size="size")
    ci = per.groupBy("k", "size").agg(F.percentile("d_brier", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    out = ci.select("k", "size", F.round(F.col("size") / 13.2, 6).alias("seasons"), F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
    return r6(out.withColumn("sign", ev.sign("lo", "hi")), "lo", "hi")


_V = {**_METRICS, **_GAIN, "pos": "SELECT k, sum(y) AS positives FROM scored WHERE model = 'model' GROUP BY k", **_boot(BLOCK), "cis": "SELECT k, base, count(*) AS valid, quantile_cont(d_auroc, 0.025) AS a_lo, quantile_cont(d_brier, 0.025) AS b_lo, quantile_cont(d_brier, 0.975) AS b_hi FROM boot GROUP BY 1, 2"}


def _verdict_rows(spark, d):
    s = scored(spark, d)
    g = ev.gain(ev.comparators(s, K), K)
    pos = s.where("model = 'model'").groupBy("k").agg(F.sum("y").alias("positives"))
    ci = ev.paired_ci(replicates(spark, d), ["k", "base"], LEAST_VALID).withColumnRenamed("base", "best")
    e = ev.ece(ev.reliability(s.where("model = 'model'"), K), K)
    return g.join(pos, "k").join(ci, ["k", "best"], "left").join(e, "k")


@query("evl_verdict_v1", with_("scored", f"""SELECT g.k, g.best, CASE WHEN g.n < 10 OR positives = 0 OR positives = g.n THEN 'neutral_inconclusive_underpowered' WHEN model_auroc < best_auroc OR model_auroc < 0.70 THEN 'failure'
    WHEN auroc_gain >= 0.02 AND coalesce(valid >= {LEAST_VALID} AND a_lo > 0, false) AND brier_delta <= 0 THEN 'success' ELSE 'neutral' END AS verdict FROM gain g JOIN pos ON pos.k = g.k LEFT JOIN cis ON cis.k = g.k AND cis.base = g.best""", **_V))
def verdict_v1(spark, d):
    c = F.col
    return _verdict_rows(spark, d).select("k", "best", ev.verdict_v1(c("n"), c("positives"), c("model_auroc"), c("best_auroc"), c("brier_delta"), c("auroc_lo")).alias("verdict"))


_FB = sql_bucket("'forged'", "CAST(k AS VARCHAR)", "CAST(seq AS VARCHAR)")
_FORECASTS = {
    "ranked": "SELECT k AS chain, row_number() OVER (PARTITION BY k ORDER BY t) AS r, row_number() OVER (PARTITION BY k ORDER BY t) AS seq, k, concat_ws('|', CAST(t AS VARCHAR), CAST(y AS VARCHAR)) AS payload FROM scored WHERE model = 'model' AND epi_year >= 1999",
    "chained": _CHAINED,
    "intact": f"SELECT chain AS k, bool_and(own = hash) AS ok FROM (SELECT *, sha256(prev || '|' || CASE WHEN {_FB.replace('CAST(k', 'CAST(chain')} % 211 = 5 THEN payload || '!' ELSE payload END) AS own FROM chained) GROUP BY 1",
}


def forecast_integrity(spark, d):
    """(k, ok): whether the ledger of a series' forecasts verifies; a few records were changed after they were written."""
    rows = scored(spark, d).where("model = 'model' and epi_year >= 1999")
    seq = F.row_number().over(Window.partitionBy("k").orderBy("t")).cast("long")
    payload = F.concat_ws("|", F.col("t").cast("string"), F.col("y").cast("string"))
    kept = led.chain(rows.select(F.col("k").alias("chain"), seq.alias("seq"), payload.alias("payload")))
    b = bucket(F.lit("forged"), F.col("chain").cast("string"), F.col("seq").cast("string"))
    changed = kept.withColumn("payload", F.when(b % 211 == 5, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))
    return led.verify(changed).select(F.col("chain").alias("k"), F.col("reason").isNull().alias("ok"))


@query("evl_verdict_v2", with_("scored", f"""SELECT g.k, CASE WHEN NOT coalesce(ok, false) THEN 'DATA-INTEGRITY FAILURE' WHEN g.n < 150 OR b_lo IS NULL OR valid < {LEAST_VALID} THEN 'UNDERPOWERED' WHEN b_lo > 0 OR ece > 0.25 THEN 'FAILURE' WHEN brier_delta < 0 AND b_hi < 0 THEN 'SUCCESS' ELSE 'NEUTRAL' END AS verdict
    FROM gain g LEFT JOIN intact ON intact.k = g.k LEFT JOIN cis ON cis.k = g.k AND cis.base = g.best JOIN (SELECT k, sum(n * abs(observed - mean_p)) / sum(n) AS ece FROM curve WHERE model = 'model' GROUP BY k) e ON e.k = g.k""", **_V, curve=_CURVE, **_FORECASTS).replace("WITH ", "WITH RECURSIVE ", 1))
def verdict_v2(spark, d):
    """A series whose ledger of forecasts does not verify, or has none, gets no other verdict."""
    c = F.col
    rows = _verdict_rows(spark, d).join(forecast_integrity(spark, d), "k", "left")
    return rows.select("k", ev.verdict_v2(c("n"), F.coalesce(c("ok"), F.lit(False)), c("brier_lo"), c("brier_hi"), c("brier_delta"), c("ece")).alias("verdict"))


_SEASON = "CASE WHEN epi_week >= 45 THEN epi_year WHEN epi_week <= 17 THEN epi_year - 1 END"


@query("evl_per_season", with_("scored", f"""SELECT m.model, nullif(m.season, -1) AS season, m.season = -1 AS pooled, m.n, round(brier, 6) AS brier, round(log_loss, 6) AS log_loss, round(rate, 6) AS rate, round(auroc, 6) AS auroc, round(ece, 6) AS ece FROM
    (SELECT model, season, count(*) AS n, avg((prob - y) * (prob - y)) AS brier, {_LOSS} AS log_loss, avg(y) AS rate FROM s GROUP BY 1, 2) m JOIN a ON a.model = m.model AND a.season = m.season
    JOIN (SELECT model, season, sum(n * abs(observed - mean_p)) / sum(n) AS ece FROM (SELECT model, season, {_BIN} AS bin, count(*) AS n, avg(prob) AS mean_p, avg(y) AS observed FROM s GROUP BY 1, 2, 3) GROUP BY 1, 2) e ON e.model = m.model AND e.season = m.season""",
    s=f"SELECT * FROM (SELECT *, {_SEASON} AS season FROM scored) WHERE season IS NOT NULL UNION ALL SELECT *, -1 FROM scored WHERE {_SEASON} IS NOT NULL", a=auroc_sql("model, season", "s", "prob")))
def per_season(spark, d):
    rows = scored(spark, d).withColumn("season", cal.season_id(*WEEK)).where("season is not null")
    return r6(ev.summary(rows, ["model", "season"], pool="season"), "brier", "log_loss", "rate", "auroc", "ece")


_LEADS = ", ".join(f"sum(confirmed) OVER (PARTITION BY k ORDER BY epi_year, epi_week ROWS BETWEEN {n} FOLLOWING AND {n + 3} FOLLOWING) AS t{n}, count(*) OVER (PARTITION BY k ORDER BY epi_year, epi_week ROWS BETWEEN {n} FOLLOWING AND {n + 3} FOLLOWING) AS c{n}" for n in range(1, 7))


@query("mod_lead_sweep", with_("features", "SELECT a.k, a.lead, round(auroc, 6) AS auroc, round(brier, 6) AS brier, n FROM (" + auroc_sql("k, lead", "rows") + ") a JOIN (SELECT k, lead, avg((score / (score + 8.0) - y) * (score / (score + 8.0) - y)) AS brier FROM rows GROUP BY 1, 2) b ON b.k = a.k AND b.lead = a.lead", wide=f"SELECT *, {_LEADS} FROM features", rows=" UNION ALL ".join(f"SELECT k, {n} AS lead, roll4 AS score, CAST(t{n} > 34 AS INTEGER) AS y FROM wide WHERE t > 8 AND c{n} = 4" for n in range(1, 7))))
def lead_sweep(spark, d):
    from epiweave.operators import features as fea

    from .q_features import features

    wide = features(spark, d).where("true")
    for n in range(1, 7):
        wide = fea.future_sum(wide, K, lead=n, name=f"t{n}")
    long = wide.where("t > 8").select("k", F.col("roll4").alias("score"), F.expr("stack(6, " + ", ".join(f"{n}, t{n}" for n in range(1, 7)) + ") AS (lead, target)")).where("target is not null")
    long = long.withColumns({"y": (F.col("target") > 34).cast("int"), "prob": F.col("score") / (F.col("score") + 8.0)})
    area, error = ev.wide_auroc(long, ["k", "lead"]).select("k", "lead", "auroc", "n"), long.groupBy("k", "lead").agg(ev.brier().alias("brier"))
    return r6(area.join(error, ["k", "lead"]), "auroc", "brier")


_ALERT = f"""SELECT *, {_SEASON} AS season, coalesce(roll4 / (roll4 + 1), 0) >= 0.5 AS high FROM (SELECT k, epi_year, epi_week, confirmed, row_number() OVER w AS t,
    coalesce(avg(confirmed) OVER (PARTITION BY k ORDER BY epi_year, epi_week ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 0) AS roll4,
    CASE WHEN count(*) OVER f = 4 THEN sum(confirmed) OVER f END AS f4 FROM zero_filled WINDOW w AS (PARTITION BY k ORDER BY epi_year, epi_week), f AS (PARTITION BY k ORDER BY epi_year, epi_week ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING))"""


def _alerts(spark, d):
    """Every week of every nation, with high: the probability is in the HIGH band, 0.5 or more."""
    from epiweave.operators import features as fea

    rows = fea.future_sum(fea.vector(zero_filled(spark, d), K), K)
    return rows.withColumns({"high": F.col("roll4") / (F.col("roll4") + 1) >= 0.5, "season": cal.season_id(*WEEK), "t": F.col("t").cast("long")})


@query("evl_alert_lead", with_("zero_filled", "SELECT k, season, min(t) FILTER (WHERE high) AS first_alert, min(t) FILTER (WHERE confirmed > 0) AS first_case, min(t) FILTER (WHERE confirmed > 0) - min(t) FILTER (WHERE high) AS lead_weeks FROM a WHERE season IS NOT NULL GROUP BY 1, 2", a=_ALERT))
def alert_lead(spark, d):
    """Weeks from a season's first HIGH alert to its first case, by place."""
    rows = _alerts(spark, d).where("season is not null")
    out = rows.groupBy("k", "season").agg(F.min(F.when(F.col("high"), F.col("t"))).alias("first_alert"), F.min(F.when(F.col("confirmed") > 0, F.col("t"))).alias("first_case"))
    return out.withColumn("lead_weeks", F.col("first_case") - F.col("first_alert"))


@query("evl_false_alert", with_("zero_filled", "SELECT k, epi_year, epi_week FROM a WHERE high AND f4 = 0", a=_ALERT))
def false_alert(spark, d):
    """HIGH alerts that no case follows in four weeks."""
    return _alerts(spark, d).where(F.col("high") & (F.col("f4") == 0)).select("k", *WEEK)
