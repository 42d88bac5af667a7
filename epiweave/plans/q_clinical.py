"""Clinical queries: one patient for each order."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from epiweave.operators import clinical as cl
from epiweave.operators import evaluation as ev

from .bindings import line_list, with_
from .q_evaluation import auroc_sql
from .registry import query

_SAME = {n: n for n in cl.WEIGHTS} | {"rapid_onset_lt_3d": "rapid_onset", "rash_present": "rash", "contact_confirmed": "contact_confirmed_case"}
_DERIVED = {"fever_high": "coalesce(fever_temp >= 39.0, false)", "duration_7_plus_days": "coalesce(duration >= 7, false)", "age_15_to_49": "coalesce(age BETWEEN 15 AND 49, false)", "male_sex": "sex = 'male'", "hcw_febrile_care": "(hcw_febrile_care OR is_hcw)"}
_FLAGGED = "SELECT *, " + ", ".join(f"{_DERIVED.get(n, _SAME[n])} AS f_{n}" for n in cl.WEIGHTS) + " FROM line_list"
_SUM = " + ".join([repr(math.log(cl.PRIOR / (1 - cl.PRIOR))), *(f"CASE WHEN f_{n} THEN CAST({w} AS DOUBLE) ELSE 0.0 END" for n, w in cl.WEIGHTS.items())])




def _competitors() -> dict[str, str]:
    """Step by step as columns, so that the SQL stays short."""
    out, last = {}, "flagged"
    for step in range(8):
        cols = []
        for i, (_, base, up, boost, down, suppress) in enumerate(cl.COMPETITORS):
            before = f"CAST({base} AS DOUBLE)" if step == 0 else f"p{i}"
            moves = [("least(CAST(0.95 AS DOUBLE), {} + CAST(%s AS DOUBLE))" % boost, n) for n in up] + [("greatest(CAST(0.01 AS DOUBLE), {} - CAST(%s AS DOUBLE))" % suppress, n) for n in down]
            cols.append(f"CASE WHEN f_{moves[step][1]} THEN {moves[step][0].format(before)} ELSE {before} END AS p{i}" if step < len(moves) else f"{before} AS p{i}")
        drop = "* EXCLUDE (" + ", ".join(f"p{i}" for i in range(len(cl.COMPETITORS))) + ")" if step else "*"
        out[f"s{step}"] = f"SELECT {drop}, {', '.join(cols)} FROM {last}"
        last = f"s{step}"
    return out


_SCORED = {
    "flagged": _FLAGGED,
    "odds": f"SELECT *, {_SUM} AS log_odds FROM flagged",
    "prob": "SELECT *, CASE WHEN fever THEN 1 / (1 + exp(-log_odds)) ELSE 0.0 END AS probability FROM odds",
    "sc": "SELECT *, CAST(round_even(probability * 100, 0) AS INTEGER) AS pct FROM prob",
    "cat": "SELECT *, CASE WHEN pct <= 25 THEN 'low' WHEN pct <= 50 THEN 'moderate' WHEN pct <= 75 THEN 'high' ELSE 'very_high' END AS category FROM sc",
}
_POINTS = "15 + " + " + ".join(f"CASE WHEN {n} THEN {p} ELSE 0 END" for n, p in cl.POINTS.items()) + " + CASE WHEN is_hcw AND hcw_febrile_care THEN 20 ELSE 0 END"
_COP = {"cop": f"SELECT *, CAST(least(floor(CASE WHEN hcw_febrile_care OR {' OR '.join(cl.POINTS)} THEN ({_POINTS}) * CASE WHEN state IN {cl.POINTS_STATES} THEN CAST(1.25 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END ELSE 5.0 END + 0.5), 95) AS INTEGER) AS score FROM line_list"}
_BAND = "CASE WHEN score < 35 THEN 'low' WHEN score < 60 THEN 'moderate' WHEN score < 80 THEN 'high' ELSE 'very-high' END"


@query("cln_derived_flags", with_("line_list", "SELECT id, f_fever_high, f_duration_7_plus_days, f_age_15_to_49, f_male_sex, f_hcw_febrile_care FROM flagged", flagged=_FLAGGED))
def derived(spark, d):
    return cl.with_flags(line_list(spark, d)).select("id", "f_fever_high", "f_duration_7_plus_days", "f_age_15_to_49", "f_male_sex", "f_hcw_febrile_care")


@query("cln_logodds", with_("line_list", "SELECT id, round(log_odds, 6) AS log_odds, round(probability, 6) AS probability, pct FROM sc", **_SCORED))
def logodds(spark, d):
    return cl.scored(line_list(spark, d)).select("id", F.round("log_odds", 6).alias("log_odds"), F.round("probability", 6).alias("probability"), "pct")


@query("cln_category", with_("line_list", "SELECT id, pct, category FROM cat", **_SCORED))
def category(spark, d):
    return cl.scored(line_list(spark, d)).select("id", "pct", "category")


def _by_category(text) -> str:
    return "CASE category " + " ".join(f"WHEN '{c}' THEN '{text(c)}'" for c in cl.CATEGORIES) + " END"


@query("cln_actions", with_("line_list", f"SELECT id, category, {_by_category(lambda c: cl.CATEGORIES[c][0])} AS label, {_by_category(lambda c: cl.CATEGORIES[c][1])} AS color, category IN ('high', 'very_high') AS isolate, {_by_category(lambda c: cl.ADVICE[c][0])} AS recommendation, {_by_category(lambda c: ' | '.join(cl.ADVICE[c][1]))} AS actions FROM cat", **_SCORED))
def actions(spark, d):
    return cl.actions(cl.scored(line_list(spark, d))).select("id", "category", "label", "color", "isolate", "recommendation", F.array_join("actions", " | ").alias("actions"))


_ACTIVE = " UNION ALL ".join(f"SELECT id, {abs(w)} AS o, {i} AS i, '{n}' AS key FROM flagged WHERE fever AND f_{n}" for i, (n, w) in enumerate(cl.WEIGHTS.items()))


@query("cln_features_active", with_("line_list", "SELECT l.id, coalesce(keys, '') AS keys FROM line_list l LEFT JOIN (SELECT id, string_agg(key, ',' ORDER BY o DESC, i) AS keys FROM active GROUP BY id) a ON a.id = l.id", flagged=_FLAGGED, active=_ACTIVE))
def active(spark, d):
    rows = cl.with_flags(line_list(spark, d)).withColumn("a", cl.features_active())
    return rows.select("id", F.array_join(F.transform("a", lambda x: x["key"]), ",").alias("keys"))


_STEPS = _competitors()


@query("cln_differentials", with_("line_list", "SELECT id, " + ", ".join(f"CAST(round_even(p{i} * 100, 0) AS INTEGER) AS d{i}" for i in range(7)) + " FROM s7", flagged=_FLAGGED, **_STEPS))
def differentials(spark, d):
    rows = cl.with_flags(line_list(spark, d))
    return rows.select("id", *(cl.competitor_pct(b, u, x, w, y).alias(f"d{i}") for i, (_, b, u, x, w, y) in enumerate(cl.COMPETITORS)))


_RANKED = "SELECT id, pct, 0 AS i, '" + cl.TARGET + "' AS name FROM sc WHERE fever UNION ALL " + " UNION ALL ".join(f"SELECT id, CAST(round_even(p{i} * 100, 0) AS INTEGER), {i + 1}, '{c[0]}' FROM s7 WHERE fever" for i, c in enumerate(cl.COMPETITORS))


@query("cln_rank", with_("line_list", "SELECT l.id, coalesce(ranking, '') AS ranking FROM line_list l LEFT JOIN (SELECT id, string_agg(name || ':' || pct, ';' ORDER BY pct DESC, i) AS ranking FROM ranked GROUP BY id) r ON r.id = l.id", **_SCORED, **_STEPS, ranked=_RANKED))
def rank(spark, d):
    rows = cl.scored(line_list(spark, d)).withColumn("r", cl.ranked())
    return rows.select("id", F.array_join(F.transform("r", lambda x: F.concat(x["name"], F.lit(":"), x["pct"].cast("string"))), ";").alias("ranking"))


@query("cln_eval", with_("line_list", "SELECT state, round(auroc, 6) AS auroc, n, positives FROM area", **_SCORED, rows="SELECT state, round(probability, 9) AS score, y FROM sc", area=auroc_sql("state", "rows")))
def evaluation(spark, d):
    rows = cl.scored(line_list(spark, d)).select("state", F.round("probability", 9).alias("score"), "y")
    return ev.wide_auroc(rows, ["state"]).withColumn("auroc", F.round("auroc", 6))


@query("cop_score", with_("line_list", "SELECT id, score FROM cop", **_COP))
def cop_score(spark, d):
    return line_list(spark, d).select("id", cl.points().alias("score"))


@query("cop_band", with_("line_list", f"SELECT id, score, {_BAND} AS band FROM cop", **_COP))
def cop_band(spark, d):
    return line_list(spark, d).select("id", cl.points().alias("score")).withColumn("band", cl.points_band())


@query("cop_differentials", with_("line_list", "SELECT id, CAST(least(90, greatest(5, floor(85 - score * CAST(0.6 AS DOUBLE) + 0.5))) AS INTEGER) AS malaria, CAST(least(60, greatest(3, floor(40 - score * CAST(0.3 AS DOUBLE) + 0.5))) AS INTEGER) AS typhoid, CAST(CASE WHEN score > 40 THEN least(25, floor(score * CAST(0.12 AS DOUBLE) + 0.5)) ELSE 3 END AS INTEGER) AS other_vhf, CAST(least(40, greatest(2, floor(25 - score * CAST(0.2 AS DOUBLE) + 0.5))) AS INTEGER) AS sepsis FROM cop", **_COP))
def cop_differentials(spark, d):
    rows = line_list(spark, d).select("id", cl.points().alias("score"))
    return rows.select("id", *(c.alias(n) for n, c in cl.points_differentials().items()))


@query("cln_compare", with_("line_list", "SELECT category, count(*) FILTER (WHERE band = 'low') AS low, count(*) FILTER (WHERE band = 'moderate') AS moderate, count(*) FILTER (WHERE band = 'high') AS high, count(*) FILTER (WHERE band = 'very-high') AS very_high FROM (SELECT category, " + _BAND + " AS band FROM cat JOIN (SELECT id AS i, score FROM cop) ON id = i) GROUP BY 1", **_SCORED, **_COP))
def compare(spark, d):
    rows = cl.scored(line_list(spark, d)).withColumn("score", cl.points()).withColumn("band", cl.points_band())
    out = rows.groupBy("category").pivot("band", ["low", "moderate", "high", "very-high"]).count().withColumnRenamed("very-high", "very_high")
    return out.na.fill(0)
