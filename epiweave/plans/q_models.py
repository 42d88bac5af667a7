"""Model queries: no SQL says the same, tests hold them against other forms.

The boosted trees are fitted on all series together, the small maps by series. Trees and their scores are
stored by a fingerprint of their rows and read by every query that builds on them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from epiweave.operators import evaluation as ev
from epiweave.operators import features as fea
from epiweave.operators import fits
from epiweave.operators import models as md
from epiweave.sources.shared import stage

from .bindings import SCORES, WEEK
from .q_features import features, usable
from .registry import query

K = ["k"]
_ROW = ("k", *WEEK, "y")
PERSISTENCE = [*md.HARMONICS, "roll4", "lag1", "trend"]
#: The maps of the four comparators: features, and whether they are standardised.
MAPS = {"recent4": (["roll4"], False), "lag1": (["lag1"], False), "seasonal": (list(md.HARMONICS), False), "seasonal_persist": (PERSISTENCE, True)}
#: What the trees of each use have seen.
SEEN = {"calibration": "epi_year <= 1997", "test": "part = 'train'", "latest": "y is not null"}


def usable_once(spark, d):
    """The usable rows as a staged table: the orders are read once, not by each fingerprint, fit and score."""
    return stage(usable(spark, d), "usable")


def rows_of(spark, d):
    return md.with_harmonics(usable_once(spark, d))


def _seen(rows, use):
    rows = rows.where(SEEN[use])
    return md.weighted(rows, rows)


def trained(spark, d, use):
    return _seen(usable_once(spark, d), use)


def tree_scores(spark, d, use):
    """(k, week, y, p): the trees of this use on all labelled weeks, or on the last week of each series."""
    own = usable_once(spark, d)
    rows = own if use != "latest" else stage(md.latest(features(spark, d), K).withColumn("y", F.lit(None).cast("int")), "latest")
    return md.stored_scores(_seen(own, use), rows, fea.NINE, _ROW)


def _map(spark, d, name):
    rows, (used, scaled) = rows_of(spark, d), MAPS[name]
    fit = fits.fit_logistic(rows.where("part = 'train'"), K, used, scaled=scaled)
    return fits.apply(rows.where("part = 'test'"), fit, K, used).select(*_ROW, "p")


@query("mod_gbt")
def gbt(spark, d):
    return tree_scores(spark, d, "test").where("epi_year = 1999")


@query("mod_persist_prob")
def persist_prob(spark, d):
    return _map(spark, d, "recent4")


@query("mod_seasonal")
def seasonal(spark, d):
    return _map(spark, d, "seasonal")


@query("mod_seasonal_persist")
def seasonal_persist(spark, d):
    return _map(spark, d, "seasonal_persist")


def calibrated(spark, d):
    """(k, week, y, p, platt, isotonic) of 1999 and after: trees that saw the years up to 1997, calibrated on 1998 alone.

    Both calibrators are fitted on all series together, as the trees are.
    """
    scores = tree_scores(spark, d, "calibration").withColumn("_all", F.lit(1))
    year, after = scores.where("epi_year = 1998"), scores.where("epi_year > 1998")
    after = fits.apply(after, fits.fit_logistic(year, ["_all"], ["p"]), ["_all"], ["p"], "platt")
    return md.fit_apply_isotonic(year, after, name="isotonic").drop("_all")


@query("mod_platt")
def platt(spark, d):
    return calibrated(spark, d).where("epi_year = 1999").select(*_ROW, "p", F.col("platt").alias("calibrated"))


@query("mod_isotonic")
def isotonic(spark, d):
    return calibrated(spark, d).where("epi_year = 1999").select(*_ROW, "p", F.col("isotonic").alias("calibrated"))


@query("evl_calibration_table")
def calibration_table(spark, d):
    """Raw, Platt and isotonic probabilities of the trees in 1999 and 2000, by year and pooled: n, AUROC, Brier, ECE, log loss."""
    rows = calibrated(spark, d).where("epi_year in (1999, 2000)")
    long = rows.select("y", F.col("epi_year").alias("cohort"), F.expr("stack(3, 'raw', p, 'platt', platt, 'isotonic', isotonic) as (variant, prob)"))
    return ev.summary(long, ["variant", "cohort"], pool="cohort")


@query("mod_expanding")
def expanding(spark, d):
    return md.expanding(usable(spark, d), K, ["roll4", "lag1"])


#: Refits of the trees in the test year: the first week of each quarter.
CUTOFFS = [(1999, 1), (1999, 14), (1999, 27), (1999, 40)]


@query("mod_expanding_trees")
def expanding_trees(spark, d):
    """The weeks from 1999 on by trees refitted each quarter on all that was labelled before."""
    return md.expanding_trees(usable(spark, d), K, fea.NINE, CUTOFFS)


@query("mod_latest_score")
def latest_score(spark, d):
    """The last week of each series, labelled or not: the trees, fitted on all labelled weeks, both persistence scores, and the probabilities of the four comparators."""
    train = rows_of(spark, d).where("part = 'train'")
    out = md.with_harmonics(md.latest(features(spark, d), K))
    for name, (used, scaled) in MAPS.items():
        out = fits.apply(out, fits.fit_logistic(train, K, used, scaled=scaled), K, used, f"p_{name}")
    out = out.join(tree_scores(spark, d, "latest").select("k", "p"), K)
    return out.select("k", *WEEK, F.col("roll4").alias("recent4"), "lag1", "p", *(f"p_{name}" for name in MAPS))


def fitted_scores(spark, d):
    """As `bindings.scored`, with fitted probabilities: the trees and the four comparators' maps on the test year, in long form."""
    rows = rows_of(spark, d)
    train, out = rows.where("part = 'train'"), rows.where("part = 'test'").withColumn("t", F.col("t").cast("long"))
    for name, (used, scaled) in MAPS.items():
        out = fits.apply(out, fits.fit_logistic(train, K, used, scaled=scaled), K, used, f"p_{name}")
    out = out.join(tree_scores(spark, d, "test").select("k", *WEEK, F.col("p").alias("p_model")), ["k", *WEEK])
    made = ", ".join(f"'{m}', {i}, {score}, p_{m}" for i, (m, score) in enumerate(zip(SCORES, ("p_model", "roll4", "cast(lag1 as double)", "p_seasonal", "p_seasonal_persist"), strict=True)))
    return out.select("k", "t", *WEEK, "y", F.expr(f"stack({len(SCORES)}, {made}) as (model, ord, score, prob)"))


@query("evl_fitted_gain")
def fitted_gain(spark, d):
    """The trees against the strongest comparator, all fitted: what evl_gain gives for the stand-ins."""
    return ev.gain(ev.comparators(fitted_scores(spark, d), K), K)


@query("mod_importance")
def importance(spark, d):
    model = md.stored_gbt(trained(spark, d, "test"), fea.NINE)
    return md.importance(model, fea.NINE, spark).withColumn("importance", F.round("importance", 4))


@query("mod_importance_group")
def importance_group(spark, d):
    return md.importance_groups(md.importance(md.stored_gbt(trained(spark, d, "test"), fea.NINE), fea.NINE, spark), ["dry", "epi_week"])
