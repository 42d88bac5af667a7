"""The model queries, for which there is no SQL: against Newton fits in NumPy, brute force and what was known when."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from epiweave.operators import evaluation as ev
from epiweave.operators import features as fea
from epiweave.operators import fits
from epiweave.operators import models as md
from epiweave.plans import catalog
from epiweave.plans import q_models as qm
from epiweave.plans.bindings import SCORES, scored
from epiweave.plans.q_features import features, usable
from epiweave.sources.shared import fingerprint, stage

from .conftest import SF

COVERED = {
    "evl_calibration_table", "evl_fitted_gain", "mod_expanding_trees", "mod_expanding", "mod_gbt", "mod_importance", "mod_importance_group", "mod_isotonic", "mod_latest_score", "mod_persist_prob", "mod_platt", "mod_seasonal", "mod_seasonal_persist",
}
WEEK = ["k", "epi_year", "epi_week"]


@pytest.fixture(scope="module")
def rows(spark):
    return md.with_harmonics(usable(spark, SF)).toPandas().sort_values(WEEK).reset_index(drop=True)


def run(spark, name):
    return catalog.QUERIES[name](spark, SF).toPandas()


def logistic(x, w):
    return 1 / (1 + np.exp(-(w[0] + x @ w[1:])))


def joined(got, want, names):
    both = got.merge(want, on=WEEK, suffixes=("", "_w"))
    assert len(both) == len(got) == len(want) > 0
    return both[names[0]].to_numpy(float), both[names[1]].to_numpy(float)


def newton(train, test, used, scaled=False):
    """Probabilities of test's rows by maps fitted in NumPy series by series."""
    parts = []
    for k, own in train.groupby("k"):
        x, z = own[used].to_numpy(float), test[test.k == k][used].to_numpy(float)
        if scaled:
            m, s = x.mean(0), x.std(0)
            x, z = (x - m) / np.where(s > 0, s, 1), (z - m) / np.where(s > 0, s, 1)
        parts.append(test[test.k == k][WEEK].assign(p=logistic(z, md.newton_logistic(x, own.y.to_numpy(float)))))
    return pd.concat(parts)


@pytest.mark.parametrize(("name", "used", "scaled"), [("mod_persist_prob", ["roll4"], False), ("mod_seasonal", list(md.HARMONICS), False), ("mod_seasonal_persist", qm.PERSISTENCE, True)])
def test_logistic_maps_of_each_series(spark, rows, name, used, scaled):
    want = newton(rows[rows.part == "train"], rows[rows.part == "test"], used, scaled)
    a, b = joined(run(spark, name), want, ("p", "p_w"))
    assert np.allclose(a, b, atol=1e-6)


def test_fits_of_many_series_need_no_python(spark):
    """Series of random sizes, one of one class, one with nulls and a constant feature, against Newton fits; the step's plan stays in the JVM."""
    d = np.random.default_rng(3)
    data = []
    for k in range(7):
        for _ in range(int(d.integers(5, 60))):
            x = d.normal(size=3) * [1, 10, 0 if k == 3 else 1]
            data.append((k, *map(float, x), int(k == 2 or d.random() < 1 / (1 + np.exp(-x[0] - 0.1 * x[1])))))
    df = spark.createDataFrame([*data, (1, None, 1.0, 1.0, 1), (1, 1.0, 1.0, 1.0, None)], "k long, a double, b double, c double, y int")
    for scaled in (False, True):
        got = {r.k: r for r in fits.fit_logistic(df, ["k"], ["a", "b", "c"], scaled=scaled, rounds=12).collect()}
        assert set(got) == set(range(7))
        for k in range(7):
            own = np.array([r[1:] for r in data if r[0] == k])
            x = own[:, :3]
            if scaled:
                x = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
            want = md.newton_logistic(x, own[:, 3])
            assert got[k].n == len(own)
            if k == 2:  # one class: no finite intercept
                assert (logistic(x, np.array(got[k].w)) > 0.99).all()
            else:
                assert np.allclose(got[k].w, want, atol=1e-6)
    step = df.groupBy("k").agg(F.array(F.array(F.sum("a"), F.sum("b")), F.array(F.sum("b"), F.sum("c"))).alias("m")).select(fits.solve(F.col("m"), 1))
    assert not any(x in step._jdf.queryExecution().toString() for x in ("Python", "Arrow", "Pandas"))


def test_solving(spark):
    d = np.random.default_rng(1)
    for n in (1, 2, 5, 8):
        a = d.normal(size=(n, n))
        a, b = a @ a.T + np.eye(n), d.normal(size=n)
        got = spark.createDataFrame([(np.column_stack([a, b]).tolist(),)], "m array<array<double>>").select(fits.solve(F.col("m"), n)).first()[0]
        assert np.allclose(got, np.linalg.solve(a, b))


@pytest.fixture(scope="module")
def calibration(spark):
    """(1998, after) of the calibration trees' scores."""
    scores = qm.tree_scores(spark, SF, "calibration").toPandas()
    return scores[scores.epi_year == 1998], scores[scores.epi_year > 1998]


def test_platt_is_fitted_on_a_year_the_trees_have_not_seen(spark, rows, calibration):
    year, after = calibration
    w = md.newton_logistic(year[["p"]].to_numpy(), year.y.to_numpy(float))
    want = after[after.epi_year == 1999].assign(c=lambda d: logistic(d[["p"]].to_numpy(), w))
    got = run(spark, "mod_platt")
    for names in (("p", "p_w"), ("calibrated", "c")):
        a, b = joined(got, want[[*WEEK, "p", "c"]], names)
        assert np.allclose(a, b, atol=1e-6)
    turned = usable(spark, SF).withColumn("y", F.when(F.col("epi_year") > 1997, 1 - F.col("y")).otherwise(F.col("y")))
    assert fingerprint(turned.where(qm.SEEN["calibration"])) == fingerprint(usable(spark, SF).where(qm.SEEN["calibration"])) != fingerprint(turned)


def steps(x, y):
    """Isotonic regression as the greatest of the least means, at the distinct x."""
    xs = np.unique(x)
    n, s = np.array([(x == v).sum() for v in xs]), np.array([y[x == v].sum() for v in xs])
    cn, cs = np.append(0, n.cumsum()), np.append(0, s.cumsum())
    mean = lambda a, b: (cs[b + 1] - cs[a]) / (cn[b + 1] - cn[a])
    return xs, np.array([max(min(mean(a, b) for b in range(i, len(xs))) for a in range(i + 1)) for i in range(len(xs))])


def test_isotonic(spark, calibration):
    year, after = calibration
    xs, g = steps(year.p.to_numpy().round(9), year.y.to_numpy(float))
    want = after[after.epi_year == 1999].assign(c=lambda d: np.interp(d.p, xs, g))
    got = run(spark, "mod_isotonic")
    a, b = joined(got, want[[*WEEK, "c"]], ("calibrated", "c"))
    assert np.abs(a - b).mean() < 0.01 and np.isclose(np.sort(a), a[np.argsort(got.p.to_numpy())]).mean() > 0.99


def auroc(p, y):
    up, down = p[y == 1][:, None], p[y == 0][None, :]
    return ((up > down) + 0.5 * (up == down)).mean() if up.size and down.size else np.nan


def test_calibration_table(spark, calibration):
    """All nine rows, from the trees' scores and both calibrators, against plain NumPy."""
    got = run(spark, "evl_calibration_table")
    year, after = calibration
    w = md.newton_logistic(year[["p"]].to_numpy(), year.y.to_numpy(float))
    iso = run(spark, "mod_isotonic").merge(after[WEEK], on=WEEK)
    xs, g = steps(year.p.to_numpy(), year.y.to_numpy(float))
    after = after[after.epi_year.isin([1999, 2000])]
    after = after.assign(raw=after.p, platt=logistic(after[["p"]].to_numpy(), w), isotonic=np.interp(after.p, xs, g))
    assert len(iso) and len(got) == 3 * (after.epi_year.nunique() + 1) and got.pooled.sum() == 3 and (got.cohort.isna() == got.pooled).all()
    for r in got.itertuples():
        part = after if r.pooled else after[after.epi_year == r.cohort]
        p, y = part[r.variant].to_numpy(), part.y.to_numpy(float)
        bins = np.minimum((p[:, None] >= np.array(ev.bin_edges(5))[1:-1]).sum(1), 4)
        gap = sum(abs(p[bins == b].sum() - y[bins == b].sum()) for b in range(5)) / len(p)
        c = np.clip(p, 1e-15, 1 - 1e-15)
        loss = -np.mean(np.where(y == 1, np.log(c), np.log(1 - c)))
        close = 1e-6 if r.variant != "isotonic" else 0.02  # between steps Spark's map has other knots
        assert r.n == len(p) and np.allclose([r.rate, r.brier, r.ece], [y.mean(), ((p - y) ** 2).mean(), gap], atol=close)
        assert r.variant == "isotonic" or (np.isclose(r.log_loss, loss, atol=1e-5) and np.isclose(r.auroc, auroc(p, y), atol=1e-6, equal_nan=True))


def test_summaries_read_once_and_tell_nulls_from_totals(spark):
    rows = [("a", None, 0.2, 0), ("a", None, 0.9, 1), ("a", 1, 0.4, 1), ("a", 1, 0.4, 0), ("b", 2, 0.5, 1), ("b", 2, None, 1)]
    df = spark.createDataFrame(rows, "v string, c int, prob double, y int")
    got = {(r.v, r.c, r.pooled): (r.n, r.auroc) for r in ev.summary(df, ["v", "c"], pool="c").collect()}
    assert got == {("a", None, False): (2, 1.0), ("a", 1, False): (2, 0.5), ("b", 2, False): (1, None), ("a", None, True): (4, 0.875), ("b", None, True): (1, None)}
    plain = {(r.v, r.c): r.auroc for r in ev.summary(df, ["v", "c"]).collect()}
    assert plain == {k[:2]: v[1] for k, v in got.items() if not k[2]}


def test_wide_groups_over_many_partitions(spark):
    """One group of distinct scores over many ranges: comparators and summaries as by brute force."""
    d = np.random.default_rng(7)
    p, y = d.random(3000).round(3), (d.random(3000) < 0.4).astype(int)
    df = spark.createDataFrame([(1, "m", 0, float(a), float(a), int(b)) for a, b in zip(p, y, strict=True)], "k int, model string, ord int, score double, prob double, y int").repartition(16)
    assert np.isclose(ev.comparators(df, ["k"]).first()["auroc"], auroc(p, y)) and np.isclose(ev.summary(df, ["k"]).first()["auroc"], auroc(p, y))


def test_replicates_against_plain_draws(spark):
    """Each replicate's AUROC and Brier differences, from its drawn weeks, with ties, a one-class draw and groups that share draws."""
    d = np.random.default_rng(2)
    n, data = 23, []
    for base in ("u", "v"):
        for i in range(1, n + 1):
            data.append((1, base, i, int(i <= 6), *map(float, d.random(4).round(1))))
    df = spark.createDataFrame(data, "k int, base string, i long, y int, score double, prob double, base_score double, base_prob double")
    out = ev.replicates(df, df.groupBy("k").agg(F.max("i").alias("n")), ["k", "base"], ["k"], 600, 4, "s").collect()
    assert len(out) == 1200
    some = 0
    for r in out:
        own = {x[2]: x[3:] for x in data if x[1] == r.base}
        starts = [int(int(hashlib.md5(f"s|1|{r.rep}|{b}".encode()).hexdigest()[:8], 16) / 4294967296.0 * (n - 4 + 1)) for b in range(6)]
        drawn = np.array([own[s + o + 1] for b, s in enumerate(starts) for o in range(4) if b * 4 + o < n])
        y, score, prob, base_score, base_prob = drawn.T
        assert np.isclose(r.d_brier, ((prob - y) ** 2 - (base_prob - y) ** 2).mean())
        if 0 < y.mean() < 1:
            assert np.isclose(r.d_auroc, auroc(score, y) - auroc(base_score, y))
        else:
            some += 1
            assert r.d_auroc is None
    assert some and ev.block_bootstrap(df, ["k", "base"], 600, 4, "s", ["k"]).count() == 1200 - some


def test_expanding_knows_only_what_was_known(spark, rows):
    got = run(spark, "mod_expanding").sort_values(WEEK)
    part = rows[rows.k == rows.k.min()].sort_values("t")
    own = got[got.k == rows.k.min()].p.to_numpy()
    for i in (30, len(part) // 2, len(part) - 1):
        past = part[part.t < part.t.iloc[i] - 4]
        if len(past) >= 20 and 0 < past.y.mean() < 1:
            w = md.newton_logistic(past[["roll4", "lag1"]].to_numpy(float), past.y.to_numpy(float))
            assert np.isclose(own[i], logistic(part[["roll4", "lag1"]].to_numpy(float)[i], w), atol=1e-6)
    turned = usable(spark, SF).withColumn("y", F.when(F.col("t") >= 120, 1 - F.col("y")).otherwise(F.col("y")))
    other = md.expanding(turned, ["k"], ["roll4", "lag1"]).toPandas().sort_values(WEEK)
    t = rows.sort_values(WEEK).t.to_numpy()
    same = np.isclose(got.p.to_numpy(), other.p.to_numpy(), equal_nan=True)
    assert same[t <= 124].all() and not same[t > 124].all()


def test_expanding_trees_know_only_what_was_known(spark):
    """Weekly cut-offs: later labels change no earlier score; a cut-off's scores are those of a fit on what was known."""
    small = usable(spark, SF)
    cuts = [(1997, w) for w in range(10, 16)] + [(1992, 1)]
    got = md.expanding_trees(small, ["k"], fea.NINE, cuts, trees=3).toPandas().sort_values(WEEK)
    assert set(got.cutoff) <= {f"{y}-W{w:02d}" for y, w in cuts} and len(set(got.cutoff)) > 4 and len(got) == small.count()
    assert ((got.epi_week == got.cutoff.str[-2:].astype(int)) | (got.cutoff == "1997-W15") | (got.cutoff == "1992-W01")).all()
    week = int(got[(got.cutoff > "1997-W10") & (got.cutoff < "1997-W15")].cutoff.iloc[0][-2:])
    known = small.where(f"epi_year < 1997 or epi_year = 1997 and epi_week <= {week - 5}")
    want = md.apply(md.stored_gbt(md.weighted(known, known), fea.NINE, trees=3), small.where(f"epi_year = 1997 and epi_week = {week}")).toPandas()
    a, b = joined(got[got.cutoff == f"1997-W{week}"], want[[*WEEK, "p"]], ("p", "p_w"))
    assert np.allclose(a, b)
    turned = small.withColumn("y", F.when((F.col("epi_year") > 1997) | (F.col("epi_year") == 1997) & (F.col("epi_week") >= week - 4), 1 - F.col("y")).otherwise(F.col("y")))
    other = md.expanding_trees(turned, ["k"], fea.NINE, cuts, trees=3).toPandas().sort_values(WEEK)
    same = np.isclose(got.p, other.p, equal_nan=True)
    early = (got.epi_year < 1997) | ((got.epi_year == 1997) & (got.epi_week <= week))
    assert same[early].all() and not same[~early].all()


def test_expanding_trees_of_the_test_year(spark, rows):
    got = run(spark, "mod_expanding_trees")
    assert len(got) == (rows.epi_year >= 1999).sum() and got.p.between(0, 1).all() and got.cutoff.nunique() == 4


def test_latest_score_is_of_the_last_week(spark, rows):
    got = run(spark, "mod_latest_score").set_index("k")
    every = features(spark, SF).toPandas().sort_values(WEEK)
    last = every.groupby("k").tail(1).set_index("k")
    assert (got.epi_year == last.epi_year).all() and (got.epi_week == last.epi_week).all() and last.f4.isna().all()
    assert np.allclose(got.recent4, last.roll4) and (got.lag1 == last.lag1).all()
    train = rows[rows.part == "train"]
    harmonics = md.with_harmonics(features(spark, SF)).toPandas().sort_values(WEEK).groupby("k").tail(1)
    for name, (used, scaled) in qm.MAPS.items():
        want = newton(train, harmonics, used, scaled).set_index("k").p
        assert np.allclose(got[f"p_{name}"], want.loc[got.index], atol=1e-6)
    model = md.stored_gbt(qm.trained(spark, SF, "latest"), fea.NINE)
    p = md.apply(model, md.latest(features(spark, SF), ["k"])).toPandas().set_index("k").p
    assert np.allclose(got.p, p.loc[got.index])


def test_boosted_trees(spark, rows):
    got = run(spark, "mod_gbt")
    assert len(got) == (rows.part == "test").sum() and got.p.between(0, 1).all()
    train = qm.trained(spark, SF, "test")
    model = md.stored_gbt(train, fea.NINE).stages[-1]
    assert model.getNumTrees == 300 and all(t.depth <= 3 for t in model.trees)
    seen = md.apply(md.stored_gbt(train, fea.NINE), train).toPandas()
    assert auroc(seen.p.to_numpy(), seen.y.to_numpy()) > 0.9  # 300 trees fit their own rows
    top = run(spark, "mod_importance")
    assert set(top.feature) == set(fea.NINE) and abs(top.importance.sum() - 1) < 1e-3 and top.sort_values("rank").importance.is_monotonic_decreasing
    groups = run(spark, "mod_importance_group").set_index("group").importance
    assert abs(groups["seasonal"] - top[top.feature.isin(["dry", "epi_week"])].importance.sum()) < 1e-3 and abs(groups.sum() - 1) < 1e-9


def test_what_the_trees_read_many_times_is_staged(spark):
    """Fingerprints, fits and scores read a table of the usable rows; only staging it reads the orders."""
    for rows in (qm.trained(spark, SF, "calibration"), qm.rows_of(spark, SF)):
        assert rows.inputFiles() and not any(t in f for f in rows.inputFiles() for t in ("orders", "customer"))
    assert fingerprint(qm.usable_once(spark, SF)) == fingerprint(usable(spark, SF))


def test_training_rows_make_tasks_by_their_number(spark):
    """A fit has thousands of jobs: how many tasks each has goes by the rows, not by the partitions of a shuffle."""
    df = spark.range(0, 1000, 1, 9).select((F.col("id") * 7 % 1000).alias("a"), (F.col("id") % 2).alias("y"))
    coalesced = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesced, "false")
    try:
        for each, parts in ((200_000, 1), (1000, 1), (300, 4)):
            got = md.in_order(df, ["a", "y"], each).rdd.glom().collect()
            assert len(got) == parts and [r.a for p in got for r in p] == list(range(1000))
    finally:
        spark.conf.unset(coalesced)


def test_boosted_trees_on_held_out_weeks(spark):
    """On series whose next weeks follow from their last, trees rank weeks they have not seen."""
    d = np.random.default_rng(0)
    data = [(k, w, float(x := d.random()), float(d.random()), int(d.random() < 1 / (1 + np.exp(-12 * (x - 0.5))))) for k in range(4) for w in range(150)]
    df = spark.createDataFrame(data, "k int, w int, a double, b double, y int")
    train = df.where("w < 100")
    out = md.apply(md.fit_gbt(stage(md.weighted(train, train), "t"), ["a", "b"], trees=20), df.where("w >= 100")).toPandas()
    assert auroc(out.p.to_numpy(), out.y.to_numpy()) > 0.85


def test_fitted_scores_go_through_the_evaluation(spark, rows):
    """The fitted table has the columns and models of the stand-ins; the gain is that of brute force on it."""
    table = qm.fitted_scores(spark, SF)
    assert table.columns == scored(spark, SF).columns and {r.model for r in table.select("model").distinct().collect()} == set(SCORES)
    own = table.toPandas()
    got = run(spark, "evl_fitted_gain").set_index("k")
    for k, part in own.groupby("k"):
        area = {m: auroc(g.score.to_numpy(), g.y.to_numpy()) for m, g in part.groupby("model")}
        if part.y.nunique() == 2:
            assert np.isclose(got.loc[k].model_auroc, area["model"]) and np.isclose(got.loc[k].best_auroc, max(v for m, v in area.items() if m != "model"))


def test_weights_of_one_class(spark):
    df = spark.createDataFrame([(0,), (0,)], "y int")
    assert [r.weight for r in md.weighted(df, df).collect()] == [1.0, 1.0]
    assert [r.weight for r in md.weighted(df.withColumn("y", F.lit(1)), df.withColumn("y", F.lit(1))).collect()] == [1.0, 1.0]


def test_a_changed_table_gets_a_model_of_its_own(spark):
    df = spark.range(60).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 2).cast("int").alias("y"), F.lit(1.0).alias("weight"))
    first, again = md.stored_gbt(df, ["a"], trees=2), md.stored_gbt(df.repartition(3), ["a"], trees=2)
    assert first.stages[-1].uid == again.stages[-1].uid != md.stored_gbt(df.withColumn("y", 1 - F.col("y")), ["a"], trees=2).stages[-1].uid
