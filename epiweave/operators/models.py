"""Early-warning models of Spark ML on the panel, and small per-cut-off refits.

Feature columns are assembled by name; `weight` balances the classes. The boosted trees are fitted on all
series together, each by Spark; the small logistic maps are fitted by series (`fits`).
"""

from __future__ import annotations

import datetime
import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from epiweave.functions import calendar as cal
from epiweave.sources.shared import fingerprint, stage, stored, unstage

WEEK = ["epi_year", "epi_week"]
HARMONICS = ("s1", "c1", "s2", "c2")
#: Training rows (some 100 bytes each) of one file, and so of one task in each of a fit's thousands of jobs.
TRAINING_ROWS = 200_000


def with_harmonics(rows: DataFrame) -> DataFrame:
    return rows.withColumns(cal.harmonics("epi_week"))


def fit_gbt(train: DataFrame, features: Sequence[str], trees: int = 300, depth: int = 3, step: float = 0.05, subsample: float = 0.8, columns: str = "0.8", seed: int = 0) -> PipelineModel:
    gbt = GBTClassifier(featuresCol="x", labelCol="y", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=step, subsamplingRate=subsample, featureSubsetStrategy=columns, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="x"), gbt]).fit(train)


def fit_logistic(train: DataFrame, features: Sequence[str], rows: int, scaled: bool = False) -> PipelineModel:
    """L2 with one unit of penalty over the whole sum of losses (regParam is by row); optionally standardised first."""
    raw = VectorAssembler(inputCols=list(features), outputCol="raw" if scaled else "x")
    scale = [StandardScaler(inputCol="raw", outputCol="x", withMean=True, withStd=True)] if scaled else []
    lr = LogisticRegression(featuresCol="x", labelCol="y", regParam=1.0 / max(1, rows), standardization=False, maxIter=200, tol=1e-9)
    return Pipeline(stages=[raw, *scale, lr]).fit(train)


def apply(model: PipelineModel, rows: DataFrame, name: str = "p") -> DataFrame:
    out = model.transform(rows).withColumn(name, vector_to_array("probability")[1])
    return out.drop("x", "raw", "rawPrediction", "probability", "prediction")


def fit_apply_isotonic(fit: DataFrame, score: DataFrame, p: str = "p", name: str = "calibrated") -> DataFrame:
    """Monotone calibration of a probability."""
    model = IsotonicRegression(featuresCol=p, labelCol="y").fit(fit)
    return model.transform(score).withColumnRenamed("prediction", name)


def latest(rows: DataFrame, k: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*k).orderBy(*(F.desc(c) for c in WEEK))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def importance(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    """Gain importance, summing to 1, ranked."""
    values = model.stages[-1].featureImportances.toArray()
    rows = spark.createDataFrame([(f, float(v)) for f, v in zip(features, values, strict=True)], "feature string, importance double")
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))  # one row a feature


def importance_groups(rows: DataFrame, seasonal: Sequence[str]) -> DataFrame:
    group = F.when(F.col("feature").isin(*seasonal), "seasonal").otherwise("case history")
    return rows.groupBy(group.alias("group")).agg(F.sum("importance").alias("importance"))


def weighted(rows: DataFrame, train: DataFrame) -> DataFrame:
    """Rows with the weight of positives that balances the training rows' classes; 1 where these are of one class."""
    n, positives = train.agg(F.count("y"), F.sum("y")).first()
    balance = (n - positives) / positives if positives else 1.0
    return rows.withColumn("weight", F.when(F.col("y") == 1, float(balance or 1.0)).otherwise(1.0))


def in_order(rows: DataFrame, by: Sequence[str], each: int = TRAINING_ROWS) -> DataFrame:
    """Rows in order, in as many partitions as their number asks for, however many a shuffle has and whatever is coalesced."""
    parts = math.ceil(rows.count() / each)
    spread = rows.repartition(1) if parts <= 1 else rows.repartitionByRange(parts, *by)
    return spread.sortWithinPartitions(*by)


def stored_gbt(train: DataFrame, features: Sequence[str], trees: int = 300, name: str = "trees") -> PipelineModel:
    """The model of these rows and features, fitted and saved in the shared folder unless it is there.

    It is found by a fingerprint of the rows, so changed rows get a model of their own. Trees take many small
    jobs over the rows, which are first put in order, as the drawn samples go by it.
    """
    rows = train.select(*features, "y", "weight")
    key = f"{trees}-{fingerprint(rows)}"

    def write(path: str) -> None:
        table = stage(in_order(rows, [*features, "y"]), "training")
        fit_gbt(table, features, trees=trees).write().save(path)
        unstage(table)

    return PipelineModel.load(stored(train.sparkSession, name, key, write))


def stored_scores(model_rows: DataFrame, rows: DataFrame, features: Sequence[str], columns: Sequence[str], trees: int = 300, name: str = "scores") -> DataFrame:
    """(columns, p) of rows by the trees of model_rows, as a table in the shared folder that later calls read."""
    kept = rows.select(*columns, *(f for f in features if f not in columns))
    key = f"{trees}-{fingerprint(model_rows.select(*features, 'y', 'weight'))}-{fingerprint(kept)}"

    def write(path: str) -> None:
        apply(stored_gbt(model_rows, features, trees), kept).select(*columns, "p").write.parquet(path)

    schema = StructType([*(kept.schema[c] for c in columns), StructField("p", DoubleType())])
    return rows.sparkSession.read.schema(schema).parquet(stored(rows.sparkSession, name, key, write))


def expanding_trees(rows: DataFrame, k: Sequence[str], features: Sequence[str], cutoffs: Sequence[tuple[int, int]], horizon: int = 4, trees: int = 300, pool: int = 4, least: int = 20) -> DataFrame:
    """rows(k, epi_year, epi_week, y, features) -> (k, epi_year, epi_week, y, cutoff, p): weeks scored by trees fitted for their cut-off.

    cutoffs are (year, week) of refits, in any number: a weekly list refits each week. A week is scored by
    the latest cut-off not after it; weeks before the first are left out. The fit of a cut-off sees the weeks whose label was known
    then: those whose `horizon` weeks had ended before it. Cut-offs with fewer than `least` such rows, or of
    one class, score by the positive rate, null if there is none. At most `pool` fits run side by side, each
    a Spark job of its own; each writes its scores to the same table, keyed by cut-off, and is found there
    when it is asked for again.
    """
    start = lambda y, w: datetime.date.fromisocalendar(y, w, 1)
    order = sorted(set(cutoffs), key=lambda c: start(*c))
    day = cal.monday(*WEEK)
    table = stage(rows.select(*k, *WEEK, "y", *(f for f in features if f not in WEEK), day.alias("_day")), "expanding")
    columns = [*k, *WEEK, "y"]

    def one(at: tuple[tuple[int, int], tuple[int, int] | None]) -> DataFrame:
        cut, after = at
        known = table.where((F.col("_day") <= F.lit(start(*cut) - datetime.timedelta(weeks=horizon + 1))) & F.col("y").isNotNull())
        now = table.where((F.col("_day") >= F.lit(start(*cut))) & (F.lit(True) if after is None else F.col("_day") < F.lit(start(*after))))
        n, positives = known.agg(F.count("y"), F.sum("y")).first()
        if n >= least and 0 < positives < n:
            out = stored_scores(weighted(known, known), now, features, columns, trees, "expanding")
        else:
            out = now.select(*columns, F.lit(positives / n if n else None).cast("double").alias("p"))
        return out.select(*columns, F.lit(f"{cut[0]}-W{cut[1]:02d}").alias("cutoff"), "p")

    with ThreadPoolExecutor(pool) as threads:
        parts = list(threads.map(one, zip(order, [*order[1:], None], strict=True)))
    return reduce(DataFrame.union, parts)


def newton_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Intercept and weights of an L2 logistic map (the intercept is free)."""
    z = np.column_stack([np.ones(len(x)), x])
    pen = np.diag([0.0, *[ridge] * x.shape[1]]) + 1e-9 * np.eye(z.shape[1])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + pen, z.T @ (y - p) - pen @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def expanding(rows: DataFrame, k: Sequence[str], features: Sequence[str], horizon: int = 4, least: int = 20, ridge: float = 1.0) -> DataFrame:
    """rows(k, epi_year, epi_week, t, y, features) -> (k, epi_year, epi_week, p): each week scored by a map fitted for it.

    The fit of week t sees the weeks whose label was known before t: those whose `horizon` ended by then
    (t - horizon - 1 and earlier). Weeks with fewer than `least` of them, or of one class, get the positive rate so far,
    null if there is none. A group is one series, some hundred weeks; groups spread over tasks.
    """
    long = rows.select(*k, *WEEK, "t", "y", *(F.col(f).cast("double") for f in features))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in k)

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t")
        t, y, x = g.t.to_numpy(), g.y.to_numpy(float), g[list(features)].to_numpy(float)
        p = np.full(len(g), np.nan)
        for i in range(len(g)):
            past = (t < t[i] - horizon) & ~np.isnan(y)
            if past.sum() >= least and 0 < y[past].mean() < 1:
                w = newton_logistic(x[past], y[past], ridge)
                p[i] = 1 / (1 + np.exp(-(w[0] + x[i] @ w[1:])))
            elif past.any():
                p[i] = y[past].mean()
        return g[[*k, *WEEK]].assign(p=p)

    out = long.groupBy(*k).applyInPandas(fit, f"{kinds}, epi_year int, epi_week int, p double")
    return out.withColumn("p", F.when(~F.isnan("p"), F.col("p")))
