"""Logistic maps of every series at once: Newton steps as grouped sums, coefficients as a table.

A map has an intercept, which is free, and an L2 penalty of `ridge` on its weights. All series take their
Newton step in the same job: the sums of X'WX and X'(y - p) by series are pre-aggregated where the rows lie,
and the small systems are solved by array functions. No Python worker takes part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epiweave.sources.shared import stage, unstage

#: Coefficients of at most so many series (some 200 bytes each) are broadcast to the rows; more are joined by a shuffle.
BROADCAST_SERIES = 50_000


def _dot(z: Sequence[Column], w: Column) -> Column:
    return sum((v * w[i] for i, v in enumerate(z)), F.lit(0.0))


def _probability(z: Sequence[Column], w: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(_dot(z, w), F.lit(-30.0)), F.lit(30.0))))


def solve(matrix: Column, n: int) -> Column:
    """The solution of n equations given as rows of n + 1 numbers, by elimination; for positive definite systems."""

    def pivot(m: Column, c: Column) -> Column:
        row = m[c]
        return F.transform(m, lambda r, i: F.when(i == c, F.transform(r, lambda v: v / r[c])).otherwise(F.zip_with(r, row, lambda a, b: a - r[c] / row[c] * b)))

    done = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), matrix, pivot)
    return F.transform(done, lambda r: r[n])


def _near(rows: DataFrame, table: DataFrame, k: Sequence[str], broadcast: bool) -> DataFrame:
    return rows.join(F.broadcast(table) if broadcast else table, list(k))


def fit_logistic(rows: DataFrame, k: Sequence[str], features: Sequence[str], ridge: float = 1.0, scaled: bool = False, y: str = "y", rounds: int = 30, settled: float = 1e-8) -> DataFrame:
    """rows(k, features, y) -> (k, n, w, mean, sd): w is the intercept and the weights of each series' map.

    With scaled the features are standardised first by the series' own means and deviations (of the whole
    population; 1 where a feature is constant). Rows with a null label or feature are left out. Steps end
    when no coefficient of any series moves by more than `settled`, which is looked at after each,
    or after `rounds` (a series of one class has no finite intercept; the clipped margin of 30 bounds it).
    """
    size = len(features) + 1
    used = rows.select(*k, F.col(y).cast("double").alias("_y"), *(F.col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(features))).dropna()
    names = [f"_f{i}" for i in range(size - 1)]
    used = stage(used, "fit")
    about = used.groupBy(*k).agg(F.count("*").alias("n"), F.array(*(F.avg(c) for c in names)).alias("mean"), F.array(*(F.stddev_pop(c) for c in names)).alias("sd"))
    if scaled:
        about = about.withColumn("sd", F.transform("sd", lambda s: F.when(s > 0, s).otherwise(1.0)))
    else:
        about = about.withColumns({"mean": F.array_repeat(F.lit(0.0), size - 1), "sd": F.array_repeat(F.lit(1.0), size - 1)})
    now = stage(about.withColumns({"w": F.array_repeat(F.lit(0.0), size), "moved": F.lit(1.0)}), "weights")
    broadcast = now.count() <= BROADCAST_SERIES
    z = [F.lit(1.0), *((F.col(c) - F.col("mean")[i]) / F.col("sd")[i] for i, c in enumerate(names))]
    pairs = [(i, j) for i in range(size) for j in range(i + 1)]
    for _ in range(rounds):
        p = _probability([F.col(f"_z{i}") for i in range(size)], F.col("w"))
        with_z = _near(used, now.select(*k, "mean", "sd", "w"), k, broadcast).select(*k, "_y", "w", *(c.alias(f"_z{i}") for i, c in enumerate(z)))
        with_p = with_z.withColumn("_p", p).withColumn("_v", F.col("_p") * (1 - F.col("_p")))
        sums = with_p.groupBy(*k).agg(*(F.sum(F.col("_v") * F.col(f"_z{i}") * F.col(f"_z{j}")).alias(f"_h{i}_{j}") for i, j in pairs), *(F.sum(F.col(f"_z{i}") * (F.col("_y") - F.col("_p"))).alias(f"_g{i}") for i in range(size)))
        cell = lambda i, j: F.col(f"_h{max(i, j)}_{min(i, j)}") + (F.lit((ridge if i else 0.0) + 1e-9) if i == j else F.lit(0.0))
        matrix = F.array(*(F.array(*(cell(i, j) for j in range(size)), F.col(f"_g{i}") - (F.col("w")[i] * ridge if i else F.lit(0.0))) for i in range(size)))
        stepped = now.join(sums, list(k)).withColumn("_step", solve(matrix, size))
        stepped = stepped.select(*k, "n", "mean", "sd", F.zip_with("w", "_step", lambda a, b: a + b).alias("w"), F.array_max(F.transform("_step", F.abs)).alias("moved"))
        before, now = now, stage(stepped, "weights")
        unstage(before)
        if (now.agg(F.max("moved")).first()[0] or 0.0) < settled:
            break
    unstage(used)
    return now.select(*k, "n", "w", "mean", "sd")


def apply(rows: DataFrame, fit: DataFrame, k: Sequence[str], features: Sequence[str], name: str = "p") -> DataFrame:
    """rows with the probability of their series' map; null where the series has none or a feature is null."""
    table = fit.select(*k, F.col("w").alias("_w"), F.col("mean").alias("_mean"), F.col("sd").alias("_sd"))
    if fit.limit(BROADCAST_SERIES + 1).count() <= BROADCAST_SERIES:
        table = F.broadcast(table)
    z = [F.lit(1.0), *((F.col(f).cast("double") - F.col("_mean")[i]) / F.col("_sd")[i] for i, f in enumerate(features))]
    return rows.join(table, list(k), "left").withColumn(name, _probability(z, F.col("_w"))).drop("_w", "_mean", "_sd")
