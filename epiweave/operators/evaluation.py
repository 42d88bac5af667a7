"""Discrimination, calibration, block bootstrap and verdicts, grouped by any columns.

`by` names the group columns; score orders cases, p is a probability, y is 0 or 1.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epiweave.sources.shared import stage


def running(steps: DataFrame, by: Sequence[str], order: str, sums: Sequence[str], descending: bool = False) -> DataFrame:
    """Adds before_<c>: the sum of c over the rows of the group that come before, for groups of any size.

    The rows are dealt out by ranges of group and order, so a single group spreads over all tasks; what lies
    before a range follows from one row a range and group. order must be unique within a group.
    """
    key = F.desc(order) if descending else F.asc(order)
    ranged = stage(steps.repartitionByRange(*by, key).withColumn("_part", F.spark_partition_id()), "ranges")
    total = ranged.groupBy(*by, "_part").agg(*(F.sum(c).alias(c) for c in sums))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    total = total.select(*by, "_part", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in sums))
    within = Window.partitionBy(*by, "_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.withColumns({f"before_{c}": F.coalesce(F.sum(c).over(within), F.lit(0)) for c in sums})
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in [*by, "_part"]]
    marked = total.select(*(F.col(c).alias(f"{c}_") for c in [*by, "_part"]), *(f"_{c}" for c in sums))
    joined = own.join(marked, reduce(and_, same))
    return joined.select(*steps.columns, *((F.col(f"before_{c}") + F.col(f"_{c}")).alias(f"before_{c}") for c in sums))


def wide_auroc(scored: DataFrame, by: Sequence[str], score: str = "score", y: str = "y") -> DataFrame:
    """As `auroc`, for few groups of very many distinct scores: a group spreads over all tasks."""
    steps = scored.groupBy(*by, score).agg(F.count_if(F.col(y) == 1).alias("_p"), F.count_if(F.col(y) == 0).alias("_n"))
    wins = running(steps, by, score, ["_n"]).withColumn("_w", F.col("_p") * (F.col("before__n") + F.col("_n") / 2))
    return wins.groupBy(*by).agg((F.sum("_w") / F.nullif(F.sum("_p") * F.sum("_n"), F.lit(0))).alias("auroc"), F.sum(F.col("_p") + F.col("_n")).alias("n"), F.sum("_p").alias("positives"))


def auroc(scored: DataFrame, by: Sequence[str], score: str = "score", y: str = "y", n: Column | None = None) -> DataFrame:
    """Area under the ROC curve, ties half; null for groups of one class.

    Cases are first counted by distinct score (n: how often a row counts), so the window ranks distinct
    scores, not rows, and repeated scores shrink before the shuffle. A group is one task: right for many
    groups such as replicates; `wide_auroc` is for few large ones.
    """
    times = F.lit(1) if n is None else n
    steps = scored.groupBy(*by, score).agg(F.sum(F.when(F.col(y) == 1, times).otherwise(0)).alias("_p"), F.sum(F.when(F.col(y) == 0, times).otherwise(0)).alias("_n"))
    w = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("_n").over(w), F.lit(0))
    wins = steps.withColumn("_w", F.col("_p") * (below + F.col("_n") / 2))
    out = wins.groupBy(*by).agg((F.sum("_w") / F.nullif(F.sum("_p") * F.sum("_n"), F.lit(0))).alias("auroc"), F.sum(F.col("_p") + F.col("_n")).alias("n"), F.sum("_p").alias("positives"))
    return out


def roc_curve(scored: DataFrame, by: Sequence[str], score: str = "score", y: str = "y") -> DataFrame:
    """One point for each distinct score as threshold, with rates and the area of the trapezoid that ends there; a group spreads over all tasks."""
    steps = scored.groupBy(*by, score).agg(F.sum(y).cast("double").alias("_p"), F.sum(1 - F.col(y)).cast("double").alias("_n"))
    every = scored.groupBy(*by).agg(F.nullif(F.sum(y).cast("double"), F.lit(0.0)).alias("_every_p"), F.nullif(F.sum(1 - F.col(y)).cast("double"), F.lit(0.0)).alias("_every_n"))
    run = running(steps, by, score, ["_p", "_n"], descending=True).join(every, list(by))
    tpr, fpr = ((F.col(f"before_{c}") + F.col(c)) / F.col(f"_every{c}") for c in ("_p", "_n"))
    out = run.withColumns({"tpr": tpr, "fpr": fpr, "_t": F.coalesce(F.col("before__p") / F.col("_every_p"), F.lit(0.0)), "_f": F.coalesce(F.col("before__n") / F.col("_every_n"), F.lit(0.0))})
    return out.withColumn("area", (F.col("fpr") - F.col("_f")) * (F.col("tpr") + F.col("_t")) / 2).select(*by, score, "tpr", "fpr", "area")


def brier(p: str = "prob", y: str = "y") -> Column:
    return F.avg(F.pow(F.col(p) - F.col(y), 2))


def log_loss(p: str = "prob", y: str = "y", least: float = 1e-15) -> Column:
    clipped = F.least(F.greatest(F.col(p), F.lit(least)), F.lit(1 - least))
    return -F.avg(F.when(F.col(y) == 1, F.log(clipped)).otherwise(F.log(1 - clipped)))


def confusion(scored: DataFrame, by: Sequence[str], p: str = "prob", y: str = "y", cut: float = 0.5) -> DataFrame:
    hit, real = F.col(p) >= cut, F.col(y) == 1
    n = scored.groupBy(*by).agg(F.count_if(hit & real).alias("tp"), F.count_if(hit & ~real).alias("fp"), F.count_if(~hit & real).alias("fn"), F.count_if(~hit & ~real).alias("tn"))
    precision, recall = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    return n.withColumns({"precision": precision, "recall": recall, "f1": 2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0))})


def bin_edges(bins: int) -> list[float]:
    """Equal bins as evenly spaced floats: i * (1 / bins), so the fourth of five edges is 0.6000000000000001."""
    return [i * (1.0 / bins) for i in range(bins)] + [1.0]


def bin_of(p: str, bins: int) -> Column:
    edges, at = bin_edges(bins), F.lit(bins)
    for i in range(bins - 1, 0, -1):
        at = F.when(F.col(p) < edges[i], i).otherwise(at)
    return at


def reliability(scored: DataFrame, by: Sequence[str], bins: int = 5, p: str = "prob", y: str = "y") -> DataFrame:
    """By bin of p: n, mean p, observed rate; empty bins are rows with n 0 and nulls; the last bin is closed; null p count nowhere."""
    full = scored.where(F.col(p).isNotNull()).groupBy(*by, bin_of(p, bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("observed"))
    spine = scored.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    return spine.join(full, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def ece(curve: DataFrame, by: Sequence[str]) -> DataFrame:
    gap = F.col("n") * F.abs(F.col("observed") - F.col("mean_p"))
    return curve.groupBy(*by).agg((F.sum(gap) / F.sum("n")).alias("ece"))


def summary(scored: DataFrame, by: Sequence[str], p: str = "prob", y: str = "y", bins: int = 5, pool: str | None = None) -> DataFrame:
    """n, rate, AUROC of p, Brier, ECE and log loss of each group; null group values are groups of their own.

    With pool, one of `by`, there are also rows over all its values: there it is null and `pooled` is true, so
    a group whose own value is null is told from the total. Both come from one reading of the rows: cases
    are counted by group and distinct p in one pass of grouping sets, and all figures follow from these counts,
    whose prefix sums spread a group of any size over all tasks. Null p count nowhere.
    """
    rows = scored.where(F.col(p).isNotNull()).select(*by, F.col(p).alias("_v"), F.col(y).alias("_y"))
    counts = (F.count_if(F.col("_y") == 1).alias("_p"), F.count_if(F.col("_y") == 0).alias("_n"))
    if pool is None:
        steps = rows.groupBy(*by, "_v").agg(*counts).withColumn("pooled", F.lit(False))
    else:
        sets = [[F.col(c) for c in [*by, "_v"]], [F.col(c) for c in [*(c for c in by if c != pool), "_v"]]]
        steps = rows.groupingSets(sets, *by, "_v").agg(*counts, (F.grouping(pool) == 1).alias("pooled"))
    keys = [*by, "pooled"]
    clipped = F.least(F.greatest(F.col("_v"), F.lit(1e-15)), F.lit(1 - 1e-15))
    parts = running(steps, keys, "_v", ["_n"]).withColumns({
        "_wins": F.col("_p") * (F.col("before__n") + F.col("_n") / 2), "_sq": F.col("_p") * F.pow(1 - F.col("_v"), 2) + F.col("_n") * F.pow("_v", 2),
        "_loss": F.col("_p") * F.log(clipped) + F.col("_n") * F.log(1 - clipped), "_sum": (F.col("_p") + F.col("_n")) * F.col("_v"), "_bin": bin_of("_v", bins),
    })
    sums = ("_wins", "_sq", "_loss", "_p", "_n")
    by_bin = parts.groupBy(*keys, "_bin").agg(*(F.sum(c).alias(c) for c in sums), F.abs(F.sum("_p") - F.sum("_sum")).alias("_gap"))
    out = by_bin.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in (*sums, "_gap")))
    n = F.col("_p") + F.col("_n")
    out = out.select(
        *keys, n.alias("n"), (F.col("_p") / n).alias("rate"), (F.col("_wins") / F.nullif(F.col("_p") * F.col("_n"), F.lit(0))).alias("auroc"), (F.col("_sq") / n).alias("brier"), (F.col("_gap") / n).alias("ece"), (-F.col("_loss") / n).alias("log_loss")
    )
    return out if pool else out.drop("pooled")


def comparators(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """AUROC of the score, Brier and log loss of the probability, for each group and model."""
    keys = [*by, "model"]
    area = wide_auroc(scored, keys).select(*keys, "auroc", "n")
    rest = scored.groupBy(*keys).agg(brier().alias("brier"), log_loss().alias("log_loss"), F.min("ord").alias("ord"))
    return area.join(rest, keys)


def strongest(metrics: DataFrame, by: Sequence[str], model: str = "model") -> DataFrame:
    """The comparator with the greatest AUROC; the first listed wins ties."""
    w = Window.partitionBy(*by).orderBy(F.desc("auroc"), "ord")
    return metrics.where(F.col("model") != model).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def gain(metrics: DataFrame, by: Sequence[str], model: str = "model") -> DataFrame:
    own = metrics.where(F.col("model") == model).select(*by, F.col("auroc").alias("model_auroc"), F.col("brier").alias("model_brier"), "n")
    best = strongest(metrics, by, model).select(*by, F.col("model").alias("best"), F.col("auroc").alias("best_auroc"), F.col("brier").alias("best_brier"))
    return own.join(best, list(by)).withColumns({"auroc_gain": F.col("model_auroc") - F.col("best_auroc"), "brier_delta": F.col("model_brier") - F.col("best_brier")})


# --- moving-block bootstrap


def block_starts(lengths: DataFrame, by: Sequence[str], reps: int, block: int, seed: str, size: str = "n", chunk: int = 250) -> DataFrame:
    """lengths(by, n[, size]) -> (by, n, drawn, rep, starts): the starts (from 0) of the drawn blocks of replicates rep, rep + 1, ...

    A replicate has ceil(size / block) blocks; a block's start is floor(u * (n - block + 1)), u from the md5
    of seed, group, replicate and block, so every engine draws the same. Rows hold `chunk` replicates and
    spread over tasks; series of fewer than two blocks have none.
    """
    rows = lengths.where(F.col("n") >= 2 * block).select(*by, F.col("n").cast("long").alias("n"), F.col(size).cast("long").alias("drawn"))
    rows = rows.withColumn("rep", F.explode(F.sequence(*(F.lit(v).cast("long") for v in (0, reps - 1, chunk)))))
    spread = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    rows = rows.repartition(int(spread), *by, "rep")
    last = F.least(F.col("rep") + chunk - 1, F.lit(reps - 1).cast("long"))

    def start(rep: Column, b: Column) -> Column:
        parts = [F.lit(seed), *(F.col(c).cast("string") for c in by), rep.cast("string"), b.cast("string")]
        u = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") / 4294967296.0
        return F.floor(u * (F.col("n") - block + 1))

    numbers = F.sequence(F.lit(0).cast("long"), (F.ceil(F.col("drawn") / block) - 1).cast("long"))
    return rows.withColumn("starts", F.transform(F.sequence("rep", last), lambda rep: F.transform(numbers, lambda b: start(rep, b))))


def _wins(weights: np.ndarray, score: np.ndarray, y: np.ndarray) -> np.ndarray:
    """AUROC of each row of weights: cases are ranked once, each replicate adds up its weights along that order; nan for one class."""
    order = np.argsort(score, kind="stable")
    firsts = np.flatnonzero(np.r_[True, np.diff(score[order]) != 0])
    along = weights[:, order]
    up, down = (np.add.reduceat(along * (y[order] == v), firsts, axis=1) for v in (1, 0))
    below = down.cumsum(1) - down
    pairs = up.sum(1) * down.sum(1)
    return np.divide((up * (below + down / 2)).sum(1), pairs, out=np.full(len(pairs), np.nan), where=pairs > 0)


def replicates(pairs: DataFrame, lengths: DataFrame, by: Sequence[str], drawn_by: Sequence[str], reps: int, block: int, seed: str, size: str = "n") -> DataFrame:
    """pairs(by, i, y, score, prob, base_score, base_prob) -> (by, size, rep, d_auroc, d_brier), d_auroc null for one class.

    lengths(drawn_by, n[, size]) says how much is drawn; groups of `by` that share drawn_by share their draws.
    A group's cases are one row, a series of some hundred weeks, ranked once for all its replicates; replicates
    are weights along that order, a matrix of a chunk of them a row.
    """
    fields = ("y", "score", "prob", "base_score", "base_prob")
    cases = pairs.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("i", *(F.col(f).cast("double").alias(f) for f in fields)))).alias("_x"))
    cases = cases.select(*by, *(F.col(f"_x.{f}").alias(f) for f in fields))
    more = [] if size == "n" else [size]
    starts = block_starts(lengths, [*drawn_by, *more], reps, block, seed, size)
    joined = cases.join(starts, list(drawn_by))
    keys = [*by, *more]
    joined = joined.select(*keys, "n", "drawn", "rep", "starts", *fields)
    kinds = ", ".join(f"{c} {joined.schema[c].dataType.simpleString()}" for c in keys)

    def run(batches):
        for b in batches:
            out = {c: [] for c in (*keys, "rep", "d_auroc", "d_brier")}
            for r in b.to_pylist():
                y, score, prob, base_score, base_prob = (np.array(r[f], float) for f in fields)
                n, drawn = len(y), np.array(r["starts"], np.int64)
                at = (drawn[:, :, None] + np.arange(block)).reshape(len(drawn), -1)[:, : r["drawn"]]
                flat = (at + n * np.arange(len(drawn))[:, None]).ravel()
                weights = np.bincount(flat, minlength=n * len(drawn)).reshape(len(drawn), n).astype(float)
                area = _wins(weights, score, y) - _wins(weights, base_score, y)
                error = weights @ ((prob - y) ** 2 - (base_prob - y) ** 2) / weights.sum(1)
                for c in keys:
                    out[c] += [r[c]] * len(drawn)
                out["rep"] += range(r["rep"], r["rep"] + len(drawn))
                out["d_auroc"] += [None if v != v else v for v in area.tolist()]
                out["d_brier"] += error.tolist()
            yield pa.RecordBatch.from_pydict(out, pa.schema([*(b.schema.field(c) for c in keys), ("rep", pa.int64()), ("d_auroc", pa.float64()), ("d_brier", pa.float64())]))

    return joined.mapInArrow(run, f"{kinds}, rep long, d_auroc double, d_brier double")


def block_bootstrap(pairs: DataFrame, by: Sequence[str], reps: int, block: int, seed: str, drawn_by: Sequence[str] | None = None) -> DataFrame:
    """pairs(by, i, y, score, prob, base_score, base_prob) -> (by, rep, d_auroc, d_brier); one-class replicates are dropped.

    Groups of `by` that share drawn_by (all of `by` unless given) are compared on the same draws; i counts from 1 without gaps.
    """
    drawn_by = list(drawn_by or by)
    lengths = pairs.groupBy(*drawn_by).agg(F.max("i").alias("n"))
    return replicates(pairs, lengths, by, drawn_by, reps, block, seed).where("d_auroc is not null")


def paired_ci(replicates: DataFrame, by: Sequence[str], least_valid: int, alpha: float = 0.05) -> DataFrame:
    """Percentile intervals of the paired differences; null with fewer than least_valid replicates."""
    at = F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))
    out = replicates.groupBy(*by).agg(F.count("*").alias("valid"), F.percentile("d_auroc", at).alias("_a"), F.percentile("d_brier", at).alias("_b"))
    ok = F.col("valid") >= least_valid
    return out.select(*by, "valid", *(F.when(ok, F.col(c)[i]).alias(n) for c, i, n in (("_a", 0, "auroc_lo"), ("_a", 1, "auroc_hi"), ("_b", 0, "brier_lo"), ("_b", 1, "brier_hi"))))


def sign(lo: str, hi: str) -> Column:
    return F.when(F.col(hi) < 0, "below").when(F.col(lo) > 0, "above").otherwise("crosses")


# --- verdicts


def verdict_v1(n: Column, positives: Column, auroc_: Column, best: Column, brier_delta: Column, lo: Column) -> Column:
    """Underpowered, then failure, then success, else neutral, in this order."""
    one_class = (positives == 0) | (positives == n)
    return (
        F.when((n < 10) | one_class, "neutral_inconclusive_underpowered")
        .when((auroc_ < best) | (auroc_ < 0.70), "failure")
        .when((auroc_ - best >= 0.02) & F.coalesce(lo > 0, F.lit(False)) & (brier_delta <= 0), "success")
        .otherwise("neutral")
    )


def verdict_v2(n: Column, integrity_ok: Column, lo: Column, hi: Column, delta: Column, ece_: Column, least: int = 150, most_ece: float = 0.25) -> Column:
    """Integrity failures override; then too few or uncomputable; then failure, success, neutral on the Brier difference."""
    return (
        F.when(~integrity_ok, "DATA-INTEGRITY FAILURE")
        .when((n < least) | lo.isNull(), "UNDERPOWERED")
        .when((lo > 0) | (ece_ > most_ece), "FAILURE")
        .when((delta < 0) & (hi < 0), "SUCCESS")
        .otherwise("NEUTRAL")
    )
