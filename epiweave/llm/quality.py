"""Quality classifier: Bradley-Terry ranking from preference pairs, cut at a score quantile (operator 8)."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_column, stage, table

_SPACES = [9, 10, 11, 12, 13, 32]


def features(text: bytes) -> np.ndarray:
    """What a score sees of a whole text: roots of the shares of its bytes, and shape measures; nothing else."""
    codes = np.frombuffer(text, np.uint8)
    count = np.bincount(codes, minlength=256).astype(float)
    n = max(1, len(codes))
    low, up, digit = count[97:123].sum(), count[65:91].sum(), count[48:58].sum()
    space, letters = count[_SPACES].sum(), count[65:91].sum() + count[97:123].sum() + count[128:].sum()
    lines = text.split(b"\n")
    words = text.split()
    shape = [
        np.log1p(n), np.log1p(letters / (space + 1)), up / max(1, up + low), digit / n, space / n, 1 - letters / n,
        len(set(lines)) / len(lines), np.log1p(n / len(lines)), len(set(words)) / max(1, len(words)), float(not words),
    ]
    return np.concatenate([np.sqrt(count / n), shape])


@dataclass(frozen=True)
class Ranker:
    """strength = weights . (features - centre) / scale; score = 1 / (1 + exp(-(a strength + b))); cut: the quantile."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    a: float
    b: float
    cut: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        strength = ((x - self.centre) / self.scale) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.a * strength + self.b, -40, 40)))


def bradley_terry(x: np.ndarray, better: np.ndarray, worse: np.ndarray, ridge: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Weights whose strengths give P(better beats worse) = logistic(difference): Newton steps on the pairs."""
    d = x[better] - x[worse]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -40, 40)))
        grad = d.T @ (1 - p) / len(d) - ridge * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(texts: list[bytes], quality: list[int], pairs: int = 40_000, seed: int = 7) -> Ranker:
    """Learns from preference pairs (any text of quality 1 over any of quality 0, drawn evenly)."""
    return fit_features(np.stack([features(t) for t in texts]), np.array(quality), pairs, seed)


def fit_features(x: np.ndarray, y: np.ndarray, pairs: int = 40_000, seed: int = 7) -> Ranker:
    """As `fit`, from the texts' features.

    Strengths become scores by a logistic map fitted on the same rows. cut is the quantile of the scores at
    the share of quality 0: halfway between the scores that it parts. With one class only, every score is
    that class's share.
    """
    centre, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranker(centre, scale, np.zeros(x.shape[1]), 0.0, 40.0 if len(good) else -40.0, 0.3)
    draw = np.random.default_rng(seed)
    z = (x - centre) / scale
    w = bradley_terry(z, draw.choice(good, pairs), draw.choice(bad, pairs))
    s = z @ w
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -40, 40)))
        v = np.maximum(p * (1 - p), 1e-9)
        g = np.array([(s * (y - p)).sum() - 1e-3 * a, (y - p).sum() - 1e-3 * b])
        h = np.array([[(v * s * s).sum() + 1e-3, (v * s).sum()], [(v * s).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    made = Ranker(centre, scale, w, float(a), float(b), 0.3)
    return Ranker(centre, scale, w, float(a), float(b), float(np.mean(np.sort(made.scores(x))[[len(bad) - 1, len(bad)]])))


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 8_000) -> Ranker:
    """Fits on at most most_rows labelled documents whose crc32(doc_id as text) mod 5 is not 0.

    The rows are those with the smallest hash of doc_id, so the sample is even and repeatable; rows with a
    null doc_id or quality, or a quality other than 0 and 1, teach nothing.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long"), F.col("quality").cast("int"))
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    known = stage(known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most_rows), "known")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(known), "doc_id")

    def run(batches):
        for b in batches:
            x = [features(t).astype("<f4").tobytes() for t in binary_column(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(x, pa.binary()), b.column("quality")], ["doc_id", "x", "quality"])

    # texts become features where they lie; only those are put in order
    seen = rows.select("doc_id", "text", "quality").mapInArrow(run, "doc_id long, x binary, quality int").orderBy("doc_id", "x", "quality").limit(2 * most_rows).collect()
    if not seen:
        return Ranker(np.zeros(1), np.ones(1), np.zeros(1), 0.0, 0.0, 0.3)
    return fit_features(np.stack([np.frombuffer(r["x"], "<f4") for r in seen]).astype(float), np.array([r["quality"] for r in seen]))


def score(docs: DataFrame, model: Ranker) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, held_out, score): one row for each row; null text counts as empty.

    held_out: crc32(doc_id as text) mod 5 is 0 (null doc_id: false). Repeated rows keep one row each; an
    empty table gives no rows; other columns are not read.
    """

    def run(batches):
        for b in batches:
            x = [features(t) for t in binary_column(b, "text")]
            s = model.scores(np.stack(x)[:, : len(model.weights)]) if x else np.zeros(0)
            held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i in b.column("doc_id").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(held, pa.bool_()), pa.array(s)], ["doc_id", "held_out", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, held_out boolean, score double")


def keep_good(docs: DataFrame, model: Ranker, quantile: float | None = None) -> DataFrame:
    """The rows of docs, with all columns, that score at least the cut.

    The cut is the model's quantile of its training scores, or that quantile of the corpus's own scores.
    Columns may have any other names; null text counts as empty.
    """
    names = docs.columns
    numbered = docs.toDF(*(f"c{i}" for i in range(len(names))))
    text = F.coalesce(F.col(f"c{names.index('text')}").cast("string"), F.lit(""))

    def run(texts):
        import pandas as pd

        for part in texts:
            yield pd.Series(model.scores(np.stack([features(t.encode()) for t in part])[:, : len(model.weights)])) if len(part) else pd.Series(dtype=float)

    scored = numbered.withColumn("score", F.pandas_udf(run, "double", F.PandasUDFType.SCALAR_ITER)(text))
    cut = model.cut if quantile is None else scored.select(F.percentile_approx("score", quantile, 10_000)).first()[0]
    return scored.where(F.col("score") >= F.lit(cut)).drop("score").toDF(*names)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
