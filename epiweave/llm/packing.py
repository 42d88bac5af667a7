"""Sequence packing as a cutting-stock problem solved by column generation (operator 9)."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import portions, stage, table
from .tokens import encoder, read_vocabulary

PIECES = "part int, rank long, doc_id long, start long, length int, doc_tokens long, ids binary"


def best_pattern(lengths: np.ndarray, values: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """Pricing: the unbounded knapsack of capacity `size`, by dynamic programming over the capacities."""
    best, last = np.zeros(size + 1), np.full(size + 1, -1)
    useful = np.flatnonzero(values > 1e-12)
    useful = useful[np.argsort(lengths[useful])]
    ls, vs = lengths[useful], values[useful]
    for cap in range(1, size + 1):
        n = np.searchsorted(ls, cap, "right")
        best[cap], last[cap] = best[cap - 1], -1
        if n:
            got = best[cap - ls[:n]] + vs[:n]
            k = int(got.argmax())
            if got[k] > best[cap]:
                best[cap], last[cap] = got[k], useful[k]
    counts, cap = np.zeros(len(lengths), np.int64), size
    while cap > 0:
        if last[cap] >= 0:
            counts[last[cap]] += 1
            cap -= lengths[last[cap]]
        else:
            cap -= 1
    return float(best[size]), counts


def column_generation(lengths: np.ndarray, demand: np.ndarray, size: int, most_rounds: int = 1500) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows: pieces of each length) and how often the linear program uses each.

    Minimises the number of sequences that cover the demand exactly: revised simplex from one pattern for
    each length, columns priced by `best_pattern`, until no pattern is worth more than one sequence or the
    bound total / size is reached. The work depends on the number of lengths, not of documents.
    """
    m = len(lengths)
    basis = np.diag(size // lengths).astype(float)
    inverse = np.diag(1.0 / np.diag(basis))
    use = inverse @ demand
    bound = float(lengths @ demand) / size
    for k in range(most_rounds):
        if use.sum() <= bound * (1 + 1e-7):
            break
        worth, pattern = best_pattern(lengths, np.ones(m) @ inverse, size)
        if worth <= 1 + 1e-9:
            break
        step = inverse @ pattern
        ok = step > 1e-9
        if not ok.any():
            break
        ratio = np.where(ok, use / np.where(ok, step, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = pattern
        use -= ratio[out] * step
        use[out] = ratio[out]
        inverse[out] /= step[out]
        for i in range(m):
            if i != out:
                inverse[i] -= step[i] * inverse[out]
        if k % 100 == 99:
            inverse = np.linalg.inv(basis)
            use = np.maximum(inverse @ demand, 0)
    return basis.T.round().astype(np.int64), np.maximum(use, 0)


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, dict[int, int]]]:
    """(how often, {length: pieces}) such that every piece of the histogram has one place; each fits `size`.

    The linear program's uses are rounded down; the few pieces left (less than one sequence for each
    pattern) are packed first-fit by decreasing length.
    """
    if not histogram:
        return []
    lengths = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[x] for x in lengths.tolist()], np.int64)
    patterns, use = column_generation(lengths, demand.astype(float), size)
    out, left = [], demand.copy()
    for p, x in zip(patterns, use, strict=True):
        n = min(int(np.floor(x + 1e-6)), *(int(left[c] // p[c]) for c in np.flatnonzero(p)))
        if n > 0:
            left -= n * p
            out.append((n, {int(lengths[c]): int(p[c]) for c in np.flatnonzero(p)}))
    bins: list[list] = []
    for c in range(len(lengths) - 1, -1, -1):
        n, w = int(left[c]), int(lengths[c])
        for b in bins:
            k = min(n, b[0] // w)
            if k:
                b[0] -= k * w
                b[1][w] = b[1].get(w, 0) + k
                n -= k
        while n:
            k = min(n, size // w)
            bins.append([size - k * w, {w: k}])
            n -= k
    return out + [(1, b[1]) for b in bins]


def cut_pieces(docs: DataFrame, vocabulary: str, end_id: int, size: int, grain: int, keeps_space: bool) -> DataFrame:
    """Tokenizes whole texts, adds end_id, and cuts each document into pieces whose lengths are few.

    Pieces of `size`, then the largest multiple of `grain`, then the rest (under `grain`). rank numbers the
    pieces of a length within their task.
    """
    blob = read_vocabulary(vocabulary)

    def run(batches):
        enc, part, ranks = encoder(blob, keeps_space, 300_000), TaskContext.get().partitionId(), {}
        names = [f.split()[0] for f in PIECES.split(", ")]

        for b in batches:
            for first, k in portions(b.column("text"), 2 << 20):
                ids, sizes = enc.encode(b.column("text").slice(first, k), end_id)
                raw, begin, rows = ids.tobytes(), 0, []
                for i, n in enumerate(sizes.tolist(), first):
                    cuts = list(range(0, n + 1, size))
                    rest = n - cuts[-1]
                    cuts += [cuts[-1] + x for x in sorted({rest - rest % grain, rest}) if x]
                    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                        rank = ranks[z - a] = ranks.get(z - a, -1) + 1
                        rows.append((part, rank, i, a, z - a, n, raw[4 * (begin + a) : 4 * (begin + z)]))
                    begin += n
                cols = list(zip(*rows, strict=True))
                cols[2] = b.column("doc_id").take(pa.array(cols[2], pa.int64()))
                kinds = [pa.int32(), pa.int64(), None, pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([c if t is None else pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def pack(docs: DataFrame, vocabulary: str, end_id: int, size: int = 2048, grain: int = 32, keeps_space: bool = False) -> DataFrame:
    """docs(doc_id, text) -> one row a piece: doc_id, start, length, doc_tokens, ids, sequence_id, offset.

    Every token of every document lies in one piece; the pieces of a sequence fill it from 0 without gaps.
    Null text counts as empty (one piece with end_id alone); repeated doc_ids are packed as separate
    documents; null doc_ids are kept; an empty table gives no rows; other columns are not read.

    The histogram of lengths (at most size / grain + grain numbers) is all that reaches the driver, where
    `plan` solves the cutting-stock problem. A piece's rank among those of its length follows from its rank
    within its task and the counts of the tasks before it, and the rank gives its sequence and offset: no
    shuffle of tokens, and no group in one task.
    """
    spark = docs.sparkSession
    pieces = stage(cut_pieces(docs, vocabulary, end_id, size, grain, keeps_space), "pieces")
    counts = stage(pieces.groupBy("length", "part").agg((F.max("rank") + 1).alias("n")), "counts")
    w = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = stage(counts.select("length", "part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before")), "before")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    slots, taken, sequence = [], dict.fromkeys(histogram, 0), 0
    for n, pattern in plan(histogram, size):
        at = 0
        for length in sorted(pattern, reverse=True):
            k = pattern[length]
            slots.append((length, taken[length], taken[length] + n * k, k, sequence, at))
            taken[length] += n * k
            at += k * length
        sequence += n
    slots = spark.createDataFrame(slots, "length int, low long, high long, each long, first long, at long")
    rank = F.col("rank") + F.col("before")
    placed = (
        pieces.join(before, ["length", "part"])
        .withColumn("nth", rank)
        .join(F.broadcast(slots), "length")
        .where("nth >= low and nth < high")
        .withColumns({"sequence_id": F.expr("first + (nth - low) div each"), "offset": F.expr("at + (nth - low) % each * length")})
    )
    return placed.select("doc_id", "start", F.col("length").cast("long"), "doc_tokens", "ids", "sequence_id", F.col("offset").cast("long"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids binary, n_tokens): the packed pieces joined; a sequence has at most `size` tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("n_tokens"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
