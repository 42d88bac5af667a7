"""Embedding near-duplicates by a pivot-permutation index (operator 2)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sorted_runs, split_hot, stage, table, unstage
from .components import components

#: Bytes of reference points that may travel with the tasks, and how many points at most.
PIVOT_BYTES, PIVOTS = 64 << 20, 32_768


def pivot_count(n: int, dim: int) -> int:
    """Reference points for n vectors: four times their root, as a power of two, so that lists grow with the root only."""
    most = 2 ** int(np.log2(max(2, min(PIVOTS, PIVOT_BYTES // (8 * max(1, dim))))))
    return int(min(most, max(256, 2 ** np.ceil(np.log2(4 * max(1.0, n**0.5))))))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spread_points(sample: np.ndarray, most: int, apart: float = 0.7) -> np.ndarray:
    """Up to `most` points of the sample of which no two have a cosine of `apart` or more: a dense group gives one."""
    points = np.zeros((most, sample.shape[1]))
    n = 0
    for x in sample:
        if n == most:
            break
        if not n or (points[:n] @ x).max() < apart:
            points[n] = x
            n += 1
    return points[:n]


class References:
    """Reference points of vectors of one dimension, and how many of the nearest two similar vectors share.

    Vectors are described relative to the sample's mean, so the points tell vectors apart that all lie in one
    direction. `apart` is raised until the sample gives half the points wanted. Pairs at cosine `least`, drawn
    around the sample's vectors along its own differences, say how many of the `prefix` nearest points such
    pairs share (`lost` of them share fewer); where that is under two points, more of the nearest are taken.
    """

    def __init__(self, sample: np.ndarray, most: int, least: float, lost: float = 0.015, prefixes: tuple[int, ...] = (16, 32, 64)):
        self.centre = sample.mean(0)
        relative = sample - self.centre
        relative = relative[np.linalg.norm(relative, axis=1) > 1e-9]
        if not len(relative):  # all alike
            self.centre, relative = np.zeros(sample.shape[1]), sample
        relative = _unit(relative)
        for apart in (0.7, 0.85, 0.93, 0.97):
            self.points = spread_points(relative, most, apart)
            if len(self.points) >= min(most, len(sample)) // 2:
                break
        d = np.random.default_rng(0)
        x, other = sample[: min(len(sample), 1000)], sample[d.permutation(len(sample))[:1000]]
        off = other - x * (other * x).sum(1, keepdims=True)
        far = np.linalg.norm(off, axis=1) > 1e-9
        x, off = x[far], off[far]
        off = off / np.linalg.norm(off, axis=1, keepdims=True)
        y = least * x + np.sqrt(max(0.0, 1 - least * least)) * off
        some = sample[:1000]
        own = np.argwhere(np.triu(some @ some.T >= least, 1))
        own = own[d.permutation(len(own))[:20_000]]
        for self.prefix in prefixes:
            self.shared = 1
            if len(x):
                a, b = (self._held(v) for v in (x, y))
                self.shared = max(1, int(np.quantile((a & b).sum(1), lost)))
            if len(own) >= 200:
                held = self._held(some)
                self.shared = min(self.shared, max(1, int(np.quantile((held[own[:, 0]] & held[own[:, 1]]).sum(1), lost))))
            if self.shared > 1:
                break

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The numbers of the nearest points of unit vectors, ascending."""
        near = (x - self.centre) @ self.points.T
        k = min(self.prefix, near.shape[1])
        return np.sort(np.argpartition(-near, k - 1, axis=1)[:, :k], axis=1).astype("<u2")

    def _held(self, x: np.ndarray) -> np.ndarray:
        held = np.zeros((len(x), len(self.points)), bool)
        np.put_along_axis(held, self.nearest(x).astype(np.int64), True, 1)
        return held


def keyed(vectors: DataFrame) -> DataFrame:
    """(vec_id, lab, k, v): v the components as little-endian doubles and k their 128-bit hash, null where a vector links with nothing."""

    def run(batches):
        for b in batches:
            keys, vs = [], []
            for x, has in zip(b.column("embedding").to_pylist(), b.column("lab").is_valid().to_pylist(), strict=True):
                v = np.array([np.nan if c is None else c for c in x]) + 0.0 if x and has else None  # + 0.0: one zero
                good = v is not None and np.isfinite(v).all() and v.any()
                vs.append(v.astype("<f8").tobytes() if good else None)
                keys.append(xxhash.xxh3_128_digest(vs[-1]) if good else None)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("lab"), pa.array(keys, pa.binary()), pa.array(vs, pa.binary())], ["vec_id", "lab", "k", "v"])

    real = dict(vectors.dtypes)["label"] in ("float", "double")
    lab = (F.col("label") + F.lit(0.0) if real else F.col("label")).cast("string")
    rows = vectors.select(F.col("vec_id").cast("long"), lab.alias("lab"), F.col("embedding").cast("array<double>"))
    return rows.mapInArrow(run, "vec_id long, lab string, k binary, v binary")


def described(classes: DataFrame, points: dict[int, References]) -> DataFrame:
    """(cid, lab, v) -> (cid, lab, dim, tops): the numbers of the nearest reference points, ascending."""

    def run(batches):
        for b in batches:
            raw = b.column("v").to_pylist()
            tops, size = [b""] * len(raw), np.array([len(x) // 8 for x in raw], np.int32)
            for dim in np.unique(size).tolist():
                at = np.flatnonzero(size == dim)
                if dim in points:
                    near = points[dim].nearest(_unit(np.frombuffer(b"".join([raw[i] for i in at]), "<f8").reshape(-1, dim)))
                else:  # a dimension without reference points is one list
                    near = np.zeros((len(at), 1), "<u2")
                for i, t in zip(at.tolist(), near, strict=True):
                    tops[i] = t.tobytes()
            yield pa.RecordBatch.from_arrays([b.column("cid"), b.column("lab"), pa.array(size), pa.array(tops, pa.binary())], ["cid", "lab", "dim", "tops"])

    return classes.select("cid", "lab", "v").mapInArrow(run, "cid long, lab string, dim int, tops binary")


def inverted(index: DataFrame, shared: dict[int, int]) -> DataFrame:
    """(lab, dim, pivot, cid, tops): a vector's entries in the inverted lists of its reference points.

    Two vectors that share `shared` (by dimension) of their points meet in the list of the smallest one they
    share, which is among the first m - shared + 1 of the m points of each; the other points need no entry.
    """

    def run(batches):
        for b in batches:
            tops = [np.frombuffer(t, "<u2") for t in b.column("tops").to_pylist()]
            keep = [t[: max(1, len(t) - shared.get(d, 1) + 1)] for t, d in zip(tops, b.column("dim").to_pylist(), strict=True)]
            owner = pa.array(np.repeat(np.arange(len(keep)), [len(t) for t in keep]))
            pivot = pa.array(np.concatenate(keep).astype(np.int32) if keep else [], pa.int32())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(owner) for c in ("lab", "dim")), pivot, *(b.column(c).take(owner) for c in ("cid", "tops"))], ["lab", "dim", "pivot", "cid", "tops"])

    return index.select("lab", "dim", "cid", "tops").mapInArrow(run, "lab string, dim int, pivot int, cid long, tops binary")


CELL = ("lab", "dim", "pivot", "cell_i", "cell_j")


def candidates(tops: list[bytes], chunk: np.ndarray, pivot: int, cross: bool, shared: int):
    """Blocks (i, j) of pairs of one list that share at least `shared` points, none of them below `pivot`; each pair twice."""
    t = np.frombuffer(b"".join(tops), "<u2").reshape(len(tops), -1)
    need = min(shared, t.shape[1])
    values, code, count = np.unique(t, return_inverse=True, return_counts=True)
    place = np.cumsum(count > 1) - 1  # points of a single member can't be shared
    code = code.reshape(t.shape)
    row, col = np.nonzero(count[code] > 1)
    has = np.zeros((len(t), int((count > 1).sum())), np.float32)
    has[row, place[code[row, col]]] = 1
    below = int(np.searchsorted(values[count > 1], pivot))
    for i in range(0, len(t), 512):
        q = slice(i, min(i + 512, len(t)))
        ok = has[q] @ has.T >= need
        ok[np.arange(q.stop - i), np.arange(i, q.stop)] = False
        if cross:
            ok &= chunk[q, None] != chunk[None, :]
        if below and ok.any():
            ok &= (has[q, :below] @ has[:, :below].T) == 0
        a, b = np.nonzero(ok)
        yield a + i, b


def survivors(lists: DataFrame, shared: dict[int, int], most: int) -> DataFrame:
    """The entries (CELL, cid, chunk) of the lists that have a candidate there: only their vectors are fetched."""
    cells = split_hot(lists, ["lab", "dim", "pivot"], "cid", most)

    def run(batches):
        for cols, at in sorted_runs(batches, list(CELL)):
            chunk, pivot, ci, cj, dim = (cols[c].to_numpy() for c in ("chunk", "pivot", "cell_i", "cell_j", "dim"))
            keep = []
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if hi - lo > 1:
                    hit = np.zeros(hi - lo, bool)
                    for i, _ in candidates(cols["tops"].slice(lo, hi - lo).to_pylist(), chunk[lo:hi], int(pivot[lo]), ci[lo] != cj[lo], shared.get(int(dim[lo]), 1)):
                        hit[i] = True
                    keep.append(lo + np.flatnonzero(hit))
            if keep:
                kept = pa.array(np.concatenate(keep))
                names = [*CELL, "cid", "chunk"]
                yield pa.RecordBatch.from_arrays([cols[c].take(kept) for c in names], names)

    kinds = "lab string, dim int, pivot int, cell_i int, cell_j int, cid long, chunk int"
    return cells.repartition(*CELL).sortWithinPartitions(*CELL).mapInArrow(run, kinds)


def verified(entries: DataFrame, index: DataFrame, classes: DataFrame, least: float, shared: dict[int, int]) -> DataFrame:
    """Rows (kind, a, b): kind 0 adds b links to class a; kind 1 is an edge of a spanning forest of the links.

    The candidates of each list are verified by their cosine in double precision; a pair is a candidate in
    one list only, so each link counts once.
    """

    def run(batches):
        for cols, at in sorted_runs(batches, list(CELL)):
            chunk, pivot, ci, cj, dim, cids, copies = (cols[c].to_numpy() for c in ("chunk", "pivot", "cell_i", "cell_j", "dim", "cid", "copies"))
            kinds, a, b = [], [], []
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                n = hi - lo
                x = _unit(np.frombuffer(b"".join(cols["v"].slice(lo, n).to_pylist()), "<f8").reshape(n, -1))
                links, root, cid = np.zeros(n, np.int64), np.arange(n), cids[lo:hi]
                for i, j in candidates(cols["tops"].slice(lo, n).to_pylist(), chunk[lo:hi], int(pivot[lo]), ci[lo] != cj[lo], shared.get(int(dim[lo]), 1)):
                    for k in range(0, len(i), 100_000):
                        p, q = i[k : k + 100_000], j[k : k + 100_000]
                        ok = np.einsum("ij,ij->i", x[p], x[q]) >= least
                        p, q = p[ok], q[ok]
                        np.add.at(links, p, copies[lo:hi][q])
                        while len(p):  # the least root spreads over the links
                            was = root.copy()
                            np.minimum.at(root, p, root[q])
                            np.minimum.at(root, q, root[p])
                            np.minimum.at(root, was, root)
                            root = root[root]
                            if (root == was).all():
                                break
                own = np.flatnonzero(links)
                kinds.append(np.zeros(len(own), np.int64)), a.append(cid[own]), b.append(links[own])
                own = np.flatnonzero(root != np.arange(n))
                kinds.append(np.ones(len(own), np.int64)), a.append(cid[own]), b.append(cid[root[own]])
            if kinds:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in (kinds, a, b)], ["kind", "a", "b"])

    full = entries.join(index.select("cid", "tops"), "cid").join(classes.select("cid", "copies", "v"), "cid")
    return full.repartition(*CELL).sortWithinPartitions(*CELL).mapInArrow(run, "kind long, a long, b long")


def near_vectors(vectors: DataFrame, least: float = 0.93, most: int = 2048) -> DataFrame:
    """vectors(vec_id, embedding, label) -> (vec_id, n_links, component_id, kept).

    Vectors link if their labels are equal and not null (compared as they are, of any type) and their cosine
    is at least `least`; those that are null, empty, zero, or hold null or non-finite components link with
    nothing, nor do vectors of different lengths. Equal vectors of a label collapse to one class with a count
    before the index is built, so copies link without being expanded. Repeated vec_ids stay separate rows; a
    null vec_id names no component that has others. An empty table gives an empty result; other columns are
    not read.

    The reference points come from a bounded sample (`pivot_count`, `References`); every class is described by
    its nearest ones. Inverted lists of ids find the pairs that share enough of them, by a number that the
    sample gives; only then are vectors fetched, and only those pairs verified.
    """
    full = stage(keyed(vectors), "vectors")
    rows = stage(full.select("vec_id", "lab", "k"), "rows")
    classes = full.where("k is not null").groupBy("lab", "k").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first_id"), F.first("v").alias("v"))
    classes = stage(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    unstage(full)
    sizes = {r[0]: r[1] for r in classes.groupBy((F.length("v") / 8).cast("int")).count().orderBy(F.desc("count")).limit(8).collect()}
    points = {}
    for dim, n in sizes.items():
        most_points = pivot_count(n, dim)
        drawn = classes.where(F.length("v") == 8 * dim).orderBy(F.xxhash64("k"), "cid").limit(2 * most_points).select("v").collect()
        points[dim] = References(_unit(np.stack([np.frombuffer(r[0], "<f8") for r in drawn])), most_points, least)
    shared = {dim: p.shared for dim, p in points.items()}
    index = stage(described(classes, points), "index")
    entries = stage(survivors(inverted(index, shared), shared, most), "entries")
    found = stage(verified(entries, index, classes, least, shared), "found")
    unstage(index, entries)
    links = found.where("kind = 0").groupBy(F.col("a").alias("cid")).agg(F.sum("b").alias("links"))
    comp = stage(components(found.where("kind = 1").select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("node").alias("cid"), "comp"), "comp")
    facts = classes.select("cid", "lab", "k", "copies", "first_id")
    low = comp.join(facts, "cid").groupBy("comp").agg(F.min("first_id").alias("low"))
    named = comp.join(low, "comp").select("cid", "low")
    facts = facts.join(links, "cid", "left").join(named, "cid", "left").select(
        "lab", "k", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("low", "first_id").alias("component_id")
    )
    out = rows.join(stage(facts, "facts"), ["lab", "k"], "left")
    comp_id = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"), F.coalesce(F.col("vec_id") == comp_id, F.lit(True)).alias("kept"))


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
