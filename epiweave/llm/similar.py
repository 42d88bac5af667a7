"""Groups of documents of five-word shingle similarity 0.8 or more: SimHash anchors, completed by an exact search (operator 5 in the pipeline).

The anchors of `simhash` guarantee the pairs within 3 bits, but no Hamming radius holds every pair of a
given Jaccard similarity. Prefixes of the shingle sets hold every such pair, so they complete the anchors'
candidates; the exact similarity of the sets decides on all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary_column, bounded, portions, sorted_runs, spanning, stage, unstage
from .components import forest_components
from .simhash import SEED, fingerprint, near_links, shingle_hashes

#: The key of a shingle set: two longs.
_KEY = ("k0", "k1")
#: Documents drawn to see which shingles are common, and how many common shingles are held at most.
DRAWN, COMMON = 4_000, 65_536
#: Rows of ids (24 bytes each) that a join may broadcast.
FEW = 200_000

Near = Callable[[int, np.ndarray], np.ndarray]


def text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def distinct_shingles(text: bytes, width: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, width))


def set_key(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits of an ascending shingle set, as two signed longs: equal sets are copies."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(np.ascontiguousarray(hashes).astype("<u8", copy=False)), "<i8").tolist())


def sketch(hashes: np.ndarray) -> bytes:
    """How many shingles fall in each of 128 or more classes of equal hash ranges, about 8 to a class; 255 stands for any number from there.

    Two sets share at most the sum of the lesser counts. Sets that share little have about 0.6 to 0.8 of the
    smaller one's size as that sum, so most of them are told from sets of similarity 0.8, which need 0.89.
    """
    bits = max(7, int(np.ceil(np.log2(max(1, len(hashes)) / 8))))
    return np.minimum(np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


class Sketches:
    """The sketches of a group; near(i, js) tells which of js may have a similarity of `least` with i."""

    def __init__(self, data: list[bytes], n: np.ndarray, least: float):
        self.n, self.least = n.astype(np.int64), least
        self.size = np.fromiter(map(len, data), np.int64, len(data))
        self.full = np.fromiter((255 in x for x in data), bool, len(data))
        self.levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for level in np.unique(self.size).tolist():  # sizes that can be similar are of one level or of neighbours
            at = np.flatnonzero((self.size == level) | (self.size == 2 * level))
            table = np.stack([np.frombuffer(data[i], np.uint8).reshape(level, -1).sum(1, dtype=np.uint16) for i in at.tolist()])
            row = np.zeros(len(data), np.int64)
            row[at] = np.arange(len(at))
            self.levels[level] = table, row

    def near(self, i: int, js: np.ndarray) -> np.ndarray:
        need = self.least * (self.n[i] + self.n[js])
        ok = np.minimum(self.n[i], self.n[js]) * (1 + self.least) + 1e-9 >= need
        level = np.minimum(self.size[i], self.size[js])
        for low in np.unique(level[ok]).tolist():
            pick = np.flatnonzero(ok & (level == low))
            table, row = self.levels[low]
            shared = np.minimum(table[row[js[pick]]], table[row[i]]).sum(1, dtype=np.int64)
            ok[pick] = (shared * (1 + self.least) + 1e-9 >= need[pick]) | self.full[i] | self.full[js[pick]]
        return ok


def sketches_near(data: list[bytes], n: np.ndarray, least: float) -> Near:
    return Sketches(data, n, least).near


def common_shingles(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of three or more of some DRAWN drawn documents: ascending hashes, and each one's place from rare to common.

    They only steer the order in `prefix`, of which any gives the same links; the driver sees at most COMMON.
    """

    def run(batches):
        for b in small(batches):
            held = [distinct_shingles(x, width) for x in binary_column(b, "text")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64) if held else [], pa.int64())], ["shingle"])

    share = min(1.0, DRAWN / max(docs.count(), 1))
    found = docs.select(F.col("text").cast("string")).sample(share, SEED).mapInArrow(run, "shingle long").groupBy("shingle").count()
    rows = found.where("count >= 3").orderBy(F.desc("count"), "shingle").limit(COMMON).collect()
    hashes = np.array([r["shingle"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], (len(hashes) - 1 - np.arange(len(hashes)))[order]


def prefix(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray], least: float) -> np.ndarray:
    """The first n - ceil(least n) + 1 of n shingles, in one order for all sets: by hash, the common ones last.

    Sets of similarity `least` share at least ceil(least n) shingles, for the n of either one, so the first
    shingle that they share stands in both prefixes. No pair is lost.
    """
    known, place = common
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        is_common = known[at] == hashes
        hashes = np.concatenate([hashes[~is_common], hashes[is_common][np.argsort(place[at[is_common]])]])
    return hashes[: len(hashes) - int(np.ceil(least * len(hashes) - 1e-6)) + 1]


def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut into portions of about 4 MB of text, so that what is made of them stays small."""
    for b in batches:
        for at, k in portions(b.column("text")):
            yield b.slice(at, k)


PRINT = "doc_id long, th long, k0 long, k1 long, n int, fp long, sketch binary, prefix array<bigint>"


def described(docs: DataFrame, width: int, least: float) -> DataFrame:
    """docs(doc_id, text) -> PRINT: what the search needs to know of each row; th is the text's hash."""
    common = common_shingles(docs, width)

    def run(batches):
        for b in small(batches):
            hashes = [shingle_hashes(x, width) for x in binary_column(b, "text")]
            made = [np.unique(h) for h in hashes]
            keys = np.array([set_key(h) for h in made], np.int64).reshape(-1, 2)
            first = [prefix(h, common, least).view(np.int64) for h in made]
            at = pa.array(np.cumsum([0, *map(len, first)]), pa.int32())
            held = pa.ListArray.from_arrays(at, pa.array(np.concatenate(first) if first else [], pa.int64()))
            own = [pa.array(map(len, made), pa.int32()), pa.array(map(fingerprint, hashes), pa.int64()), pa.array(map(sketch, made), pa.binary()), held]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(keys[:, 0]), pa.array(keys[:, 1]), *own], [f.split()[0] for f in PRINT.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), text_hash().alias("th"), F.col("text").cast("string")).mapInArrow(run, PRINT)


def anchor_links(classes: DataFrame) -> DataFrame:
    """classes(cid, fp) -> candidates (src, dst): classes of one fingerprint, and of fingerprints that meet at an anchor within 3 bits."""
    classes = classes.select("cid", "fp")
    prints = stage(classes.groupBy("fp").agg(F.min("cid").alias("first")), "anchored")
    same = classes.join(prints, "fp").where("cid <> first").select(F.col("first").alias("src"), F.col("cid").alias("dst"))
    near = near_links(prints).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    ends = [prints.select(F.col("fp").alias(end), F.col("first").alias(name)) for end, name in (("a", "src"), ("b", "dst"))]
    return same.union(near.join(ends[0], "a").join(ends[1], "b").select("src", "dst"))


def prefix_links(classes: DataFrame, least: float, most: int = 4096) -> DataFrame:
    """Shingle sets (cid, n, prefix) -> (kind, a, b, rest, n): what proposes all pairs of similarity `least`.

    Sets that share a shingle of their prefixes are a candidate unless those that follow it are too few: at
    the first shared shingle, positions i and j, at most min(n_a - i, n_b - j) are shared. A shingle of up to
    8 sets yields its pairs (kind 0: a < b). One of more yields its entries (kind 1: shingle a, set b, rest
    n - i), which `group_links` holds against each other by their sketches. One of over `most` sets, which is
    rare as common shingles come last, yields a star (kind 2: a, b), whose tree is searched whole.
    """
    rows = classes.select("cid", "n", F.posexplode("prefix").alias("i", "shingle")).select("shingle", "cid", "n", (F.col("n") - F.col("i")).alias("rest"))
    hot = stage(rows.groupBy("shingle").agg(F.count("*").alias("sets"), F.min("cid").alias("first")).where(F.col("sets") > most).select("shingle", "first"), "hot")
    star = None
    if not hot.isEmpty():
        marked = rows.join(bounded(hot, 10_000), "shingle", "left")
        star = marked.where("first is not null and first <> cid").select(F.lit(2).alias("kind"), F.col("first").alias("a"), F.col("cid").alias("b"), F.lit(0).alias("rest"), "n")
        rows = marked.where("first is null").drop("first")

    def run(batches):
        for cols, at in sorted_runs(batches, ["shingle"]):
            cid, n, rest = (cols[c].to_numpy() for c in ("cid", "n", "rest"))
            size = np.diff(at)
            owner = np.repeat(np.arange(len(size)), size)
            small = size[owner] <= 8
            near = []
            for k in range(1, min(8, len(cid))):
                i = np.flatnonzero(small[:-k] & (owner[k:] == owner[:-k]))
                if not len(i):
                    break
                i = i[_enough(rest, n, i, i + k, least)]
                near.append(np.stack([cid[i], cid[i + k]], 1))
            pair = np.unique(np.sort(np.concatenate(near), axis=1), axis=0) if near else np.zeros((0, 2), np.int64)
            many = np.flatnonzero(~small)
            zero = np.zeros(len(pair), np.int32)
            made = [
                (np.concatenate([zero, np.ones(len(many), np.int32)])), np.concatenate([pair[:, 0], cols["shingle"].to_numpy()[many]]), np.concatenate([pair[:, 1], cid[many]]),
                np.concatenate([zero, rest[many]]), np.concatenate([zero, n[many]]),
            ]
            if len(made[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in made], ["kind", "a", "b", "rest", "n"])

    found = rows.repartition("shingle").sortWithinPartitions("shingle", "cid").mapInArrow(run, "kind int, a long, b long, rest int, n int")
    return found if star is None else found.union(star)


def _enough(rest: np.ndarray, n: np.ndarray, i, j, least: float) -> np.ndarray:
    return np.minimum(rest[i], rest[j]) * (1 + least) + 1e-9 >= least * (n[i].astype(np.int64) + n[j])


def group_links(entries: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Entries (shingle, cid, rest, n) of shingles of many sets -> links (src, dst): a spanning forest, for each shingle, of the sets that may be similar.

    A pair of similarity `least` passes the test at the first shingle it shares, so it lies in one tree of all
    links; as sketches rule out most others, these trees are hardly larger than the groups that are sought.
    """

    def run(batches):
        for cols, at in sorted_runs(batches, ["shingle"]):
            cid, n, rest = (cols[c].to_numpy() for c in ("cid", "n", "rest"))
            src, dst = [], []
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                held = Sketches(cols["sketch"].slice(lo, hi - lo).to_pylist(), n[lo:hi], least)

                def near(i, js, held=held, lo=lo, n=n, rest=rest):
                    ok = _enough(rest, n, lo + i, lo + js, least)
                    ok[ok] = held.near(i, js[ok])
                    return ok

                for i, j in spanning(hi - lo, near):
                    src.append(cid[lo + i])
                    dst.append(cid[lo + j])
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    full = entries.join(classes.select("cid", "sketch"), "cid")
    return full.repartition("shingle").sortWithinPartitions("shingle", "cid").mapInArrow(run, "src long, dst long")


def possible(links: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The links (src, dst) whose sketches do not rule out a similarity of `least`: no true link goes."""
    a, b = (classes.select(F.col("cid").alias(end), F.col("n").alias(f"n_{end}"), F.col("sketch").alias(f"s_{end}")) for end in ("src", "dst"))

    def run(batches):
        for t in batches:
            size = np.stack([t.column("n_src").to_numpy(), t.column("n_dst").to_numpy()], 1)
            both = zip(t.column("s_src").to_pylist(), t.column("s_dst").to_pylist(), strict=True)
            ok = [k for k, pair in enumerate(both) if Sketches(list(pair), size[k], least).near(0, np.array([1]))[0]]
            yield pa.RecordBatch.from_arrays([t.column(c).take(pa.array(ok, pa.int64())) for c in ("src", "dst")], ["src", "dst"])

    return links.join(a, "src").join(b, "dst").mapInArrow(run, "src long, dst long")


def shingle_sets(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """docs(doc_id, text), members(cid, doc_id, th) -> (cid, n, data): the sets, as ascending little-endian longs.

    Rows with the same doc_id and text give the same set. A task gives each cid once; one that several tasks
    give has the same set in each, which changes no link.
    """

    def run(batches):
        seen: set[int] = set()
        for b in small(batches):
            cids, texts, out = b.column("cid").to_pylist(), binary_column(b, "text"), []
            for cid, text in zip(cids, texts, strict=True):
                if cid not in seen:
                    seen.add(cid)
                    out.append((cid, distinct_shingles(text, width)))
            cols = [pa.array([c for c, _ in out], pa.int64()), pa.array([len(h) for _, h in out], pa.int32()), pa.array([h.astype("<u8").tobytes() for _, h in out], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["cid", "n", "data"])

    texts = docs.select(F.col("doc_id").cast("long").alias("own"), text_hash().alias("th"), F.col("text").cast("string"))
    wanted = bounded(members.select("cid", "doc_id", F.col("th").alias("want")), FEW)
    found = texts.join(wanted, F.col("own").eqNullSafe(F.col("doc_id")) & (F.col("th") == F.col("want"))).select("cid", "text")
    return found.mapInArrow(run, "cid long, n int, data binary")


def verified(links: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The links (src, dst) whose shingle sets have a Jaccard similarity of `least` or more; two empty sets have 1."""
    a, b = (sets.select(F.col("cid").alias(end), F.col("data").alias(f"d_{end}")) for end in ("src", "dst"))

    def run(batches):
        for t in batches:
            ok = []
            for i, (x, y) in enumerate(zip(*(t.column(c).to_pylist() for c in ("d_src", "d_dst")), strict=True)):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                if len(np.intersect1d(x, y, assume_unique=True)) * (1 + least) + 1e-9 >= least * (len(x) + len(y)):
                    ok.append(i)
            yield pa.RecordBatch.from_arrays([t.column(c).take(pa.array(ok, pa.int64())) for c in ("src", "dst")], ["src", "dst"])

    return links.join(a, "src").join(b, "dst").mapInArrow(run, "src long, dst long")


def sets_near(data: list[bytes], n: np.ndarray, least: float) -> Near:
    ids = np.unique(np.frombuffer(b"".join(data), "<u8"), return_inverse=True)[1]
    start = np.append(0, np.cumsum(n))
    mark = np.zeros(len(ids) + 1, np.int32)

    def near(i: int, js: np.ndarray) -> np.ndarray:
        own = ids[start[i] : start[i + 1]]
        mark[own] = 1
        upto = np.append(0, np.cumsum(mark[ids]))
        mark[own] = 0
        return (upto[start[js + 1]] - upto[start[js]]) * (1 + least) + 1e-9 >= least * (n[i] + n[js])

    return near


def tree_links(trees: DataFrame, payload: DataFrame, measure: Callable[[list[bytes], np.ndarray, float], Near], least: float, most: int, weigh: Column | None = None) -> DataFrame:
    """trees(node, comp), payload(cid, n, data) -> links (src, dst) that span the near pairs of each tree, as `measure` tells them.

    A tree of up to `most` (the sum of weigh) is one cell, in which a member leaves the search only by a link
    and each that left is held against all that are still in it. A larger tree is dealt out by chunks, each
    with the tree's smallest member; what these cells do not connect with that member (rest) meets every
    chunk in further cells. So a tree of near copies is shipped about twice, and no task holds more than two chunks.
    """
    rows = trees.select("comp", F.col("node").alias("cid")).join(payload.select("cid", "n", "data"), "cid")
    rows = rows.withColumn("w", F.lit(1) if weigh is None else weigh)
    large = rows.groupBy("comp").agg(F.sum("w").alias("w")).where(F.col("w") > most)
    large = stage(large.select("comp", F.ceil(F.col("w") / most).cast("int").alias("chunks")), "large")
    keys = ["comp", "a", "b"]

    def run(batches):
        for cols, at in sorted_runs(batches, [*keys]):
            cid, n, data = cols["cid"].to_numpy(), cols["n"].to_numpy().astype(np.int64), cols["data"]
            src, dst = [], []
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if hi - lo > 1:
                    near = measure(data.slice(lo, hi - lo).to_pylist(), n[lo:hi], least)
                    for i, j in spanning(hi - lo, near):
                        src.append(cid[lo + i])
                        dst.append(cid[lo + j])
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    def searched(cells: DataFrame) -> DataFrame:
        return cells.select(*keys, "cid", "n", "data").repartition(*keys).sortWithinPartitions(*keys, "cid").mapInArrow(run, "src long, dst long")

    if large.isEmpty():
        return searched(rows.withColumns({"a": F.lit(0), "b": F.lit(0)}))
    chunk = F.pmod(F.xxhash64("cid"), F.coalesce("chunks", F.lit(1)).cast("bigint")).cast("int")
    dealt = rows.join(bounded(large, 10_000), "comp", "left").withColumn("a", chunk).withColumn("b", F.lit(0))
    hubs = dealt.where("cid = comp and chunks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).where("other <> a")
    first = stage(searched(dealt.unionByName(hubs.drop("a").withColumnRenamed("other", "a"), allowMissingColumns=True)), "cells")
    found = stage(forest_components(first), "connected")
    nodes = trees.join(bounded(large, 10_000), "comp").select("comp", F.col("node").alias("cid"))
    label = nodes.join(found.select(F.col("node").alias("cid"), F.col("comp").alias("label")), "cid", "left")
    rest = stage(label.where(F.coalesce("label", "cid") != F.col("comp")).select("comp", "cid"), "rest")  # the smallest member labels what it is connected with
    if rest.isEmpty():
        return first
    left = rows.join(bounded(rest, FEW), ["comp", "cid"], "left_semi")
    parts = left.groupBy("comp").agg(F.ceil(F.sum("w") / most).cast("int").alias("parts"))
    parts = stage(parts.join(large, "comp"), "parts")
    these = left.join(bounded(parts, 10_000), "comp").withColumn("a", F.pmod(F.xxhash64("cid"), F.col("parts").cast("bigint")).cast("int"))
    these = these.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    all_ = rows.join(bounded(parts, 10_000), "comp").withColumn("b", F.pmod(F.xxhash64("cid"), F.col("chunks").cast("bigint")).cast("int"))
    all_ = all_.withColumn("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return first.union(searched(these.select(*keys, "cid", "n", "data").union(all_.select(*keys, "cid", "n", "data"))))


def similar_rows(docs: DataFrame, width: int = 5, least: float = 0.8, most: int = 4096, most_shingles: int = 1_000_000) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, th, component_id, kept_id, kept_th): a row for each row; groups of similar documents.

    Texts become sets of their distinct `width`-word shingles (lower-cased, words between ASCII white space;
    64-bit hashes). Equal sets are copies and one class. Two classes link if their Jaccard similarity is
    `least` or more. `anchor_links` and `prefix_links` propose, sketches rule out, exact sets decide.
    component_id is the smallest doc_id of the group; kept_id, kept_th are the doc_id and text hash of the
    row that stands for it: the smallest doc_id, then the smallest hash, a null doc_id only if there is no other.

    Null and empty texts are copies of each other. Repeated doc_ids stay separate rows, whatever their texts;
    a group of which every doc_id is null has a null component_id. An empty table gives an empty result;
    other columns are not read.
    """
    full = stage(described(docs, width, least), "prints")
    prints = stage(full.select("doc_id", "th", *_KEY), "rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first")
    classes = full.groupBy(*_KEY).agg(first, *(F.first(c).alias(c) for c in ("n", "fp", "sketch", "prefix")))
    classes = stage(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    unstage(full)
    links = stage(prefix_links(classes, least, most), "candidates")
    small = stage(classes.drop("prefix"), "sketches")
    unstage(classes)
    pairs = stage(possible(links.where("kind = 0").select(F.col("a").alias("src"), F.col("b").alias("dst")).union(anchor_links(small)).distinct(), small, least), "pairs")
    groups = links.where("kind = 1").select(F.col("a").alias("shingle"), F.col("b").alias("cid"), "rest", "n")
    tight = stage(group_links(groups, small, least).distinct(), "tight")
    stars = links.where("kind = 2").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    if not stars.isEmpty():
        whole = stage(forest_components(stars), "stars")
        tight = tight.union(stage(tree_links(whole, small.withColumnRenamed("sketch", "data"), sketches_near, least, most), "starred"))
    trees = stage(forest_components(tight), "trees")
    ends = pairs.select(F.col("src").alias("cid")).union(pairs.select("dst")).union(trees.select("node")).distinct()
    members = small.join(ends, "cid", "left_semi").select("cid", "first.doc_id", "first.th")
    sets = stage(shingle_sets(docs, stage(members, "members"), width), "sets")
    exact = stage(verified(pairs, sets, least).union(tree_links(trees, sets, sets_near, least, most_shingles, F.col("n"))), "exact")
    unstage(sets, links)
    comp = stage(forest_components(exact).select(F.col("node").alias("cid"), "comp"), "comp")
    low = comp.join(small, "cid").groupBy("comp").agg(F.min("first").alias("low"))
    named = small.join(comp.join(low, "comp").select("cid", "low"), "cid", "left").select(*_KEY, F.coalesce("low", "first").alias("low"))
    named = stage(named.select(*_KEY, F.col("low.doc_id").alias("kept_id"), F.col("low.th").alias("kept_th")), "named")
    return prints.join(named, list(_KEY)).select("doc_id", "th", F.col("kept_id").alias("component_id"), "kept_id", "kept_th")


def similar_documents(docs: DataFrame, **options) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, component_id): the groups of `similar_rows`, a row for each row."""
    return similar_rows(docs, **options).select("doc_id", "component_id")


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """One row of docs, with all its columns, for each group of `similar_rows`: the row that stands for it.

    Rows are told apart by doc_id and text, so a row with another's doc_id but a text of its own stays, and
    a null doc_id protects no copy. Of rows that agree in doc_id and text one stays, whatever their other columns.
    """
    found = stage(similar_rows(docs, **options), "similar")
    is_kept = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("th") == F.col("kept_th"))
    told = found.groupBy("doc_id", "th").agg(F.first(is_kept).alias("kept"), F.count("*").alias("times"))
    told = stage(told.where("not kept or times > 1").select(F.col("doc_id").alias("_of"), F.col("th").alias("_th"), "kept"), "told")
    names = docs.columns
    # columns by position: the names of docs may be any
    numbered = docs.toDF(*(f"c{i}" for i in range(len(names))))
    own = {c: F.col(f"c{i}") for i, c in reversed(list(enumerate(names)))}
    own_hash = F.xxhash64(F.coalesce(own["text"].cast("string"), F.lit("")))
    marked = numbered.join(bounded(told, FEW), own["doc_id"].cast("long").eqNullSafe(F.col("_of")) & (own_hash == F.col("_th")), "left")
    single = marked.where("kept is null").select(*numbered.columns)
    once = marked.where("kept").dropDuplicates(["_of", "_th"]).select(*numbered.columns)
    return single.union(once).toDF(*names)
