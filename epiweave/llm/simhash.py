"""SimHash near-duplicates by anchor-point covering (operator 5)."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_column, sorted_runs, spanning, split_hot, stage, table
from .components import components

SEED = 42


def shingle_hashes(text: bytes, width: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each space-joined run of `width` words of the lower-cased text (fewer words: all of them)."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(width, len(words))
    parts = map(joined.__getitem__, map(slice, starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()))
    n = len(words) - width + 1
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(seed)), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """64 bits, each 1 where over half of the hashes have it; none: 0. Signed, as Spark keeps longs."""
    count = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = np.ascontiguousarray(hashes[i : i + 65536]).astype("<u8", copy=False)
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fp long). Null text counts as empty; every row yields one row."""

    def run(batches):
        for b in batches:
            fps = [fingerprint(shingle_hashes(x, width)) for x in binary_column(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


#: Bits 0-30 of a half carry the perfect Hamming code [31, 26]: position p (1..31) has bit p - 1.
_POSITIONS = np.arange(1, 32, dtype=np.int64)


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The anchors (codewords) within 2 = covering radius 1 + threshold 1 of each 31-bit word.

    Returns (row, codeword). A word that is a codeword has just itself; any other has the codeword at
    distance 1 and the 15 at distance 2 (pairs of positions whose exclusive-or is its syndrome).
    """
    half = half.astype(np.int64)
    bits = (half[:, None] >> (_POSITIONS - 1)) & 1
    syndrome = np.bitwise_xor.reduce(bits * _POSITIONS, axis=1)
    home = np.where(syndrome > 0, half ^ (np.int64(1) << np.maximum(syndrome - 1, 0)), half)
    rows, words = [np.arange(len(half))], [home]
    mate = _POSITIONS[None, :] ^ syndrome[:, None]
    first = (syndrome[:, None] > 0) & (mate > _POSITIONS[None, :])
    r, k = np.nonzero(first)
    rows.append(r)
    words.append(half[r] ^ (np.int64(1) << (_POSITIONS[k] - 1)) ^ (np.int64(1) << (mate[r, k] - 1)))
    return np.concatenate(rows), np.concatenate(words)


def replicas(prints: DataFrame) -> DataFrame:
    """(fp) -> (anchor, fp): each fingerprint at every anchor of either half within covering radius + threshold.

    Two fingerprints with at most 3 differing bits differ in at most 1 bit of one 32-bit half; then the
    home anchor of one lies within 1 of it and within 2 of the other, so both stand there. Per half 16
    anchors out of 2^26, whatever the corpus size; bit 31 of a half takes no part in its code.
    """

    def run(batches):
        for b in batches:
            fp = b.column("fp").to_numpy()
            for half in (0, 1):
                row, word = anchors((fp >> (32 * half)) & 0x7FFFFFFF)
                yield pa.RecordBatch.from_arrays([pa.array(word | (half << 32)), pa.array(fp[row])], ["anchor", "fp"])

    return prints.select("fp").mapInArrow(run, "anchor long, fp long")


def near_links(prints: DataFrame, radius: int = 3, most: int = 4096) -> DataFrame:
    """Distinct fingerprints (fp) -> links (src, dst) that span each group of fingerprints within radius bits.

    Each anchor yields a spanning forest of its own links, at most members - 1, never all pairs; groups of
    over `most` fingerprints are split into chunk pairs. radius up to 3 (the guarantee of `replicas`).
    """
    if not 0 <= radius <= 3:
        raise ValueError("the anchors guarantee radius 0 to 3")
    cells = split_hot(replicas(prints), ["anchor"], "fp", most)
    keys = ["anchor", "cell_i", "cell_j"]

    def run(batches):
        for cols, at in sorted_runs(batches, keys):
            fp = cols["fp"].to_numpy().view(np.uint64)
            size = np.diff(at)
            src, dst = [], []
            owner = np.repeat(np.arange(len(size)), size)
            small = size[owner] <= 8
            for k in range(1, 8):
                i = np.flatnonzero(small[:-k] & (owner[k:] == owner[:-k])) if len(fp) > k else []
                if not len(i):
                    break
                i = i[np.bitwise_count(fp[i] ^ fp[i + k]) <= radius]
                src.append(fp[i])
                dst.append(fp[i + k])
            for g in np.flatnonzero(size > 8).tolist():
                own = fp[at[g] : at[g + 1]]
                e = list(spanning(len(own), lambda i, js, own=own: np.bitwise_count(own[js] ^ own[i]) <= radius))
                if e:
                    i, j = np.array(e).T
                    src.append(own[i])
                    dst.append(own[j])
            if src:
                pair = np.unique(np.stack([np.concatenate(src), np.concatenate(dst)], 1).view(np.int64), axis=0)
                pair = pair[pair[:, 0] != pair[:, 1]]
                if len(pair):
                    yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["src", "dst"])

    return cells.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "src long, dst long")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fp long, component_id): smallest doc_id reachable over near fingerprints.

    Lower-cases A-Z, takes words between ASCII white space and their shingles with repeats. Null or empty
    text: fingerprint 0, linked like any other. Copies collapse to their fingerprint before links are
    sought. Rows with equal doc_id stay separate rows; a null doc_id never names a component unless the
    whole component has none. An empty table gives an empty result; other columns are not read.
    """
    prints = stage(fingerprints(docs, width), "prints")
    classes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    comp = stage(components(near_links(classes, radius)).select(F.col("node").alias("fp"), "comp"), "comp")
    low = comp.join(classes, "fp").groupBy("comp").agg(F.min("first_id").alias("low"))
    named = comp.join(low, "comp").select("fp", "low")
    named = stage(classes.join(named, "fp", "left").select("fp", F.coalesce("low", "first_id").alias("component_id")), "named")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    dup = near_duplicates(table(spark, sf_dir, "documents"))
    return dup.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
