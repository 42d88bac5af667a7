"""Benchmark decontamination by SimHash windows and multi-index Hamming blocks (operator 4)."""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_column, bounded, stage, table
from .simhash import fingerprint

HIT = "doc_id long, item_id long, start_word long, n_words long, similarity double"


class HammingBlocks:
    """Finds all fingerprints within `radius` bits of a query among 64-bit fingerprints.

    64 bits are eight blocks of 8. If each block b differed in more than most[b] bits, with the most[b] + 1
    adding up to radius + 1, the whole would differ in more than radius; so each fingerprint is listed in
    every block under all values within most[b] of its own, and a query looks up its eight values.
    """

    def __init__(self, prints: list[int], radius: int):
        self.radius = radius
        self.prints = np.array(prints, np.int64).view(np.uint64)
        values = np.arange(256, dtype=np.uint8)
        own = self.prints.view(np.uint8).reshape(-1, 8)
        self.most = [(radius + 1) // 8 + (block < (radius + 1) % 8) - 1 for block in range(8)]
        self.lists, self.at = [], []
        for block, most in enumerate(self.most):
            value, item = np.nonzero(np.bitwise_count(values[:, None] ^ own[None, :, block]) <= most)
            self.lists.append(item.astype(np.int32))
            self.at.append(np.searchsorted(value, np.arange(257)))

    def near(self, fp: int) -> list[int]:
        query = np.array([fp], np.uint64)
        found = [self.lists[b][self.at[b][v] : self.at[b][v + 1]] for b, v in enumerate(query.view(np.uint8).tolist())]
        at = np.unique(np.concatenate(found))
        return at[np.bitwise_count(self.prints[at] ^ query[0]) <= self.radius].tolist()


def shingles(words: list[bytes], width: int) -> Counter:
    """The word shingles of a passage with their numbers; fewer words than width: the whole passage."""
    if not words:
        return Counter()
    width = min(width, len(words))
    return Counter(b" ".join(words[i : i + width]) for i in range(len(words) - width + 1))


def weighted_jaccard(a: Counter, b: Counter) -> float:
    both = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return both / (sum(a.values()) + sum(b.values()) - both) if a or b else 0.0


def _print(bag: Counter) -> int:
    return fingerprint(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s, n in bag.items() for _ in range(n)), np.uint64))


def window_prints(words: list[bytes], starts: np.ndarray, span: int, width: int) -> np.ndarray:
    """SimHash of words[s : s + span] for each s of the ascending starts, from running sums of the shingles' bits."""
    width = min(width, span)
    n = span - width + 1
    out = np.zeros(len(starts), np.uint64)
    cuts = [0, *(np.flatnonzero(np.diff(starts) > span) + 1).tolist(), len(starts)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        low = int(starts[a])
        part = words[low : int(starts[b - 1]) + span]
        hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(part[i : i + width]), 42) for i in range(len(part) - width + 1)), np.uint64, len(part) - width + 1)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        upto = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
        at = starts[a:b] - low
        out[a:b] = np.packbits(2 * (upto[at + n] - upto[at]) > n, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


class Index:
    """A block of benchmark items, ready to be held against documents."""

    def __init__(self, items: list[tuple[int, bytes]], width: int, least: float, radius: int):
        self.width, self.least = width, least
        self.items = [(i, text.lower().split()) for i, text in items]
        self.items = [(i, w) for i, w in self.items if w]
        self.vocabulary = {w: k + 1 for k, w in enumerate(sorted({w for _, ws in self.items for w in ws}))}
        self.by_length: dict[int, list[tuple[int, Counter]]] = defaultdict(list)
        posted: dict[int, dict[int, set[tuple[int, int]]]] = defaultdict(lambda: defaultdict(set))
        for i, words in self.items:
            self.by_length[len(words)].append((i, shingles(words, width)))
            place = (len(words), len(self.by_length[len(words)]) - 1)
            w = min(width, len(words))
            n = len(words) - w + 1
            ids = np.array([self.vocabulary[x] for x in words], np.int64)
            for code in set(self.codes([ids[k : k + n] for k in range(w)]).tolist()):
                posted[w][code].add(place)
        #: By shingle width: the sorted codes of all items' shingles, and by code the lengths of the items that hold it with their places among the items of that length.
        self.known = {w: (np.array(sorted(codes), np.uint64), [self._by_length(codes[c]) for c in sorted(codes)]) for w, codes in posted.items()}
        self.blocks = {n: HammingBlocks([_print(b) for _, b in group], radius) for n, group in self.by_length.items()}

    @staticmethod
    def _by_length(places: set[tuple[int, int]]) -> dict[int, np.ndarray]:
        out: dict[int, list[int]] = defaultdict(list)
        for length, k in sorted(places):
            out[length].append(k)
        return {length: np.array(ks) for length, ks in out.items()}

    @staticmethod
    def codes(words: list[np.ndarray]) -> np.ndarray:
        """A number for each shingle, given its first, second ... words' ids; equal shingles have equal numbers."""
        code = np.zeros(len(words[0]), np.uint64)
        for w in words:
            code = (code ^ w.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(29)
        return code

    def windows(self, words: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray, dict[int, dict[int, np.ndarray]], int]]:
        """Item length -> (starts, shared, holders, need) of the item-sized windows that may be similar to an item of that length.

        need is the least overlap of weighted shingles at which the similarity reaches `least`. A window's
        overlap with any item is at most its number of places with a shingle of an item of that length; starts
        are the windows where that is `need` or more, shared the places, holders the items by place.
        """
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))
        held: dict[int, dict[int, dict[int, np.ndarray]]] = defaultdict(dict)
        for width, (known, lengths) in self.known.items():
            n = len(ids) - width + 1
            if n < 1:
                continue
            whole = ids[:n] > 0
            for k in range(1, width):
                whole &= ids[k : k + n] > 0
            at = np.flatnonzero(whole)
            code = self.codes([ids[at + k] for k in range(width)])
            k = np.minimum(np.searchsorted(known, code), len(known) - 1)
            same = known[k] == code
            for p, c in zip(at[same].tolist(), k[same].tolist(), strict=True):
                for length, items in lengths[c].items():
                    held[length][p] = items
        out = {}
        for length, holders in held.items():
            span, w = min(length, len(words)), min(self.width, length)
            n = span - w + 1
            need = int(np.ceil(self.least / (1 + self.least) * (n + length - w + 1) - 1e-9))
            p = np.array(sorted(holders))
            starts = np.arange(len(words) - span + 1)
            mass = np.searchsorted(p, starts + n) - np.searchsorted(p, starts)
            starts = starts[mass >= max(need, 1)]
            if len(starts):
                out[length] = starts, p, holders, need
        return out

    def hits(self, text: bytes) -> dict[int, tuple[float, int, int]]:
        """item_id -> (similarity, first word, words) of its most similar window, the first among equals.

        A window has as many words as the item (a shorter document is one window). Its fingerprint goes
        through the Hamming blocks of the items of that length. Repeated shingles can turn a fingerprint's
        bits beyond any radius, so items that share enough places with the window join what the blocks
        return; exact weighted similarity decides on both.
        """
        words = text.lower().split()
        out: dict[int, tuple[float, int, int]] = {}
        if not words:
            return out
        for length, (starts, places, holders, need) in sorted(self.windows(words).items()):
            span = min(length, len(words))
            n = span - min(self.width, length) + 1
            for start, fp in zip(starts.tolist(), window_prints(words, starts, span, self.width).tolist(), strict=True):
                inside = places[np.searchsorted(places, start) : np.searchsorted(places, start + n)].tolist()
                sharing = np.bincount(np.concatenate([holders[p] for p in inside]), minlength=len(self.by_length[length]))
                near = {*self.blocks[length].near(fp), *np.flatnonzero(sharing >= need).tolist()}
                near = sorted(k for k in near if sharing[k] >= need)  # others can't reach the similarity
                bag = shingles(words[start : start + span], self.width) if near else None
                for k in near:
                    item, own = self.by_length[length][k]
                    similarity = weighted_jaccard(bag, own)
                    best = out.get(item, (0.0, 0, 0))
                    if similarity >= self.least and (similarity > best[0] or (similarity == best[0] and (start, span) < best[1:])):
                        out[item] = (similarity, start, span)
        return out


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 5, least: float = 0.8, radius: int = 22, block_items: int = 20_000) -> DataFrame:
    """docs(doc_id, text) x benchmark(item_id, text) -> HIT: one row for each document and item found in it.

    A document holds an item if a window of as many words as the item has a weighted (multiset) Jaccard
    similarity of at least `least` on shingles of `width` words (words: lower-cased, between ASCII white
    space; an item under `width` words is one shingle). Candidates are items whose fingerprint lies within
    `radius` bits of the window's (windows of similarity 0.8 without repeated shingles differ in 10 of 64 bits
    on average, 22 is four standard deviations more), and those that share so many shingle places with the
    window that the similarity may be reached: so none is lost, repeats or not. Null and empty texts hold nothing and items without words are found
    nowhere; repeated doc_ids give rows each; repeated item_ids count as one item with several texts; empty
    tables give no rows; other columns are not read.

    The items go to the tasks in blocks of at most `block_items`, each of which passes over all documents, so
    what a task holds does not grow with either table; the driver keeps the blocks until the job has run.
    """
    items = benchmark.select(F.col("item_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = items.count()
    blocks = max(1, -(-n // block_items))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = None
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        index = Index([(i, t.encode()) for i, t in part.orderBy("item_id", "text").collect()], width, least, radius)

        def run(batches, index=index):
            for b in batches:
                out = []
                for i, text in enumerate(binary_column(b, "text")):
                    out += [(i, item, start, span, s) for item, (s, start, span) in sorted(index.hits(text).items(), key=lambda x: (x[0] is None, x[0]))]
                if out:
                    at, *cols = zip(*out, strict=True)
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], [f.split()[0] for f in HIT.split(", ")])

        here = rows.mapInArrow(run, HIT)
        found = here if found is None else found.union(here)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs, with all columns, that hold no item of the benchmark.

    Whether a row goes is decided by its text alone, known by a 64-bit hash: a null doc_id protects no leak, and
    a row that has another's doc_id but a clean text of its own stays.
    """
    names = docs.columns
    numbered = docs.toDF(*(f"c{i}" for i in range(len(names))))
    own = {c: F.col(f"c{i}") for i, c in reversed(list(enumerate(names)))}
    th = F.xxhash64(F.coalesce(own["text"].cast("string"), F.lit("")))
    leaks = contamination(docs.select(F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("doc_id"), "text"), benchmark, **options)
    leaks = stage(leaks.select(F.col("doc_id").alias("_th")).distinct(), "leaks")
    return numbered.join(bounded(leaks, 200_000), th == F.col("_th"), "left_anti").toDF(*names)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
