"""Token ids in ORC files: run-length encoded integers, row indexes, Bloom filters on doc_id (operator 3)."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, portions, shared_dir, stage, table
from .tokens import encoder, read_vocabulary

SCHEMA = "part int, doc_id long, before long, n_tokens long, ids array<int>"


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int, keeps_space: bool = True, stripe_bytes: int = 16 << 20, stride: int = 1000) -> None:
    """Encodes docs(doc_id, text) and writes ORC files in ascending doc_id order (ties by text, null ids first).

    A row holds part (number of the file), doc_id, before (ids in the file before it), n_tokens (with
    end_id) and ids. Integers are run-length encoded by ORC; each stripe has row indexes and a Bloom filter
    on doc_id, so a reader skips files, stripes and row groups by min, max and filter, and splits files
    between stripes. Null text counts as empty (only end_id). An empty table writes no rows. Rows are
    dealt out by ranges of doc_id: no task depends on the corpus size.
    """
    blob = read_vocabulary(vocabulary)

    def run(batches):
        enc, part, before = encoder(blob, keeps_space, 700_000), TaskContext.get().partitionId(), 0
        for b in batches:
            for at, k in portions(b.column("text"), 16 << 20):
                ids, n = enc.encode(b.column("text").slice(at, k), end_id)
                ends = np.cumsum(n)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.view("<i4")))
                cols = [pa.array(np.full(k, part, np.int32)), b.column("doc_id").slice(at, k), pa.array(before + ends - n), pa.array(n), lists]
                yield pa.RecordBatch.from_arrays(cols, ["part", "doc_id", "before", "n_tokens", "ids"])
                before += int(ends[-1])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, SCHEMA)
    rows.write.option("orc.bloom.filter.columns", "doc_id").option("orc.row.index.stride", stride).option("orc.stripe.size", stripe_bytes).option("compression", "zstd").orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the files; start is the number of ids of all documents before it.

    The sums by file are one row a file, added up in order of the files; filters on doc_id reach the files.
    """
    rows = spark.read.schema(SCHEMA).orc(path)
    sums = rows.groupBy("part").agg(F.max(F.col("before") + F.col("n_tokens")).alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    first = stage(sums.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first")), "starts")
    return rows.join(bounded(first, 200_000), "part").select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids")


def with_crc32(rows: DataFrame) -> DataFrame:
    """Replaces ids by ids_crc32, the unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batches):
        for b in batches:
            lists = b.column("ids")
            flat, at = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            crc = [zlib.crc32(flat[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
            del lists, flat
            pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return with_crc32(read_tokens(spark, path))
