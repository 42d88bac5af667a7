"""Streaming forms of the weekly work. Inputs have an event time `ts` of type TIMESTAMP.

`run_available` drains what is there (availableNow) into a sink table and returns it; the same streams run
continuously with another trigger. State stays bounded by the watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructField, StructType

from epiweave.sources.shared import shared_dir


def weekly(events: DataFrame, by: Sequence[str], delay: str) -> DataFrame:
    """Counts by Monday-aligned week, final once the watermark passes the week."""
    w = F.window("ts", "7 days", startTime="4 days")
    return events.withWatermark("ts", delay).groupBy(*by, w).agg(F.count("*").alias("n"))


def rolling(events: DataFrame, by: Sequence[str], delay: str) -> DataFrame:
    """28-day burden sliding by 7 days."""
    w = F.window("ts", "28 days", "7 days", "4 days")
    return events.withWatermark("ts", delay).groupBy(*by, w).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, by: Sequence[str], gap: str, delay: str) -> DataFrame:
    """Bursts of reports: rows of a source at most `gap` apart."""
    return events.withWatermark("ts", delay).groupBy(*by, F.session_window("ts", gap).alias("window")).agg(F.count("*").alias("n"))


def first_seen(events: DataFrame, by: Sequence[str], delay: str) -> DataFrame:
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(by))


def run_available(stream: DataFrame, name: str, mode: str = "append", out: str | None = None, state: str | None = None) -> DataFrame:
    """Drains the stream into out, going on from the checkpoint in state; both are fresh folders unless given."""
    spark = stream.sparkSession
    out, state = out or shared_dir(spark, name), state or shared_dir(spark, f"{name}-state")
    stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_batches(stream: DataFrame, name: str, each: Callable[[DataFrame, int], None]) -> None:
    state = shared_dir(stream.sparkSession, f"{name}-state")
    stream.writeStream.foreachBatch(each).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def split_late(stream: DataFrame, spark: SparkSession, name: str, delay: str) -> DataFrame:
    """Rows with late: their time is more than `delay` before the latest time of earlier batches; counted, not merged.

    The latest time up to each batch is kept beside the rows, in a folder that a repeated batch replaces, so a
    restarted stream goes on where it stopped. A batch reads the one row of the batch before it.
    """
    out, tops = shared_dir(spark, name), shared_dir(spark, f"{name}-latest")

    def each(batch: DataFrame, number: int) -> None:
        late, before = F.lit(False), spark.createDataFrame([], "latest timestamp")
        if number:
            before = spark.read.schema("latest timestamp").parquet(f"{tops}/batch={number - 1}")
            batch = batch.crossJoin(F.broadcast(before.select(F.col("latest").alias("top"))))  # one row
            late = F.coalesce(F.col("ts") < F.col("top") - F.expr(f"interval {delay}"), F.lit(False))
        batch.withColumn("late", late).drop("top").write.mode("overwrite").parquet(f"{out}/batch={number}")
        batch.select(F.col("ts").alias("latest")).union(before).agg(F.max("latest").alias("latest")).write.mode("overwrite").parquet(f"{tops}/batch={number}")

    run_batches(stream, name, each)
    return spark.read.parquet(out)


#: Keys are dealt into so many buckets, each a map in the state store. A checkpoint holds for one number of them.
BUCKETS = 2048


class Once(StatefulProcessor):
    """Keeps the hash of each key of a bucket in the state store: the first is appended, equal ones are skipped, others are conflicts.

    Within a batch the smallest hash stands for its key if it has none yet; equal records count once. With
    keep_ms the state of a key goes that long after it was set, which bounds the store where keys age.
    A call of the processor takes some milliseconds, so it has a bucket of keys; the map is asked only for
    the keys at hand.
    """

    def __init__(self, key_schema: StructType, keep_ms: int | None = None) -> None:
        self.key_schema, self.keep_ms = key_schema, keep_ms

    def init(self, handle) -> None:
        self.kept = handle.getMapState("hashes", self.key_schema, "hash string", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803 - names of the interface
        names, out = self.key_schema.names, []
        hashes: dict[tuple, set[str]] = {}
        for batch in rows:
            for *k, hash_ in zip(*(batch[c].tolist() for c in names), batch["hash"].tolist(), strict=True):
                hashes.setdefault(tuple(k), set()).add(hash_)
        for k, own in hashes.items():
            stored = (self.kept.getValue(k) or (None,))[0]
            for hash_ in sorted(own):
                if stored is None:
                    stored, action = hash_, "append"
                    self.kept.updateValue(k, (hash_,))
                else:
                    action = "skip" if hash_ == stored else "conflict"
                out.append((*k, hash_, action))
        yield pd.DataFrame(out, columns=[*names, "hash", "action"])


def append_once(stream: DataFrame, k: Sequence[str], keep_ms: int | None = None) -> DataFrame:
    """stream(k..., hash) -> stream (k..., hash, action): one record a key over all batches, kept in Spark's state store.

    What a batch costs goes with its own keys, not with the batches before. Repeated rows of a key are
    dropped where they lie before the shuffle, so a key of a third of all rows is no burden. Rows of a null
    hash are left out; the keys must not be null. A restart from the checkpoint neither loses nor repeats.
    """
    names = [f"k{i}" for i in range(len(k))]
    own = stream.where("hash is not null").select(*(F.col(c).alias(n) for n, c in zip(names, k, strict=True)), "hash")
    thin = own.mapInPandas(lambda batches: (b.drop_duplicates() for b in batches), own.schema)
    keys = StructType([StructField(n, own.schema[n].dataType) for n in names])
    kinds = [f"{n} {own.schema[n].dataType.simpleString()}" for n in names]
    use_state_store(stream.sparkSession)
    mode = "none" if keep_ms is None else "processingTime"
    dealt = thin.withColumn("bucket", F.pmod(F.xxhash64(*names), F.lit(BUCKETS))).groupBy("bucket")
    out = dealt.transformWithStateInPandas(Once(keys, keep_ms), ", ".join([*kinds, "hash string", "action string"]), "append", mode)
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, k, strict=True)), "hash", "action")


def use_state_store(spark: SparkSession) -> None:
    """Keyed processors need the store that spills to disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
