"""Append-only ledgers on a shared file system: commits, tails of the chains, compare-and-append.

A ledger is a folder. `manifest/<version>.json` names the folders of each commit: its records and the tails of
the chains it touched. A commit becomes part of the ledger when its manifest is created, which fails if
another append took the version first; nothing is ever rewritten, and folders without a manifest don't count.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epiweave.operators import ledgers as led
from epiweave.sources.shared import create_file, file_system

RECORDS = "chain long, seq long, payload string, prev string, hash string"
TAILS = "chain long, seq long, hash string"
#: Every so many commits the tails of all chains are written, so that a reader needs those of few commits.
FULL_TAILS = 16


class StaleTail(RuntimeError):
    """Another append came first: read the ledger again."""


class RefusedAppend(ValueError):
    """The stored chains don't verify, or the records don't follow them."""


@dataclass(frozen=True)
class Ledger:
    spark: SparkSession
    path: str
    version: int
    commits: tuple[dict, ...]

    def records(self) -> DataFrame:
        """(chain, seq, payload, prev, hash) of all commits up to this version."""
        return _read(self.spark, [c["records"] for c in self.commits], RECORDS)

    def tails(self) -> DataFrame:
        """(chain, seq, hash) of the last record of each chain; cost goes with the chains, not with the records."""
        first = max((i for i, c in enumerate(self.commits) if c["full"]), default=0)
        return _last(_read(self.spark, [c["tails"] for c in self.commits[first:]], TAILS))


def _read(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _last(rows: DataFrame) -> DataFrame:
    return rows.groupBy("chain").agg(F.max(F.struct("seq", "hash")).alias("x")).select("chain", "x.seq", "x.hash")


def open_ledger(spark: SparkSession, path: str) -> Ledger:
    """The ledger as it is now; an absent folder is an empty ledger of version 0."""
    place, fs = file_system(spark, f"{path}/manifest")
    names = sorted(x.getPath().getName() for x in fs.listStatus(place)) if fs.exists(place) else []
    names = [n for n in names if n.endswith(".json") and n[0].isdigit()]
    if names != [f"{i:09d}.json" for i in range(1, len(names) + 1)]:
        raise RefusedAppend("a version of the ledger is missing")
    rows = [json.loads(r.value) for r in spark.read.text([f"{path}/manifest/{n}" for n in names], wholetext=True).collect()] if names else []  # one small row a commit
    return Ledger(spark, path, len(names), tuple(sorted(rows, key=lambda c: c["version"])))


def delta(ledger: Ledger, new: DataFrame, verify: bool = True) -> DataFrame:
    """What an append of new(chain, seq, payload) would write: its records chained to the stored tails.

    Each chain goes on from its tail: its records are numbered tail + 1, tail + 2, ... without a gap or
    repetition, else RefusedAppend. With verify the stored records of the chains that grow must verify and
    end in the stored tails, else RefusedAppend. Null payloads count as empty; records of a null chain form
    one chain.
    """
    rows = new.select(F.col("chain").cast("long"), F.col("seq").cast("long"), F.col("payload").cast("string"))
    grown = rows.groupBy("chain").agg(F.min("seq").alias("_from"), F.max("seq").alias("_to"), F.count_distinct("seq").alias("_n"), F.count("*").alias("_rows"))
    tails = ledger.tails().select(F.col("chain").alias("_c"), F.col("seq").alias("_seq"), F.col("hash").alias("_hash"))
    both = grown.join(tails, F.col("chain").eqNullSafe(F.col("_c")), "left").drop("_c")
    follows = (F.col("_from") == F.coalesce("_seq", F.lit(0)) + 1) & (F.col("_n") == F.col("_rows")) & (F.col("_to") - F.col("_from") + 1 == F.col("_n"))
    odd = both.where(~F.coalesce(follows, F.lit(False))).select("chain").first()
    if odd:
        raise RefusedAppend(f"the records of chain {odd[0]} don't follow its tail")
    going_on = both.where("_seq is not null")
    if verify and ledger.version:
        _check(ledger, going_on)
    return led.chain(rows, tails=going_on.select("chain", F.col("_hash").alias("hash")))


def append(ledger: Ledger, new: DataFrame, verify: bool = True) -> Ledger:
    """Writes `delta` as the next version and returns the ledger with it.

    If another append took that version first, StaleTail is raised and nothing is added.
    """
    spark, tag = ledger.spark, uuid.uuid4().hex[:12]
    data, own = f"{ledger.path}/records-{tag}", f"{ledger.path}/tails-{tag}"
    delta(ledger, new, verify).write.parquet(data)
    now = _last(_read(spark, [data], RECORDS))
    full = (ledger.version + 1) % FULL_TAILS == 0
    (_last(ledger.tails().union(now)) if full else now).write.parquet(own)
    commit = {"version": ledger.version + 1, "records": data, "tails": own, "full": full}
    if not create_file(spark, f"{ledger.path}/manifest/{ledger.version + 1:09d}.json", json.dumps(commit)):
        for p in (data, own):
            place, fs = file_system(spark, p)
            fs.delete(place, True)
        raise StaleTail(f"version {ledger.version + 1} of {ledger.path} is taken")
    return Ledger(spark, ledger.path, ledger.version + 1, (*ledger.commits, commit))


def _check(ledger: Ledger, grown: DataFrame) -> None:
    """Verifies the stored chains that grow, and that they end where the tails say."""
    mine = grown.select(F.col("chain").alias("_c"), "_seq", "_hash")
    stored = ledger.records()
    stored = stored.join(mine.select("_c"), stored.chain.eqNullSafe(F.col("_c")), "left_semi")
    bad = led.verify(stored).where("reason is not null").first()
    if bad:
        raise RefusedAppend(f"chain {bad.chain} does not verify: {bad.reason} at {bad.first_bad_seq}")
    ends = _last(stored)
    both = mine.join(ends, ends.chain.eqNullSafe(F.col("_c")), "left")
    if (moved := both.where("not (seq <=> _seq and hash <=> _hash)").first()) is not None:
        raise RefusedAppend(f"chain {moved['_c']} does not end in its tail")
