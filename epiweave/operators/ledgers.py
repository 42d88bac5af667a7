"""Hash-chained ledgers: building, verifying, idempotent appends, manifests, contracts, outcomes."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epiweave.functions import calendar as cal
from epiweave.operators.evaluation import running

GENESIS = "0" * 64
WEEK = ["epi_year", "epi_week"]


def chain(records: DataFrame, genesis: str = GENESIS, tails: DataFrame | None = None) -> DataFrame:
    """records(chain, seq, payload) -> + prev, hash; hash is the SHA-256 of prev | payload.

    Chains are dealt out over tasks and read in order as a stream that keeps one hash, so a chain of any
    length passes in bounded memory; building one chain is sequential by nature. Ties of seq go by payload,
    null payloads count as empty, and the records of a null chain form one chain. tails(chain, hash) are the
    last hashes of chains that go on: they stand in front of their chain's records in the stream; other chains start at genesis.
    """

    def run(batches):
        last_chain, last = run, genesis  # no chain equals run
        for b in batches:
            prevs, hashes, kept = [], [], []
            for c, p, tail in zip(b.column("chain").to_pylist(), b.column("payload").to_pylist(), b.column("tail").to_pylist(), strict=True):
                if last_chain is run or c != last_chain:
                    last_chain, last = c, genesis
                kept.append(tail is None)
                if tail is not None:
                    last = tail
                    continue
                prevs.append(last)
                last = hashlib.sha256(f"{last}|{p or ''}".encode()).hexdigest()
                hashes.append(last)
            own = b.select(["chain", "seq", "payload"]).filter(pa.array(kept, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(prevs, pa.string()), pa.array(hashes, pa.string())], ["chain", "seq", "payload", "prev", "hash"])

    none = F.lit(None).cast("string")
    rows = records.select(F.col("chain").cast("long"), F.col("seq").cast("long"), F.col("payload").cast("string"), none.alias("tail"))
    if tails is not None:
        rows = rows.union(tails.select(F.col("chain").cast("long"), F.lit(None).cast("long"), none, F.col("hash")))
    rows = rows.repartition("chain").sortWithinPartitions("chain", F.col("tail").isNull(), "seq", "payload")
    return rows.mapInArrow(run, "chain long, seq long, payload string, prev string, hash string")


def verify(ledger: DataFrame, genesis: str | None = GENESIS, own: Column | None = None) -> DataFrame:
    """ledger(chain, seq, payload, prev, hash) -> by chain: records, the first bad sequence number and why, or null.

    own is the hash a record should have (by default the SHA-256 of prev | payload). Every record meets its
    predecessor by a join on chain and seq - 1, so even one single chain of any length spreads over all tasks.
    A record is out of sequence if its number is below 1, repeated, or lacks the one before it; the first
    record's prev must be genesis, which may be null. A record without a stored hash is refused for that.
    Null payloads count as empty, as in `chain`.
    """
    own = F.sha2(F.concat("prev", F.lit("|"), F.coalesce("payload", F.lit(""))), 256) if own is None else own
    rows = ledger.select("chain", "seq", "prev", "hash", own.alias("_own"))
    rows = rows.groupBy("chain", "seq").agg(F.count("*").alias("_n"), F.max("prev").alias("prev"), F.max("hash").alias("hash"), F.max("_own").alias("_own"))
    before = rows.select(F.col("chain").alias("_c"), (F.col("seq") + 1).alias("_s"), F.col("hash").alias("_before"), F.lit(True).alias("_there"))
    both = rows.join(before, F.col("chain").eqNullSafe(F.col("_c")) & (F.col("seq") == F.col("_s")), "left")
    order = (F.col("_n") > 1) | (F.col("seq") < 1) | ((F.col("seq") > 1) & F.col("_there").isNull())
    expected = F.when(F.col("seq") == 1, F.lit(genesis)).otherwise(F.col("_before"))
    reason = F.when(order, "sequence").when(F.col("hash").isNull(), "missing hash").when(~F.col("prev").eqNullSafe(expected), "broken link").when(~F.col("hash").eqNullSafe(F.col("_own")), "altered record")
    bad = both.withColumn("reason", reason).groupBy("chain").agg(F.sum("_n").alias("records"), F.min(F.when(F.col("reason").isNotNull(), F.struct("seq", "reason"))).alias("_b"))
    return bad.select("chain", "records", F.col("_b.seq").alias("first_bad_seq"), F.col("_b.reason").alias("reason"))


def verify_json(lines: DataFrame, own: str, previous: str, genesis: str | None = None) -> DataFrame:
    """lines(chain, seq, raw JSON) -> as `verify`, for ledgers whose records embed their own and their predecessor's hash.

    A record's hash is the SHA-256 of its canonical JSON (sorted keys, no spaces) without the field `own`.
    """
    rows = canonical_json(lines, "raw", [own])
    rows = rows.select("chain", "seq", "payload", F.get_json_object("raw", f"$.{previous}").alias("prev"), F.get_json_object("raw", f"$.{own}").alias("hash"))
    return verify(rows, genesis, F.sha2("payload", 256))


def chain_json(records: DataFrame, own: str, previous: str, genesis: str | None = None) -> DataFrame:
    """records(chain, seq, payload: a JSON object) -> (chain, seq, raw): each with its predecessor's and its own hash embedded."""

    def run(batches):
        last_chain, last = run, genesis
        for b in batches:
            out = []
            for c, p in zip(b.column("chain").to_pylist(), b.column("payload").to_pylist(), strict=True):
                if last_chain is run or c != last_chain:
                    last_chain, last = c, genesis
                record = {**json.loads(p or "{}"), previous: last}
                last = hashlib.sha256(_canonical(record).encode()).hexdigest()
                out.append(_canonical({**record, own: last}))
            yield pa.RecordBatch.from_arrays([b.column("chain"), b.column("seq"), pa.array(out, pa.string())], ["chain", "seq", "raw"])

    rows = records.select(F.col("chain").cast("long"), F.col("seq").cast("long"), F.col("payload").cast("string"))
    return rows.repartition("chain").sortWithinPartitions("chain", "seq", "payload").mapInArrow(run, "chain long, seq long, raw string")


def _canonical(record: dict) -> str:
    return json.dumps(record, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def canonical_json(lines: DataFrame, raw: str = "raw", own: Sequence[str] = ()) -> DataFrame:
    """Adds payload: the line's JSON with sorted keys, no spaces, without its own hash fields (foreign ledgers)."""

    def run(batches):
        for b in batches:
            out = []
            for x in b.column(raw).to_pylist():
                r = json.loads(x.lstrip("﻿"))
                out.append(_canonical({k: v for k, v in r.items() if k not in own}))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, "payload"])

    from pyspark.sql.types import StringType, StructField, StructType

    return lines.mapInArrow(run, StructType([*lines.schema.fields, StructField("payload", StringType())]))


def canonical_hash(lines: DataFrame, raw: str = "raw", own: Sequence[str] = ("record_sha256",)) -> DataFrame:
    """lines with hash: the SHA-256 of a record's canonical JSON (sorted keys at every depth, no spaces, UTF-8) without its own hash field."""
    return canonical_json(lines, raw, own).withColumn("hash", F.sha2("payload", 256)).drop("payload")


def sequence_gaps(ledger: DataFrame) -> DataFrame:
    """By chain with records out of place: the first place (from 1) whose record has another number, and how many records do.

    A record's place is 1 + the records of its chain with smaller numbers, counted by prefix sums over ranges,
    so one chain of any length spreads over all tasks. Of repeated numbers at most one is in place.
    """
    counts = ledger.groupBy("chain", "seq").agg(F.count("*").alias("_n"))
    rows = running(counts, ["chain"], "seq", ["_n"])
    placed = (F.col("seq") > F.col("before__n")) & (F.col("seq") <= F.col("before__n") + F.col("_n"))
    bad = F.col("_n") - F.coalesce(placed, F.lit(False)).cast("long")
    first = F.col("before__n") + F.when(F.coalesce(F.col("seq") == F.col("before__n") + 1, F.lit(False)), 2).otherwise(1)
    return rows.withColumns({"_bad": bad, "_first": first}).where("_bad > 0").groupBy("chain").agg(F.min("_first").alias("first_gap"), F.sum("_bad").alias("n_bad"))


def idempotent(existing: DataFrame, new: DataFrame, k: Sequence[str], hash_: str = "hash") -> DataFrame:
    """new with an action: append, skip (same hash already there) or conflict (another hash there)."""
    old = existing.select(*k, F.col(hash_).alias("_h"))
    return new.join(old, list(k), "left").withColumn("action", F.when(F.col("_h").isNull(), "append").when(F.col("_h") == F.col(hash_), "skip").otherwise("conflict")).drop("_h")


def manifest_drift(hashes: DataFrame, manifest: DataFrame) -> DataFrame:
    """Names whose file hash (name, sha256) differs from the manifest's or is missing."""
    now = hashes.select("name", F.col("sha256").alias("now"))
    return manifest.join(now, "name", "left").where("now is null or now <> sha256").select("name", F.when(F.col("now").isNull(), "missing").otherwise("drifted").alias("status"))


def contract_violations(records: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds violations: the names of the rules a record breaks, joined by commas; a null outcome breaks a rule."""
    broken = F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()))
    return records.withColumn("violations", F.array_join(broken, ","))


def leaked_fields(records: DataFrame, payload: str, forbidden: Sequence[str]) -> DataFrame:
    found = F.array_intersect(F.json_object_keys(payload), F.array(*map(F.lit, forbidden)))
    return records.withColumn("leaked", F.array_join(F.array_sort(found), ","))


def outcomes(forecasts: DataFrame, weekly: DataFrame, k: Sequence[str], threshold: float, cut: float = 0.5, measure: str = "confirmed") -> DataFrame:
    """forecasts(k, epi_year, epi_week, p) joined with their four target weeks.

    n_found of 4, burden (null unless all four are there), was_elevated (strictly above the threshold),
    correct at the cut, missing week keys and the source rows as text, both in week order.
    """
    start = F.date_add(cal.sunday(*WEEK), 1)
    target = forecasts.select(*k, *WEEK, "p", F.explode(cal.target_weeks(start)).alias("_day"))
    target = target.select(*k, *WEEK, "p", cal.iso_year("_day").alias("_y"), cal.iso_week("_day").alias("_w"))
    rows = weekly.select(*k, F.col("epi_year").alias("_y"), F.col("epi_week").alias("_w"), F.col(measure).alias("_n"))
    both = target.join(rows, [*k, "_y", "_w"], "left")
    key = cal.week_key("_y", "_w")
    out = both.groupBy(*k, *WEEK, "p").agg(
        F.count("_n").alias("n_found"), F.sum("_n").alias("_sum"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("_n").isNull(), key))), ",").alias("missing"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("_n").isNotNull(), F.concat(key, F.lit("="), F.col("_n").cast("string"))))), ",").alias("snapshot"),
    )
    out = out.withColumn("burden", F.when(F.col("n_found") == 4, F.col("_sum")))
    out = out.withColumn("was_elevated", F.col("burden") > threshold)
    return out.withColumn("correct", (F.col("p") >= cut) == F.col("was_elevated")).drop("_sum")


def without_outcome(scored: DataFrame, recorded: DataFrame, k: Sequence[str]) -> DataFrame:
    """The forecasts that have no outcome yet; those that do are refused a second one."""
    return scored.join(recorded.select(*k).distinct(), list(k), "left_anti")


def by_study(records: DataFrame, study: str, own: str) -> DataFrame:
    """Adds accepted: whether a record is of the study that is read; records of others, or of none, are rejected."""
    return records.withColumn("accepted", F.coalesce(F.col(study) == own, F.lit(False)))


def refusals(requests: DataFrame, by: Sequence[str]) -> DataFrame:
    return requests.groupBy(*by, F.coalesce("reason", F.lit("eligible")).alias("reason")).agg(F.count("*").alias("n"))
