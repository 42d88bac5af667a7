"""Stored ledgers: appends from the tails, stale and tampered ones refused; ledgers and late rows of streams over restarts."""

import hashlib
import random
import threading
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from epiweave.operators import ledgers as led
from epiweave.sources import ledger_store as ls
from epiweave.sources.shared import shared_dir
from epiweave.streaming import streams as st

SCHEMA = "chain long, seq long, payload string"


def rows_for(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def content(df):
    return sorted(map(str, df.select("chain", "seq", "payload", "prev", "hash").collect()))


@pytest.fixture
def store(spark):
    return ls.open_ledger(spark, shared_dir(spark, "ledger"))


ALL = [(c, s, None if s == 3 else f"{c}/{s}") for c in (1, 2, None) for s in range(1, 7)]


def test_appends_equal_one_chain(spark, store):
    for part in ((1, 2), (3, 3), (4, 6)):
        store = ls.append(store, rows_for(spark, [r for r in ALL if part[0] <= r[1] <= part[1]] + ([(9, 1, "new")] if part[0] == 4 else [])))
    again = ls.open_ledger(spark, store.path)
    assert again.version == 3 and again.commits == store.commits
    assert content(again.records()) == content(led.chain(rows_for(spark, [*ALL, (9, 1, "new")])))
    ends = {r.chain: (r.seq, r.hash) for r in again.tails().collect()}
    assert set(ends) == {1, 2, None, 9} and ends[9][0] == 1 and ends[None][0] == 6
    assert led.verify(again.records()).where("reason is not null").count() == 0


def test_delta_writes_nothing(spark, store):
    store = ls.append(store, rows_for(spark, [(1, 1, "a")]))
    out = ls.delta(store, rows_for(spark, [(1, 2, "b")])).first()
    assert out.prev == hashlib.sha256(f"{led.GENESIS}|a".encode()).hexdigest() and ls.open_ledger(spark, store.path).records().count() == 1


def test_full_tails_are_written_now_and_then(spark, store, monkeypatch):
    monkeypatch.setattr(ls, "FULL_TAILS", 2)
    for s in range(1, 4):
        store = ls.append(store, rows_for(spark, [(s % 2, (s + 1) // 2, "x")]))
    assert [c["full"] for c in store.commits] == [False, True, False]
    assert sorted((r.chain, r.seq) for r in store.tails().collect()) == [(0, 1), (1, 2)]


def test_stale_tails_are_refused(spark, store):
    store = ls.append(store, rows_for(spark, [(1, 1, "a")]))
    later = ls.append(store, rows_for(spark, [(1, 2, "b")]))
    with pytest.raises(ls.StaleTail):
        ls.append(store, rows_for(spark, [(1, 2, "c")]))
    assert content(ls.open_ledger(spark, store.path).records()) == content(later.records())
    with pytest.raises(ls.RefusedAppend, match="don't follow"):  # read again, the record no longer fits
        ls.append(later, rows_for(spark, [(1, 2, "c")]))


def test_of_appends_at_once_one_wins(spark, store):
    results = []

    def run(i):
        try:
            ls.append(store, rows_for(spark, [(i, 1, "x")]))
            results.append(i)
        except ls.StaleTail:
            pass

    threads = [threading.Thread(target=run, args=(i,)) for i in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert [r.chain for r in ls.open_ledger(spark, store.path).records().collect()] == results and len(results) == 1


@pytest.mark.parametrize("new", [[(1, 1, "a")], [(1, 3, "a")], [(1, 2, "a"), (1, 2, "b")], [(1, 2, "a"), (1, 4, "b")], [(7, 2, "a")], [(1, None, "a")]])
def test_records_must_follow(spark, store, new):
    store = ls.append(store, rows_for(spark, [(1, 1, "a")]))
    with pytest.raises(ls.RefusedAppend):
        ls.append(store, rows_for(spark, new))
    assert ls.open_ledger(spark, store.path).version == 1


@pytest.mark.parametrize("change", ["payload = concat(payload, '!')", "hash = null", "drop last", "drop all", "drop first"])
def test_tampered_ledgers_are_refused(spark, store, change):
    """Records changed, cut off or removed under a ledger stop appends to their chain, not to others."""
    store = ls.append(store, rows_for(spark, [(c, s, "p") for c in (1, 2) for s in (1, 2, 3)]))
    mine = F.col("chain") == 1
    rows = store.records()
    if change.startswith("drop"):
        rows = rows.where({"drop last": ~(mine & (F.col("seq") == 3)), "drop first": ~(mine & (F.col("seq") == 1)), "drop all": ~mine}[change])
    else:
        name, value = change.split(" = ")
        rows = rows.withColumn(name, F.when(mine & (F.col("seq") == 2), F.expr(value)).otherwise(F.col(name)))
    other = f"{store.path}/changed"
    rows.write.parquet(other)
    changed = ls.Ledger(spark, store.path, 1, ({**store.commits[0], "records": other},))
    with pytest.raises(ls.RefusedAppend):
        ls.append(changed, rows_for(spark, [(1, 4, "q")]))
    assert ls.append(changed, rows_for(spark, [(2, 4, "q")])).version == 2


def test_lost_versions_are_noticed(spark, store):
    for s in (1, 2):
        store = ls.append(store, rows_for(spark, [(1, s, "p")]))
    place, fs = ls.file_system(spark, f"{store.path}/manifest/000000001.json")
    fs.delete(place, False)
    with pytest.raises(ls.RefusedAppend, match="missing"):
        ls.open_ledger(spark, store.path)


def test_null_payloads_and_missing_hashes(spark):
    """A null payload is an empty one for the writer and the reader; a record without a hash is refused for that."""
    chained = led.chain(rows_for(spark, [(1, 1, "a"), (1, 2, None), (1, 3, "c")]))
    assert led.verify(chained).first()["reason"] is None
    lost = chained.withColumn("hash", F.when(F.col("seq") != 2, F.col("hash")))
    assert tuple(led.verify(lost).first())[2:] == (2, "missing hash")


def test_gaps_of_one_chain_over_many_partitions(spark):
    """Places by prefix counts equal those of a sort, with repeated, lost, null and negative numbers."""
    d = random.Random(5)
    rows = [(c, s) for c in (1, None) for s in [*range(-2 * (c or 0), 400), *[d.randrange(400) for _ in range(3 * (c or 0))], *[None] * (c or 0)] if s is None or c is None or s % 97]
    got = {r.chain: (r.first_gap, r.n_bad) for r in led.sequence_gaps(spark.createDataFrame(rows, "chain long, seq long").repartition(11)).collect()}
    for c in (1, None):
        own = sorted((s for k, s in rows if k == c), key=lambda s: (s is not None, s or 0))
        bad = []
        for s in set(own):
            places = [i + 1 for i, x in enumerate(own) if x == s]
            bad += [p for p in places if p != s]
        assert got[c] == (min(bad), len(bad))


# --- streams


def folder_stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_ledger_stream_over_batches_and_restarts(spark, tmp_path):
    """Each folder of input is drained by a query of its own from one checkpoint: state and output go on, nothing twice."""
    path, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = "k int, z string, hash string"
    batches = [[(1, "z", "h2"), (1, "z", "h1"), (2, "z", "h1"), (2, "z", "h1")], [(1, "z", "h1"), (1, "z", "h2"), (3, "y", "h9"), (1, "y", "h2")], [(3, "y", "h9"), (2, "z", "h0"), (3, "y", None)]]
    want = [[(1, "z", "h1", "append"), (1, "z", "h2", "conflict"), (2, "z", "h1", "append")], [(1, "y", "h2", "append"), (1, "z", "h1", "skip"), (1, "z", "h2", "conflict"), (3, "y", "h9", "append")], [(2, "z", "h0", "conflict"), (3, "y", "h9", "skip")]]
    seen = []
    for rows, expected in zip(batches, want, strict=True):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        stored = st.run_available(st.append_once(folder_stream(spark, path, schema), ["k", "z"]), "once", out=out, state=state)
        seen += expected
        assert sorted(map(tuple, stored.collect())) == sorted(seen)
    again = st.run_available(st.append_once(folder_stream(spark, path, schema), ["k", "z"]), "once", out=out, state=state)
    assert again.count() == len(seen)  # a restart without new input adds nothing


def test_a_call_of_the_ledger_processor_takes_a_bucket_of_keys():
    """Thousands of keys in chunks go through one call, which asks the map once for each and writes only new ones."""

    class Map(dict):
        asked = 0

        def getValue(self, k):  # noqa: N802 - name of the interface
            self.asked += 1
            return self.get(k)

        updateValue = dict.__setitem__  # noqa: N815 - name of the interface

    kept = Map()
    own = st.Once(StructType().add("k0", "long"))
    own.init(SimpleNamespace(getMapState=lambda *_: kept))
    for batch in (0, 1):
        rows = pd.DataFrame([(k, f"h{i + batch}") for k in range(3000) for i in (1, 0, 1)], columns=["k0", "hash"])
        out = pd.concat(own.handleInputRows((5,), iter([rows[:4000], rows[4000:]]), None))
        assert kept.asked == 3000 * (batch + 1) and len(out) == 6000
        assert dict(out.groupby(["hash", "action"]).size()) == ({("h0", "append"): 3000, ("h1", "conflict"): 3000} if not batch else {("h1", "conflict"): 3000, ("h2", "conflict"): 3000})
    assert kept == {(k,): ("h0",) for k in range(3000)}


def test_ledger_stream_deals_keys_of_all_types_into_buckets(spark, tmp_path):
    path, schema = str(tmp_path / "in"), "a long, b date, c timestamp, d decimal(9,2), e boolean, f double, hash string"
    key = ["a", "b", "c", "d", "e", "f"]
    rows = spark.range(5000).selectExpr("id + 9000000000 as a", "date_add(date'2020-01-01', cast(id % 90 as int)) as b", "timestamp'2020-03-29 00:30:00.123456' + make_interval(0, 0, 0, 0, cast(id % 9 as int)) as c", "cast(id / 4 as decimal(9,2)) as d", "id % 2 = 0 as e", "id / 3 as f", "'x' as hash")
    for own in (rows, rows.where("a % 2 = 0").withColumn("hash", F.when(F.col("a") % 3 == 0, "y").otherwise("x"))):
        own.coalesce(1).write.mode("append").parquet(path)
    out = st.run_available(st.append_once(folder_stream(spark, path, schema), key), "once")
    plan = st.append_once(folder_stream(spark, path, schema), key)._jdf.queryExecution().analyzed().toString()
    assert "bucket" in plan[plan.index("TransformWithState") :]
    want = rows.selectExpr(*key, "'append' as action").union(rows.where("a % 2 = 0").selectExpr(*key, "if(a % 3 = 0, 'conflict', 'skip') as action"))
    assert out.select(*key, "action").exceptAll(want).isEmpty() and want.count() == out.count()


def test_late_rows_over_batches(spark, tmp_path):
    path, schema = str(tmp_path / "in"), "id int, ts timestamp"
    for rows in ([(1, "2020-01-10")], [(2, "2020-01-01"), (3, "2020-01-09")], [(4, "2020-01-20"), (5, "2020-01-08")], [(6, "2020-01-16"), (7, "2020-01-18")], [(8, None)], [(9, "2020-01-01")]):
        spark.createDataFrame(rows, "id int, ts string").select("id", F.col("ts").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(path)
    out = st.split_late(folder_stream(spark, path, schema), spark, "late", "3 days")
    assert {r.id: r.late for r in out.collect()} == {1: False, 2: True, 3: False, 4: False, 5: False, 6: True, 7: False, 8: False, 9: True}
