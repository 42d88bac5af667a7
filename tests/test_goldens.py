"""Values printed in the domain's own documents, degenerate inputs, and properties that must hold."""

import datetime
import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from epiweave.functions import calendar as cal
from epiweave.functions import extract as ex
from epiweave.operators import clinical as cl
from epiweave.operators import curation as cur
from epiweave.operators import evaluation as ev
from epiweave.operators import features as fea
from epiweave.operators import lags as lg
from epiweave.operators import ledgers as led
from epiweave.operators import models as md
from epiweave.plans import bindings as b

LAGS = [9, 10, 10, 10, 10, 11, 11, 11, 11, 12, 12, 12, 12, 15, 15, 16, 17, 17, 17, 17, 18, 18, 18, 18, 19, 19, 19, 22, 22, 23, 24, 24, 26, 30, 37, 44]


def test_lag_statistics(spark):
    rows = spark.createDataFrame([("a", x) for x in LAGS], "k string, lag int")
    r = lg.lag_stats(rows, ["k"]).first()
    assert (r["n"], r["min"], r["median"], r["p75"], r["p90"], r["max"]) == (36, 9, 17, 19.75, 25, 44)
    assert round(r["mean"], 4) == 17.6667 and round(r["sd"], 4) == 7.7016
    got = {x["lead"]: x["eligible"] for x in lg.lag_coverage(rows, [1, 2, 3, 4, 5, 6], ["k"]).collect()}
    assert got == {1: 0, 2: 0, 3: 13, 4: 27, 5: 33, 6: 34}
    assert lg.choose_lead(lg.lag_coverage(rows, [2, 3, 4, 5, 6], ["k"]), ["k"], 0.9).first()["lead"] == 5


def test_reconciliation(spark):
    reports = spark.createDataFrame([("n", 2026, w, c) for w, c in ((36, 1086), (37, 1104), (38, 1115), (39, 1134), (40, 1138))], "k string, epi_year int, epi_week int, cum_confirmed int")
    told = spark.createDataFrame([("n", 2026, w, c) for w, c in ((37, 17), (38, 11), (39, 13), (40, 3))], "k string, epi_year int, epi_week int, narrative int")
    got = {r["epi_week"]: (r["difference"], r["discrepancy"], r["status"]) for r in cur.reconcile(reports, told, ["k"]).collect()}
    assert got == {37: (18, 1, "differs"), 38: (11, 0, "agrees"), 39: (19, 6, "differs"), 40: (4, 1, "differs")}


def test_eligibility_windows(spark):
    weeks = spark.createDataFrame([(2026, w) for w in range(45, 54)] + [(2027, w) for w in range(1, 18)], "epi_year int, epi_week int")
    rows = {(r[0], r[1]): r for r in lg.windows(weeks, 1).collect()}
    assert len(rows) == 26
    assert rows[2026, 45]["window_start"] == datetime.date(2026, 11, 9) and rows[2026, 45]["window_end"] == datetime.date(2026, 12, 6) and rows[2026, 45]["last_loggable_day"] == datetime.date(2026, 11, 8)
    yields = {r["scenario"]: r["eligible"] for r in lg.scenarios(weeks, {"measured": 6, "typical": 17}, lead=1).collect()}
    assert yields == {"measured": 0, "typical": 0}


def test_guard_refuses(spark):
    cases = [
        (2026, 36, "2026-09-27T23:59:59Z", None), (2026, 35, "2026-09-21T00:00:00Z", "target_already_started"), (2026, 37, "2026-10-04T23:59:59", "naive_timestamp_rejected"), (2025, 53, "2025-12-01T00:00:00Z", "malformed_source_week"),
        (2026, 53, "2027-01-01T00:00:00Z", None), (2026, 0, "2026-01-01T00:00:00Z", "malformed_source_week"), (2026, 54, "2026-01-01T00:00:00Z", "malformed_source_week"), (2026, 38, "2026-10-12T01:00:00+02:00", None),
    ]
    rows = spark.createDataFrame([("a", y, w, t) for y, w, t, _ in cases], "k string, epi_year int, epi_week int, issued_at string")
    got = {(r["epi_year"], r["epi_week"], r["issued_at"]): r["reason"] for r in lg.guard(rows, ["k"], lead=4).collect()}
    assert got == {(y, w, t): reason for y, w, t, reason in cases}
    twice = spark.createDataFrame([("a", 2026, 36, "2026-09-20T00:00:00Z"), ("a", 2026, 36, "2026-09-21T00:00:00Z")], rows.schema)
    assert sorted(str(r["reason"]) for r in lg.guard(twice, ["k"], lead=4).collect()) == ["None", "duplicate_data_through_week"]
    with pytest.raises(TypeError):
        lg.guard(rows, ["k"])


def test_first_observation(spark):
    d = datetime.date
    rows = [("39", d(2026, 9, 27), d(2026, 10, 10), False), ("39", d(2026, 9, 27), d(2026, 10, 12), True), ("41", d(2026, 10, 11), d(2026, 10, 28), False)]
    got = {r["w"]: (r["lag_lower"], r["lag_upper"], r["open"]) for r in lg.first_observation(spark.createDataFrame(rows, "w string, week_end date, checked_on date, visible boolean"), ["w"]).collect()}
    assert got == {"39": (13, 15, False), "41": (17, None, True)}


@pytest.mark.parametrize(
    "given, low, high",
    [
        ({}, 5, 15), ({"headache": True, "myalgia": True}, 10, 25), ({"sore_throat": True, "chest_pain": True}, 30, 55), ({"sore_throat": True, "contact_confirmed_case": True}, 55, 80),
        ({"fever_temp": 39.8, "sore_throat": True, "chest_pain": True, "mucosal_bleeding": True, "contact_confirmed_case": True, "high_risk_lga": True, "duration": 10}, 85, 100),
        ({"fever_temp": 38.8, "rash": True, "rapid_onset": True, "headache": True}, 3, 20),
        ({"fever_temp": 38.7, "is_hcw": True, "household_illness": True, "high_risk_lga": True, "headache": True, "myalgia": True}, 25, 50),
    ],
)
def test_clinical_scenarios(spark, given, low, high):
    kinds = {f: "boolean" for f in b.FLAGS} | {"age": "int", "sex": "string", "fever_temp": "double", "duration": "int", "state": "string"}
    row = tuple(({"fever": True} | given).get(n) for n in kinds)
    df = cl.scored(spark.createDataFrame([row], ", ".join(f"{n} {t}" for n, t in kinds.items())))
    r = df.select("pct", cl.ranked().alias("r"), cl.points().alias("points")).first()
    assert low <= r["pct"] <= high
    assert [x["pct"] for x in r["r"]] == sorted((x["pct"] for x in r["r"]), reverse=True) and len(r["r"]) == 8


def test_report_fields(spark):
    text = "Epi Week: 36 2026\nCumulative 7938 1086 6 259 23.8%\nCumulative 1 2 3 4 5.0%\n12 States have recorded\nOndo reported 30% and Edo 22%"
    df = spark.createDataFrame([(text,), (None,), ("",), ("Epi Week 3 2020 only",)], "text string")
    r = df.select(*(c.alias(n) for n, c in (ex.header() | ex.cumulative()).items()), ex.states_affected().alias("states"), ex.state_shares().alias("shares")).collect()
    assert (r[0]["year"], r[0]["week"], r[0]["cum_suspected"], r[0]["cum_confirmed"], r[0]["cum_deaths"], r[0]["cfr"], r[0]["prior_confirmed"], r[0]["states"], r[0]["shares"]) == (2026, 36, 7938, 1086, 259, 23.8, 2, 12, "Ondo:30%; Edo:22%")
    assert r[1]["year"] is None and r[2]["cum_confirmed"] is None and r[3]["week"] == 3


def test_features_against_slices(spark):
    d = np.random.default_rng(1)
    counts = d.integers(0, 20, 40).tolist()
    rows = spark.createDataFrame([("a", 2000 + i // 52, i % 52 + 1, c) for i, c in enumerate(counts)], "k string, epi_year int, epi_week int, confirmed long")
    got = fea.future_sum(fea.vector(rows, ["k"]), ["k"]).orderBy("epi_year", "epi_week").collect()
    for i, r in enumerate(got):
        past = counts[max(0, i - 4) : i]
        assert r["lag4"] == (counts[i - 4] if i >= 4 else 0)
        assert abs(r["roll4"] - (sum(past) / len(past) if past else 0)) < 1e-12
        assert r["f4"] == (sum(counts[i + 1 : i + 5]) if i + 4 < len(counts) else None)
    with pytest.raises(Exception, match="threshold drifted"):
        fea.threshold(fea.future_sum(fea.vector(rows, ["k"]), ["k"]), ["k"], 2000, expected=-1.0).collect()


def test_auroc_and_reliability(spark):
    d = random.Random(3)
    rows = [("a", d.choice([0.1, 0.2, 0.5, 0.6, 0.9]), d.randint(0, 1)) for _ in range(60)] + [("one", 0.5, 1)]
    df = spark.createDataFrame(rows, "k string, score double, y int").withColumn("prob", F.col("score"))
    got = {r["k"]: r["auroc"] for r in ev.auroc(df, ["k"]).collect()}
    pos, neg = [s for k, s, y in rows if k == "a" and y], [s for k, s, y in rows if k == "a" and not y]
    assert abs(got["a"] - sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)) < 1e-12 and got["one"] is None
    assert sum(r["area"] for r in ev.roc_curve(df.where("k = 'a'"), ["k"]).collect()) == pytest.approx(got["a"])
    curve = {r["bin"]: r["n"] for r in ev.reliability(df.where("k = 'a'"), ["k"]).collect()}
    assert set(curve) == {1, 2, 3, 4, 5} and curve[4] == 0 and curve[3] == sum(s in (0.5, 0.6) for k, s, _ in rows if k == "a")


def test_verdict_order(spark):
    c = lambda x, t="double": F.lit(x).cast(t)
    cases = [((9, 4, 0.9, 0.5, -0.1, 0.1), "neutral_inconclusive_underpowered"), ((30, 30, 0.9, 0.5, -0.1, 0.1), "neutral_inconclusive_underpowered"), ((30, 9, 0.69, 0.5, -0.1, 0.1), "failure"), ((30, 9, 0.9, 0.5, -0.1, 0.1), "success"), ((30, 9, 0.9, 0.5, -0.1, None), "neutral")]
    for (n, p, a, best, delta, lo), want in cases:
        assert spark.range(1).select(ev.verdict_v1(c(n), c(p), c(a), c(best), c(delta), c(lo))).first()[0] == want


def test_chain_and_tampering(spark):
    rows = [(c, s, f"{c}/{s}") for c in range(5) for s in range(1, 9)]
    df = led.chain(spark.createDataFrame(rows, "chain long, seq long, payload string"))
    prev = led.GENESIS
    for r in df.where("chain = 3").orderBy("seq").collect():
        assert r["prev"] == prev
        prev = hashlib.sha256(f"{prev}|{r['payload']}".encode()).hexdigest()
        assert r["hash"] == prev
    assert led.verify(df).where("reason is not null").count() == 0
    bad = df.withColumn("payload", F.when((F.col("chain") == 2) & (F.col("seq") == 5), "x").otherwise(F.col("payload")))
    assert [tuple(r) for r in led.verify(bad).where("reason is not null").collect()] == [(2, 8, 5, "altered record")]
    lines = spark.createDataFrame([(json.dumps({"b": 1, "a": {"z": 1e-05, "y": "é"}, "h": "x"}),)], "raw string")
    assert led.canonical_json(lines, own=["h"]).first()["payload"] == '{"a":{"y":"é","z":1e-05},"b":1}'


def test_one_gap_for_a_removed_week(spark):
    rows = [("a", 2020, w, 10 * w) for w in range(1, 11)]
    schema = "k string, epi_year int, epi_week int, cum_confirmed int"
    assert cur.gap_report(spark.createDataFrame(rows, schema), ["k"], ["confirmed"]).count() == 0
    gaps = cur.gap_report(spark.createDataFrame([r for r in rows if r[2] != 5], schema), ["k"], ["confirmed"]).collect()
    assert [(r["epi_week"], r["reason"]) for r in gaps] == [(6, "missing predecessor")]


def test_iso_calendar(spark):
    days = [datetime.date(2018, 12, 25) + datetime.timedelta(days=i) for i in range(0, 3000, 5)]
    df = spark.createDataFrame([(d,) for d in days], "day date")
    got = df.select("day", cal.iso_year("day").alias("y"), cal.iso_week("day").alias("w")).withColumn("m", cal.monday("y", "w")).collect()
    assert all((r["y"], r["w"]) == r["day"].isocalendar()[:2] and r["m"] == datetime.date.fromisocalendar(r["y"], r["w"], 1) for r in got)
    assert spark.range(1).select(cal.monday(F.lit(2025), F.lit(53))).first()[0] is None


def test_platt_keeps_auroc_and_small_map(spark):
    d = np.random.default_rng(0)
    x = d.normal(size=400)
    y = (x + d.normal(size=400) > 0).astype(int)
    w = md.newton_logistic(x[:, None], y.astype(float))
    df = spark.createDataFrame([(float(a), int(c)) for a, c in zip(x, y, strict=True)], "s double, y int")
    model = md.fit_logistic(df, ["s"], 400)
    lr = model.stages[-1]
    assert abs(lr.intercept - w[0]) < 1e-3 and abs(lr.coefficients[0] - w[1]) < 1e-3
    out = md.apply(model, df).withColumn("k", F.lit(1))
    assert ev.auroc(out, ["k"], "p").first()["auroc"] == pytest.approx(ev.auroc(out, ["k"], "s").first()["auroc"])


def test_guard_refuses_what_it_cannot_read(spark):
    """Unreadable times are no forecasts; a second request is one by the instant, whatever its offset."""
    rows = [
        (1, 2026, 40, None), (2, 2026, 40, "rubbishZ"), (3, 2026, 40, "2026-10-01T10:00:00"), (4, 2026, 54, "2026-10-01T10:00:00Z"),
        (5, 2026, 38, "2026-09-20T01:00:00+05:00"), (5, 2026, 38, "2026-09-19T23:00:00Z"), (6, 2026, 38, "2026-09-28T00:00:00Z"), (7, 2026, 38, "2026-09-28T04:59:59+05:00"), (8, 2026, 38, "rubbishZ"), (8, 2026, 38, "2026-09-20T01:00:00Z"),
    ]
    df = spark.createDataFrame(rows, "id int, epi_year int, epi_week int, issued_at string")
    got = {(r["id"], r["issued_at"]): r["reason"] for r in lg.guard(df, ["id"], lead=2).collect()}
    assert got[1, None] == got[2, "rubbishZ"] == got[8, "rubbishZ"] == "malformed_timestamp" and got[3, "2026-10-01T10:00:00"] == "naive_timestamp_rejected"
    assert got[4, "2026-10-01T10:00:00Z"] == "malformed_source_week" and got[8, "2026-09-20T01:00:00Z"] is None
    assert got[5, "2026-09-20T01:00:00+05:00"] is None and got[5, "2026-09-19T23:00:00Z"] == "duplicate_data_through_week"
    assert got[6, "2026-09-28T00:00:00Z"] == "target_already_started" and got[7, "2026-09-28T04:59:59+05:00"] is None


def test_times_that_are_read(spark):
    """Forms of ISO 8601 with and without an offset against Python's reader, and what is no time."""
    good = ["2026-07-27T01:00Z", "2026-07-27T01:00:00+0000", "2026-07-27 01:00:00+00:00", "2026-07-27T01:00:00.25-03:30", "2026-07-27T01:00:00,250000+02", "2026-07-27T01:00", "2026-07-27 01:00:00", "2026-07-27", "2024-02-29T23:59:59z"]
    bad = ["", "rubbish", "2026-02-30T01:00Z", "2026-07-27T24:00Z", "2026-07-27T01:60Z", "2026-07-27T1:00Z", "20260727T0100Z", "2026-07-27T01:00 Z", "2026-07-27T01:00+1", "T01:00Z", None]
    df = spark.createDataFrame([(x,) for x in [*good, *bad]], "x string")
    instant, offset = lg.iso_time("x")
    got = {r.x: (r.t, r.o) for r in df.select("x", instant.cast("double").alias("t"), offset.alias("o")).collect()}
    assert all(got[x][0] is None for x in bad)
    for x in good:
        t = datetime.datetime.fromisoformat(x.replace("z", "Z"))
        assert got[x] == ((t if t.tzinfo else t.replace(tzinfo=datetime.timezone.utc)).timestamp(), t.tzinfo is not None), x


def test_json_ledger(spark):
    """One long chain of JSON lines against hashlib, whole and with a byte changed or a line lost."""
    n = 600
    rows = spark.createDataFrame([(None, i, json.dumps({"b": f"é{i}", "a": i})) for i in range(1, n + 1)], "chain long, seq long, payload string")
    lines = led.chain_json(rows, "own", "prev").collect()
    last = None
    for r in sorted(lines, key=lambda r: r["seq"]):
        record = json.loads(r["raw"])
        own = record.pop("own")
        assert record["prev"] == last and own == hashlib.sha256(json.dumps(record, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
        last = own
    def check(change, drop=0):
        made = [(r["chain"], r["seq"], change(r["raw"]) if r["seq"] == 321 else r["raw"]) for r in lines if r["seq"] != drop]
        r = led.verify_json(spark.createDataFrame(made, "chain long, seq long, raw string").repartition(7), "own", "prev").first()
        return r["records"], r["first_bad_seq"], r["reason"]
    assert check(lambda x: x) == (n, None, None) and check(lambda x: " " + x) == (n, None, None)
    assert check(lambda x: x.replace("é321", "e321")) == (n, 321, "altered record") and check(lambda x: x, 400) == (n - 1, 401, "sequence")


def test_chain_of_null_key_goes_on_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        rows = led.chain(spark.createDataFrame([(None, i, f"p{i}") for i in range(1, 8)], "chain long, seq long, payload string"))
        assert led.verify(rows).first()["first_bad_seq"] is None
        assert rows.where(F.col("prev") == led.GENESIS).count() == 1
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_curves_of_large_groups_equal_small_ones(spark):
    rows = [(g, random.Random(i).randrange(40) / 40, i % 3 == 0) for g in (1, 2, None) for i in range(300)]
    df = spark.createDataFrame([(g, s, int(y)) for g, s, y in rows], "g int, score double, y int")
    a, b = ({r["g"]: (round(r["auroc"], 9), r["n"]) for r in f(df, ["g"]).collect()} for f in (ev.auroc, ev.wide_auroc))
    assert a == b and len(a) == 3


def test_reliability_leaves_null_probabilities_out(spark):
    df = spark.createDataFrame([(1, None, 1), (1, 0.9, 1), (1, 0.1, 0)], "g int, prob double, y int")
    assert sum(r["n"] for r in ev.reliability(df, ["g"]).collect()) == 2
