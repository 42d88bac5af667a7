"""Ledger queries: chains over conversations, outcomes over the region panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from epiweave.functions import calendar as cal
from epiweave.operators import ledgers as led

from .bindings import CTES, MONDAY, WEEK, bucket, ledger, panel, read, sql_bucket, with_
from .q_lags import guard as guarded
from .registry import ORACLE_SQL, query

K = ["k"]
_RANKED = "SELECT *, row_number() OVER (PARTITION BY chain ORDER BY seq, payload) AS r FROM ledger"
_CHAINED = f"""SELECT chain, seq, payload, r, '{led.GENESIS}' AS prev, sha256('{led.GENESIS}' || '|' || coalesce(payload, '')) AS hash FROM ranked WHERE r = 1
    UNION ALL SELECT n.chain, n.seq, n.payload, n.r, c.hash, sha256(c.hash || '|' || coalesce(n.payload, '')) FROM chained c JOIN ranked n ON n.chain = c.chain AND n.r = c.r + 1"""


def _recursive(body: str, **more: str) -> str:
    return with_("", body, **_HOLES, ranked=_RANKED, chained=_CHAINED, **more).replace("WITH ", "WITH RECURSIVE ", 1)


_B = sql_bucket("'bad'", "CAST(chain AS VARCHAR)", "CAST(seq AS VARCHAR)")
_LEDGER = CTES["ledger"][0].replace("AS payload FROM", "AS payload0 FROM")
_HOLES = {"ledger0": _LEDGER, "ledger": f"SELECT chain, seq, CASE WHEN {_B} % 19 <> 7 THEN payload0 END AS payload FROM ledger0"}
_TAMPERED = f"""SELECT chain, seq, CASE WHEN {_B} % 29 = 0 THEN coalesce(payload, '') || '!' ELSE payload END AS payload, prev,
    CASE WHEN {_B} % 41 = 3 THEN NULL WHEN {_B} % 31 = 1 THEN sha256(prev || '|' || coalesce(payload, '') || '?') ELSE hash END AS hash FROM chained WHERE {_B} % 37 <> 2"""


def _bad():
    return bucket(F.lit("bad"), F.col("chain").cast("string"), F.col("seq").cast("string"))


def with_holes(spark, d):
    """The ledger with some payloads null."""
    return ledger(spark, d).withColumn("payload", F.when(_bad() % 19 != 7, F.col("payload")))


def tampered(spark, d):
    """Some records are lost, some changed, some forged, and some have lost their hash."""
    rows = led.chain(with_holes(spark, d)).withColumn("b", _bad()).where("b % 37 <> 2")
    payload = F.coalesce("payload", F.lit(""))
    forged = F.sha2(F.concat(F.col("prev"), F.lit("|"), payload, F.lit("?")), 256)
    hash_ = F.when(F.col("b") % 41 != 3, F.when(F.col("b") % 31 == 1, forged).otherwise(F.col("hash")))
    return rows.withColumns({"hash": hash_, "payload": F.when(F.col("b") % 29 == 0, F.concat(payload, F.lit("!"))).otherwise(F.col("payload"))}).drop("b")


@query("led_record_hash", """SELECT conv_id AS chain, turn + 1 AS seq, sha256('{"chars":{"n":' || coalesce(length(text), 0) || ',"of":"' || coalesce(role, '') || '"},"place":"é","role":"' || coalesce(role, '') || '","share":' || CAST(turn AS VARCHAR) || '.5,"turn":' || turn || '}') AS hash FROM conversations""")
def record_hash(spark, d):
    """Records as JSON lines with keys in no order, blanks, a nested object and their own hash field."""
    rows = read(spark, d, "conversations")
    role, n = F.to_json(F.struct(F.coalesce("role", F.lit("")).alias("r"))).substr(6, 10**6), F.coalesce(F.length("text"), F.lit(0))
    role = F.regexp_replace(role, r"\}$", "")
    raw = F.format_string('{"turn": %d, "share" : %d.5, "record_sha256": "old", "place":"\\u00e9", "role": %s, "chars": {"of": %s,"n":%d}}', "turn", "turn", role, role, n)
    return led.canonical_hash(rows.select(F.col("conv_id").alias("chain"), (F.col("turn") + 1).alias("seq"), raw.alias("raw"))).select("chain", "seq", "hash")


@query("led_chain", _recursive("SELECT chain, seq, prev, hash FROM chained"))
def chain(spark, d):
    return led.chain(with_holes(spark, d)).select("chain", "seq", "prev", "hash")


@query("led_verify", _recursive(f"""SELECT chain, count(*) AS records, min(seq) FILTER (WHERE reason IS NOT NULL) AS first_bad_seq, arg_min(reason, seq) FILTER (WHERE reason IS NOT NULL) AS reason FROM (
    SELECT *, CASE WHEN row_number() OVER w <> seq THEN 'sequence' WHEN hash IS NULL THEN 'missing hash' WHEN prev IS DISTINCT FROM CASE WHEN seq = 1 THEN '{led.GENESIS}' ELSE lag(hash) OVER w END THEN 'broken link' WHEN sha256(prev || '|' || coalesce(payload, '')) <> hash THEN 'altered record' END AS reason FROM tampered WINDOW w AS (PARTITION BY chain ORDER BY seq)) GROUP BY chain""", tampered=_TAMPERED))
def verify(spark, d):
    return led.verify(tampered(spark, d))




def _json_sql(prev: str, r: str = "") -> str:
    """A record's canonical JSON without its own hash."""
    return f"""'{{"chars":' || {r}n || ',"previous_sha256":' || {prev} || ',"role":"' || {r}role || '","turn":' || {r}seq || '}}'"""


_JRANKED = "SELECT conv_id AS chain, turn + 1 AS seq, role, length(text) AS n FROM conversations"
_PREV = """'"' || c.hash || '"'"""
_JCHAINED = f"""SELECT chain, seq, role, n, CAST(NULL AS VARCHAR) AS prev, sha256({_json_sql("'null'")}) AS hash FROM jranked WHERE seq = 1
    UNION ALL SELECT r.chain, r.seq, r.role, r.n, c.hash, sha256({_json_sql(_PREV, "r.")}) FROM jchained c JOIN jranked r ON r.chain = c.chain AND r.seq = c.seq + 1"""
_JB = sql_bucket("'json'", "CAST(chain AS VARCHAR)", "CAST(seq AS VARCHAR)")


@query("led_verify_json", "WITH RECURSIVE jranked AS (" + _JRANKED + "), jchained AS (" + _JCHAINED + f"""), jt AS (SELECT *, {_JB} AS b FROM jchained WHERE {_JB} % 37 <> 2)
    SELECT chain, count(*) AS records, min(seq) FILTER (WHERE reason IS NOT NULL) AS first_bad_seq, arg_min(reason, seq) FILTER (WHERE reason IS NOT NULL) AS reason FROM (
    SELECT *, CASE WHEN row_number() OVER w <> seq THEN 'sequence' WHEN prev IS DISTINCT FROM lag(hash) OVER w THEN 'broken link' WHEN b % 29 = 0 THEN 'altered record' END AS reason FROM jt WINDOW w AS (PARTITION BY chain ORDER BY seq)) GROUP BY chain""")
def verify_json(spark, d):
    """A ledger of JSON lines with embedded hashes and null at the start; some lines are lost, some altered."""
    text = F.coalesce(F.length("text"), F.lit(0))
    rows = read(spark, d, "conversations").select(F.col("conv_id").alias("chain"), (F.col("turn") + 1).alias("seq"), F.to_json(F.struct((F.col("turn") + 1).alias("turn"), "role", text.alias("chars"))).alias("payload"))
    b = bucket(F.lit("json"), F.col("chain").cast("string"), F.col("seq").cast("string"))
    lines = led.chain_json(rows, "record_sha256", "previous_sha256").withColumn("b", b).where("b % 37 <> 2")
    lines = lines.withColumn("raw", F.when(F.col("b") % 29 == 0, F.regexp_replace("raw", '"chars":', '"chars":9')).otherwise(F.col("raw"))).drop("b")
    return led.verify_json(lines, "record_sha256", "previous_sha256")


@query("led_sequence", _recursive("SELECT chain, min(e) AS first_gap, count(*) AS n_bad FROM (SELECT chain, seq, row_number() OVER (PARTITION BY chain ORDER BY seq) AS e FROM tampered) WHERE seq <> e GROUP BY chain", tampered=_TAMPERED))
def sequence(spark, d):
    return led.sequence_gaps(tampered(spark, d))


_P = sql_bucket("CAST(k AS VARCHAR)", "CAST(epi_year AS VARCHAR)", "CAST(epi_week AS VARCHAR)")
_REC = "sha256(concat_ws('|', CAST(k AS VARCHAR), CAST(epi_year AS VARCHAR), CAST(epi_week AS VARCHAR), CAST(confirmed AS VARCHAR)))"


def _records(rows):
    return rows.select("k", *WEEK, F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in ("k", *WEEK, "confirmed"))), 256).alias("hash"))


def _b():
    return bucket(*(F.col(c).cast("string") for c in ("k", *WEEK)))


@query("led_idempotent", with_("panel", f"SELECT n.k, n.epi_year, n.epi_week, n.hash, CASE WHEN o.hash IS NULL THEN 'append' WHEN o.hash = n.hash THEN 'skip' ELSE 'conflict' END AS action FROM n LEFT JOIN o ON o.k = n.k AND o.epi_year = n.epi_year AND o.epi_week = n.epi_week", n=f"SELECT k, epi_year, epi_week, {_REC} AS hash FROM panel", o=f"SELECT k, epi_year, epi_week, {_REC} AS hash FROM (SELECT * REPLACE (CASE WHEN {_P} % 7 = 0 THEN confirmed + 1 ELSE confirmed END AS confirmed) FROM panel WHERE epi_year < 2000)"))
def idempotent(spark, d):
    new = panel(spark, d)
    old = new.where("epi_year < 2000").withColumn("confirmed", F.when(_b() % 7 == 0, F.col("confirmed") + 1).otherwise(F.col("confirmed")))
    return led.idempotent(_records(old), _records(new), ["k", *WEEK])


_PROB = "CAST(confirmed AS DOUBLE) / (confirmed + 8)"
_OUT = {
    "fc": f"SELECT k, epi_year, epi_week, {_PROB} AS p, {MONDAY} AS m FROM panel WHERE epi_week % 2 = 0",
    "w": f"SELECT k, {MONDAY} AS m, epi_year, epi_week, confirmed FROM panel WHERE {_P} % 23 <> 0",
    "tg": "SELECT k, epi_year, epi_week, p, CAST(m + 7 + 7 * i AS DATE) AS day FROM fc, (SELECT CAST(range AS INTEGER) AS i FROM range(4))",
    "oc": """SELECT t.k, t.epi_year, t.epi_week, p, count(confirmed) AS n_found, CAST(CASE WHEN count(confirmed) = 4 THEN sum(confirmed) END AS BIGINT) AS burden,
        coalesce(string_agg(CASE WHEN confirmed IS NULL THEN isoyear(day) || '-W' || lpad(CAST(week(day) AS VARCHAR), 2, '0') END, ',' ORDER BY day), '') AS missing,
        coalesce(string_agg(CASE WHEN confirmed IS NOT NULL THEN isoyear(day) || '-W' || lpad(CAST(week(day) AS VARCHAR), 2, '0') || '=' || confirmed END, ',' ORDER BY day), '') AS snapshot FROM tg t LEFT JOIN w ON w.k = t.k AND w.m = t.day GROUP BY 1, 2, 3, 4""",
}


def _outcomes(spark, d):
    rows = panel(spark, d)
    fc = rows.where("epi_week % 2 = 0").select("k", *WEEK, (F.col("confirmed") / (F.col("confirmed") + 8)).alias("p"))
    return led.outcomes(fc, rows.where(_b() % 23 != 0), K, threshold=32)


@query("led_outcome_join", with_("panel", "SELECT k, epi_year, epi_week, round(p, 6) AS p, burden, burden > 32 AS was_elevated, (p >= 0.5) = (burden > 32) AS correct FROM oc WHERE n_found = 4", **_OUT))
def outcome_join(spark, d):
    return _outcomes(spark, d).where("n_found = 4").select("k", *WEEK, F.round("p", 6).alias("p"), "burden", "was_elevated", "correct")


@query("led_outcome_missing", with_("panel", "SELECT k, epi_year, epi_week, missing FROM oc WHERE n_found < 4", **_OUT))
def outcome_missing(spark, d):
    return _outcomes(spark, d).where("n_found < 4").select("k", *WEEK, "missing")


@query("led_source_snapshot", with_("panel", "SELECT k, epi_year, epi_week, snapshot FROM oc WHERE n_found = 4", **_OUT))
def source_snapshot(spark, d):
    return _outcomes(spark, d).where("n_found = 4").select("k", *WEEK, "snapshot")


@query("led_outcome_dup", with_("panel", "SELECT k, epi_year, epi_week, burden FROM oc WHERE n_found = 4 AND epi_year >= 1999", **_OUT))
def outcome_dup(spark, d):
    rows = _outcomes(spark, d).where("n_found = 4").select("k", *WEEK, "burden")
    return led.without_outcome(rows, rows.where("epi_year < 1999"), ["k", *WEEK])


@query("led_scoreable", with_("panel", "SELECT k, epi_year, epi_week, round(p, 6) AS p, burden FROM oc WHERE n_found = 4 AND epi_year * 100 + epi_week BETWEEN 199845 AND 199917", **_OUT))
def scoreable(spark, d):
    rows = _outcomes(spark, d).where("n_found = 4")
    return rows.where(cal.in_window(*WEEK, 199845, 199917)).select("k", *WEEK, F.round("p", 6).alias("p"), "burden").orderBy("k", *WEEK)


_GUARD = ORACLE_SQL["elig_guard"]


@query("led_refusals", f"SELECT k, coalesce(reason, 'eligible') AS reason, count(*) AS n FROM ({_GUARD}) GROUP BY 1, 2")
def refusals(spark, d):
    return led.refusals(guarded(spark, d), K)


@query("led_contract_check", with_("panel", f"SELECT k, epi_year, epi_week, concat_ws(',', CASE WHEN version <> 'v1' THEN 'model_version' END, CASE WHEN threshold <> 32 THEN 'threshold' END, CASE WHEN horizon <> 4 THEN 'horizon' END, CASE WHEN missing THEN 'comparators' END, CASE WHEN p IS NULL THEN 'probability' END) AS violations FROM (SELECT k, epi_year, epi_week, CASE WHEN {_P} % 17 = 0 THEN 'v2' ELSE 'v1' END AS version, CASE WHEN {_P} % 19 = 0 THEN 33 ELSE 32 END AS threshold, CASE WHEN {_P} % 23 = 0 THEN 5 ELSE 4 END AS horizon, CASE WHEN {_P} % 13 > 0 THEN {_PROB} END AS p, {_P} % 29 = 0 AS missing FROM panel)"))
def contract_check(spark, d):
    b, names = _b(), F.array(*map(F.lit, ("recent4", "lag1", "seasonal", "seasonal_persist")))
    rec = panel(spark, d).select("k", *WEEK, F.when(b % 17 == 0, "v2").otherwise("v1").alias("version"), F.when(b % 19 == 0, 33).otherwise(32).alias("threshold"), F.when(b % 23 == 0, 5).otherwise(4).alias("horizon"), F.when(b % 13 > 0, F.col("confirmed") / (F.col("confirmed") + 8)).alias("p"), F.when(b % 29 == 0, F.slice(names, 1, 3)).otherwise(names).alias("names"))
    rules = {"model_version": F.col("version") == "v1", "threshold": F.col("threshold") == 32, "horizon": F.col("horizon") == 4, "comparators": F.array_sort("names") == F.array_sort(names), "probability": F.col("p").isNotNull()}
    return led.contract_violations(rec, rules).select("k", *WEEK, "violations")


@query("led_study_filter", "SELECT user_id, event_type AS study, event_type = 'click' AS accepted, count(*) AS n FROM events GROUP BY 1, 2")
def study_filter(spark, d):
    rows = read(spark, d, "events").select("user_id", F.col("event_type").alias("study"))
    return led.by_study(rows, "study", "click").groupBy("user_id", "study", "accepted").agg(F.count("*").alias("n"))


@query("led_no_outcome_leak", "SELECT event_id, CASE WHEN props LIKE '%\"k\"%' THEN 'k' ELSE '' END AS leaked FROM events")
def no_outcome_leak(spark, d):
    return led.leaked_fields(read(spark, d, "events"), "props", ["k", "was_elevated", "burden"]).select("event_id", "leaked")
