"""Source and sink queries: tables derived from the given ones are written in a format and read back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from epiweave.operators import ledgers as led
from epiweave.sources import files
from epiweave.sources import ledger_store as ls
from epiweave.sources import series_store as ss
from epiweave.sources.shared import shared_dir

from .bindings import WEEK, bucket, ledger, panel, sql_bucket, with_
from .q_board import _BOARD, board, updates
from .q_ledgers import _CHAINED, _RANKED
from .registry import query

K = ["k"]
_B = sql_bucket("CAST(k AS VARCHAR)", "CAST(epi_year AS VARCHAR)", "CAST(epi_week AS VARCHAR)")


def _b():
    return bucket(*(F.col(c).cast("string") for c in ("k", *WEEK)))


@query("src_series", with_("panel", f"SELECT k, epi_year, epi_week, CASE WHEN {_B} % 9 = 0 THEN 0 ELSE confirmed END AS confirmed FROM panel"))
def series(spark, d):
    path = shared_dir(spark, "series")
    panel(spark, d).withColumn("confirmed", F.when(_b() % 9 > 0, F.col("confirmed"))).write.csv(path, header=True)
    return files.read_series(spark, path, "k int, epi_year int, epi_week int, confirmed long")


@query("src_state_sitrep", with_("panel_nation", "SELECT epi_year, epi_week, count(*) AS n_states FROM panel_nation GROUP BY 1, 2 HAVING count(*) <> 25"))
def sitrep(spark, d):
    path = shared_dir(spark, "sitreps")
    rows = panel(spark, d, "n_nationkey")
    key = F.format_string("%d-W%02d", *WEEK)
    rows.select(F.col("k").cast("string").alias("state"), F.col("confirmed").cast("int").alias("confirmed_cases"), F.lit(0).alias("deaths"), key.alias("week")).repartition("week").write.partitionBy("week").csv(path, header=True)
    return files.read_sitreps(spark, f"{path}/*", expected=25)[1]


@query("src_ledger_jsonl", "SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1")
def ledger_jsonl(spark, d):
    path = shared_dir(spark, "jsonl")
    spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role").write.json(path)
    lines = files.read_ledger_lines(spark, path)
    return lines.select(F.get_json_object("raw", "$.conv_id").cast("long").alias("conv_id")).groupBy("conv_id").agg(F.count("*").alias("n"))


@query("src_json_doc", with_("panel", "SELECT k, epi_year, epi_week, confirmed FROM panel"))
def json_doc(spark, d):
    path = shared_dir(spark, "json")
    rows = panel(spark, d).groupBy("k", "epi_year").agg(F.collect_list(F.struct("k", *WEEK, "confirmed")).alias("forecasts"))
    rows.select("forecasts", F.col("k").alias("place"), F.col("epi_year").alias("year")).write.partitionBy("place", "year").json(path)  # a document a file
    return files.read_json_array(spark, path, "forecasts", "forecasts array<struct<k: int, epi_year: int, epi_week: int, confirmed: bigint>>")


_LINES = "SELECT epi_year, string_agg(line, chr(10) ORDER BY line) || chr(10) AS content FROM (SELECT epi_year, concat_ws(',', CAST(k AS VARCHAR), CAST(epi_year AS VARCHAR), CAST(epi_week AS VARCHAR), CAST(confirmed AS VARCHAR)) AS line FROM panel) GROUP BY 1"


def _lines(spark, d):
    return panel(spark, d).select("epi_year", F.concat_ws(",", *(F.col(c).cast("string") for c in ("k", *WEEK, "confirmed"))).alias("line"))


def _year_files(spark, d, name):
    """A text file a year, its lines in order; (epi_year, sha256, length) of the files."""
    path = shared_dir(spark, name)
    _lines(spark, d).repartition("epi_year").sortWithinPartitions("epi_year", "line").write.partitionBy("epi_year").text(path)
    return files.file_hashes(spark, f"{path}/*/*.txt").select(F.regexp_extract("path", r"epi_year=(\d+)", 1).cast("int").alias("epi_year"), "sha256", "length")


@query("src_files_binary", with_("panel", "SELECT epi_year, sha256(content) AS sha256, length(content) AS length FROM f", f=_LINES))
def files_binary(spark, d):
    return _year_files(spark, d, "binary")


@query("led_manifest_drift", with_("panel", "SELECT 'year-' || epi_year AS name, 'drifted' AS status FROM f WHERE epi_year % 2 = 0 UNION ALL SELECT 'year-0', 'missing'", f=_LINES))
def manifest_drift(spark, d):
    """The files against a manifest of hashes made from the table: those of even years are stale, and one file is gone."""
    now = _year_files(spark, d, "manifest").select(F.concat(F.lit("year-"), F.col("epi_year")).alias("name"), "sha256")
    listed = _lines(spark, d).groupBy("epi_year").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    content = F.concat(F.array_join("lines", "\n"), F.when(F.col("epi_year") % 2 == 0, "stale").otherwise("\n"))
    manifest = listed.select(F.concat(F.lit("year-"), F.col("epi_year")).alias("name"), F.sha2(content, 256).alias("sha256"))
    gone = spark.range(1).select(F.lit("year-0").alias("name"), F.lit("0").alias("sha256"))
    return led.manifest_drift(now, manifest.unionByName(gone))


@query("snk_series_append", with_("panel", "SELECT k, epi_year, count(*) AS n, CAST(sum(confirmed) AS BIGINT) AS confirmed, max(running) AS highest FROM (SELECT *, CAST(sum(confirmed) OVER (PARTITION BY k ORDER BY epi_year, epi_week ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS BIGINT) AS running FROM panel) GROUP BY 1, 2"))
def series_append(spark, d):
    """A bucketed store filled by two appends that overlap, then read by a window that needs no exchange."""
    rows = panel(spark, d)
    store = ss.open_series(spark, shared_dir(spark, "series-store"), "k int, epi_year int, epi_week int, confirmed bigint", K, 8)
    ss.append(store, rows.where("epi_year < 1999"))
    ss.append(store, rows.where("epi_year >= 1997"))
    four = F.sum("confirmed").over(Window.partitionBy("k").orderBy(*WEEK).rowsBetween(-3, 0))
    return store.read().withColumn("running", four).groupBy("k", "epi_year").agg(F.count("*").alias("n"), F.sum("confirmed").alias("confirmed"), F.max("running").alias("highest"))


@query("snk_ledger_append", with_("ledger", "SELECT chain, count(*) AS n, arg_max(hash, r) AS last, 3 AS version FROM chained GROUP BY 1", ranked=_RANKED, chained=_CHAINED).replace("WITH ", "WITH RECURSIVE ", 1))
def ledger_append(spark, d):
    """Three appends, each from the stored tails: the first records of every chain, those up to the fourth, the rest."""
    store = ls.open_ledger(spark, shared_dir(spark, "ledger"))
    rows = ledger(spark, d)
    for part in ("seq = 1", "seq between 2 and 4", "seq > 4"):
        store = ls.append(store, rows.where(part))
    store = ls.open_ledger(spark, store.path)
    last = F.max(F.struct("seq", "hash"))["hash"]
    return store.records().groupBy("chain").agg(F.count("*").alias("n"), last.alias("last")).withColumn("version", F.lit(store.version))


@query("snk_upsert", with_("", "SELECT state, count(*) AS n, round(sum(score), 3) AS total FROM m GROUP BY 1", **_BOARD))
def upsert(spark, d):
    path = shared_dir(spark, "board")
    files.upsert(board(spark, d), updates(spark, d), ["object_id", "object_type"], path, apply=True)
    return spark.read.parquet(path).groupBy("state").agg(F.count("*").alias("n"), F.round(F.sum("score"), 3).alias("total"))
