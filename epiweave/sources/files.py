"""Readers and append-only writers for series, sitreps, ledgers, JSON documents and files to hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epiweave.operators import board as bd
from epiweave.operators import curation as cur

SERIES = "k long, epi_year int, epi_week int, confirmed long"


def read_series(spark: SparkSession, path: str, schema: str = SERIES) -> DataFrame:
    """CSV with a header; null counts are 0."""
    rows = spark.read.schema(schema).csv(path, header=True, mode="FAILFAST")
    return rows.withColumn("confirmed", F.coalesce("confirmed", F.lit(0)))


def read_sitreps(spark: SparkSession, glob: str, expected: int = 37) -> tuple[DataFrame, DataFrame]:
    """One CSV a week named YYYY-WNN: (state rows with the week, weeks whose number of states is not `expected`)."""
    rows = spark.read.schema("state string, confirmed_cases int, deaths int").csv(glob, header=True)
    name = F.col("_metadata.file_path")
    rows = rows.select("*", F.regexp_extract(name, r"(\d{4})-W(\d{2})", 1).cast("int").alias("epi_year"), F.regexp_extract(name, r"(\d{4})-W(\d{2})", 2).cast("int").alias("epi_week"))
    weeks = rows.groupBy("epi_year", "epi_week").agg(F.count_distinct("state").alias("n_states"))
    return rows, weeks.where(F.col("n_states") != expected)


def read_ledger_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, raw): non-blank lines as they are, without a byte-order mark; a line that is no JSON object fails the job."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^﻿", "").alias("raw")).where(F.trim("raw") != "")
    ok = F.json_object_keys("raw").isNotNull()
    return rows.withColumn("raw", F.when(ok, F.col("raw")).otherwise(F.raise_error(F.lit("malformed ledger line"))))


def read_json_array(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """A whole-file JSON document: one row for each element of an array field."""
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode(field).alias("item")).select("item.*")


def file_hashes(spark: SparkSession, glob: str) -> DataFrame:
    """(name, sha256, length, path) of whole files."""
    rows = spark.read.format("binaryFile").load(glob)
    return rows.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("sha256"), "length", "path")


def append_series(existing: DataFrame, new: DataFrame, k: Sequence[str], path: str, apply: bool = False) -> DataFrame:
    """The rows that are new; with apply they are appended at path, which is never rewritten."""
    delta = cur.append_new(existing, new, k)
    if apply:
        delta.write.mode("append").parquet(path)
    return delta


def upsert(board: DataFrame, updates: DataFrame, k: Sequence[str], path: str, apply: bool = False) -> DataFrame:
    """The merged board; with apply it is written as a new version at path, which must not exist yet."""
    merged = bd.upsert(board, updates, k)
    if apply:
        merged.write.parquet(path)
    return merged
