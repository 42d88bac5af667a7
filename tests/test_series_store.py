"""Bucketed series: appends keep the buckets, and work by series plans without an exchange."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from epiweave.sources import series_store as ss
from epiweave.sources.shared import shared_dir

SCHEMA = "k int, epi_year int, epi_week int, confirmed bigint"


def panel(spark, years, k=40):
    return spark.range(k).crossJoin(spark.range(years[0], years[1]).withColumnRenamed("id", "y")).select(
        F.col("id").cast("int").alias("k"), F.col("y").cast("int").alias("epi_year"), F.explode(F.sequence(F.lit(1), F.lit(52))).alias("epi_week"), (F.col("id") * F.col("y") % 17).alias("confirmed")
    )


@pytest.fixture
def wide_only(spark):
    """No broadcasts: what is not dealt out alike has to be moved."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_appends_keep_the_buckets(spark, wide_only):
    path = shared_dir(spark, "store")
    store = ss.open_series(spark, path, SCHEMA, ["k"], 5)
    assert ss.append(store, panel(spark, (2000, 2002))) == 40 * 104
    assert ss.append(store, panel(spark, (2001, 2003))) == 40 * 52  # the overlap is stored already
    assert ss.append(store, panel(spark, (2001, 2003))) == 0
    again = ss.open_series(spark, path, SCHEMA, ["k"], 5)
    assert sorted(map(tuple, again.read().collect())) == sorted(map(tuple, panel(spark, (2000, 2003)).collect()))
    rows = again.read()
    w = Window.partitionBy("k").orderBy("epi_year", "epi_week")
    for df in (rows.withColumn("run", F.sum("confirmed").over(w)), rows.groupBy("k").agg(F.sum("confirmed")), rows.groupBy("k", "epi_year").agg(F.max("confirmed"))):
        assert "Exchange" not in plan(df), plan(df)
    got = rows.withColumn("run", F.sum("confirmed").over(w)).groupBy("k").agg(F.max("run").alias("m")).collect()
    assert {r.k: r.m for r in got} == {r.k: r.m for r in panel(spark, (2000, 2003)).groupBy("k").agg(F.sum("confirmed").alias("m")).collect()}


def test_joins_of_stores_move_nothing(spark, wide_only):
    a, b = (ss.open_series(spark, shared_dir(spark, "store"), SCHEMA, ["k"], 4) for _ in range(2))
    ss.append(a, panel(spark, (2000, 2002)))
    ss.append(b, panel(spark, (2001, 2003)))
    with ss._partial_keys(spark):
        both = ss.against(a, b)
        assert "Exchange" not in plan(both), plan(both)
        assert both.count() == 40 * 52 and both.where("confirmed <> other_confirmed").isEmpty()


def test_repeats_and_missing_keys(spark):
    store = ss.open_series(spark, shared_dir(spark, "store"), SCHEMA, ["k"], 3)
    rows = spark.createDataFrame([(1, 2020, 1, 5), (1, 2020, 1, 3), (1, 2020, 2, None)], SCHEMA)
    assert ss.append(store, rows.withColumn("more", F.lit(1))) == 2
    assert sorted((r.epi_week, r.confirmed) for r in store.read().collect()) == [(1, 3), (2, None)]
    with pytest.raises(ValueError, match="without its series"):
        ss.append(store, spark.createDataFrame([(None, 2020, 1, 5)], SCHEMA))
    assert ss.append(store, rows.where("false")) == 0 and store.read().count() == 2
