"""The driver's tables as the library's inputs: each DataFrame here has its SQL twin in CTES."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epiweave.functions import calendar as cal

WEEK = ("epi_year", "epi_week")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket(*parts) -> Column:
    """A number from 0 to 2^32 - 1 drawn from the md5 of the parts: the same in Spark and in SQL."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint")


def sql_bucket(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8) AS BIGINT)"


def panel(spark: SparkSession, sf_dir: str, k: str = "n_regionkey") -> DataFrame:
    """Weekly counts (k, epi_year, epi_week, confirmed): orders by the customer's region or nation."""
    orders = read(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    by_place = orders.join(customers, orders.o_custkey == customers.c_custkey).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return by_place.groupBy(F.col(k).alias("k"), cal.iso_year("day").alias("epi_year"), cal.iso_week("day").alias("epi_week")).agg(F.count("*").alias("confirmed"))


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region panel with all four measures, week bounds and publication day."""
    p = panel(spark, sf_dir)
    lag = 6 + bucket(*(F.col(c).cast("string") for c in ("k", *WEEK))) % 39
    return p.select(
        "k", *WEEK, (3 * F.col("confirmed") + 2).alias("suspected"), "confirmed", (F.col("epi_week") % 3).cast("bigint").alias("probable"), (F.col("epi_week") % 2).cast("bigint").alias("deaths"),
        cal.monday(*WEEK).alias("week_start"), cal.sunday(*WEEK).alias("week_end"), F.date_add(cal.sunday(*WEEK), lag.cast("int")).alias("published"),
    )


MEASURES = ("suspected", "confirmed", "probable", "deaths")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative reports: running sums by (k, year), some weeks missing, some reported twice, some corrected down."""
    w = Window.partitionBy("k", "epi_year").orderBy("epi_week")
    cums = [F.sum(m).over(w).alias(f"cum_{m}") for m in MEASURES]
    b = bucket(*(F.col(c).cast("string") for c in ("k", *WEEK)))
    full = weekly(spark, sf_dir).select("k", *WEEK, *cums, b.alias("b")).where("b % 11 <> 0")
    fix = F.when(F.col("b") % 17 == 0, 5).otherwise(0)
    first = full.withColumns({"cum_deaths": F.col("cum_deaths") - fix, "archive_pos": F.lit(1)})
    again = full.where("b % 13 = 0").withColumns({"cum_deaths": F.col("cum_deaths") + 1, "archive_pos": F.lit(2)})
    return first.union(again).drop("b")


def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report texts (id, text) made from the cumulative reports."""
    r = reports(spark, sf_dir)
    ident = F.concat_ws("-", *(F.col(c).cast("string") for c in ("k", *WEEK, "archive_pos")))
    row = "%d %d %d %d %d.5%%"
    text = F.format_string(
        "Epi Week: %d %d\nCumulative " + row + "\nCumulative " + row + "\n%d States have recorded cases. Ondo reported %d%% and Edo %d%%.\nIn week %d, cases from %d reported in epi week %d of %d to %d.",
        "epi_week", "epi_year", *(f"cum_{m}" for m in MEASURES), F.col("cum_deaths") % 90, *(F.col(f"cum_{m}") + 1 for m in MEASURES), F.col("cum_deaths") % 80, F.col("k") + 3, F.col("epi_week") % 50, F.col("k") + 10,
        "epi_week", "cum_probable", F.col("epi_week") - 1, "epi_year", "cum_confirmed",
    )
    return r.select(ident.alias("id"), text.alias("text"))


#: model -> (score, constant of the probability score / (score + constant)), as Spark and DuckDB SQL: stand-ins for the fitted maps.
_WAVE = "round(10 + 3 * cos(2 * pi() * (epi_week - 1) / 52) + 2 * sin(2 * pi() * (epi_week - 1) / 52), 4)"
SCORES = {"model": ("2 * roll4 + lag1", "24.0"), "recent4": ("roll4", "8.0"), "lag1": ("lag1", "8.0"), "seasonal": (_WAVE, "9.0"), "seasonal_persist": (f"round(0.5 * roll4 + 0.5 * {_WAVE} + 0.1 * lag1, 6)", "9.5")}


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form (k, t, week, model, score, prob, y): the scores of the model and its four comparators for the weeks with a full horizon."""
    w = Window.partitionBy("k").orderBy(*WEEK)
    p = panel(spark, sf_dir).select(
        "k", *WEEK, F.row_number().over(w).alias("t"), F.coalesce(F.lag("confirmed").over(w), F.lit(0)).alias("lag1"), F.coalesce(F.avg("confirmed").over(w.rowsBetween(-4, -1)), F.lit(0.0)).alias("roll4"),
        F.sum("confirmed").over(w.rowsBetween(1, 4)).alias("f4"), F.count("*").over(w.rowsBetween(1, 4)).alias("n4"),
    )
    p = p.where("n4 = 4 and t > 8").withColumn("y", (F.col("f4") > 34).cast("int"))
    made = ", ".join(f"'{m}', {o}, cast({s} as double), cast(({s}) / (({s}) + {c}) as double)" for o, (m, (s, c)) in enumerate(SCORES.items()))
    return p.select("k", "t", *WEEK, "y", F.expr(f"stack({len(SCORES)}, {made}) as (model, ord, score, prob)"))


def zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nation panel with every week from a nation's first to its last: (k, epi_year, epi_week, confirmed), 0 where nothing was reported."""
    p = panel(spark, sf_dir, "n_nationkey").withColumn("day", cal.monday(*WEEK))
    spine = p.groupBy("k").agg(F.min("day").alias("a"), F.max("day").alias("b")).select("k", F.explode(F.sequence("a", "b", F.expr("interval 7 days"))).alias("day"))
    full = spine.join(p.select("k", "day", "confirmed"), ["k", "day"], "left")
    return full.select("k", cal.iso_year("day").alias("epi_year"), cal.iso_week("day").alias("epi_week"), F.coalesce("confirmed", F.lit(0)).alias("confirmed"))


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of a value: lineitem by order, shipping day as publication time, all columns breaking ties."""
    c = ("l_orderkey", "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return read(spark, sf_dir, "lineitem").select(*c).withColumnRenamed("l_quantity", "value")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chain, seq, payload): one chain for each conversation."""
    c = read(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("chain"), (F.col("turn") + 1).alias("seq"), F.concat_ws("|", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role", "text").alias("payload"))


FLAGS = (
    "fever sore_throat chest_pain mucosal_bleeding facial_edema proteinuria hearing_loss headache myalgia vomiting diarrhea abdominal_pain rapid_onset rash jaundice contact_confirmed_case "
    "contact_rodent high_risk_lga hcw_febrile_care household_illness travel_endemic is_hcw refractory_fever weakness"
).split()


def line_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One patient for each order: flags, age, temperature and duration from hashes, a laboratory result y."""
    b = bucket(F.col("o_orderkey").cast("string"))
    c = bucket(F.lit("c"), F.col("o_orderkey").cast("string"))
    flags = [((F.shiftright(b, i) % 2) == 1).alias(f) for i, f in enumerate(FLAGS)]
    states = F.array(*map(F.lit, ("Edo", "Ondo", "Bauchi", "Taraba", "Ebonyi", "Lagos", "Kano", "Abia")))
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("day"), *flags, F.when(c % 7 > 0, (c % 80).cast("int")).alias("age"), F.when(c % 2 == 0, "male").otherwise("female").alias("sex"),
        F.when(c % 5 > 0, 36 + (c % 50) / 10).alias("fever_temp"), F.when(c % 3 > 0, (c % 15).cast("int")).alias("duration"), F.element_at(states, (c % 8 + 1).cast("int")).alias("state"), (c % 11 < 4).cast("int").alias("y"),
    )


def _flag_sql() -> str:
    return ", ".join(f"((b >> {i}) % 2) = 1 AS {f}" for i, f in enumerate(FLAGS))


_KYW = ("CAST(k AS VARCHAR)", "CAST(epi_year AS VARCHAR)", "CAST(epi_week AS VARCHAR)")
MONDAY = "(CAST(date_trunc('week', make_date(epi_year, 1, 4)) AS DATE) + 7 * (epi_week - 1))"


def _panel_sql(k: str) -> str:
    return f"""SELECT {k} AS k, CAST(isoyear(o_orderdate) AS INTEGER) AS epi_year, CAST(week(o_orderdate) AS INTEGER) AS epi_week, count(*) AS confirmed
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3"""


#: name -> (SQL, names it needs)
CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "panel": (_panel_sql("n_regionkey"), ()),
    "panel_nation": (_panel_sql("n_nationkey"), ()),
    "weekly": (
        f"""SELECT k, epi_year, epi_week, 3 * confirmed + 2 AS suspected, confirmed, CAST(epi_week % 3 AS BIGINT) AS probable, CAST(epi_week % 2 AS BIGINT) AS deaths,
        {MONDAY} AS week_start, {MONDAY} + 6 AS week_end, {MONDAY} + 6 + CAST(6 + {sql_bucket(*_KYW)} % 39 AS INTEGER) AS published FROM panel""",
        ("panel",),
    ),
    "full_reports": (
        "SELECT k, epi_year, epi_week, "
        + ", ".join(f"CAST(sum({m}) OVER (PARTITION BY k, epi_year ORDER BY epi_week) AS BIGINT) AS cum_{m}" for m in MEASURES)
        + f", {sql_bucket(*_KYW)} AS b FROM weekly",
        ("weekly",),
    ),
    "reports": (
        """SELECT k, epi_year, epi_week, cum_suspected, cum_confirmed, cum_probable, cum_deaths - CASE WHEN b % 17 = 0 THEN 5 ELSE 0 END AS cum_deaths, 1 AS archive_pos FROM full_reports WHERE b % 11 <> 0
        UNION ALL SELECT k, epi_year, epi_week, cum_suspected, cum_confirmed, cum_probable, cum_deaths + 1, 2 FROM full_reports WHERE b % 11 <> 0 AND b % 13 = 0""",
        ("full_reports",),
    ),
    "latest": ("SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY k, epi_year, epi_week ORDER BY archive_pos DESC) AS r FROM reports) WHERE r = 1", ("reports",)),
    "features": (
        """SELECT k, epi_year, epi_week, confirmed, row_number() OVER w AS t, coalesce(lag(confirmed, 1) OVER w, 0) AS lag1, coalesce(lag(confirmed, 2) OVER w, 0) AS lag2, coalesce(lag(confirmed, 4) OVER w, 0) AS lag4, coalesce(lag(confirmed, 8) OVER w, 0) AS lag8,
        coalesce(avg(confirmed) OVER (PARTITION BY k ORDER BY epi_year, epi_week ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 0.0) AS roll4,
        coalesce(avg(confirmed) OVER (PARTITION BY k ORDER BY epi_year, epi_week ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), 0.0) AS roll8,
        CAST(CASE WHEN count(*) OVER (PARTITION BY k ORDER BY epi_year, epi_week ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) = 4 THEN sum(confirmed) OVER (PARTITION BY k ORDER BY epi_year, epi_week ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) END AS BIGINT) AS f4
        FROM panel WINDOW w AS (PARTITION BY k ORDER BY epi_year, epi_week)""",
        ("panel",),
    ),
    "scored": (
        " UNION ALL ".join(
            f"SELECT k, t, epi_year, epi_week, '{m}' AS model, {o} AS ord, CAST({s} AS DOUBLE) AS score, CAST(({s}) / (({s}) + {c}) AS DOUBLE) AS prob, CAST(f4 > 34 AS INTEGER) AS y FROM features WHERE f4 IS NOT NULL AND t > 8"
            for o, (m, (s, c)) in enumerate(SCORES.items())
        ),
        ("features",),
    ),
    "zero_filled": (
        f"""SELECT s.k, CAST(isoyear(s.day) AS INTEGER) AS epi_year, CAST(week(s.day) AS INTEGER) AS epi_week, coalesce(confirmed, 0) AS confirmed FROM
        (SELECT k, CAST(unnest(generate_series(CAST(min({MONDAY}) AS TIMESTAMP), CAST(max({MONDAY}) AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS day FROM panel_nation GROUP BY k) s
        LEFT JOIN (SELECT k, {MONDAY} AS day, confirmed FROM panel_nation) p ON p.k = s.k AND p.day = s.day""",
        ("panel_nation",),
    ),
    "revisions": ("SELECT l_orderkey, l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity AS value FROM lineitem", ()),
    "ledger": ("SELECT conv_id AS chain, turn + 1 AS seq, concat_ws('|', CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR), role, text) AS payload FROM conversations", ()),
    "line_list": (
        f"""SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, {_flag_sql()}, CASE WHEN c % 7 > 0 THEN CAST(c % 80 AS INTEGER) END AS age, CASE WHEN c % 2 = 0 THEN 'male' ELSE 'female' END AS sex,
        CASE WHEN c % 5 > 0 THEN 36 + CAST(c % 50 AS DOUBLE) / 10 END AS fever_temp, CASE WHEN c % 3 > 0 THEN CAST(c % 15 AS INTEGER) END AS duration,
        ['Edo', 'Ondo', 'Bauchi', 'Taraba', 'Ebonyi', 'Lagos', 'Kano', 'Abia'][CAST(c % 8 + 1 AS INTEGER)] AS state, CAST(c % 11 < 4 AS INTEGER) AS y
        FROM (SELECT *, {sql_bucket("CAST(o_orderkey AS VARCHAR)")} AS b, {sql_bucket("'c'", "CAST(o_orderkey AS VARCHAR)")} AS c FROM orders)""",
        (),
    ),
}


def with_(names: str, body: str, **more: str) -> str:
    """SELECT body behind the CTEs named, in order of need, and those given as keywords."""
    out: dict[str, str] = {}

    def add(name: str) -> None:
        sql, needs = CTES[name]
        for n in needs:
            add(n)
        out.setdefault(name, sql)

    for name in names.split():
        add(name)
    out |= more
    return ("WITH " + ",\n".join(f"{n} AS ({s})" for n, s in out.items()) + "\n" if out else "") + body
