"""Extraction queries: report texts made from the cumulative reports, and the pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from epiweave.functions import extract as ex
from epiweave.sources.shared import stage

from .bindings import CTES, read, report_text, with_
from .registry import query

_ROW = "'Cumulative ' || (cum_suspected + {0}) || ' ' || (cum_confirmed + {0}) || ' ' || (cum_probable + {0}) || ' ' || (cum_deaths + {0}) || ' ' || (cum_deaths % {1}) || '.5%' || chr(10)"
CTES["texts"] = (
    f"""SELECT k || '-' || epi_year || '-' || epi_week || '-' || archive_pos AS id, 'Epi Week: ' || epi_week || ' ' || epi_year || chr(10) || {_ROW.format(0, 90)} || {_ROW.format(1, 80)} ||
    (k + 3) || ' States have recorded cases. Ondo reported ' || (epi_week % 50) || '% and Edo ' || (k + 10) || '%.' || chr(10) || 'In week ' || epi_week || ', cases from ' || cum_probable || ' reported in epi week ' || (epi_week - 1) || ' of ' || epi_year || ' to ' || cum_confirmed || '.' AS text FROM reports""",
    ("reports",),
)
_YEARS = r"20\d{2}|19\d{2}"  # the given tables are of the nineties
_H, _C, _S, _N = ex.header_pattern(_YEARS), ex.CUMULATIVE, ex.SHARE, ex.NARRATIVE


def _n(pattern: str, g: int) -> str:
    return f"TRY_CAST(regexp_extract(text, '{pattern}', {g}) AS INTEGER)"


def _all(g: int, at: int, kind: str = "INTEGER") -> str:
    return f"TRY_CAST(regexp_extract_all(text, '{_C}', {g})[{at}] AS {kind})"


@query("ext_header", with_("texts", f"SELECT id, {_n(_H, 2)} AS year, {_n(_H, 1)} AS week FROM texts"))
def header(spark, d):
    return report_text(spark, d).select("id", *(c.alias(n) for n, c in ex.header(years=_YEARS).items()))


@query("ext_cumulative", with_("texts", f"SELECT id, {_n(_H, 2)} AS year, {_n(_H, 1)} AS week, {_all(1, 1)} AS cum_suspected, {_all(2, 1)} AS cum_confirmed, {_all(3, 1)} AS cum_probable, {_all(4, 1)} AS cum_deaths, {_all(5, 1, 'DOUBLE')} AS cfr, {_all(2, 2)} AS prior_confirmed, {_all(4, 2)} AS prior_deaths FROM texts"))
def cumulative(spark, d):
    return report_text(spark, d).select("id", *(c.alias(n) for n, c in (ex.header(years=_YEARS) | ex.cumulative()).items()))


@query("ext_states_affected", with_("texts", f"SELECT id, TRY_CAST(regexp_extract(text, '{ex.STATES}', 1) AS INTEGER) AS n FROM texts"))
def states_affected(spark, d):
    return report_text(spark, d).select("id", ex.states_affected().alias("n"))


@query("ext_state_shares", with_("texts", f"SELECT id, substr(array_to_string(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN a[i] <> '' THEN a[i] ELSE c[i] END || ':' || CASE WHEN b[i] <> '' THEN b[i] ELSE e[i] END || '%'), '; '), 1, 200) AS shares FROM (SELECT id, regexp_extract_all(text, '{_S}', 1) AS a, regexp_extract_all(text, '{_S}', 2) AS b, regexp_extract_all(text, '{_S}', 3) AS c, regexp_extract_all(text, '{_S}', 4) AS e FROM texts)"))
def state_shares(spark, d):
    return report_text(spark, d).select("id", ex.state_shares().alias("shares"))


@query("ext_narrative_count", with_("texts", f"SELECT id, {_n(_N, 1)} AS told_week, {_n(_N, 2)} AS previous, {_n(_N, 3)} AS previous_week, {_n(_N, 4)} AS told_year, {_n(_N, 5)} AS current FROM texts"))
def narrative(spark, d):
    return report_text(spark, d).select("id", *(c.alias(n) for n, c in ex.narrative().items()))


@query("ext_parse_quality", with_("texts", f"SELECT count(*) FILTER (WHERE ok) AS ok, count(*) FILTER (WHERE NOT ok) AS failed FROM (SELECT {_n(_H, 1)} IS NOT NULL AND {_all(2, 1)} IS NOT NULL AS ok FROM texts)"))
def parse_quality(spark, d):
    """The counters come with the pass that writes the parsed reports."""
    fields = {"week": ex.header(years=_YEARS)["week"], "cum_confirmed": ex.cumulative()["cum_confirmed"]}
    parsed, quality = ex.parse_quality(report_text(spark, d), fields, list(fields))
    stage(parsed, "parsed")
    return spark.createDataFrame([(quality.get["ok"], quality.get["failed"])], "ok long, failed long")


_PDF = r"""CASE page_id % 3 WHEN 0 THEN regexp_replace(html, 'href="(/[^"]*)"', 'HREF=' || chr(39) || '\1.PDF' || chr(39), 'g') WHEN 1 THEN regexp_replace(html, 'href="(/[^" ]*)"', 'href = \1.pdf', 'g') ELSE html END"""


@query("ext_links", f"""WITH p AS (SELECT page_id, {_PDF} AS html FROM pages), e AS (SELECT page_id, coalesce(unnest(a), '') || coalesce(unnest(b), '') || coalesce(unnest(c), '') AS href, generate_subscripts(a, 1) AS pos FROM
    (SELECT page_id, {', '.join("regexp_extract_all(html, '" + ex.HREF.replace("'", "''") + f"', {g}) AS {n}" for g, n in ((1, 'a'), (2, 'b'), (3, 'c')))} FROM p)),
    f AS (SELECT page_id, href, min(pos) AS pos FROM e WHERE lower(href) LIKE '%.pdf' GROUP BY 1, 2)
    SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) AS INTEGER) AS ord, CASE WHEN href LIKE 'http%' THEN href ELSE 'https://archive.example' || href END AS href FROM f""")
def links(spark, d):
    """Links to reports; in two of three pages the links are turned into such, in single quotes or bare."""
    forms = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("html", 'href="(/[^"]*)"', "HREF='$1.PDF'")).when(F.col("page_id") % 3 == 1, F.regexp_replace("html", 'href="(/[^" ]*)"', "href = $1.pdf")).otherwise(F.col("html"))
    return ex.links(read(spark, d, "pages").select("page_id", forms.alias("html")), suffix=".pdf", base="https://archive.example")


@query("src_report_pages", "SELECT page_id, url, length(html) AS n_chars FROM pages")
def report_pages(spark, d):
    return read(spark, d, "pages").select("page_id", "url", F.length("html").cast("long").alias("n_chars"))
