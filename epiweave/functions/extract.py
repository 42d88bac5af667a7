"""Fields of report texts and pages by regular expressions, as column expressions."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

# Fixed patterns of the report layout.
HEADER = r"(?i)Epi\s*Week[:\s]*(\d{1,2})\s*(20\d{2})"
CUMULATIVE = r"Cumulative\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s+([\d.]+)\s*%"
STATES = r"(?i)(\d+)\s+States?\s+have\s+recorded"
SHARE = r"([A-Z][a-z]+)\s+reported\s+(\d+)%|([A-Z][a-z]+)\s+(\d+)%"
NARRATIVE = r"In week (\d+), .*? from (\d+) reported in epi week (\d+) of (\d{4}) to (\d+)"


def _int(pattern: str, group: int, text: str) -> Column:
    return F.regexp_extract(F.col(text), pattern, group).try_cast("int")


#: A link's target in double quotes, in single quotes, or bare.
HREF = r"""(?i)<a\s[^>]*?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def header_pattern(years: str = r"20\d{2}") -> str:
    """The header's pattern for reports of other years than this century's."""
    return HEADER.replace(r"20\d{2}", years)


def header(text: str = "text", years: str = r"20\d{2}") -> dict[str, Column]:
    return {"year": _int(header_pattern(years), 2, text), "week": _int(header_pattern(years), 1, text)}


def cumulative(text: str = "text") -> dict[str, Column]:
    """The first Cumulative row (this year) and, as prior_confirmed and prior_deaths, the second (a year before)."""
    names = ("cum_suspected", "cum_confirmed", "cum_probable", "cum_deaths", "cfr")
    every = {n: F.regexp_extract_all(F.col(text), F.lit(CUMULATIVE), i) for i, n in enumerate(names, 1)}
    out = {n: F.get(c, 0).try_cast("double" if n == "cfr" else "int") for n, c in every.items()}
    return out | {f"prior_{n[4:]}": F.get(every[n], 1).try_cast("int") for n in ("cum_confirmed", "cum_deaths")}


def states_affected(text: str = "text") -> Column:
    return _int(STATES, 1, text)


def state_shares(text: str = "text", most: int = 200) -> Column:
    """State:NN% joined by '; ', cut at `most` characters."""
    groups = [F.regexp_extract_all(F.col(text), F.lit(SHARE), i) for i in (1, 2, 3, 4)]
    pairs = F.transform(F.arrays_zip(*(g.alias(f"g{i}") for i, g in enumerate(groups))), lambda z: F.concat(F.when(z["g0"] != "", z["g0"]).otherwise(z["g2"]), F.lit(":"), F.when(z["g1"] != "", z["g1"]).otherwise(z["g3"]), F.lit("%")))
    return F.substring(F.array_join(pairs, "; "), 1, most)


def narrative(text: str = "text") -> dict[str, Column]:
    return {n: _int(NARRATIVE, i, text) for n, i in (("told_week", 1), ("previous", 2), ("previous_week", 3), ("told_year", 4), ("current", 5))}


def links(pages: DataFrame, suffix: str = "", base: str = "") -> DataFrame:
    """pages(page_id, html) -> (page_id, ord, href): each target once, in order of first occurrence, made absolute.

    Targets may be quoted either way or not at all, tags and suffix in any case; empty targets are none.
    """
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(HREF), F.lit(0))  # one pass over the page; what was found is short
    target = F.transform(found, lambda m: F.concat(*(F.regexp_extract(m, HREF, g) for g in (1, 2, 3))))  # one of the forms; the others are empty
    every = pages.select("page_id", F.posexplode(target).alias("pos", "href"))
    every = every.where((F.col("href") != "") & F.lower("href").endswith(suffix.lower()))
    first = every.groupBy("page_id", "href").agg(F.min("pos").alias("pos"))
    full = F.when(F.col("href").startswith("http"), F.col("href")).otherwise(F.concat(F.lit(base), F.col("href")))
    return first.select("page_id", F.row_number().over(Window.partitionBy("page_id").orderBy("pos")).alias("ord"), full.alias("href"))


def parse_quality(reports: DataFrame, parsed: dict[str, Column], needed: Sequence[str]) -> tuple[DataFrame, Observation]:
    """reports with the parsed fields, and counters ok and failed that the pass over them fills.

    A report is ok if all needed fields were found. The counters cost no pass of their own: they can be asked
    for (`.get`) once the reports have been written, and count all that were.
    """
    quality = Observation(f"parse-quality-{uuid.uuid4().hex[:12]}")
    out = reports.select("*", *(c.alias(n) for n, c in parsed.items()))
    ok = reduce(and_, (F.col(n).isNotNull() for n in needed))
    return out.observe(quality, F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed")), quality
