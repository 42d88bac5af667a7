"""URL verdicts from fixed rules and link-graph propagation, DataFrame functions only (operator 10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table, unstage

#: (host, path, verdict): a rule fits its host and all subdomains where the url's path starts with the rule's.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest fitting rule, null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """pages(host, html) -> (src, dst, share): links between different hosts; share is the part of src's links."""
    target = F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""), 1))
    links = pages.where("host <> ''").select(F.col("host").alias("src"), target.alias("to"))
    to = F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), F.col("to"))).otherwise(F.col("to"))
    links = links.select("src", url_host(to).alias("dst")).where("src <> dst and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))
    total = links.groupBy("src").agg(F.sum("n").alias("all"))
    return links.join(total, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share"))


def propagate(hosts: DataFrame, edges: DataFrame, seed: str, rounds: int = 1000, damping: float = 0.85, settled: float = 1e-4, every: int = 4) -> DataFrame:
    """Personalised PageRank over edges(src, dst, share) of two seed vectors of hosts: `seed` and `pages`.

    Returns (host, seed_mass, mass): what of a host's rank comes from the seeds, and all of its rank. A
    round adds what walks of its length bring. It ends when all mass that is still on its way, wherever it
    may arrive, is below `settled` of the mass of every host that has any: so each host's share is right to
    `settled`, whatever the size of others; small hosts beside one of a billion pages take some 200 rounds
    unless their walks end before. Raises if that takes more than `rounds`.

    Contributions are summed before they are shuffled, so a host of very many links to it is one row a
    partition. A host of very many links meets its own rank in a join that adaptive execution splits.
    `every` rounds make a table in the shared folder.
    """
    none = F.lit(0.0)
    own, all_ = ((1 - damping) * F.col(c) for c in (seed, "pages"))
    now = hosts.select("host", own.alias("s"), all_.alias("p"), own.alias("ds"), all_.alias("dp"))
    was = None
    for k in range(1, rounds + 1):
        walking = now.where("dp > 0").select(F.col("host").alias("from"), "ds", "dp")
        sent = edges.join(walking, F.col("src") == F.col("from")).groupBy(F.col("dst").alias("host"))
        sent = sent.agg(F.sum(F.col("ds") * F.col("share")).alias("_s"), F.sum(F.col("dp") * F.col("share")).alias("_p"))
        ds, dp = damping * F.coalesce("_s", none), damping * F.coalesce("_p", none)
        now = now.join(sent, "host", "left").select("host", (F.col("s") + ds).alias("s"), (F.col("p") + dp).alias("p"), ds.alias("ds"), dp.alias("dp"))
        if k % every:
            continue
        now = stage(now, "rank")
        coming, least = now.agg(F.sum("dp"), F.min(F.when(F.col("p") > 0, F.col("p")))).first()
        if was is not None:
            unstage(was)
        was = now
        if not coming or coming * damping / (1 - damping) <= settled * least:
            return now.select("host", F.col("s").alias("seed_mass"), F.col("p").alias("mass"))
    raise RuntimeError("the ranks did not settle")


def judge(pages: DataFrame, rules=RULES, threshold: float = 0.5) -> DataFrame:
    """pages(page_id, url, html) -> (page_id, host, path, rule, verdict, trust, distrust): one row for each row.

    Pages that a rule allows or blocks are the trusted and the blocked seeds of their hosts. trust is the
    share of a host's PageRank that comes from trusted seeds along links; distrust the share of its reversed
    PageRank that comes from blocked seeds, against the links. A host is blocked if distrust - trust is above
    threshold; its pages without a rule take that verdict, those of hosts without any evidence are allowed.

    Null urls, and those without ://, have the empty host, which no link reaches. Null html has no links.
    Repeated rows and null page_ids stay; an empty table gives no rows; other columns are not read.
    """
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), "html").withColumns({"rule": rule, "ruled": verdict})
    edges = stage(host_edges(rows), "edges")
    seen = rows.groupBy("host").agg(
        F.count("*").alias("pages"), F.count_if(F.col("ruled") == "allow").alias("allowed"), F.count_if(F.col("ruled") == "block").alias("blocked")
    )
    if edges.isEmpty():
        masses = stage(seen.select("host", (F.col("allowed") / F.col("pages")).alias("trust"), (F.col("blocked") / F.col("pages")).alias("distrust")), "masses")
    else:
        linked = edges.select(F.col("dst").alias("host")).distinct().select("host", *(F.lit(0).cast("long").alias(c) for c in ("pages", "allowed", "blocked")))
        hosts = stage(seen.union(linked).groupBy("host").agg(*(F.sum(c).alias(c) for c in ("pages", "allowed", "blocked"))), "hosts")
        share = F.when(F.col("mass") > 0, F.col("seed_mass") / F.col("mass")).otherwise(0.0)
        trust = propagate(hosts, edges, "allowed").select("host", share.alias("trust"))
        into = edges.groupBy("dst").agg(F.sum("share").alias("all"))
        back = stage(edges.join(into, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("share") / F.col("all")).alias("share")), "back")
        distrust = propagate(hosts, back, "blocked").select("host", share.alias("distrust"))
        masses = stage(trust.join(distrust, "host"), "masses")
    out = rows.drop("html").join(masses, "host", "left")
    method = F.when(F.col("distrust") - F.col("trust") > threshold, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "trust", "distrust")


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
