"""Merkle manifests of datasets: aligned blocks keep a level as one string, substrings are hashed (operator 12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, stage, table, unstage

#: Hexadecimal characters of a digest.
DIGEST = 64
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value: no two lists of fields read alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """The digest of a row of documents, with some columns replaced."""
    return F.sha2(F.concat(*(field(changed.get(c, F.col(c))) for c in COLUMNS)), 256)


def ranked(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Adds rank: a row's place in its group, from 0. Ranges of (group, order) spread even one group over all tasks.

    Rows of a range are numbered where they lie; what comes before a range follows from one row a group and range.
    """
    rows = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_at", F.monotonically_increasing_id())
    rows = stage(rows.withColumn("_part", F.shiftright("_at", 33)), name)
    parts = rows.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = stage(parts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n"), f"{name}-parts")
    out = rows.join(bounded(parts, 200_000), [group, "_part"])
    return out.withColumn("rank", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_first", "_before")


def _cut(level: Column, first: Column, number: Column) -> Column:
    """Digests first .. first + number - 1 of a level; levels are binary so that a substring costs its own length."""
    return F.substring(level, (first * DIGEST + 1).cast("int"), (number * DIGEST).cast("int"))


def parents(level: Column, fan: int) -> Column:
    """The level above: each run of `fan` digests (the last may be shorter) is hashed as text."""
    runs = F.ceil(F.octet_length(level) / (fan * DIGEST))
    return F.array_join(F.transform(F.sequence(F.lit(0), (runs - 1).cast("int")), lambda i: F.sha2(_cut(level, i * fan, F.lit(fan)), 256)), "").cast("binary")


def levels(level: Column, number: Column, fan: int) -> Column:
    """The given level and `number` levels above it."""
    up = F.slice(F.sequence(F.lit(0), number), 2, number)  # 1 .. number, none for 0
    return F.aggregate(up, F.array(level), lambda acc, _: F.concat(acc, F.array(parents(F.element_at(acc, -1), fan))))


def segments(above: Column, place: Column, fan: int) -> Column:
    """Siblings of the digest at `place`, level by level: what flanks it in its run, as array<struct<left, right>>."""

    def at(level: Column, i: Column) -> Column:
        p = F.floor(place / F.pow(F.lit(float(fan)), i)).cast("int")
        first = p - p % fan
        return F.struct(_cut(level, first, p - first).alias("left"), _cut(level, p + 1, first + fan - p - 1).alias("right"))

    return F.transform(F.slice(above, 1, F.size(above) - 1), at)


def fold(digest: Column, proof: Column) -> Column:
    """The root that a digest and its proof lead to."""
    return F.aggregate(proof, digest.cast("binary"), lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256).cast("binary")).cast("string")


def proof_digest(proof: Column) -> Column:
    """The digest of all siblings of a proof, from the leaf up, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"]).cast("string")), ""), 256)


def blocks(nodes: DataFrame, fan: int, deep: int) -> DataFrame:
    """nodes(g, rank, node, ...) -> (g, block, items, above): aligned runs of fan^deep nodes with the levels above them.

    items holds place, node and the other columns, by place. A block of a group of several blocks has `deep`
    levels, however few nodes it has; a group's only block ends where one node is left.
    """
    most = fan**deep
    others = [c for c in nodes.columns if c not in ("g", "rank", "node")]
    rows = nodes.withColumns({"block": F.floor(F.col("rank") / most), "place": (F.col("rank") % most).cast("int")})
    held = rows.groupBy("g", "block").agg(F.array_sort(F.collect_list(F.struct("place", "node", *others))).alias("items"))
    last = nodes.groupBy("g").agg((F.max("rank") >= most).alias("_several"))
    alone = F.lit(0)
    for k in range(deep):
        alone = F.when(F.size("items") > fan**k, k + 1).otherwise(alone)
    number = F.when(F.col("_several"), deep).otherwise(alone)
    level = F.array_join(F.transform("items", lambda x: x["node"]), "").cast("binary")
    return held.join(bounded(last, 200_000), "g").select("g", "block", "items", levels(level, number, fan).alias("above"))


def tree(nodes: DataFrame, fan: int = 2, deep: int = 8, name: str = "merkle") -> DataFrame:
    """nodes(g, rank, node, ...) -> (g, node, ..., top, path): the top of the node's group and the siblings on the way.

    Blocks of fan^deep nodes are reduced side by side; their tops are the nodes of the next round, so a
    group of n nodes takes log(n) / (deep log(fan)) rounds, each over 1 / fan^deep of the rows before.
    """
    others = [c for c in nodes.columns if c not in ("g", "rank", "node")]
    held = stage(blocks(nodes, fan, deep), name)
    top = F.element_at("above", -1).cast("string")
    if held.where("block > 0").isEmpty():
        held = held.withColumns({"_top": top, "_rest": F.array().cast("array<struct<left:binary,right:binary>>")})
    else:
        upper = tree(held.select("g", F.col("block").alias("rank"), top.alias("node"), F.col("block").alias("_below")), fan, deep, f"{name}-up")
        held = held.join(upper.select("g", F.col("_below").alias("block"), F.col("top").alias("_top"), F.col("path").alias("_rest")), ["g", "block"])
    out = held.select("g", "above", "_top", "_rest", F.explode("items").alias("x"))
    path = F.concat(segments(F.col("above"), F.col("x.place"), fan), F.col("_rest"))
    return out.select("g", "x.node", *(f"x.{c}" for c in others), F.col("_top").alias("top"), path.alias("path"))


def manifest(docs: DataFrame, fan: int = 2, deep: int = 8, **also: Column) -> DataFrame:
    """documents -> (doc_id, lang, leaf, the columns of `also`, subroot, root, proof): one row for each row.

    A leaf is the digest of a row's fields. Leaves of a language ascend by doc_id (null first, ties by
    digest); runs of `fan` become their digest until one node is left, the subroot; the subroots, by language
    (null first, bytewise), likewise give the root. proof is array<struct<left, right>> from leaf to root.

    Null fields count as `-`, differing from empty ones. Repeated rows are leaves of their own. Texts of any
    length are hashed whole. A table of one row has it as subroot and root, and an empty proof; an empty table
    gives no rows. Columns other than those of documents are read only by `also`.
    """
    rows = stage(docs.select("doc_id", "lang", leaf().alias("node"), *(c.alias(n) for n, c in also.items())), "leaves")
    langs = ranked(rows.select(F.lit(0).alias("one"), "lang").distinct(), "one", ["lang"], "langs")
    langs = stage(langs.select(F.col("lang").alias("_lang"), F.col("rank").alias("g")), "langs-ranked")
    numbered = rows.join(bounded(langs, 200_000), F.col("lang").eqNullSafe(F.col("_lang"))).drop("_lang")
    order = ranked(numbered, "g", ["doc_id", "node"], "leaves-ranked")
    within = tree(order, fan, deep, "blocks")
    subroots = stage(within.groupBy("g").agg(F.first("top").alias("node")), "subroots")
    over = tree(subroots.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("rank"), "node", F.col("g").alias("_g")), fan, deep, "roots")
    over = stage(over.select(F.col("_g").alias("g"), F.col("top").alias("root"), F.col("path").alias("_path")), "over")
    unstage(rows)
    out = within.join(bounded(over, 10_000), "g")
    return out.select("doc_id", "lang", F.col("node").alias("leaf"), *also, F.col("top").alias("subroot"), "root", F.concat("path", "_path").alias("proof"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    tampered = F.when(hit, leaf(n_chars=F.col("n_chars") + 1))
    rows = manifest(table(spark, sf_dir, "documents"), tampered=tampered)
    folded = fold(F.coalesce("tampered", "leaf"), F.col("proof"))
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELDS = ", ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in COLUMNS)
#: The proof by other means: whole levels as lists, siblings by index.
ORACLE = f"""WITH RECURSIVE d AS (SELECT *, n_chars + 1 AS more FROM documents),
leaves AS (SELECT doc_id, lang, sha256(concat({_FIELDS})) AS leaf, sha256(concat({_FIELDS.replace("n_chars", "more")})) AS forged, '0x' AS x FROM d),
ordered AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM leaves),
trees AS (SELECT g, 0 AS l, list(leaf ORDER BY i) AS nodes FROM ordered GROUP BY g
    UNION ALL SELECT g, l + 1, list_transform(range((len(nodes) + 1) // 2), lambda j: sha256(nodes[2 * j + 1] || coalesce(nodes[2 * j + 2], ''))) FROM trees WHERE len(nodes) > 1),
subs AS (SELECT g, nodes[1] AS subroot FROM trees WHERE len(nodes) = 1),
roots AS (SELECT 0 AS l, list(subroot ORDER BY g) AS nodes FROM subs
    UNION ALL SELECT l + 1, list_transform(range((len(nodes) + 1) // 2), lambda j: sha256(nodes[2 * j + 1] || coalesce(nodes[2 * j + 2], ''))) FROM roots WHERE len(nodes) > 1),
root AS (SELECT nodes[1] AS root FROM roots WHERE len(nodes) = 1),
ids AS (SELECT *, row_number() OVER () AS r FROM ordered),
steps AS (SELECT r, 0 AS stage, t.l, (i >> t.l) % 2 AS side, coalesce(nodes[xor(i >> t.l, 1) + 1], '') AS sibling FROM ids JOIN trees t ON t.g = ids.g WHERE len(nodes) > 1
    UNION ALL SELECT r, 1, t.l, (g >> t.l) % 2, coalesce(nodes[xor(g >> t.l, 1) + 1], '') FROM ids, roots t WHERE len(nodes) > 1),
numbered AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY stage, l) AS s FROM steps),
proofs AS (SELECT r, sha256(string_agg(sibling, '' ORDER BY s)) AS proof_sha256 FROM numbered GROUP BY r),
crc(n, c) AS (SELECT range, range FROM range(256)), crc_step AS (SELECT n, c, 0 AS k FROM crc UNION ALL SELECT n, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_step WHERE k < 8),
tab AS (SELECT list(c ORDER BY n) AS t FROM crc_step WHERE k = 8),
hit AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda p: CAST(ascii(substr(CAST(doc_id AS VARCHAR), p, 1)) AS BIGINT))), lambda a, b: xor(a >> 8, t[xor(a % 256, b) + 1])), 4294967295) % 7 = 0 AS bad FROM (SELECT DISTINCT doc_id FROM documents), tab),
folds AS (SELECT r, 0 AS s, CASE WHEN bad THEN coalesce(forged, leaf) ELSE leaf END AS h FROM ids LEFT JOIN hit ON hit.doc_id = ids.doc_id
    UNION ALL SELECT f.r, f.s + 1, sha256(CASE WHEN side = 1 THEN sibling || h ELSE h || sibling END) FROM folds f JOIN numbered n ON n.r = f.r AND n.s = f.s + 1),
folded AS (SELECT r, arg_max(h, s) AS folded_root FROM folds GROUP BY r)
SELECT ids.doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM ids JOIN subs ON subs.g = ids.g CROSS JOIN root LEFT JOIN proofs ON proofs.r = ids.r JOIN folded ON folded.r = ids.r"""
