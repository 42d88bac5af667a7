"""Chat formatting with Spark expressions only (operator 1).

A conversation becomes blocks `### role: text</turn>` and a line feed; adjacent turns of one role share a
block, their texts parted by `<part>`. Inside texts and roles the control characters are written `\\b`
(backslash), `\\l` (<), `\\h` (#) and, in roles, `\\c` (:), so no control string can occur there and
`parse` gets every turn back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

PART, CLOSE = "<part>", "</turn>\n"


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit("#"), F.lit("\\h"))
    return F.replace(out, F.lit(":"), F.lit("\\c")) if role else out


def unescape(text: Column) -> Column:
    for code, char in (("\\c", ":"), ("\\h", "#"), ("\\l", "<"), ("\\b", "\\")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """turns(conv_id, turn, role, text) -> (conv_id, formatted string, mask array<struct<length, loss>>).

    Turns are ordered by turn, then role, then text (ties and repeated rows all stay; a null turn comes
    first); a null role or text counts as empty; rows with a null conv_id form one conversation (a
    conversation is one array, so one task holds it whole); other columns are not read; no rows give no rows. mask covers `formatted` in code points from its start,
    two runs for each turn (markup, then text) and the last mark; loss holds for texts of loss_role.
    """
    rows = turns.select(
        F.col("conv_id"), F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def piece(t: Column, i: Column) -> Column:
        head = F.concat(F.lit("### "), escape(t["role"], True), F.lit(": "))
        before = F.get(F.col("turns"), i - 1)["role"]
        lead = F.when(before.isNull(), head).when(before == t["role"], F.lit(PART)).otherwise(F.concat(F.lit(CLOSE), head))
        return F.struct(lead.alias("lead"), escape(t["text"]).alias("body"), (t["role"] == loss_role).alias("loss"))

    chats = chats.select("conv_id", F.transform("turns", piece).alias("pieces"))
    runs = F.flatten(
        F.transform(
            "pieces",
            lambda p: F.array(F.struct(F.length(p["lead"]).alias("length"), F.lit(False).alias("loss")), F.struct(F.length(p["body"]).alias("length"), p["loss"].alias("loss"))),
        )
    )
    text = F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["lead"], p["body"])), ""), F.lit(CLOSE))
    tail = F.array(F.struct(F.lit(len(CLOSE)).alias("length"), F.lit(False).alias("loss")))
    return chats.select("conv_id", text.alias("formatted"), F.concat(runs, tail).alias("mask"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>, unescaped, merged turns parted again."""
    blocks = F.split(formatted, F.lit("</turn>\n"), -1)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def block(b: Column) -> Column:
        cut = F.instr(b, ": ")
        role = unescape(F.substring(b, F.lit(5), cut - 5))
        parts = F.split(F.substring(b, cut + 2, F.length(b)), F.lit(PART), -1)
        return F.transform(parts, lambda p: F.struct(role.alias("role"), unescape(p).alias("text")))

    return F.flatten(F.transform(blocks, block))


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(own).alias("text")
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    chats = format_chats(turns).select("conv_id", "formatted", "mask", parse(F.col("formatted")).alias("back"))
    masked = F.filter(F.col("back"), lambda t, i: F.get(F.col("mask"), 2 * i + 1)["loss"])
    loss = F.array_join(F.transform(masked, lambda t: t["text"]), "")
    every = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(every, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
l AS (SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
e AS (SELECT *, len(text) + len(text) - len(replace(replace(replace(text, '\', ''), '<', ''), '#', '')) AS n,
             len(role) + len(role) - len(replace(replace(replace(replace(role, '\', ''), '<', ''), '#', ''), ':', '')) AS r FROM l)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(len(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n + CASE WHEN before IS NOT NULL AND before = role THEN 6 ELSE 4 + r + 2 END
                  + CASE WHEN after IS NOT NULL AND after = role THEN 0 ELSE 8 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
