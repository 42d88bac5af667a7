"""A training-data pipeline over `documents`: five stages, each written as Parquet and read by the next.

The driver of this repository may run STAGES itself; `run` applies them in order. All stages but the last
return the columns of documents: doc_id, text, lang, source, n_chars. Rows are told apart by doc_id and text:
repeated or null doc_ids make no row go but copies of a text and rows that hold a benchmark item.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epiweave.llm import common, decontaminate, packing, pii, quality, similar

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: No SQL: the stages are learned models, fingerprints over shuffled links, and a linear program.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that score below the model's quantile cut go."""
    model = quality.train(docs, common.table(spark, sf_dir, "labels"))
    return quality.keep_good(docs.select(*COLUMNS), model)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: one document of each group of similar texts (five-word shingles, 0.8) stays, that with the smallest doc_id.

    SimHash anchors propose, prefixes of the shingle sets complete them, exact similarity decides.
    """
    return similar.deduplicate(docs.select(*COLUMNS)).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that hold a benchmark item go."""
    return decontaminate.decontaminate(docs.select(*COLUMNS), common.table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: personal data in the texts becomes a mark of its kind; n_chars follows."""
    return pii.redact(docs.select(*COLUMNS), pii.train()).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: pieces of documents with their place in the sequences, and the ids' checksum."""
    packed = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality", quality_stage),
    ("near-duplicates", dedup_stage),
    ("decontamination", decontamination_stage),
    ("personal data", pii_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
