"""The corpus pipeline: quality rules, near-duplicate removal, benchmark decontamination, sanitised personal data, BPE tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; between stages the rows are written as Parquet and
read again. All stages but the last return the columns of `documents`, in their order, and any further columns that came along.

Defined cases: an empty table stays empty; a null or blank text fails the base rules and goes in the first stage; very long texts go through
whole; of rows that repeat a whole document the second stage keeps one; of equal and near copies the smallest id stays; extra columns go through
as they are, whatever their names; the operators name the outcome of every other case.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skywright.llm import bpe, decontam, near_dedup, pii, quality_rules
from skywright.llm.common import fresh, materialize, once, release, table, without_ids


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the base rules or the learned rules reject. A null or blank text fails the base rules and goes."""
    return quality_rules.good(docs, quality_rules.learn(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class; of rows that repeat a whole document, one."""
    return near_dedup.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item."""
    found = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return without_ids(docs, found.where(F.size("spans") > 0).select("doc_id"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and disclosing terms in the text; n_chars is the new length. A null text stays null."""
    base, terms, clean = fresh("base", docs.columns), fresh("terms", docs.columns), fresh("clean", docs.columns)
    found = pii.find(docs, keep=docs.columns, base_as=base, terms_as=terms)
    text = once(F.when(F.col("text").isNotNull(), pii.sanitised(F.col("text"), F.col(base), F.col(terms))))
    found = found.withColumn(clean, text)
    new = {"text": F.col(clean), "n_chars": F.length(clean).cast(docs.schema["n_chars"].dataType)}
    return found.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every kept text, with the digests of ids and decoded text."""
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json")).drop("decoded")


STAGES = [
    ("quality_rules", keep_good),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", sanitise),
    ("bpe", encode),
]

#: Learned rules, alignments and BPE merges are beyond SQL: tests/llm/test_pipeline.py holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        release(*before)  # what a stage has read goes when its own rows are written
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
