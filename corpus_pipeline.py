"""Cleaning and encoding of a document corpus in five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.llm import bpe, decontamination, minhash_forest, pii, quality_rules
from docsift.llm.common import materialize, read_table
from docsift.llm.queries import WORD_BPE


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighted quality rules keep.

    Null, empty and blank texts and texts of fewer than ten words fail the base rule and go; ids are not looked at, so null
    and repeated ids, repeated rows and clashing columns change nothing; an empty table gives an empty table.
    """
    # The row travels as one struct, so its columns cannot clash with those of the rules; counts are taken once.
    rows = materialize(quality_rules.counted(docs.select(F.struct("*").alias("row"), "text")).select("row", "counts"), "quality-counts")
    return quality_rules.verdicts(rows, quality_rules.fitted(rows)).where("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one with the smallest id, null ids last.

    Rows are told apart by numbers of their own, so rows without an id take part, repeated rows leave one, and rows that share
    an id but not the text are not copies of each other.  Null, empty and blank texts are no near duplicates and stay.  An
    empty table gives an empty table; clashing columns change nothing.
    """
    keyed = materialize(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("key")), "keyed")
    order = F.struct(F.col("row.doc_id").isNull().alias("none"), F.col("row.doc_id").alias("id"), "key")
    found = minhash_forest.near_duplicates(keyed.select(order.alias("order"), "row.text"), id_col="order")
    gone = materialize(found.where("not kept").select("doc_id.key"), "near-copies")
    return keyed.join(gone, "key", "left_anti").select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    A hash of id and text stands for a row, as ids may be null or repeated: each leaking row goes, and no other row of its id.
    Null and empty texts hold nothing and stay; repeated rows share their verdict; an empty table of documents or items gives
    the documents as they are; clashing columns change nothing.
    """
    key = F.xxhash64("doc_id", "text")
    found = decontamination.leaks(docs.select(key.alias("key"), "text"), read_table(spark, sf_dir, "benchmark"), id_col="key")
    leaking = materialize(found.select(F.col("doc_id").alias("key")).distinct(), "leaking")
    rows = docs.select(key.alias("key"), F.struct("*").alias("row"))
    return rows.join(leaking, "key", "left_anti").select("row.*")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows the new text.

    Every row stays.  Rows without such data, null and empty texts among them, stay as they are, n_chars included; ids are not
    looked at; repeated rows get equal texts; an empty table gives an empty table; clashing columns change nothing.
    """
    trees, text = pii.model(spark), F.col("plain")
    rows = docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("plain"))
    rows = rows.select("row", "plain", F.explode(F.array(pii.base_spans(text))).alias("base"))
    rows = rows.select("row", "plain", F.explode(F.array(F.when(text.rlike(pii.MAY), pii.all_spans(text, F.col("base"), trees)).otherwise(F.col("base")))).alias("spans"))
    found = F.size("spans") > 0
    rows = rows.select("row", found.alias("found"), F.when(found, pii.redacted(text, F.col("spans"))).alias("redacted"))
    new = {"text": F.col("redacted"), "n_chars": F.length("redacted").cast("long")}
    return rows.select(*(F.when(F.col("found"), new[c]).otherwise(F.col(f"row.{c}")).alias(c) if c in new else F.col(f"row.{c}") for c in docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text.

    One row for each row, repeated and null ids included; a null text counts as empty; an empty table gives an empty table.
    """
    return bpe.encoding_digests(docs, public_tokenizers.path(WORD_BPE))


STAGES = [("quality_rules", quality), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("pii", redact), ("bpe", encode)]

#: The stages hold estimates and hashes that SQL cannot express; the tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
