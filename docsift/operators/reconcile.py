"""What an incremental build does with each document, and the checks before an index is published."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plan(files: DataFrame, records: DataFrame) -> DataFrame:
    """document_id and outcome of files (document_id, sha256, parsed) against records (document_id, sha256, artifact_ok).

    Unchanged documents are reused; changed or new ones are active if they parsed; a failed update keeps the old content
    as stale; a document that is gone stays as missing_source while its artifact is sound.
    """
    f = files.select("document_id", F.col("sha256").alias("new_sha"), "parsed")
    r = records.select("document_id", F.col("sha256").alias("old_sha"), "artifact_ok")
    sound = F.coalesce("artifact_ok", F.lit(False))
    outcome = (
        F.when(F.col("new_sha").isNull(), F.when(sound, "missing_source").otherwise("unavailable"))
        .when(sound & F.col("new_sha").eqNullSafe(F.col("old_sha")), "reuse")
        .when(F.col("parsed"), "active")
        .when(sound, "stale")
        .otherwise("failed_new")
    )
    return f.join(r, "document_id", "full_outer").select("document_id", outcome.alias("outcome"))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def untraced(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with the side that lacks them."""
    a, b = inputs.select(key).distinct(), outputs.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("missing_in", F.lit("output")).union(b.join(a, key, "left_anti").withColumn("missing_in", F.lit("input")))


def missing_targets(targets: DataFrame, index: DataFrame, key: str) -> DataFrame:
    return targets.select(key).distinct().join(index.select(key), key, "left_anti")


def outcome_counts(planned: DataFrame) -> DataFrame:
    return planned.groupBy("outcome").agg(F.count("*").alias("n"))


def with_status(files: DataFrame, reports: DataFrame, key: str) -> DataFrame:
    """Status of each file by its report; a file without one has failed."""
    return files.select(key).join(reports.select(key, "status"), key, "left").select(key, F.coalesce("status", F.lit("failed")).alias("status"))
