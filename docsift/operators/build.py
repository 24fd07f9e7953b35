"""Incremental index builds: what is done with each document, its artifact, and the corpus that is published.

A build reads the files that are there, reuses what is unchanged, processes the rest, and publishes a new generation only if
something differs.  Artifacts hold one document's chunks and vectors under a key that names its content and the pipeline; a
document whose new version fails keeps its old artifact.  All of it is one set of tables, so a million documents are one job.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.config import DEFAULT, Config, fingerprint
from docsift.operators import chunking, cleaning, embedding
from docsift.sources.store import IndexStore, exclusive_lock

RECORD = (
    "document_id string, source string, source_path string, active_source_sha256 string, observed_source_sha256 string, pipeline_signature string, "
    "artifact_key string, status string, pages long, chunks long, error string"
)
KEY = re.compile("[0-9a-f]{64}")


class BuildError(RuntimeError):
    """A build that must not publish; the generation in use stays."""


def artifact_key(document_id: Column, source_sha256: Column, pipeline: str, nonce: str = "") -> Column:
    """Names the content of an artifact; a nonce makes a new one of equal content."""
    return F.sha2(F.to_json(F.struct(document_id.alias("document_id"), F.lit(nonce).alias("nonce"), F.lit(pipeline).alias("pipeline"), source_sha256.alias("source_sha256"))), 256)


def valid_key(key: Column) -> Column:
    return F.coalesce(key.rlike("^[0-9a-f]{64}$"), F.lit(False))


def valid_record(sha256: Column, pipeline: str, sound: Column) -> Column:
    """Whether a record serves again: same content, same pipeline, and its artifact is sound."""
    return F.coalesce((F.col("active_source_sha256") == sha256) & (F.col("pipeline_signature") == pipeline), F.lit(False)) & F.coalesce(sound, F.lit(False))


def artifact_faults(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """artifact_key with chunks, sizes of vectors, and whether it is sound: a vector of one size for each chunk, all finite, ids unique."""
    wrong = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = vectors.select("artifact_key", "chunk_id", F.size("embedding").alias("n"), wrong.alias("wrong"))
    rows = chunks.select("artifact_key", "chunk_id", F.lit(True).alias("chunk")).join(v, ["artifact_key", "chunk_id"], "full_outer")
    per = rows.groupBy("artifact_key").agg(F.count("chunk").alias("chunks"), F.min("n").alias("low"), F.max("n").alias("high"), F.count_if(F.col("chunk").isNull() | F.col("n").isNull() | F.coalesce("wrong", F.lit(False))).alias("faults"), (F.count("*") - F.countDistinct("chunk_id")).alias("repeated"))
    return per.select("artifact_key", "chunks", F.col("high").alias("dimension"), ((F.col("faults") == 0) & (F.col("repeated") == 0) & (F.col("low") == F.col("high")) & (F.col("high") > 0)).alias("sound"))


def plan(files: DataFrame, records: DataFrame, sound: DataFrame, pipeline: str, *, force: bool = False, prune_missing: bool = False) -> DataFrame:
    """document_id, action (reuse, process, missing, gone) and the record of each file and each document known before."""
    old = records.join(sound.select("artifact_key", "sound"), "artifact_key", "left").select("document_id", F.struct(*records.columns, "sound").alias("old"))
    new = files.select("document_id", F.struct("source", "source_path", "sha256").alias("new"))
    both = new.join(old, "document_id", "full_outer")
    same = F.coalesce((F.col("old.active_source_sha256") == F.col("new.sha256")) & (F.col("old.pipeline_signature") == pipeline) & F.col("old.sound"), F.lit(False))
    action = F.when(F.col("new").isNull(), F.lit("gone") if prune_missing else F.when(F.coalesce("old.sound", F.lit(False)), "missing").otherwise("gone"))
    return both.withColumn("action", action.when(F.lit(not force) & same, "reuse").otherwise("process"))


def reconciled(planned: DataFrame, parsed: DataFrame, pipeline: str, nonce: str = "") -> DataFrame:
    """``RECORD`` rows after parsing: active, stale, missing_source or failed_new.

    ``parsed`` has document_id, ok, pages, error of the files that were to be processed; a file without a row has failed.
    """
    report = parsed.select("document_id", F.struct("ok", "pages", "error").alias("report"))
    rows = planned.where("action <> 'gone' or new is not null").join(report, "document_id", "left")
    ok, kept = F.coalesce("report.ok", F.lit(False)), F.coalesce("old.sound", F.lit(False))
    status = F.when(F.col("action") == "reuse", "active").when(F.col("action") == "missing", "missing_source").when(ok, "active").when(kept, "stale").otherwise("failed_new")
    fresh = (F.col("action") == "process") & ok
    failed = F.coalesce("report.error", F.lit("no parse result"))
    return rows.withColumn("status", status).select(
        "document_id",
        F.coalesce("new.source", "old.source").alias("source"),
        F.coalesce("new.source_path", "old.source_path").alias("source_path"),
        F.when(fresh, F.col("new.sha256")).when(F.col("status") != "failed_new", F.col("old.active_source_sha256")).alias("active_source_sha256"),
        F.col("new.sha256").alias("observed_source_sha256"),
        F.when(fresh, F.lit(pipeline)).otherwise(F.col("old.pipeline_signature")).alias("pipeline_signature"),
        F.when(fresh, artifact_key(F.col("document_id"), F.col("new.sha256"), pipeline, nonce)).when(F.col("status") != "failed_new", F.col("old.artifact_key")).alias("artifact_key"),
        "status",
        F.when(fresh, F.col("report.pages")).otherwise(F.col("old.pages")).cast("long").alias("pages"),
        F.when(~fresh, F.col("old.chunks")).cast("long").alias("chunks"),
        F.when(F.col("status").isin("stale", "failed_new"), failed).when(F.col("status") == "missing_source", "the source file is gone; its last version stays").alias("error"),
    )


def in_order(records: DataFrame) -> DataFrame:
    """Records by path without regard to case, then by id."""
    return records.orderBy(F.lower(F.coalesce("source_path", F.lit(""))), "document_id")


def publication_signature(records: DataFrame, config: Config) -> str:
    """Hash of what a publication consists of, whatever the order of rows.

    The sum of row hashes stands for the rows, so nothing that grows with the documents reaches the driver.
    """
    row = F.xxhash64("document_id", "artifact_key", "status", "observed_source_sha256", "error")
    n, total = records.agg(F.count("*"), F.sum(row.cast("decimal(38,0)"))).first()
    return fingerprint({"records": n, "sum": str(total), "bm25": config.bm25_signature()})


def report(records: DataFrame, planned: DataFrame, chunks: int, published: bool, **flags: bool) -> dict:
    """Counts of a build by what became of its documents."""
    by = {r["status"]: r["n"] for r in records.groupBy("status").agg(F.count("*").alias("n")).collect()}
    does = {r["action"]: r["n"] for r in planned.groupBy("action").agg(F.count("*").alias("n")).collect()}
    bad = by.get("stale", 0) + by.get("failed_new", 0)
    return {
        "status": "partial" if bad else "complete", **flags, "published": published, "active_documents": sum(by.values()) - by.get("failed_new", 0), "active_chunks": chunks,
        "reused_documents": does.get("reuse", 0), "updated_documents": by.get("active", 0) - does.get("reuse", 0), "stale_documents": by.get("stale", 0),
        "missing_source_documents": by.get("missing_source", 0), "failed_documents": by.get("failed_new", 0),
    }


@dataclass
class Index:
    """An index under a folder: its store, settings, the parser of files and the embedder of chunks.

    ``parse`` takes rows of document_id, source, content and gives block rows with document_id, and report rows with
    document_id, ok, pages, error.
    """

    spark: SparkSession
    root: str
    parse: Callable[[DataFrame], tuple[DataFrame, DataFrame]]
    embedder: embedding.Embedder
    embedding_name: str
    config: Config = DEFAULT
    lock: str | None = None

    def __post_init__(self):
        self.store = IndexStore(self.spark, self.root)

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.store.read(name) if self.store.exists() else self.spark.createDataFrame([], schema)

    def build(self, files: DataFrame, *, force: bool = False, strict: bool = False, prune_missing: bool = False) -> dict:
        """Brings the index up to the files (document_id, source, source_path, sha256, content) and returns the report.

        With ``strict`` a file that fails stops the build; nothing to publish stops it as well.  The generation in use changes
        only by the last step.
        """
        with exclusive_lock(self.lock):
            return self._build(files, force, strict, prune_missing)

    def _build(self, files: DataFrame, force: bool, strict: bool, prune_missing: bool) -> dict:
        if files.isEmpty():
            raise BuildError("no files; the index stays as it is")
        pipeline = self.config.pipeline_signature(self.embedding_name)
        chunk_schema = f"{chunking.CHUNK}, chunk_id string, artifact_key string"
        records, old_chunks = self._table("records", RECORD), self._table("chunks", chunk_schema)
        old_vectors = self._table("vectors", "chunk_id string, embedding array<float>, artifact_key string")
        sound = artifact_faults(old_chunks, old_vectors)
        planned = self.store.stage("plan", plan(files, records, sound, pipeline, force=force, prune_missing=prune_missing))
        todo = files.join(planned.where("action = 'process'").select("document_id"), "document_id", "left_semi")
        blocks, parsed = self.parse(todo)
        blocks, parsed = self.store.stage("blocks", blocks), self.store.stage("parsed", parsed)
        if strict and not parsed.where("not coalesce(ok, false)").isEmpty():
            raise BuildError("strict: a file failed; the index stays as it is")
        new = self.store.stage("new-records", reconciled(planned, parsed, pipeline, uuid.uuid4().hex if force else ""))
        if strict and not new.where("status in ('stale', 'failed_new')").isEmpty():
            raise BuildError("strict: a file failed; the index stays as it is")
        live = new.where("artifact_key is not null")
        if live.isEmpty():
            raise BuildError("no document can be published; the index stays as it is")
        keys = live.select("document_id", "artifact_key")
        refined, audit = cleaning.cleaned(blocks.join(parsed.where("ok").select("document_id"), "document_id", "left_semi"), self.config)
        refined = self.store.stage("refined", refined)
        made = chunking.chunk_documents(refined, self.config).join(keys, "document_id")
        made = self.store.stage("made", made)
        broken = chunking.integrity(refined, made).where("not complete")
        if not broken.isEmpty():
            raise BuildError("chunks do not hold every block; the index stays as it is")
        without = live.join(planned.where("action = 'process'"), "document_id", "left_semi").where("status = 'active'").join(made, "document_id", "left_anti")
        if not without.isEmpty():
            raise BuildError("a document has no text; the index stays as it is")
        fresh = embedding.embedded(made, "chunk_id", self.embedder).join(made.select("chunk_id", "artifact_key"), "chunk_id")
        kept = live.select("artifact_key").distinct()
        chunks = self.store.stage("all-chunks", old_chunks.join(kept, "artifact_key", "left_semi").select(*made.columns).union(made))
        vectors = self.store.stage("all-vectors", old_vectors.join(kept, "artifact_key", "left_semi").select("chunk_id", "embedding", "artifact_key").union(fresh.select("chunk_id", "embedding", "artifact_key")))
        counts = chunks.groupBy("artifact_key").agg(F.count("*").alias("n"))
        final = new.join(counts, "artifact_key", "left").withColumn("chunks", F.coalesce("n", "chunks")).select(*records.columns)
        final = self.store.stage("final-records", final)
        signature = publication_signature(final, self.config)
        current = self.store.exists() and self.store.note().get("signature") == signature and self.current_is_sound()
        if not current:
            faults = embedding.vector_faults(vectors, "chunk_id").first()
            if faults["sizes"] != 1 or faults["not_finite"] or faults["repeated_ids"]:
                raise BuildError(f"vectors are not fit to publish: {faults.asDict()}")
            tables = {"records": final, "chunks": chunks, "vectors": vectors, "audit": audit}
            self.store.publish(tables, {"chunks": "chunk_id", "vectors": "chunk_id", "records": "document_id"}, {"signature": signature, "pipeline": pipeline, "bm25": self.config.bm25_signature()})
        out = report(final, planned, chunks.count(), not current, force=force, strict=strict, prune_missing=prune_missing)
        self.store.clear_stage()
        return out

    def current_is_sound(self) -> bool:
        """Whether the generation in use reads back: a vector for each chunk and the settings of the sparse index."""
        if self.store.note().get("bm25") != self.config.bm25_signature():
            return False
        chunks, vectors = self.store.read("chunks").select("chunk_id"), self.store.read("vectors").select("chunk_id")
        return chunks.exceptAll(vectors).isEmpty() and vectors.exceptAll(chunks).isEmpty()

    def status(self) -> dict:
        """Whether questions can be asked, and of how many documents and chunks."""
        if not self.store.exists():
            return {"ready": False, "documents": 0, "chunks": 0}
        documents = self.store.read("records").where("artifact_key is not null").count()
        return {"ready": True, "documents": documents, "chunks": self.store.read("chunks").count()}
