"""Token-id files as Parquet list columns (operator 10).

Documents are dealt by range of doc_id, each task encodes its range in order and writes one file: doc_id, the document's
place in the file and its ids, the end id included.  Ids are dictionary encoded (``encoding="dictionary"``) or written as
binary-packed deltas (``"delta"``); row groups and pages have set sizes, and the writer adds page indexes, so a reader can
fetch the metadata columns or a range of documents without touching other pages.  Where a document starts in the whole
corpus follows from the totals of the files, one row each.

Results: a null text counts as empty (the end id alone); a null doc_id sorts first; rows with equal doc_id are ordered by
their text, so repeated rows each get their own place; an empty table gives files without rows and an empty result;
columns other than id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docsift.llm.bpe import LEAN_MEMO_CHARS, Memo, load
from docsift.llm.common import batch_rows, lean, scratch_path, texts

SCHEMA = "shard int, doc_id long, shard_start long, n_tokens long, ids array<int>"


@lru_cache(4)
def _ids(path: str) -> Memo:
    """Little-endian ids of a pre-token, from the byte-pair model of the tokenizers library."""
    model, shaped = Tokenizer.from_file(path).model, load(path).shaped
    return Memo(lambda word: np.array([t.id for t in model.tokenize(shaped(word))], "<u4").tobytes(), LEAN_MEMO_CHARS)


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Rows of ``SCHEMA`` in ascending doc_id order within and across partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memo, shard, start = load(tokenizer_path), _ids(tokenizer_path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            doc_ids, starts, counts, data = [], [], [], []
            for doc_id, text in batch_rows(batch, "doc_id", "text"):
                parts = []
                for section, added in model.sections(text):
                    if added >= 0:
                        parts.append(np.array([added], "<u4").tobytes())
                    else:
                        parts += map(memo.__getitem__, model.words(section))
                parts.append(end)
                data.append(b"".join(parts))
                doc_ids.append(doc_id)
                starts.append(start)
                counts.append(len(data[-1]) // 4)
                start += counts[-1]
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(data), "<i4")))
            yield pa.RecordBatch.from_arrays([pa.array([shard] * len(doc_ids), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), ids], ["shard", "doc_id", "shard_start", "n_tokens", "ids"])

    return texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(lean(run), SCHEMA)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, *, end_id: int = 0, encoding: str = "dictionary", row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10) -> None:
    """Write the ids of ``docs`` under ``path``."""
    options = {"parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.dictionary.page.size": 4 << 20, "parquet.enable.dictionary": str(encoding == "dictionary").lower(), "parquet.writer.version": "PARQUET_2_0" if encoding == "delta" else "PARQUET_1_0", "parquet.page.write-checksum.enabled": "true"}
    encoded(docs, tokenizer_path, end_id).write.options(**{k: str(v) for k, v in options.items()}).parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each file, so the one task that adds them up reads as many rows as there are files.
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("total")).select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    return rows.join(F.broadcast(totals), "shard").select("doc_id", (F.col("offset") + F.col("shard_start")).alias("start"), "n_tokens", "ids")


def with_checksum(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (unsigned, over little-endian 32-bit ids) from the ids that were read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            flat, cuts = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            keep = [batch.column(batch.schema.get_field_index(n)) for n in ("doc_id", "start", "n_tokens")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digests(docs: DataFrame, tokenizer_path: str, label: str = "token-files") -> DataFrame:
    """Write the files to the shared folder, read them back and return what they hold of each document.

    The files are removed when the driver ends; ``write_token_files`` keeps them where the caller says.
    """
    path = scratch_path(docs.sparkSession, label)
    write_token_files(docs, path, tokenizer_path)
    return with_checksum(read_token_files(docs.sparkSession, path))
