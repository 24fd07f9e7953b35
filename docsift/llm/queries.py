"""The ten training-data queries, each over its whole table with production parameters, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.llm import bpe, decontamination, license_scan, minhash_forest, pii, quality_classifier, quality_rules, suffix_dedup, token_counts, token_output
from docsift.llm.common import materialize, read_table

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.near_duplicates(read_table(spark, sf_dir, "documents"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents")).drop("kept")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(read_table(spark, sf_dir, "documents")))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licence_matches(read_table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(quality_rules.counted(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "counts"), "quality-counts")
    judged = quality_rules.verdicts(rows, quality_rules.fitted(rows))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *(F.col(f"counts.{n}") for n in names), "base_failed", "kept", F.round("quality_probability", 6).alias("quality_probability"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoding_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_file_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


# The same results in SQL: all pairs that share a shingle, closed over links; every 200-byte string by its hash.
OP2_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda k: array_to_string(w[k:k + 4], chr(1)))) AS g FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
p AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
c(doc_id, m) AS (SELECT doc_id, doc_id FROM w UNION SELECT p.a, c.m FROM c JOIN p ON p.b = c.doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, min(m) AS component_id, min(m) = doc_id AS kept FROM c LEFT JOIN n USING (doc_id) GROUP BY doc_id, n"""
OP3_SQL = r"""WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
k AS (SELECT doc_id, h, unnest(range(greatest(len(h) // 2 - 199, 0))) AS s FROM h), m AS (SELECT doc_id, s, md5(substring(h, 2 * s + 1, 400)) AS m FROM k),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY m) AS n FROM m) WHERE n > 1),
g AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM (SELECT doc_id, s, CASE WHEN s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 200 THEN 1 ELSE 0 END AS fresh FROM r)),
u AS (SELECT doc_id, run, min(s) AS a, max(s) + 200 AS b FROM g GROUP BY doc_id, run),
v AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM u),
q AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substring(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substring(any_value(h), 2 * max(b) + 1) AS left_over FROM v JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(left_over, h))) AS kept_sha256 FROM h LEFT JOIN q USING (doc_id)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_benchmark_decontamination, op2_minhash_near_dedup, op3_suffix_array_dedup, op4_pii, op5_license_scan)
    found += (op6_quality_rules, op7_quality_classifier, op8_bpe_encoding, op9_token_counts, op10_token_output)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """SQL where it can say the same; the others hold estimates, models or tokenizers and are tested against plain versions."""
    return {"op2_minhash_near_dedup": OP2_SQL, "op3_suffix_array_dedup": OP3_SQL}
