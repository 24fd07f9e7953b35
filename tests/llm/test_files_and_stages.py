"""Layout of token files, the classifier's odd rows, and the first stages of the pipeline against plain versions."""

import random
from collections import defaultdict

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_ops import shingles
from test_quality import plain_posteriors, plain_votes

import corpus_pipeline
from docsift.llm import quality_classifier, token_output

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("encoding", "kinds"), [("dictionary", {"PLAIN_DICTIONARY", "RLE_DICTIONARY"}), ("delta", {"DELTA_BINARY_PACKED"})])
def test_layout_of_token_files(spark, tmp_path, encoding, kinds):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    token_output.write_token_files(docs, f"file://{tmp_path}/ids", public_tokenizers.path("byte_bpe_50k.json"), encoding=encoding, row_group_bytes=64 << 10, page_bytes=8 << 10)
    files = [pq.ParquetFile(f) for f in sorted((tmp_path / "ids").glob("*.parquet"))]
    groups = [f.metadata.row_group(k) for f in files for k in range(f.metadata.num_row_groups)]
    assert sum(g.num_rows for g in groups) == docs.count()
    assert len(groups) > len([f for f in files if f.metadata.num_rows])
    for g in groups:
        for column in (g.column(k) for k in range(g.num_columns)):
            assert column.has_offset_index
            assert column.has_column_index
            if column.path_in_schema.startswith("ids"):
                assert kinds & set(column.encodings)
    # Metadata alone: the pages of ids are not among the columns that are read.
    rows = token_output.read_token_files(spark, f"file://{tmp_path}/ids").select("doc_id", "start", "n_tokens")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1].split("\n")[0]
    total = rows.agg(F.sum("n_tokens"), F.max(F.col("start") + F.col("n_tokens"))).first()
    assert total[0] == total[1]


def test_classifier_takes_odd_rows(spark):
    """Null ids, repeated rows, empty and very long texts and clashing columns, with a model that was fitted."""
    rng = random.Random(4)
    good = lambda n: " ".join(rng.choice(["the", "river", "and", "stone", "walked", "over", "slowly"]) for _ in range(n))
    bad = lambda n: " ".join(rng.choice(["BUY!!", "$$$", "click", "NOW!!", "***", "win%%%"]) for _ in range(n))
    rows = [(k, good(60) if k % 2 else bad(60)) for k in range(300)]
    odd = [(None, good(60)), (None, None), (5, rows[5][1]), (5, rows[5][1]), (901, ""), (902, good(60_000)), (903, bad(60_000)), (904, "x")]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(300)], "doc_id long, quality int, toxic int")
    plain = spark.createDataFrame(rows + odd, "doc_id long, text string")
    clashing = plain.select("*", F.lit(0.1).alias("score"), F.lit(1).alias("quality"), F.lit(True).alias("held_out"), F.lit("x").alias("lang"))
    got = [sorted(map(tuple, quality_classifier.scores(df, labels).collect()), key=str) for df in (plain, clashing)]
    assert got[0] == got[1]
    assert len(got[0]) == len(rows) + len(odd)
    assert all(0 <= r[2] <= 1 and r[3] == int(r[2] >= 0.5) for r in got[0])
    of = defaultdict(set)
    for r in got[0]:
        of[r[0]].add(r[2])
    assert len(of[5]) == 1
    assert min(of[902]) > 0.5 > max(of[903])


def test_first_stages_equal_plain_versions(spark, tmp_path):
    """Quality rules by vectors over plain votes, then groups by all pairs of shingle sets."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    votes = [plain_votes(t) for _, t in rows]
    good = plain_posteriors([v for v, _ in votes])
    kept = [(i, t) for (i, t), (_, failed), g in zip(rows, votes, good, strict=True) if not failed and g >= 0.5]
    first = corpus_pipeline.quality(spark, docs, SF)
    assert sorted(r.doc_id for r in first.collect()) == sorted(i for i, _ in kept)
    assert first.columns == docs.columns
    sets = {i: shingles(t) for i, t in kept}
    group = {i: i for i in sets}
    for a in sorted(sets):
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    second = corpus_pipeline.near_dedup(spark, first, SF)
    assert sorted(r.doc_id for r in second.collect()) == sorted(i for i, g in group.items() if i == g)
    assert second.columns == docs.columns
