"""Findings of the reviews on odd and larger tables: queries against their SQL or plain loops, and what a plan holds and moves."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from docsift.functions import text as T
from docsift.operators import cleaning, retrieval
from docsift.plans import catalogue
from docsift.sources import scratch

SF = "/root/testdata/sf0.001"


def sql_rows(name, **tables):
    con = duckdb.connect()
    for table, path in tables.items():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
    result = con.execute(catalogue.oracle_sql()[name])
    return [d[0] for d in result.description], sorted(map(tuple, result.fetchall()))


@pytest.fixture
def tables(spark, tmp_path):
    """Writes tables and gives the folder."""

    def write(**frames):
        for name, (rows, schema) in frames.items():
            spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_long_lines_of_two_types_are_named_as_in_the_sql(spark, tables):
    long, short = "x" * 1501, "y"
    texts = [[long, long, short], [short, long, *[short] * 5, long], [short, long], [long], [short], [*[long] * 9]]
    folder = tables(documents=([(k, "\n".join(t)) for k, t in enumerate(texts)], "doc_id long, text string"))
    columns, want = sql_rows("chunk_length_report", documents=f"{folder}/documents.parquet")
    got = catalogue.queries()["chunk_length_report"](spark, folder).select(columns).collect()
    assert sorted(map(tuple, got)) == want
    assert {"table,text", "text,table"} <= {r.above_hard_types for r in got}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


TEXTS = ["北京的天气 fox 2024 95.5%", "the Quick-brown fox_jumps the fox", "天 the over a.b.c", "", "!!! ...", "THE the thE", "ünïcode naïve K 3.14.15％ x"]


def test_words_equal_the_column_expression(spark):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("aZk9.5_+-% 京天％é\\n\\u2028") for _ in range(80)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", T.tokens(F.col("text")).alias("t"))
    assert {r.k: r.t for r in df.collect()} == {k: T.words(t) for k, t in enumerate(texts)}


@pytest.mark.parametrize("sizes", [{}, {"QUERY_BLOCK": 2, "CELLS": 4, "TEXTS": 2}])
@pytest.mark.parametrize("most", [1_000_000, 7])
def test_rankings_equal_sql_with_repeated_ids_and_null_texts(spark, tables, monkeypatch, sizes, most):
    """Two rows of one id count twice and a null text has no length, as in the SQL; ties go by id, also over many blocks."""
    for name, value in sizes.items():
        monkeypatch.setattr(retrieval, name, value)
    monkeypatch.setattr(retrieval.Postings, "MOST_TERMS", most)
    rng = random.Random(4)
    vocabulary = "the fox jumps over lazy dogs while seven wizards brew potions".split()
    text = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 6)))
    docs = [(k // 2 if k < 8 else k, text()) for k in range(90)] + [(200, None), (201, ""), (202, "other words")]
    docs += [(k, "seven wizards") for k in range(300, 345)]
    folder = tables(documents=(docs, "doc_id long, text string"), benchmark=([(k, text()) for k in range(9)] + [(90, None), (91, "absent")], "item_id long, text string"))
    for name in ("bm25_topk", "rrf_fusion"):
        columns, want = sql_rows(name, documents=f"{folder}/documents.parquet", benchmark=f"{folder}/benchmark.parquet")
        got = catalogue.queries()[name](spark, folder).select(columns).collect()
        assert [tuple(r) for r in sorted(map(tuple, got))] == want


def test_rankings_shuffle_no_pairs_of_query_and_document(spark):
    """What is shuffled is what tasks keep, for each of the rankings once; pairs were joined and aggregated before."""
    docs, items = catalogue.Tables(spark, SF).docs(), catalogue.Tables(spark, SF).items()
    postings = retrieval.Postings(docs, items, "doc_id", "item_id")
    for ranking in (postings.bm25_topk(30), postings.overlap_topk(30)):
        text = plan(ranking)
        assert "Join" not in text
        assert "Aggregate" not in text
        assert text.count("Exchange") == 1


def test_best_rows_equal_a_sort():
    rng = np.random.default_rng(5)
    for k in (1, 3, 50):
        scores = np.round(rng.normal(size=(400, 7)), 1)
        scores[rng.random(scores.shape) < 0.02] = np.nan
        scores[rng.random(scores.shape) < 0.1] = -np.inf
        scores[:, 6] = 1.0
        ids, best = rng.permutation(400), retrieval.Best(7, k)
        for at in range(0, 400, 9):
            best.add(ids[at : at + 9], scores[at : at + 9])
        got = list(zip(*(x.tolist() for x in best.rows()), strict=True))
        for q in range(7):
            rows = sorted((0 if np.isnan(s) else 1, 0 if np.isnan(s) else -s, i) for i, s in zip(ids.tolist(), scores[:, q].tolist(), strict=True) if s > -np.inf or np.isnan(s))
            assert [i for p, i, _ in got if p == q] == [i for *_, i in rows[:k]]


def test_best_rows_hold_little(monkeypatch):
    """Rows that tie in all queries, as copies of one document do."""
    monkeypatch.setattr(retrieval, "CELLS", 100)
    best = retrieval.Best(10, 5)
    for at in range(0, 5000, 10):
        best.add(np.arange(at, at + 10), np.ones((10, 10)))
        assert sum(len(s) for *_, s in best.held) == best.size <= 200
    assert sorted(best.rows()[1].tolist()) == sorted(list(range(5)) * 10)


def test_containing_moves_no_text(spark):
    """Texts are compared in the task that reads them; they were shuffled by document and by item before."""
    t = catalogue.Tables(spark, SF)
    text = plan(retrieval.containing(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), t.items(), "doc_id", "item_id"))
    assert "BroadcastHashJoin" in text
    assert "SortMergeJoin" not in text
    assert text.count("Exchange") == text.count("BroadcastExchange")


def test_containing_with_repeated_ids_and_blocks(spark, tables, monkeypatch):
    """A document's row counts once for each item that it holds, also if ids repeat; four pairs came of two rows before."""
    monkeypatch.setattr(retrieval, "KEYED_BLOCK", 2)
    docs = [(1, "aa the quick brown fox jumps"), (1, "bb the quick brown fox jumps"), (2, "the quick\nbrown fox"), (3, None), (4, "quick quick brown quick brown")]
    items = [(k, x) for k, x in enumerate(["the quick brown fox", "the quick\nbrown fox", "quick brown fox", "e quick brown f", "uick quick bro", "no such words here"])]
    folder = tables(documents=(docs, "doc_id long, text string"), benchmark=(items, "item_id long, text string"))
    columns, want = sql_rows("gold_pairs", documents=f"{folder}/documents.parquet", benchmark=f"{folder}/benchmark.parquet")
    assert sorted(map(tuple, catalogue.queries()["gold_pairs"](spark, folder).select(columns).collect())) == want


@pytest.mark.parametrize("name", ["prompt_prefix", "prompt_context", "sent_dropped", "rerank_topk"])
def test_texts_of_hits_are_not_shuffled(spark, monkeypatch, name):
    """The hits go to the tasks that read the texts, whatever the size up to which Spark itself does so."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = []
        real = retrieval.with_rows
        monkeypatch.setattr(retrieval, "with_rows", lambda *a: asked.append(real(*a)) or asked[-1])
        catalogue.queries()[name](spark, SF)
        text = plan(asked[0])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in text
    assert "SortMergeJoin" not in text


def test_many_hits_are_joined_by_shuffling(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "MOST_HITS", 2)
    hits, rows = spark.createDataFrame([(k % 3, k) for k in range(9)], "doc_id long, rank long"), spark.createDataFrame([(0, "a"), (1, "b")], "doc_id long, text string")
    assert sorted(map(tuple, retrieval.with_rows(hits, rows, "doc_id").collect())) == sorted((k % 3, k, "ab"[k % 3]) for k in range(9) if k % 3 < 2)


def test_dense_search_equals_sql_with_ties_and_nan(spark, tables):
    """Vectors that are not numbers come first in SQL; those of a batch of more than k rows were lost."""
    rng = random.Random(6)
    rows = [(k, [rng.choice([0.0, 0.5, 1.0]) for _ in range(4)], 0) for k in range(700)]
    rows[650] = (650, [float("nan"), 0.0, 0.0, 1.0], 0)
    folder = tables(embeddings=(rows, "vec_id long, embedding array<float>, label int"))
    columns, want = sql_rows("dense_topk", embeddings=f"{folder}/embeddings.parquet")
    got = sorted(map(tuple, catalogue.queries()["dense_topk"](spark, folder).select(columns).collect()))
    assert repr(got) == repr(want)
    assert any(r[1] == 650 for r in got)


def test_dense_search_multiplies_some_rows_at_a_time(spark, monkeypatch):
    """A worker's product has 4 * CELLS numbers at most; it had a whole Arrow batch by a block of queries before."""
    monkeypatch.setattr(retrieval, "CELLS", 25)
    seen = []
    monkeypatch.setattr(retrieval.Best, "add", lambda self, ids, scores: seen.append(scores.shape))
    vectors = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(300)], "vec_id long, embedding array<float>")
    caught = []
    real = type(vectors).mapInPandas
    monkeypatch.setattr(type(vectors), "mapInPandas", lambda self, f, schema: caught.append(f) or real(self, f, schema))
    retrieval.dense_topk(vectors, vectors.where("vec_id < 10"), "vec_id", "vec_id")
    list(caught[0]([vectors.selectExpr("vec_id as vec", "embedding").toPandas()]))
    assert sum(n for n, _ in seen) == 300
    assert max(n * q for n, q in seen) <= 100


def test_cleaning_shuffles_blocks_once(spark):
    """Every step is a window within a document; blocks were joined with themselves, and shuffled and cleaned again for it."""
    t = catalogue.Tables(spark, SF)
    text = plan(cleaning.audit(cleaning.traced(t.blocks().drop("level", "atomic"))))
    assert "Join" not in text
    assert text.count("Exchange hashpartitioning(document_id") == 1
    assert text.count("Scan parquet") == 1


def test_merged_blocks_are_the_pairs_of_pages(spark):
    """Pairs by windows against pairs by aggregation, with excluded blocks and chains through pages of one block."""
    rng, rows = random.Random(8), []
    for d in range(150):
        seq = 0
        for page in range(1, rng.randint(2, 7)):
            for _ in range(rng.choice([1, 1, 2, 3])):
                rows.append((d, seq, rng.choice(["Alpha beta", "goes on", "retriev-", "ends here.", " "]), page + (page > 3 and d % 3 == 0), rng.choice(["text", "text", "text", "table"]), rng.random() < 0.2))
                seq += 1
    blocks = cleaning.prepared(spark.createDataFrame(rows, "document_id long, block_seq int, text string, page int, block_type string, excluded boolean"))
    want = {(r.document_id, r.left_seq, r.right_seq, r.text) for r in cleaning.cross_page_merges(blocks).collect()}
    done = cleaning.merged(blocks).collect()
    assert len(done) == len(rows)
    texts = {(r.document_id, r.block_seq): r.text for r in done if r.operations and r.operations[-1].op == "cross_page_paragraph_merge"}
    assert texts == {(d, left): text for d, left, _, text in want}
    assert {(r.document_id, r.block_seq) for r in done if r.gone} == {(d, right) for d, _, right, _ in want}
    assert len(want) > 30


def test_terms_are_counted_in_bounded_parts(spark, monkeypatch):
    """Documents are dealt by id into parts that follow their bytes; the terms of a whole input split were held and shuffled."""
    text = plan(catalogue.queries()["tokenize_terms"](spark, SF))
    assert text.count("Exchange hashpartitioning(doc_id") == 1
    assert text.index("Generate") < text.index("Exchange hashpartitioning(doc_id")
    docs = catalogue.Tables(spark, SF).docs()
    monkeypatch.setattr(scratch, "PART", 1000)
    assert scratch.dealt(docs, "doc_id").rdd.getNumPartitions() == -(-scratch._bytes(docs) // 1000) > 8


def test_terms_of_repeated_ids_add_up(spark, tables):
    folder = tables(documents=([(k % 3, x) for k, x in enumerate(["a b a", "c", None, "a", "", "d d", "b A"])], "doc_id long, text string"))
    columns, want = sql_rows("tokenize_terms", documents=f"{folder}/documents.parquet")
    assert sorted(map(tuple, catalogue.queries()["tokenize_terms"](spark, folder).select(columns).collect())) == want
