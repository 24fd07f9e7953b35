"""Fixtures with known results and comparisons with plain loops."""

import json
import random

import pytest
from pyspark.sql import functions as F

from docsift.functions import text as T
from docsift.operators import answers, chunking, cleaning, evaluation, retrieval
from docsift.sources import readers
from docsift.streaming import ingest


def test_tokens(spark):
    df = spark.createDataFrame([("北京 Qwen3-Embedding-0.6B 2024 95.5% !!!",), ("!!! ...",)], "text string")
    got = [r[0] for r in df.select(T.tokens(F.col("text"))).collect()]
    assert got == [["北京", "qwen3-embedding-0.6b", "2024", "95.5%"], []]


def test_repeat_key(spark):
    assert spark.range(1).select(T.repeat_key(F.lit("Page 12 of MIX iv a1"))).first()[0] == "page <PAGE> of <PAGE> <PAGE> a1"


def test_margins(spark):
    rows = [("d", p, 3 * p + k, t) for p in range(1, 6) for k, t in enumerate(("RAG 学习报告", f"第 {p} 页正文。", f"- {p} -"))]
    boxed = [(*r, "text", [0.0, 0.4, 1.0, 0.5] if r[2] % 3 == 0 else None, None) for r in rows]
    boxed = spark.createDataFrame(boxed, "document_id string, page int, block_seq int, text string, block_type string, bbox array<double>, page_height double")
    # A box in the middle of the page is no margin, whatever the order.
    assert "rag 学习报告" not in {r.key for r in cleaning.repeated_margins(boxed).collect()}
    got = {(r.position, r.key, r.hits) for r in cleaning.repeated_margins(spark.createDataFrame(rows, "document_id string, page int, block_seq int, text string")).collect()}
    assert ("header", "rag 学习报告", 5) in got
    assert ("footer", "- <PAGE> -", 5) in got


def test_titles(spark):
    texts = ["1.RAG技术", "1.2 检索增强", "1.2.1 查询重写", "正文内容。", "第一章 基础", "第一节 检索", "一、总体方案", "（一）实现细节", "第一章 基础：", "1　检索", "（1）弱编号"]
    df = spark.createDataFrame([(k, t, "text") for k, t in enumerate(texts)], "n int, text string, block_type string")
    assert [r.level for r in cleaning.titles(df).orderBy("n").collect()] == [1, 2, 3, None, 1, 2, 1, 2, 1, 1, None]
    kinds = ["header", "footnote", "title", "list"]
    df = spark.createDataFrame([(k, "（1）弱编号" if t == "title" else "第一章 基础", t) for k, t in enumerate(kinds)], "n int, text string, block_type string")
    assert [r.level for r in cleaning.titles(df).orderBy("n").collect()] == [1, None, 3, None]


def test_section_paths_equal_a_stack(spark):
    rng, rows, want = random.Random(5), [], {}
    for d in range(60):
        stack: list[str] = []
        for k in range(rng.randint(1, 25)):
            level = rng.choice([None, 1, 2, 3, 4, 5, 6])
            rows.append((str(d), k, f"t{k}", level))
            if level is not None:
                level = min(level, len(stack) + 1, 6)
                stack = [*stack[: level - 1], f"t{k}"]
            want[str(d), k] = stack
    df = spark.createDataFrame(rows, "document_id string, block_seq int, text string, level int")
    assert {(r.document_id, r.block_seq): r.section_path for r in cleaning.section_paths(df).collect()} == want


def merged(a, b):
    a, b = a.rstrip(), b.lstrip()
    if a.endswith("."):
        return None
    if a.endswith("-"):
        return a[:-1] + b
    return a + " " + b if b[0].islower() else None


def test_cross_page_merges_equal_a_loop(spark):
    rng, rows, want = random.Random(6), [], set()
    for d in range(80):
        pages = [[rng.choice(["Alpha beta", "gamma delta long text", "retriev-", "this one ends here."]) for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 6))]
        seq, at = 0, []
        for p, blocks in enumerate(pages, 1):
            at.append((p, seq, seq + len(blocks) - 1))
            rows += [(str(d), p, seq + k, t) for k, t in enumerate(blocks)]
            seq += len(blocks)
        used, flat = set(), [t for blocks in pages for t in blocks]
        for (p, _, left), (_, right, _) in zip(at, at[1:], strict=False):
            if left not in used and merged(flat[left], flat[right]):
                used |= {left, right}
                want.add((str(d), p, left, right, merged(flat[left], flat[right])))
    df = spark.createDataFrame(rows, "document_id string, page int, block_seq int, text string")
    assert {tuple(r)[:5] for r in cleaning.cross_page_merges(df).collect()} == want


def test_merge_texts(spark):
    pairs = [("retriev-", "al improves quality", "retrieval improves quality"), ("Retrieval uses dense", "and sparse signals", "Retrieval uses dense and sparse signals"), ("该方法同时使用稠密检索，", "并结合稀疏召回提高效果", "该方法同时使用稠密检索，并结合稀疏召回提高效果"), ("Complete sentence.", "next begins lower", None)]
    df = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a string, b string")
    assert [r[0] for r in df.select(cleaning.merge_rule(F.col("a"), F.col("b"))["text"]).collect()] == [w for *_, w in pairs]


def block(k, text, path=("章",), kind="text", atomic=False, page=1):
    return {"block_seq": k, "text": text, "block_type": kind, "section_path": list(path), "atomic": atomic, "block_id": str(k), "source_block_ids": None, "page_start": page, "page_end": None, "captions": 0}


@pytest.mark.parametrize(
    ("blocks", "ids"),
    [
        ([block(0, "a" * 420), block(1, "b" * 420)], [[0, 1]]),
        ([block(0, "a" * 450, ("章", "1.1")), block(1, "b" * 450, ("章", "1.2"))], [[0, 1]]),
        ([block(0, "a" * 450, ("章",)), block(1, "b" * 450, ("他",))], [[0], [1]]),
        ([block(0, "公式解释" * 40), block(1, "x" * 900, kind="equation")], [[0, 1]]),
        ([block(0, "表一", kind="table_caption"), block(1, "| a |\n| b |", kind="table")], [[0, 1]]),
        # The target ends a region only after a join, so a section that has it already still takes a small sibling.
        ([block(0, "a" * 1100, ("章", "1.1")), block(1, "b" * 300, ("章", "1.2"))], [[0, 1]]),
        ([block(0, "a" * 700, ("章", "1.1")), block(1, "b" * 400, ("章", "1.2")), block(2, "c" * 100, ("章", "1.3"))], [[0, 1], [2]]),
        # An object is never cut, a long text is.
        ([block(0, "i" * 2000, kind="image")], [[0]]),
        ([block(0, "附录内容", ("章", "附录 A")), block(1, "b", ("章", "附录 B"))], [[0], [1]]),
    ],
)
def test_chunks(blocks, ids):
    assert [[int(i) for i in c["source_block_ids"]] for c in chunking.pack(blocks)] == ids


def test_chunk_metadata():
    made = chunking.pack([block(0, "t" * 200, ("章", "一"), page=2), block(1, "x=1", ("章", "一"), "equation", page=3), block(2, "u" * 100, ("章", "二"), page=4)])
    assert len(made) == 1
    c = made[0]
    assert (c["page"], c["page_end"], c["block_types"], c["block_type"], c["atomic"]) == (2, 4, ["text", "equation"], "mixed", False)
    assert (c["section_path"], c["section_paths"], c["region_end"]) == (["章"], [["章", "一"], ["章", "二"]], "no_compatible_sibling")
    rows = "\n".join(["head", *(f"{k} " + "r" * 110 for k in range(30))])
    table = chunking.pack([block(0, "标题", kind="caption"), block(1, rows, kind="table")])
    assert [(c["table_id"], c["table_part_index"], c["table_part_count"], c["atomic"]) for c in table] == [("1", k, len(table), True) for k in range(1, len(table) + 1)]
    assert all(c["text"].split("\n")[1:3] == ["标题", "head"] for c in table)
    assert [c["atomic"] for c in chunking.pack([block(0, "x" * 100, kind="equation")])] == [True]


def test_plain_splitting():
    text = "第一句话说明问题。" * 200
    made = chunking.pack_plain([block(0, text), block(1, "\n".join(["head", "r" * 700, "s" * 700, "t" * 2000]), kind="table")])
    assert all(len(c["text"]) <= 800 for c in made)
    rows = [c["text"] for c in made if c["block_type"] == "table"]
    assert all(t.startswith("head\n") for t in rows)
    assert "".join(t.split("\n", 1)[1] for t in rows) == "r" * 700 + "s" * 700 + "t" * 2000
    plain = [c["text"] for c in made if c["block_type"] == "text"]
    assert len(plain) > 2
    # Neighbours overlap.
    assert all(b[:9] in a for a, b in zip(plain, plain[1:], strict=False))


def test_long_text_and_table():
    parts = chunking.pack([block(0, "一段正文。" * 400)])
    assert len(parts) > 1
    assert all(len(p["text"]) <= 1500 for p in parts)
    table = chunking.table_rows("\n".join(["head", *("r" * 110 for _ in range(30))]), 1200, 0)
    assert len(table) > 1
    assert all(p.startswith("head\n") for p in table)
    assert all(len(p) <= 80 for p in chunking.split_text("a" * 200, 80, 10))


def test_fusion(spark):
    hits = lambda names: spark.createDataFrame([("q", n, k) for k, n in enumerate(names, 1)], "q string, chunk string, rank int")
    got = retrieval.reciprocal_rank_fusion({"dense": hits(["shared", "dense-only"]), "bm25": hits(["shared", "bm25-only"])}, "q", "chunk").orderBy("fusion_rank").collect()
    assert [r.chunk for r in got] == ["shared", "bm25-only", "dense-only"]
    assert got[0].fusion_score == pytest.approx(2 / 61, abs=1e-9)
    assert got[1].dense_rank is None


def test_rerank_and_gate(spark):
    hits = spark.createDataFrame([("q", str(k), k) for k in range(8)], "q string, c string, fusion_rank int")
    top = retrieval.rerank(hits, "q", "c", F.col("c").cast("double"))
    assert [r.c for r in top.orderBy("rerank_rank").collect()] == ["7", "6", "5", "4", "3"]
    queries = spark.createDataFrame([("q",), ("none",)], "q string")
    gate = {r.q: (r.status, r.reason, r.answerable) for r in retrieval.evidence_gate(queries, top, "q", None).collect()}
    assert gate == {"q": ("answerable", "threshold_not_calibrated", True), "none": ("no_candidates", "no_candidates", False)}
    gate = {r.q: (r.status, r.reason, r.answerable) for r in retrieval.evidence_gate(queries, top, "q", 1.0).collect()}
    assert gate == {"q": ("below_threshold", "below_threshold", False), "none": ("no_candidates", "no_candidates", False)}
    blank = top.withColumn("score", F.lit(None).cast("double"))
    assert retrieval.evidence_gate(queries, blank, "q", None).where("q = 'q'").first().answerable
    with pytest.raises(Exception, match="no score"):
        retrieval.evidence_gate(queries, blank, "q", 0.5).collect()


def test_prompt_and_citations(spark):
    hits = spark.createDataFrame([("q", 1, "x" * 10), ("q", 2, "y" * 10)], "q string, rank int, text string")
    assert [r.sent for r in answers.prompt_prefix(hits, "q", budget=14).orderBy("rank").collect()] == [True, False]
    done = lambda a, ranks: spark.range(1).select(answers.finalized(F.lit(a), F.array(*map(F.lit, ranks))).alias("a")).select("a.*").first()
    assert tuple(done("依据[1]，误引[2]。", [1])) == ("依据[1]，误引。", ["1"], 1)
    assert tuple(done("资料中没有找到相关内容。\n\n[1][2]", [1, 2])) == ("资料中没有找到相关内容。", [], 0)
    assert tuple(done("资料中没有找到相关内容。[7]", [1, 2])) == ("资料中没有找到相关内容。", [], 0)


def test_metrics(spark):
    items = spark.createDataFrame([("i",), ("none",)], "item string")
    hits = spark.createDataFrame([("i", s, k) for k, s in enumerate(["x", "a", "a2", "b"], 1)], "item string, doc string, rank int")
    gold = spark.createDataFrame([("i", "a"), ("i", "b")], "item string, doc string")
    got = {r.item: tuple(r)[1:] for r in evaluation.retrieval_metrics(items, hits, gold, "item", "doc", 3).collect()}
    assert got == {"i": (2, 1, 0.5, 0.5), "none": (0, None, None, None)}


def test_judge_json(spark):
    raws = ['```json\n{"correctness":3,"completeness":2,"relevance":3,"reason":"ok"}\n```', '{"correctness":4,"completeness":2,"relevance":3,"reason":"ok"}', "no json"]
    df = spark.createDataFrame([(r,) for r in raws], "raw string").select(evaluation.judge_fields().alias("j"))
    assert [r.j is not None for r in df.collect()] == [True, False, False]


def test_index_store(spark, tmp_path):
    store = readers.IndexStore(spark, f"file://{tmp_path}/index")
    first = store.publish({"chunks": spark.range(5)}, {"chunks": "id"})
    with pytest.raises(ValueError, match="stays in use"):
        store.publish({"chunks": spark.range(2).union(spark.range(2))}, {"chunks": "id"})
    assert store.current() == first
    assert store.read("chunks").count() == 5


def test_layout(spark, tmp_path):
    (tmp_path / "layout.json").write_text('{"pdf_info": [{"page_idx": 0, "preproc_blocks": [{"type": "text", "lines": [{"spans": [{"type": "text", "content": "first"}]}]}, {"type": "table", "lines": [{"spans": [{"type": "table", "html": "<table><tr><td>row one</td></tr></table>"}]}]}]}, {"page_idx": 1, "preproc_blocks": [{"type": "interline_equation", "lines": [{"spans": [{"content": "x"}, {"content": "=1"}]}]}]}]}')
    got = [(r.page, r.block_type, r.text) for r in readers.layout_blocks(spark, str(tmp_path)).orderBy("page", "block_seq").collect()]
    assert got == [(1, "text", "first"), (1, "table", "| row one"), (2, "equation", "x=1")]


def test_layout_child_and_discarded_blocks(spark, tmp_path):
    leaf = lambda kind, **span: {"type": kind, "lines": [{"spans": [span]}]}
    table = {"type": "table", "blocks": [leaf("table_footnote", content="note"), leaf("table_body", html="<table><tr><td>cell</td></tr></table>"), leaf("table_caption", content="Table 1")]}
    image = {"type": "image", "blocks": [{"type": "image_body", "blocks": [leaf("text", content="inner")]}, leaf("image_caption", content="Figure 1")]}
    margins = [leaf(k, content=k) for k in ("header", "abandon", "page_footnote", "footer", "page_number")]
    pages = [{"page_idx": 0, "preproc_blocks": [table, image, {"type": "text"}], "discarded_blocks": margins}, {"page_idx": 1, "preproc_blocks": [leaf("text", content="last")]}]
    (tmp_path / "layout.json").write_text(json.dumps({"pdf_info": pages}))
    got = [(r.page, r.block_type, r.text) for r in readers.layout_blocks(spark, str(tmp_path)).orderBy("page", "block_seq").collect()]
    assert got == [(1, "table", "Table 1\n| cell\nnote"), (1, "image", "inner\nFigure 1"), (1, "text", ""), *[(1, k, k) for k in ("header", "page_footnote", "footer", "page_number")], (2, "text", "last")]


@pytest.mark.parametrize(("kind", "title"), [("references", "B"), ("bibliography", "B"), ("text", "Appendix B"), ("text", "附录 B")])
def test_hard_boundaries(kind, title):
    assert len(chunking.pack([block(0, "short", ("Part", "A")), block(1, "short", ("Part", "B"))])) == 1
    assert len(chunking.pack([block(0, "short", ("Part", "A")), block(1, "short", ("Part", title), kind)])) == 2


def test_unsafe_members():
    assert all(map(readers.unsafe_member, ["/a", "../a", "a/../b", "a\\b", "c:a", "con.txt", "a.", "b /c"]))
    assert not any(map(readers.unsafe_member, ["a/b.json", "layout.json"]))


def test_server_sent_events():
    text = 'event: delta\ndata: {"t": "a"}\n\ndata: {"t": 2}\n\n'
    for size in (1, 3, 100):
        assert list(ingest.sse_events(text[k : k + size] for k in range(0, len(text), size))) == [("delta", {"t": "a"}), ("message", {"t": 2})]


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").write.parquet(f"{tmp_path}/in")
    seen = []
    q = ingest.watch(spark, f"{tmp_path}/in", "doc_id long, text string", lambda df, n: seen.extend(r.doc_id for r in df.collect()), f"{tmp_path}/state")
    q.awaitTermination(60)
    assert sorted(seen) == [1, 2]


def test_containing_items_without_an_inner_word(spark, monkeypatch):
    """Items of one or two words, of CJK characters, blank and null ones, in more than one block, as a plain loop finds them."""
    docs = [(1, "the quick brown fox jumps"), (2, "北京的天气怎么样？今天很好。"), (3, "foxes and\nquick brown foxes"), (4, None), (5, "")]
    items = [(1, "fox"), (2, "quick brown"), (3, "天气怎么样"), (4, "ick bro"), (5, "absent"), (6, "quick brown fox jumps"), (7, ""), (8, None), (9, " ")]
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    got = retrieval.containing(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), "doc_id", "item_id")
    assert sorted(map(tuple, got.collect())) == sorted((d, i) for d, x in docs for i, y in items if x is not None and y is not None and y in x)
