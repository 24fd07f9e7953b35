"""Index builds, the question service, evaluation runs and the command line on small folders."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docsift import cli, config
from docsift.operators import answers, build, embedding, evaluation, history, service
from docsift.plans.runs import Run
from docsift.sources import readers, report
from docsift.sources.store import IndexStore, atomic_json, exclusive_lock, read_json
from docsift.streaming.sse import Requests

TEXTS = {"a.txt": "1 Rivers\nThe river Danube flows through ten countries.\fIt ends in the Black Sea.", "B.txt": "1 Stones\nGranite is a hard stone made of quartz and mica.", "c.txt": "1 Birds\nThe heron waits beside quiet water for fish."}


def lay_down(folder, texts):
    folder.mkdir(exist_ok=True)
    for old in folder.iterdir():
        old.unlink()
    for name, text in texts.items():
        (folder / name).write_text(text)


def parse(files):
    """Text files; one that begins with BROKEN fails."""
    good = files.where(~F.startswith(F.decode("content", "UTF-8"), F.lit("BROKEN")))
    blocks, report = cli.parse_text(good)
    bad = files.join(good.select("document_id"), "document_id", "left_anti").select("document_id", F.lit(False).alias("ok"), F.lit(None).cast("long").alias("pages"), F.lit("ValueError").alias("error"))
    return blocks, report.unionByName(bad)


def index(spark, root):
    return build.Index(spark, f"file://{root}/index", parse, embedding.hashing_embedder(), "hashing-256", lock=f"{root}/lock")


def state(ix):
    return {r.source: r.status for r in ix.store.read("records").collect()}


def test_builds(spark, tmp_path):
    folder, ix = tmp_path / "files", index(spark, tmp_path)
    files = lambda: readers.files(spark, f"file://{folder}", "*.txt")
    lay_down(folder, {})
    with pytest.raises(Exception, match="no files|does not exist|PATH_NOT_FOUND"):
        ix.build(files())
    assert ix.status() == {"ready": False, "documents": 0, "chunks": 0}
    lay_down(folder, TEXTS)
    first = ix.build(files())
    assert (first["status"], first["published"], first["updated_documents"], first["active_documents"]) == ("complete", True, 3, 3)
    generation = ix.store.current()
    again = ix.build(files())
    assert (again["published"], again["reused_documents"], ix.store.current()) == (False, 3, generation)
    # One changed, one broken (its old version stays), one gone (kept unless pruned), one new and broken.
    lay_down(folder, {"a.txt": TEXTS["a.txt"] + " Indeed.", "B.txt": "BROKEN", "d.txt": "BROKEN"})
    with pytest.raises(build.BuildError, match="strict"):
        ix.build(files(), strict=True)
    assert ix.store.current() == generation
    mixed = ix.build(files())
    assert state(ix) == {"a.txt": "active", "B.txt": "stale", "c.txt": "missing_source", "d.txt": "failed_new"}
    assert (mixed["status"], mixed["stale_documents"], mixed["missing_source_documents"], mixed["failed_documents"]) == ("partial", 1, 1, 1)
    kept = {r.source: r.active_source_sha256 != r.observed_source_sha256 for r in ix.store.read("records").where("status = 'stale'").collect()}
    assert kept == {"B.txt": True}
    ids = {r.document_id: r.artifact_key for r in ix.store.read("records").collect()}
    forced = ix.build(files(), force=True, prune_missing=True)
    assert state(ix) == {"a.txt": "active", "B.txt": "stale", "d.txt": "failed_new"}
    assert forced["reused_documents"] == 0
    changed = {r.source for r in ix.store.read("records").collect() if r.artifact_key and r.artifact_key != ids[r.document_id]}
    assert changed == {"a.txt"}
    assert ix.status() == {"ready": True, "documents": 2, "chunks": ix.store.read("chunks").count()}
    assert [r.source_path for r in build.in_order(ix.store.read("records")).collect()] == ["a.txt", "B.txt", "d.txt"]
    with exclusive_lock(str(tmp_path / "lock")), pytest.raises(RuntimeError, match="held"):
        ix.build(files())


def test_artifacts(spark):
    chunks = spark.createDataFrame([("k", "1"), ("k", "2"), ("l", "3"), ("m", "4")], "artifact_key string, chunk_id string")
    vectors = spark.createDataFrame([("k", "1", [1.0, 0.0]), ("k", "2", [0.0, 1.0]), ("l", "3", [float("nan"), 0.0]), ("m", "5", [1.0, 0.0])], "artifact_key string, chunk_id string, embedding array<double>")
    assert {r.artifact_key: r.sound for r in build.artifact_faults(chunks, vectors).collect()} == {"k": True, "l": False, "m": False}
    keys = spark.createDataFrame([("0" * 64,), ("g" * 64,), ("0" * 63,), (None,)], "k string")
    assert [r[0] for r in keys.select(build.valid_key(F.col("k"))).collect()] == [True, False, False, False]


@pytest.fixture(scope="module")
def asked(spark):
    rows = [("c1", "The river Danube flows through ten countries.", "a.txt", 1, ["Rivers"]), ("c2", "Granite is a hard stone.", "x/b.txt", 2, ["Stones"]), ("c3", "The heron waits for fish.", "c.txt", 3, [])]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string, source string, page int, section_path array<string>")
    embed = embedding.hashing_embedder()
    return service.Service(spark, chunks, embedding.embedded(chunks, "chunk_id", embed), embed, lambda m: "It is the Danube [1], not [9].")


def test_questions(spark, asked):
    got = asked.ask("Which river flows through ten countries?")
    assert (got.answer, got.answerable, got.reason, got.evidence_status) == ("It is the Danube [1], not .", True, "threshold_not_calibrated", "answerable")
    assert [h["chunk_id"] for h in got.hits] == ["c1"]
    assert len(got.retrieval_hits) >= 1
    events = list(asked.ask_stream("Which river flows through ten countries?"))
    assert [e for e, _ in events] == ["status", "retrieval", "status", "delta", "done"]
    assert asked.ask("zzz qqq").evidence_status in ("no_candidates", "answerable")
    refused = service.Service(asked.spark, asked.chunks, asked.vectors, asked.embedder, lambda m: service.NOTHING_FOUND + "[1]")
    got = refused.ask("Which river flows through ten countries?")
    assert (got.answer, got.answerable, got.reason, got.hits) == (service.NOTHING_FOUND, False, "generation_refused", [])
    tight = service.Service(asked.spark, asked.chunks, asked.vectors, asked.embedder, lambda m: "x", config=config.Config(prompt_chars=5))
    assert tight.ask("river").reason == "context_budget_empty"
    strict = service.Service(asked.spark, asked.chunks, asked.vectors, asked.embedder, lambda m: "x", config=config.Config(rerank_threshold=1.1))
    assert strict.ask("river").evidence_status == "below_threshold"
    table = spark.createDataFrame([("1", "Which river flows?"), ("2", "Which stone is hard?")], "question_id string, text string")
    rows = {r.question_id: r for r in asked.answer_all(table).collect()}
    assert [rows[k].hits[0].chunk_id for k in ("1", "2")] == ["c1", "c2"]
    assert rows["1"].messages[1].content.endswith("Which river flows?")
    assert "[1] The river" in rows["1"].messages[1].content


def test_requests(asked):
    kept = []
    requests = Requests(asked, lambda q, a: kept.append(q))
    code, body = requests.respond("Which stone is hard?")
    assert code == 200
    assert set(body) == {"answer", "answerable", "reason", "hits", "timing"}
    assert [requests.respond(q)[0] for q in ("", "  ", "x" * 2001)] == [422] * 3
    frames = "".join(requests.ask_stream("Which stone is hard?"))
    assert frames.count("event: ") == 5
    assert kept == ["Which stone is hard?"] * 2
    stream = requests.ask_stream("Which stone is hard?")
    next(stream)
    assert requests.respond("Which stone is hard?")[0] == 429
    stream.close()
    assert requests.respond("Which stone is hard?")[0] == 200
    broken = Requests(service.Service(asked.spark, asked.chunks, asked.vectors, asked.embedder, lambda m: 1 / 0), lambda q, a: kept.append("never"))
    assert "event: error" in "".join(broken.ask_stream("Which stone is hard?"))
    assert broken.respond("Which stone is hard?") == (500, {"detail": "ZeroDivisionError"})
    assert "never" not in kept
    assert Requests(None).respond("x")[0] == 503


def test_embedding_faults(spark):
    rows = spark.createDataFrame([("a", "one two"), ("b", None)], "chunk_id string, text string")
    vectors = embedding.embedded(rows, "chunk_id", embedding.hashing_embedder(8)).collect()
    assert [round(sum(x * x for x in r.embedding), 5) for r in sorted(vectors)] == [1.0, 0.0]
    for wrong in (lambda t: pd.Series([[1.0]] * (len(t) + 1)), lambda t: pd.Series([[float("inf")]] * len(t)), lambda t: pd.Series([[1.0] * (k + 1) for k in range(len(t))])):
        with pytest.raises(Exception, match="embedder"):
            embedding.embedded(rows.coalesce(1), "chunk_id", wrong).collect()


QUESTIONS = [{"question_id": k, "question": q, "ground_truth": "g", "question_type": t, "difficulty": "easy", "eval_criteria": "c", "reference_context_ids": [d]} for k, q, t, d in ((1, "Which river?", "fact", "D1"), ("x2", "Which stone?", "拒答", "D2"), (10, "Which bird?", "fact", "D9"))]


def test_evaluation_run(spark, tmp_path):
    (tmp_path / "set.json").write_text(json.dumps(QUESTIONS))
    source_map = spark.createDataFrame([("D1", "a.txt"), ("D2", "b.txt"), ("D9", "z.txt")], "doc_code string, source string")
    questions = readers.questions(spark, str(tmp_path / "set.json"), source_map).withColumn("set_order", F.monotonically_increasing_id())
    available = spark.createDataFrame([("a.txt",), ("b.txt",)], "source string")
    calls = []

    def answer(todo):
        ids = [r.question_id for r in todo.collect()]
        calls.append(ids)
        hit = lambda s: [(1, s, 1, 0.5, "text", "c")]
        rows = [(i, hit("a.txt"), "said", True, "answerable", "generation: ValueError" if i == "x2" and len(calls) == 1 else None, *[0.5] * 5, 10, None, 12) for i in ids]
        kinds = ", ".join(f"{c} double" for c in evaluation.STAGES) + ", " + ", ".join(f"{c} long" for c in evaluation.TOKENS)
        return spark.createDataFrame(rows, f"question_id string, hits array<struct<rank:int,source:string,page:int,score:double,text:string,chunk_id:string>>, answer string, answerable boolean, evidence_status string, error string, {kinds}")

    run = Run(spark, f"file://{tmp_path}/run")
    evaluate = lambda **more: {(r.question_type, r.difficulty): r for r in run.evaluate(questions, source_map, available, answer, {"v": 1}, **more).collect()}
    whole = evaluate(limit=2)[None, None]
    assert (whole.attempted, whole.answered, whole.remaining, whole.hit_at_k if "hit_at_k" in whole else whole.mean_hit_at_k) == (2, 1, 1, 0.5)
    assert (whole.prompt_tokens, whole.completion_tokens, whole.p95_seconds) == (20, 0, 0.5)
    whole = evaluate()[None, None]
    assert calls == [["1", "x2"], ["10"]]
    assert (whole.attempted, whole.missing_target_sources) == (3, 1)
    assert evaluate(retry_failed=True)[None, None].answered == 3
    assert calls[2] == ["x2"]
    with pytest.raises(ValueError, match="changed"):
        run.evaluate(questions, source_map, available, answer, {"v": 2})
    raw = '{"correctness": 3, "completeness": 2, "relevance": 1, "reason": "fine"}'
    run.judge(lambda m: F.when(m[1]["content"].contains("stone"), "no json").otherwise(F.lit(raw)), limit=3)
    judged = {r.question_id: r.judge for r in run.items().collect()}
    assert judged["x2"] is None
    assert tuple(judged["1"]) == (3, 2, 1, "fine")
    run.judge(lambda m: F.lit(raw.replace("3", "0")))
    judged = {r.question_id: r.judge.correctness for r in run.items().collect()}
    assert judged == {"1": 3, "10": 3, "x2": 0}
    run.judge(lambda m: F.lit(raw.replace("3", "1")), force=True, question_type="拒答")
    assert {r.question_id: r.judge.correctness for r in run.items().collect()} == {"1": 3, "10": 3, "x2": 1}
    summary = read_json(f"{tmp_path}/run/summary.json")
    assert (summary["dataset_questions"], summary["remaining"], summary["status_counts"]) == (3, 0, {"answered": 3})
    assert set(summary["by_question_type"]) == {"fact", "拒答"}
    lines = [json.loads(x) for f in sorted((tmp_path / "run" / "results.jsonl").glob("part*")) for x in f.read_text().splitlines()]
    assert [x["question_id"] for x in lines] == ["1", "10", "x2"]
    csv = "".join(f.read_text(encoding="utf-8") for f in sorted((tmp_path / "run" / "results.csv").glob("part*")))
    assert csv.startswith("﻿question_id,")
    assert "## x2 (拒答, easy)" in (tmp_path / "run" / "report.md").read_text()
    assert "| fact | 2 |" in (tmp_path / "run" / "judge_summary.md").read_text()
    assert evaluation.dataset_size(5, 3) == 5
    assert evaluation.dataset_size(2, 3) == evaluation.dataset_size(None, 3) == 3


def test_judge_messages(spark):
    kind = "struct<question_type:string,question:string,ground_truth:string,eval_criteria:string,answer:string,hits:array<struct<rank:int,source:string,page:int,score:double,text:string>>>"
    df = spark.createDataFrame([((t, "q", "g", "c", None, [(1, "s", 2, 0.5, "x")]),) for t in ("fact", "拒答")], f"item {kind}")
    got = [r[0] for r in df.select(evaluation.judge_messages()).collect()]
    assert "must be refused" in got[1][0].content
    assert "must be refused" not in got[0][0].content
    assert json.loads(got[0][1].content)["retrieval_evidence"][0]["source"] == "s"
    assert json.loads(got[0][1].content)["rag_answer"] == ""


def test_load_items(spark, tmp_path):
    for k, x in enumerate(("10", "x", "2")):
        (tmp_path / f"{k}.json").write_text(json.dumps({"question_id": x, "status": "answered"}))
    assert [r.question_id for r in readers.load_items(spark, str(tmp_path), "question_id string, status string").collect()] == ["2", "10", "x"]
    (tmp_path / "9.json").write_text('{"question_id": "2"}')
    with pytest.raises(readers.SourceError, match="repeated"):
        readers.load_items(spark, str(tmp_path), "question_id string, status string")


def test_history_store(spark):
    now = lambda s: F.lit(s).cast("timestamp")
    exchange = lambda c, q: spark.createDataFrame([(c, q, "answer", '{"hits": []}')], "conv_id string, question string, answer string, snapshot string")
    first = history.saved(history.initialised(spark), exchange(None, "q" * 40), now("2024-01-01 00:00:00"))
    rows = spark.createDataFrame(first.collect(), first.schema)
    conv = rows.first().conv_id
    assert [(r.message_id, r.role, r.snapshot) for r in history.conversation(rows, conv).collect()] == [(1, "user", None), (2, "assistant", '{"hits": []}')]
    rows = history.saved(rows, exchange(conv, "more"), now("2024-01-02 00:00:00"))
    assert [r.message_id for r in history.conversation(rows, conv).collect()] == [1, 2, 3, 4]
    listed = history.conversations(rows).collect()
    assert [(r.title, r.messages, str(r.updated_at)) for r in listed] == [("q" * 29 + "…", 4, "2024-01-02 00:00:00")]
    with pytest.raises(Exception, match="unknown conversation"):
        history.saved(rows, exchange("nope", "x"), now("2024-01-03 00:00:00")).collect()


def test_settings(tmp_path, monkeypatch):
    (tmp_path / "env").write_text("# comment\nDOCSIFT_RRF_K=10\nDOCSIFT_CHUNK_MIN='5'\nDOCSIFT_RERANK_THRESHOLD=\n")
    got = config.load(str(tmp_path / "env"), {"DOCSIFT_CHUNK_MIN": "7", "DOCSIFT_SECTION_AWARE": "false"})
    assert (got.rrf_k, got.chunk_min, got.section_aware, got.rerank_threshold) == (10, 7, False, None)
    with pytest.raises(config.ConfigError, match="RRF_K"):
        config.load(None, {"DOCSIFT_RRF_K": "many"})
    with pytest.raises(config.ConfigError, match="B"):
        config.require({"A": "x", "B": " "}, "A", "B")
    base = config.Config()
    assert config.Config(chunk_min=1).chunking_signature() != base.chunking_signature() == config.Config(bm25_b=0.1).chunking_signature()
    assert config.Config(bm25_b=0.1).bm25_signature() != base.bm25_signature()
    assert base.pipeline_signature("m") != base.pipeline_signature("n")
    (tmp_path / "x.py").write_text("a = 1")
    assert list(config.code_snapshot(str(tmp_path))) == ["x.py"]


def test_reports_and_files(spark, tmp_path):
    trace = {"question": "Wo <b>?", "hits": [{"rank": 1, "text": "seen", "source": "a"}, {"rank": 2, "text": "cut"}], "messages": [{"role": "user", "content": "[1] seen\n\nWo?"}], "neighbors": {"1": [{"text": "near"}]}, "timing": {"total_seconds": 1.5}, "answer": "x", "error": None}
    data, page = report.write_trace(trace, str(tmp_path))
    html = page.read_text()
    assert read_json(str(data)) == trace
    assert "1 of 2 hits sent" in html
    assert "Wo &lt;b&gt;?" in html
    assert data.stem.endswith("-Wo-b")
    atomic_json(f"{tmp_path}/a/b.json", {"x": 1})
    assert [p.name for p in (tmp_path / "a").iterdir()] == ["b.json"]
    store = IndexStore(spark, f"file://{tmp_path}/sparse")
    store.save_postings(spark.createDataFrame([("t", 1, 2)], "term string, doc_id int, tf int"), spark.createDataFrame([(1, 5)], "doc_id int, dl int"), "sig")
    assert store.load_postings("sig")[0].count() == 1
    with pytest.raises(ValueError, match="settings"):
        store.load_postings("other")
    assert answers.render_blocks("[1] a\n\n[2] b") == ["[1] a\n\n", "[2] b"]


def test_archives_and_adapters(spark, tmp_path):
    import io
    import zipfile

    def archive(*members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, data in members:
                z.writestr(name, data)
        return spark.createDataFrame([("d", bytearray(out.getvalue()))], "document_id string, content binary")

    got = readers.extracted(archive(("x/layout.json", "{}"), ("b.txt", "b")), r".*\.json").collect()
    assert [(r.member, bytes(r.content)) for r in got] == [("x/layout.json", b"{}")]
    for bad in ([("../a", "x")], [("A.txt", "x"), ("a.TXT", "y")]):
        with pytest.raises(Exception, match="unsafe or repeated"):
            readers.extracted(archive(*bad)).collect()
    leaf = lambda kind, text: {"type": kind, "lines": [{"spans": [{"content": text}]}]}
    (tmp_path / "layout.json").write_text(json.dumps({"pdf_info": [{"page_idx": 0, "preproc_blocks": [leaf("title", "T"), leaf("text", "body")]}, {"page_idx": 1, "preproc_blocks": []}]}))
    blocks, stats = readers.adapted(spark, str(tmp_path / "layout.json"), None, 2)
    assert [r.block_id for r in blocks.orderBy("page", "block_seq").collect()] == ["p1_b0", "p1_b1"]
    assert (stats["text_pages"], stats["empty_text_pages"], stats["block_types"], stats["page_source"]) == (1, [2], {"title": 1, "text": 1}, "preproc_blocks")
    with pytest.raises(readers.SourceError, match="expected 3 pages"):
        readers.adapted(spark, str(tmp_path / "layout.json"), None, 3)
    (tmp_path / "bare.json").write_text(json.dumps({"pdf_info": [{"page_idx": 0}]}))
    (tmp_path / "content.json").write_text(json.dumps([{"page_idx": 0, "type": "list", "list_items": ["a", "b"]}, {"page_idx": 0, "type": "table", "table_caption": ["cap"], "table_body": "<table><tr><td>x</td></tr></table>"}, {"page_idx": 0, "type": "image", "image_caption": ["fig"], "content": "seen"}]))
    blocks, stats = readers.adapted(spark, str(tmp_path / "bare.json"), str(tmp_path / "content.json"), 1)
    assert [r.text for r in blocks.orderBy("block_seq").collect()] == ["a\nb", "cap\n| x", "fig\nseen"]
    assert stats["page_source"] == "content_list"
    assert [readers.text_value(v) for v in (None, "a", ["a", "b"])] == ["", "a", "a\nb"]
    with pytest.raises(readers.SourceError):
        readers.text_value({"a": 1})
    files = spark.createDataFrame([("1", "ok.pdf", bytearray(b"p1\fp2")), ("2", "bad.pdf", bytearray(b"!"))], "document_id string, source string, content binary")

    def pages(content):
        if content == b"!":
            raise OSError("secret path")
        return content.decode().split("\f")

    rows, reports = readers.pages(files, pages)
    assert [(r.page, r.text) for r in rows.orderBy("page").collect()] == [(1, "p1"), (2, "p2")]
    assert {r.document_id: (r.ok, r.pages, r.error) for r in reports.collect()} == {"1": (True, 2, None), "2": (False, None, "OSError")}


def test_command_line(spark, tmp_path, capsys):
    lay_down(tmp_path / "files", TEXTS)
    cli.main(["build", f"file://{tmp_path}/files", "--index", f"file://{tmp_path}/ix"])
    assert json.loads(capsys.readouterr().out)["active_documents"] == 3
    cli.main(["status", "--index", f"file://{tmp_path}/ix"])
    assert json.loads(capsys.readouterr().out)["ready"] is True
    rows = [dict(q, reference_context_ids=[d]) for q, d in zip(QUESTIONS, ("D1", "D2", "D3"), strict=True)]
    (tmp_path / "set.json").write_text(json.dumps(rows))
    (tmp_path / "map.json").write_text(json.dumps({"D1": "a.txt", "D2": "B.txt", "D3": "c.txt"}))
    common = ["evaluate", "--index", f"file://{tmp_path}/ix", "--dataset", str(tmp_path / "set.json"), "--source-map", str(tmp_path / "map.json"), "--output", f"file://{tmp_path}/out"]
    cli.main([*common, "--validate-only"])
    assert json.loads(capsys.readouterr().out) == {"questions": 3}
    cli.main(common)
    capsys.readouterr()
    summary = read_json(f"{tmp_path}/out/summary.json")
    assert summary["attempted"] == 3
    assert summary["mean_hit_at_k"] >= 0.6
    cli.main(["export", "--output", f"file://{tmp_path}/out"])
    assert json.loads(capsys.readouterr().out)["groups"] >= 3
