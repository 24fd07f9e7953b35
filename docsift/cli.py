"""Command line: build an index, run an evaluation set against it, judge and export results, show the state of an index."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift import config
from docsift.operators import build, embedding, evaluation, service
from docsift.plans.runs import Run
from docsift.sources import readers
from docsift.sources.store import read_json


def _spark() -> SparkSession:
    return SparkSession.builder.appName("docsift").getOrCreate()


def parse_text(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain-text files, their pages parted by form feeds; files of other kinds go through the optional page reader."""
    text = files.where(~F.lower("source").endswith(".pdf"))
    rows = text.select("document_id", "source", F.posexplode(F.split(F.decode("content", "UTF-8"), "\f")).alias("at", "text"))
    own = rows.select("document_id", "source", (F.col("at") + 1).alias("page"), "text")
    other, report = readers.pages(files.where(F.lower("source").endswith(".pdf")))
    counted = own.groupBy("document_id").agg(F.lit(True).alias("ok"), F.count("*").alias("pages"), F.lit(None).cast("string").alias("error"))
    return readers.as_blocks(own.unionByName(other)), counted.unionByName(report)


def _index(args: argparse.Namespace) -> build.Index:
    return build.Index(_spark(), args.index, parse_text, embedding.hashing_embedder(), "hashing-256", config.load(args.env))


def do_build(args: argparse.Namespace) -> dict:
    files = readers.files(_spark(), args.folder, args.pattern)
    return _index(args).build(files, force=args.force, strict=args.strict, prune_missing=args.prune_missing)


def do_status(args: argparse.Namespace) -> dict:
    return _index(args).status()


def _answers(index: build.Index):
    """Extractive answers: the best passage itself, cited; a model takes its place where one is at hand."""
    sources = index.store.read("records").select("document_id", "source")
    chunks = index.store.read("chunks").join(sources, "document_id")
    asked = service.Service(index.spark, chunks, index.store.read("vectors"), index.embedder, lambda messages: messages[-1]["content"], config=index.config)

    def run(questions: DataFrame) -> DataFrame:
        rows = asked.answer_all(questions.select("question_id", F.col("question").alias("text")))
        best = F.concat(F.element_at("hits", 1)["text"], F.lit(" [1]"))
        none = {c: F.lit(None).cast("double") for c in evaluation.STAGES} | {c: F.lit(None).cast("long") for c in evaluation.TOKENS} | {"error": F.lit(None).cast("string")}
        return rows.select("question_id", "hits", F.when(F.col("answerable"), best).alias("answer"), "answerable", F.col("status").alias("evidence_status")).withColumns(none)

    return run


def do_evaluate(args: argparse.Namespace) -> dict:
    spark, index = _spark(), _index(args)
    source_map = spark.createDataFrame(list(read_json(args.source_map).items()), "doc_code string, source string")
    questions = readers.questions(spark, args.dataset, source_map).withColumn("set_order", F.monotonically_increasing_id())
    if args.validate_only:
        return {"questions": questions.count()}
    signature = {"settings": index.config.signature(), "index": index.store.current(), "dataset": config.fingerprint(read_json(args.dataset)), "source_map": config.fingerprint(read_json(args.source_map)), "top_k": args.top_k, "code": config.fingerprint(config.code_snapshot(str(config.Path(config.__file__).parent)))}
    summary = Run(spark, args.output).evaluate(questions, source_map, index.store.read("records"), _answers(index), signature, k=args.top_k, limit=args.limit, retry_failed=args.retry_failed)
    return {"groups": summary.count(), "output": args.output}


def do_export(args: argparse.Namespace) -> dict:
    return {"groups": Run(_spark(), args.output).export().count(), "output": args.output}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="docsift", description=__doc__)
    sub = p.add_subparsers(required=True)
    b = sub.add_parser("build", help="bring an index up to a folder of files")
    b.add_argument("folder")
    b.add_argument("--pattern", default="*")
    for flag in ("--force", "--strict", "--prune-missing"):
        b.add_argument(flag, action="store_true")
    s = sub.add_parser("status", help="whether an index is ready")
    e = sub.add_parser("evaluate", help="run an evaluation set")
    for name in ("--dataset", "--source-map", "--output"):
        e.add_argument(name, required=True)
    e.add_argument("--limit", type=int)
    e.add_argument("--top-k", type=int, default=5)
    for flag in ("--retry-failed", "--validate-only"):
        e.add_argument(flag, action="store_true")
    x = sub.add_parser("export", help="write the exports of a run again")
    x.add_argument("--output", required=True)
    for command, does in ((b, do_build), (s, do_status), (e, do_evaluate), (x, do_export)):
        command.set_defaults(does=does)
        if command is not x:
            command.add_argument("--index", required=True)
            command.add_argument("--env", help="file of settings")
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    print(json.dumps(args.does(args), ensure_ascii=False, default=str))


if __name__ == "__main__":
    main()
