"""Evaluation runs in a folder: results that stay, a signature that must not change, judging and exports."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.operators import evaluation
from docsift.sources import readers, report
from docsift.sources.store import atomic_json, exclusive_lock, read_json

HIT = "array<struct<rank:int,source:string,page:int,score:double,text:string,chunk_id:string>>"
JUDGE = "struct<correctness:int,completeness:int,relevance:int,reason:string>"
ITEM = (
    "question_id string, question string, ground_truth string, question_type string, difficulty string, eval_criteria string, targets array<string>, "
    f"missing_sources array<string>, hits {HIT}, answer string, answerable boolean, evidence_status string, status string, error string, hit_at_k int, "
    "recall_at_k double, reciprocal_rank double, " + ", ".join(f"{c} double" for c in evaluation.STAGES) + ", " + ", ".join(f"{c} long" for c in evaluation.TOKENS) + f", judge {JUDGE}"
)


class Run:
    """A folder with run.json, item generations and exports."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.local = self.folder.removeprefix("file://")

    def items(self) -> DataFrame | None:
        try:
            name = read_json(f"{self.local}/items.json")["generation"]
        except FileNotFoundError:
            return None
        return self.spark.read.schema(ITEM).parquet(f"{self.folder}/items/{name}")

    def _keep(self, items: DataFrame) -> DataFrame:
        name = uuid.uuid4().hex
        items.select(*(c.split(" ", 1)[0] for c in _columns())).write.parquet(f"{self.folder}/items/{name}")
        atomic_json(f"{self.local}/items.json", {"generation": name})
        return self.items()

    def _check(self, signature: dict) -> None:
        try:
            known = read_json(f"{self.local}/run.json")
        except FileNotFoundError:
            if self.items() is not None:
                raise ValueError("there are results but no signature of the run") from None
            atomic_json(f"{self.local}/run.json", signature)
            return
        if known != signature:
            raise ValueError("the set, the index, the code or the settings have changed; take a new folder")

    def evaluate(self, questions: DataFrame, source_map: DataFrame, available: DataFrame, answer: Callable[[DataFrame], DataFrame], signature: dict, *, k: int = 5, limit: int | None = None, retry_failed: bool = False) -> DataFrame:
        """Runs the questions that have no result yet and returns the summary.

        ``answer`` maps question_id, question, to question_id, hits, answer, answerable, evidence_status, error, seconds of
        the stages and token counts.  Only the question goes to it.
        """
        with exclusive_lock(f"{self.local}/.evaluation.lock"):
            self._check(signature)
            done = self.items()
            todo = evaluation.run_items(questions, done, limit=limit, retry_failed=retry_failed)
            todo = todo.join(evaluation.targets(todo, source_map, available), "question_id", "left")
            found = answer(todo.select("question_id", "question"))
            rows = todo.join(found, "question_id")
            hits = found.select("question_id", F.explode("hits").alias("h")).select("question_id", F.col("h.rank").alias("rank"), F.col("h.source").alias("source"))
            gold = todo.select("question_id", F.explode("targets").alias("source"))
            metrics = evaluation.retrieval_metrics(todo, hits, gold, "question_id", "source", k).drop("n_targets")
            status = evaluation.item_status(F.col("answerable"), F.col("evidence_status"), F.col("answer"), F.col("error"))
            rows = rows.join(metrics, "question_id").withColumns({"status": status, "judge": F.lit(None).cast(JUDGE)})
            new = rows.select(*(F.col(n).cast(t).alias(n) for n, t in (c.split(" ", 1) for c in _columns())))
            every = new if done is None else done.join(new.select("question_id"), "question_id", "left_anti").select(*new.columns).union(new)
            return self.export(self._keep(every), questions.count())

    def judge(self, scorer: Callable[[Column], Column], *, limit: int | None = None, force: bool = False, question_type: str | None = None) -> DataFrame:
        """Judges results that have no judgement yet; where the judge's answer breaks the rules, the row stays as it is."""
        with exclusive_lock(f"{self.local}/.evaluation.lock"):
            items = self.items()
            if items is None:
                raise ValueError("no results to judge")
            chosen = evaluation.to_judge(items, limit=limit, force=force, question_type=question_type)
            return self.export(self._keep(evaluation.judged(items, chosen, scorer)))

    def export(self, items: DataFrame | None = None, total: int | None = None) -> DataFrame:
        """Writes summary, JSON lines, CSV and Markdown reports; returns the summary.

        A folder holds one run's questions, a bounded set, so the Markdown is made on the driver.
        """
        items = self.items() if items is None else items
        if items is None:
            raise ValueError("no results to export")
        saved = items.count()
        if total is None:
            try:
                total = evaluation.dataset_size(read_json(f"{self.local}/summary.json").get("dataset_questions"), saved)
            except FileNotFoundError:
                total = saved
        if total < saved:
            raise ValueError("the set has fewer questions than there are results")
        summary = evaluation.full_summary(items, total)
        rows = [r.asDict(recursive=True) for r in summary.collect()]
        counts = evaluation.status_counts(items).first()[0]
        whole = next((r for r in rows if r["level"] == 3), {})
        by = {f"by_{n}": {r[n]: r for r in rows if r["level"] == level} for n, level in (("question_type", 1), ("difficulty", 2))}
        atomic_json(f"{self.local}/summary.json", whole | {"status_counts": counts} | by)
        ordered = items.orderBy(*evaluation.question_order(F.col("question_id")))
        readers.export_jsonl(ordered, f"{self.folder}/results.jsonl")
        readers.export_csv(ordered.select(*evaluation.export_row()), f"{self.folder}/results.csv", mark=True)
        listed = [r.asDict(recursive=True) for r in ordered.collect()]
        for name, text in (("report.md", report.results_markdown(listed)), ("judge_summary.md", report.judge_table([r.asDict() for r in evaluation.judge_summary(items).collect()]))):
            with open(f"{self.local}/{name}", "w", encoding="utf-8") as f:
                f.write(text)
        return summary


def _columns() -> list[str]:
    """Name and type of each column of ``ITEM``, split at its top level."""
    out, depth, held = [], 0, ""
    for c in ITEM + ",":
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(held.strip())
            held = ""
        else:
            held += c
    return out
