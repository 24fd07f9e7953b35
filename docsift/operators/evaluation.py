"""Retrieval metrics, summaries and percentiles, judging, and evaluation runs that can be resumed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.functions.text import percent, seconds, strip

STAGES = ["recall_seconds", "rerank_seconds", "retrieval_seconds", "generation_seconds", "total_seconds"]
TOKENS = ["prompt_tokens", "completion_tokens", "total_tokens"]
SCORES = ["correctness", "completeness", "relevance"]
#: Columns of an evaluated question beside those of its retrieval metrics.
RESULT = {"status": "string", **dict.fromkeys(STAGES, "double"), **dict.fromkeys(TOKENS, "long"), "missing_sources": "array<string>"}


def retrieval_metrics(items: DataFrame, hits: DataFrame, gold: DataFrame, item: str, target: str, k: int = 5) -> DataFrame:
    """item, n_targets, hit_at_k, recall_at_k, reciprocal_rank; without targets the metrics are null, without hits zero."""
    sizes = gold.groupBy(item).agg(F.countDistinct(target).alias("n_targets"))
    found = hits.where(F.col("rank") <= k).join(gold.distinct(), [item, target]).groupBy(item).agg(F.countDistinct(target).alias("found"), F.min("rank").alias("first"))
    rows = items.select(item).join(sizes, item, "left").join(found, item, "left")
    known = F.col("n_targets").isNotNull()
    return rows.select(item, F.coalesce("n_targets", F.lit(0)).alias("n_targets"), F.when(known, F.when(F.col("found") > 0, 1).otherwise(0)).alias("hit_at_k"), F.when(known, F.round(F.coalesce("found", F.lit(0)) / F.col("n_targets"), 9)).alias("recall_at_k"), F.when(known, F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 9)).alias("reciprocal_rank"))


def summary_columns() -> list:
    return [F.count("*").alias("attempted"), F.count_if(F.col("answerable")).alias("answered"), F.round(F.avg(F.col("answerable").cast("int")), 9).alias("success_rate"), F.round(F.avg("hit_at_k"), 9).alias("hit_at_k"), F.round(F.avg("recall_at_k"), 9).alias("recall_at_k"), F.round(F.avg("reciprocal_rank"), 9).alias("mrr")]


def summarize(rows: DataFrame) -> DataFrame:
    return rows.agg(*summary_columns())


def summarize_sets(rows: DataFrame) -> DataFrame:
    """Overall, by question_type and by difficulty in one aggregation."""
    return rows.groupingSets([[], ["question_type"], ["difficulty"]], "question_type", "difficulty").agg(*summary_columns())


def nearest_rank(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Nearest-rank median and 95th percentile."""
    return rows.groupBy(group).agg(F.count(value).alias("n"), F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value})").alias("p50"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95"))


def judge_fields(raw: str = "raw") -> DataFrame | object:
    """A judge's JSON, fenced or not, as scores of 0 to 3 and a reason; null where it breaks the rules."""
    text = F.regexp_replace(F.trim(F.col(raw)), r"^```(?:json)?\s*|\s*```$", "")
    parsed = F.from_json(text, "correctness int, completeness int, relevance int, reason string")
    good = F.lit(True)
    for name in ("correctness", "completeness", "relevance"):
        good = good & parsed[name].between(0, 3) & F.get_json_object(text, f"$.{name}").rlike("^[0-3]$")
    return F.when(good & (F.trim(parsed["reason"]) != ""), parsed)


def complete_judgement(judge: Column) -> Column:
    """Whether a stored judgement has three scores from 0 to 3 and a reason; false for none."""
    good = F.coalesce(strip(judge["reason"]) != "", F.lit(False))
    for name in SCORES:
        good = good & F.coalesce(judge[name].between(0, 3), F.lit(False))
    return good


# What a judge is told, for all questions, for those that must be refused, and for the others.
JUDGE_RULE = "Score the answer from 0 to 3 for correctness, completeness and relevance, only by the reference answer, the criteria and the evidence. 0 is not at all, 1 a little, 2 mostly, 3 fully. Return one JSON object with these three integers and a reason of at most 50 characters."
JUDGE_REFUSAL = " The question must be refused: a refusal that invents nothing has correctness 3, one that names the false premise completeness 3, a general refusal completeness 2, a direct refusal relevance 3; an empty answer has correctness and completeness 0."
JUDGE_ANSWER = " An empty answer, or one that only says that nothing was found, has correctness 0 and completeness 0."
REFUSAL_TYPE = "拒答"


def judge_messages(item: str = "item") -> Column:
    """System and user message for one evaluated question, given as a struct with its hits."""
    c = F.col(item)
    rule = F.concat(F.lit(JUDGE_RULE), F.when(c["question_type"] == REFUSAL_TYPE, JUDGE_REFUSAL).otherwise(JUDGE_ANSWER))
    evidence = F.transform(c["hits"], lambda h: F.struct(h["rank"].alias("rank"), h["source"].alias("source"), h["page"].alias("page"), h["score"].alias("score"), h["text"].alias("text")))
    names = {"question_type": "question_type", "question": "question", "reference_answer": "ground_truth", "evaluation_criteria": "eval_criteria", "rag_answer": "answer"}
    payload = F.to_json(F.struct(*(F.coalesce(c[of], F.lit("")).alias(n) for n, of in names.items()), F.coalesce(evidence, F.array().cast("array<struct<rank:int,source:string,page:int,score:double,text:string>>")).alias("retrieval_evidence")))
    return F.array(F.struct(F.lit("system").alias("role"), rule.alias("content")), F.struct(F.lit("user").alias("role"), payload.alias("content")))


def to_judge(items: DataFrame, *, limit: int | None = None, force: bool = False, question_type: str | None = None) -> DataFrame:
    """Questions that a judging run takes: of the type asked for, not yet judged unless forced, in order of the question."""
    if limit is not None and limit < 1:
        raise ValueError("limit must be positive")
    rows = items if question_type is None else items.where(F.col("question_type") == question_type)
    rows = rows if force else rows.where(~complete_judgement(F.col("judge")))
    return rows if limit is None else rows.orderBy(*question_order(F.col("question_id"))).limit(limit)


def judged(items: DataFrame, chosen: DataFrame, scorer: Callable[[Column], Column]) -> DataFrame:
    """The items with a new judgement where the scorer's answer keeps the rules; other rows stay as they are.

    ``scorer`` maps the messages to the judge's raw text, for instance a pandas UDF around a model.
    """
    asked = chosen.select("question_id", F.struct(*chosen.columns).alias("item")).select("question_id", scorer(judge_messages()).alias("raw"))
    new = asked.select("question_id", judge_fields().alias("new_judge")).where("new_judge is not null")
    rows = items.join(new, "question_id", "left")
    fields = F.struct(*(F.when(F.col("new_judge").isNotNull(), F.col("new_judge")[n]).otherwise(F.col("judge")[n]).alias(n) for n in (*SCORES, "reason")))
    return rows.withColumn("judge", F.when(F.col("new_judge").isNotNull() | F.col("judge").isNotNull(), fields)).drop("new_judge")


def judge_columns(judge: Column) -> list[Column]:
    """The judgement as text columns of an export, blank where there is none."""
    return [F.coalesce(judge[n].cast("string"), F.lit("")).alias(n) for n in SCORES] + [F.coalesce(judge["reason"], F.lit("")).alias("judge_reason")]


def judge_summary(items: DataFrame) -> DataFrame:
    """Overall and by question_type: questions, retrieval metrics, mean seconds and mean scores; null scores do not count."""
    means = [F.round(F.avg(c), 9).alias(c) for c in ("hit_at_k", "recall_at_k", "reciprocal_rank", *STAGES)]
    scores = [F.round(F.avg(F.col("judge")[n]), 9).alias(n) for n in SCORES]
    rows = items.withColumn("question_type", F.coalesce("question_type", F.lit("none")))
    return rows.rollup("question_type").agg(F.count("*").alias("questions"), *means, *scores)


def full_summary_columns() -> list[Column]:
    """Of evaluated questions: counts, success, retrieval means, mean seconds of each stage, percentiles and token sums."""
    p = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY total_seconds)")
    return [
        F.count("*").alias("attempted"),
        F.count_if(F.col("status") == "answered").alias("answered"),
        F.round(F.avg((F.coalesce("status", F.lit("unknown")) == "answered").cast("int")), 9).alias("success_rate"),
        F.count("hit_at_k").alias("retrieval_evaluated"),
        *(F.round(F.avg(c), 9).alias(f"mean_{c}") for c in ("hit_at_k", "recall_at_k", "reciprocal_rank", *STAGES)),
        p(0.5).alias("p50_seconds"),
        p(0.95).alias("p95_seconds"),
        F.count_if(F.coalesce(*TOKENS).isNotNull()).alias("token_usage_reported"),
        *(F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in TOKENS),
        F.count_if(F.size("missing_sources") > 0).alias("missing_target_sources"),
    ]


def status_counts(rows: DataFrame) -> DataFrame:
    """One row: a map of each status to its number of questions."""
    n = rows.groupBy(F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"))
    return n.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("status_counts"))


def full_summary(rows: DataFrame, dataset_questions: int | None = None) -> DataFrame:
    """Overall, by question_type and by difficulty in one aggregation; with the size of the set, how many are left."""
    out = rows.groupingSets([[], ["question_type"], ["difficulty"]], "question_type", "difficulty").agg(F.grouping_id().alias("level"), *full_summary_columns())
    if dataset_questions is None:
        return out
    whole = F.col("level") == 3
    return out.withColumns({"dataset_questions": F.when(whole, F.lit(dataset_questions)), "remaining": F.when(whole, F.lit(dataset_questions) - F.col("attempted"))})


def dataset_size(old: int | None, saved: int) -> int:
    """Questions of the set: the number noted before, unless more are saved by now."""
    return old if old is not None and old >= saved else saved


def run_items(questions: DataFrame, done: DataFrame | None, *, limit: int | None = None, retry_failed: bool = False) -> DataFrame:
    """Questions that a run takes: those without a result, with ``retry_failed`` also those that ended in an error, up to a limit."""
    if done is not None:
        kept = done if not retry_failed else done.where("status <> 'error' or status is null")
        questions = questions.join(kept.select("question_id"), "question_id", "left_anti")
    return questions if limit is None else questions.orderBy("set_order").limit(limit)


def item_status(answerable: Column, gate_status: Column, answer: Column, error: Column) -> Column:
    """answered, empty_answer, no_hits, rejected or error."""
    said = F.when(F.coalesce(strip(answer), F.lit("")) != "", "answered").otherwise("empty_answer")
    return F.when(error.isNotNull(), "error").when(answerable, said).when(gate_status == "no_candidates", "no_hits").otherwise("rejected")


def targets(questions: DataFrame, source_map: DataFrame, available: DataFrame) -> DataFrame:
    """question_id, its target sources in order, and those that the index lacks."""
    refs = questions.select("question_id", F.explode_outer("reference_context_ids").alias("doc_code"))
    known = available.select("source").distinct().withColumn("present", F.lit(True))
    rows = refs.join(F.broadcast(source_map), "doc_code", "left").join(known, "source", "left")
    missing = F.array_sort(F.collect_set(F.when(F.col("present").isNull(), F.col("source"))))
    return rows.groupBy("question_id").agg(F.array_sort(F.collect_set("source")).alias("targets"), missing.alias("missing_sources"))


def export_row() -> list[Column]:
    """Columns of a result table for people: percentages, seconds, sources by name and page, judgement; blank where unknown."""
    hits = F.array_join(F.transform("hits", lambda h: F.concat(F.coalesce(h["source"], F.lit("?")), F.lit(" p."), F.coalesce(h["page"].cast("string"), F.lit("?")))), "; ")
    plain = ["question_id", "question_type", "difficulty", "question", "ground_truth", "answer", "eval_criteria", "status"]
    return [
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in plain),
        F.coalesce(hits, F.lit("")).alias("retrieved_sources"),
        F.coalesce(F.array_join("missing_sources", "; "), F.lit("")).alias("missing_sources"),
        *(percent(F.col(c)).alias(c) for c in ("hit_at_k", "recall_at_k", "reciprocal_rank")),
        *(seconds(F.col(c)).alias(c) for c in STAGES),
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in TOKENS),
        F.coalesce(F.col("error"), F.lit("")).alias("error"),
        *judge_columns(F.col("judge")),
    ]


def question_order(key: Column) -> list[Column]:
    """Sort columns: keys of digits by their number, then the others by their text in lower case."""
    digits = key.rlike("^[0-9]+$")
    return [F.when(digits, 0).otherwise(1), F.when(digits, key.cast("decimal(38,0)")), F.lower(key), key]
