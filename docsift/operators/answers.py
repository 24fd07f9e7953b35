"""From hits to an answer: the budgeted prompt, the model call that callers supply, and the check of citations."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsift.functions.text import CITATION, REFUSAL, strip


def prompt_prefix(hits: DataFrame, query: str, *, budget: int, rank: str = "rank", text: str = "text") -> DataFrame:
    """Adds used_chars and sent: hits in order of rank until the first that would pass the budget."""
    cost = F.length(F.concat(F.lit("["), F.col(rank).cast("string"), F.lit("] "), strip(F.col(text))))
    order = Window.partitionBy(query).orderBy(rank).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hits.withColumn("used_chars", F.sum(cost.cast("long")).over(order)).withColumn("sent", F.col("used_chars") <= budget)


def prompts(hits: DataFrame, query: str) -> DataFrame:
    """query and its numbered context blocks of the hits that are sent."""
    block = F.struct(F.col("rank"), F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), strip(F.col("text"))).alias("block"))
    return hits.where("sent").groupBy(query).agg(F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda b: b["block"]), "\n\n").alias("context"))


def is_refusal(answer: Column) -> Column:
    return strip(answer).rlike(REFUSAL)


def finalized(answer: Column, ranks: Column) -> Column:
    """struct(answer, cited, invalid): citations of hits that were not sent are cut and counted; a refusal cites nothing.

    Numbers are compared as written, so [01] is not [1]; the citations of a refusal are cut but not counted as wrong.
    """
    numbers = F.regexp_extract_all(answer, F.lit(CITATION), F.lit(1))
    allowed = F.transform(ranks, lambda r: r.cast("string"))
    wrong = F.when(is_refusal(answer), F.array_distinct(numbers)).otherwise(F.array_except(numbers, allowed))
    clean = F.aggregate(wrong, answer, lambda acc, n: F.replace(acc, F.concat(F.lit("["), n, F.lit("]")), F.lit("")))
    cited = F.when(is_refusal(answer), F.array().cast("array<string>")).otherwise(F.array_intersect(allowed, numbers))
    invalid = F.when(is_refusal(answer), F.lit(0)).otherwise(F.size(F.filter(numbers, lambda n: ~F.array_contains(allowed, n))))
    return F.struct(strip(clean).alias("answer"), cited.alias("cited"), invalid.alias("invalid"))


def parts(answer: Column) -> Column:
    """The answer as text and citation pieces in order."""
    return F.regexp_extract_all(answer, F.lit(r"\[[0-9]+\]|(?:(?!\[[0-9]+\])[\s\S])+"), F.lit(0))


def sent_counts(prefix: DataFrame, query: str) -> DataFrame:
    """query, sent and dropped hits, characters sent."""
    return prefix.groupBy(query).agg(F.count_if("sent").alias("sent"), F.count_if(~F.col("sent")).alias("dropped"), F.coalesce(F.max(F.when(F.col("sent"), F.col("used_chars"))), F.lit(0)).alias("sent_chars"))


def public_hit(hit: str = "hit") -> Column:
    """What of a hit is shown outside: rank, file name without its folders, page, section, text and score."""
    c = F.col(hit)
    name = F.element_at(F.split(c["source"], r"[/\\\\]"), -1)
    return F.struct(c["rank"].alias("rank"), name.alias("source"), c["page"].alias("page"), c["section_path"].alias("section_path"), c["text"].alias("text"), c["score"].alias("score"))


def format_context(hits: DataFrame, query: str) -> DataFrame:
    """query and its hits as one text for inspection: rank, source, page and score in a line, then the text."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("source", F.lit("?")), F.lit(" p."), F.coalesce(F.col("page").cast("string"), F.lit("?")), F.lit(" score="), F.when(F.col("score").isNotNull(), F.format_string("%.4f", F.col("score").cast("double"))).otherwise("?"))
    block = F.struct("rank", F.concat_ws("\n", line, strip(F.col("text"))).alias("block"))
    return hits.groupBy(query).agg(F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda b: b["block"]), "\n\n").alias("context"))


def question_problem(question: Column) -> Column:
    """Why a question is refused, else null: 1 to 2000 characters as it comes, and some that are not white space."""
    n = F.length(question)
    return F.when(question.isNull() | (n < 1), "empty").when(n > 2000, "too long").when(strip(question) == "", "blank")


def messages(question: Column, context: Column, rule: str) -> Column:
    """The messages of a model call: the rule, then the numbered context and the question."""
    user = F.concat(context, F.lit("\n\n"), question)
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(rule).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def final_status(sent: Column, gate_status: Column, answerable: Column, answer: Column) -> Column:
    """struct(answerable, reason) of a question: refused by the gate, no evidence within the budget, refused by the model, or answered."""
    said_no = is_refusal(answer)
    reason = F.when(~answerable, gate_status).when(F.coalesce(sent, F.lit(0)) == 0, "context_budget_empty").when(said_no, "generation_refused")
    return F.struct(reason.isNull().alias("answerable"), reason.alias("reason"))


def render_blocks(text: str) -> list[str]:
    """Numbered context blocks of a prompt, taken apart again."""
    return [b for b in re.split(r"(?m)^(?=\[[0-9]+\] )", text) if b.strip()]
