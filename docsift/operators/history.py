"""Chat history as tables: conversations of numbered turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def title(question: Column) -> Column:
    """The first 29 characters of a question, with an ellipsis if it is longer."""
    return F.when(F.length(question) > 29, F.concat(F.left(question, F.lit(29)), F.lit("…"))).otherwise(question)


def listed(turns: DataFrame) -> DataFrame:
    """conv_id, title from the first turn, turns, last_turn; longest conversations first."""
    rows = turns.groupBy("conv_id").agg(title(F.min_by("text", "turn")).alias("title"), F.count("*").alias("turns"), F.max("turn").alias("last_turn"))
    return rows.orderBy(F.desc("last_turn"), F.desc("conv_id"))


def detail(turns: DataFrame) -> DataFrame:
    """conv_id with its messages in order, as one text."""
    message = F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(message)), lambda m: m["line"]), "\n").alias("messages"))


def deleted(turns: DataFrame, gone: DataFrame) -> DataFrame:
    """The turns without the conversations in ``gone``."""
    return turns.join(gone.select("conv_id").distinct(), "conv_id", "left_anti")


def exchanged(turns: DataFrame, exchanges: DataFrame) -> DataFrame:
    """The turns with the question and answer of each exchange behind the last turn of its conversation.

    ``exchanges`` has conv_id, question, answer, one row a conversation; those of unknown conversations are left out.
    """
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    pair = F.inline(F.array(*(F.struct((F.col("last") + k).alias("turn"), F.lit(role).alias("role"), F.col(text).alias("text")) for k, role, text in ((1, "user", "question"), (2, "assistant", "answer")))))
    return turns.select("conv_id", "turn", "role", "text").union(exchanges.join(last, "conv_id").select("conv_id", pair))


def existing(asked: DataFrame, turns: DataFrame) -> DataFrame:
    """conv_id of ``asked`` and whether there is such a conversation."""
    known = turns.select("conv_id").distinct().withColumn("known", F.lit(True))
    return asked.join(known, "conv_id", "left").select("conv_id", F.coalesce("known", F.lit(False)).alias("found"))


MESSAGE = "conv_id string, message_id long, role string, text string, created_at timestamp, snapshot string"


def initialised(spark: SparkSession) -> DataFrame:
    """An empty message table."""
    return spark.createDataFrame([], MESSAGE)


def conversations(messages: DataFrame) -> DataFrame:
    """conv_id, title, created_at, updated_at, messages; the last changed first."""
    first = F.min_by("text", F.when(F.col("role") == "user", F.col("message_id")))
    rows = messages.groupBy("conv_id").agg(title(first).alias("title"), F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"), F.count("*").alias("messages"))
    return rows.orderBy(F.desc("updated_at"), F.desc("conv_id"))


def saved(messages: DataFrame, exchanges: DataFrame, now: Column) -> DataFrame:
    """The messages with the question and the answer of each exchange, all or none.

    ``exchanges`` has conv_id, question, answer and snapshot (JSON of what was shown), one row a conversation; a null conv_id
    begins a new conversation.  One that is not known is an error.
    """
    last = messages.groupBy("conv_id").agg(F.max("message_id").alias("last"))
    rows = exchanges.withColumns({"new": F.col("conv_id").isNull(), "conv_id": F.coalesce("conv_id", F.uuid())}).join(last, "conv_id", "left")
    known = F.when(~F.col("new") & F.col("last").isNull(), F.raise_error(F.concat(F.lit("unknown conversation "), "conv_id")).cast("long")).otherwise(F.coalesce("last", F.lit(0)))
    parts = ((1, "user", F.col("question"), F.lit(None).cast("string")), (2, "assistant", F.col("answer"), F.col("snapshot")))
    pair = F.inline(F.array(*(F.struct((F.col("at") + k).alias("message_id"), F.lit(role).alias("role"), text.alias("text"), now.alias("created_at"), shown.alias("snapshot")) for k, role, text, shown in parts)))
    added = rows.withColumn("at", known).select("conv_id", pair)
    return messages.select(*added.columns).union(added)


def conversation(messages: DataFrame, conv_id: str) -> DataFrame:
    """The messages of one conversation in order, with their snapshots."""
    return messages.where(F.col("conv_id") == conv_id).orderBy("message_id").select("message_id", "role", "text", "created_at", "snapshot")
