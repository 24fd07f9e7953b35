"""Incremental document intake as a stream, and the incremental reading of server-sent events."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def watch(spark: SparkSession, folder: str, schema: str, upsert: Callable[[DataFrame, int], None], checkpoint: str):
    """Files that arrive in a folder, handed on in batches; available ones now, state in the checkpoint folder."""
    rows = spark.readStream.schema(schema).parquet(folder)
    latest = rows.withColumn("content_sha256", F.sha2("text", 256))
    return latest.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events of each type in event-time windows; with a stream, rows later than the watermark are left out."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sse_events(pieces: Iterable[str]) -> Iterator[tuple[str, object]]:
    """(event, data) of a server-sent stream, however its text is cut."""
    held = ""
    for piece in pieces:
        held += piece.replace("\r\n", "\n")
        while "\n\n" in held:
            frame, held = held.split("\n\n", 1)
            fields = [line.split(":", 1) for line in frame.split("\n") if ":" in line and not line.startswith(":")]
            data = "\n".join(v.removeprefix(" ") for k, v in fields if k == "data")
            if data:
                yield next((v.strip() for k, v in fields if k == "event"), "message"), json.loads(data)
