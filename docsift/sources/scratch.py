"""Intermediate tables in the folder that the cluster shares, and small inputs dealt over all cores.

A lineage is cut by writing a table under the folder that ``spark.checkpoint.dir`` names, which every executor and the driver
can see.  Losing an executor then costs at most the tasks that ran on it.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_scratch: dict[str, object] = {}
#: Bytes for each core below which an input of few files is dealt over the cores.
SMALL = 64 << 20
#: Bytes of a part of a table that is dealt by keys, as estimated from its files, and the size from which nothing is estimated.
PART, UNKNOWN = 4 << 20, 1 << 50


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a folder of our own only in local mode, where one machine does everything."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="docsift-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder that is removed when the driver ends."""
    path = f"{shared_dir(spark)}/docsift/{label}-{uuid.uuid4().hex}"
    _scratch[path] = spark
    return path


def materialize(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: a checkpoint that survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._docsift_path = path
    return out


def drop_scratch(*frames: DataFrame) -> None:
    """Remove tables that ``materialize`` wrote and that no later plan reads."""
    for df in frames:
        path = getattr(df, "_docsift_path", None)
        if path and _scratch.pop(path, None) is not None:
            _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@atexit.register
def _sweep() -> None:
    for path, spark in list(_scratch.items()):
        try:
            if spark._jsc.sc().isStopped():
                continue
            _remove(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone at exit
            pass


def spread(df: DataFrame) -> DataFrame:
    """A table of few files and little data over all cores, since a file of one row group is one task; others as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if _bytes(df) < cores * SMALL and len(df.inputFiles()) < cores else df


def _bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """A table by keys in parts of bounded bytes, so that what a task holds does not grow with the input."""
    size, cores = _bytes(df), df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-size // PART)), *keys) if size < UNKNOWN else df.repartition(*keys)
