"""Published generations of tables, small JSON files that are replaced whole, and locks between processes."""

from __future__ import annotations

import fcntl
import json
import os
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def atomic_json(path: str, value: object) -> None:
    """Replaces a local JSON file as a whole: written beside it, forced to disk, renamed."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    beside = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
    try:
        with beside.open("w", encoding="utf-8") as f:
            json.dump(value, f, ensure_ascii=False, indent=2)
            f.flush()
            os.fsync(f.fileno())
        beside.replace(target)
    finally:
        beside.unlink(missing_ok=True)


def read_json(path: str) -> object:
    """A local JSON file, with or without a byte order mark."""
    return json.loads(Path(path).read_text(encoding="utf-8-sig"))


@contextmanager
def exclusive_lock(path: str | None) -> Iterator[None]:
    """Held by one process at a time; a second one fails at once.  Without a path nothing is locked."""
    if path is None:
        yield
        return
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "a+b") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError:
            raise RuntimeError(f"{path} is held by another process") from None
        try:
            yield
        finally:
            fcntl.flock(f, fcntl.LOCK_UN)


class IndexStore:
    """Generations of tables under a folder and a pointer to the one in use, switched after the new one has been read back."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = self._place("current.json")
        self._fs = self._path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._stage = f"stage-{uuid.uuid4().hex}"

    def _place(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def exists(self) -> bool:
        return self._fs.exists(self._path)

    def stage(self, name: str, df: DataFrame) -> DataFrame:
        """Write an intermediate table under the folder and read it back."""
        path = f"{self.root}/{self._stage}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear_stage(self) -> None:
        self._fs.delete(self._place(self._stage), True)

    def publish(self, tables: dict[str, DataFrame], keys: dict[str, str], note: dict | None = None) -> str:
        """Write all tables, check row counts and unique keys, then move the pointer, with a note; returns the generation."""
        name = uuid.uuid4().hex
        for table, df in tables.items():
            df.write.parquet(f"{self.root}/generations/{name}/{table}")
        for table, key in keys.items():
            back = self.spark.read.parquet(f"{self.root}/generations/{name}/{table}")
            n, distinct = back.agg(F.count("*"), F.countDistinct(key)).first()
            if n != distinct or not n:
                self._fs.delete(self._place(f"generations/{name}"), True)
                raise ValueError(f"{table}: {n} rows, {distinct} distinct {key}; the old generation stays in use")
        new = self._place(f"current-{name}.json")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps({"generation": name, "note": note or {}}).encode()))
        out.close()
        self._fs.delete(self._path, False)
        if not self._fs.rename(new, self._path):
            raise OSError(f"pointer not moved to {name}")
        return name

    def _pointer(self) -> dict:
        return json.loads(self.spark.read.text(self._path.toString(), wholetext=True).first()[0])

    def note(self) -> dict:
        """What was noted with the generation in use."""
        return self._pointer().get("note", {})

    def current(self) -> str:
        name = self._pointer()["generation"]
        if not re.fullmatch("[0-9a-f]{32}", name):
            raise ValueError("pointer does not name a generation")
        return name

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/generations/{self.current()}/{table}")

    def save_postings(self, postings: DataFrame, lengths: DataFrame, signature: str) -> str:
        """A sparse index as tables of its own generation, with the signature of the settings it was made with."""
        return self.publish({"postings": postings, "lengths": lengths}, {"lengths": lengths.columns[0]}, {"bm25": signature, "documents": lengths.count()})

    def load_postings(self, signature: str) -> tuple[DataFrame, DataFrame]:
        """The tables of a sparse index; other settings, or another number of documents than noted, are an error."""
        note, lengths = self.note(), self.read("lengths")
        if note.get("bm25") != signature or note.get("documents") != lengths.count():
            raise ValueError("the sparse index was made with other settings, or is not whole")
        return self.read("postings"), lengths
