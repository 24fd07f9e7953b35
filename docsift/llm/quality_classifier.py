"""Quality classifier by compression (operator 7).

Two zstandard dictionaries are built, from good and from bad labelled text.  A text that resembles the good text compresses
smaller with the good dictionary, so the difference of both compressed sizes over the text's length tells the classes
apart; a logistic curve, fitted on labelled texts that are in neither dictionary, turns it into a probability.

The fit uses a bounded sample: of each label the ``per_class`` documents with the smallest hash of their id, each of at
most ``max_chars`` characters.  Ids whose crc32 (as text) leaves 1 when divided by 3 are held out of it.  The score reads
the text alone.

Results: null and empty texts get the score of no difference; without labels of both classes every score is 0.5;
repeated rows give equal results; if an id has several labels the smallest counts; an empty table gives an empty table;
columns other than id, text and the label are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import batch_rows, texts

PER_CLASS, MAX_CHARS = 1500, 20_000
DICTIONARY, LEVEL, PIECE = 96 << 10, 3, 2048


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> tuple[list[tuple[int, str]], float]:
    """(label, text) in a settled order, and the share of label 1 among all usable labels; the ids are chosen before any text is read, so no text is shuffled."""
    usable = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality")).where(~held_out(F.col("doc_id")))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = [usable.where(F.col("quality") == k).orderBy(*order).limit(per_class) for k in (0, 1)]
    few = F.broadcast(ids[0].union(ids[1]))  # at most 2 * per_class rows
    rows = docs.join(few, "doc_id").where(F.length("text").between(1, max_chars)).select("doc_id", "quality", "text").collect()
    share = usable.agg(F.avg("quality")).first()[0]
    return [(r["quality"], r["text"]) for r in sorted(rows, key=lambda r: (r["doc_id"] * 2654435761 % 2**32, r["doc_id"], r["text"]))], 0.5 if share is None else float(share)


class Model:
    """Both dictionaries and the curve; ``dictionaries`` is None if one class had no text."""

    def __init__(self, sample: list[tuple[int, str]], share: float = 0.5):
        self.share = min(0.99, max(0.01, share))
        raw = [(y, t.encode("utf-8", "surrogatepass")) for y, t in sample]
        # Every third document of a class is for the curve.
        parts: dict[tuple[int, bool], list[bytes]] = {}
        for y, data in raw:
            seen = sum(len(parts.get((y, k), [])) for k in (False, True))
            parts.setdefault((y, seen % 3 == 2), []).append(data)
        self.dictionaries, self.slope, self.shift = None, 0.0, 0.0
        if all(parts.get((y, k)) for y in (0, 1) for k in (False, True)):
            self.dictionaries = [_dictionary(parts[y, False]) for y in (0, 1)]
            x = np.array([self.difference(d) for y in (0, 1) for d in parts[y, True]])
            y = np.repeat([0.0, 1.0], [len(parts[0, True]), len(parts[1, True])])
            self._fit(x, y)

    def _compressors(self) -> list[zstandard.ZstdCompressor]:
        if not hasattr(self, "_made"):
            self._made = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=kind)) for d, kind in self.dictionaries]
        return self._made

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_made"}

    def difference(self, data: bytes) -> float:
        """Compressed size with the bad dictionary minus that with the good one, over the length."""
        if not data:
            return 0.0
        # Piece by piece, else a long text soon compresses by its own past and no longer by the dictionary.
        pieces = [data[k : k + PIECE] for k in range(0, len(data), PIECE)]
        bad, good = (sum(len(c.compress(p)) for p in pieces) for c in self._compressors())
        return (bad - good) / len(data)

    def _fit(self, x: np.ndarray, y: np.ndarray) -> None:
        """Logistic regression on the standardised difference, classes weighted as they occur among all usable labels."""
        mean, scale = x.mean(), x.std() or 1.0
        design = np.stack([(x - mean) / scale, np.ones_like(x)])
        weight = np.where(y > 0, self.share / y.mean(), (1 - self.share) / (1 - y.mean()))
        beta = np.zeros(2)
        for _ in range(100):
            p = 1 / (1 + np.exp(-beta @ design))
            step = np.linalg.solve((design * (weight * p * (1 - p))) @ design.T + 1e-2 * np.eye(2), design @ (weight * (y - p)) - 1e-2 * beta)
            beta += step
            if abs(step).max() < 1e-9:
                break
        self.slope, self.shift = float(beta[0] / scale), float(beta[1] - beta[0] * mean / scale)

    def score(self, text: str) -> float:
        if self.dictionaries is None:
            return 0.5
        z = self.slope * self.difference(text.encode("utf-8", "surrogatepass")) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def _dictionary(samples: list[bytes]) -> tuple[bytes, int]:
    """A trained dictionary, or the texts themselves where there are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes(), zstandard.DICT_TYPE_FULLDICT
    except zstandard.ZstdError:
        return b"\n".join(samples)[:DICTIONARY], zstandard.DICT_TYPE_RAWCONTENT


def scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **sample) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    docs = texts(docs, id_col=id_col, text_col=text_col)
    model = Model(*training_sample(docs, labels, **sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(batch_rows(batch, "doc_id", "text"))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([model.score(r[1]) for r in rows], pa.float64())], ["doc_id", "score"])

    scored = docs.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))
