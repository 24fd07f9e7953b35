"""Embedding as an operator that callers supply, and hybrid recall with it.

An embedder is a function of a pandas series of texts that gives one vector for each; it is loaded once for a Python worker.
``hashing_embedder`` stands in where no model is at hand: signed counts of hashed terms, of unit length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.config import DEFAULT, Config
from docsift.operators import retrieval

Embedder = Callable[[pd.Series], pd.Series]
#: Texts that an embedder gets at once.
BATCH = 256
_TERM = re.compile(r"[A-Za-z]+(?:[._+\-]?[A-Za-z0-9]+)*|[0-9]+(?:\.[0-9]+)*|[\u3400-\u9fff]")


def hashing_embedder(dimension: int = 256) -> Embedder:
    def embed(texts: pd.Series) -> pd.Series:
        out = np.zeros((len(texts), dimension), np.float32)
        for row, text in enumerate(texts):
            for term in _TERM.findall(text or ""):
                h = zlib.crc32(term.lower().encode())
                out[row, h % dimension] += 1.0 if h >> 31 else -1.0
        return pd.Series(list(out), index=texts.index)

    return embed


def embedded(rows: DataFrame, id_col: str, embedder: Embedder, *, text_col: str = "text", instruction: str = "", dimension: int | None = None) -> DataFrame:
    """id and embedding of unit length; a vector of another size than the first, or one that is not finite, is an error.

    ``instruction`` goes before each text, as models want it for questions.  A text without terms gives a zero vector, which
    matches nothing; a null text counts as empty.
    """
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = dimension
        for whole in batches:
            for at in range(0, len(whole), BATCH):
                pdf = whole.iloc[at : at + BATCH]
                made = embedder((instruction + pdf["text"].fillna("")).reset_index(drop=True))
                vectors = [np.asarray(v, np.float32) for v in made]
                size = size or (len(vectors[0]) if vectors else None)
                if len(vectors) != len(pdf) or any(v.shape != (size,) for v in vectors):
                    raise ValueError(f"the embedder must give one vector of {size} numbers for each text")
                matrix = np.stack(vectors) if vectors else np.zeros((0, size or 0), np.float32)
                if not np.isfinite(matrix).all():
                    raise ValueError("the embedder gave a number that is not finite")
                matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
                yield pd.DataFrame({id_col: pdf[id_col].to_numpy(), "embedding": list(matrix)})

    return rows.select(F.col(id_col), F.col(text_col).alias("text")).mapInPandas(run, f"{id_col} {kind}, embedding array<float>")


def vector_faults(vectors: DataFrame, id_col: str) -> DataFrame:
    """One row: vectors, distinct sizes, vectors with a number that is not finite, and repeated ids."""
    wrong = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.agg(F.count("*").alias("vectors"), F.countDistinct(F.size("embedding")).alias("sizes"), F.count_if(wrong).alias("not_finite"), (F.count("*") - F.countDistinct(id_col)).alias("repeated_ids"))


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda acc, x: acc + x)


def hybrid(chunks: DataFrame, vectors: DataFrame, questions: DataFrame, chunk_id: str, question_id: str, embedder: Embedder, *, config: Config = DEFAULT, weights: dict[str, float] | None = None) -> DataFrame:
    """Dense and sparse recall of each question, fused: question, chunk, ranks and scores of both routes, fusion_rank."""
    asked = embedded(questions, question_id, embedder, instruction=config.query_instruction)
    dense = retrieval.dense_topk(vectors, asked, chunk_id, question_id, config.dense_top_k).select(F.col("query").alias(question_id), F.col("vec").alias(chunk_id), "score", "rank")
    sparse = retrieval.bm25_topk(chunks, questions, chunk_id, question_id, config=config)
    routes = {"dense": dense, "bm25": sparse}
    return retrieval.reciprocal_rank_fusion(routes, question_id, chunk_id, k=config.fused_top_k, rrf_k=config.rrf_k, weights=weights)
