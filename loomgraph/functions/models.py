"""Extension points: embedders and rerankers that run as vectorised functions."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.retrieval import identity_rerank, top_k
from .texts import DENSE


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Signed token counts by an 8-byte BLAKE2 hash; rows have length 1."""

    def __init__(self, dim: int = 384):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            for token in re.findall(DENSE, t.lower()):
                h = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "big")
                out[i, h % self.dim] += 1.0 if h // self.dim % 2 == 0 else -1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embedded(docs: DataFrame, embedder: Embedder, text: str = "text") -> DataFrame:
    """Adds ``embedding``."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(list(embedder.embed(s.fillna("").tolist())))

    return docs.withColumn("embedding", run(F.col(text)))


Score = Callable[[list[str], list[str]], list[float]]


def reranked(hits: DataFrame, score: Score | None, k: int, query: str = "query", text: str = "content") -> DataFrame:
    """The best k of each query by a pairwise model; by their own score without one."""
    if score is None:
        return identity_rerank(hits, k)

    @F.pandas_udf("double")
    def run(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(score(q.tolist(), t.tolist()))

    scored = hits.drop("rank").withColumn("rerank_score", run(F.col(query), F.col(text)))
    return top_k(scored, k, score="rerank_score")


EMBEDDERS: dict[str, Callable[..., Embedder]] = {"hash": HashEmbedder}


def create_embedder(name: str = "hash", **options) -> Embedder:
    return EMBEDDERS[name](**options)


def ratio_rerank(queries: list[str], texts: list[str]) -> list[float]:
    """A model that needs no weights: the share of a query's words that a text has."""
    words = lambda x: set(re.findall(DENSE, x.lower()))
    return [len(words(q) & words(t)) / max(len(words(q)), 1) for q, t in zip(queries, texts, strict=True)]


def same_dimension(a: Column, b: Column) -> Column:
    return F.size(a) == F.size(b)
