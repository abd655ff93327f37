"""Plug points for models: embedders, rerankers and page readers, with deterministic stand-ins.

A model class is created once for each Python worker and fed Arrow batches. A batch that fails gives nulls and an error text
instead of ending the job.
"""

from __future__ import annotations

import hashlib
import importlib
import re
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


class Embedder(Protocol):
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class Reranker(Protocol):
    def score(self, query: str, texts: list[str]) -> list[float]: ...


class PageReader(Protocol):
    def read(self, image: bytes) -> str: ...


class HashedEmbedder:
    """Counts of words in md5 buckets, at unit length."""

    dim = 64

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", (t or "").lower()):
                out[i, int(hashlib.md5(w.encode()).hexdigest(), 16) % self.dim] += 1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


class OverlapReranker:
    """The share of a query's distinct words that a text holds."""

    def score(self, query: str, texts: list[str]) -> list[float]:
        q = set(re.findall(r"\w+", query.lower()))
        return [len(q & set(re.findall(r"\w+", (t or "").lower()))) / max(1, len(q)) for t in texts]


def load(name: str):
    """'module:Class' as a class."""
    module, _, cls = name.partition(":")
    return getattr(importlib.import_module(module), cls)


@lru_cache(maxsize=4)
def instance(name: str):
    return load(name)()


HASHED, OVERLAP = "folio.functions.models:HashedEmbedder", "folio.functions.models:OverlapReranker"


def embed(texts: Column, model: str = HASHED) -> Column:
    """A vector for each text, at unit length as the model gives it; null for null texts and for vectors that are not finite."""

    def run(batch: pd.Series) -> pd.Series:
        v = np.asarray(instance(model).encode(batch.fillna("").tolist()), np.float32)
        return pd.Series([None if t is None or not np.isfinite(x).all() else x.tolist() for t, x in zip(batch, v)])

    return F.pandas_udf(run, "array<float>")(texts)


def rerank(pool: DataFrame, model: str = OVERLAP, query: str = "query", text: str = "text") -> DataFrame:
    """Adds rerank in [0, 1] and rerank_error; a failing model keeps the order that was there."""

    def run(batches):
        for pdf in batches:
            scores, errors = pd.Series([None] * len(pdf), index=pdf.index, dtype=object), pd.Series([None] * len(pdf), index=pdf.index, dtype=object)
            for q, part in pdf.groupby(query, sort=False):
                try:
                    s = np.asarray(instance(model).score(q, part[text].fillna("").tolist()), float)
                    if len(s) and (s.min() < 0 or s.max() > 1):
                        s = 1 / (1 + np.exp(-s))
                    scores[part.index] = s.tolist()
                except Exception as e:  # noqa: BLE001 - the order without the model is the answer then
                    errors[part.index] = f"{type(e).__name__}: {e}"[:300]
            yield pdf.assign(rerank=scores.astype(float), rerank_error=errors)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pool.schema.fields)
    return pool.mapInPandas(run, f"{fields}, rerank double, rerank_error string")
