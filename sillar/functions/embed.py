"""Embedding texts with a pluggable model; offline, by hashing words into signed buckets."""

from __future__ import annotations

import re
import zlib
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# By model name, the prefix of queries, the prefix of documents, and the window asked for.
PROFILES = {
    "qwen3-embedding": ("Instruct: Given a developer question, retrieve the source code that implements the answer\nQuery:", "", 8192),
    "nomic-embed-text": ("search_query: ", "search_document: ", 2048),
    "embeddinggemma": ("task: code retrieval | query: ", "title: none | text: ", 2048),
    "bge-m3": ("", "", 8192),
}


def profile(model: str) -> tuple[str, str, int]:
    """(query prefix, document prefix, window) of a model; tags after ':' do not count."""
    return PROFILES.get(model.split(":", 1)[0], ("", "", 2048))


class Embedder(Protocol):
    model: str

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """Words and their halves of identifiers, hashed into signed buckets, of length 1; no meaning is claimed."""

    def __init__(self, size: int = 64):
        self.size, self.model = size, f"hashing-{size}"

    def __call__(self, texts):
        out = []
        for t in texts:
            v = np.zeros(self.size)
            for w in re.findall(r"[A-Za-zÀ-ÿ]+|\d+", re.sub(r"([a-z])([A-Z])", r"\1 \2", t)):
                h = zlib.crc32(w.lower().encode())
                v[h % self.size] += 1 if h >> 16 & 1 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out


def embed(text: Column, embedder: Embedder | None = None, query: bool = False) -> Column:
    """Vectors of a column, batch by batch; a model that returns fewer or empty vectors is an error, null texts give null."""
    model = embedder or HashingEmbedder()
    prefix = profile(model.model)[0 if query else 1]

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        rows = [i for i, t in enumerate(texts) if t is not None]
        vectors = model([prefix + texts.iloc[i] for i in rows])
        if len(vectors) != len(rows) or not all(len(v) for v in vectors):
            raise ValueError("the model did not return one vector for each text")
        out: list = [None] * len(texts)
        for i, v in zip(rows, vectors):
            out[i] = v
        return pd.Series(out)

    return run(text)


def embed_chunks(chunks: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """Chunks with the vector of their path and code."""
    return chunks.withColumn("embedding", embed(F.concat("file_path", F.lit("\n\n"), "code"), embedder))


def check_model(recorded: str | None, wanted: str) -> None:
    """Refuses to query an index that another model made; an index without a record is one of nomic-embed-text."""
    if (recorded or "nomic-embed-text") != wanted:
        raise ValueError(f"the index was made with {recorded or 'nomic-embed-text'}, not with {wanted}")
