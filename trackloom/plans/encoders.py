"""Text encoders. Anything with encode(list of texts) -> unit vectors will do; the one here
hashes words and needs no model."""

from __future__ import annotations

import zlib
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Encoder(Protocol):
    dimension: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashingEncoder:
    """Signed word and word-pair hashes, scaled to length one."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for i, text in enumerate(texts):
            words = text.lower().split()
            for term in [*words, *[f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]]:
                h = zlib.crc32(term.encode())
                out[i, h % self.dimension] += 1.0 if h >> 31 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


def encode_column(encoder: Encoder, text: Column) -> Column:
    """Vectors of a text column, an Arrow batch at a time."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(encoder.encode(texts.fillna("").tolist())))

    return run(text)


def encode_query(encoder: Encoder, query: str) -> list[float]:
    if not str(query).strip():
        raise ValueError("an empty question")
    return encoder.encode([query])[0].astype(float).tolist()
