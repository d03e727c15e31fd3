"""Encoding of a corpus to vectors in batches by any encoder; one that needs no weights is given."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


class HashingEncoder:
    """Signed counts of words in ``width`` cells by a hash, of unit length; a text without a word is the zero vector."""

    def __init__(self, width: int = 64):
        self.width = width

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width), "f4")
        for row, text in zip(out, texts, strict=True):
            for word in re.findall(r"[^\W_]+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode("utf-8"), digest_size=8).digest(), "little")
                row[(h >> 1) % self.width] += 1.0 if h & 1 else -1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def encode(df: DataFrame, key: str, text: str, encoder: Callable[[list[str]], np.ndarray], batch: int = 256) -> DataFrame:
    """(key, vector array<float>) of every row with a text; ``encoder`` is sent to the tasks once and called with ``batch`` texts at a time."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                vectors = np.asarray(encoder(part.column(1).to_pylist()), "f4")
                flat = pa.array(vectors.ravel(), pa.float32())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, vectors.size + 1, vectors.shape[1]), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[key, "vector"])

    return df.where(df[text].isNotNull()).select(key, text).mapInArrow(run, f"{key} {kind}, vector array<float>")
