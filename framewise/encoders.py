"""Models are plugged in: what a query and a pipeline need of them, and a deterministic stand-in for tests."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType


class Encoder(Protocol):
    """Unit vectors of texts, and the entities that texts name."""

    def visual(self, texts: list[str]) -> np.ndarray: ...

    def text(self, texts: list[str]) -> np.ndarray: ...

    def entities(self, texts: list[str]) -> list[list[str]]: ...


class DeterministicEncoder:
    """Vectors drawn from a hash of the text; entities are capitalised words. No model, for tests alone."""

    def __init__(self, size: int = 64):
        self.size = size

    def _vectors(self, kind: str, texts: list[str]) -> np.ndarray:
        out = np.stack([np.random.default_rng(int.from_bytes(hashlib.sha256(f"{kind}:{t}".encode()).digest()[:8], "little")).standard_normal(self.size) for t in texts])
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-8)).astype(np.float32)

    def visual(self, texts: list[str]) -> np.ndarray:
        return self._vectors("visual", texts)

    def text(self, texts: list[str]) -> np.ndarray:
        return self._vectors("text", texts)

    def entities(self, texts: list[str]) -> list[list[str]]:
        return [[w.strip(".,;:!?") for w in t.split() if w[:1].isupper()] for t in texts]


def captioned(column: Column, load: Callable[[], Callable[[object], str]]) -> Column:
    """Captions of a column by a model that load() makes once in each worker task; "" where it fails for a row."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        caption = load()

        def safe(value: object) -> str:
            try:
                return caption(value) or ""
            except Exception:  # noqa: BLE001 - one frame that a model cannot read must not end the stage
                return ""

        for values in batches:
            yield pd.Series([safe(v) for v in values], dtype=object)

    return run(column)


def embed(column: Column, load: Callable[[], Encoder], kind: str = "text") -> Column:
    """Vectors of a text column by an iterator of Arrow batches; load() runs once in each worker task."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = load()
        for texts in batches:
            yield pd.Series(list(getattr(encoder, kind)([t or "" for t in texts]))) if len(texts) else pd.Series([], dtype=object)

    return run(column)
