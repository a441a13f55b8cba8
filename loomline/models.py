"""Model protocols and deterministic offline stand-ins. Any object with the method fits; models load once per Python worker."""

from __future__ import annotations

import json
import re
import zlib
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Embedder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray: ...


class PairScorer(Protocol):
    def predict(self, pairs: list[tuple[str, str]]) -> list[float]: ...


class Generator(Protocol):
    def generate(self, prompt: str, seed: int = 0) -> str: ...


_WORD = re.compile(r"[^\W_]+")


class HashEmbedder:
    """Signed feature hashing of words, scaled to length one."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims), dtype=np.float64)
        for i, text in enumerate(texts):
            for word in _WORD.findall((text or "").lower()):
                h = zlib.crc32(word.encode())
                out[i, h % self.dims] += 1.0 if h & 0x10000 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1.0, norm)


class OverlapScorer:
    """Share of the first text's words in the second."""

    def predict(self, pairs: list[tuple[str, str]]) -> list[float]:
        out = []
        for a, b in pairs:
            x, y = set(_WORD.findall((a or "").lower())), set(_WORD.findall((b or "").lower()))
            out.append(len(x & y) / len(x) if x else 0.0)
        return out


class ExtractiveGenerator:
    """The sentence of the prompt's last paragraph picked by the seed."""

    def generate(self, prompt: str, seed: int = 0) -> str:
        parts = [s.strip() for s in re.split(r"(?<=[.!?])\s+", prompt.strip().rsplit("\n\n", 1)[-1]) if s.strip()]
        return parts[seed % len(parts)] if parts else ""


class PassageGenerator:
    """Pairs about the prompt's last paragraph as JSON: its first sentences are the answers. A prompt for a question gives one."""

    def generate(self, prompt: str, seed: int = 0) -> str:
        passage = prompt.split("Passage:\n", 1)
        if len(passage) < 2:
            return json.dumps({"question": f"What was settled about {' '.join(prompt.split()[-6:])}?"})
        said = [s.strip() for s in re.split(r"(?<=[.!?])\s+", passage[1].strip()) if s.strip()][seed : seed + 2]
        return "Pairs:\n" + json.dumps([{"question": f"What does the passage say about {' '.join(s.split()[:4])}?", "answer": s} for s in said], ensure_ascii=False)


def embed(text: Column, model: Embedder) -> Column:
    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([v.astype("float32").tolist() for v in model.encode(texts.fillna("").tolist())])

    return run(text)


class EmbeddingScorer:
    """Dot product of the vectors of both texts."""

    def __init__(self, model: Embedder):
        self.model = model

    def predict(self, pairs: list[tuple[str, str]]) -> list[float]:
        left, right = (self.model.encode([p[i] for p in pairs]) for i in (0, 1))
        return (left * right).sum(axis=1).tolist()


def score_pairs(a: Column, b: Column, model: PairScorer) -> Column:
    """The model's scores; a batch on which it fails has none (null), so that another scorer can follow."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        try:
            return pd.Series(model.predict(list(zip(x.fillna(""), y.fillna("")))), dtype="float64")
        except Exception:  # noqa: BLE001 whatever a model raises, the chain goes on
            return pd.Series([None] * len(x), dtype="float64")

    return run(a, b)


def generate(prompt: Column, model: Generator, seed: int = 0) -> Column:
    """Model output; null for null prompts and where the model fails, so that one prompt does not end a job."""

    def one(p):
        try:
            return model.generate(p, seed) if isinstance(p, str) else None
        except Exception:  # noqa: BLE001
            return None

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        return prompts.map(one)

    return run(prompt)
