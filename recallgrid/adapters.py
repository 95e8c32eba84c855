"""What models do for the engine, as protocols, with deterministic versions that need none.

A model's calls run batch by batch in the workers; a task that fails runs again.
"""

from __future__ import annotations

import hashlib
import re
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray: ...


class Extractor(Protocol):
    def triples(self, passage: str) -> list[list[str]]: ...


class Reader(Protocol):
    def answer(self, prompt: str) -> str: ...


class HashEmbedder:
    """Words hashed into a few dimensions with signs, of unit length; a text without words is the zero vector."""

    def __init__(self, width: int = 64):
        self.width = width

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width))
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", (t or "").lower()):
                h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big")
                out[i, h % self.width] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-10)


class RuleExtractor:
    """A triple for each clause "X verb Y" of a sentence, where the verb is one of a few."""

    VERBS = "is|are|was|were|has|have|owns|founded|created|wrote|visited|located in|born in|part of"

    def triples(self, passage: str) -> list[list[str]]:
        out = []
        for s in re.split(r"[.!?\n]+", passage or ""):
            m = re.match(rf"\s*(.+?)\s+({self.VERBS})\s+(.+?)\s*$", s)
            if m:
                out.append(list(m.groups()))
        return out


class FirstPassageReader:
    """Answers with the first line of the prompt."""

    def answer(self, prompt: str) -> str:
        return "Answer: " + prompt.split("\n", 1)[0].removeprefix("Wikipedia Title: ")


def embedded(df: DataFrame, model: Embedder, text_col: str, out: str = "embedding") -> DataFrame:
    """``df`` with the vectors of a text column, encoded batch by batch."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series(list(shared.value.encode(texts.fillna("").tolist())))

    return df.withColumn(out, encode(text_col))


def extracted(df: DataFrame, model: Extractor, text_col: str = "passage") -> DataFrame:
    """``df`` with ``extracted_triples`` and the ``extracted_entities`` in them."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<array<string>>")
    def triples(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: shared.value.triples(t) if t else [])

    from recallgrid.operators.openie import entities_of, valid_triples

    out = df.withColumn("extracted_triples", valid_triples(triples(text_col)))
    return out.withColumn("extracted_entities", entities_of(F.flatten(F.transform("extracted_triples", lambda t: F.array(t[0], t[2])))))


def answered(df: DataFrame, model: Reader, prompt_col: str = "prompt", out: str = "response") -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def answer(prompts: pd.Series) -> pd.Series:
        return prompts.map(lambda p: shared.value.answer(p), na_action="ignore")

    return df.withColumn(out, answer(prompt_col))
