"""Model calls behind a narrow surface, with local stand-ins.

The stand-ins are deterministic and need no network. They take the place of models in tests and plans; they
aren't models, and say nothing about the quality that one would have. A remote model implements the same
methods, as a rule with mapInPandas over batches.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field
from itertools import chain
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Embedding(Protocol):
    dimension: int

    def embed(self, text: Column) -> Column: ...


class Classifier(Protocol):
    def classify(self, text: Column) -> Column: ...


class Extractor(Protocol):
    def extract(self, instructions: Column, text: Column) -> Column: ...


class Generator(Protocol):
    def answer(self, question: Column, context: Column, history: Column | None = None) -> Column:
        """history: what was said before, an array of role and content in order, as functions.prompts.chat takes it."""
        ...


def strict(categories: Column, allowed: list[str]) -> Column:
    """Of the categories a model named, those that there are, each once, in its order. Without this, all are kept."""
    return F.array_intersect(categories, F.array(*[F.lit(a) for a in allowed]).cast("array<string>"))


@dataclass
class HashedWords:
    """Counts of a text's words by hash, at unit length; a text without words, or null, is all zeros."""

    dimension: int = 64

    def embed(self, text: Column) -> Column:
        size = self.dimension

        @F.pandas_udf("array<float>")
        def counted(texts: pd.Series) -> pd.Series:
            words = [(t or "").lower().split() for t in texts]
            every = list(chain.from_iterable(words))
            slot = {w: zlib.crc32(w.encode()) % size for w in set(every)}  # a word of many texts is hashed once a batch
            row = np.repeat(np.arange(len(words)), [len(w) for w in words])
            at = row * size + np.fromiter(map(slot.__getitem__, every), np.int64, len(every))
            v = np.bincount(at, minlength=len(words) * size).reshape(-1, size).astype(np.float32)
            return pd.Series(list(v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-12)))

        return counted(text)


@dataclass
class Keywords:
    """Categories whose keyword a text holds (any case), sorted; the summary is the text's first line."""

    rules: dict[str, list[str]] = field(default_factory=dict)

    def categories(self, text: Column) -> Column:
        low = F.lower(F.coalesce(text, F.lit("")))
        found = [F.when(F.greatest(*[low.contains(w.lower()) for w in words], F.lit(False)), F.lit(name)) for name, words in sorted(self.rules.items())]
        return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")

    def classify(self, text: Column) -> Column:
        return F.struct(self.categories(text).alias("categories"), F.regexp_extract(F.coalesce(text, F.lit("")), r"^[^\n]*", 0).alias("clause_summary"))


@dataclass
class FirstSentence:
    """The first sentence that holds any word of the instructions of five letters or more; NA where none does, and a fixed message without text."""

    missing: str = "NA"
    nothing: str = "No relevant sections found"

    def extract(self, instructions: Column, text: Column) -> Column:
        sentences = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^.\n]+"), F.lit(0))
        words = F.regexp_extract_all(F.lower(F.coalesce(instructions, F.lit(""))), F.lit(r"\p{L}{5,}"), F.lit(0))
        fits = F.filter(sentences, lambda s: F.exists(words, lambda w: F.lower(s).contains(w)))
        first = F.trim(F.coalesce(F.try_element_at(fits, F.lit(1)), F.lit(self.missing)))
        return F.when(F.coalesce(text, F.lit("")) == "", F.lit(self.nothing)).otherwise(first)


@dataclass
class TopLines:
    """The first lines of the context, as an answer; where there are none, of what was said before, the last first."""

    lines: int = 3

    def answer(self, question: Column, context: Column, history: Column | None = None) -> Column:
        if history is not None:
            said = F.array_join(F.transform(F.reverse(history), lambda m: F.coalesce(m["content"], F.lit(""))), "\n")
            context = F.when(F.coalesce(context, F.lit("")) != "", context).otherwise(said)
        some = F.filter(F.split(F.coalesce(context, F.lit("")), "\n"), lambda x: x != "")
        return F.array_join(F.slice(some, 1, self.lines), "\n")
