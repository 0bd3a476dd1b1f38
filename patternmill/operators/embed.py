"""D3: what turns texts into vectors. A model takes the place of HashEmbedder by offering the same two methods and dims."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from patternmill.operators.search import embed, hash_embedding


class Embedder(Protocol):
    dims: int

    def column(self, text: Column) -> Column:
        """array<float> of each text."""

    def query(self, text: str) -> list[float]:
        """The vector of one query, on the driver."""


class HashEmbedder:
    """The deterministic stand-in."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def column(self, text: Column) -> Column:
        return hash_embedding(text, self.dims).cast("array<float>")

    def query(self, text: str) -> list[float]:
        return embed([text], self.dims)[0]


class CallEmbedder:
    """Any function from a list of texts to a list of vectors, called for a batch of rows at a time; null texts go in as empty."""

    def __init__(self, call: Callable[[list[str]], list[list[float]]], dims: int):
        self.call, self.dims = call, dims

    def column(self, text: Column) -> Column:
        call = self.call

        @F.pandas_udf("array<float>")
        def run(values: pd.Series) -> pd.Series:
            return pd.Series(call([v or "" for v in values]))

        return run(text)

    def query(self, text: str) -> list[float]:
        return [float(x) for x in self.call([text])[0]]
