"""Plug-in taggers with a keyed cache: only items that the cache lacks are computed."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.sources.store import stale, upserted

#: A provider turns a batch of inputs into one JSON text each; it is set up once a task.
Provider = Callable[[], Callable[[pd.Series], pd.Series]]


def cache_key(*parts: str, salt: str = "") -> F.Column:
    return F.sha1(F.concat(*[F.col(p) for p in parts], F.lit(salt)))


def tagged(items: DataFrame, cache: DataFrame, key: str, value: str, provider: Provider) -> DataFrame:
    """The cache (key, answer) with answers for items that it lacked."""

    def run(batches):
        answer = provider()
        for frame in batches:
            yield pd.DataFrame({key: frame[key], "answer": answer(frame[value])})

    schema = T.StructType([T.StructField(key, items.schema[key].dataType), T.StructField("answer", T.StringType())])
    new = stale(items.select(key, value).dropDuplicates([key]), cache, [key]).mapInPandas(run, schema)
    return upserted(cache.select(key, "answer"), new, [key])


def resolve(wanted: str, available: Sequence[str]) -> str:
    """The provider asked for, or with ``auto`` the first available of anthropic, ollama, local."""
    if wanted != "auto":
        return wanted
    return next((p for p in ("anthropic", "ollama") if p in available), "local")
