"""Token counts: batch encoding in Arrow functions that return lengths only.

Rows are dealt out in groups balanced by bytes.  All texts, long ones too, are
split at white space, which this tokenizer drops, so no token spans it.  The
pieces of a group that a worker has not met go to the library's batch encoding
in calls balanced by bytes; only their lengths are kept, and a text's count is
the sum over its pieces.

Edge cases: a null or empty text has 0 bytes and 0 tokens; repeated rows are
counted each on their own; an empty table gives an empty result; columns named
like a result are replaced, others passed on by :func:`with_counts`.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.llm.chunks import WordCounts, load
from chronoloom.llm.common import with_text_columns


@functools.lru_cache(maxsize=1)
def counts_of(tokenizer_path: str) -> WordCounts:
    """One memo a Python worker: later tasks find the pieces of earlier ones."""
    return WordCounts(load(tokenizer_path))


def counter(tokenizer_path: str):
    """A function from texts to [UTF-8 lengths, token counts]."""
    counts = counts_of(tokenizer_path)
    return lambda texts: [[len(t.encode("utf-8")) for t in texts], counts(texts)]


def with_counts(df: DataFrame, tokenizer_path: str, limit: int = 2048, text_col: str = "text", group_bytes: int = 4 << 20) -> DataFrame:
    """``df`` with n_bytes, n_tokens and over_limit (n_tokens > ``limit``)."""
    fields = [("n_bytes", T.LongType(), pa.int64()), ("n_tokens", T.LongType(), pa.int64())]
    out = with_text_columns(df, lambda: counter(tokenizer_path), fields, text_col, group_bytes)
    kept = [c for c in out.columns if c.lower() != "over_limit"]
    return out.select(*kept, (F.col("n_tokens") > limit).alias("over_limit"))
