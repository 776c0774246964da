"""Helpers that the training-data operators share.

Nothing here collects documents: tables are cut off from their lineage by
writing them to the folder that the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.sources.store import shared_dir, written  # noqa: F401


def pick(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns, as ``new=old``; others, whatever their names or case, can't clash."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{position(df.columns, old)}").alias(new) for new, old in names.items()])


def position(columns: Sequence[str], name: str) -> int:
    """Index of ``name``: by exact case first, else in any case."""
    if name in columns:
        return list(columns).index(name)
    lower = [c.lower() for c in columns]
    if name.lower() not in lower:
        raise ValueError(f"no column {name!r} among {list(columns)}")
    return lower.index(name.lower())


def groups_by_bytes(lengths: Sequence[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` bytes each (a longer row stands alone)."""
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def with_text_columns(
    df: DataFrame,
    make: Callable[[], Callable[[list[str]], list[Sequence]]],
    fields: Sequence[tuple[str, T.DataType, pa.DataType]],
    text_col: str = "text",
    group_bytes: int = 4 << 20,
) -> DataFrame:
    """``df`` with columns computed from whole texts in Arrow batches; a null text counts as empty.

    ``make()`` runs once a task and returns a function from a list of texts to
    one list per field.  Work is dealt out in groups of about ``group_bytes``.
    Columns of ``df`` named like a new one (in any case) are replaced.
    """
    new = {name.lower() for name, _, _ in fields}
    at = position(df.columns, text_col)
    keep = [i for i, c in enumerate(df.columns) if c.lower() not in new]
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    plain = plain.select(*[f"c{i}" for i in keep], F.col(f"c{at}").alias("whole_text"))
    schema = T.StructType([T.StructField(f"c{i}", df.schema[i].dataType, True) for i in keep] + [T.StructField(f"n{i}", kind, True) for i, (_, kind, _) in enumerate(fields)])
    arrow = [kind for _, _, kind in fields]

    def run(batches):
        compute = make()
        for batch in batches:
            texts = batch.column(len(keep))
            sizes = [0 if n is None else n for n in pc.binary_length(texts).to_pylist()]
            for a, b in groups_by_bytes(sizes, group_bytes):
                values = [t or "" for t in texts.slice(a, b - a).to_pylist()]
                got = compute(values)
                arrays = [batch.column(i).slice(a, b - a) for i in range(len(keep))]
                arrays += [v if isinstance(v, pa.Array) else pa.array(v, type=k) for v, k in zip(got, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[f"c{i}" for i in keep] + [f"n{i}" for i in range(len(fields))])

    out = plain.mapInArrow(run, schema)
    return out.toDF(*[df.columns[i] for i in keep], *[name for name, _, _ in fields])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def hash64(*columns: Column) -> Column:
    return F.xxhash64(*columns)


#: Names by which Spark's file systems go in pyarrow.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}


def filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a URI as Spark writes it, and the path in it."""
    scheme, mark, rest = uri.partition("://")
    return pyarrow.fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}{mark}{rest}")
