"""Tables written to the cluster's shared folder, tolerant JSON, freshness and upserts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI below ``spark.checkpoint.dir``, deleted when the driver's JVM ends; only where that is unset, in local mode, a local one is made and set.

    A path without a scheme belongs to the cluster's default file system, as
    Spark's own writers take it; it is completed to a URI, so that readers
    outside Spark's, which take a bare path for a local one, find it too.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="chronoloom-")
        spark.sparkContext.setCheckpointDir(base)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    path = fs.makeQualified(path)
    fs.deleteOnExit(path)
    uri = path.toString()
    return "file://" + uri[len("file:") :] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, and no executor's loss can undo it."""
    uri = shared_dir(df.sparkSession, name)
    df.write.parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


def busy(spark: SparkSession) -> int:
    """Partitions for work that takes longer than its rows' bytes tell, so that small partitions are not put together."""
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Names by which Spark's file systems go in pyarrow.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}


def filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a URI as Spark writes it, and the path in it; for tasks that read and write files of their own."""
    scheme, mark, rest = uri.partition("://")
    return pyarrow.fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}{mark}{rest}")


def signature(name: Column, size: Column, modified: Column) -> Column:
    return F.concat_ws(":", name, size.cast("string"), modified.cast("long").cast("string"))


def input_hash(*parts: Column) -> Column:
    """SHA-1 of the parts, one after another with nothing between."""
    return F.sha1(F.concat(*parts))


def fresh(df: DataFrame, expected: Column, hash_col: str = "_input_hash") -> DataFrame:
    return df.filter(F.col(hash_col) == expected)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON document by an explicit schema; a corrupt one gives nulls, not an error."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key it lacks."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def stale(items: DataFrame, cache: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Items that the cache lacks."""
    return items.join(cache.select(*keys), list(keys), "left_anti")


def files(spark: SparkSession, root: str, extensions: Sequence[str]) -> DataFrame:
    """Files below ``root`` by extension (in any case): path, size, modified; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return found.filter(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin([e.lower() for e in extensions]))


def relative(path: Column, root: str) -> Column:
    """Below ``root`` with forward slashes, null elsewhere."""
    p, r = F.regexp_replace(path, r"\\", "/"), root.rstrip("/") + "/"
    return F.when(p.startswith(r), F.substr(p, F.lit(len(r) + 1)))
