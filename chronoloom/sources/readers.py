"""Readers of text artefacts: one row a file, parsed in Spark's string functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions import parse


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no, line."""
    return whole_texts(spark, path).select("path", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line"))


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    return parse.subtitle_cues(whole_texts(spark, path), ["path"], "text")


def read_lrc(spark: SparkSession, path: str) -> DataFrame:
    return parse.lyric_lines(whole_texts(spark, path), ["path"], "text")


def read_banner(spark: SparkSession, path: str) -> DataFrame:
    return parse.banner(numbered_lines(spark, path), ["path"], "line")


def read_scene_log(spark: SparkSession, path: str) -> DataFrame:
    return parse.scene_cuts(numbered_lines(spark, path), ["path"], "line")


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    return parse.dotenv(spark.read.text(path))


def shots(documents: DataFrame, shot_schema: str) -> DataFrame:
    """Shots of documents (column text) that hold {"shots": [...]} or a bare list; those without an id go."""
    nested = F.from_json("text", f"struct<shots:array<struct<{shot_schema}>>>")["shots"]
    bare = F.from_json("text", f"array<struct<{shot_schema}>>")
    return documents.select(F.explode(F.coalesce(nested, bare)).alias("s")).select("s.*").filter("id is not null")


def middle_keyframes(files: DataFrame, path: str = "path") -> DataFrame:
    """src_idx, index, path: the middle one, by name, of each shot's pictures (srcNN_shotNNN_*.jpg); other files are passed over."""
    name = F.substring_index(path, "/", -1)
    number = lambda n: F.regexp_extract(name, r"^src(\d+)_shot(\d+)_.*\.jpg$", n).try_cast("int")
    ordered = F.array_sort(F.collect_list(path))  # a shot has six at most
    found = files.select(path, number(1).alias("src_idx"), number(2).alias("index")).filter("src_idx is not null")
    return found.groupBy("src_idx", "index").agg(ordered.alias("_p")).select("src_idx", "index", F.element_at("_p", F.floor(F.size("_p") / 2).cast("int") + 1).alias(path))


def wanted(shots_: DataFrame, only: Sequence[str] | None = None, limit: int | None = None, order: str = "id") -> DataFrame:
    """The shots named in ``only``, else the first ``limit`` in order, else all."""
    if only:
        return shots_.filter(F.col("id").isin(*only))
    return shots_.orderBy(order).limit(limit) if limit else shots_
