"""Quantiles by selection are bit for bit those of ``percentile``."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.operators.quantiles import quantiles

ASK = {"least": ("x", 0.0), "low": ("x", 0.05), "mid": ("x", 0.5), "high": ("x", 0.95), "most": ("x", 1.0), "other": ("y", 0.333)}


def plain(df, keys):
    return df.groupBy(*keys).agg(*[F.percentile(c, F.lit(q)).alias(n) for n, (c, q) in ASK.items()])


@pytest.mark.parametrize("bins", [16, 1024])
def test_equal_to_percentile(spark, bins):
    """Normal and log-normal values over many magnitudes, ties only, negative ones, one value, nulls, no value, a null key."""
    r = np.random.default_rng(3)
    values = {"normal": r.normal(size=501), "wide": np.exp(r.normal(size=400) * (20)), "ties": r.integers(0, 3, 300).astype(float), "one": np.array([-7.25]), None: -np.arange(90.0), "same": np.full(50, 2.5)}
    rows = [(k, float(x), None if i % 3 == 0 else float(-x)) for k, xs in values.items() for i, x in enumerate(xs)] + [("none", None, None), ("ties", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    got, want = (sorted((tuple(x) for x in f.select("k", *ASK).collect()), key=str) for f in (quantiles(df, ["k"], ASK, bins), plain(df, ["k"])))
    assert got == want and len(got) == 7


def test_without_keys(spark):
    df = spark.range(1001).select((F.col("id") * F.col("id")).alias("x"), F.lit(1.5).alias("y"))
    assert quantiles(df, [], ASK).collect() == plain(df, []).select(*ASK).collect()
    assert [tuple(x) for x in quantiles(df.filter("x < 0"), [], ASK).collect()] == [(None,) * len(ASK)]


def test_extremes(spark):
    """Ends whose distance overflows a double; infinite values are refused."""
    big = float(np.finfo(float).max)
    df = spark.createDataFrame([(x, 0.0) for x in (-big, -1.0, 0.0, 3.0, big)], "x double, y double")
    assert quantiles(df, [], {"mid": ("x", 0.5), "near": ("x", 0.75)}).collect() == [(0.0, 3.0)]
    small = spark.createDataFrame([(x, 0.0) for x in (0.0, 5e-324, 1e-323, 5e-324)], "x double, y double")
    assert quantiles(small, [], {"least": ("x", 0.0), "mid": ("x", 0.5), "most": ("x", 1.0)}).collect() == [(0.0, 5e-324, 1e-323)]
    with pytest.raises(Exception, match="infinite value"):
        quantiles(df.union(spark.createDataFrame([(float("inf"), 0.0)], "x double, y double")), [], ASK)
