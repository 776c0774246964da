"""Walks along series that are spread over many ranges, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from chronoloom.operators import chains


@pytest.fixture
def many_ranges(spark):
    """Ranges stay apart, however small: pointers cross them."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", before)


def spaced(times, gap):
    out = []
    for t in sorted(times):
        if not out or t - out[-1] > gap:
            out.append(t)
    return out


def test_greedy_gap_across_ranges(spark, many_ranges):
    """A hot series, a null key, repeated times, null times."""
    r = random.Random(1)
    times = {"hot": [r.randrange(900) for _ in range(700)], None: [r.randrange(60) for _ in range(40)], "one": [5]}
    df = spark.createDataFrame([(k, float(t)) for k, ts in times.items() for t in ts] + [("one", None)], "k string, i double")
    got = [(x.k, x.i) for x in chains.greedy_gap(df, ["k"], 4.0).collect()]
    assert sorted(got, key=str) == sorted([(k, float(t)) for k, ts in times.items() for t in spaced(ts, 4)], key=str)


def test_followers_at_equal_places(spark, many_ranges):
    df = spark.createDataFrame([("a", 0.0), ("a", 2.0), ("a", 4.0), ("b", 3.0)], "k string, i double")
    got = {(x.k, x.i): x.next for x in chains.followers(df, ["k"], "i", F.col("i") + 2.0).collect()}
    assert got == {("a", 0.0): 4.0, ("a", 2.0): None, ("a", 4.0): None, ("b", 3.0): None}


def test_walks_keep_columns_and_number_steps(spark, many_ranges):
    """Strides of one to nine; a walk ends at a null, at no row, and at a row that points back or to itself."""
    r = random.Random(2)
    rows = [(k, i, i + r.randrange(1, 10), f"{k}{i}") for k in range(5) for i in range(-40, 260)]
    odd = {(1, 3): None, (2, 0): 0, (3, 9): 5, (4, 20): 10_000}
    rows = [(k, i, odd.get((k, i), to), name) for k, i, to, name in rows]
    at = {(k, i): (to, name) for k, i, to, name in rows}
    want = []
    for k in range(5):
        i, n = -40, 0
        while (k, i) in at:
            to, name = at[k, i]
            want.append((k, i, to, name, n))
            n += 1
            if to is None or to <= i:
                break
            i = to
    df = spark.createDataFrame(rows, "k int, i int, to int, name string")
    got = [tuple(x) for x in chains.chained(df, ["k"], "i", "to").collect()]
    assert sorted(got, key=lambda x: x[:2]) == want
    assert chains.chained(df.filter("k > 9"), ["k"], "i", "to").count() == 0
