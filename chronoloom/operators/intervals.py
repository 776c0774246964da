"""Interval operators.  Range joins go through equal-width bins, so both sides are dealt out by key and bin."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def from_boundaries(cuts: DataFrame, keys: Sequence[str], t: str, duration: Column, margin: float = 0.05) -> DataFrame:
    """Intervals between 0, the distinct cuts inside the margins, and the duration: keys, start, end."""
    bounds = cuts.groupBy(*keys).agg(duration.alias("_d"))
    ends = bounds.select(*keys, F.explode(F.array(F.lit(0.0), F.col("_d"))).alias("_t"))
    inner = cuts.select(*keys, F.round(t, 3).alias("_t")).join(bounds, list(keys))
    inner = inner.filter((F.col("_t") > margin) & (F.col("_t") < F.col("_d") - margin)).select(*keys, "_t")
    points = inner.unionByName(ends).distinct()
    w = Window.partitionBy(*keys).orderBy("_t")
    return points.select(*keys, F.col("_t").alias("start"), F.lead("_t").over(w).alias("end")).filter("end is not null")


def coalesced(spans: DataFrame, keys: Sequence[str], pad: float, start: str = "start", end: str = "end") -> DataFrame:
    """Intervals widened by ``pad`` on both sides (not below 0) and merged where they touch: keys, start, end."""
    w = Window.partitionBy(*keys).orderBy("_a", "_b").rowsBetween(Window.unboundedPreceding, -1)
    wide = spans.select(*keys, F.greatest(F.lit(0.0), F.col(start) - pad).alias("_a"), (F.col(end) + pad).alias("_b"))
    flagged = wide.withColumn("_reach", F.max("_b").over(w)).withColumn("_new", F.when(F.col("_reach").isNull() | (F.col("_a") > F.col("_reach")), 1).otherwise(0))
    run = F.sum("_new").over(Window.partitionBy(*keys).orderBy("_a", "_b").rowsBetween(Window.unboundedPreceding, 0))
    return flagged.withColumn("_run", run).groupBy(*keys, "_run").agg(F.min("_a").alias(start), F.max("_b").alias(end)).drop("_run")


def binned(spans: DataFrame, width: float, start: str, end: str) -> DataFrame:
    """One row for each bin of ``width`` that the closed interval touches."""
    return spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.greatest(start, end) / width))))


def overlapping(left: DataFrame, right: DataFrame, keys: Sequence[str], width: float, closed: bool, how: str, left_span: tuple[str, str], right_span: tuple[str, str], row: Sequence[str]) -> DataFrame:
    """Rows of ``left`` that overlap (``left_semi``) or don't (``left_anti``) an interval of ``right`` with the same keys.

    ``row`` identifies rows of ``left``; only these travel through the join.
    """
    (a, b), (c, d) = left_span, right_span
    l = binned(left.select(*keys, *row, F.col(a).alias("_a"), F.col(b).alias("_b")), width, "_a", "_b")
    r = binned(right.select(*keys, F.col(c).alias("_c"), F.col(d).alias("_d")), width, "_c", "_d")
    meets = (F.col("_a") <= F.col("_d")) & (F.col("_b") >= F.col("_c")) if closed else (F.col("_a") < F.col("_d")) & (F.col("_b") > F.col("_c"))
    hit = l.join(r, [*keys, "_bin"]).filter(meets).select(*row).distinct()
    return left.join(hit, list(row), how)


def containing(points: DataFrame, spans: DataFrame, keys: Sequence[str], t: str, width: float, inside: Column, start: str = "start", end: str = "end") -> DataFrame:
    """Points beside every interval for which ``inside`` holds, through bins of ``width``."""
    p = points.withColumn("_bin", F.floor(F.col(t) / width))
    return p.join(binned(spans, width, start, end), [*keys, "_bin"]).filter(inside).drop("_bin")


def first_cover(points: DataFrame, spans: DataFrame, keys: Sequence[str], t: str, position: str, lead: float, width: float, start: str = "start", end: str = "end") -> DataFrame:
    """For each point the first interval (by ``position``) with start - lead <= t <= end: keys, t, position."""
    wide = spans.withColumn("_from", F.col(start) - lead)
    hits = containing(points, wide, keys, t, width, (F.col("_from") <= F.col(t)) & (F.col(t) <= F.col(end)), "_from", end)
    return hits.groupBy(*keys, t).agg(F.min(position).alias(position))


def nearest(points: DataFrame, marks: DataFrame, keys: Sequence[str], t: str, mark: str, into: str = "nearest") -> DataFrame:
    """The nearest mark to each point, the earlier on ties, without pairing them: both are put in one order, and the last mark before and the first after are looked up."""
    both = points.select(*keys, F.col(t).alias("_t"), F.lit(None).cast("double").alias("_m")).distinct().unionByName(marks.select(*keys, F.col(mark).alias("_t"), F.col(mark).cast("double").alias("_m")).distinct())
    w = Window.partitionBy(*keys).orderBy("_t", F.col("_m").isNull())
    back = Window.partitionBy(*keys).orderBy("_t", F.col("_m").isNotNull())
    before = F.last("_m", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_m", ignorenulls=True).over(back.rowsBetween(0, Window.unboundedFollowing))
    found = both.withColumns({"_p": before, "_n": after}).filter("_m is null")
    closer = F.when(F.col("_n").isNull() | (F.col("_t") - F.col("_p") <= F.col("_n") - F.col("_t")), F.col("_p")).otherwise(F.col("_n"))
    return found.select(*keys, F.col("_t").alias(t), closer.alias(into))


def density(points: DataFrame, keys: Sequence[str], t: str, lo: Column, width: float, n: int) -> DataFrame:
    """Counts by bin of ``width`` from ``lo``, the last bin taking what lies beyond; empty bins are 0: keys, bin, hits."""
    counts = points.groupBy(*keys, F.least(F.lit(n - 1), F.floor((F.col(t) - lo) / width).cast("int")).alias("bin")).agg(F.count("*").alias("hits"))
    spine = points.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return spine.join(counts, [*keys, "bin"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)).cast("long"))


def hot_span(bins: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """First and last bin of at least max(0.8 mean, 0.25 max): keys, first_bin, last_bin."""
    w = Window.partitionBy(*keys)
    least = F.greatest(0.8 * F.avg(value).over(w), 0.25 * F.max(value).over(w))
    return bins.withColumn("_least", F.round(least, 6)).filter(F.col(value) >= F.col("_least")).groupBy(*keys).agg(F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin"))
