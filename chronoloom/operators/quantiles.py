"""Exact quantiles by distributed selection: count by bins, narrow to the bin that holds the order statistic, repeat."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.sources.store import written


def _bin(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """The bin of ``v`` in [lo, hi], from 0 to bins - 1.  Rounding keeps the order of values, so bins are ranges of them; halves avoid overflow."""
    return F.when(v == lo, 0).when(v == hi, bins - 1).otherwise(F.least(F.floor((v / 2 - lo / 2) / (hi / 2 - lo / 2) * bins), F.lit(bins - 1)).cast("int"))


def quantiles(rows: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[str, float]], bins: int = 1024) -> DataFrame:
    """keys and, for each name in ``wanted``, the linearly interpolated quantile of a column (as ``percentile`` gives it), in double precision.

    A quantile lies between two order statistics at most.  Each round counts the
    values of a statistic's interval in ``bins`` bins of equal width and goes on
    with the least and largest value of the bin that holds it, until these are
    one; so a state has at most ``bins`` entries a statistic, whatever the number
    of distinct values, and only bins are shuffled.  Values spread over many
    magnitudes take more rounds; every round parts the least value of an interval
    from the largest, so rounds end.  ``rows`` is read once a round.

    Nulls and NaN are left out; a key without values has null quantiles.  No keys
    give one row.  Infinite values are not taken: they raise an error.
    """
    columns = sorted({c for c, _ in wanted.values()})
    one = F.struct(*[F.col(k) for k in keys] or [F.lit(0)])
    long = rows.select(one.alias("_k"), F.explode(F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_v")) for c in columns])).alias("_s")).select("_k", "_s.*")
    long = long.withColumn("_v", F.when(F.isnan("_v"), None).otherwise(F.when(F.abs("_v") == float("inf"), F.raise_error(F.lit("infinite value"))).otherwise(F.col("_v"))))
    ends = written(long.groupBy("_k", "_c").agg(F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")), "ends")
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("_name"), F.lit(c).alias("_of"), F.lit(float(q)).alias("_q")) for name, (c, q) in wanted.items()]))
    asked = ends.filter("_n > 0").withColumn("_a", asked).filter("_a._of = _c").select("_k", "_c", "_n", "_lo", "_hi", "_a._name", (F.col("_a._q") * (F.col("_n") - 1)).alias("_at"))
    # statistics of equal rank are sought once
    ranks = F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at"))))
    state = written(asked.withColumn("_rank", ranks).select("_k", "_c", "_rank", F.col("_rank").alias("_left"), "_lo", "_hi").distinct(), "ranks")
    place = ["_k", "_c", "_rank"]
    through = Window.partitionBy(*place).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    while not state.filter("_lo < _hi").isEmpty():
        open_ = state.filter("_lo < _hi")
        inside = long.join(open_, ["_k", "_c"]).filter("_v >= _lo and _v <= _hi")
        counted = inside.groupBy(*place, "_left", _bin(F.col("_v"), F.col("_lo"), F.col("_hi"), bins).alias("_bin")).agg(F.count("*").alias("_m"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        upto = counted.withColumn("_upto", F.sum("_m").over(through))
        narrowed = upto.filter("_left < _upto and _left >= _upto - _m").select(*place, (F.col("_left") - F.col("_upto") + F.col("_m")).alias("_left"), "_lo", "_hi")
        state = written(narrowed.unionByName(state.filter("_lo = _hi")), "ranks")
    low, high = (state.select("_k", "_c", F.col("_rank").alias(f"_r{n}"), F.col("_lo").alias(n)) for n in ("_low", "_high"))
    placed = asked.withColumns({"_r_low": F.floor("_at"), "_r_high": F.ceil("_at")}).join(low, ["_k", "_c", "_r_low"]).join(high, ["_k", "_c", "_r_high"])
    value = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise((F.col("_r_high") - F.col("_at")) * F.col("_low") + (F.col("_at") - F.col("_r_low")) * F.col("_high"))
    pick = [F.max(F.when(F.col("_name") == name, F.col("_value"))).alias(name) for name in wanted]
    found = placed.withColumn("_value", value).groupBy("_k").agg(*pick)
    every = ends.select("_k").distinct()
    if not keys:  # also of no rows
        every = rows.sparkSession.range(1).select(F.struct(F.lit(0)).alias("_k"))
    out = every.join(found, "_k", "left")
    return out.select(*([F.col(f"_k.{k}").alias(k) for k in keys]), *wanted)
