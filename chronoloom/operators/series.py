"""Operators on time series: every one works by series key, so series spread over the cluster.

A series is rows of (keys..., i, value) with i counting from 0.  Raw samples
are aggregated to such rows first, with partial sums before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.exprs import EPS, level
from chronoloom.sources.store import written


def by(keys: Sequence[str], order: str | Column = "i"):
    return Window.partitionBy(*keys).orderBy(order)


def block_rms(samples: DataFrame, keys: Sequence[str], index: Column, value: str) -> DataFrame:
    """Root mean square by block: keys, i, e (6 decimals)."""
    return samples.groupBy(*keys, index.alias("i")).agg(F.round(F.sqrt(F.avg(F.col(value) * F.col(value)) + EPS), 6).alias("e"))


def on_spine(series: DataFrame, keys: Sequence[str], value: str = "e") -> DataFrame:
    """Every i from the first (0 at most) to the last of each series, with 0 where there was no row."""
    ends = series.groupBy(*keys).agg(F.least(F.lit(0), F.min("i")).alias("_lo"), F.max("i").alias("_hi"))
    spine = ends.select(*keys, F.explode(F.sequence("_lo", "_hi")).alias("i"))
    return spine.join(series, [*keys, "i"], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def grid(series: DataFrame, keys: Sequence[str], step: int, into: str = "beat") -> DataFrame:
    """Multiples of ``step`` within each series' extent, with the extent's ends (lo, hi)."""
    ends = series.groupBy(*keys).agg(F.min("i").alias("lo"), F.max("i").alias("hi"))
    first = F.ceil(F.col("lo") / step).cast("int") * step
    return ends.filter(first <= F.col("hi")).withColumn(into, F.explode(F.sequence(first, F.col("hi"), F.lit(step))))


def ranged(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """``rows`` in ranges of (keys, order), written, each row with its range's number ``_range``; a long series is spread over many."""
    return written(rows.repartitionByRange(*keys, order).withColumn("_range", F.spark_partition_id()), "ranges")


def neighbours(held: DataFrame, keys: Sequence[str], order: str, before: Sequence[str] = (), after: Sequence[str] = ()) -> DataFrame:
    """``held`` (from ``ranged``) with structs ``_before`` and ``_after``: the named columns of the row before and after in the series, null at its ends.

    A window sees one series' rows of one range; across ranges only the rows
    at their ends are carried over, one a series and range, so no series' rows
    come together in a task, however long it is.
    """
    within = Window.partitionBy(*keys, "_range").orderBy(order)
    across = Window.partitionBy(*keys).orderBy("_range")
    out = held
    for into, names, step, edge in (("_before", before, F.lag, F.max_by), ("_after", after, F.lead, F.min_by)):
        if not names:
            continue
        item = F.struct(*names)
        carried = held.groupBy(*keys, "_range").agg(edge(item, order).alias("_edge")).withColumn("_edge", step("_edge").over(across)).filter("_edge is not null")
        carried = carried.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, "_range"])], "_edge")
        out = out.withColumn(into, step(item).over(within))
        # only the row at the range's end looks across
        same = F.lit(True)
        for i, k in enumerate([*keys, "_range"]):
            same = same & out[k].eqNullSafe(carried[f"_k{i}"])
        out = out.join(carried, same & out[into].isNull(), "left").withColumn(into, F.coalesce(into, "_edge")).drop("_edge", *[f"_k{i}" for i in range(len(keys) + 1)])
    return out


def box_smooth(series: DataFrame, keys: Sequence[str], k: int, value: str = "e", into: str = "s") -> DataFrame:
    """Moving average of width ``k`` with zeros beyond the ends (an even width reaches one further back)."""
    w = by(keys).rowsBetween(-(k // 2), (k - 1) // 2)
    return series.withColumn(into, F.round(F.sum(value).over(w) / k, 6))


def with_quantiles(series: DataFrame, keys: Sequence[str], value: str, **quantiles: float) -> DataFrame:
    """Exact, linearly interpolated quantiles of each series beside its rows."""
    q = series.groupBy(*keys).agg(*[F.round(F.percentile(value, F.lit(p)), 6).alias(name) for name, p in quantiles.items()])
    return series.join(q, list(keys))


def islands(series: DataFrame, keys: Sequence[str], starts: Column, into: str = "island", order: str = "i") -> DataFrame:
    """Numbers runs of rows: a row for which ``starts`` holds (or the first) begins a new one."""
    w = by(keys, order)
    flag = F.when(F.lag(F.lit(1)).over(w).isNull() | F.coalesce(starts, F.lit(True)), 1).otherwise(0)
    return series.withColumn("_new", flag).withColumn(into, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int") - 1).drop("_new")


def sections(series: DataFrame, keys: Sequence[str], lo: float = 0.40, hi: float = 0.72, value: str = "s") -> DataFrame:
    """Runs of one level: keys, island, start_i, end_i (the next one's start, or the last sample), level, energy."""
    graded = with_quantiles(series, keys, value, q_lo=lo, q_hi=hi).withColumn("level", level(F.col(value), F.col("q_lo"), F.col("q_hi")))
    w = by(keys)
    graded = graded.withColumn("_before", F.lag("level").over(w))
    runs = islands(graded, keys, F.col("_before") != F.col("level"))
    found = runs.groupBy(*keys, "island").agg(F.min("i").alias("start_i"), F.max("i").alias("last_i"), F.first("level").alias("level"), F.round(F.avg(value), 4).alias("energy"))
    end = F.coalesce(F.lead("start_i").over(by(keys, "start_i")), F.col("last_i"))
    return found.withColumn("end_i", end).drop("last_i")


def merge_short(spans: DataFrame, keys: Sequence[str], least: float, start: str = "start_i", end: str = "end_i") -> DataFrame:
    """A span shorter than ``least`` joins the one before (the first stays); level and energy stay the first one's."""
    runs = islands(spans, keys, F.col(end) - F.col(start) >= least, "_run", start)
    return runs.groupBy(*keys, "_run").agg(F.min(start).alias(start), F.max(end).alias(end), F.min_by("level", start).alias("level"), F.min_by("energy", start).alias("energy")).withColumnRenamed("_run", "section")


def jumps(series: DataFrame, keys: Sequence[str], width: int, rise: float, q: float = 0.66, value: str = "s") -> DataFrame:
    """Samples where the mean of the next ``width`` exceeds the previous ones' by more than ``rise`` and the quantile ``q``: keys, i.

    Values are taken to six places, as integers: means of twelve lie on a tie of
    the sixth place for one in twelve, and are rounded half up.
    """
    w = by(keys)
    whole = Window.partitionBy(*keys)

    def mean(frame):
        total, n = F.sum("_m").over(frame), F.count("_m").over(frame)
        return F.floor((2 * total + n) / F.nullif(2 * n, F.lit(0))) / 1000000

    marked = with_quantiles(series, keys, value, q_hi=q).withColumn("_m", F.round(F.col(value) * 1000000).try_cast("long")).withColumns(
        {"before": mean(w.rowsBetween(-width, -1)), "after": mean(w.rowsBetween(0, width - 1)), "lo": F.min("i").over(whole), "hi": F.max("i").over(whole)}
    )
    return marked.filter((F.col("i") >= F.col("lo") + width) & (F.col("i") <= F.col("hi") - width) & (F.round(F.col("after") - F.col("before"), 6) > rise) & (F.col("after") > F.col("q_hi"))).select(*keys, "i")


def greedy_gap_by_score(rows: DataFrame, keys: Sequence[str], gap: float, most: int, t: str = "t", score: str = "score") -> DataFrame:
    """In descending score (then ascending time) rows at least ``gap`` from all chosen ones, up to ``most``: keys, t."""
    item = F.struct((-F.col(score)).alias("s"), F.col(t).cast("double").alias("t"))
    kept = F.aggregate(
        F.array_sort(F.collect_list(item)),
        F.array().cast("array<double>"),
        lambda acc, x: F.when((F.size(acc) < most) & ~F.exists(acc, lambda c: F.abs(c - x["t"]) < gap), F.concat(acc, F.array(x["t"]))).otherwise(acc),
    )
    return rows.groupBy(*keys).agg(kept.alias("_kept")).select(*keys, F.explode("_kept").alias(t))


def rank_below(series: DataFrame, keys: Sequence[str], value: str, into: str = "rel") -> DataFrame:
    """Share of a series' values that are strictly smaller."""
    w = Window.partitionBy(*keys)
    return series.withColumn(into, F.round((F.rank().over(w.orderBy(value)) - 1) / F.count("*").over(w), 6))


def local_maxima(series: DataFrame, keys: Sequence[str], most: int = 6, value: str = "e") -> DataFrame:
    """Inner samples not below either neighbour and above the mean; the ``most`` highest, later first on ties: keys, rank, i, value."""
    w = by(keys)
    marked = series.withColumns({"_p": F.lag(value).over(w), "_n": F.lead(value).over(w), "_m": F.avg(value).over(Window.partitionBy(*keys))})
    peaks = marked.filter((F.col(value) >= F.col("_p")) & (F.col(value) >= F.col("_n")) & (F.col(value) > F.col("_m")))
    ranked = peaks.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), F.desc("i"))))
    return ranked.filter(F.col("rank") <= most).select(*keys, "rank", "i", value)


def autocorrelation(series: DataFrame, keys: Sequence[str], lags: range, value: str = "e") -> DataFrame:
    """Sum of products of mean-centred values ``lag`` apart: keys, lag, r.  Lags are few, so each row is sent once a lag."""
    centred = series.withColumn("_c", F.col(value) - F.avg(value).over(Window.partitionBy(*keys)))
    late = centred.withColumn("lag", F.explode(F.sequence(F.lit(lags.start), F.lit(lags.stop - 1)))).select(*keys, "lag", (F.col("i") - F.col("lag")).alias("i"), F.col("_c").alias("_d"))
    return centred.join(late, [*keys, "i"]).groupBy(*keys, "lag").agg(F.round(F.sum(F.col("_c") * F.col("_d")), 4).alias("r"))


def best_period(correlation: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The lag with the largest correlation, the least on ties: keys, lag, r."""
    return correlation.groupBy(*keys).agg(F.max_by("lag", F.struct("r", -F.col("lag"))).alias("lag"), F.max("r").alias("r"))


def phase_scores(series: DataFrame, keys: Sequence[str], period: int, value: str = "e") -> DataFrame:
    """Sum of the values on each of the ``period`` possible grids: keys, phase, score."""
    return series.groupBy(*keys, F.pmod("i", F.lit(period)).alias("phase")).agg(F.round(F.sum(value), 4).alias("score"))


def snapped(series: DataFrame, grid: DataFrame, keys: Sequence[str], window: int, value: str = "e") -> DataFrame:
    """Each grid index moved to the largest value within ``window`` (first on ties): keys, beat, i."""
    near = grid.withColumn("i", F.explode(F.sequence(F.col("beat") - window, F.col("beat") + window)))
    return near.join(series, [*keys, "i"]).groupBy(*keys, "beat").agg(F.max_by("i", F.struct(value, -F.col("i"))).alias("snapped"))


def buildups(series: DataFrame, drops: DataFrame, keys: Sequence[str], width: int, rise: float = 0.1, value: str = "s", t: str = "i") -> DataFrame:
    """Windows of ``width`` samples before a drop over which the value rises: keys, drop_i, start_i, end_i."""
    first_i = series.groupBy(*keys).agg(F.min("i").alias("_lo"))
    d = drops.select(*keys, F.col(t).cast("int").alias("drop_i")).join(first_i, list(keys)).withColumns({"start_i": F.greatest(F.col("_lo"), F.col("drop_i") - width), "end_i": F.col("drop_i") - 1})
    d = d.filter(F.col("end_i") - F.col("start_i") >= 1)
    first, last = (series.select(*keys, F.col("i").alias(name), F.col(value).alias(v)) for name, v in (("start_i", "_first"), ("end_i", "_last")))
    return d.join(first, [*keys, "start_i"]).join(last, [*keys, "end_i"]).filter(F.round(F.col("_last") - F.col("_first"), 6) > rise).select(*keys, "drop_i", "start_i", "end_i")


def at_grid(points: DataFrame, series: DataFrame, keys: Sequence[str], t: str, hz: float, value: str = "e") -> DataFrame:
    """The sample at or before each time on a uniform grid, the series' last one (``hi`` of the point) beyond its end: an equality join."""
    index = F.greatest(F.col("lo"), F.least(F.floor(F.col(t) * hz).cast("int"), F.col("hi")))
    return points.withColumn("i", index).join(series.select(*keys, "i", value), [*keys, "i"])


def long_runs(rows: DataFrame, keys: Sequence[str], order: str, flag: Column, least: int) -> DataFrame:
    """Rows at least the ``least``-th of an unbroken run for which ``flag`` holds."""
    w = by(keys, order)
    marked = rows.withColumn("_f", F.coalesce(flag, F.lit(False)))
    runs = islands(marked.withColumn("_b", F.lag("_f").over(w)), keys, F.col("_b") != F.col("_f"), "_run", order)
    return runs.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_run").orderBy(order))).filter(F.col("_f") & (F.col("_n") >= least)).drop("_f", "_b", "_run", "_n")


def spectrum(signal: DataFrame, keys: Sequence[str], value: str, width: int = 1024, hop: int = 512) -> DataFrame:
    """keys, frame, magnitude: spectra of frames of ``width`` samples, every ``hop``, under a Hann window.

    ``value`` is an array of samples, one row a piece of signal; a short one is
    padded with zeros to one frame, a tail of less than a frame is left out.
    """

    def run(batches):
        window = np.hanning(width)
        for batch in batches:
            names = batch.schema.names[:-2]
            samples = [np.asarray(x, dtype=float) for x in batch.column(len(names)).to_pylist()]
            at, frame, out = [], [], []
            for k, y in enumerate(samples):
                y = np.pad(y, (0, max(0, width - len(y))))
                n = 1 + (len(y) - width) // hop
                place = np.arange(width)[None, :] + hop * np.arange(n)[:, None]
                at += [k] * n
                frame += range(n)
                out += list(np.abs(np.fft.rfft(y[place] * window, axis=1)))
            kept = [batch.column(i).take(pa.array(at, pa.int64())) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(frame, pa.int32()), pa.array([m.tolist() for m in out], pa.list_(pa.float64()))], names=[*names, "frame", "magnitude"])

    rows = signal.filter(F.col(value).isNotNull()).select(*keys, F.transform(value, lambda x: F.coalesce(x.cast("double"), F.lit(0.0))).alias("samples"), F.lit(0).alias("unused"))
    schema = ", ".join(f"`{k}` {dict(signal.dtypes)[k]}" for k in keys)
    return rows.mapInArrow(run, f"{schema}, frame int, magnitude array<double>")
