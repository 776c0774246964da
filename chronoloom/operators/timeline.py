"""Frame-level evaluation of a timeline, and captions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.exprs import duck_volume


def layers(plan: DataFrame) -> DataFrame:
    """``plan`` (track_start, duration, transition, frames) with lead, from_frame and total: overlapping transitions start early."""
    lead = F.when(F.col("transition").isin("fade", "swell"), F.least("frames", "track_start")).otherwise(F.lit(0))
    return plan.withColumn("lead", lead).withColumns({"from_frame": F.col("track_start") - F.col("lead"), "total": F.col("duration") + F.col("lead")})


def at_frames(frames: DataFrame, spans: DataFrame, keys: Sequence[str], start: str, length: Column, width: int, frame: str = "frame") -> DataFrame:
    """Frames beside every span that is active then, by key and bins of ``width`` frames."""
    s = spans.withColumn("_end", F.col(start) + length).filter(F.col("_end") > F.col(start))
    binned = s.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col("_end") - 1) / width))))
    f = frames.withColumn("_bin", F.floor(F.col(frame) / width))
    return f.join(binned, [*keys, "_bin"]).filter((F.col(frame) >= F.col(start)) & (F.col(frame) < F.col("_end"))).drop("_bin", "_end")


def topmost(active: DataFrame, keys: Sequence[str], frame: str = "frame", pos: str = "pos") -> DataFrame:
    """keys, frame, pos, n_layers: later clips paint over earlier ones."""
    return active.groupBy(*keys, frame).agg(F.max(pos).alias(pos), F.count("*").alias("n_layers"))


def change_points(spans: DataFrame, keys: Sequence[str], start: str, length: Column, frame: str = "frame") -> DataFrame:
    """keys, frame: where a span begins or ends; between two of them nothing changes, so these frames stand for all."""
    return spans.select(*keys, F.explode(F.array(F.col(start), F.col(start) + length)).alias(frame)).withColumn(frame, F.col(frame).cast("int")).filter(F.col(frame) >= 0).distinct()


def ramp_frames(ducks: DataFrame, keys: Sequence[str], ramp: int = 9, frame: str = "frame") -> DataFrame:
    """keys, frame: every frame of each duck's two ramps; elsewhere the curve is flat."""
    down, up = F.sequence(F.col("start") - ramp, F.col("start")), F.sequence(F.col("start") + F.col("dur"), F.col("start") + F.col("dur") + ramp)
    return ducks.select(*keys, F.explode(F.concat(down, up)).alias(frame)).withColumn(frame, F.col(frame).cast("int")).filter(F.col(frame) >= 0).distinct()


def ducked(frames: DataFrame, ducks: DataFrame, keys: Sequence[str], base: float, width: int, ramp: int = 9) -> DataFrame:
    """keys, frame, volume: the least over all ducks, ``base`` where none reaches."""
    wide = ducks.withColumn("_start", F.col("start") - ramp)
    near = at_frames(frames, wide, keys, "_start", F.col("dur") + 2 * ramp + 1, width)
    low = near.groupBy(*keys, "frame").agg(F.min(duck_volume(F.col("frame"), F.col("start"), F.col("dur"), F.col("to"), F.lit(base), ramp)).alias("_v"))
    return frames.join(low, [*keys, "frame"], "left").withColumn("volume", F.round(F.coalesce("_v", F.lit(base)), 6)).drop("_v")


def clipped_captions(captions: DataFrame, total: Column) -> DataFrame:
    """Captions that start before the end, cut there."""
    return captions.filter(F.col("start") < total).withColumn("dur", F.least("dur", total - F.col("start"))).filter("dur > 0")


def chunks(totals: DataFrame, keys: Sequence[str], total: str, size: int) -> DataFrame:
    """keys, first, last: frames in chunks of ``size``."""
    rows = totals.filter(F.col(total) > 0).withColumn("first", F.explode(F.sequence(F.lit(0), F.col(total) - 1, F.lit(size))))
    return rows.select(*keys, "first", F.least(F.col("first") + size - 1, F.col(total) - 1).alias("last"))


def draft_times(clips: DataFrame, drops: DataFrame, keys: Sequence[str], fps: int, most: int = 24) -> DataFrame:
    """keys, i, t: times of a draft to look at: distinct starts of cuts and drops in order, of more than ``most`` every so many.

    ``clips`` has track_start in frames, ``drops`` t in seconds.
    """
    starts = clips.select(*keys, F.bround(F.col("track_start") / fps, 2).alias("t"))
    times = starts.unionByName(drops.select(*keys, F.bround("t", 2).alias("t"))).filter("t is not null").distinct()
    w = Window.partitionBy(*keys)
    numbered = times.withColumns({"_k": F.row_number().over(w.orderBy("t")) - 1, "_n": F.count("*").over(w)})
    # the element at floor(i * n / most) for some i below most, or any if there are no more than that
    i = F.expr(f"CASE WHEN _n <= {most} THEN _k ELSE (_k * {most} + _n - 1) DIV _n END")
    picked = numbered.withColumn("i", i.cast("int")).filter(f"_n <= {most} OR (i < {most} AND (i * _n) DIV {most} = _k)")
    return picked.select(*keys, "i", "t")
