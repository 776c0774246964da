"""Spectra of long signals: samples as rows, shards of frames with the samples that their last frames reach into."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.series import neighbours, ranged
from chronoloom.sources.store import written


def _framed(samples: DataFrame, keys: Sequence[str], value: str, width: int, hop: int, shard: int, lead: int, give: Callable[[np.ndarray, bool], pa.Array], kind: str, into: str) -> DataFrame:
    """keys, frame, ``into``: what ``give`` makes of the magnitudes of a shard's frames, of which the first ``lead`` (of the shard before) are only to be looked at."""
    span = shard * hop  # from one shard's first sample to the next one's
    held = samples.select(F.struct(*keys).alias("_k"), F.col("i").cast("long").alias("_i"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("_v")).filter("_i >= 0")
    ends = held.groupBy("_k").agg((1 + F.floor((F.greatest(F.max("_i") + 1, F.lit(width)) - width) / hop)).cast("long").alias("_frames"))
    first, last = F.greatest(F.floor((F.col("_i") - width + hop) / span), F.lit(0)), F.floor((F.col("_i") + lead * hop) / span)
    spread = held.withColumn("_s", F.explode(F.sequence(first, last)))
    # every shard is there, also one without samples
    there = ends.select("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_frames") - 1) / shard))).alias("_s"), F.lit(None).cast("long").alias("_i"), F.lit(0.0).alias("_v"))
    rows = spread.unionByName(there).join(ends, "_k").filter(F.col("_s") * shard < F.col("_frames"))
    window = np.hanning(width)

    def run(part: pa.Table) -> pa.Table:
        s, frames = part.column("_s")[0].as_py(), part.column("_frames")[0].as_py()
        part = part.filter(part.column("_i").is_valid())
        y = np.zeros(lead * hop + (shard - 1) * hop + width)
        y[part.column("_i").to_numpy() - (s * span - lead * hop)] = part.column("_v").to_numpy()
        before = 0 if s == 0 else lead  # nothing lies before the first frame
        own = min(shard, frames - s * shard)
        place = np.arange(width)[None, :] + hop * np.arange(lead - before, lead + own)[:, None]
        magnitude = np.abs(np.fft.rfft(y[place] * window, axis=1))
        return pa.table({"_s": pa.array([s] * own, pa.int64()), "frame": pa.array(np.arange(own) + s * shard, pa.int64()), into: give(magnitude, before > 0)})

    types = dict(rows.dtypes)

    def keyed(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        out = run(part)
        return out.append_column("_k", pa.array([key[0].as_py()] * len(out), key[0].type)).select(["_k", "frame", into])

    found = rows.groupBy("_k", "_s").applyInArrow(keyed, f"_k {types['_k']}, frame long, `{into}` {kind}")
    return found.select("_k.*", "frame", into)


def long_spectrum(samples: DataFrame, keys: Sequence[str], value: str, width: int = 1024, hop: int = 512, shard: int = 256) -> DataFrame:
    """keys, frame, magnitude: spectra of frames of ``width`` samples, every ``hop``, under a Hann window, of signals of any length.

    Rows are samples, distinct by keys and ``i`` (from 0; negative ones are left
    out).  A signal ends at its largest ``i``; missing and null samples are 0; a
    short signal is padded to one frame, a tail of less than a frame is left out.
    A task has the samples of ``shard`` frames, and only those within ``width`` -
    ``hop`` of the next shard are sent twice.  Null keys are a key.
    """
    return _framed(samples, keys, value, width, hop, shard, 0, lambda m, _: pa.array(m.tolist(), pa.list_(pa.float64())), "array<double>", "magnitude")


def flux(samples: DataFrame, keys: Sequence[str], value: str, width: int = 1024, hop: int = 512, shard: int = 256) -> DataFrame:
    """keys, frame, flux: the sum of what magnitudes gain from one frame to the next, 0 for a signal's first; as ``long_spectrum``, without sending spectra anywhere."""

    def gains(m: np.ndarray, led: bool) -> pa.Array:
        up = np.maximum(np.diff(m, axis=0), 0).sum(axis=1)
        return pa.array(up if led else np.concatenate([[0.0], up]))

    return _framed(samples, keys, value, width, hop, shard, 1, gains, "double", "flux")


def onsets(samples: DataFrame, keys: Sequence[str], value: str, width: int = 1024, hop: int = 512, shard: int = 256) -> DataFrame:
    """keys, i (the frame), onset: flux (6 decimals) as a share of the signal's largest, smoothed by 0.25, 0.5 and 0.25; nothing lies beyond the ends."""
    f = written(flux(samples, keys, value, width, hop, shard).withColumn("flux", F.round("flux", 6)), "flux")
    packed = f.select(F.struct(*keys).alias("_k"), "frame", "flux")
    most = packed.groupBy("_k").agg(F.max("flux").alias("_most"))
    around = neighbours(ranged(packed, ["_k"], "frame"), ["_k"], "frame", before=["flux"], after=["flux"]).join(most, "_k")
    side = lambda name: F.coalesce(F.col(f"{name}.flux"), F.lit(0.0))
    total = side("_before") / 4 + F.col("flux") / 2 + side("_after") / 4
    return around.select("_k.*", F.col("frame").alias("i"), F.when(F.col("_most") == 0, 0.0).otherwise(F.round(total / F.col("_most"), 6)).alias("onset"))
