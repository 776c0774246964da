"""Walks along series: each row names the row that follows it, and a walk visits those that follow from the first.

Series are spread over ranges of their order.  Within a range pointers are
doubled in numpy; between ranges only the rows at which walks enter a range are
left, and their pointers are doubled by joins, in about log2(ranges of the
longest series) rounds.  Neither a series nor a walk ever comes together in one
row, task or array.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.series import ranged
from chronoloom.sources.store import written


def followers(rows: DataFrame, keys: Sequence[str], at: str, beyond: Column, into: str = "next") -> DataFrame:
    """keys, at, ``into``: the first ``at`` of the same series above ``beyond``, null where there is none.

    Rows are distinct by keys and ``at``; rows whose ``at`` or ``beyond`` is null
    are left out.  Rows and what they ask for are laid out in one order, in which
    the last row seen from behind answers; ranges pass on their first row only.
    """
    held = rows.select(F.struct(*keys).alias("_k"), F.col(at).alias("_of"), beyond.alias("_p")).filter("_of is not null and _p is not null")
    marks = held.select("_k", F.col("_of").alias("_p"), F.col("_of").alias("_mark"), F.lit(None).cast(dict(held.dtypes)["_of"]).alias("_of"))
    line = ranged(marks.unionByName(held.withColumn("_mark", F.lit(None).cast(dict(held.dtypes)["_of"]))), ["_k"], "_p")
    # from the end; at equal places questions come before rows, as only later rows answer
    back = Window.partitionBy("_k", "_range").orderBy(F.desc("_p"), F.col("_mark").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("_k").orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    beyond_range = line.groupBy("_k", "_range").agg(F.min("_mark").alias("_first")).select("_k", "_range", F.min("_first").over(later).alias("_later"))
    asked = line.withColumn("_near", F.last("_mark", ignorenulls=True).over(back)).filter("_of is not null").join(beyond_range, ["_k", "_range"])
    return asked.select("_k.*", F.col("_of").alias(at), F.coalesce("_near", "_later").alias(into))


def _places(part: pa.Table, at: str, following: str) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """A range's rows in order, their ``at``, and each one's follower as a row number; the number of rows where it lies in no row of the range, also for that number itself."""
    part = part.sort_by(at).combine_chunks()
    x, to = part.column(at).to_numpy(), part.column(following)
    n = len(x)
    there = to.is_valid().to_numpy()
    y = pc.fill_null(to, pa.scalar(0, to.type)).to_numpy()
    place = np.searchsorted(x, y)
    good = there & (place < n)
    good[good] = x[place[good]] == y[good]
    return part, x, np.append(np.where(good, place, n), n)


def chained(rows: DataFrame, keys: Sequence[str], at: str, following: str, into: str = "step") -> DataFrame:
    """The rows of each series that are reached from its first one along ``following``, numbered from 0 in ``into``.

    ``at`` and ``following`` are numbers of one type; rows are distinct by keys
    and ``at``, those with a null ``at`` are left out.  A walk ends at a row whose
    follower is null, is no row, or doesn't lie after it.  Null keys are a key.
    Other columns are kept; names that begin with an underscore are taken.
    """
    kind = dict(rows.dtypes)[at]
    held = ranged(rows.filter(F.col(at).isNotNull()).withColumns({"_k": F.struct(*keys), "_to": F.when(F.col(following) > F.col(at), F.col(following)).cast(kind)}), ["_k"], at)

    def leave(part: pa.Table) -> pa.Table:
        part, x, f = _places(part, at, "_to")
        n = len(x)
        hops, last = np.append(np.ones(n, np.int64), 0), np.arange(n + 1)
        while (f < n).any():
            last, hops, f = np.where(f < n, last[f], last), hops + hops[f], f[f]
        out = part.select(["_k", "_range", at])
        return out.append_column("_leaves", part.column("_to").take(pa.array(last[:n]))).append_column("_hops", pa.array(hops[:n]))

    spot = held.select("_k", "_range", at, "_to")
    types = dict(held.dtypes)
    out = written(spot.groupBy("_k", "_range").applyInArrow(leave, f"_k {types['_k']}, _range int, `{at}` {kind}, _leaves {kind}, _hops long"), "leaves")
    # where walks can enter a range: a series' first row, and what another range's rows leave for
    heads = out.groupBy("_k").agg(F.min(at).alias(at)).withColumn("_head", F.lit(True))
    targets = out.filter("_leaves is not null").select("_k", F.col("_leaves").alias(at)).distinct().withColumn("_head", F.lit(False))
    wanted = heads.unionByName(targets).groupBy("_k", at).agg(F.bool_or("_head").alias("_head"))
    entries = written(out.join(wanted, ["_k", at]), "entries")
    reached, jump = entries.filter("_head").select("_k", at), entries.select("_k", at, "_leaves")
    while not jump.filter("_leaves is not null").isEmpty():
        onto = reached.join(jump, ["_k", at]).filter("_leaves is not null").select("_k", F.col("_leaves").alias(at))
        reached = written(reached.unionByName(onto).distinct(), "reached")
        far = jump.select("_k", F.col(at).alias("_leaves"), F.col("_leaves").alias("_far"))
        jump = written(jump.filter("_leaves is not null").join(far, ["_k", "_leaves"]).select("_k", at, F.col("_far").alias("_leaves")), "jumps")
    # a walk enters a range once
    before = Window.partitionBy("_k").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = entries.join(reached, ["_k", at]).select("_k", "_range", F.col(at).alias("_start"), F.coalesce(F.sum("_hops").over(before), F.lit(0)).alias("_offset"))

    names = rows.columns

    def visit(part: pa.Table) -> pa.Table:
        part, x, f = _places(part, at, "_to")
        n = len(x)
        seen = np.zeros(n + 1, bool)
        seen[np.searchsorted(x, part.column("_start")[0].as_py())] = True
        while (f < n).any():
            seen[f[seen]] = True
            f = f[f]
        rows_ = np.flatnonzero(seen[:n])
        step = part.column("_offset")[0].as_py() + np.arange(len(rows_))
        return part.select(names).take(pa.array(rows_)).append_column(into, pa.array(step.astype(np.int64)))

    schema = ", ".join(f"`{c}` {types[c]}" for c in names)
    entered = held.join(starts, ["_k", "_range"])
    return entered.groupBy("_k", "_range").applyInArrow(visit, f"{schema}, `{into}` long").select(*names, into)


def greedy_gap(times: DataFrame, keys: Sequence[str], gap: float, t: str = "i") -> DataFrame:
    """Times kept in ascending order if more than ``gap`` (0 or more) after the last kept one: keys, t (double).  Equal times are one."""
    marks = written(times.select(*keys, F.col(t).cast("double").alias(t)).distinct(), "times")  # laying out in ranges reads its input twice
    return chained(followers(marks, keys, t, F.col(t) + float(gap)), keys, t, "next").select(*keys, t)
