"""Rules that audit a timeline, its score, and one pass of revision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.exprs import cosine, penalty
from chronoloom.operators.intervals import containing
from chronoloom.operators.series import long_runs

#: Cosine of two clips' colours from which they look the same.
ALIKE = 0.92
#: Keys over which the plans that look at one rank are spread.
SPREAD = 64


#: Columns of a finding beside the keys.  pos is null where it is about the whole plan; clip_id names footage to bring in.
FINDING = "pos int, type string, severity int, rule int, t double, frame int, action string, prefer string, match_intensity double, to_frames int, clip_id long"


def issues(plan: DataFrame, drops: DataFrame, strong: DataFrame, keys: Sequence[str], fps: int = 30) -> DataFrame:
    """keys and FINDING: what eight rules find in plans.

    ``plan`` has pos, clip_id, known (the clip is in the library), cluster,
    colour, impact, intensity, track_start and duration (frames), e, q_hi, rel
    and is_drop; ``drops`` has frame; ``strong`` has rank (from 0) and clip_id
    of the library's clips of high impact, in its order.

    Rules on a slot and the one before it share one window and one explode.
    Drops meet slots through bins of frames.  A plan that uses u strong clips
    leaves three of the first u + 3 unused, so it meets these, not the library.
    ``rule`` and ``pos`` order findings of equal severity and time.
    """
    w = Window.partitionBy(*keys).orderBy("pos")
    frame, none = F.col("track_start"), F.lit(None)

    def finding(kind, severity, rule, action, prefer=none, match=none, to=none, at=frame):
        values = {"type": F.lit(kind), "severity": F.lit(severity), "rule": F.lit(rule), "t": F.round(at / float(fps), 2), "frame": at, "action": F.lit(action), "prefer": prefer, "match_intensity": match, "to_frames": to, "clip_id": none}
        kinds = dict(c.split() for c in FINDING.split(", "))
        return F.struct(*[v.cast(kinds[n]).alias(n) for n, v in values.items()])

    loud = F.col("e") >= F.col("q_hi")
    same = F.lag("cluster").over(w) == F.col("cluster")
    alike = F.round(cosine(F.lag("colour").over(w), F.col("colour")), 6) > ALIKE
    found = F.array_compact(
        F.array(
            F.when(F.lag("known").over(w) & F.col("known") & (F.coalesce(same, F.lit(False)) | alike), finding("repetition", 2, 1, "replace", match=F.col("intensity"))),
            F.when(loud & (F.col("intensity") < 0.4), finding("weak_in_strong", 3, 2, "replace", F.lit("impact"), F.greatest(F.lit(0.7), F.col("rel")))).when(
                (F.col("rel") < 0.25) & (F.col("intensity") > 0.7), finding("busy_in_calm", 1, 2, "replace", F.lit("calm"), F.col("rel"))
            ),
            F.when(loud & (F.col("duration") > int(1.4 * fps)) & ~F.col("is_drop"), finding("under_editing", 1, 4, "shorten", to=F.lit(int(0.8 * fps)))),
        )
    )
    by_row = plan.withColumn("_f", found).select(*keys, "pos", F.explode("_f").alias("f")).select(*keys, "pos", "f.*")

    slots = plan.select(*keys, "pos", "impact", (frame - 0.15 * fps).alias("_from"), (frame + F.col("duration")).cast("double").alias("_to"))
    hits = containing(drops.select(F.col("frame").alias("_d")).distinct(), slots, [], "_d", 2.0 * fps, (F.col("_from") <= F.col("_d")) & (F.col("_d") <= F.col("_to")), "_from", "_to")
    cover = hits.groupBy(*keys, "_d").agg(F.min_by(F.struct("pos", "impact"), "pos").alias("s")).filter("s.impact < 0.6")
    weak = cover.select(*keys, "s.pos", finding("weak_drop", 3, 3, "replace", F.lit("impact"), F.lit(0.9), at=F.col("_d")).alias("f")).select(*keys, "pos", "f.*")

    fast = long_runs(plan, keys, "pos", (F.col("duration") < int(0.3 * fps)) & ~F.col("is_drop"), 4)
    fast = fast.select(*keys, "pos", finding("over_editing", 1, 5, "lengthen", to=F.lit(int(0.5 * fps))).alias("f")).select(*keys, "pos", "f.*")

    used = plan.select(*keys, "clip_id").distinct().join(strong, "clip_id").select(*keys, "rank")
    whole = plan.groupBy(*keys).agg(F.count_distinct(F.when(F.col("known"), F.coalesce("cluster", F.lit("")))).alias("_c"), F.count_if("known").alias("_n"))
    looked = whole.join(used.groupBy(*keys).agg(F.count("*").alias("_u")), list(keys), "left").withColumn("rank", F.explode(F.sequence(F.lit(0), (F.coalesce("_u", F.lit(0)) + 2).cast("int")))).select(*keys, "rank")
    unused = looked.join(used, [*keys, "rank"], "left_anti").withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("rank"))).filter("_n <= 3").join(strong, "rank")
    start = F.lit(0)
    wasted = unused.select(*keys, finding("wasted_footage", 2, 6, "inject", F.lit("impact"), at=start).dropFields("clip_id").alias("f"), F.col("clip_id").cast("long").alias("clip_id"), "_n")
    wasted = wasted.select(*keys, none.cast("int").alias("pos"), "f.*", "clip_id")
    dull = whole.filter(F.col("_c") / F.greatest(F.lit(1), F.col("_n")) < 0.55).select(*keys, none.cast("int").alias("pos"), finding("low_variety", 2, 7, "diversify", at=start).alias("f")).select(*keys, "pos", "f.*")
    return by_row.unionByName(weak).unionByName(fast).unionByName(wasted).unionByName(dull)


def ordered(keys: Sequence[str]):
    """Worst first, then by time; findings of the same are in the order of rules and slots."""
    return Window.partitionBy(*keys).orderBy(F.desc("severity"), "t", "rule", "pos", "clip_id")


def variety(plan: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n, variety: distinct clusters (null is one) by rows."""
    return plan.groupBy(*keys).agg(F.count("*").alias("n"), F.round((F.count_distinct("cluster") + F.max(F.col("cluster").isNull().cast("int"))) / F.greatest(F.lit(1), F.count("*")), 4).alias("variety"))


def scores(found: DataFrame, plans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, score: 100 less the penalties, 0 at least; a plan without findings has 100."""
    lost = found.groupBy(*keys).agg(F.sum(penalty(F.col("severity"))).alias("_lost"), F.count("*").alias("n_issues"))
    return plans.select(*keys).distinct().join(lost, list(keys), "left").select(*keys, F.coalesce("n_issues", F.lit(0)).alias("n_issues"), F.greatest(F.lit(0), 100 - F.coalesce("_lost", F.lit(0))).cast("int").alias("score"))


def truncated(plan: DataFrame, keys: Sequence[str], cut_at: int) -> DataFrame:
    """Rows that start before ``cut_at`` (the first if none does); the last of them reaches to it."""
    w = Window.partitionBy(*keys)
    kept = plan.withColumn("_first", F.min("track_start").over(w)).filter((F.col("track_start") < cut_at) | (F.col("track_start") == F.col("_first"))).drop("_first")
    last = F.row_number().over(w.orderBy(F.desc("track_start"), F.desc("pos"))) == 1
    return kept.withColumn("duration", F.when(last, F.greatest(F.lit(1), F.lit(cut_at) - F.col("track_start"))).otherwise(F.col("duration")))


def convergence(history: DataFrame, keys: Sequence[str], good: int = 96, gain: int = 2) -> DataFrame:
    """keys, stop_version (the first at ``good``, or that gains less than ``gain``), best_version (the first best up to there)."""
    w = Window.partitionBy(*keys).orderBy("version")
    stops = (F.col("score") >= good) | (F.col("score") - F.lag("score").over(w) < gain)
    marked = history.withColumn("_s", F.coalesce(stops, F.lit(False)))
    marked = marked.withColumn("_stop", F.coalesce(F.min(F.when(F.col("_s"), F.col("version"))).over(Window.partitionBy(*keys)), F.max("version").over(Window.partitionBy(*keys))))
    return marked.filter("version <= _stop").groupBy(*keys).agg(F.max("_stop").alias("stop_version"), F.max_by("version", F.struct("score", -F.col("version"))).alias("best_version"))


def replacements(found: DataFrame, plan: DataFrame, candidates: DataFrame, keys: Sequence[str], most: int = 8) -> DataFrame:
    """One pass of revision: the ``most`` worst findings that ask for another clip, each with the best candidate.

    Candidates are bucketed by intensity into eleven classes beforehand, with
    the best of each cluster, so a finding meets one row a cluster, not the library.
    """
    asked = found.filter(F.col("type").isin("weak_in_strong", "repetition", "busy_in_calm")).select(*keys, "pos", "type", "severity")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("severity"), "pos", "type"))
    first = asked.withColumn("_n", rank).filter(F.col("_n") <= most)
    aim = first.join(plan.select(*keys, "pos", "cluster", "rel"), [*keys, "pos"]).withColumn("slot", F.round(F.when(F.col("type") == "weak_in_strong", F.greatest(F.lit(0.7), F.col("rel"))).otherwise(F.col("rel")) * 10).cast("int"))
    hit = aim.join(candidates, "slot").filter(F.col("cluster") != F.col("clip_cluster"))
    return hit.groupBy(*keys, "pos", "type").agg(F.max_by("clip_id", F.struct("clip_score", -F.col("clip_id"))).alias("clip_id"))


def merged(found: DataFrame, plan: DataFrame, keys: Sequence[str], most: int = 8) -> DataFrame:
    """keys, pos, track_start, duration: slots found too short take in the slot after them, ``most`` of them in order.

    A slot that was taken in is gone, its own finding with it: of a run of
    found slots every other one acts.  The last slot has nothing to take in.
    """
    w = Window.partitionBy(*keys).orderBy("pos")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    asked = found.filter(F.col("type") == "over_editing").select(*keys, "pos").distinct().withColumn("_f", F.lit(True))
    rows = plan.select(*keys, "pos", "track_start", "duration").join(asked, [*keys, "pos"], "left").withColumn("_f", F.coalesce("_f", F.lit(False)))
    rows = rows.withColumns({"_end": F.lead(F.col("track_start") + F.col("duration")).over(w), "_run": F.sum((~F.col("_f")).cast("int")).over(so_far)})
    turn = F.row_number().over(Window.partitionBy(*keys, "_run", "_f").orderBy("pos"))
    rows = rows.withColumn("_act", F.col("_f") & (turn % 2 == 1) & F.col("_end").isNotNull())
    rows = rows.withColumn("_act", F.col("_act") & (F.sum(F.col("_act").cast("int")).over(so_far) <= most))
    left = rows.withColumn("_gone", F.coalesce(F.lag("_act").over(w), F.lit(False))).filter(~F.col("_gone"))
    return left.select(*keys, "pos", "track_start", F.when(F.col("_act"), F.col("_end") - F.col("track_start")).otherwise(F.col("duration")).alias("duration"))


def split(found: DataFrame, plan: DataFrame, keys: Sequence[str], beat: int, to: int = 24, margin: int = 4, most: int = 8) -> DataFrame:
    """keys, pos, part, track_start, duration: slots found too long are cut at the beat nearest to ``to`` frames after their start.

    Beats are ``beat`` frames apart, the earlier one wins ties.  A cut within
    ``margin`` frames of either end is not made and does not count for ``most``.
    """
    asked = found.filter(F.col("type") == "under_editing").select(*keys, "pos").distinct().withColumn("_f", F.lit(True))
    rows = plan.select(*keys, "pos", "track_start", "duration").join(asked, [*keys, "pos"], "left")
    start, end = F.col("track_start"), F.col("track_start") + F.col("duration")
    mid = F.floor((2 * (start + to) + beat - 1) / (2 * beat)).cast("int") * beat
    rows = rows.withColumn("_mid", F.when(F.col("_f") & (mid > start + margin) & (mid < end - margin), mid))
    so_far = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    cut = F.col("_mid").isNotNull() & (F.count("_mid").over(so_far) <= most)
    piece = lambda n, a, b: F.struct(F.lit(n).alias("part"), a.cast("int").alias("track_start"), (b - a).cast("int").alias("duration"))
    rows = rows.withColumn("_p", F.when(cut, F.array(piece(0, start, F.col("_mid")), piece(1, F.col("_mid"), end))).otherwise(F.array(piece(0, start, end))))
    return rows.select(*keys, "pos", F.explode("_p").alias("p")).select(*keys, "pos", "p.*")


def diversified(plan: DataFrame, order: DataFrame, keys: Sequence[str], most: int = 3) -> DataFrame:
    """keys, pos, clip_id, new_id: the first ``most`` slots whose clip a plan uses again get the library's first clips that it doesn't use.

    ``plan`` has pos and clip_id, ``order`` clip_id and its rank from 0 among the
    clips that may be used.  A plan of u clips leaves one of the first u + 1
    free, so it looks at its first u + ``most`` ranks, not at the library.  All
    plans look at the same ranks, so these few are sent SPREAD times, and a rank's
    plans are spread over as many keys.
    """
    uses = F.count("*").over(Window.partitionBy(*keys, "clip_id"))
    twice = plan.withColumn("_uses", uses).filter("_uses > 1 and clip_id is not null")
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("pos"))
    first = twice.withColumn("_n", n).filter(F.col("_n") <= most).select(*keys, "pos", "clip_id", "_n")
    mine = plan.select(*keys, "clip_id").distinct()
    ranks = mine.groupBy(*keys).agg(F.count("*").alias("_u")).withColumn("rank", F.explode(F.sequence(F.lit(0), (F.col("_u") + most - 1).cast("int"))))
    reach = plan.groupBy(*keys).agg(F.count("*").alias("_u")).agg((F.max("_u") + most).alias("_reach"))  # no plan looks further
    short = order.crossJoin(F.broadcast(reach)).filter("rank < _reach").select("rank", "clip_id", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("_turn"))
    ranks = ranks.withColumn("_turn", F.pmod(F.xxhash64(*keys), F.lit(SPREAD)).cast("int"))
    free = ranks.join(short, ["rank", "_turn"]).select(*keys, "clip_id", "rank").join(mine, [*keys, "clip_id"], "left_anti")
    free = free.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("rank"))).filter(F.col("_n") <= most)
    return first.join(free.withColumnRenamed("clip_id", "new_id"), [*keys, "_n"]).select(*keys, "pos", "clip_id", "new_id")


def injected(plan: DataFrame, footage: DataFrame, keys: Sequence[str], most: int = 3) -> DataFrame:
    """keys, pos, clip_id, impact: strong clips that no plan uses overwrite, one after another, the then weakest of a plan's strong slots.

    ``plan`` has pos, impact and strong, ``footage`` n (order of injection, from
    1), clip_id and impact; its first ``most`` rows are used.  Only the ``most``
    weakest slots can be met, so a plan folds over that many.
    """
    slot = "struct<impact:double,pos:int,clip_id:bigint>"
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("impact", "pos"))
    weak = plan.filter("strong").withColumn("_n", rank).filter(F.col("_n") <= most)
    held = weak.groupBy(*keys).agg(F.collect_list(F.struct(F.col("impact").cast("double"), F.col("pos").cast("int"), F.lit(None).cast("bigint").alias("clip_id")).cast(slot)).alias("_s"))
    first = footage.filter(F.col("n") <= most).agg(F.array_sort(F.collect_list(F.struct("n", "clip_id", F.col("impact").cast("double").alias("impact")))).alias("_c"))

    def overwrite(slots, clip):
        weakest = F.array_min(F.transform(slots, lambda s: F.struct(s["impact"], s["pos"])))["pos"]
        new = F.struct(clip["impact"].alias("impact"), weakest.alias("pos"), clip["clip_id"].cast("bigint").alias("clip_id"))
        return F.concat(F.filter(slots, lambda s: s["pos"] != weakest), F.array(new.cast(slot)))

    done = held.crossJoin(F.broadcast(first)).withColumn("_s", F.aggregate("_c", F.col("_s"), overwrite))  # one row of at most ``most`` clips
    return done.select(*keys, F.explode("_s").alias("s")).select(*keys, "s.pos", "s.clip_id", "s.impact").filter("clip_id is not null")
