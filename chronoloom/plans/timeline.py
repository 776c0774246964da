"""Timeline queries: layers, curves, captions, chunks, transitions, assignment.  Frames are minutes of a user's day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions import exprs as X
from chronoloom.operators import assign as A
from chronoloom.operators import intervals as I
from chronoloom.operators import timeline as T
from chronoloom.plans import library, ranges
from chronoloom.plans.profiles import PROFILES, profiles
from chronoloom.plans.registry import registrar, table

REGISTRY, query = registrar()


def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ranges.clips(spark, sf_dir)
    return c.select(
        "user_id", "pos", F.floor(F.col("start_s") / 60).cast("int").alias("track_start"), F.greatest(F.lit(1), F.floor((F.col("end_s") - F.col("start_s")) / 60).cast("int")).alias("duration"),
        F.when(F.col("track") == "view", "fade").when(F.col("track") == "click", "swell").when(F.col("track") == "error", "flash").otherwise("cut").alias("transition"), F.lit(9).alias("frames"), F.round(F.col("value") / 500, 4).alias("impact"),
    )


PLAN = ranges.CLIPS + """, plan AS (SELECT user_id, pos, CAST(floor(start_s / 60) AS INT) AS track_start, greatest(1, CAST(floor((end_s - start_s) / 60) AS INT)) AS duration,
  CASE track WHEN 'view' THEN 'fade' WHEN 'click' THEN 'swell' WHEN 'error' THEN 'flash' ELSE 'cut' END AS transition, round(value / 500, 4) AS impact FROM clips),
layers AS (SELECT *, track_start - lead AS from_frame, duration + lead AS total FROM (SELECT *, CASE WHEN transition IN ('fade', 'swell') THEN least(9, track_start) ELSE 0 END AS lead FROM plan)),
frames AS (SELECT user_id, from_frame AS frame FROM layers WHERE from_frame >= 0 UNION SELECT user_id, from_frame + total FROM layers WHERE from_frame + total >= 0)
"""


@query(PLAN + "SELECT f.user_id, f.frame, max(pos) AS pos, count(*) AS n_layers FROM frames f JOIN layers l ON l.user_id = f.user_id AND f.frame >= from_frame AND f.frame < from_frame + total GROUP BY 1, 2")
def frame_layers(spark, sf_dir):
    """The topmost clip from each frame on where a clip begins or ends; between these frames nothing changes."""
    p = T.layers(plan(spark, sf_dir))
    return T.topmost(T.at_frames(T.change_points(p, ["user_id"], "from_frame", F.col("total")), p, ["user_id"], "from_frame", F.col("total"), 1440), ["user_id"])


DUCKS = """, ducks AS (SELECT user_id, track_start AS start, least(duration, 120) AS dur, round(0.2 + impact / 10, 4) AS "to" FROM plan WHERE transition = 'flash'),
ramps AS (SELECT DISTINCT user_id, frame FROM (SELECT user_id, CAST(unnest(list_concat(range(start - 9, start + 1), range(start + dur, start + dur + 10))) AS INT) AS frame FROM ducks) WHERE frame >= 0),
v AS (SELECT f.user_id, frame, CASE WHEN frame <= start THEN 0.85 + ("to" - 0.85) * greatest(0.0, least(1.0, (frame - (start - 9)) / 9.0)) WHEN frame >= start + dur THEN "to" + (0.85 - "to") * greatest(0.0, least(1.0, (frame - (start + dur)) / 9.0)) ELSE "to" END AS v
  FROM ramps f JOIN ducks d ON d.user_id = f.user_id AND frame >= start - 9 AND frame <= start + dur + 9)
"""


def ducks(p: DataFrame) -> DataFrame:
    return p.filter("transition = 'flash'").select("user_id", F.col("track_start").alias("start"), F.least("duration", F.lit(120)).alias("dur"), F.round(0.2 + F.col("impact") / 10, 4).alias("to"))


@query(PLAN + DUCKS + "SELECT user_id, frame, round(coalesce(min(v), 0.85), 6) AS volume FROM ramps LEFT JOIN v USING (user_id, frame) GROUP BY 1, 2")
def duck_curve(spark, sf_dir):
    """The music's volume at every frame of the ducks' ramps; elsewhere the curve is flat."""
    d = ducks(plan(spark, sf_dir))
    return T.ducked(T.ramp_frames(d, ["user_id"]), d, ["user_id"], 0.85, 1440)


TOTALS = """, t AS (SELECT user_id, CAST(max(track_start + duration) AS BIGINT) AS total, 10 + user_id % 20 AS fi, user_id % 3 * 15 AS fo FROM plan GROUP BY 1)"""


def totals(p: DataFrame) -> DataFrame:
    return p.groupBy("user_id").agg(F.max(F.col("track_start") + F.col("duration")).cast("long").alias("total")).withColumns({"fi": 10 + F.col("user_id") % 20, "fo": F.col("user_id") % 3 * 15})


@query(PLAN + TOTALS + """, e AS (SELECT DISTINCT * FROM (SELECT *, CAST(unnest(list_concat(range(0, fi + 1), range(total - fo, total + 1))) AS INT) AS frame FROM t) WHERE frame >= 0)
SELECT user_id, frame, round(greatest(0.0, least(CASE WHEN fi <= 0 THEN 1.0 ELSE greatest(0.0, least(1.0, frame / CAST(fi AS DOUBLE))) END, CASE WHEN fo <= 0 THEN 1.0 ELSE greatest(0.0, least(1.0, (total - frame) / CAST(fo AS DOUBLE))) END)), 6) AS gain FROM e""")
def fade_envelope(spark, sf_dir):
    """The gain at every frame of the fade in and the fade out; between them it is 1."""
    t = totals(plan(spark, sf_dir)).withColumn("frame", F.explode(F.array_distinct(F.concat(F.sequence(F.lit(0).cast("long"), "fi"), F.sequence(F.col("total") - F.col("fo"), "total"))))).filter("frame >= 0")
    gain = X.fade_envelope(F.col("frame").cast("double"), F.col("total").cast("double"), F.col("fi"), F.col("fo"))
    return t.select("user_id", F.col("frame").cast("int").alias("frame"), F.round(gain, 6).alias("gain"))


@query(PLAN + """, t AS (SELECT user_id, CAST(count(*) AS INT) * 37 AS total FROM plan GROUP BY 1)
SELECT user_id, CAST(f AS INT) AS first, CAST(least(f + 199, total - 1) AS INT) AS last FROM t, range(0, 1000000, 200) r(f) WHERE f < total""")
def chunk_plan(spark, sf_dir):
    t = plan(spark, sf_dir).groupBy("user_id").agg((F.count("*").cast("int") * 37).alias("total"))
    return T.chunks(t, ["user_id"], "total", 200)


@query(PLAN + "SELECT user_id, pos, track_start AS start, least(48, 20000 - track_start) AS dur FROM plan WHERE track_start < 20000 AND least(48, 20000 - track_start) > 0")
def caption_clip(spark, sf_dir):
    c = plan(spark, sf_dir).select("user_id", "pos", F.col("track_start").alias("start"), F.lit(48).alias("dur"))
    return T.clipped_captions(c, F.lit(20000))


def pools_sql() -> str:
    rows = ", ".join(f"('{p.name}', '{lv}', {list(getattr(p, lv))}, {p.crossfade})" for p in PROFILES for lv in ("low", "mid", "high", "drop"))
    return f"pools AS (SELECT * FROM (VALUES {rows}) v(profile, level, pool, crossfade))"


@query(ranges.CLIPS + ", " + pools_sql() + """, picked AS (SELECT user_id, pos, profile, crossfade, pool[(pos - 1) % len(pool) + 1] AS transition FROM (SELECT *, CASE track WHEN 'error' THEN 'drop' WHEN 'purchase' THEN 'high' WHEN 'click' THEN 'mid' ELSE 'low' END AS level FROM clips) JOIN pools USING (level))
SELECT profile, transition, CAST(CASE WHEN transition IN ('fade', 'swell') THEN crossfade WHEN transition = 'punch' THEN 8 WHEN transition IN ('whip', 'slide') THEN 10 WHEN transition = 'flash' THEN 7 WHEN transition = 'glitch' THEN 9 ELSE 0 END AS INT) AS frames, count(*) AS n, CAST(sum(pos) AS BIGINT) AS pos_sum FROM picked GROUP BY 1, 2, 3""")
def transition_cycle(spark, sf_dir):
    c = ranges.clips(spark, sf_dir).select("user_id", "pos", F.when(F.col("track") == "error", "drop").when(F.col("track") == "purchase", "high").when(F.col("track") == "click", "mid").otherwise("low").alias("level"))
    pools = profiles(spark).select("profile", "crossfade", F.explode(F.map_from_arrays(F.array(*map(F.lit, ("low", "mid", "high", "drop"))), F.array("low", "mid", "high", "drop"))).alias("level", "pool"))
    picked = c.join(F.broadcast(pools), "level").withColumn("transition", X.cycled(F.col("pool"), F.col("pos") - 1))  # 24 rows
    return picked.groupBy("profile", "transition", X.transition_frames(F.col("transition"), F.col("crossfade")).cast("int").alias("frames")).agg(F.count("*").alias("n"), F.sum("pos").alias("pos_sum"))


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable clips of the library with a source time and three colour shares."""
    lib = library.library(spark, sf_dir).filter("usable")
    return lib.select("id", "quality", "intensity", "impact", "dur", "cluster", (F.col("id") * 2.0).alias("start"), F.array(F.col("exposure"), F.col("quality"), F.lit(0.5)).alias("colour"))


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of each user's timeline: the rank of their energy is the intensity they ask for; the highest are peaks."""
    c = ranges.clips(spark, sf_dir)
    target = F.least(F.lit(1.0), F.round(F.col("value") / 500, 2))
    begin = F.col("start_s") / 3600
    return c.select("user_id", F.col("pos").alias("slot"), begin.alias("begin"), (F.col("end_s") / 3600).alias("end"), F.least(F.lit(4.0), (F.col("end_s") - F.col("start_s")) / 3600).alias("seconds"), target.alias("target"), ((F.col("track") == "error") | (target >= 0.72)).alias("is_peak"))


def tagged_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those clips with the tags of labelled documents of the same number, and with the roles that speak while they run."""
    s = shots(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    people = F.when(F.col("id") % 3 == 0, F.array().cast("array<string>")).when(F.col("id") % 3 == 1, F.array(F.lit("user"))).otherwise(F.array(F.lit("assistant"), F.lit("crowd")))
    tags = labels.select("id", F.when(F.col("toxic") == 1, "action").when(F.col("quality") == 1, "tender").otherwise("grief").alias("emotion"), F.when(F.col("toxic") == 1, "action").otherwise("dialogue").alias("scene"), people.alias("characters"))
    turns = ranges.speech(spark, sf_dir).select("role", (F.col("start") * 6).alias("start"), (F.col("start") * 6 + 8).alias("end")).distinct()  # one turn a minute; those at the same time are one
    there = I.coalesced(turns, ["role"], 9.0)
    roles = F.explode(F.array(F.lit("user"), F.lit("assistant"))).alias("role")
    span = s.select("id", roles, F.col("start").alias("a"), (F.col("start") + F.col("dur")).alias("b")).withColumn("key", F.struct("id", "role"))
    heard = I.overlapping(span, there, ["role"], 60.0, True, "left_semi", ("a", "b"), ("start", "end"), ["key"]).groupBy("id").agg(F.collect_set("role").alias("heard"))
    return s.join(tags, "id", "left").join(heard, "id", "left")


@query()
def assign_greedy(spark, sf_dir):
    """Each user's slots filled greedily from the whole library, peaks first.  The choices depend on each other, so there is no SQL; a test compares them with a plain loop."""
    return A.assigned(slots(spark, sf_dir), shots(spark, sf_dir), "user_id")


@query()
def assign_arc(spark, sf_dir):
    """Each user's slots filled from the parts of the library that their acts name; compared with a plain loop."""
    s = slots(spark, sf_dir)
    act = ranges.act_of(F.col("begin") * 3600)
    t0 = F.when(act == "happy", 0.0).when(act == "fight", 200.0).otherwise(1e9)
    moods = F.when(act == "fight", F.array(F.lit("action"), F.lit("tense"))).otherwise(F.array(F.lit("tender")))
    people = F.when(act == "fight", F.array(F.lit("assistant"))).when(act == "happy", F.array(F.lit("user"))).otherwise(F.array(F.lit("user"), F.lit("assistant")))
    s = s.withColumns({"act": act, "t0": t0, "t1": t0 + 1500.0, "emotions": moods, "characters": people})
    return A.assigned(s, tagged_shots(spark, sf_dir), "user_id", A.Arc(), A.ARC)
