"""Queries over cuts: effects, unused footage, numbering, flashes, motion, volume, trims, actions, spectra and colours."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoloom.functions import exprs as X
from chronoloom.operators import assign as A
from chronoloom.operators import audit
from chronoloom.operators import series as S
from chronoloom.operators import timeline as T
from chronoloom.plans import audits, library, timeline
from chronoloom.plans.profiles import PROFILES
from chronoloom.plans.registry import registrar, table
from chronoloom.sources.store import written

REGISTRY, query = registrar()
FPS = 30


def allowed_sql() -> str:
    rows = ", ".join(f"('{p.name}', {p.kenburns}, {p.shake}, {p.flash})" for p in PROFILES)
    return f"allowed AS (SELECT * FROM (VALUES {rows}) v(profile, kenburns, shake, flash))"


@query(audits.PLAN + ", " + allowed_sql() + """
SELECT profile, user_id, pos, concat_ws(',', CASE WHEN intensity <= 0.55 AND kenburns THEN 'kenburns' END, CASE WHEN intensity > 0.55 AND shake AND (e >= q_hi OR is_drop) THEN 'shake' END, CASE WHEN is_drop AND flash THEN 'flash' END) AS effects FROM plan, allowed""")
def effects_list(spark, sf_dir):
    """Each clip's effects in order, under every profile."""
    allowed = F.array(*[F.struct(F.lit(p.name).alias("profile"), F.lit(p.kenburns).alias("kenburns"), F.lit(p.shake).alias("shake"), F.lit(p.flash).alias("flash")) for p in PROFILES])
    p = audits.plan(spark, sf_dir).withColumn("a", F.explode(allowed))
    found = X.effects(F.col("intensity") > 0.55, F.col("e") >= F.col("q_hi"), F.col("is_drop"), F.col("a.kenburns"), F.col("a.shake"), F.col("a.flash"))
    return p.select("a.profile", "user_id", "pos", F.array_join(found, ",").alias("effects"))


@query(library.LIBRARY + """, used AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber <= 2)
SELECT id, impact, CAST(row_number() OVER (ORDER BY id) AS INT) AS n, row_number() OVER (ORDER BY id) <= 3 AS flagged FROM lib WHERE usable AND impact > 0.6 AND id NOT IN (SELECT id FROM used WHERE id IS NOT NULL)""")
def wasted_footage(spark, sf_dir):
    """Strong clips that no plan uses (here: parts without a returned first or second line), in the library's order; the first three are flagged."""
    used = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' AND l_linenumber <= 2").select(F.col("l_partkey").alias("id"))
    strong = library.library(spark, sf_dir).filter("usable AND impact > 0.6").join(used, "id", "left_anti").select("id", "impact")
    order = library.numbered(strong.select("id").distinct(), "id", "n")
    return strong.join(order, "id").select("id", "impact", (F.col("n") + 1).alias("n"), (F.col("n") < 3).alias("flagged"))


@query(audits.PLAN + "SELECT user_id, CAST(arg_min(pos, intensity * 1000000 + pos) AS INT) AS pos, min(intensity) AS impact FROM plan WHERE e >= q_hi OR is_drop GROUP BY 1")
def weakest_slot(spark, sf_dir):
    """The slot with the least impact among a plan's strong ones, the first on ties: where unused footage goes."""
    strong = audits.plan(spark, sf_dir).filter("e >= q_hi OR is_drop")
    return strong.groupBy("user_id").agg(F.min_by("pos", F.struct("intensity", "pos")).alias("pos"), F.min("intensity").alias("impact"))


@query(audits.PLAN + """SELECT user_id, pos, CAST(row_number() OVER (PARTITION BY user_id ORDER BY NOT (e >= q_hi OR is_drop), pos) - 1 AS INT) AS turn,
printf('c%03d', row_number() OVER (PARTITION BY user_id ORDER BY pos) - 1) AS clip_no FROM plan""")
def peak_first_order(spark, sf_dir):
    """The order in which slots are filled (peaks, then the rest) and the clips' numbers in the timeline's order."""
    w = Window.partitionBy("user_id")
    turn = F.row_number().over(w.orderBy(~((F.col("e") >= F.col("q_hi")) | F.col("is_drop")), "pos")) - 1
    number = F.format_string("c%03d", F.row_number().over(w.orderBy("pos")) - 1)
    return audits.plan(spark, sf_dir).select("user_id", "pos", turn.cast("int").alias("turn"), number.alias("clip_no"))


@query(timeline.PLAN + """SELECT user_id, pos, CAST(f AS INT) AS f, round(CASE WHEN f <= 1 THEN f * 0.85 ELSE 0.85 * greatest(0.0, (7 - f) / 6.0) END, 6) AS clip_flash, round(CASE WHEN f <= 1 THEN f * 0.5 ELSE 0.5 * greatest(0.0, (6 - f) / 5.0) END, 6) AS beat_flash
FROM plan, range(0, 8) r(f) WHERE transition = 'flash' AND f < duration""")
def flash_curves(spark, sf_dir):
    """Opacity of the flash over a clip and of the accent on its beat, at each of their frames."""
    p = timeline.plan(spark, sf_dir).filter("transition = 'flash'").withColumn("f", F.explode(F.sequence(F.lit(0), F.least(F.lit(7), F.col("duration") - 1))))
    return p.select("user_id", "pos", "f", F.round(X.pulse(F.col("f"), 0.85, 7), 6).alias("clip_flash"), F.round(X.pulse(F.col("f"), 0.5, 6), 6).alias("beat_flash"))


@query(timeline.PLAN + """, t AS (SELECT user_id, pos, transition, total, unnest([0, total // 2, total]) AS f FROM layers),
p AS (SELECT *, greatest(0.0, least(1.0, f / CAST(total AS DOUBLE))) AS p FROM t)
SELECT DISTINCT user_id, pos, CAST(f AS INT) AS f, round((1.06 + 0.1 * p) * CASE WHEN transition = 'flash' THEN 1.02 ELSE 1 END, 6) AS scale, round(CASE WHEN pos % 2 = 0 THEN 24 * p ELSE 0.0 - 24 * p END, 6) AS tx, round(10 * p, 6) AS ty, CASE WHEN transition = 'flash' THEN 10 ELSE 0 END AS shake FROM p""")
def clip_motion(spark, sf_dir):
    """Zoom, drift and shake at a clip's first, middle and last frame; the drift's side is the position's parity instead of a random one."""
    p = T.layers(timeline.plan(spark, sf_dir)).withColumn("f", F.explode(F.array_distinct(F.array(F.lit(0), F.expr("total div 2").cast("int"), F.col("total")))))
    share = X.clamp01(F.col("f") / F.col("total").cast("double"))
    shaken = F.col("transition") == "flash"
    scale = (1.06 + 0.1 * share) * F.when(shaken, 1.02).otherwise(1.0)
    side = F.when(F.col("pos") % 2 == 0, 24 * share).otherwise(-24 * share)
    return p.select("user_id", "pos", "f", F.round(scale, 6).alias("scale"), F.round(side, 6).alias("tx"), F.round(10 * share, 6).alias("ty"), F.when(shaken, 10).otherwise(0).alias("shake"))


@query(timeline.PLAN + timeline.DUCKS + timeline.TOTALS + """, low AS (SELECT user_id, frame, round(coalesce(min(v), 0.85), 6) AS volume FROM ramps LEFT JOIN v USING (user_id, frame) GROUP BY 1, 2)
SELECT user_id, frame, round(volume * greatest(0.0, least(CASE WHEN fi <= 0 THEN 1.0 ELSE greatest(0.0, least(1.0, frame / CAST(fi AS DOUBLE))) END, CASE WHEN fo <= 0 THEN 1.0 ELSE greatest(0.0, least(1.0, (total - frame) / CAST(fo AS DOUBLE))) END)), 6) AS volume FROM low JOIN t USING (user_id)""")
def final_volume(spark, sf_dir):
    """The music's volume: the ducks' curve times the fades, at every frame of the ducks' ramps."""
    p = timeline.plan(spark, sf_dir)
    d = timeline.ducks(p)
    low = T.ducked(T.ramp_frames(d, ["user_id"]), d, ["user_id"], 0.85, 1440).join(timeline.totals(p), "user_id")
    gain = X.fade_envelope(F.col("frame").cast("double"), F.col("total").cast("double"), F.col("fi"), F.col("fo"))
    return low.select("user_id", "frame", F.round(F.col("volume") * gain, 6).alias("volume"))


@query(timeline.PLAN + """SELECT user_id, CAST(max(track_start + duration) AS INT) AS duration, 30 AS fps, CASE WHEN user_id % 2 = 0 THEN 1920 ELSE 1080 END AS width, CASE WHEN user_id % 2 = 0 THEN 1080 ELSE 1920 END AS height FROM plan GROUP BY 1""")
def plan_metadata(spark, sf_dir):
    """Length, rate and size of each plan; every other one is upright."""
    p = timeline.plan(spark, sf_dir).groupBy("user_id").agg(F.max(F.col("track_start") + F.col("duration")).cast("int").alias("duration"))
    wide = F.col("user_id") % 2 == 0
    return p.select("user_id", "duration", F.lit(FPS).alias("fps"), F.when(wide, 1920).otherwise(1080).alias("width"), F.when(wide, 1080).otherwise(1920).alias("height"))


@query(timeline.PLAN + "SELECT user_id, pos, CAST(greatest(0, floor(impact * 10 * 30 + 0.5) - lead) AS INT) AS start_from FROM layers")
def source_trim(spark, sf_dir):
    """The source frame from which each clip is played."""
    p = T.layers(timeline.plan(spark, sf_dir))
    return p.select("user_id", "pos", X.source_trim(F.col("impact") * 10, F.col("lead"), FPS).alias("start_from"))


@query("""SELECT CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN 'inject' ELSE 'replace' END AS action, CASE event_id % 4 WHEN 1 THEN 'p' || CAST(user_id % 10 AS VARCHAR) END AS clip_id, count(*) AS n FROM events GROUP BY 1, 2""")
def action_structs(spark, sf_dir):
    """Actions given as a bare name, an object, an object without a name and nothing, brought to one struct."""
    k = F.col("event_id") % 4
    said = F.when(k == 0, F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))).when(k == 1, F.format_string('{"action": "inject", "clipId": "p%d"}', F.col("user_id") % 10)).when(k == 2, "{}")
    e = table(spark, sf_dir, "events").select(X.action_of(F.try_parse_json(said)).alias("a"))
    return e.groupBy("a.action", "a.clip_id").agg(F.count("*").alias("n"))


@query("""WITH u AS (SELECT user_id, count(*) % 60 / 10.0 AS stop FROM events GROUP BY 1) SELECT user_id, CAST(i AS INT) AS i, round(CAST(i * 0.25 AS DOUBLE), 6) AS t FROM u, range(0, 1000) r(i) WHERE i * 0.25 < stop""")
def float_range(spark, sf_dir):
    """Sample times of each user, a quarter apart (a step that is exact in binary, so SQL needs no loop)."""
    u = table(spark, sf_dir, "events").groupBy("user_id").agg((F.count("*") % 60 / 10.0).cast("double").alias("stop"))
    return u.select("user_id", F.posexplode(X.float_range(F.lit(0.0), F.col("stop"), F.lit(0.25))).alias("i", "t")).withColumn("t", F.round("t", 6))


@query("""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS y FROM embeddings),
w AS (SELECT list_transform(range(32), lambda n: 0.5 - 0.5 * cos(2 * pi() * n / 31)) AS w),
f AS (SELECT vec_id, label, CAST(f AS INT) AS frame, list_transform(range(32), lambda n: y[CAST(f * 16 + n + 1 AS INT)] * w[CAST(n + 1 AS INT)]) AS x FROM v, w, range(0, 3) r(f)),
b AS (SELECT vec_id, label, frame, k, sqrt(power(list_sum(list_transform(range(32), lambda n: x[CAST(n + 1 AS INT)] * cos(2 * pi() * k * n / 32))), 2) + power(list_sum(list_transform(range(32), lambda n: x[CAST(n + 1 AS INT)] * sin(2 * pi() * k * n / 32))), 2)) AS m FROM f, range(0, 17) r(k))
SELECT label, frame, CAST(k AS INT) AS bin, round(avg(m), 4) AS magnitude FROM b GROUP BY 1, 2, 3""")
def windowed_spectrum(spark, sf_dir):
    """Mean spectra of a label's vectors taken as signals of 64 samples, in frames of 32, every 16."""
    found = S.spectrum(library.embeddings(spark, sf_dir), ["label"], "embedding", 32, 16)
    bins = found.select("label", "frame", F.posexplode("magnitude").alias("bin", "m"))
    return bins.groupBy("label", "frame", "bin").agg(F.round(F.avg("m"), 4).alias("magnitude"))


@query("""WITH c AS (SELECT l_suppkey, least(1.0, l_discount * 10) AS r, least(1.0, l_tax * 12) AS g, l_quantity / 50.0 AS b FROM lineitem WHERE l_linenumber % 4 = 1),
h AS (SELECT *, greatest(r, g, b) AS mx, greatest(r, g, b) - least(r, g, b) + 1e-9 AS gap FROM c),
u AS (SELECT *, CASE WHEN mx = b THEN (r - g) / gap + 4 WHEN mx = g THEN (b - r) / gap + 2 ELSE (g - b) / gap - 6 * floor((g - b) / gap / 6) END / 6 AS hue FROM h),
n AS (SELECT l_suppkey, CAST(greatest(0, least(7, floor((hue - floor(hue)) * 8))) * 9 + greatest(0, least(2, floor(gap / (mx + 1e-9) * 3))) * 3 + greatest(0, least(2, floor(mx * 3))) AS INT) AS bin, count(*) AS n FROM u GROUP BY 1, 2)
SELECT l_suppkey, bin, round(n / (sum(n) OVER (PARTITION BY l_suppkey) + 1e-9), 5) AS share FROM n""")
def hue_histogram(spark, sf_dir):
    """Shares of hue, saturation and value bins over every fourth line (as the sampled pixels) of a supplier; empty bins have no row."""
    li = table(spark, sf_dir, "lineitem").filter("l_linenumber % 4 = 1")
    c = li.select("l_suppkey", X.hue_bin(F.least(F.lit(1.0), F.col("l_discount") * 10), F.least(F.lit(1.0), F.col("l_tax") * 12), F.col("l_quantity") / 50.0).alias("bin"))
    n = c.groupBy("l_suppkey", "bin").agg(F.count("*").alias("n"))
    return n.select("l_suppkey", "bin", F.round(F.col("n") / (F.sum("n").over(Window.partitionBy("l_suppkey")) + X.EPS), 5).alias("share"))


@query()
def edit_plan(spark, sf_dir):
    """Whole plans under the first profile: assigned clips with number, frames, transition, effects and reason.  The choices have no SQL; a test recomputes the rest."""
    slots = timeline.slots(spark, sf_dir)
    shots = timeline.shots(spark, sf_dir).select(F.col("id").alias("clip_id"), "intensity", "impact", "quality")
    chosen = A.assigned(slots, timeline.shots(spark, sf_dir), "user_id").select("user_id", "slot", "clip_id")
    p = PROFILES[0]
    rows = slots.join(chosen, ["user_id", "slot"]).join(shots, "clip_id")
    level = X.level(F.col("target"), F.lit(0.4), F.lit(0.72))
    drop = F.col("is_peak") & (F.col("slot") % 8 == 0)
    pool = F.when(drop, F.array(*map(F.lit, p.drop)))
    for name in ("low", "mid", "high"):
        pool = pool.when(level == name, F.array(*map(F.lit, getattr(p, name))))
    start, end = F.round(F.col("begin") * FPS).cast("int"), F.round(F.col("end") * FPS).cast("int")
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("slot")) - 1
    rows = rows.withColumns({"number": number, "level": level, "drop": drop}).withColumn("transition", X.cycled(pool, F.col("number")))
    flags = [F.lit(x) for x in (p.kenburns, p.shake, p.flash)]
    return rows.select(
        "user_id", F.format_string("c%03d", "number").alias("clip_no"), "clip_id", start.alias("track_start"), F.greatest(F.lit(1), end - start).alias("duration"), "transition",
        X.transition_frames(F.col("transition"), F.lit(p.crossfade)).alias("frames"), F.array_join(X.effects(F.col("intensity") > 0.55, level == "high", F.col("drop"), *flags), ",").alias("effects"), "level", F.col("drop").alias("is_drop"),
        F.concat(F.when(F.col("drop"), "DROP ").otherwise(""), F.format_string("%s energy (%.2f) -> intensity %.2f, quality %.2f", "level", "target", "intensity", "quality")).alias("reason"),
    )


@query(audits.PLAN + """, beside AS (SELECT p.user_id, p.pos, p.track_start, p.duration, f.pos IS NOT NULL AS f, lead(p.track_start + p.duration) OVER (PARTITION BY p.user_id ORDER BY p.pos) AS next_end
  FROM plan p LEFT JOIN (SELECT DISTINCT user_id, pos FROM issues WHERE type = 'over_editing') f ON f.user_id = p.user_id AND f.pos = p.pos),
run_of AS (SELECT *, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM beside),
acts AS (SELECT *, f AND row_number() OVER (PARTITION BY user_id, run, f ORDER BY pos) % 2 = 1 AND next_end IS NOT NULL AS act FROM run_of),
done AS (SELECT *, act AND sum(CASE WHEN act THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) <= 8 AS took FROM acts),
left_over AS (SELECT *, coalesce(lag(took) OVER (PARTITION BY user_id ORDER BY pos), false) AS gone FROM done)
SELECT user_id, pos, printf('c%03d', row_number() OVER (PARTITION BY user_id ORDER BY pos) - 1) AS clip_no, track_start, CAST(CASE WHEN took THEN next_end - track_start ELSE duration END AS INT) AS duration FROM left_over WHERE NOT gone""")
def revise_merge(spark, sf_dir):
    """A revision's merges: slots of over-edited runs take in the next slot, eight a plan, and the rest is numbered anew."""
    p, found = audits.found_issues(spark, sf_dir)
    number = F.format_string("c%03d", F.row_number().over(Window.partitionBy("user_id").orderBy("pos")) - 1)
    return audit.merged(found, p, audits.KEYS).select("user_id", "pos", number.alias("clip_no"), "track_start", F.col("duration").cast("int").alias("duration"))


@query(audits.PLAN + """, asked AS (SELECT p.user_id, p.pos, p.track_start, p.duration, CASE WHEN f.pos IS NOT NULL THEN (2 * (p.track_start + 24) + 6) // 14 * 7 END AS m
  FROM plan p LEFT JOIN (SELECT DISTINCT user_id, pos FROM issues WHERE type = 'under_editing') f ON f.user_id = p.user_id AND f.pos = p.pos),
fits AS (SELECT *, CASE WHEN m > track_start + 4 AND m < track_start + duration - 4 THEN m END AS mid FROM asked),
cut AS (SELECT *, mid IS NOT NULL AND count(mid) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) <= 8 AS cut FROM fits)
SELECT user_id, pos, 0 AS part, track_start, CAST(CASE WHEN cut THEN mid - track_start ELSE duration END AS INT) AS duration FROM cut
UNION ALL SELECT user_id, pos, 1, CAST(mid AS INT), CAST(track_start + duration - mid AS INT) FROM cut WHERE cut""")
def revise_split(spark, sf_dir):
    """A revision's splits: strong slots held too long are cut at a beat (seven frames apart), eight a plan."""
    p, found = audits.found_issues(spark, sf_dir)
    return audit.split(found, p, audits.KEYS, beat=7)


@query(audits.PLAN.replace("WITH", "WITH RECURSIVE", 1) + ", footage AS (" + library.LIBRARY + """, used AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber <= 2)
  SELECT row_number() OVER (ORDER BY id) AS n, id, impact FROM lib WHERE usable AND impact > 0.6 AND id NOT IN (SELECT id FROM used WHERE id IS NOT NULL) ORDER BY id LIMIT 3),
step AS (SELECT 0 AS n, user_id, pos, intensity AS impact, CAST(NULL AS BIGINT) AS clip_id FROM plan WHERE e >= q_hi OR is_drop
  UNION ALL SELECT n + 1, user_id, pos, CASE WHEN k = 1 THEN new_impact ELSE impact END, CASE WHEN k = 1 THEN new_id ELSE clip_id END
  FROM (SELECT s.*, w.impact AS new_impact, w.id AS new_id, row_number() OVER (PARTITION BY user_id ORDER BY s.impact, s.pos) AS k FROM step s JOIN footage w ON w.n = s.n + 1))
SELECT user_id, pos, clip_id, impact FROM step WHERE n = (SELECT count(*) FROM footage) AND clip_id IS NOT NULL""")
def revise_inject(spark, sf_dir):
    """A revision's injections: the first three strong unused clips overwrite a plan's weakest strong slots."""
    p = audits.plan(spark, sf_dir)
    strong = ((F.col("e") >= F.col("q_hi")) | F.col("is_drop")).alias("strong")
    return audit.injected(p.select("user_id", "pos", F.col("intensity").alias("impact"), strong), wasted_footage(spark, sf_dir).withColumnRenamed("id", "clip_id"), audits.KEYS)


@query(library.LIBRARY + """, tl AS (SELECT o_custkey AS plan_id, l_partkey AS clip_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey, l_linenumber, l_partkey) AS INT) AS pos FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
twice AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY pos) AS n FROM (SELECT *, count(*) OVER (PARTITION BY plan_id, clip_id) AS uses FROM tl) WHERE uses > 1),
ranked AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM lib WHERE usable),
mine AS (SELECT DISTINCT plan_id, clip_id FROM tl),
most AS (SELECT plan_id, count(*) + 3 AS most FROM mine GROUP BY 1),
free AS (SELECT plan_id, id AS new_id, row_number() OVER (PARTITION BY plan_id ORDER BY k) AS n FROM (SELECT most.plan_id, id, k FROM most JOIN ranked ON k <= most.most) c ANTI JOIN mine ON mine.plan_id = c.plan_id AND mine.clip_id = c.id)
SELECT plan_id, pos, clip_id, new_id FROM twice JOIN free USING (plan_id, n) WHERE n <= 3""")
def revise_diversify(spark, sf_dir):
    """A revision's exchange of repeated clips: a customer's lines in order are a plan, their parts its clips."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey", "l_linenumber", "l_partkey"))
    p = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("plan_id"), F.col("l_partkey").alias("clip_id"), pos.alias("pos"))
    p = written(p, "plan")  # read for repeats, for used clips and for the longest plan
    usable = library.library(spark, sf_dir).filter("usable").select(F.col("id").alias("clip_id")).distinct()
    return audit.diversified(p, library.numbered(usable, "clip_id", "rank"), ["plan_id"])
