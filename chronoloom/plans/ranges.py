"""Interval queries.  A clip is an event of a user, lasting until the user's next one; times are seconds from 2024-01-01."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.operators import intervals as I
from chronoloom.operators import series as S
from chronoloom.plans import signal
from chronoloom.plans.registry import registrar, table

REGISTRY, query = registrar()
DAY = 86400.0
# Excluded ranges, acts.
EXCLUDED = ((5 * DAY, 6 * DAY), (12.5 * DAY, 13 * DAY))
ACTS = (("happy", 0.0, 10 * DAY), ("fight", 10 * DAY, 20 * DAY), ("aftermath", 20 * DAY, 25 * DAY))


def seconds() -> F.Column:
    """Whole seconds, rounded down also before 2024."""
    return F.expr("CAST(floor(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) / 1000000) AS DOUBLE)")


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events in order; those without a time come last, so that the others are numbered from 1 (``ORDER BY`` in the SQL does the same)."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("track"), F.col("value"), seconds().alias("start_s"))
    w = Window.partitionBy("user_id").orderBy(F.asc_nulls_last("start_s"), F.asc_nulls_last("event_id"))
    return e.withColumns({"pos": F.row_number().over(w).cast("int"), "end_s": F.coalesce(F.lead("start_s").over(w), F.col("start_s") + 10.0)})


CLIPS = """
WITH ev AS (SELECT user_id, event_id, event_type AS track, value, CAST(date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) AS DOUBLE) AS start_s FROM events),
clips AS (SELECT *, CAST(row_number() OVER w AS INT) AS pos, coalesce(lead(start_s) OVER w, start_s + 10.0) AS end_s FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY start_s, event_id))
"""


@query(CLIPS + "SELECT user_id, pos, start_s, end_s FROM clips WHERE NOT ((start_s < 518400 AND end_s > 432000) OR (start_s < 1123200 AND end_s > 1080000))")
def exclude_ranges(spark, sf_dir):
    ranges = spark.createDataFrame(EXCLUDED, "lo double, hi double")
    c = clips(spark, sf_dir).select("user_id", "pos", "start_s", "end_s")
    return I.overlapping(c, ranges, [], DAY, False, "left_anti", ("start_s", "end_s"), ("lo", "hi"), ["user_id", "pos"])


@query(CLIPS + "SELECT p.user_id, p.start_s AS t, min(c.pos) AS pos FROM clips p JOIN clips c ON c.user_id = p.user_id AND c.start_s - 0.15 <= p.start_s AND p.start_s <= c.end_s WHERE p.track = 'error' GROUP BY 1, 2")
def first_cover(spark, sf_dir):
    c = clips(spark, sf_dir)
    points = c.filter("track = 'error'").select("user_id", F.col("start_s").alias("t")).distinct()
    return I.first_cover(points, c.select("user_id", "pos", "start_s", "end_s"), ["user_id"], "t", "pos", 0.15, DAY, "start_s", "end_s")


def speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "role", (F.col("turn") * 10.0).cast("double").alias("start"), (F.col("turn") * 10.0 + 8.0).cast("double").alias("end"))


SPEECH = """
WITH speech AS (SELECT conv_id, role, CAST(turn * 10 AS DOUBLE) AS start, CAST(turn * 10 + 8 AS DOUBLE) AS "end" FROM conversations),
wide AS (SELECT conv_id, role, greatest(0.0, start - 9) AS a, "end" + 9 AS b FROM speech),
flagged AS (SELECT *, CASE WHEN max(b) OVER w IS NULL OR a > max(b) OVER w THEN 1 ELSE 0 END AS new FROM wide WINDOW w AS (PARTITION BY conv_id, role ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY conv_id, role ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM flagged),
presence AS (SELECT conv_id, role, min(a) AS start, max(b) AS "end" FROM numbered GROUP BY conv_id, role, run)
"""


@query(SPEECH + 'SELECT conv_id, role, start, "end" FROM presence')
def presence_coalesce(spark, sf_dir):
    return I.coalesced(speech(spark, sf_dir), ["conv_id", "role"], 9.0)


@query(SPEECH + """, shots AS (SELECT conv_id, CAST(n AS INT) AS shot, n * 15.0 AS a, n * 15.0 + 5 AS b FROM (SELECT conv_id, unnest(range(0, CAST(max(turn) AS BIGINT) + 1)) AS n FROM conversations GROUP BY 1))
SELECT conv_id, shot, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b FROM shots s WHERE EXISTS (SELECT 1 FROM presence p WHERE p.conv_id = s.conv_id AND p.role = 'assistant' AND s.a <= p."end" AND s.b >= p.start)""")
def presence_semi(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations")
    last = F.col("m").cast("int")
    shots = talk.groupBy("conv_id").agg(F.max("turn").alias("m")).filter("m >= 0").withColumn("shot", F.explode(F.sequence(F.lit(0), last))).select("conv_id", "shot", (F.col("shot") * 15.0).alias("a"), (F.col("shot") * 15.0 + 5).alias("b"))
    there = I.coalesced(speech(spark, sf_dir).filter("role = 'assistant'"), ["conv_id", "role"], 9.0).drop("role")
    keyed = shots.withColumn("key", F.struct("conv_id", "shot"))
    return I.overlapping(keyed, there, ["conv_id"], 60.0, True, "left_semi", ("a", "b"), ("start", "end"), ["key"]).drop("key")


def act_of(t: F.Column) -> F.Column:
    """The act that holds ``t``; the last one where none does."""
    out = F.lit(ACTS[-1][0])
    for name, lo, hi in reversed(ACTS):
        out = F.when((t >= lo) & (t < hi), name).otherwise(out)
    return out


@query(CLIPS + "SELECT track, CASE WHEN start_s < 864000 THEN 'happy' WHEN start_s < 1728000 THEN 'fight' ELSE 'aftermath' END AS act, count(*) AS n FROM clips WHERE start_s >= 0 GROUP BY 1, 2")
def act_lookup(spark, sf_dir):
    return clips(spark, sf_dir).groupBy("track", act_of(F.col("start_s")).alias("act")).agg(F.count("*").alias("n"))


@query(CLIPS + """, acts AS (SELECT * FROM (VALUES ('happy', 0.0, 172800.0), ('fight', 172800.0, 259200.0), ('aftermath', 2160000.0, 2170000.0)) v(act, lo, hi)),
pools AS (SELECT user_id, act, count(*) FILTER (start_s BETWEEN lo AND hi) AS inside, count(*) AS everything, min(pos) FILTER (start_s BETWEEN lo AND hi) AS first_inside, min(pos) AS first_any FROM clips, acts GROUP BY 1, 2)
SELECT user_id, act, CASE WHEN inside > 0 THEN inside ELSE everything END AS n_pool, coalesce(first_inside, first_any) AS first_pos FROM pools""")
def act_pool_fallback(spark, sf_dir):
    spans = F.array(*[F.struct(F.lit(a).alias("act"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for a, lo, hi in (("happy", 0.0, 2 * DAY), ("fight", 2 * DAY, 3 * DAY), ("aftermath", 2160000.0, 2170000.0))])
    c = clips(spark, sf_dir).select("user_id", "pos", "start_s", F.explode(spans).alias("x")).withColumn("inside", F.col("start_s").between(F.col("x.lo"), F.col("x.hi")))
    agg = c.groupBy("user_id", F.col("x.act").alias("act")).agg(F.count_if("inside").alias("n_in"), F.count("*").alias("n_all"), F.min(F.when(F.col("inside"), F.col("pos"))).alias("p_in"), F.min("pos").alias("p_all"))
    return agg.select("user_id", "act", F.when(F.col("n_in") > 0, F.col("n_in")).otherwise(F.col("n_all")).alias("n_pool"), F.coalesce("p_in", "p_all").alias("first_pos"))


@query(CLIPS + """SELECT user_id, t, nearest FROM (SELECT p.user_id, p.start_s AS t, m.start_s AS nearest, row_number() OVER (PARTITION BY p.user_id, p.start_s ORDER BY abs(p.start_s - m.start_s), m.start_s) AS n
FROM (SELECT DISTINCT user_id, start_s FROM clips WHERE track <> 'error') p LEFT JOIN (SELECT DISTINCT user_id, start_s FROM clips WHERE track = 'error') m USING (user_id)) WHERE n = 1""")
def nearest_beat(spark, sf_dir):
    c = clips(spark, sf_dir)
    return I.nearest(c.filter("track <> 'error'").select("user_id", F.col("start_s").alias("t")), c.filter("track = 'error'").select("user_id", "start_s"), ["user_id"], "t", "start_s")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def uncached_anti(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


PEAKS = signal.UNIT + """, ev AS (SELECT user_id, event_id, event_type AS track, CAST(date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) AS DOUBLE) AS start_s FROM events),
clips AS (SELECT *, CAST(row_number() OVER w AS INT) AS pos, coalesce(lead(start_s) OVER w, start_s + 10.0) AS end_s FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY start_s, event_id))
SELECT track, user_id, pos, start_s, end_s FROM clips c WHERE NOT EXISTS (SELECT 1 FROM merged m WHERE m.level = 'high' AND m.track = c.track AND c.start_s < m.end_i * 3600.0 AND c.end_s > m.start_i * 3600.0)"""


@query(PEAKS)
def peak_window_anti(spark, sf_dir):
    _, found = signal.merged_sections(spark, sf_dir)
    windows = found.filter("level = 'high'").select("track", (F.col("start_i") * 3600.0).alias("lo"), (F.col("end_i") * 3600.0).alias("hi"))
    c = clips(spark, sf_dir).select("track", "user_id", "pos", "start_s", "end_s")
    return I.overlapping(c, windows, ["track"], DAY, False, "left_anti", ("start_s", "end_s"), ("lo", "hi"), ["user_id", "pos"])


DENSITY = """
WITH ev AS (SELECT event_type, CAST(date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) AS DOUBLE) AS t FROM events),
p AS (SELECT * FROM ev WHERE t >= 432000),
spine AS (SELECT event_type, CAST(b AS INT) AS bin FROM (SELECT DISTINCT event_type FROM p), range(20) r(b)),
hits AS (SELECT event_type, CAST(least(19, floor((t - 432000) / 86400)) AS INT) AS bin, count(*) AS hits FROM p GROUP BY 1, 2),
density AS (SELECT spine.event_type, spine.bin, CAST(coalesce(hits, 0) AS BIGINT) AS hits FROM spine LEFT JOIN hits USING (event_type, bin))
"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "events").select("event_type", seconds().alias("t")).filter(F.col("t") >= 5 * DAY)
    return I.density(p, ["event_type"], "t", F.lit(5 * DAY), DAY, 20)


@query(DENSITY + "SELECT event_type, bin, hits FROM density")
def impact_density(spark, sf_dir):
    return daily(spark, sf_dir)


@query(DENSITY + """, sm AS (SELECT event_type, bin, round(sum(hits) OVER (PARTITION BY event_type ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5.0, 6) AS s FROM density),
th AS (SELECT *, round(greatest(0.8 * avg(s) OVER (PARTITION BY event_type), 0.25 * max(s) OVER (PARTITION BY event_type)), 6) AS least FROM sm)
SELECT event_type, min(bin) AS first_bin, max(bin) AS last_bin, CAST(432000 + min(bin) * 86400 AS DOUBLE) AS start_s, CAST(432000 + (max(bin) + 1) * 86400 AS DOUBLE) AS end_s FROM th WHERE s >= least GROUP BY 1""")
def fight_window(spark, sf_dir):
    bins = daily(spark, sf_dir).withColumnRenamed("bin", "i")
    smooth = S.box_smooth(bins, ["event_type"], 5, "hits").withColumnRenamed("i", "bin")
    span = I.hot_span(smooth, ["event_type"], "s")
    return span.select("*", (5 * DAY + F.col("first_bin") * DAY).alias("start_s"), (5 * DAY + (F.col("last_bin") + 1) * DAY).alias("end_s"))


@query("""
WITH cuts AS (SELECT user_id, round(date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) / 86400.0, 3) AS t FROM events),
pts AS (SELECT DISTINCT user_id, t FROM cuts WHERE t > 0.05 AND t < 30 - 0.05 UNION SELECT DISTINCT user_id, unnest([0.0, 30.0]) FROM cuts),
iv AS (SELECT user_id, t AS start, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS "end" FROM pts),
ok AS (SELECT * FROM iv WHERE "end" IS NOT NULL),
fl AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY start) = 1 OR round("end" - start, 3) >= 0.4 THEN 1 ELSE 0 END AS new FROM ok),
nm AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY start) - 1 AS shot FROM fl)
SELECT user_id, CAST(shot AS INT) AS shot, CAST(min(start) AS DOUBLE) AS start, CAST(max("end") AS DOUBLE) AS "end" FROM nm GROUP BY 1, 2""")
def bounds_to_intervals(spark, sf_dir):
    cuts = table(spark, sf_dir, "events").select("user_id", (seconds() / DAY).alias("t"))
    spans = I.from_boundaries(cuts, ["user_id"], "t", F.max(F.lit(30.0)))
    runs = S.islands(spans, ["user_id"], F.round(F.col("end") - F.col("start"), 3) >= 0.4, "shot", "start")
    return runs.groupBy("user_id", "shot").agg(F.min("start").alias("start"), F.max("end").alias("end"))
