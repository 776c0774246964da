"""Further queries: tags, windows, kernels, summaries, curves."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoloom.functions import exprs as X
from chronoloom.functions import parse as P
from chronoloom.operators import intervals as I
from chronoloom.operators import series as S
from chronoloom.plans import audits, library, ranges, signal, texts, timeline
from chronoloom.plans.registry import registrar, table
from chronoloom.sources import store

REGISTRY, query = registrar()


@query(library.LIBRARY + """SELECT CASE WHEN intensity > 0.6 THEN 'high' WHEN intensity < 0.25 THEN 'low' ELSE 'mid' END AS energy, CASE WHEN exposure < 0.3 THEN 'dark' WHEN exposure > 0.6 THEN 'bright' ELSE 'mid' END AS light,
impact > 0.7 AS hit, CASE WHEN intensity > 0.6 THEN 'action' WHEN intensity > 0.35 THEN 'tense' ELSE 'tender' END AS emotion, count(*) AS n FROM lib GROUP BY 1, 2, 3, 4""")
def local_tags(spark, sf_dir):
    lib = library.library(spark, sf_dir)
    energy = F.when(F.col("intensity") > 0.6, "high").when(F.col("intensity") < 0.25, "low").otherwise("mid")
    light = F.when(F.col("exposure") < 0.3, "dark").when(F.col("exposure") > 0.6, "bright").otherwise("mid")
    return lib.groupBy(energy.alias("energy"), light.alias("light"), (F.col("impact") > 0.7).alias("hit"), X.emotion_from_motion(F.lit(False), F.col("intensity")).alias("emotion")).agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT user_id, event_id, event_type, CAST(date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) % 5400 AS INT) AS s FROM events WHERE event_id % 7 <> 0)
SELECT user_id, round(s + (event_id % 100) / 100.0 - 600, 2) AS at, 2.8 AS dur, event_type AS text FROM e WHERE s + (event_id % 100) / 100.0 - 600 >= 0 AND s + (event_id % 100) / 100.0 - 600 <= 1200""".replace("2.8 AS dur", "CAST(2.8 AS DOUBLE) AS dur"))
def lyric_window(spark, sf_dir):
    lines = P.lyric_lines(texts.stamped(spark, sf_dir), ["user_id"], "text").withColumn("at", F.round(F.col("t") - 600, 2))
    return lines.filter((F.col("at") >= 0) & (F.col("at") <= 1200)).select("user_id", "at", F.lit(2.8).alias("dur"), "text")


@query(ranges.CLIPS + "SELECT user_id, pos, lag(track) OVER w AS before, lead(track) OVER w AS after FROM clips WINDOW w AS (PARTITION BY user_id ORDER BY pos)")
def neighbour_clusters(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("pos")
    return ranges.clips(spark, sf_dir).select("user_id", "pos", F.lag("track").over(w).alias("before"), F.lead("track").over(w).alias("after"))


@query(signal.UNIT + """, shot AS (SELECT m.track, section, i, e, s FROM merged m JOIN extent z ON z.track = m.track JOIN smooth x ON x.track = m.track AND x.i >= least(m.start_i + 1, hi) AND x.i < greatest(m.start_i + 2, m.end_i))
SELECT track, section, round(avg(e), 4) AS motion_mean, max(e) AS motion_max, round(avg(s), 4) AS brightness, count(*) AS n FROM shot GROUP BY 1, 2""")
def shot_motion(spark, sf_dir):
    s, found = signal.merged_sections(spark, sf_dir)
    inside = F.explode(F.sequence(F.least(F.col("start_i") + 1, F.col("hi")), F.greatest(F.col("start_i") + 2, F.col("end_i")) - 1))
    shots = found.join(s.groupBy("track").agg(F.max("i").alias("hi")), "track").select("track", "section", inside.alias("i"))
    return shots.join(s, ["track", "i"]).groupBy("track", "section").agg(F.round(F.avg("e"), 4).alias("motion_mean"), F.max("e").alias("motion_max"), F.round(F.avg("s"), 4).alias("brightness"), F.count("*").alias("n"))


@query("""WITH b AS (SELECT event_type, CAST(least(71, floor(value / 500 * 72)) AS INT) AS bin, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT event_type, sum(n) AS total FROM b GROUP BY 1),
spine AS (SELECT event_type, CAST(x AS INT) AS bin FROM t, range(72) r(x)) SELECT event_type, bin, round(coalesce(n, 0) / total, 5) AS share FROM spine JOIN t USING (event_type) LEFT JOIN b USING (event_type, bin)""")
def value_histogram(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    b = e.groupBy("event_type", F.least(F.lit(71), F.floor(F.col("value") / 500 * 72).cast("int")).alias("bin")).agg(F.count("*").alias("n"))
    spine = b.groupBy("event_type").agg(F.sum("n").alias("total")).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(71))))
    return spine.join(b, ["event_type", "bin"], "left").select("event_type", "bin", F.round(F.coalesce("n", F.lit(0)) / F.col("total"), 5).alias("share"))


@query("WITH s AS (SELECT o_custkey, o_orderstatus, max(o_totalprice) AS v FROM orders GROUP BY 1, 2) SELECT o_orderstatus, count(*) AS n_sources, round(sum(v), 2) AS total, min(v) AS least, max(v) AS most FROM s GROUP BY 1")
def source_totals(spark, sf_dir):
    s = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.max("o_totalprice").alias("v"))
    return s.groupBy("o_orderstatus").agg(F.count("*").alias("n_sources"), F.round(F.sum("v"), 2).alias("total"), F.min("v").alias("least"), F.max("v").alias("most"))


@query(ranges.CLIPS + """, d AS (SELECT user_id, track, CAST(end_s - start_s AS BIGINT) AS hold FROM clips)
SELECT user_id, count(*) AS n, count(DISTINCT track) AS n_unique, min(hold) AS shortest, list_sort(list(hold))[CAST(floor(count(*) / 2) AS INT) + 1] AS middle, max(hold) AS longest FROM d GROUP BY 1""")
def plan_summary(spark, sf_dir):
    d = ranges.clips(spark, sf_dir).select("user_id", "track", (F.col("end_s") - F.col("start_s")).cast("long").alias("hold"), F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("end_s") - F.col("start_s"))).alias("r"), F.count("*").over(Window.partitionBy("user_id")).alias("c"))
    at = F.col("r") == F.floor(F.col("c") / 2) + 1
    return d.groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("track").alias("n_unique"), F.min("hold").alias("shortest"), F.max(F.when(at, F.col("hold"))).alias("middle"), F.max("hold").alias("longest"))


@query(ranges.CLIPS + "SELECT CASE WHEN start_s < 864000 THEN 'happy' WHEN start_s < 1728000 THEN 'fight' ELSE 'aftermath' END AS act, count(*) AS n FROM clips GROUP BY 1")
def act_mix(spark, sf_dir):
    reason = F.format_string("%s act, score %.2f", ranges.act_of(F.col("start_s")), F.col("value") / 500)
    return ranges.clips(spark, sf_dir).select(F.get(F.split(reason, " act"), 0).alias("act")).groupBy("act").agg(F.count("*").alias("n"))


@query("""SELECT label, vec_id, CASE WHEN p IS NULL THEN 0.0 ELSE round(list_sum(list_transform(range(64), lambda i: abs(CAST(embedding[i + 1] AS DOUBLE) - CAST(p[i + 1] AS DOUBLE)))) / 64, 5) END AS motion
FROM (SELECT *, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings)""")
def frame_difference(spark, sf_dir):
    held = S.ranged(library.embeddings(spark, sf_dir), ["label"], "vec_id")
    e = S.neighbours(held, ["label"], "vec_id", before=["embedding"]).withColumn("p", F.col("_before.embedding"))
    gap = F.aggregate(F.zip_with("embedding", "p", lambda a, b: F.abs(a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, x: s + x) / 64
    return e.select("label", "vec_id", F.when(F.col("p").isNull(), 0.0).otherwise(F.round(gap, 5)).alias("motion"))


@query("""WITH f AS (SELECT label, vec_id, CASE WHEN p IS NULL THEN 0 ELSE list_sum(list_transform(range(64), lambda i: greatest(0, CAST(round(CAST(embedding[i + 1] AS DOUBLE) * 1e9) AS BIGINT) - CAST(round(CAST(p[i + 1] AS DOUBLE) * 1e9) AS BIGINT)))) END AS flux
  FROM (SELECT *, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings)),
n AS (SELECT label, vec_id, CAST(flux AS HUGEINT) AS x, CAST(max(flux) OVER (PARTITION BY label) AS HUGEINT) AS most FROM f)
SELECT label, vec_id, CASE WHEN most = 0 THEN 0.0 ELSE CAST(((coalesce(lag(x) OVER w, 0) + 2 * x + coalesce(lead(x) OVER w, 0)) * 1000000 + 2 * most) // (4 * most) AS DOUBLE) / 1e6 END AS onset FROM n WINDOW w AS (PARTITION BY label ORDER BY vec_id)""")
def spectral_flux(spark, sf_dir):
    """Positive change from frame to frame as a share of the largest, smoothed by 0.25, 0.5, 0.25; in integers up to the last step, so the sums don't depend on their order."""
    held = S.ranged(library.embeddings(spark, sf_dir), ["label"], "vec_id")
    e = S.neighbours(held, ["label"], "vec_id", before=["embedding"]).withColumn("p", F.col("_before.embedding"))
    fixed = lambda x: F.round(x.cast("double") * 1e9).cast("long")
    rise = F.aggregate(F.zip_with("embedding", "p", lambda a, b: F.greatest(F.lit(0), fixed(a) - fixed(b))), F.lit(0).cast("long"), lambda s, x: s + x)
    f = store.written(e.select("label", "vec_id", "_range", F.coalesce(rise, F.lit(0)).cast("decimal(20,0)").alias("x")), "flux")
    most = f.groupBy(F.col("label").alias("of")).agg(F.max("x").alias("most"))
    around = S.neighbours(f, ["label"], "vec_id", before=["x"], after=["x"])
    x = around.join(most, F.col("label").eqNullSafe(F.col("of")))
    side = lambda name: F.coalesce(F.col(f"{name}.x"), F.lit(0))
    share = F.expr("CAST((total * 1000000 + 2 * most) div (4 * most) AS DOUBLE) / 1e6")
    return x.withColumn("total", side("_before") + 2 * F.col("x") + side("_after")).select("label", "vec_id", F.when(F.col("most") == 0, 0.0).otherwise(share).alias("onset"))


@query(library.LIBRARY + "SELECT id, CAST(greatest(1, least(6, 1 + floor(dur * 4 / 2) + CASE WHEN intensity > 0.5 THEN 2 ELSE 0 END)) AS INT) AS n_keyframes FROM lib")
def keyframe_count(spark, sf_dir):
    n = 1 + F.floor(F.col("dur") * 4 / 2) + F.when(F.col("intensity") > 0.5, 2).otherwise(0)
    return library.library(spark, sf_dir).select("id", F.greatest(F.lit(1), F.least(F.lit(6), n)).cast("int").alias("n_keyframes"))


@query(library.LIBRARY + """SELECT 'quality' AS list, id, quality AS v FROM (SELECT * FROM lib WHERE usable ORDER BY quality DESC, id LIMIT 5) UNION ALL SELECT 'intensity', id, intensity FROM (SELECT * FROM lib WHERE usable ORDER BY intensity DESC, id LIMIT 5)""")
def library_top(spark, sf_dir):
    lib = library.library(spark, sf_dir).filter("usable")
    top = lambda c: lib.orderBy(F.desc(c), "id").limit(5).select(F.lit(c).alias("list"), "id", F.col(c).alias("v"))
    return top("quality").unionByName(top("intensity"))


@query(signal.UNIT + "SELECT track, CAST(i * 30 AS INT) AS frame FROM graded WHERE i % 24 = 0 AND s >= q_hi UNION SELECT track, CAST(i * 30 AS INT) FROM drops")
def flash_frames(spark, sf_dir):
    s, d = signal.drops(spark, sf_dir)
    strong = S.with_quantiles(s, signal.KEYS, "s", q_hi=0.72).filter((F.col("i") % 24 == 0) & (F.col("s") >= F.col("q_hi"))).select("track", "i")
    return strong.unionByName(d.select("track", "i")).select("track", X.frames(F.col("i"), 30).alias("frame")).distinct()


@query(audits.PLAN + """, a AS (SELECT user_id, CAST(greatest(0, 100 - coalesce(sum(CASE severity WHEN 2 THEN 5 WHEN 3 THEN 9 END), 0)) AS INT) AS a FROM (SELECT DISTINCT user_id FROM plan) LEFT JOIN (SELECT * FROM issues WHERE severity >= 2) USING (user_id) GROUP BY 1),
b AS (SELECT user_id, CAST(greatest(0, 100 - 3 * count(*)) AS INT) AS b FROM issues WHERE severity = 1 GROUP BY 1)
SELECT user_id, a, b, CAST(round_even((a + coalesce(b, a)) / 2.0, 0) AS INT) AS score FROM a LEFT JOIN b USING (user_id)""")
def blended_scores(spark, sf_dir):
    """Two critics' scores of one plan, and their mean, half to even; where the second has none, the first stands for it."""
    p, found = audits.found_issues(spark, sf_dir)
    found = store.written(found, "issues")
    lost = found.filter("severity >= 2").groupBy("user_id").agg(F.sum(X.penalty(F.col("severity"))).alias("lost"))
    a = p.select("user_id").distinct().join(lost, "user_id", "left").select("user_id", F.greatest(F.lit(0), 100 - F.coalesce("lost", F.lit(0))).cast("int").alias("a"))
    b = found.filter("severity = 1").groupBy("user_id").agg(F.greatest(F.lit(0), 100 - 3 * F.count("*")).cast("int").alias("b"))
    return a.join(b, "user_id", "left").select("user_id", "a", "b", F.bround((F.col("a") + F.coalesce("b", "a")) / 2).cast("int").alias("score"))


@query("SELECT doc_id, sha1(coalesce(source, '') || ':' || CAST(n_chars AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR) || coalesce(lang, '')) AS key FROM documents")
def input_hashes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", store.input_hash(store.signature(F.coalesce("source", F.lit("")), F.col("n_chars"), F.col("doc_id")), F.coalesce("lang", F.lit(""))).alias("key"))


@query("""WITH x AS (SELECT l_orderkey, l_quantity - lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS d, l_discount * 100 AS r, l_tax * 100 AS g, l_quantity AS b FROM lineitem)
SELECT l_orderkey, round(coalesce(var_pop(d), 0), 4) AS sharpness, round((sqrt(var_pop(r - g) + var_pop((r + g) / 2 - b)) + 0.3 * sqrt(avg(r - g) * avg(r - g) + avg((r + g) / 2 - b) * avg((r + g) / 2 - b))) / 255, 5) AS colourfulness FROM x GROUP BY 1""")
def sharpness_colour(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_quantity") - F.lag("l_quantity").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))).alias("d"), (F.col("l_discount") * 100 - F.col("l_tax") * 100).alias("rg"), ((F.col("l_discount") * 100 + F.col("l_tax") * 100) / 2 - F.col("l_quantity")).alias("yb"))
    spread, mean = F.sqrt(F.var_pop("rg") + F.var_pop("yb")), F.sqrt(F.avg("rg") * F.avg("rg") + F.avg("yb") * F.avg("yb"))
    return li.groupBy("l_orderkey").agg(F.round(F.coalesce(F.var_pop("d"), F.lit(0.0)), 4).alias("sharpness"), F.round((spread + 0.3 * mean) / 255, 5).alias("colourfulness"))


@query(timeline.PLAN + """, f AS (SELECT user_id, pos, transition, CAST(t AS INT) AS f, greatest(0.0, least(1.0, t / 9.0)) AS p FROM layers, range(0, 13, 3) r(t))
SELECT transition, f, count(*) AS n, round(avg(CASE transition WHEN 'fade' THEN p WHEN 'swell' THEN p ELSE 1.0 END), 6) AS opacity, round(avg(CASE WHEN transition = 'swell' THEN 1.18 - 0.18 * (1 - (1 - p) * (1 - p) * (1 - p)) ELSE 1.0 END), 6) AS scale FROM f GROUP BY 1, 2""")
def transition_entrance(spark, sf_dir):
    p = timeline.plan(spark, sf_dir).select("transition", F.explode(F.sequence(F.lit(0), F.lit(12), F.lit(3))).alias("f"))
    share = X.clamp01(F.col("f") / 9.0)
    opacity = F.when(F.col("transition").isin("fade", "swell"), share).otherwise(1.0)
    scale = F.when(F.col("transition") == "swell", 1.18 - 0.18 * X.ease_out(share)).otherwise(1.0)
    return p.groupBy("transition", "f").agg(F.count("*").alias("n"), F.round(F.avg(opacity), 6).alias("opacity"), F.round(F.avg(scale), 6).alias("scale"))


@query(timeline.PLAN + """, c AS (SELECT DISTINCT user_id, pos, duration, f FROM (SELECT user_id, pos, duration, CAST(unnest(list_concat(range(0, least(13, duration)), range(greatest(0, duration - 10), duration))) AS INT) AS f FROM plan)),
o AS (SELECT *, greatest(0.0, least(1.0, f / 12.0)) AS p, greatest(0.0, least(1.0, (duration - f) / 10.0)) AS q FROM c)
SELECT user_id, pos, f, round(least(1 - (1 - p) * (1 - p) * (1 - p), q), 6) AS opacity, round(1.06 + 0.1 * f / duration, 6) AS zoom FROM o""")
def caption_envelope(spark, sf_dir):
    """Opacity of a caption (eased in over 12 frames, out over the last 10) and the zoom beside it, at every frame of both ramps; between them both stay on their lines."""
    ramps = F.array_distinct(F.concat(F.sequence(F.lit(0), F.least(F.lit(12), F.col("duration") - 1)), F.sequence(F.greatest(F.lit(0), F.col("duration") - 10), F.col("duration") - 1)))
    c = timeline.plan(spark, sf_dir).withColumn("f", F.explode(ramps))
    opacity = F.least(X.ease_out(X.clamp01(F.col("f") / 12.0)), X.clamp01((F.col("duration") - F.col("f")) / 10.0))
    return c.select("user_id", "pos", "f", F.round(opacity, 6).alias("opacity"), F.round(1.06 + 0.1 * F.col("f") / F.col("duration"), 6).alias("zoom"))


@query(timeline.PLAN + """, ok AS (SELECT user_id, pos, track_start, impact FROM plan WHERE duration >= 21 AND track_start >= 45 AND impact >= 0.4),
short AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY impact DESC, pos) AS n FROM ok) WHERE n <= 16),
xs AS (SELECT user_id, list_transform(list_sort(list([-impact, CAST(track_start AS DOUBLE)])), lambda v: [v[2]]) AS xs FROM short GROUP BY 1),
picked AS (SELECT user_id, list_reduce(xs, lambda acc, x: CASE WHEN len(acc) < 3 AND len(list_filter(acc, lambda c: abs(c - x[1]) < 480)) = 0 THEN list_concat(acc, x) ELSE acc END, CAST([] AS DOUBLE[])) AS ks FROM xs)
SELECT user_id, CAST(unnest(ks) AS INT) AS track_start FROM picked""")
def diegetic_pick(spark, sf_dir):
    p = timeline.plan(spark, sf_dir).filter("duration >= 21 and track_start >= 45 and impact >= 0.4")
    short = p.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("impact"), "pos"))).filter("n <= 16")
    return S.greedy_gap_by_score(short, ["user_id"], 480, 3, "track_start", "impact").withColumn("track_start", F.col("track_start").cast("int"))


@query(ranges.CLIPS + "SELECT user_id, pos, start_s, start_s BETWEEN 864000 AND 1728000 AND value > 20 AS usable FROM clips")
def source_window_filter(spark, sf_dir):
    return ranges.clips(spark, sf_dir).select("user_id", "pos", "start_s", (F.col("start_s").between(10 * ranges.DAY, 20 * ranges.DAY) & (F.col("value") > 20)).alias("usable"))


@query(ranges.SPEECH + ', t AS (SELECT conv_id, role, start, "end" FROM presence), d AS (SELECT role, CAST(least(9, floor(start / 20)) AS INT) AS bin, count(*) AS hits FROM t GROUP BY 1, 2), spine AS (SELECT role, CAST(b AS INT) AS bin FROM (SELECT DISTINCT role FROM t), range(10) r(b)) SELECT role, bin, CAST(coalesce(hits, 0) AS BIGINT) AS hits FROM spine LEFT JOIN d USING (role, bin)')
def presence_density(spark, sf_dir):
    there = I.coalesced(ranges.speech(spark, sf_dir), ["conv_id", "role"], 9.0)
    return I.density(there, ["role"], "start", F.lit(0.0), 20.0, 10)
