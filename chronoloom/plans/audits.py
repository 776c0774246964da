"""Audit queries.  A plan is a user's events in order, each showing a clip of the library; durations are frames between events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.operators import audit as A
from chronoloom.operators import series as S
from chronoloom.plans import library, ranges, signal
from chronoloom.plans.registry import registrar, table
from chronoloom.sources.store import written

REGISTRY, query = registrar()
KEYS = ["user_id"]


#: Frames an hour of events takes in a plan: a frame is ten minutes.
HOUR = 6


def clip_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library as audits see it: three colour shares a clip."""
    return library.library(spark, sf_dir).select("id", "cluster", "dur", "quality", "intensity", "impact", "usable", F.array("impact", "intensity", "exposure").alias("colour"))


def music(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """track, h, e, q_lo, q_hi, rel; and the frames of all tracks' drops."""
    signals, found = signal.drops(spark, sf_dir)
    s = S.rank_below(S.with_quantiles(signals, signal.KEYS, "s", q_lo=0.40, q_hi=0.72), signal.KEYS, "s")
    return s.select("track", F.col("i").alias("h"), F.col("s").alias("e"), "q_lo", "q_hi", "rel"), found.select((F.col("i") * HOUR).cast("int").alias("frame")).distinct()


def strong(features: DataFrame) -> DataFrame:
    """rank, clip_id of the usable clips of high impact, in the library's order."""
    ids = features.filter("usable and impact > 0.8").select(F.col("id").alias("clip_id"))
    return library.numbered(ids, "clip_id", "rank")


@dataclass(frozen=True)
class Audited:
    """A plan with its music, and what rules need beside it."""

    plan: DataFrame
    energy: DataFrame
    drops: DataFrame
    features: DataFrame

    def issues(self) -> DataFrame:
        return A.issues(self.plan, self.drops, strong(self.features), KEYS)


def audited(spark: SparkSession, sf_dir: str) -> Audited:
    """Users' plans: an event shows a clip of the library (by its number), over the energy of its type's hour; written, as rules, runs and scores all read it."""
    features = written(clip_features(spark, sf_dir), "features")
    energy, drops = music(spark, sf_dir)
    most = table(spark, sf_dir, "part").agg(F.max("p_partkey").alias("_most"))
    c = ranges.clips(spark, sf_dir).crossJoin(F.broadcast(most))  # one row
    c = c.select("user_id", "pos", "track", (1 + F.col("event_id") % F.col("_most")).alias("clip_id"), "start_s", "end_s", F.floor(F.col("start_s") / 3600).cast("int").alias("h"))
    lib = features.select(F.col("id").alias("clip_id"), F.lit(True).alias("known"), "cluster", "colour", "intensity", "impact")
    joined = c.join(energy, ["track", "h"]).join(lib, "clip_id", "left").select(
        "user_id", "pos", "track", "clip_id", F.coalesce("known", F.lit(False)).alias("known"), "cluster", "colour", F.floor((F.col("end_s") - F.col("start_s")) / 600).cast("int").alias("duration"),
        F.coalesce("intensity", F.lit(0.5)).alias("intensity"), F.coalesce("impact", F.lit(0.0)).alias("impact"), "e", "q_lo", "q_hi", "rel", (F.col("h") % 24 == 0).alias("is_drop"), F.floor(F.col("start_s") / 600).cast("int").alias("track_start"),
    )
    return Audited(written(joined, "plan"), energy, drops, features)


def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(spark, sf_dir).plan


def found_issues(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The plans and what the rules find in them."""
    a = audited(spark, sf_dir)
    return a.plan, a.issues()


PLAN = signal.UNIT + ", library AS (" + library.LIBRARY + """ SELECT *, [impact, intensity, exposure] AS colour FROM lib),
ev AS (SELECT user_id, event_id, event_type AS track, value, CAST(date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) AS DOUBLE) AS start_s FROM events),
clips AS (SELECT *, CAST(row_number() OVER w AS INT) AS pos, coalesce(lead(start_s) OVER w, start_s + 10.0) AS end_s FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY start_s, event_id)),
plan_ranked AS (SELECT track, i, s, q_hi, round((rank() OVER (PARTITION BY track ORDER BY s) - 1) / count(*) OVER (PARTITION BY track), 6) AS rel FROM graded),
plan AS (SELECT user_id, pos, c.track, c.clip_id, l.id IS NOT NULL AS known, l.cluster, l.colour, CAST(floor((end_s - start_s) / 600) AS INT) AS duration, coalesce(l.intensity, 0.5) AS intensity, coalesce(l.impact, 0.0) AS impact,
    s AS e, q_hi, rel, i % 24 = 0 AS is_drop, CAST(floor(start_s / 600) AS INT) AS track_start
  FROM (SELECT *, 1 + event_id % (SELECT max(p_partkey) FROM part) AS clip_id FROM clips) c JOIN plan_ranked r ON r.track = c.track AND r.i = CAST(floor(start_s / 3600) AS INT) LEFT JOIN library l ON l.id = c.clip_id),
plan_lagged AS (SELECT *, lag(cluster) OVER w AS before, lag(known) OVER w AND known AS both_known, lag(colour) OVER w AS colour_before, duration < 9 AND NOT is_drop AS fast FROM plan WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
fast_runs AS (SELECT *, sum(CASE WHEN fast THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM plan_lagged),
fast_numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id, run, fast ORDER BY pos) AS n FROM fast_runs),
drop_frames AS (SELECT DISTINCT i * 6 AS d FROM drops),
drop_cover AS (SELECT user_id, d, min(pos) AS pos, arg_min(impact, pos) AS impact FROM plan JOIN drop_frames ON track_start - 4.5 <= d AND d <= track_start + duration GROUP BY 1, 2),
strong_clips AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM library WHERE usable AND impact > 0.8),
unused AS (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY k) AS n FROM (SELECT DISTINCT user_id FROM plan) u, strong_clips s WHERE NOT EXISTS (SELECT 1 FROM plan p WHERE p.user_id = u.user_id AND p.clip_id = s.id)),
shown AS (SELECT user_id, count(DISTINCT coalesce(cluster, '')) FILTER (known) AS c, count(*) FILTER (known) AS n FROM plan GROUP BY 1),
issues AS (
  SELECT user_id, pos, 'repetition' AS type, 2 AS severity, track_start AS frame, 'replace' AS action, NULL AS prefer, intensity AS match_intensity, NULL AS to_frames, NULL AS clip_id FROM plan_lagged
    WHERE both_known AND (coalesce(before = cluster, false) OR round(list_inner_product(colour_before, colour) / (sqrt(list_inner_product(colour_before, colour_before)) * sqrt(list_inner_product(colour, colour)) + 1e-9), 6) > 0.92)
  UNION ALL SELECT user_id, pos, 'weak_in_strong', 3, track_start, 'replace', 'impact', greatest(0.7, rel), NULL, NULL FROM plan WHERE e >= q_hi AND intensity < 0.4
  UNION ALL SELECT user_id, pos, 'busy_in_calm', 1, track_start, 'replace', 'calm', rel, NULL, NULL FROM plan WHERE NOT (e >= q_hi AND intensity < 0.4) AND rel < 0.25 AND intensity > 0.7
  UNION ALL SELECT user_id, pos, 'weak_drop', 3, d, 'replace', 'impact', 0.9, NULL, NULL FROM drop_cover WHERE impact < 0.6
  UNION ALL SELECT user_id, pos, 'under_editing', 1, track_start, 'shorten', NULL, NULL, 24, NULL FROM plan WHERE e >= q_hi AND duration > 42 AND NOT is_drop
  UNION ALL SELECT user_id, pos, 'over_editing', 1, track_start, 'lengthen', NULL, NULL, 15, NULL FROM fast_numbered WHERE fast AND n >= 4
  UNION ALL SELECT user_id, NULL, 'wasted_footage', 2, 0, 'inject', 'impact', NULL, NULL, id FROM unused WHERE n <= 3
  UNION ALL SELECT user_id, NULL, 'low_variety', 2, 0, 'diversify', NULL, NULL, NULL, NULL FROM shown WHERE c / greatest(1, n) < 0.55)
"""


@query(PLAN + """SELECT user_id, CAST(pos AS INT) AS pos, type, CAST(severity AS INT) AS severity, round(CAST(frame / 30 AS DOUBLE), 2) AS t, CAST(frame AS INT) AS frame, action, prefer, CAST(match_intensity AS DOUBLE) AS match_intensity,
  CAST(to_frames AS INT) AS to_frames, CAST(clip_id AS BIGINT) AS clip_id FROM issues""")
def issue_rules(spark, sf_dir):
    """All findings of the eight rules, each with what it asks the reviser to do."""
    return found_issues(spark, sf_dir)[1].drop("rule")


@query(PLAN + """SELECT user_id, coalesce(n_issues, 0) AS n_issues, CAST(greatest(0, 100 - coalesce(lost, 0)) AS INT) AS score FROM (SELECT DISTINCT user_id FROM plan)
LEFT JOIN (SELECT user_id, count(*) AS n_issues, sum(CASE severity WHEN 1 THEN 2 WHEN 2 THEN 5 ELSE 9 END) AS lost FROM issues GROUP BY 1) USING (user_id)""")
def plan_score(spark, sf_dir):
    p, found = found_issues(spark, sf_dir)
    return A.scores(found, p, KEYS)


@query(PLAN + "SELECT type, count(*) AS n, min(pos) AS first_pos FROM issues GROUP BY 1 ORDER BY n DESC, type LIMIT 4")
def issue_topk(spark, sf_dir):
    return found_issues(spark, sf_dir)[1].groupBy("type").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos")).orderBy(F.desc("n"), "type").limit(4)


@query(ranges.CLIPS + "SELECT user_id, count(*) AS n, round(count(DISTINCT track) / greatest(1, count(*)), 4) AS variety FROM clips GROUP BY 1")
def variety(spark, sf_dir):
    c = ranges.clips(spark, sf_dir).select("user_id", F.col("track").alias("cluster"))
    return A.variety(c, KEYS)


@query(PLAN + "SELECT user_id, pos, duration FROM fast_numbered WHERE fast AND n >= 3")
def over_editing_runs(spark, sf_dir):
    p = plan(spark, sf_dir)
    return S.long_runs(p, KEYS, "pos", (F.col("duration") < 9) & ~F.col("is_drop"), 3).select("user_id", "pos", "duration")


@query(ranges.CLIPS + "SELECT user_id, count(*) FILTER (value >= before) AS n_up, count(before) AS n_steps FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY pos) AS before FROM clips) GROUP BY 1")
def monotonicity(spark, sf_dir):
    c = ranges.clips(spark, sf_dir).withColumn("before", F.lag("value").over(Window.partitionBy("user_id").orderBy("pos")))
    return c.groupBy("user_id").agg(F.count_if(F.col("value") >= F.col("before")).alias("n_up"), F.count("before").alias("n_steps"))


@query(PLAN + """, w AS (SELECT user_id, min(track_start) AS first_start FROM plan GROUP BY 1),
cut_kept AS (SELECT p.* FROM plan p JOIN w USING (user_id) WHERE track_start < 2000 OR track_start = first_start)
SELECT user_id, pos, track_start, CAST(CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY track_start DESC, pos DESC) = 1 THEN greatest(1, 2000 - track_start) ELSE duration END AS INT) AS duration FROM cut_kept""")
def timeline_truncate(spark, sf_dir):
    return A.truncated(plan(spark, sf_dir), KEYS, 2000).select("user_id", "pos", "track_start", F.col("duration").cast("int").alias("duration"))


@query("""WITH h AS (SELECT user_id, CAST(version AS INT) AS version, score FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY d) AS version, CAST(floor(v) % 101 AS INT) AS score FROM (
  SELECT user_id, CAST(date_diff('hour', TIMESTAMP '2024-01-01', ts) // 24 AS INT) AS d, round(sum(value), 2) AS v FROM events GROUP BY 1, 2))),
m AS (SELECT *, score >= 96 OR score - lag(score) OVER (PARTITION BY user_id ORDER BY version) < 2 AS s FROM h),
st AS (SELECT *, coalesce(min(version) FILTER (s) OVER (PARTITION BY user_id), max(version) OVER (PARTITION BY user_id)) AS stop FROM m)
SELECT user_id, max(stop) AS stop_version, CAST(arg_max(version, score * 1000 - version) AS INT) AS best_version FROM st WHERE version <= stop GROUP BY 1""")
def stop_rule(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.expr("CAST(floor(timestampdiff(HOUR, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) / 24) AS INT)").alias("d"), "value")
    daily = e.groupBy("user_id", "d").agg(F.round(F.sum("value"), 2).alias("v"))
    h = daily.select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("d")).alias("version"), (F.floor("v") % 101).cast("int").alias("score"))
    return A.convergence(h, KEYS)


@query(PLAN.replace("WITH raw", "WITH raw") + ", " + library.LIBRARY.strip().removeprefix("WITH ").replace("p AS (SELECT p_partkey", "pa AS (SELECT p_partkey").replace("FROM p JOIN li", "FROM pa JOIN li") + """,
cand AS (SELECT CAST(s AS INT) AS slot, id, cluster AS clip_cluster, round(0.9 * quality + 1.2 * (1 - abs(intensity - s / 10.0)), 6) AS clip_score FROM lib, range(11) r(s) WHERE usable),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slot, clip_cluster ORDER BY clip_score DESC, id) AS n FROM cand) WHERE n = 1),
asked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY severity DESC, pos, type) AS n FROM issues WHERE type IN ('weak_in_strong', 'repetition', 'busy_in_calm')),
aim AS (SELECT a.user_id, a.pos, a.type, plan.cluster, CAST(round(CASE WHEN a.type = 'weak_in_strong' THEN greatest(0.7, rel) ELSE rel END * 10) AS INT) AS slot FROM asked a JOIN plan ON plan.user_id = a.user_id AND plan.pos = a.pos WHERE a.n <= 8)
SELECT user_id, pos, type, clip_id FROM (SELECT user_id, pos, type, id AS clip_id, row_number() OVER (PARTITION BY user_id, pos, type ORDER BY clip_score DESC, id) AS n2 FROM aim JOIN top USING (slot) WHERE cluster <> clip_cluster) WHERE n2 = 1""")
def revise_pass(spark, sf_dir):
    p, found = found_issues(spark, sf_dir)
    lib = library.library(spark, sf_dir).filter("usable").withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(10))))
    score = F.round(0.9 * F.col("quality") + 1.2 * (1 - F.abs(F.col("intensity") - F.col("slot") / 10)), 6)
    scored = lib.select("slot", F.struct((-score).alias("s"), F.col("id").alias("clip_id"), F.col("cluster").alias("clip_cluster")).alias("c"))
    ranked = scored.withColumn("n", F.row_number().over(Window.partitionBy("slot", "c.clip_cluster").orderBy("c.s", "c.clip_id"))).filter("n = 1")  # the best of each cluster: a finding rules out one cluster
    top = ranked.select("slot", "c.clip_id", "c.clip_cluster", (-F.col("c.s")).alias("clip_score"))
    return A.replacements(found, p, top, KEYS)
