"""Time-series queries.  A track is an event type; its energy is the root mean square of ``events.value`` by hour."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.operators import chains, spectra
from chronoloom.operators import series as S
from chronoloom.operators.quantiles import quantiles
from chronoloom.plans.registry import registrar, table
from chronoloom.sources.store import written

REGISTRY, query = registrar()
KEYS = ["track"]
SMOOTH, JUMP, RISE, GAP, LEAST = 21, 12, 0.05, 6, 6
BUILD, PERIOD, SNAP = 24, 24, 3


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("track"), F.expr("CAST(floor(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) / 3600000000) AS INT)").alias("h"), F.col("value").alias("v"))
    return S.on_spine(S.block_rms(events, KEYS, F.col("h"), "v"), KEYS)


def unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy as a share of the track's largest, smoothed.

    Events are read once: what is left of them, one row an hour and track, is
    written, as quantiles, sections and jumps all read it.
    """
    e = hourly(spark, sf_dir)
    share = e.withColumn("e", F.round(F.col("e") / (F.max("e").over(Window.partitionBy(*KEYS)) + 1e-9), 6))
    return written(S.box_smooth(share, KEYS, SMOOTH), "energy")


UNIT = """
WITH raw AS (
  SELECT event_type AS track, CAST(date_diff('hour', TIMESTAMP '2024-01-01', ts) AS INT) AS i, round(sqrt(avg(value * value) + 1e-9), 6) AS e FROM events GROUP BY 1, 2),
extent AS (SELECT track, least(0, min(i)) AS lo, max(i) AS hi FROM raw GROUP BY 1),
grid6 AS (SELECT track, lo, hi, unnest(range(CAST(ceil(lo / 6.0) * 6 AS BIGINT), CAST(hi + 1 AS BIGINT), 6)) AS b FROM extent),
grid24 AS (SELECT track, unnest(range(CAST(ceil(lo / 24.0) * 24 AS BIGINT), CAST(hi + 1 AS BIGINT), 24)) AS b FROM extent),
spine AS (SELECT track, CAST(unnest(range(CAST(lo AS BIGINT), CAST(hi + 1 AS BIGINT))) AS INT) AS i FROM extent),
filled AS (SELECT spine.track, spine.i, coalesce(e, 0.0) AS e FROM spine LEFT JOIN raw USING (track, i)),
energy AS (SELECT track, i, round(e / (max(e) OVER (PARTITION BY track) + 1e-9), 6) AS e FROM filled),
smooth AS (SELECT track, i, e, round(sum(e) OVER (PARTITION BY track ORDER BY i ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) / 21, 6) AS s FROM energy),
q AS (SELECT track, round(quantile_cont(s, CAST(0.40 AS DOUBLE)), 6) AS q_lo, round(quantile_cont(s, CAST(0.72 AS DOUBLE)), 6) AS q_hi, round(quantile_cont(s, CAST(0.66 AS DOUBLE)), 6) AS q_jump FROM smooth GROUP BY 1),
graded AS (SELECT *, CASE WHEN s >= q_hi THEN 'high' WHEN s <= q_lo THEN 'low' ELSE 'mid' END AS level FROM smooth JOIN q USING (track)),
marked AS (SELECT *, CASE WHEN lag(level) OVER w IS NULL OR lag(level) OVER w <> level THEN 1 ELSE 0 END AS new FROM graded WINDOW w AS (PARTITION BY track ORDER BY i)),
runs AS (SELECT *, sum(new) OVER (PARTITION BY track ORDER BY i) AS island FROM marked),
isles AS (SELECT track, island, min(i) AS start_i, max(i) AS last_i, first(level) AS level, round(avg(s), 4) AS energy FROM runs GROUP BY 1, 2),
ends AS (SELECT track, start_i, coalesce(lead(start_i) OVER (PARTITION BY track ORDER BY start_i), last_i) AS end_i, level, energy FROM isles),
flagged AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY track ORDER BY start_i) = 1 OR end_i - start_i >= 6 THEN 1 ELSE 0 END AS new FROM ends),
grouped AS (SELECT *, sum(new) OVER (PARTITION BY track ORDER BY start_i) - 1 AS section FROM flagged),
merged AS (SELECT track, CAST(section AS INT) AS section, min(start_i) AS start_i, max(end_i) AS end_i, arg_min(level, start_i) AS level, arg_min(energy, start_i) AS energy FROM grouped GROUP BY 1, 2),
rises AS (
  SELECT track, start_i AS i FROM (SELECT *, lag(level) OVER (PARTITION BY track ORDER BY start_i) AS before FROM merged) WHERE level = 'high' AND before <> 'high'),
around AS (
  SELECT track, i, q_jump, floor((2 * sum(m) OVER b + count(m) OVER b) / nullif(2 * count(m) OVER b, 0)) / 1000000 AS before,
         floor((2 * sum(m) OVER a + count(m) OVER a) / nullif(2 * count(m) OVER a, 0)) / 1000000 AS after FROM (SELECT *, TRY_CAST(round(s * 1000000) AS BIGINT) AS m FROM graded)
  WINDOW b AS (PARTITION BY track ORDER BY i ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY track ORDER BY i ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING)),
jumped AS (SELECT track, i FROM around JOIN extent USING (track) WHERE i >= lo + 12 AND i <= hi - 12 AND round(after - before, 6) > 0.05 AND after > q_jump),
candidates AS (SELECT * FROM rises UNION ALL SELECT * FROM jumped),
kept AS (
  SELECT track, list_reduce(list_transform(list_sort(list(CAST(i AS DOUBLE))), lambda v: [v]), lambda acc, x: CASE WHEN len(acc) = 0 OR x[1] - acc[-1] > 6 THEN list_concat(acc, x) ELSE acc END, CAST([] AS DOUBLE[])) AS ks
  FROM (SELECT track, i FROM candidates) GROUP BY track),
"""
UNIT += "drops AS (SELECT track, CAST(unnest(ks) AS INT) AS i FROM kept)\n"


def merged_sections(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = unit(spark, sf_dir)
    return s, S.merge_short(S.sections(s, KEYS), KEYS, LEAST)


def structural_drops(found: DataFrame) -> DataFrame:
    before = F.lag("level").over(S.by(KEYS, "start_i"))
    return found.withColumn("_b", before).filter((F.col("level") == "high") & (F.col("_b") != "high")).select(*KEYS, F.col("start_i").alias("i"))


def drops(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s, found = merged_sections(spark, sf_dir)
    both = structural_drops(found).unionAll(S.jumps(s, KEYS, JUMP, RISE))
    return s, chains.greedy_gap(both, KEYS, GAP).withColumn("i", F.col("i").cast("int"))


@query(UNIT + "SELECT track, section, CAST(start_i AS INT) AS start_i, CAST(end_i AS INT) AS end_i, level, energy FROM merged")
def energy_sections(spark, sf_dir):
    return merged_sections(spark, sf_dir)[1].select("track", "section", "start_i", "end_i", "level", "energy")


@query(UNIT + "SELECT track, i FROM drops")
def energy_drops(spark, sf_dir):
    return drops(spark, sf_dir)[1]


@query(
    UNIT
    + """SELECT d.track, d.i AS drop_i, CAST(greatest(lo, d.i - 24) AS INT) AS start_i, CAST(d.i - 1 AS INT) AS end_i
FROM drops d JOIN extent x ON x.track = d.track JOIN smooth a ON a.track = d.track AND a.i = greatest(lo, d.i - 24) JOIN smooth b ON b.track = d.track AND b.i = d.i - 1
WHERE d.i - 1 - greatest(lo, d.i - 24) >= 1 AND round(b.s - a.s, 6) > 0.02"""
)
def buildups(spark, sf_dir):
    s, d = drops(spark, sf_dir)
    return S.buildups(s, d, KEYS, BUILD, 0.02)


@query(UNIT + "SELECT track, i, round((rank() OVER (PARTITION BY track ORDER BY s) - 1) / count(*) OVER (PARTITION BY track), 6) AS rel FROM smooth")
def rel_energy(spark, sf_dir):
    return S.rank_below(unit(spark, sf_dir), KEYS, "s").select("track", "i", "rel")


def beats(df: DataFrame, step: int = 6) -> DataFrame:
    return S.grid(df, KEYS, step).select(*KEYS, "beat")


@query(UNIT + "SELECT s.track, CAST(b AS INT) AS beat, s.i, e FROM smooth s JOIN grid6 g ON s.track = g.track AND s.i = CAST(greatest(lo, least(floor(b * 1.05), hi)) AS INT)")
def beat_energy(spark, sf_dir):
    e = unit(spark, sf_dir)
    return S.at_grid(S.grid(e, KEYS, 6), e, KEYS, "beat", 1.05).select("track", "beat", "i", "e")


@query(
    UNIT
    + """SELECT track, CAST(rank AS INT) AS rank, i, e FROM (
  SELECT track, i, e, row_number() OVER (PARTITION BY track ORDER BY e DESC, i DESC) AS rank FROM (
    SELECT *, lag(e) OVER w AS p, lead(e) OVER w AS n, avg(e) OVER (PARTITION BY track) AS m FROM energy WINDOW w AS (PARTITION BY track ORDER BY i))
  WHERE e >= p AND e >= n AND e > m) WHERE rank <= 6"""
)
def local_peaks(spark, sf_dir):
    return S.local_maxima(unit(spark, sf_dir), KEYS)


CORRELATION = """, centred AS (SELECT track, i, e - avg(e) OVER (PARTITION BY track) AS c FROM energy),
correlated AS (SELECT a.track, CAST(l AS INT) AS lag, round(sum(a.c * b.c), 4) AS r FROM range(6, 49) x(l) JOIN centred a ON TRUE JOIN centred b ON b.track = a.track AND b.i = a.i + l GROUP BY 1, 2)
"""


@query(UNIT + CORRELATION + "SELECT track, lag, r, round(60.0 / lag, 4) AS tempo FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY r DESC, lag) AS n FROM correlated) WHERE n = 1")
def tempo_period(spark, sf_dir):
    r = S.autocorrelation(unit(spark, sf_dir), KEYS, range(6, 49))
    return S.best_period(r, KEYS).select("track", "lag", "r", F.round(60.0 / F.col("lag"), 4).alias("tempo"))


@query(UNIT + "SELECT track, CAST(i % 24 AS INT) AS phase, round(sum(e), 4) AS score FROM energy GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY track ORDER BY round(sum(e), 4) DESC, CAST(i % 24 AS INT)) = 1")
def phase_search(spark, sf_dir):
    scored = S.phase_scores(unit(spark, sf_dir), KEYS, PERIOD)
    return scored.groupBy(*KEYS).agg(F.max_by("phase", F.struct("score", -F.col("phase"))).alias("phase"), F.max("score").alias("score"))


@query(UNIT + "SELECT s.track, CAST(b AS INT) AS beat, CAST(arg_max(i, e * 1000000 - i * 0.0001) AS INT) AS snapped FROM smooth s JOIN grid24 g ON g.track = s.track AND i BETWEEN b - 3 AND b + 3 GROUP BY 1, 2")
def beat_snap(spark, sf_dir):
    e = unit(spark, sf_dir)
    return S.snapped(e, beats(e, PERIOD), KEYS, SNAP).withColumn("snapped", F.col("snapped").cast("int"))


@query(UNIT + "SELECT track, CAST(b AS INT) AS beat, CAST(b / 6 AS INT) AS beat_no FROM grid24")
def downbeats(spark, sf_dir):
    b = beats(hourly(spark, sf_dir)).withColumn("beat_no", (F.col("beat") / 6).cast("int"))
    return b.filter("beat_no % 4 = 0")


@query(UNIT + "SELECT DISTINCT d.track, CAST(b AS INT) AS beat FROM drops d JOIN grid6 g ON g.track = d.track AND abs(b - d.i) <= 2")
def beat_drop_band(spark, sf_dir):
    s, d = drops(spark, sf_dir)
    near = d.select("track", F.explode(F.sequence(F.col("i") - 2, F.col("i") + 2)).alias("beat")).distinct()
    return beats(s).join(near, ["track", "beat"], "left_semi")


WALK = UNIT.replace("WITH raw", "WITH RECURSIVE raw") + """, beat AS (
  SELECT g.track, g.k, g.level, CAST(CASE g.level WHEN 'low' THEN 4 WHEN 'mid' THEN 2 ELSE 1 END AS INT) AS stride
  FROM (SELECT track, CAST(i / 6 AS INT) AS k, level FROM graded WHERE i % 6 = 0) g),
edge AS (SELECT track, CAST(ceil(lo / 6.0) AS INT) AS first_k, CAST(floor(hi / 6.0) AS INT) AS last_k FROM extent),
hit AS (SELECT DISTINCT d.track, CAST(b / 6 AS INT) AS k FROM drops d JOIN grid6 g ON g.track = d.track AND abs(b - d.i) <= 2),
step AS (
  SELECT b.track, b.k, b.level, least(b.k + b.stride, last_k) AS last, coalesce(min(h.k), least(b.k + b.stride, last_k)) AS next, count(h.k) > 0 AS is_drop, b.k = first_k AS head
  FROM beat b JOIN edge USING (track) LEFT JOIN hit h ON h.track = b.track AND h.k > b.k AND h.k <= least(b.k + b.stride, last_k) WHERE b.k < last_k GROUP BY b.track, b.k, b.level, b.stride, first_k, last_k),
walk AS (
  SELECT track, 0 AS seg_no, k, next, level, is_drop FROM step WHERE head
  UNION ALL SELECT s.track, w.seg_no + 1, s.k, s.next, s.level, s.is_drop FROM walk w JOIN step s ON s.track = w.track AND s.k = w.next)
"""


def walked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments between beats: a stride by level, cut short at a drop.  Each beat's next one is a pure column; the walk follows these."""
    s, d = drops(spark, sf_dir)
    graded = S.with_quantiles(s, KEYS, "s", q_lo=0.40, q_hi=0.72).withColumn("level", F.when(F.col("s") >= F.col("q_hi"), "high").when(F.col("s") <= F.col("q_lo"), "low").otherwise("mid"))
    beat = graded.filter("i % 6 = 0").select("track", (F.col("i") / 6).cast("int").alias("k"), "level").withColumn("stride", F.when(F.col("level") == "low", 4).when(F.col("level") == "mid", 2).otherwise(1))
    hit = d.select("track", F.explode(F.sequence(F.col("i") - 2, F.col("i") + 2)).alias("b")).filter("b % 6 = 0").select("track", (F.col("b") / 6).cast("int").alias("h")).distinct()
    ends = beat.groupBy("track").agg(F.max("k").alias("last_k"))
    reach = beat.join(ends, "track").filter("k < last_k").withColumn("last", F.least(F.col("k") + F.col("stride"), F.col("last_k"))).withColumn("h", F.explode(F.sequence(F.col("k") + 1, F.col("last"))))
    step = reach.join(hit.withColumn("there", F.lit(True)), ["track", "h"], "left").groupBy("track", "k", "level", "last").agg(F.min(F.when(F.col("there"), F.col("h"))).alias("first_hit"))
    step = step.select("track", "k", F.coalesce("first_hit", "last").alias("next"), "level", F.col("first_hit").isNotNull().alias("is_drop"))
    return chains.chained(written(step, "steps"), KEYS, "k", "next", "seg_no").withColumn("seg_no", F.col("seg_no").cast("int"))


@query(WALK + "SELECT track, CAST(seg_no AS INT) AS seg_no, CAST(k AS INT) AS k, CAST(next AS INT) AS next, level, is_drop FROM walk")
def cut_walk(spark, sf_dir):
    return walked(spark, sf_dir)


@query(
    WALK
    + """, cut AS (SELECT *, CASE WHEN seg_no = 0 OR next - k >= 2 THEN 1 ELSE 0 END AS new FROM walk),
held AS (SELECT *, sum(new) OVER (PARTITION BY track ORDER BY seg_no) - 1 AS hold FROM cut)
SELECT track, CAST(hold AS INT) AS hold, CAST(min(k) AS INT) AS start_k, CAST(max(next) AS INT) AS end_k, bool_or(is_drop) AS is_drop,
       CASE WHEN bool_or(level = 'high') THEN 'high' ELSE arg_min(level, seg_no) END AS level FROM held GROUP BY 1, 2"""
)
def min_hold_merge(spark, sf_dir):
    runs = S.islands(walked(spark, sf_dir), KEYS, F.col("next") - F.col("k") >= 2, "hold", "seg_no")
    return runs.groupBy("track", "hold").agg(
        F.min("k").alias("start_k"), F.max("next").alias("end_k"), F.bool_or("is_drop").alias("is_drop"),
        F.when(F.bool_or(F.col("level") == "high"), "high").otherwise(F.min_by("level", "seg_no")).alias("level"),
    )


SPACING = UNIT + """, ranked AS (SELECT track, list_transform(list_sort(list([-(round(e, 4)), CAST(i AS DOUBLE)])), lambda v: [v[2]]) AS xs FROM energy GROUP BY track),
spaced AS (SELECT track, list_reduce(xs, lambda acc, x: CASE WHEN len(acc) < 12 AND len(list_filter(acc, lambda c: abs(c - x[1]) < 16)) = 0 THEN list_concat(acc, x) ELSE acc END, CAST([] AS DOUBLE[])) AS ks FROM ranked)
SELECT track, CAST(unnest(ks) AS INT) AS i FROM spaced"""


@query(SPACING)
def greedy_spacing(spark, sf_dir):
    e = unit(spark, sf_dir).withColumn("score", F.round("e", 4))
    return S.greedy_gap_by_score(e, KEYS, 16, 12, "i").withColumn("i", F.col("i").cast("int"))


@query(UNIT + """, n AS (SELECT track, count(*) AS n FROM drops GROUP BY track), picks AS (SELECT track, CAST(unnest(range(0, least(n, 5))) AS INT) AS p, n FROM n),
placed AS (SELECT track, i, row_number() OVER (PARTITION BY track ORDER BY i) - 1 AS idx FROM drops)
SELECT picks.track, p, i FROM picks JOIN placed ON placed.track = picks.track AND idx = CAST(floor(CAST(p AS DOUBLE) * n / least(n, 5)) AS INT)""")
def stride_sample(spark, sf_dir):
    _, d = drops(spark, sf_dir)
    times = d.groupBy("track").agg(F.array_sort(F.collect_list("i")).alias("ts"))
    k = F.least(F.size("ts"), F.lit(5))
    return times.select("track", "ts", k.alias("k"), F.explode(F.sequence(F.lit(0), k - 1)).alias("p")).select("track", "p", F.element_at("ts", F.floor(F.col("p") * F.size("ts") / F.col("k")).cast("int") + 1).alias("i"))


@query("""SELECT event_type AS track, round(quantile_cont(value, CAST(0.05 AS DOUBLE)), 6) AS lo, round(quantile_cont(value, CAST(0.5 AS DOUBLE)), 6) AS mid, round(quantile_cont(value, CAST(0.95 AS DOUBLE)), 6) AS hi
FROM events WHERE event_type IS NOT NULL GROUP BY 1""")
def sample_quantiles(spark, sf_dir):
    """Of raw samples, whose values have no bounded number, in tracks of any size."""
    e = table(spark, sf_dir, "events").filter("event_type is not null").select(F.col("event_type").alias("track"), "value")
    found = quantiles(e, KEYS, {"lo": ("value", 0.05), "mid": ("value", 0.5), "hi": ("value", 0.95)})
    return found.select("track", *[F.round(c, 6).alias(c) for c in ("lo", "mid", "hi")])


ONSETS = UNIT + """, wave AS (SELECT track, i - lo AS n, e, hi - lo + 1 AS size FROM filled JOIN extent USING (track)),
framed AS (SELECT track, f, n - f * 16 AS j, e * (0.5 - 0.5 * cos(2 * pi() * (n - f * 16) / 31)) AS x FROM wave, range(0, 100000) r(f) WHERE f < 1 + (greatest(size, 32) - 32) // 16 AND n >= f * 16 AND n < f * 16 + 32),
spectra AS (SELECT track, f, k, sqrt(power(sum(x * cos(2 * pi() * k * j / 32)), 2) + power(sum(x * sin(2 * pi() * k * j / 32)), 2)) AS m FROM framed, range(0, 17) r(k) GROUP BY 1, 2, 3),
gains AS (SELECT track, f, round(sum(g), 6) AS flux FROM (SELECT track, f, greatest(0.0, coalesce(m - lag(m) OVER (PARTITION BY track, k ORDER BY f), 0.0)) AS g FROM spectra) GROUP BY 1, 2),
onsets AS (SELECT track, CAST(f AS BIGINT) AS i, CASE WHEN max(flux) OVER (PARTITION BY track) = 0 THEN 0.0
  ELSE round((coalesce(lag(flux) OVER w, 0.0) / 4 + flux / 2 + coalesce(lead(flux) OVER w, 0.0) / 4) / max(flux) OVER (PARTITION BY track), 6) END AS onset FROM gains WINDOW w AS (PARTITION BY track ORDER BY f))
"""


def wave_onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A track's hours as the samples of one long signal, in frames of 32, every 16."""
    e = written(hourly(spark, sf_dir), "wave")
    first = e.groupBy(*KEYS).agg(F.min("i").alias("lo"))
    return spectra.onsets(e.join(first, KEYS).withColumn("i", F.col("i") - F.col("lo")), KEYS, "e", 32, 16, 8)


@query(ONSETS + "SELECT track, i, onset FROM onsets")
def signal_onsets(spark, sf_dir):
    return wave_onsets(spark, sf_dir)


@query(ONSETS + """, level AS (SELECT track, i, onset - avg(onset) OVER (PARTITION BY track) AS c FROM onsets),
products AS (SELECT a.track, CAST(l AS INT) AS lag, round(sum(a.c * b.c), 4) AS r FROM range(2, 20) x(l) JOIN level a ON TRUE JOIN level b ON b.track = a.track AND b.i = a.i + l GROUP BY 1, 2)
SELECT track, lag, r FROM products QUALIFY row_number() OVER (PARTITION BY track ORDER BY r DESC, lag) = 1""")
def onset_period(spark, sf_dir):
    """From samples to the period of their onsets."""
    return S.best_period(S.autocorrelation(written(wave_onsets(spark, sf_dir), "onsets"), KEYS, range(2, 20), "onset"), KEYS)
