"""Text queries: lyrics and subtitles written from events and read again, speakers of conversations, tags, loose JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.functions import exprs as X
from chronoloom.functions import parse as P
from chronoloom.functions import tables
from chronoloom.plans.ranges import seconds
from chronoloom.plans.registry import registrar, table

REGISTRY, query = registrar()
# The closed list of this query.
EMOTIONS = ("click", "view", "error", "purchase")


def stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text of lines [mm:ss.cc] word per user and hour of the first 90 minutes of each day."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", (seconds() % 5400).cast("int").alias("s"))
    line = F.format_string("[%02d:%02d.%02d] %s", (F.col("s") / 60).cast("int"), F.col("s") % 60, (F.col("event_id") % 100).cast("int"), F.when(F.col("event_id") % 7 == 0, "").otherwise(F.col("event_type")))
    return e.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))


LYRICS = """WITH e AS (SELECT user_id, event_id, event_type, CAST(date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) % 5400 AS INT) AS s FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS line_no FROM e)
SELECT user_id, CAST(line_no AS INT) AS line_no, round(s + (event_id % 100) / 100.0, 2) AS t, event_type AS text FROM n WHERE event_id % 7 <> 0"""


@query(LYRICS)
def lrc_parse(spark, sf_dir):
    return P.lyric_lines(stamped(spark, sf_dir), ["user_id"], "text")


def subtitled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One subtitle text a user, a cue an event."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", seconds().cast("long").alias("s")).withColumn("d", F.col("s") % 86400)
    clock = lambda ms: F.format_string("%02d:%02d:%02d,%03d", (F.col("d") / 3600).cast("int"), (F.col("d") / 60).cast("int") % 60, F.col("d") % 60 + (1 if ms == 1500 else 0), F.lit(ms % 1000))
    block = F.concat(F.col("event_id").cast("string"), F.lit("\n"), clock(250), F.lit(" --> "), clock(1500), F.lit("\n<i>"), F.col("event_type"), F.lit("</i>\nagain"))
    return e.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("text"))


SUBTITLES = """WITH e AS (SELECT user_id, event_id, event_type, CAST(date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) AS BIGINT) AS s FROM events)
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS cue_no, s % 86400 + 0.25 AS start, s % 86400 + 1.5 AS "end", event_type || ' again' AS text FROM e""".replace("s % 86400 + 0.25 AS start", "CAST(s % 86400 + 0.25 AS DOUBLE) AS start").replace("s % 86400 + 1.5 AS", "CAST(s % 86400 + 1.5 AS DOUBLE) AS")


@query(SUBTITLES)
def srt_parse(spark, sf_dir):
    return P.subtitle_cues(subtitled(spark, sf_dir), ["user_id"], "text")


def parsed_in_sql(texts: DataFrame, function: str, number: str) -> DataFrame:
    """``texts`` (user_id, text) through one of the functions of SQL: user_id and the fields of its structs."""
    spark = texts.sparkSession
    tables.register(spark)
    return spark.sql(f"SELECT * FROM (SELECT user_id, inline_outer(found) FROM (SELECT user_id, {function}(text) AS found FROM {{texts}})) WHERE {number} IS NOT NULL", texts=texts)


@query(SUBTITLES)
def srt_in_sql(spark, sf_dir):
    return parsed_in_sql(subtitled(spark, sf_dir), "srt_cues", "cue_no")


@query(LYRICS)
def lrc_in_sql(spark, sf_dir):
    return parsed_in_sql(stamped(spark, sf_dir), "lyric_lines", "line_no")


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as cues: a capitalised label (each fifth a sound), the text without brackets, and a sound."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.array_join(F.split(F.coalesce("text", F.lit("")), r"[\s\[\]]+"), " ").alias("words"))
    label = F.when(F.col("turn") % 5 == 4, F.lower("role")).otherwise(F.initcap("role"))
    return P.labelled(c.withColumn("text", F.concat(F.lit("["), label, F.lit("] "), F.col("words"), F.lit(" [Door Slams]"))), "text", ("user", "assistant"))


SPOKEN = r"""
WITH c AS (SELECT conv_id, turn, role, array_to_string(regexp_split_to_array(coalesce(text, ''), '[\s\[\]]+'), ' ') AS words FROM conversations),
s AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN NULL WHEN role IN ('user', 'assistant') THEN role ELSE 'other' END AS speaker,
  CASE WHEN turn % 5 = 4 THEN role || ',door slams' ELSE 'door slams' END AS sounds, nullif(trim(regexp_replace(words, '\s+', ' ', 'g')), '') AS dialogue FROM c)
"""


@query(SPOKEN + "SELECT conv_id, turn, speaker, sounds, dialogue FROM s")
def speaker_labels(spark, sf_dir):
    return spoken(spark, sf_dir).select("conv_id", "turn", "speaker", F.array_join("sounds", ",").alias("sounds"), "dialogue")


@query(SPOKEN + "SELECT coalesce(speaker, 'none') AS speaker, count(dialogue) AS n_lines, min(turn * 10) AS first_s, max(turn * 10) AS last_s FROM s GROUP BY 1")
def speaker_counts(spark, sf_dir):
    s = spoken(spark, sf_dir)
    return s.groupBy(F.coalesce("speaker", F.lit("none")).alias("speaker")).agg(F.count("dialogue").alias("n_lines"), F.min(F.col("turn") * 10).alias("first_s"), F.max(F.col("turn") * 10).alias("last_s"))


@query("""WITH t AS (SELECT role, conv_id % 10 AS track, count(*) FILTER (turn % 3 <> 0) AS plain, count(*) FILTER (turn % 3 = 0) AS cued FROM conversations GROUP BY 1, 2)
SELECT role, arg_max(track, plain * 100 - track) AS dialogue_track, CASE WHEN max(cued) > 5 THEN arg_max(track, cued * 100 - track) END AS sdh_track FROM t GROUP BY 1""")
def track_classify(spark, sf_dir):
    """Per role the track with most plain lines and that with most cued ones (only above 5), the first on ties."""
    t = table(spark, sf_dir, "conversations").groupBy("role", (F.col("conv_id") % 10).alias("track")).agg(F.count_if(F.col("turn") % 3 != 0).alias("plain"), F.count_if(F.col("turn") % 3 == 0).alias("cued"))
    best = lambda c: F.max_by("track", F.struct(c, -F.col("track")))
    return t.groupBy("role").agg(best("plain").alias("dialogue_track"), F.when(F.max("cued") > 5, best("cued")).alias("sdh_track"))


@query("""SELECT event_type AS raw, mood, count(*) AS n FROM (SELECT event_type, event_id % 4 AS k, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN 'other' WHEN 2 THEN event_type ELSE 'other' END AS v FROM events),
LATERAL (SELECT CASE WHEN k % 2 = 0 AND v IN ('click', 'view', 'error', 'purchase') THEN v WHEN k % 2 = 0 AND contains(v, 'view') THEN 'view' ELSE 'neutral' END AS mood) GROUP BY 1, 2""")
def enum_coerce(spark, sf_dir):
    """Exact names, names inside a phrase, other words and nulls, brought to a closed list."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id") % 4
    said = F.when(k == 0, F.concat(F.lit(" "), F.upper("event_type"))).when(k == 2, F.concat(F.lit("very "), F.col("event_type"), F.lit("-ish"))).when(k == 1, "zzz")
    return e.groupBy(F.col("event_type").alias("raw"), X.coerced(said, EMOTIONS, "neutral").alias("mood")).agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN event_id % 5 = 4 THEN -1 ELSE CAST(json_extract(props, '$.k') AS BIGINT) % 10 END AS k, count(*) AS n, count(*) FILTER (event_id % 5 IN (1, 2)) AS wrapped FROM events GROUP BY 1""")
def tolerant_json(spark, sf_dir):
    """Objects alone, inside chatter, and no object at all."""
    e = table(spark, sf_dir, "events").withColumn("m", F.col("event_id") % 5)
    said = F.when(F.col("m") == 4, "none at all").when(F.col("m").isin(1, 2), F.concat(F.lit("Sure: "), F.col("props"), F.lit(" ok"))).otherwise(F.col("props"))
    k = F.try_variant_get(P.loose_json(said), "$.k", "long")
    return e.groupBy(F.coalesce(k % 10, F.lit(-1).cast("long")).alias("k")).agg(F.count("*").alias("n"), F.count_if(F.col("m").isin(1, 2)).alias("wrapped"))
