"""Library queries: features, gates, similarity.  Clips are parts with their line items as samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.functions import exprs as X
from chronoloom.operators import similarity
from chronoloom.operators.graph import connected_components
from chronoloom.plans.registry import registrar, table
from chronoloom.sources.store import written

REGISTRY, query = registrar()
# Hue names in order.
HUES = ("red", "orange", "yellow", "green", "cyan", "blue", "purple", "pink")
NEAR = 18


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per part: mean and largest motion of its line items.

    Means lie on ties of the fourth place for one part in forty, where a sum of
    doubles depends on the order of the lines; so millionths are summed as
    integers and rounded half up.
    """
    li = table(spark, sf_dir, "lineitem").withColumn("_m", F.expr("try_cast(round(l_discount * 1000000) AS bigint)")).groupBy(F.col("l_partkey").alias("id"))
    mean = F.floor((2 * F.sum("_m") + 100 * F.count("_m")) / F.nullif(200 * F.count("_m"), F.lit(0))) / 10000
    return li.agg(mean.alias("motion_mean"), F.max("l_quantity").alias("motion_max"), F.count("*").alias("n_keyframes"))


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("cluster"), (F.col("p_size") / 20.0).alias("dur"),
        F.round(F.col("p_retailprice") % 100 / 100, 4).alias("brightness"), F.round(F.col("p_partkey") % 97 / 97, 2).alias("sharpness"), F.round(F.col("p_partkey") % 31 / 31, 2).alias("colour"),
    )
    found = written(p.join(samples(spark, sf_dir), "id"), "features")  # read for the bounds and for the rows
    bounds = found.agg(*[F.round(F.percentile(c, F.lit(q)), 6).alias(f"{c}_{n}") for c in ("motion_mean", "motion_max") for q, n in ((0.05, "lo"), (0.95, "hi"))])
    found = found.crossJoin(F.broadcast(bounds))  # one row
    reason = X.reject_reason(F.col("dur"), F.col("brightness"), F.col("sharpness"), F.col("colour"))
    return found.select(
        "id", "cluster", "dur", "n_keyframes",
        F.round(X.normalised(F.col("motion_mean"), F.col("motion_mean_lo"), F.col("motion_mean_hi")), 4).alias("intensity"),
        F.round(X.normalised(F.col("motion_max"), F.col("motion_max_lo"), F.col("motion_max_hi")), 4).alias("impact"),
        F.round(X.exposure(F.col("brightness")), 2).alias("exposure"),
        X.quality(F.col("sharpness"), F.col("colour"), F.round(X.exposure(F.col("brightness")), 2)).alias("quality"),
        reason.alias("reject_reason"), reason.isNull().alias("usable"),
    )


LIBRARY = """
WITH li AS (SELECT l_partkey AS id, floor((2 * sum(m) + 100 * count(m)) / nullif(200 * count(m), 0)) / 10000 AS motion_mean, max(l_quantity) AS motion_max, count(*) AS n_keyframes
  FROM (SELECT *, TRY_CAST(round(l_discount * 1000000) AS BIGINT) AS m FROM lineitem) GROUP BY 1),
p AS (SELECT p_partkey AS id, p_brand AS cluster, p_size / 20.0 AS dur, round(p_retailprice % 100 / 100, 4) AS brightness, round(CAST(p_partkey % 97 AS DOUBLE) / 97, 2) AS sharpness, round(CAST(p_partkey % 31 AS DOUBLE) / 31, 2) AS colour FROM part),
f AS (SELECT * FROM p JOIN li USING (id)),
b AS (SELECT round(quantile_cont(motion_mean, CAST(0.05 AS DOUBLE)), 6) AS ml, round(quantile_cont(motion_mean, CAST(0.95 AS DOUBLE)), 6) AS mh, round(quantile_cont(motion_max, CAST(0.05 AS DOUBLE)), 6) AS xl, round(quantile_cont(motion_max, CAST(0.95 AS DOUBLE)), 6) AS xh FROM f),
s AS (SELECT *, round(CASE WHEN brightness < 0.06 OR brightness > 0.97 THEN 0.0 ELSE greatest(0.0, least(1.0, 1 - abs(brightness - 0.45) / 0.55)) END, 2) AS exposure,
  CASE WHEN dur < 0.4 THEN 'too_short' WHEN brightness < 0.06 THEN 'black' WHEN brightness > 0.97 THEN 'blown_out' WHEN sharpness < 0.02 AND colour < 0.05 THEN 'flat' END AS reject_reason FROM f, b),
lib AS (SELECT id, cluster, CAST(dur AS DOUBLE) AS dur, n_keyframes, round(greatest(0.0, least(1.0, (motion_mean - ml) / (mh - ml + 1e-9))), 4) AS intensity, round(greatest(0.0, least(1.0, (motion_max - xl) / (xh - xl + 1e-9))), 4) AS impact,
  exposure, round(0.42 * sharpness + 0.28 * colour + 0.30 * exposure, 4) AS quality, reject_reason, reject_reason IS NULL AS usable FROM s)
"""


@query(LIBRARY + "SELECT * FROM lib")
def library_inner(spark, sf_dir):
    return library(spark, sf_dir)


@query("SELECT lang, coalesce(CAST(toxic AS VARCHAR), 'untagged') AS tag, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2")
def library_tags_left(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return docs.join(labels, "doc_id", "left").groupBy("lang", F.coalesce(F.col("toxic").cast("string"), F.lit("untagged")).alias("tag")).agg(F.count("*").alias("n"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


@query("SELECT label, CAST(d AS INT) AS dim, round(avg(CAST(embedding[d + 1] AS DOUBLE)), 5) AS mean FROM embeddings, range(64) r(d) GROUP BY 1, 2")
def vector_mean(spark, sf_dir):
    return similarity.vector_mean(embeddings(spark, sf_dir), "label", "embedding")


HASHES = """
h AS (SELECT vec_id, label, CAST(CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END AS BIGINT) AS hash FROM (
  SELECT vec_id, label, list_sum(list_transform(range(64), lambda i: CASE WHEN e[i + 1] > m THEN CAST(power(2::DOUBLE, 63 - i) AS HUGEINT) ELSE 0::HUGEINT END))::HUGEINT AS u
  FROM (SELECT vec_id, label, e, list_aggregate(e, 'median') AS m FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)))),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b, CAST(bit_count(xor(a.hash, b.hash)) AS INT) AS distance FROM h a JOIN h b ON a.vec_id < b.vec_id AND bit_count(xor(a.hash, b.hash)) <= 18)
"""


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.sign_hash(embeddings(spark, sf_dir), "embedding").select(F.col("vec_id").alias("id"), "hash")


def held_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes written once, as several joins read them."""
    return written(hashes(spark, sf_dir), "hashes")


@query("WITH " + HASHES + "SELECT vec_id AS id, hash FROM h")
def sign_hash(spark, sf_dir):
    return hashes(spark, sf_dir)


@query("WITH " + HASHES + "SELECT a, b, distance FROM pairs")
def hamming_pairs(spark, sf_dir):
    return similarity.hamming_pairs(held_hashes(spark, sf_dir), NEAR)


CLUSTERS = "WITH RECURSIVE " + HASHES + """, both_ways AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs UNION SELECT vec_id, vec_id FROM h),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON e.a = r.b),
least AS (SELECT a AS id, min(b) AS component FROM reach GROUP BY 1),
clusters AS (SELECT id, CAST(dense_rank() OVER (ORDER BY component) - 1 AS INT) AS cluster FROM least)
"""


def numbered(values: DataFrame, by: str, into: str) -> DataFrame:
    """Distinct values with their rank from 0: in ranges that are numbered each on its own, from counts of the ranges before.

    Only one count a range comes together in a task.
    """
    ranged = written(values.repartitionByRange(by).withColumn("range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = F.row_number().over(Window.partitionBy("range").orderBy(by)) - 1
    return ranged.withColumn("own", own).join(F.broadcast(offsets), "range").select(by, (F.col("own") + F.col("offset")).cast("int").alias(into))


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate pairs, numbered by their first member; vectors without a partner are alone."""
    h = held_hashes(spark, sf_dir)
    found = connected_components(similarity.hamming_pairs(h, NEAR), written)
    labelled = h.join(found, h["id"] == found["node"], "left").select("id", F.coalesce("component", "id").alias("component"))
    return labelled.join(numbered(labelled.select("component").distinct(), "component", "cluster"), "component").select("id", "cluster")


@query(CLUSTERS + "SELECT id, cluster FROM clusters")
def near_dup_clusters(spark, sf_dir):
    return clusters(spark, sf_dir)


@query(CLUSTERS + "SELECT cluster, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM clusters GROUP BY 1 HAVING count(*) > 1")
def redundant_groups(spark, sf_dir):
    return clusters(spark, sf_dir).groupBy("cluster").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).filter("n > 1")


@query("""SELECT label, vec_id, before, round(list_inner_product(v, e) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(e, e)) + 1e-9), 4) AS cos FROM (
  SELECT label, vec_id, e, lag(vec_id) OVER w AS before, lag(e) OVER w AS v FROM (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) WINDOW w AS (PARTITION BY label ORDER BY vec_id)) WHERE before IS NOT NULL""")
def adjacent_cosine(spark, sf_dir):
    return similarity.adjacent(embeddings(spark, sf_dir), "label", "vec_id", "embedding")


@query("""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT vec_id, label, score FROM (SELECT q.vec_id, r.label, max(round(list_inner_product(q.e, r.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(r.e, r.e))), 4)) AS score
FROM v q JOIN v r ON r.vec_id % 10 = 0 WHERE q.vec_id % 10 <> 0 GROUP BY 1, 2) WHERE score >= 0.28""")
def ref_match(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    index = F.col("vec_id") % 10 == 0
    return similarity.best_reference(e.filter(~index), e.filter(index), 0.28)


@query("""WITH v AS (SELECT vec_id, list_transform(range(8), lambda h: round(list_sum(list_transform(embedding[h * 8 + 1 : h * 8 + 8], lambda x: abs(CAST(x AS DOUBLE)))), 6)) AS sums FROM embeddings)
SELECT vec_id, ['red', 'orange', 'yellow', 'green', 'cyan', 'blue', 'purple', 'pink'][list_position(sums, list_max(sums))] AS palette FROM v""")
def palette_argmax(spark, sf_dir):
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + F.abs(x.cast("double")))
    sums = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda h: F.round(total(F.slice("embedding", h * 8 + 1, 8)), 6))
    v = embeddings(spark, sf_dir).select("vec_id", sums.alias("sums"))
    return v.select("vec_id", F.element_at(F.array(*map(F.lit, HUES)), F.array_position("sums", F.array_max("sums")).cast("int")).alias("palette"))


@query(LIBRARY + """, slots AS (SELECT CAST(s AS INT) AS slot, s / 10.0 AS rel FROM range(11) r(s)),
scored AS (SELECT slot, id, round(0.9 * quality + 1.2 * (1 - abs(intensity - rel)) + 0.3 * impact, 6) AS score FROM lib, slots WHERE usable)
SELECT slot, id, score FROM (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY score DESC, id) AS n FROM scored) WHERE n = 1""")
def top1_scored(spark, sf_dir):
    """The best clip for each of eleven energies, the first in the library on ties."""
    lib = library(spark, sf_dir).filter("usable").withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(10))))
    score = F.round(0.9 * F.col("quality") + 1.2 * (1 - F.abs(F.col("intensity") - F.col("slot") / 10)) + 0.3 * F.col("impact"), 6)
    return lib.withColumn("score", score).groupBy("slot").agg(F.max_by("id", F.struct("score", -F.col("id"))).alias("id"), F.max("score").alias("score"))


@query(LIBRARY + """, short AS (SELECT id, impact, intensity, round(intensity * 10 + 6 * impact, 4) AS rank_score FROM lib WHERE usable ORDER BY impact DESC, intensity DESC, id LIMIT 16)
SELECT id, impact, intensity, rank_score FROM short WHERE rank_score > 2""")
def shortlist_topk(spark, sf_dir):
    short = library(spark, sf_dir).filter("usable").orderBy(F.desc("impact"), F.desc("intensity"), "id").limit(16)
    return short.select("id", "impact", "intensity", F.round(F.col("intensity") * 10 + 6 * F.col("impact"), 4).alias("rank_score")).filter("rank_score > 2")
