"""The operators' queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm import crosspoly, decontaminate, hostrep, jaccard, lexsearch, piecefst, runs, secrets, suffixdedup, tokencount, tokenstore, toxicity, warc
from chronoloom.llm.common import documents, pick, shared_dir

BYTE_BPE, WORD_BPE, PIECES = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pick(documents(spark, sf_dir), doc_id="doc_id", text="text")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(texts(spark, sf_dir)).drop("text")


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.encode_and_read(documents(spark, sf_dir), BYTE_BPE, end_id=2)


def op3_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return crosspoly.search(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.with_counts(texts(spark, sf_dir), WORD_BPE, limit=2048).drop("text")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.flag(texts(spark, sf_dir), table(spark, sf_dir, "benchmark"), width=10).drop("text")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links")


def fold(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    settings = toxicity.Settings()
    return toxicity.fit(*toxicity.training_sample(docs, labels.filter(fold() != 1), settings), settings)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.with_scores(texts(spark, sf_dir), model, threshold=0.7)
    return scored.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove(documents(spark, sf_dir), length=50)


def op9_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return hostrep.judge(pages, hostrep.outcomes_by_document(pages, table(spark, sf_dir, "labels")))


def op10_piece_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecefst.with_round_trip(texts(spark, sf_dir), PIECES).drop("text")


def op11_reversed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexsearch.search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), k=10)


def op12_boundary_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write(table(spark, sf_dir, "pages"), shared_dir(spark, "archives"), least=1000)
    return warc.read(manifest, payloads=False).select(
        warc.key_column("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), warc.key_column("refers_to").alias("refers_to")
    )


def planted_words(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of the contract: in documents whose id's hash is divisible by 10, a period from some word on."""
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text: the contract's words, joined by single spaces."""

    def run(batches):
        for batch in batches:
            made = [b" ".join(planted_words(runs.words_of(t or ""), d)).decode("utf-8") for d, t in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=["doc_id", "text"])

    return docs.mapInArrow(run, docs.schema)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.with_runs(planted(texts(spark, sf_dir)), least=24, times=3)
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat_ws("", r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))))
    better = lambda a, b: F.coalesce(b["length"] * a["period"] > a["length"] * b["period"], F.lit(True))
    best = F.aggregate("runs", F.lit(None).cast(runs.RUN.elementType), lambda a, b: F.when(better(a, b), b).otherwise(a))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return found.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_secret_scan, op2_token_shards, op3_cross_polytope, op4_token_counts, op5_decontaminate, op6_jaccard_join, op7_toxicity, op8_suffix_dedup, op9_host_reputation, op10_piece_transducer, op11_reversed_search, op12_boundary_chain, op13_periodic_runs)
    return {f.__name__: f for f in ops}


DECONTAMINATE_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[i + 1 : i + least(10, len(ws))], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(0, greatest(1, len(ws) - 9))) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(ws[i + 1 : i + n], ' ') AS win
  FROM (SELECT doc_id, ws, n, unnest(range(0, len(ws) - n + 1)) AS i FROM w, sizes WHERE len(ws) >= n)),
hits AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

REPUTATION_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
marks AS (SELECT doc_id, max(greatest(toxic, 1 - quality)) AS bad FROM labels GROUP BY doc_id),
outcomes AS (
  SELECT page_id, max(CAST(bad AS DOUBLE)) AS bad
  FROM p JOIN marks ON marks.doc_id = TRY_CAST(nullif(regexp_extract(path, '/([0-9]{1,18})', 1), '') AS BIGINT)
  WHERE page_id IS NOT NULL AND bad IS NOT NULL GROUP BY page_id),
hosts AS (
  SELECT host, CAST(count(bad) AS DOUBLE) AS n, coalesce(sum(bad), 0.0) AS k,
         CASE WHEN regexp_matches(name, '^[0-9.]+$') THEN name WHEN two IN (SUFFIX_LIST) THEN array_to_string(list_slice(labels, -3, -1), '.') ELSE two END AS domain,
         CASE WHEN regexp_matches(name, '^[0-9.]+$') THEN '' WHEN two IN (SUFFIX_LIST) THEN two ELSE labels[-1] END AS suffix
  FROM (SELECT *, string_split(name, '.') AS labels, array_to_string(list_slice(string_split(name, '.'), -2, -1), '.') AS two
        FROM (SELECT DISTINCT page_id, host, regexp_replace(string_split(host, '@')[-1], ':[0-9]*$', '') AS name FROM p)) LEFT JOIN outcomes USING (page_id) GROUP BY host, name, labels, two),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY suffix),
overall AS (SELECT coalesce(sum(k) / nullif(sum(n), 0), 0.0) AS m FROM suffixes),
s1 AS (
  SELECT coalesce(least(greatest(mean / greatest(spread - noise, 1e-6) - 1, 1.0), 1000.0), 1000.0) AS s FROM (
    SELECT sum(n * (k / n - m) * (k / n - m)) / sum(n) AS spread, sum(m * (1 - m)) / sum(n) AS noise, sum(n * m * (1 - m)) / sum(n) AS mean FROM suffixes, overall WHERE n > 0)),
suffix_rates AS (SELECT suffix, (k + s * m) / (n + s) AS m FROM suffixes, overall, s1),
d AS (SELECT domains.*, m FROM domains JOIN suffix_rates USING (suffix)),
s2 AS (
  SELECT coalesce(least(greatest(mean / greatest(spread - noise, 1e-6) - 1, 1.0), 1000.0), 1000.0) AS s FROM (
    SELECT sum(n * (k / n - m) * (k / n - m)) / sum(n) AS spread, sum(m * (1 - m)) / sum(n) AS noise, sum(n * m * (1 - m)) / sum(n) AS mean FROM d WHERE n > 0)),
domain_rates AS (SELECT domain, (k + s * m) / (n + s) AS m FROM d, s2),
h AS (SELECT hosts.*, m FROM hosts JOIN domain_rates USING (domain)),
s3 AS (
  SELECT coalesce(least(greatest(mean / greatest(spread - noise, 1e-6) - 1, 1.0), 1000.0), 1000.0) AS s FROM (
    SELECT sum(n * (k / n - m) * (k / n - m)) / sum(n) AS spread, sum(m * (1 - m)) / sum(n) AS noise, sum(n * m * (1 - m)) / sum(n) AS mean FROM h WHERE n > 0)),
posterior AS (SELECT host, (k + s * m) / (n + s) AS rate, n + s AS weight FROM h, s3),
low AS (SELECT host, rate - 1.645 * sqrt(rate * (1 - rate) / (weight + 1)) AS low FROM posterior),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
  FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN low > 0.3 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN low USING (host)
"""


REPUTATION_SQL = REPUTATION_SQL.replace("SUFFIX_LIST", ", ".join(f"'{s}'" for s in hostrep.SUFFIXES))


SEARCH_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ts FROM documents),
b AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark),
asked AS (SELECT item_id, term, count(*) AS times FROM b GROUP BY 1, 2),
whole AS (SELECT count(*) FILTER (len(ts) > 0) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM d),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM d) SEMI JOIN asked USING (term) GROUP BY 1, 2, 3),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), whole),
parts AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))) AS part FROM tf JOIN weights USING (term), whole),
scores AS (SELECT item_id, doc_id, CAST(sum(times * part) AS BIGINT) AS score FROM asked JOIN parts USING (term) GROUP BY 1, 2),
ranks AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranks WHERE rank <= 10
"""

ARCHIVE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
g AS (SELECT *, CASE WHEN strlen(payload) >= 1000 THEN max(page_id) OVER (PARTITION BY payload) END AS original FROM p)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest,
       CASE WHEN original <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN original <> page_id THEN original END AS refers_to
FROM g
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_decontaminate": DECONTAMINATE_SQL, "op9_host_reputation": REPUTATION_SQL, "op11_reversed_search": SEARCH_SQL, "op12_boundary_chain": ARCHIVE_SQL}
