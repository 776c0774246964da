"""URL filters by empirical-Bayes host reputation, in DataFrame functions only.

Labelled page outcomes (bad or not) are counted by host.  Each host's rate is
shrunk towards its registered domain's, that towards its suffix's, and that
towards the overall rate, through beta priors whose strength is estimated from
the spread of the rates one level down (method of moments).  A host is blocked
if the lower bound of its posterior, by the normal approximation (mean less
``z`` standard deviations), exceeds ``block_rate``.  Rules come first.

Counts are summed by host before anything is joined, so one host may hold any
share of the pages; the table of hosts is joined, and Spark broadcasts it only
below its own size threshold, else splits skewed partitions.

Edge cases: a null url or one without ``://`` has an empty host and path and
is judged as the host ''; a host without outcomes gets its prior; repeated
pages are judged each on their own and their outcomes count once a page_id;
pages with null ids carry no outcome; without any outcome nothing is blocked
but by rule; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import pick, written

# Host, path, verdict.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(F.coalesce(url, F.lit(""))), "^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(F.coalesce(url, F.lit(""))), "^[^/?#]*([^?#]*)", 1)


# Public suffixes of two labels that are told from registered domains; a bounded list, to be given whole where more are wanted.
SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "org.au", "org.uk", "github.io", "blogspot.com")


def named(host: Column) -> Column:
    """The host without user name and port, which are no part of a domain."""
    return F.regexp_replace(F.substring_index(host, "@", -1), ":[0-9]*$", "")


def domain_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The registered domain: one label more than the suffix; an address in digits is its own."""
    name = named(host)
    two = F.substring_index(name, ".", -2)
    return F.when(name.rlike("^[0-9.]+$"), name).when(two.isin(*suffixes), F.substring_index(name, ".", -3)).otherwise(two)


def suffix_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    name = named(host)
    two = F.substring_index(name, ".", -2)
    return F.when(name.rlike("^[0-9.]+$"), "").when(two.isin(*suffixes), two).otherwise(F.substring_index(name, ".", -1))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # a longer rule overrides
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def strength(level: DataFrame, n: str, k: str, prior: str) -> DataFrame:
    """One row: the beta prior's strength that explains the spread of ``k / n`` around ``prior``, within 1 and 1000."""
    rate = F.col(k) / F.col(n)
    spread = F.sum(F.col(n) * (rate - F.col(prior)) * (rate - F.col(prior))) / F.sum(n)
    noise = F.sum(F.col(prior) * (1 - F.col(prior))) / F.sum(n)
    mean = F.sum(F.col(n) * F.col(prior) * (1 - F.col(prior))) / F.sum(n)
    agg = level.filter(F.col(n) > 0).agg(spread.alias("spread"), noise.alias("noise"), mean.alias("mean"))
    between = F.greatest(F.col("spread") - F.col("noise"), F.lit(1e-6))
    return agg.select(F.coalesce(F.least(F.greatest(F.col("mean") / between - 1, F.lit(1.0)), F.lit(1000.0)), F.lit(1000.0)).alias("strength"))


def shrunk(level: DataFrame, prior: str, into: str) -> DataFrame:
    """Posterior mean ``into`` and its beta's total weight; ``level`` has n, k and the prior mean."""
    s = F.broadcast(strength(level, "n", "k", prior))  # one row
    return (
        level.crossJoin(s)
        .withColumn(into, (F.col("k") + F.col("strength") * F.col(prior)) / (F.col("n") + F.col("strength")))
        .withColumn("weight", F.col("n") + F.col("strength"))
        .drop("strength")
    )


def reputations(pages: DataFrame, outcomes: DataFrame, z: float = 1.645, public: Sequence[str] = SUFFIXES) -> DataFrame:
    """One row a host: n, k, rate (posterior mean) and low (lower bound).

    ``pages`` has page_id, host; ``outcomes`` has page_id, bad (0 or 1).
    """
    marks = pick(outcomes, page_id="page_id", bad="bad").filter("page_id is not null and bad is not null").groupBy("page_id").agg(F.max(F.col("bad").cast("double")).alias("bad"))
    once = pages.groupBy("page_id", "host").agg(F.lit(1).alias("one"))
    hosts = once.join(marks, "page_id", "left").groupBy("host").agg(F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0.0)).alias("k"))
    # a row a host, written, as three levels read it
    hosts = written(hosts.withColumns({"domain": domain_of(F.col("host"), public), "suffix": suffix_of(F.col("host"), public)}), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    overall = suffixes.agg(F.coalesce(F.sum("k") / F.nullif(F.sum("n"), F.lit(0.0)), F.lit(0.0)).alias("overall"))
    suffixes = shrunk(suffixes.crossJoin(F.broadcast(overall)), "overall", "suffix_rate").select("suffix", "suffix_rate")
    domains = shrunk(domains.join(suffixes, "suffix"), "suffix_rate", "domain_rate").select("domain", "domain_rate")
    hosts = shrunk(hosts.join(domains, "domain"), "domain_rate", "rate")
    sd = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("weight") + 1))
    return hosts.select("host", "n", "k", "rate", (F.col("rate") - z * sd).alias("low"))


def judge(pages: DataFrame, outcomes: DataFrame, block_rate: float = 0.3, z: float = 1.645, rules: Sequence[tuple[str, str, str]] = RULES, public: Sequence[str] = SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict for each page.  ``public`` names suffixes of two labels under which anybody may register."""
    urls = pick(pages, page_id="page_id", url="url").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = reputations(urls, outcomes, z, public)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("low") > block_rate, F.lit("block")).otherwise(F.lit("allow"))
    return urls.join(known.select("host", "low"), "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"))


def outcomes_by_document(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Outcomes of pages whose path names a labelled document by number: bad if it is toxic or of low quality."""
    number = F.expr("try_cast(regexp_extract(path, '/([0-9]{1,18})', 1) AS BIGINT)")
    urls = pick(pages, page_id="page_id", url="url").select("page_id", path_of(F.col("url")).alias("path")).select("page_id", number.alias("doc_id"))
    bad = F.greatest(F.col("toxic"), 1 - F.col("quality"))  # null only if both are
    marks = pick(labels, doc_id="doc_id", toxic="toxic", quality="quality").groupBy("doc_id").agg(F.max(bad).alias("bad"))
    return urls.join(marks, "doc_id").select("page_id", "bad")
