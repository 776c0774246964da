import math
import re
from collections import Counter

from chronoloom.llm import lexsearch

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k):
    """The formula of the module's docstring, document by document."""
    terms = [(i, Counter(x.translate(LOWER) for x in TERM.findall(t or ""))) for i, t in docs]
    some, total = sum(1 for _, c in terms if c), sum(sum(c.values()) for _, c in terms)
    df = Counter(x for _, c in terms for x in c)
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(x.translate(LOWER) for x in TERM.findall(t or ""))
    out = []
    for i, want in asked.items():
        scored = []
        for d, c in terms:
            m = 100 - 75 + (75 * sum(c.values()) * some) // max(total, 1)
            score = sum(n * math.floor(1000 * math.log((2 * some + 2) / (2 * df[x] + 1))) * ((1_000_000_000 * c[x]) // (1000 * c[x] + 8 * m)) for x, n in want.items() if c[x])
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(i, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return out


def key(r):
    return tuple((x is None, x or 0) for x in r)


def check(spark, docs, items, k, **settings):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, score string, Rank int").repartition(3)
    b = spark.createDataFrame([(t, i, 2.0) for i, t in items], "text string, item_id long, score double")
    got = sorted((tuple(r) for r in lexsearch.search(d, b, k, **settings).select("item_id", "rank", "doc_id", "score").collect()), key=key)
    assert got == sorted(brute(docs, items, k), key=key)
    return got


ODD = [(1, None), (2, ""), (3, "Alpha beta ALPHA"), (4, "alpha beta alpha"), (None, "alpha beta alpha"), (5, "ÄÖ äö été_x 42"), (6, "alpha " * 40000), (7, "gamma-delta"), (7, "gamma-delta"), (8, "!!! ,,,"), (9, "alpha")]


def test_ties_nulls_repeats_long_texts_and_clashing_names(spark):
    items = [(1, "alpha beta"), (2, "Alpha ALPHA alpha"), (None, "gamma"), (3, "nothing here"), (4, None), (5, ""), (1, "delta äö"), (6, "beta gamma 42")]
    got = check(spark, ODD, items, 3)
    assert {r[0] for r in got} == {1, 2, None, 6}
    assert check(spark, ODD, items, 100)


def test_blocks_give_what_one_gives(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert check(spark, docs, items, 10) == check(spark, docs, items, 10, block_postings=200, block_items=7)


def test_empty_sides(spark):
    assert check(spark, [], [(1, "a")], 3) == [] and check(spark, [(1, "a")], [], 3) == [] and check(spark, [(1, "a")], [(1, None)], 3) == []


def test_heaps_stay_small_and_whole(monkeypatch):
    """Many offers with few left waiting: the same as one sort."""
    import numpy as np

    rng = np.random.default_rng(4)
    heaps, rows = lexsearch.Heaps(5, 3), []
    heaps.most = 10
    for b in range(40):
        scores, ids = rng.integers(0, 9, (20, 5)), rng.integers(0, 500, 20)
        heaps.offer(scores, ids, np.zeros(20, dtype=np.int64))
        assert heaps.waiting <= 10 or b == 0
        rows += [(i, -scores[d, i], ids[d]) for d in range(20) for i in range(5) if scores[d, i] > 0]
    item, score, ids, _ = heaps.best()
    want = [r for i in range(5) for r in sorted(x for x in rows if x[0] == i)[:3]]
    assert list(zip(item, -score, ids, strict=True)) == want
