import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from chronoloom.llm import runs
from chronoloom.llm.queries import op13_periodic_runs


def brute(words, least=24, times=3):
    """Every period, every pair of words."""
    n, seen = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(least, times * q):
                seen.setdefault((start, i - start + q), q)
    return sorted((s, n, q) for (s, n), q in seen.items())


def made(rng):
    """Words with periods planted in periods."""
    n, k = rng.choice([0, 1, 5, 23, 24, 25, 60, 100, 300, 700]), rng.choice([1, 2, 3, 5, 50, 1000])
    words = [b"%d" % rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randrange(4) if n > 2 else 0):
        a = rng.randrange(n)
        p, end = rng.randrange(1, max(2, (n - a) // 3 + 1)), rng.randrange(a, n) + 1
        inner = rng.randrange(1, max(2, p // 3 + 1)) if rng.random() < 0.4 else p
        for i in range(a, min(a + p, n)):
            words[i] = words[a + (i - a) % inner]
        for i in range(a, end):
            words[i] = words[a + (i - a) % p]
    return words


@pytest.mark.parametrize("least,times", [(24, 3), (1, 3), (30, 4)])
def test_random_documents_in_blocks(least, times):
    rng = random.Random(least)
    total = 0
    for _ in range(40):
        docs = [made(rng) for _ in range(rng.randrange(1, 10))]
        want = [brute(d, least, times) for d in docs]
        assert runs.runs_of(docs, least, times) == want
        total += sum(map(len, want))
    assert total > 20


def test_structured_words():
    f, g = [b"a"], [b"b"]
    while len(f) < 900:
        f, g = g + f, g
        f, g = f + g, f
    thue = [b"%d" % (bin(i).count("1") % 2) for i in range(800)]
    for words in (f[:1000], thue, [b"a"] * 900, [b"a", b"b"] * 300 + [b"a"] * 99, ([b"a"] * 50 + [b"b"]) * 12, (([b"a"] * 7 + [b"b"]) * 5 + [b"c"]) * 12, ([b"x"] * 29 + [b"y"] * 30 + [b"z"]) * 4):
        assert runs.runs_of([words]) == [brute(words)]


def test_colliding_hashes_only_cost_time(monkeypatch):
    """With hashes of four values every context meets every other; the result stays."""
    true = runs.mixed
    monkeypatch.setattr(runs, "mixed", lambda x: true(x) & np.uint64(3))
    rng = random.Random(8)
    for _ in range(10):
        words = made(rng)[:120]
        assert runs.runs_of([words]) == [brute(words)]


def test_periods_of_large_scales():
    rng = random.Random(2)
    for q in (4000, 4095, 4096, 4097):
        unit = [b"%d" % rng.randrange(9) for _ in range(q)]
        words = [b"-"] + (unit * 4)[: 3 * q + 7] + [b"+"]
        assert (1, 3 * q + 7, q) in runs.runs_of([words])[0]


def expected(doc_id, text):
    words = (text or "").encode().split()
    h, n = (zlib.crc32(str(doc_id).encode()), len(words)) if doc_id is not None else (1, 0)
    if doc_id is None:
        words = (text or "").encode().split()
    elif h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found, drop = brute(words), set()
    for s, m, q in found:
        drop |= set(range(s + q, s + m))
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else None
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *four, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def order(r):
    return tuple((x is None, str(x)) for x in r)


def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in op13_periodic_runs(spark, sf).collect()]
    assert sorted(got, key=order) == sorted((expected(*r) for r in rows), key=order)
    assert sum(r[1] > 0 for r in got) >= 5


def test_query_on_odd_rows(spark, tmp_path):
    line = "a b\tc\nd\x0be\x0cf\rg\x00 h\u00a0i\u2003j "
    rows = [(1, None), (2, ""), (3, " \n"), (4, line * 30), (4, line * 30), (None, line * 9), (5, "é " * 24), (6, "é " * 23), (7, "A a " * 12), (8, "x y z " * 3000), (30, "k " * 5), (14, "q r s t " * 50)]
    table = spark.createDataFrame([(t, i, "n", 1) for i, t in rows], "text string, doc_id long, runs string, Collapsed int")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in op13_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=order) == sorted((expected(*r) for r in rows), key=order)


def test_operator_keeps_columns_and_empty_tables(spark):
    table = spark.createDataFrame([("a b " * 20, "n", 5)], "text string, RUNS string, other int")
    got = runs.with_runs(table)
    assert got.columns == ["text", "other", "n_words", "runs", "collapsed"]
    row = got.first()
    assert [tuple(r) for r in row["runs"]] == [(0, 40, 2)] and row["collapsed"] == "a b" and row["n_words"] == 40 and row["other"] == 5
    assert runs.with_runs(table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        runs.runs_of([[b"a"]], times=2)
