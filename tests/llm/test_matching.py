import hashlib
import random
import re
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest

from chronoloom.llm import crosspoly, decontaminate, jaccard, queries, suffixdedup

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_flags(texts, items, width=10):
    out = []
    for text in texts:
        words, hit, found = WORD.findall(lower(text)), set(), set()
        for item, t in items:
            w = WORD.findall(lower(t))
            n = min(width, len(w))
            for i in range(max(1, len(w) - width + 1)) if w else ():
                for j in range(len(words) - n + 1):
                    if words[j : j + n] == w[i : i + n]:
                        hit |= set(range(j, j + n))
                        found |= {item} - {None}
        ids = ",".join(sorted(map(str, found)))
        out.append((len(words), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return out


def test_decontaminate(spark):
    rng = random.Random(3)
    vocabulary = ["a", "b", "É", "c1", "d\x85e", "f"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) for _ in range(60)] + [None, "", "A-B a;b"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 14)))) for i in range(12)] + [(3, "a b"), (70, None), (None, "f f")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, N_HIT int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_flags(texts, items)
    for size in (1 << 20, 5):  # one automaton, or one a few items
        got = decontaminate.flag(docs, bench, block_words=size).orderBy("doc_id").collect()
        assert [(r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got] == want
    assert decontaminate.flag(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.flag(docs.limit(0), bench).count() == 0
    two = spark.createDataFrame([(1, "b c1"), (2, "É a")], "item_id long, text string")
    for size in (1 << 20, 1):
        cut = decontaminate.without_spans(spark.createDataFrame([(1, "x B, c1;y é É\na"), (2, None)], "doc_id long, text string"), two, block_words=size).orderBy("doc_id").collect()
        assert [r.text for r in cut] in (["x ;y é ", ""], ["x , ;y é \n", ""])


def test_memory_of_a_large_benchmark():
    """20 MB of benchmark text: an automaton of one block at a time, below 1 GB."""
    code = """
import random, resource, pickle, zlib
from chronoloom.llm import decontaminate as d
rng = random.Random(1)
class Sent:
    def __init__(self, value): self.value = value
sent, text = [], []
vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(60000)]
for _ in range(3):
    items = [(i, " ".join(rng.choices(vocabulary, k=50))) for i in range(d.BLOCK_WORDS // 50)]
    text.append(items[7][1])
    sent.append(Sent(zlib.compress(pickle.dumps(items))))
made = sum(len(t) for _, t in items)
sent = [Sent(bytes(sent[i % 3].value)) for i in range((20 << 20) // made + 1)]
n = 0
for k, one in enumerate(d.in_turn(sent, 10)()):
    n += one.scan(d.words_of(text[k]))[0].sum() == 50
    if k == 2: break  # memory is that of one block, however many
assert n == 3 and len(sent) > 10
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, check=True)
    assert int(done.stdout.split()[-1]) < 1000


def test_spans_map_to_the_original():
    built = decontaminate.Patterns([(1, "zwei drei")], 10)
    text = "Éins ZWEI,\n drei vier"
    assert [text[a:b] for a, b in decontaminate.spans_in_text(text, built)] == ["ZWEI,\n drei"]


def plain_shingles(text, n=5):
    """Tuples of ``n`` words, by a loop over characters: words are runs of ASCII letters, digits and all beyond ASCII, in lower case."""
    words, word = [], ""
    for c in (text or "").lower() + " ":
        if c.isascii() and not c.isalnum():
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def test_shingles_equal_plain_ones(spark, sf):
    texts = [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + ["", "a", "A b\tc-d_e f", "É é É é É é É", "x\u00a0y z\u2003w v u t", "1 2 3 4 5 6 " * 50, "!?"]
    sets = jaccard.shingle_sets([t or "" for t in texts])
    for t, got in zip(texts, sets, strict=True):
        want = plain_shingles(t)
        assert len(got) == len(want) and list(got) == sorted(set(got.tolist()))
    owners: dict = {}
    for k, got in enumerate(sets):
        for h in got.tolist():
            owners.setdefault(h, set()).add(k)
    plain: dict = {}
    for k, t in enumerate(texts):
        for s in plain_shingles(t):
            plain.setdefault(s, set()).add(k)
    assert sorted(map(sorted, owners.values())) == sorted(map(sorted, plain.values()))


def brute_classes(rows, threshold=0.8):
    """rows: (doc_id, text); classes by all pairs of plain shingle sets."""
    sets = [plain_shingles(t) for _, t in rows]
    n = len(rows)
    parent, links = list(range(n)), [0] * n

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i in range(n):
        least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return {rows[i][0]: (least[find(i)], links[i]) for i in range(n)}


def edited(rng, words, share):
    return [rng.choice(words) if rng.random() < share else w for w in words]


def corpus(seed=5, groups=25):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = []
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 30, 120, 600]))]
        for _ in range(rng.choice([1, 2, 8])):
            rows.append((len(rows), " ".join(edited(rng, base, rng.choice([0, 0.005, 0.02, 0.05])))))
    big = [rng.choice(vocabulary) for _ in range(80)]
    rows += [(len(rows) + i, " ".join(edited(rng, big, 0.01))) for i in range(60)]
    return rows + [(len(rows), ""), (len(rows) + 1, "   "), (len(rows) + 2, "one two"), (len(rows) + 3, "One, two")]


def test_jaccard_classes_equal_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_classes(rows)
    for small, block in ((1000, 512), (8, 7)):  # as it is, and with every bucket and group dealt out in blocks
        got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.classes(docs, small=small, block=block, target=0.99999).collect()}
        assert got == want


def test_jaccard_finds_truncated_copies(spark):
    """One set inside the other, at the threshold and a little above, with the parameters of production."""
    rng = np.random.default_rng(8)
    rows, n = [], 400
    for i in range(n):
        words = [f"w{v}" for v in rng.integers(0, 1 << 40, 604)]  # 600 shingles
        kept = 480 + i % 31  # of which so many stay: 0.8 to 0.85
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[: kept + 4]))]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: (d - d % 2, 1) for d, _ in rows}


def test_jaccard_runs_for_contained_sets():
    """In split buckets both levels must meet; a set of 0.8 n inside one of n has one common token a level on average."""
    once = (1 - (1 - 1 / (0.8 * 1000)) ** 800) ** 2
    assert (1 - once) ** jaccard.runs_needed(0.999, 0.8) <= 0.001


def test_jaccard_edge_cases(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, "A b, c d e f", "y"), (3, None, "z"), (None, "a b c d e f", "n")], "doc_id long, text string, sid string")
    got = sorted(jaccard.classes(docs).select("doc_id", "class_id", "n_links").collect(), key=str)
    assert [tuple(r) for r in got if r.doc_id is not None] == [(1, 1, 2), (1, 1, 2), (2, 1, 2), (3, 3, 0)]
    stays = jaccard.one_of_each(docs)
    assert stays.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in stays.collect()))) == ["1", "3", "None"]
    assert jaccard.classes(docs.limit(0)).count() == 0


def brute_removed(rows, n=50):
    first = {}
    for doc, text in rows:
        if doc is not None:
            b = (text or "").encode()
            for i in range(len(b) - n + 1):
                w = b[i : i + n]
                first[w] = min(first.get(w, doc), doc)
    out = []
    for doc, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        if doc is not None:
            for i in range(len(b) - n + 1):
                if first[b[i : i + n]] < doc:
                    gone[i : i + n] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(gone) else 0
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((doc, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check_removed(spark, rows, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffixdedup.remove(docs, **kw).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_removed(rows)


def test_suffix_dedup_equals_all_windows(spark):
    rng = random.Random(11)
    passages = ["".join(rng.choice("abc é\0") for _ in range(rng.randint(40, 200))) for _ in range(12)]
    rows = []
    for i in range(120):
        parts = [rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 90))) for _ in range(rng.randint(0, 5))]
        rows.append((rng.randint(0, 90), "".join(parts)))
    rows += [(5, "x" * 400), (6, "x" * 70), (7, "ab" * 100), (None, passages[0] * 2), (3, None), (200, passages[0] + passages[1]), (200, passages[0] + passages[1])]
    check_removed(spark, rows)
    check_removed(spark, rows, block_bytes=2000, batch=500)


def test_suffix_dedup_on_documents(spark, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet")[["doc_id", "text"]]
    rows = [(int(a), b) for a, b in docs.itertuples(index=False)][:120]
    check_removed(spark, rows, block_bytes=1 << 16, batch=1 << 12)


def test_shingles_of_long_texts_in_slices(monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["ab", "É", "c1", "x" * 40]) for _ in range(rng.randint(0, 300))) for _ in range(20)]
    want = jaccard.shingle_sets(texts)
    monkeypatch.setattr(jaccard, "SLICE", 64)
    assert all(np.array_equal(a, b) for a, b in zip(want, jaccard.shingle_sets(texts), strict=True))


def test_one_of_each_with_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, "a", 1, 1), (2, text, "b", 2, 2), (2, text, "b", 2, 2), (3, None, "c", 3, 3), (None, text, "d", 4, 4), (5, text + " more", "e", 5, 5)]
    df = spark.createDataFrame(rows, "DOC_ID long, text string, _sid string, _stays int, _set int")
    got = jaccard.one_of_each(df)
    assert got.columns == df.columns and sorted(r._sid for r in got.collect()) == ["a", "c", "d"]


def test_suffix_levels_are_geometric():
    rng = np.random.default_rng(0)
    text = rng.integers(0, 256, 30 * 5000, dtype=np.uint8)
    levels = suffixdedup.SuffixLevels(text, 50)
    for i in range(30):
        levels.add(np.arange(100) * 50 + i * 5000, np.full(100, i))
    assert len(levels.levels) <= 8 and sum(len(at) for _, at in levels.levels) == 3000


@pytest.mark.parametrize("alphabet", [2, 256])
def test_suffix_levels_in_batches_equal_one_batch(alphabet):
    """Twenty batches, of windows that repeat within and across batches, with null bytes and heads in common: scans of older levels lose nothing."""
    rng = np.random.default_rng(alphabet)
    pool = rng.integers(0, alphabet, (300, 50), dtype=np.uint8)
    pool[:100, :30] = 0
    text = pool[rng.integers(0, 300, 2000)].ravel()
    owners, positions = np.sort(rng.integers(0, 400, 2000)), np.arange(2000) * 50
    whole = suffixdedup.SuffixLevels(text, 50).add(positions, owners)
    levels, out, seen = suffixdedup.SuffixLevels(text, 50), [], 0
    for cut in [*np.searchsorted(owners, np.arange(20, 400, 20)), 2000]:
        out.append(levels.add(positions[seen:cut], owners[seen:cut]))
        seen = cut
    first: dict = {}
    for at, owner in zip(positions.tolist(), owners.tolist(), strict=True):
        first.setdefault(text[at : at + 50].tobytes(), owner)
    want = [first[text[at : at + 50].tobytes()] < owner for at, owner in zip(positions.tolist(), owners.tolist(), strict=True)]
    assert np.concatenate(out).tolist() == want == whole.tolist()
    assert len(levels.levels) > 1 and sum(len(at) for _, at in levels.levels) == len(first)


def test_suffix_levels_are_scanned_on_a_given_table(spark, sf, monkeypatch):
    """Batches of the production size over the smallest table's text: older levels are scanned and merged."""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    text = np.frombuffer("".join(t or "" for _, t in rows).encode(), dtype=np.uint8)
    scans = []
    levels = suffixdedup.SuffixLevels(text, 50)
    true = suffixdedup.SuffixLevels.scan
    monkeypatch.setattr(suffixdedup.SuffixLevels, "scan", lambda self, *a: scans.append(1) or true(self, *a))
    for a in range(0, 6 << 14, 1 << 14):
        levels.add(np.arange(a, a + (1 << 14)), np.full(1 << 14, a))
    assert len(scans) >= 5 and len(levels.levels) <= 6


def test_suffix_dedup_in_several_levels(spark):
    """Few digits and small buckets: packets go through units, and answers come back through them."""
    rng = random.Random(5)
    passages = ["".join(rng.choice("abc d") for _ in range(rng.randint(60, 200))) for _ in range(6)]
    rows = [(i, "".join(rng.choice(passages) if rng.random() < 0.4 else "".join(rng.choice("abcdefgh ") for _ in range(60)) for _ in range(4))) for i in range(150)]
    rows += [(i, passages[0]) for i in range(500, 560)]
    check_removed(spark, rows, block_bytes=3000, bucket_bytes=500, batch=300, fan=4)


def test_suffix_dedup_sends_packets_once(spark, monkeypatch):
    """Digits grow with the text, so that packets of 14 kB in buckets of 40 bytes aren't stored for a second level, and tables hold no texts."""
    rng = random.Random(6)
    passages = ["".join(rng.choice("abc d") for _ in range(150)) for _ in range(4)]
    rows = [(i, "".join(rng.choice(passages) if rng.random() < 0.4 else "".join(rng.choice("abcdefgh ") for _ in range(60)) for _ in range(2))) for i in range(80)]
    assert 256 * 40 < sum(len(t) for _, t in rows) < 4096 * 40
    check_removed(spark, rows, block_bytes=3000, bucket_bytes=40, fan=256)  # two levels: units whose entries nobody else has
    tables, true = {}, suffixdedup.written
    monkeypatch.setattr(suffixdedup, "written", lambda df, name: tables.setdefault(name, df.columns) and true(df, name))
    check_removed(spark, rows, block_bytes=3000, bucket_bytes=40)
    assert "packets" not in tables and tables["blocks"] == ["block", "path", "place", "packed", "n", "size"]


def test_suffix_dedup_edge_cases(spark):
    schema = "doc_id long, text string, BLOCK int, size int"
    assert suffixdedup.remove(spark.createDataFrame([], schema)).count() == 0
    rng = np.random.default_rng(1)
    long = rng.integers(97, 123, 3 << 20, dtype=np.uint8).tobytes().decode()
    rows = [(1, long, 1, 1), (2, long[1000:1_500_000] + "#" + long[-70:], 1, 1), (None, long[:200], 1, 1), (3, None, None, None)]
    got = {r.doc_id: r for r in suffixdedup.remove(spark.createDataFrame(rows, schema)).collect()}
    kept = {1: long, 2: "#", None: long[:200], 3: ""}
    assert {k: r.kept_sha256 for k, r in got.items()} == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in kept.items()}
    assert (got[2].n_removed, got[2].n_spans) == (1_499_070, 2)


def brute_nearest(ids, x, queries, k):
    out = {}
    for q in queries:
        s = [(-float((x[i] * x[q]).sum()), ids[i]) for i in range(len(ids)) if ids[i] != ids[q]]
        out[ids[q]] = sorted(s)[:k]
    return out


def test_nearest_recall_and_order(spark, sf):
    e = pd.read_parquet(f"{sf}/embeddings.parquet")
    ids, x = e.vec_id.tolist(), np.stack(e.embedding.values).astype(float)
    got = queries.op3_cross_polytope(spark, sf).toPandas()
    want = brute_nearest(ids, x, [i for i, v in enumerate(ids) if v % 20 == 0], 20)
    hits = sum(len(set(got[got.query_id == q].vec_id) & {i for _, i in w}) for q, w in want.items())
    assert hits / (20 * len(want)) >= 0.9
    for q, part in got.groupby("query_id"):
        part = part.sort_values("rank")
        assert part["rank"].tolist() == list(range(1, 21)) and q not in set(part.vec_id)
        keys = list(zip(-part.score, part.vec_id, strict=True))
        assert keys == sorted(keys)
    assert np.allclose(got.score, [(x[ids.index(a)] * x[ids.index(b)]).sum() for a, b in zip(got.query_id, got.vec_id, strict=True)], atol=1e-12)


def test_nearest_edge_cases(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=8) * (1 + i % 3)).tolist(), "x") for i in range(200)] + [(i, [1.0] * 8, "x") for i in range(200, 400)]
    rows += [(500, None, "x"), (501, [0.0] * 8, "x"), (502, [float("nan")] * 8, "x"), (503, [1.0, None] * 4, "x"), (504, [float("inf")] + [0.0] * 7, "x"), (505, [1.0], "x"), (None, [1.0] * 8, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, ID string")
    got = crosspoly.search(df, df.filter("vec_id % 20 = 0"), k=20, tables=3, probes=1000, block=64).toPandas()  # every bucket probed: exact
    ids, x = [r[0] for r in rows[:400]], np.array([r[1] for r in rows[:400]])
    want = brute_nearest(ids, x, [i for i in range(400) if i % 20 == 0], 20)
    for q, w in want.items():
        assert got[got.query_id == q].sort_values("rank").vec_id.tolist() == [i for _, i in w]
    assert crosspoly.search(df.limit(0), df).count() == 0
    few = crosspoly.search(df.filter("vec_id < 3"), df.filter("vec_id = 0"), probes=1000)
    assert sorted(few.toPandas().vec_id) == [1, 2]


def recall(spark, x, k=20):
    """Of the nearest k with the parameters of production, for every 20th vector."""
    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(len(x)), "embedding": x.tolist()}))
    got = crosspoly.search(df, df.filter("vec_id % 20 = 0"), k=k).toPandas()
    mine = np.arange(0, len(x), 20)
    score = x[mine] @ x.T
    score[np.arange(len(mine)), mine] = -np.inf
    deep = min(k, len(x) - 1)
    want = np.argsort(-score, axis=1, kind="stable")[:, :deep]
    found = {q: set(part.vec_id) for q, part in got.groupby("query_id")}
    return sum(len(found[q] & set(w.tolist())) for q, w in zip(mine.tolist(), want, strict=True)) / want.size



@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_nearest_recall_and_candidates_on_the_given_tables(spark, size):
    """The hashed path on ``embeddings``; what share of the rows it ranks is printed by the next test's model."""
    e = pd.read_parquet(f"/root/testdata/{size}/embeddings.parquet")
    x = np.stack(e.embedding.values).astype(float)[np.argsort(e.vec_id.values)]
    assert e.vec_id.min() == 0 and e.vec_id.max() == len(x) - 1
    assert recall(spark, x) >= 0.9


def share_ranked(x, k=20, tables=24, seed=3):
    """Of all rows, those that the average query meets in some table: the hashing in numpy."""
    m = crosspoly.rotations(len(x), 2 * x.shape[1])
    probes = crosspoly.probes_for(x[np.random.default_rng(0).permutation(len(x))[: crosspoly.SAMPLE]], len(x), k, tables, m, seed, 0.95)
    asked, met = x[::80], np.zeros((len(x[::80]), len(x)), dtype=bool)
    for t in range(tables):
        both = np.ones_like(met)
        for r in range(m):
            y = crosspoly.signed(crosspoly.rotated(x, t * m + r, seed))
            mine = np.zeros((len(asked), y.shape[1]), dtype=bool)
            np.put_along_axis(mine, np.argsort(-y[::80], axis=1)[:, :probes], True, axis=1)
            both &= mine[:, y.argmax(axis=1)]
        met |= both
    return met.mean()


def test_nearest_candidates_stay_few_as_vectors_grow(spark):
    """20,000 directions without structure, the hardest case: recall, and less than a fifth of the rows ranked; buckets have more rotations in larger tables."""
    x = np.random.default_rng(9).normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert share_ranked(x) < 0.2
    assert recall(spark, x) >= 0.9
    assert [crosspoly.rotations(n, 128) for n in (500, 2000, 100_000, 200_000, 10**9)] == [1, 2, 2, 3, 4]


def test_nearest_recall_with_unequal_norms(spark):
    rng = np.random.default_rng(1)
    unit = rng.normal(size=(3000, 64))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    one = np.ones(3000)
    for norms in (np.r_[10, one[1:]], rng.uniform(0.5, 1.5, 3000), np.exp(rng.normal(0, 0.5, 3000))):
        assert recall(spark, unit * norms[:, None]) >= 0.95


def test_nearest_of_extreme_components_and_repeated_ids(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e200, -1e200]), (2, [1e-200, 2e-200]), (3, [1.0, 2.0]), (20, [0.0, 1.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = crosspoly.search(df, df.filter("vec_id % 20 = 0"), k=2).toPandas()
    assert {q: sorted(p.vec_id) for q, p in got.groupby("query_id")} == {0: [3, 20], 20: [0, 0, 1, 3]}
    assert got[got.query_id == 20].sort_values(["rank", "vec_id"]).vec_id.tolist() == [0, 0, 1, 3]
    first = got[(got.query_id == 0)].sort_values("rank")
    assert first.vec_id.tolist() == [3, 20] and first.score.tolist() == [3e200, 1e200]


def test_nearest_of_few_vectors(spark):
    unit = np.random.default_rng(4).normal(size=(39, 64))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    assert recall(spark, unit[:15]) == 1  # fewer than k candidates: all are returned
    assert recall(spark, unit) >= 0.9


def test_nearest_finishes_queries_that_found_too_few(spark):
    x = np.random.default_rng(5).normal(size=(2300, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(2300), "embedding": x.tolist()}))
    got = crosspoly.search(df, df.filter("vec_id = 0"), k=20, tables=1, probes=1).toPandas().sort_values("rank")
    assert got.vec_id.tolist() == [i for _, i in brute_nearest(list(range(2300)), x, [0], 20)[0]]
