import random
import tracemalloc
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from chronoloom.llm import hostrep, queries, toxicity


def invented(n=900, seed=4):
    """Texts in which a toxic one holds a few forms of bad stems; suffixes differ, so most forms are unseen."""
    rng = random.Random(seed)
    stems, suffixes = ["grolb", "snarfu", "vexqu"], [a + b for a in "aeiou" for b in "lmnrst"]
    syllables = ["ba", "de", "ki", "lo", "mu", "pra", "ste", "tion"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    texts, labels = [], []
    for i in range(n):
        words, toxic = [word() for _ in range(rng.randint(5, 200))], i % 3 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randint(0, len(words)), rng.choice(stems) + rng.choice(suffixes))
        texts.append(" ".join(words))
        labels.append(int(toxic))
    return texts, labels


def test_unseen_forms_are_found():
    texts, labels = invented()
    model = toxicity.fit(texts[:600], labels[:600])
    score = model.probability(*model.evidences(texts[600:]))
    y = np.array(labels[600:])
    assert (score[y == 1] >= 0.7).mean() > 0.9 and (score[y == 0] >= 0.7).mean() < 0.05


def test_long_texts_are_cut_where_no_word_goes_on():
    texts, labels = invented(120)
    model = toxicity.fit(texts, labels)
    texts += ["", "   ", "x" * 500, "\n\nSnarfulon ΣΑΣ " * 40, "a b\n" + "y" * 300 + " c"]
    assert all("".join(toxicity.pieces(t, 60)) == t for t in texts)
    whole, cut = model.evidences(texts), model.evidences(texts, most=60)
    assert (whole[1] == cut[1]).all() and np.allclose(whole[0], cut[0], atol=1e-9)
    long = " ".join(texts[1:100:3]) * 400 + " snarfulon grolbam"
    assert len(long) > 6_000_000
    tracemalloc.start()
    evidence, words = model.evidences([long])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    last = model.evidences([" ".join(toxicity.words_of(long)[-8:])])[0]
    assert words[0] == len(toxicity.words_of(long)) and evidence[0] >= last[0] - 1e-9
    assert np.allclose(model.evidences([long], most=1 << 16)[0], evidence, atol=1e-6)
    assert peak < 300 << 20


def test_word_means_equal_a_plain_count():
    s = toxicity.Settings()
    rng = np.random.default_rng(0)
    value = rng.normal(size=s.buckets)
    texts = ["Abc déf", "", "x", "12 !!", "abc"]
    together = toxicity.bags(texts, s)
    assert together.n_words.tolist() == [2, 0, 1, 0, 1]
    means = toxicity.word_means(together, value)
    alone = [toxicity.word_means(toxicity.bags([t], s), value) for t in texts]
    assert np.allclose(means, np.concatenate(alone)) and np.isclose(means[0], means[3])


def test_degenerate_samples():
    for labels in ([], [0, 0], [1, 1, 1]):
        model = toxicity.fit(["a b"] * len(labels), labels)
        score = model.probability(*model.evidences(["", "a b c", "x" * 5000]))
        assert ((score >= 0) & (score <= 1)).all()


def test_scores_edge_cases(spark):
    texts, labels = invented(120)
    model = toxicity.fit(texts, labels)
    df = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (3, texts[0], "s"), (3, texts[0], "s"), (None, "long " * 30000, "s")], "doc_id long, text string, Score string")
    got = toxicity.with_scores(df, model)
    assert [c.lower() for c in got.columns].count("score") == 1
    rows = got.collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert toxicity.with_scores(df.limit(0), model).count() == 0
    marks = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    sample = toxicity.training_sample(df, marks, toxicity.Settings())
    assert sample == (["", texts[0]], [1, 0])


def plain_evidence(model, text):
    """The evidence of one text and its number of words, with dicts and Python's integers, gram by gram."""
    s, full = model.settings, (1 << 64) - 1

    def symbol(c):
        h = c * 0x9E3779B97F4A7C15 & full
        return h ^ h >> 29

    words, word = [], []
    for c in text.lower() + " ":
        if c.isalpha():
            word.append(ord(c))
        elif word:
            words.append(word)
            word = []
    means = []
    for w in words:
        found = []
        bordered = [1, *w, 1]
        for n in range(s.shortest, s.longest + 1):
            for i in range(len(bordered) - n + 1):
                h = 0
                for c in bordered[i : i + n]:
                    h = (h * 0x100000001B3 + symbol(c)) & full
                found.append(((h ^ h >> 32) * 0xD6E8FEB86659FD93 & full) >> 40)
        whole = sum(symbol(c) * pow(0x9DDFEA08EB382D69, i % 64, 1 << 64) for i, c in enumerate(w)) & full
        found.append(((whole ^ whole >> 31) * 0xD6E8FEB86659FD93 & full) >> 40)
        means.append(sum(model.gram_logit[h % s.buckets] for h in found) / len(found))
    if not means:
        return -30.0, 0
    if len(means) <= s.window:
        return sum(means) / len(means) + model.bias, len(means)
    best = None
    for start in range(0, len(means) - s.window + s.stride, s.stride):
        end = min(start + s.window, len(means))
        mean = sum(means[end - s.window : end]) / s.window
        best = mean if best is None or mean > best else best
    return best + model.bias, len(means)


def test_scores_equal_a_plain_scorer():
    texts, labels = invented(200)
    model = toxicity.fit(texts, labels)
    odd = ["", "!!", "a", "A b", "x1y2 z", "İstanbul ǅ ﬁ ß", "été " * 40, "w" * 200, "one two three four five six seven eight", "one two three four five six seven eight nine", *texts[:40]]
    evidence, words = model.evidences(odd)
    want = [plain_evidence(model, t) for t in odd]
    assert words.tolist() == [n for _, n in want]
    assert np.allclose(evidence, [e for e, _ in want], atol=1e-9)


def test_scores_stay_when_held_out_labels_are_flipped(spark, sf, tmp_path):
    labels = pd.read_parquet(f"{sf}/labels.parquet")
    held = labels.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)
    labels.loc[held, "toxic"] = 1 - labels.loc[held, "toxic"]
    labels.loc[held, "quality"] = 1 - labels.loc[held, "quality"]
    assert held.sum() > 5
    labels.to_parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "text", "'xx' AS lang", "cast(doc_id as string) AS source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    one, two = (f.toPandas().set_index("doc_id").sort_index() for f in (queries.op7_toxicity(spark, sf), queries.op7_toxicity(spark, str(tmp_path))))
    assert one.score.tolist() == two.score.tolist() and one.predicted.tolist() == two.predicted.tolist()


def test_query_never_learns_held_out_labels(spark, sf):
    got = queries.op7_toxicity(spark, sf).toPandas()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    assert got.score.between(0, 1).all()


def test_held_out_accuracy():
    d = pd.read_parquet("/root/testdata/sf0.1/documents.parquet").merge(pd.read_parquet("/root/testdata/sf0.1/labels.parquet"), on="doc_id")
    held = d.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)
    train, test = d[~held], d[held].head(800)
    train = pd.concat([train[train.toxic == 1].head(700), train[train.toxic == 0].head(1400)]).sort_values("doc_id")
    model = toxicity.fit(train.text.tolist(), train.toxic.tolist())
    score = model.probability(*model.evidences(test.text.tolist()))
    y = test.toxic.to_numpy()
    rank = score.argsort().argsort()
    n = y.sum()
    auc = (rank[y == 1].sum() - n * (n - 1) / 2) / (n * (len(y) - n))
    assert auc > 0.93, auc


URLS = ["http://A.Example.com/en/7x?q#f", "https://x.net/de/1", "ftp://example.net/de/8", "http://notexample.net/de/8", "org/es/", None, "", "http://", "http://org/es/#", "//a.org/es/1", "x://com/en/?/en/", "http://com/EN/", "http://sub.example.com:80/en/7", "http://h.org#/es/", "http://é.org/es/\n?x"]


def test_reputation_equals_sql(spark):
    rng = random.Random(9)
    hosts = [f"h{i}.d{i % 4}.{['com', 'net', 'org'][i % 3]}" for i in range(30)]
    rows = [(i, u) for i, u in enumerate(URLS)] + [(100 + i, f"http://{rng.choice(hosts[: 3 + i % 27])}/de/{i % 200}") for i in range(600)] + [(3, URLS[3]), (None, URLS[0])]
    labels = [(i, int(rng.random() < 0.8), int(rng.random() < (0.9 if i % 7 == 0 else 0.1))) for i in range(200)] + [(1, None, 1), (None, 1, 1), (2, None, None)]
    pages = spark.createDataFrame([(a, b, "h", "x") for a, b in rows], "page_id long, url string, host string, Path string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = hostrep.judge(pages, hostrep.outcomes_by_document(pages, marks)).toPandas()
    db = duckdb.connect()
    for name, frame in (("pages", pages), ("labels", marks)):
        db.register(name, pd.DataFrame(frame.collect(), columns=frame.columns).convert_dtypes())
    want = db.execute(queries.REPUTATION_SQL).df()
    key = lambda f: sorted(tuple(None if pd.isna(v) else v for v in r) for r in f[["host", "path", "rule", "verdict"]].itertuples(index=False, name=None)) if False else sorted(map(str, (tuple(None if pd.isna(v) else v for v in r) for r in f[["host", "path", "rule", "verdict"]].itertuples(index=False, name=None))))
    assert key(got) == key(want) and len(got) == len(rows)
    by = {(r.host, r.path): (r.rule, r.verdict) for r in got.itertuples()}
    assert by["a.example.com", "/en/7x"] == ("example.com/en/7", "allow")
    assert by["example.net", "/de/8"] == ("example.net/de/8", "block")
    assert by["notexample.net", "/de/8"][0] == "net/de/"
    assert by["sub.example.com:80", "/en/7"][0] is None and by["com", "/EN/"][0] is None


def test_reputation_without_outcomes(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, bad int")
    assert hostrep.judge(pages, none).first().verdict == "allow"
    assert hostrep.judge(pages.limit(0), none).count() == 0


def test_shrinkage_orders_hosts(spark):
    pages = spark.createDataFrame([(i, "bad.x.com" if i < 40 else "one.y.com" if i == 40 else f"ok{i % 9}.x.com") for i in range(400)], "page_id long, host string")
    bad = spark.createDataFrame([(i, 1 if i <= 40 else int(i % 20 == 0)) for i in range(400)], "page_id long, bad int")
    got = {r.host: r for r in hostrep.reputations(pages, bad).collect()}
    assert got["bad.x.com"].low > 0.3 > got["ok1.x.com"].low
    assert got["one.y.com"].rate < 0.9 and got["one.y.com"].low < got["bad.x.com"].low  # one outcome is not enough


@pytest.mark.parametrize("host,domain,suffix", [("a.b.c", "b.c", "c"), ("c", "c", "c"), ("", "", "")])
def test_domains(spark, host, domain, suffix):
    from pyspark.sql import functions as F

    r = spark.createDataFrame([(host,)], "h string").select(hostrep.domain_of(F.col("h")).alias("d"), hostrep.suffix_of(F.col("h")).alias("s")).first()
    assert (r.d, r.s) == (domain, suffix)
