import numpy as np

import corpus_pipeline
from chronoloom.llm import decontaminate, piecefst, secrets
from chronoloom.llm.queries import PIECES, toxicity_model
from tests.llm.test_matching import brute_classes


def test_each_stage_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    frame = docs.toPandas()

    clean = steps["toxicity"](spark, docs, sf)
    assert clean.columns == docs.columns
    kept = clean.toPandas()
    model = toxicity_model(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    score = model.probability(*model.evidences(frame.text.tolist()))
    assert sorted(kept.doc_id) == sorted(frame.doc_id[score < 0.7]) and len(kept) > 0.7 * len(frame)

    small = kept.head(150)
    part = spark.createDataFrame(small)
    single = steps["jaccard_join"](spark, part, sf)
    assert single.columns == docs.columns
    classes = brute_classes(list(zip(small.doc_id.tolist(), small.text.tolist(), strict=True)))
    assert sorted(single.toPandas().doc_id) == sorted({c for c, _ in classes.values()})

    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    built = decontaminate.Patterns(items, 10)
    out = steps["decontamination"](spark, part, sf)
    want = [i for i, t in zip(small.doc_id, small.text, strict=True) if not built.scan(decontaminate.words_of(t))[0].any()]
    assert out.columns == docs.columns and sorted(out.toPandas().doc_id) == sorted(want)

    masked = steps["secret_scan"](spark, part, sf).toPandas()
    assert list(masked.columns) == docs.columns and len(masked) == len(small)
    assert not masked.text.map(lambda t: bool([s for s in secrets.find_spans(t) if s[2] in ("access", "hex", "jwt", "key", "pem")])).any()
    assert (masked.n_chars == masked.text.str.len()).all()

    last = steps["sentencepiece"](spark, part, sf).toPandas()
    machine = piecefst.PieceTransducer(PIECES)
    texts = dict(zip(small.doc_id, small.text, strict=True))
    for i, ids in zip(last.doc_id, last.ids, strict=True):
        assert machine.decode(np.array(ids, dtype="<u4").tobytes()) == texts[i]


def test_empty_input(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_columns_named_like_results_pass_through(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60).selectExpr("*", "7D AS score", "5 AS predicted", "'x' AS contaminated", "8 AS n_hit", "9 AS Sid", "3 AS stays")
    steps = dict(corpus_pipeline.STAGES)
    for name in ("toxicity", "jaccard_join", "decontamination", "secret_scan"):
        out = steps[name](spark, docs, sf)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and {(r["score"], r["predicted"], r["contaminated"], r["n_hit"], r["Sid"], r["stays"]) for r in rows} == {(7.0, 5, "x", 8, 9, 3)}
    nulls = spark.createDataFrame([(None, None, "en", "s", 0), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "ein kurzer Text", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nulls, sf).count() >= 3


def test_run_is_the_stages_in_turn(spark, sf, tmp_path):
    """A small folder of tables: run() gives what the stages give one after another, and only clean documents' rows."""
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(120).write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).toPandas()) if stage is not corpus_pipeline.STAGES[-1][1] else stage(spark, docs, str(tmp_path))
    want = docs.toPandas()
    assert sorted(got.doc_id) == sorted(want.doc_id) and 60 < len(got) <= 120
    ids = lambda f: {d: list(i) for d, i in zip(f.doc_id, f.ids, strict=True)}
    assert ids(got) == ids(want)
