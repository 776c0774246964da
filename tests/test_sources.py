import pandas as pd
from pyspark.sql import functions as F

from chronoloom.functions import scores
from chronoloom.functions.parse import is_impact, loose_json, number_or
from chronoloom.operators import providers
from chronoloom.sources import readers


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_readers(spark, tmp_path):
    (tmp_path / "a.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nhi\n")
    (tmp_path / "a.lrc").write_text("[00:01.5] la\n")
    (tmp_path / "a.log").write_text("x\n Duration: 00:00:10.00,\nVideo: h264 640x360, 25 fps\npts_time:2.5\n")
    (tmp_path / ".env").write_text("# c\n\nA='b=c'\nnone\n")
    at = lambda n: str(tmp_path / n)
    assert [(r.start, r.text) for r in readers.read_srt(spark, at("a.srt")).collect()] == [(1.0, "hi")]
    assert [(r.t, r.text) for r in readers.read_lrc(spark, at("a.lrc")).collect()] == [(1.5, "la")]
    b = readers.read_banner(spark, at("a.log")).first()
    assert (b.duration, b.width, b.height, b.fps, b.has_audio) == (10.0, 640, 360, 25.0, False)
    assert [r.t for r in readers.read_scene_log(spark, at("a.log")).collect()] == [2.5]
    (tmp_path / "set.env").write_text("# c\n\nA='b=c'\nnone\n")
    assert [tuple(r) for r in readers.read_settings(spark, at("set.env")).collect()] == [("A", "b=c")]


def test_shots_of_both_shapes(spark):
    docs = spark.createDataFrame([('{"shots": [{"id": "a"}, {"x": 1}]}',), ('[{"id": "b"}]',), ("{",), (None,)], "text string")
    assert sorted(r.id for r in readers.shots(docs, "id:string").collect()) == ["a", "b"]


def test_tags(spark):
    text = '{"emotion": "Very Tense", "scene_type": 3, "confidence": 7, "characters": ["aki"], "description": " x "}'
    got = value(spark, scores.tag(loose_json(F.lit(text))))
    assert (got.emotion, got.scene_type, got.confidence, got.characters, got.description) == ("tense", "establishing", 1.0, ["aki"], "x")
    empty = value(spark, scores.tag(loose_json(F.lit("none"))))
    assert (empty.emotion, empty.confidence, empty.characters) == ("neutral", 0.0, [])
    assert value(spark, is_impact(F.lit("gunfire"))) and not value(spark, is_impact(F.lit("sighs")))


def test_scores(spark):
    d = lambda x: F.lit(float(x))
    assert round(value(spark, scores.slot_score(d(1), d(0.5), d(1), d(0.275), d(0.5), d(1), F.lit(True))), 6) == round(0.9 + 1.2 - 0.5 + 1.3 + 0.2, 6)
    a = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    arc = lambda emotion, people: scores.arc_score(d(1), d(0.5), d(2), d(0.5), d(1), F.lit(False), F.lit(emotion).cast("string"), F.lit("dialogue"), people, a("happy"), a("aki"), F.lit(True), F.lit("happy"))
    assert round(value(spark, arc("happy", a("aki", "crowd"))), 6) == round(1.8 - 0.3 + 1.6 + 0.6 + 1.3 - 1.2 + 0.7, 6)
    assert round(value(spark, arc(None, a())), 6) == round(1.8 - 0.3 + 0.5 + 0.7, 6)
    assert [value(spark, scores.tempo(F.lit(n), 43.0)) for n in (20, 40, 14)] == [129.0, 129.0, 92.14]
    assert value(spark, scores.tempo(F.lit(None).cast("int"), 43.0)) == 120.0


def test_keyframe_times(spark):
    t = lambda dur, peaks, action: value(spark, scores.keyframe_times(F.lit(0.0), F.lit(float(dur)), F.array(*map(F.lit, peaks)).cast("array<double>"), F.lit(action)))
    assert t(1.9, [], False) == [0.95]
    assert len(t(5, [1.0, 1.1, 3.0], True)) == 5 and {1.0, 3.0} < set(t(5, [1.0, 1.1, 3.0], True))
    assert len(t(20, [], True)) == 6


def test_provider_computes_only_what_is_missing(spark):
    items = spark.createDataFrame([("k1", "a"), ("k2", "b"), ("k2", "b")], "key string, text string")
    cache = spark.createDataFrame([("k1", "old")], "key string, answer string")
    got = providers.tagged(items, cache, "key", "text", lambda: lambda s: "new " + s.astype(str))
    assert sorted(map(tuple, got.collect())) == [("k1", "old"), ("k2", "new b")]
    assert providers.resolve("auto", ["ollama"]) == "ollama" and providers.resolve("auto", []) == "local" and providers.resolve("x", []) == "x"
    assert isinstance(pd.Series([1]), pd.Series)


def test_models(spark):
    names = F.array(F.lit("qwen:3b"), F.lit("x"))
    assert value(spark, scores.has_model(names, "qwen:7b")) and not value(spark, scores.has_model(names, "y"))
    assert [value(spark, scores.suggested_model(F.lit(g), "s", "m", "l")) for g in (0, 4, 16, 64)] == ["l", "s", "m", "l"]


def test_general_descriptions(spark):
    text = '{"subjects": ["a", "b"], "actions": "runs", "objects": "", "scene": "street", "mood": "", "camera": {"angle": "low"}, "people_count": 2, "confidence": "0.5"}'
    got = value(spark, scores.general(loose_json(F.lit(text))))
    assert (got.subjects, got.actions, got.objects, got.emotion) == (["a", "b"], ["runs"], [], [])
    assert (got.scene, got.mood, got.text, got.people_count, got.confidence) == ("street", "unknown", "", 2, 0.5)
    assert tuple(got.camera) == ("unknown", "unknown", "low")
    odd = value(spark, scores.general(loose_json(F.lit('{"camera": "near", "confidence": "high"}'))))
    assert tuple(odd.camera) == ("unknown",) * 3 and odd.confidence == 0.0 and odd.people_count is None


def test_settings_pictures_and_chosen_shots(spark):
    got = [value(spark, number_or(F.lit(x).cast("string"), 0.4)) for x in ("1.5", " 2 ", "x", "", None)]
    assert got == [1.5, 2.0, 0.4, 0.4, 0.4]
    names = ["/k/src00_shot001_a.jpg", "/k/src00_shot001_b.jpg", "/k/src00_shot001_c.jpg", "/k/src01_shot002_a.jpg", "/k/src01_shot002_b.jpg", "/k/other.jpg"]
    files = spark.createDataFrame([(n,) for n in reversed(names)], "path string")
    assert sorted(tuple(r) for r in readers.middle_keyframes(files).collect()) == [(0, 1, names[1]), (1, 2, names[4])]
    shots = spark.createDataFrame([("c",), ("a",), ("b",)], "id string")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(readers.wanted(shots, ["b"], 2)) == ["b"] and ids(readers.wanted(shots, None, 2)) == ["a", "b"] and len(ids(readers.wanted(shots))) == 3
