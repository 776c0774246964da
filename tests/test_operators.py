"""Literal inputs with results worked out by hand."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoloom.functions import exprs as X
from chronoloom.functions import parse as P
from chronoloom.operators import audit, chains, graph, intervals, series, similarity, timeline
from chronoloom.plans.profiles import profile
from chronoloom.sources import store


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def lit(x):
    return F.lit(x)


def test_boundaries_and_short_spans(spark):
    cuts = spark.createDataFrame([("a", t) for t in (0.02, 1.0, 1.2, 5.0)], "k string, t double")
    spans = intervals.from_boundaries(cuts, ["k"], "t", F.max(F.lit(6.0)))
    assert rows(spans, "start") == [("a", 0.0, 1.0), ("a", 1.0, 1.2), ("a", 1.2, 5.0), ("a", 5.0, 6.0)]
    merged = series.merge_short(spans.withColumns({"level": F.lit("x"), "energy": F.lit(1.0)}), ["k"], 0.4, "start", "end")
    assert [(r[2], r[3]) for r in rows(merged, "start")] == [(0.0, 1.2), (1.2, 5.0), (5.0, 6.0)]


@pytest.mark.parametrize("times,kept", [([1, 5, 6, 9], [1, 5, 9]), ([1, 3, 3.1], [1, 3.1])])
def test_greedy_gap(spark, times, kept):
    df = spark.createDataFrame([("a", float(t)) for t in times], "k string, i double")
    assert [r[1] for r in rows(chains.greedy_gap(df, ["k"], 2.0), "i")] == kept


def test_rank_below(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate((1.0, 1.0, 3.0))], "k string, i int, e double")
    assert [r.rel for r in series.rank_below(df, ["k"], "e").orderBy("i").collect()] == [0.0, 0.0, round(2 / 3, 6)]


def test_local_maxima_later_first(spark):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate((1, 3, 3, 1))], "k string, i int, e double")
    assert [r[2] for r in rows(series.local_maxima(df, ["k"]), "rank")] == [2, 1]


@pytest.mark.parametrize("k", [3, 4, 5])
def test_box_smooth_like_convolution(spark, k):
    import numpy as np

    v = np.arange(1.0, 10) ** 2
    df = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(v)], "k string, i int, e double")
    got = [r.s for r in series.box_smooth(df, ["k"], k).orderBy("i").collect()]
    assert np.allclose(got, np.convolve(v, np.ones(k) / k, "same"), atol=1e-6)


@pytest.mark.parametrize("v,lo,hi,want", [(5, 2, 5, "high"), (2, 2, 5, "low"), (3, 2, 5, "mid"), (4, 4, 4, "high")])
def test_level(spark, v, lo, hi, want):
    assert value(spark, X.level(lit(v), lit(lo), lit(hi))) == want


def test_exposure_and_gate(spark):
    got = [value(spark, X.exposure(lit(b))) for b in (0.45, 0.06, 0.0599, 0.97, 0.98)]
    assert [round(g, 6) for g in got] == [1.0, 0.290909, 0.0, 0.054545, 0.0]
    assert value(spark, X.reject_reason(lit(0.3), lit(0.01), lit(1.0), lit(1.0))) == "too_short"


def test_coalesce_and_presence(spark):
    df = spark.createDataFrame([("a", 10.0, 12.0), ("a", 25.0, 26.0), ("a", 60.0, 61.0)], "k string, start double, end double")
    there = intervals.coalesced(df, ["k"], 9.0)
    assert rows(there, "start") == [("a", 1.0, 35.0), ("a", 51.0, 70.0)]
    shots = spark.createDataFrame([("a", 1, 35.0, 40.0), ("a", 2, 35.1, 40.0)], "k string, id int, a double, b double")
    hit = intervals.overlapping(shots, there, ["k"], 10.0, True, "left_semi", ("a", "b"), ("start", "end"), ["id"])
    assert [r.id for r in hit.collect()] == [1]


def test_exclusion_is_open(spark):
    clips = spark.createDataFrame([(1, 180.0, 185.0), (2, 184.0, 186.0)], "id int, a double, b double")
    bad = spark.createDataFrame([(185.0, 330.0)], "lo double, hi double")
    kept = intervals.overlapping(clips, bad, [], 50.0, False, "left_anti", ("a", "b"), ("lo", "hi"), ["id"])
    assert [r.id for r in kept.collect()] == [1]


def test_nearest_prefers_the_earlier(spark):
    p = spark.createDataFrame([("a", 1.5), ("a", 0.2), ("a", 9.0)], "k string, t double")
    m = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "k string, b double")
    assert rows(intervals.nearest(p, m, ["k"], "t", "b"), "t") == [("a", 0.2, 1.0), ("a", 1.5, 1.0), ("a", 9.0, 2.0)]


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (None, 4)], "a long, b long")
    assert rows(graph.connected_components(edges, store.written), "node") == [(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)]
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {r[1] for r in rows(graph.connected_components(chain, store.written), "node")} == {0}


def test_components_of_a_shuffled_chain(spark):
    """Ids in random order, as hashes are: needs hundreds of rounds where only neighbours hear of a smaller label."""
    ids = random.Random(1).sample(range(1000), 1000)
    chain = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "a long, b long").coalesce(1)
    written = []

    def keep(df, name):
        written.append(name)
        return store.written(df, name)

    got = rows(graph.connected_components(chain, keep), "node")
    assert got == [(i, 0) for i in range(1000)]
    assert written.count("taken") <= 12


def test_hamming(spark):
    assert value(spark, X.hamming(lit(1), lit(3))) == 1
    assert value(spark, X.hamming(F.lit(-1).cast("long"), F.lit(5).cast("long"))) == 62
    df = spark.createDataFrame([(i, h) for i, h in enumerate((0, 1, 3, -1, -2, 1 << 40))], "id long, hash long")
    brute = {(a, b) for a in range(6) for b in range(a + 1, 6) if bin((df.collect()[a].hash ^ df.collect()[b].hash) & (1 << 64) - 1).count("1") <= 2}
    assert {(r.a, r.b) for r in similarity.hamming_pairs(df, 2).collect()} == brute


def test_reference_match(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    refs = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", [1.0, 1.0]), ("c", [0.0, 0.0])], "label string, embedding array<double>")
    assert rows(similarity.best_reference(v, refs, 0.7), "label") == [(1, "a", 1.0), (1, "b", 0.7071)]


def test_references_meet_batches_one_matrix_at_a_time(spark):
    """Against all pairs in plain numpy, over many blocks; no pairs of packed lots and blocks are made, of which a batch could hold thousands."""
    x = np.random.default_rng(5).normal(size=(300, 8))
    v = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x[:200])], "vec_id long, embedding array<double>")
    refs = spark.createDataFrame([(None if i % 3 == 0 else f"l{i % 3}", e.tolist()) for i, e in enumerate(x[200:])], "label string, embedding array<double>")
    found = similarity.best_reference(v, refs, 0.5, block=4)
    cosines = (x[:200] @ x[200:].T) / np.linalg.norm(x[:200], axis=1)[:, None] / np.linalg.norm(x[200:], axis=1)[None, :]
    want = {(i, None if k == 0 else f"l{k}", round(float(cosines[i, k::3].max()), 4)) for i in range(200) for k in range(3) if round(float(cosines[i, k::3].max()), 4) >= 0.5}
    assert {(r["vec_id"], r["label"], r["score"]) for r in found.collect()} == want and want
    plan = found._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("peak,slot,want", [(11.0, 2, (10.0, 1.0)), (11.0, 6, (10.0, 0.667)), (11.0, 10, (10.0, 0.5)), (None, 2, (10.6, 1.0))])
def test_source_window(spark, peak, slot, want):
    start, speed = X.source_window(lit(10.0), lit(14.0), F.lit(peak).cast("double"), lit(float(slot)), F.lit(None).cast("double"))
    assert (value(spark, start), value(spark, speed)) == want


def test_captions_and_chunks(spark):
    c = spark.createDataFrame([(96, 48), (120, 48)], "start int, dur int")
    assert rows(timeline.clipped_captions(c, F.lit(100)), "start") == [(96, 4)]
    t = spark.createDataFrame([("a", 450)], "k string, n int")
    assert rows(timeline.chunks(t, ["k"], "n", 200), "first") == [("a", 0, 199), ("a", 200, 399), ("a", 400, 449)]


def test_lyrics(spark):
    text = "[00:01.24] So\n[1:02:5] x\n[00:10] \nno\n[00:01.00][00:05.00] dup"
    df = spark.createDataFrame([("a", text), ("b", None), ("c", "")], "k string, text string")
    assert [(r[2], r[3]) for r in rows(P.lyric_lines(df, ["k"], "text"), "line_no")] == [(1.24, "So"), (62.5, "x"), (1.0, "[00:05.00] dup")]


def test_subtitles_and_labels(spark):
    text = "1\n00:00:01,500 --> 00:00:02,000\n[Denji] [gasps] Hello <i>you</i>\n\n2\r\n00:00:03.000 --> 00:00:04.000\r\n[explosion]\r\n\r\n3\n00:00:05,000 --> 00:00:06,000\n[Mika] hi\n\nbad"
    cues = P.subtitle_cues(spark.createDataFrame([("a", text)], "k string, text string"), ["k"], "text")
    got = [(r.start, r.speaker, r.sounds, r.dialogue) for r in P.labelled(cues).orderBy("start").collect()]
    assert got == [(1.5, "denji", ["gasps"], "Hello you"), (3.0, None, ["explosion"], None), (5.0, "other", [], "hi")]


def test_odd_stamps_and_blocks(spark):
    cue = lambda stamp, body="x": f"{stamp}\n{body}"
    blocks = [
        cue("0:00:01,500 --> 00:00:02,000"), cue("00:00:01,5 --> 00:00:02,000"), cue("00:00:01,50 --> 00:00:02,000"), cue("00:00:01;500 --> 00:00:02,000"), cue("100:00:01,500 --> 00:00:02,000"),  # no cues
        cue("00:00:01,5009 --> 00:00:02.000 X1:40", "kept"), "7\n 00:00:03,000-->00:00:04,000 \n \n<b>a</b>\n\t\nb <i>c</i> ", cue("00:00:05,000 --> 00:00:06,000", "<i></i>"), "00:00:07,000 --> 00:00:08,000", cue("10:59:59.999 --> 99:00:00,001", "late"),
    ]
    text = "\n\n\n" + "\n\n".join(blocks) + "\r\n\r\n12\r\n00:00:09,000 --> 00:00:10,000\r\nend\r\n\n\n"
    cues = P.subtitle_cues(spark.createDataFrame([("a", text), ("b", None), ("c", "")], "k string, text string"), ["k"], "text")
    assert [(r.k, r.start, r.end, r.text) for r in cues.orderBy("start").collect()] == [("a", 1.5, 2.0, "kept"), ("a", 3.0, 4.0, "a b c"), ("a", 9.0, 10.0, "end"), ("a", 39599.999, 356400.001, "late")]


def test_neighbours_across_ranges(spark):
    """One series over all ranges, short ones, a null key and ties: as lag and lead over the whole series."""
    many = [("hot", i, i * i) for i in range(400)] + [("b", 5, 1), ("c", 1, 2), ("c", 2, 3), (None, 1, 7), (None, 9, 8)]
    df = spark.createDataFrame(many, "k string, i int, v int").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        held = series.ranged(df, ["k"], "i")
        assert held.filter("k = 'hot'").select("_range").distinct().count() > 2
        got = series.neighbours(held, ["k"], "i", before=["i", "v"], after=["v"]).select("k", "i", "v", "_before.i", F.col("_before.v").alias("b"), F.col("_after.v").alias("a"))
        w = Window.partitionBy("k").orderBy("i")
        want = df.select("k", "i", "v", F.lag("i").over(w), F.lag("v").over(w).alias("b"), F.lead("v").over(w).alias("a"))
        order = lambda r: tuple((x is None, str(x)) for x in r)
        assert sorted(map(tuple, got.collect()), key=order) == sorted(map(tuple, want.collect()), key=order)
        assert series.neighbours(series.ranged(df.limit(0), ["k"], "i"), ["k"], "i", before=["v"]).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_coercion(spark):
    vocabulary = ("action", "tense", "tender", "sad", "neutral")[:3] + ("neutral",)
    got = [value(spark, X.coerced(F.lit(v).cast("string"), vocabulary, "neutral")) for v in ("Action-packed", "tense action", "sad", None, " TENSE ")]
    assert got == ["action", "action", "neutral", "neutral", "tense"]


def test_loose_json(spark):
    got = [value(spark, F.try_variant_get(P.loose_json(lit(t)), "$.a", "int")) for t in ('Sure: {"a":1} ok', "none", '{"a": 2}', "}{")]
    assert got == [1, None, 2, None]


def test_banner_cuts_tracks(spark):
    lines = ["  Duration: 01:02:03.50, start", "Stream #0:0(eng): Video: h264, 1920x1080, 23.98 fps", "Stream #0:1: Audio: aac", "Stream #0:2(jpn): Subtitle: subrip (forced)", "x pts_time:1.5 y", "x pts_time:1.5 y"]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(lines)], "k string, line_no int, line string")
    assert rows(P.banner(df, ["k"], "line"), "k") == [("f", 3723.5, 1920, 1080, 23.98, True)]
    assert rows(P.scene_cuts(df, ["k"], "line"), "t") == [("f", 1.5)]
    assert rows(P.subtitle_tracks(df, ["k"], "line"), "stream") == [("f", 2, "jpn", True)]
    assert value(spark, P.loudness(lit("mean_volume: -23.5 dB"))) == -23.5 and value(spark, P.loudness(lit("x"))) == -99.0
    assert value(spark, P.slug(lit("Jace June: Come!"))) == "jace_june_come"


def test_scores(spark):
    found = spark.createDataFrame([("a", 2), ("a", 2), ("a", 2), ("b", 2)], "k string, severity int")
    plans = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    assert [(r.k, r.score) for r in audit.scores(found, plans, ["k"]).orderBy("k").collect()] == [("a", 85), ("b", 95), ("c", 100)]


def test_fast_runs(spark):
    df = spark.createDataFrame([("a", i, d) for i, d in enumerate((8, 8, 8, 8, 8, 9))], "k string, pos int, duration int")
    assert [r[1] for r in rows(series.long_runs(df, ["k"], "pos", F.col("duration") < 9, 4), "pos")] == [3, 4]


def test_layers_and_curves(spark):
    p = spark.createDataFrame([(5, 46, "fade", 9)], "track_start int, duration int, transition string, frames int")
    r = timeline.layers(p).first()
    assert (r.lead, r.from_frame, r.total) == (5, 0, 51)
    got = [value(spark, X.duck_volume(lit(f), lit(100), lit(50), lit(0.24), lit(0.85))) for f in (91, 94, 100, 150, 159)]
    assert [round(g, 6) for g in got] == [0.85, 0.646667, 0.24, 0.24, 0.85]
    fade = [value(spark, X.fade_envelope(lit(float(f)), lit(100.0), lit(10), lit(20))) for f in (5, 50, 90, 100)]
    assert fade == [0.5, 1.0, 0.5, 0.0]


def test_convergence(spark):
    h = spark.createDataFrame([("a", 1, 55), ("a", 2, 91), ("a", 3, 92), ("a", 4, 99), ("b", 1, 97)], "k string, version int, score int")
    assert rows(audit.convergence(h, ["k"]), "k") == [("a", 3, 3), ("b", 1, 1)]


def test_truncate(spark):
    p = spark.createDataFrame([("a", 1, 0, 10), ("a", 2, 10, 10), ("a", 3, 20, 10), ("b", 1, 50, 5)], "k string, pos int, track_start int, duration int")
    assert rows(audit.truncated(p, ["k"], 15), "k", "pos") == [("a", 1, 0, 10), ("a", 2, 10, 5), ("b", 1, 50, 1)]


def test_profiles():
    assert profile("story").cut_on == "downbeats" and profile("hype").crossfade == 6
    with pytest.raises(KeyError):
        profile("none")


def test_store(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert rows(store.upserted(old, new, ["id"]), "id") == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(store.stale(new, old, ["id"]), "id") == [(3, "d")]
    (tmp_path / "x.json").write_text("{broken")
    assert store.read_json(spark, str(tmp_path / "x.json"), "a int").collect()[0].a is None
    (tmp_path / "a.MP4").write_text("x")
    assert store.files(spark, str(tmp_path), [".mp4"]).count() == 1
    assert value(spark, store.relative(lit("/r/a\\b"), "/r")) == "a/b" and value(spark, store.relative(lit("/x/a"), "/r")) is None
    assert value(spark, store.input_hash(lit("ab"), lit("c"))) == value(spark, F.sha1(lit("abc")))


def test_revision_merges_splits_and_exchanges(spark):
    plan = spark.createDataFrame([("u", i, 10 * i, 10) for i in range(1, 7)] + [("v", 1, 0, 100), ("v", 2, 100, 30), ("v", 3, 130, 28)], "k string, pos int, track_start int, duration int")
    found = spark.createDataFrame([("u", 2, "over_editing"), ("u", 3, "over_editing"), ("u", 4, "over_editing"), ("u", 6, "over_editing"), ("v", 1, "under_editing"), ("v", 3, "under_editing"), ("v", 1, "under_editing"), ("v", 2, "repetition")], "k string, pos int, type string")
    # 2 takes 3 in, whose own finding is gone; 4 takes 5 in; 6 is the last
    got = sorted(map(tuple, audit.merged(found, plan.filter("k = 'u'"), ["k"]).collect()))
    assert got == [("u", 1, 10, 10), ("u", 2, 20, 20), ("u", 4, 40, 20), ("u", 6, 60, 10)]
    once = sorted(map(tuple, audit.merged(found, plan.filter("k = 'u'"), ["k"], most=1).collect()))
    assert once == [("u", 1, 10, 10), ("u", 2, 20, 20), ("u", 4, 40, 10), ("u", 5, 50, 10), ("u", 6, 60, 10)]
    # 24 lies between beats 20 and 30; 154 is nearest to 150, which leaves 8 frames of the third slot
    got = sorted(map(tuple, audit.split(found, plan.filter("k = 'v'"), ["k"], beat=10).collect()))
    assert got == [("v", 1, 0, 0, 20), ("v", 1, 1, 20, 80), ("v", 2, 0, 100, 30), ("v", 3, 0, 130, 20), ("v", 3, 1, 150, 8)]
    # beat 25: the cut at 150 would leave 8 frames of 28, fewer than the margin of 9
    got = sorted(map(tuple, audit.split(found, plan.filter("k = 'v'"), ["k"], beat=25, margin=9).collect()))
    assert got == [("v", 1, 0, 0, 25), ("v", 1, 1, 25, 75), ("v", 2, 0, 100, 30), ("v", 3, 0, 130, 28)]
    assert audit.merged(found.limit(0), plan.limit(0), ["k"]).count() == 0

    used = spark.createDataFrame([("u", 1, 5), ("u", 2, 7), ("u", 3, 5), ("u", 4, 7), ("u", 5, None), ("u", 6, None), ("w", 1, 5)], "k string, pos int, clip_id long")
    order = spark.createDataFrame([(5, 0), (6, 1), (7, 2), (8, 3), (9, 4), (10, 5)], "clip_id long, rank int")
    got = sorted(map(tuple, audit.diversified(used, order, ["k"]).collect()))
    assert got == [("u", 1, 5, 6), ("u", 2, 7, 8), ("u", 3, 5, 9)]


@pytest.mark.parametrize("n", [1, 5, 24, 25, 47, 48, 100])
def test_draft_times(spark, n):
    clips = spark.createDataFrame([(1, 30 * i) for i in range(n)] + [(1, 0)], "u int, track_start int")
    drops = spark.createDataFrame([(1, float(n) - 1.0), (1, None)], "u int, t double")
    got = [(r.i, r.t) for r in timeline.draft_times(clips, drops, ["u"], 30).orderBy("i").collect()]
    assert got == [(i, float(i * n // 24 if n > 24 else i)) for i in range(min(n, 24))]


def test_injections_overwrite_the_then_weakest(spark):
    plan = [(1, 1, 0.9, True), (1, 2, 0.1, True), (1, 3, 0.65, True), (1, 4, 0.0, False), (2, 1, 0.2, True), (3, 1, 0.5, False)]
    footage = [(1, 70, 0.61), (2, 71, 0.8), (3, 72, 0.95), (4, 73, 1.0)]
    got = audit.injected(spark.createDataFrame(plan, "u int, pos int, impact double, strong boolean"), spark.createDataFrame(footage, "n int, clip_id long, impact double"), ["u"])
    want = []
    for user in (1, 2, 3):
        slots = {p: (i, None) for u, p, i, strong in plan if u == user and strong}
        for _, clip, impact in footage[:3]:
            if slots:
                slots[min(slots, key=lambda p: (slots[p][0], p))] = (impact, clip)
        want += [(user, p, c, i) for p, (i, c) in slots.items() if c is not None]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) == 3
    none = audit.injected(spark.createDataFrame(plan, "u int, pos int, impact double, strong boolean"), spark.createDataFrame([], "n int, clip_id long, impact double"), ["u"])
    assert none.count() == 0


def test_plans_that_look_at_one_rank_are_spread(spark):
    """3,000 plans look at the same first ranks: no task of the join gets all of a rank's."""
    plan = spark.range(3000).selectExpr("id plan_id", "explode(array(5L, 5L, 7L)) clip_id", "1 pos").selectExpr("plan_id", "clip_id", "cast(row_number() over (partition by plan_id order by clip_id) as int) pos")
    order = spark.range(40).selectExpr("cast(id as int) rank", "id clip_id")
    found = audit.diversified(plan, order, ["plan_id"])
    got = found.groupBy("pos", "clip_id", "new_id").count().collect()
    assert {tuple(r) for r in got} == {(1, 5, 0, 3000), (2, 5, 1, 3000)}
    assert "_turn" in found._jdf.queryExecution().optimizedPlan().toString()
