"""The audit, the revision and their repetition against plain loops over dicts."""

import math

import pandas as pd
import pytest

from chronoloom.operators import audit, revision
from chronoloom.operators.shelf import Shelf, shelved
from chronoloom.plans import revisions

FPS = 30


def cosine(a, b):
    dot = sum(x * y for x, y in zip(a, b, strict=True))
    return dot / (math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b)) + 1e-9)


def plain_audit(slots, library, energy, drops):
    """What is wrong with one plan, worst first."""
    out = []

    def add(severity, kind, pos, t, **more):
        out.append({"severity": severity, "type": kind, "pos": pos, "t": round(t, 2), **more})

    for a, b in zip(slots, slots[1:], strict=False):
        x, y = library.get(a["clip_id"]), library.get(b["clip_id"])
        if x and y and ((x["cluster"] is not None and x["cluster"] == y["cluster"]) or round(cosine(x["colour"], y["colour"]), 6) > 0.92):
            add(2, "repetition", b["pos"], b["track_start"] / FPS, action="replace", match=b["intensity"])
    heard = {s["pos"]: energy[s["track"], s["track_start"] // 6] for s in slots}
    for s in slots:
        e, hi, rel = heard[s["pos"]]
        if e >= hi and s["intensity"] < 0.4:
            add(3, "weak_in_strong", s["pos"], s["track_start"] / FPS, action="replace", prefer="impact", match=max(0.7, rel))
        elif rel < 0.25 and s["intensity"] > 0.7:
            add(1, "busy_in_calm", s["pos"], s["track_start"] / FPS, action="replace", prefer="calm", match=rel)
    for d in sorted(drops):
        cover = next((s for s in slots if s["track_start"] - 0.15 * FPS <= d <= s["track_start"] + s["duration"]), None)
        if cover and cover["impact"] < 0.6:
            add(3, "weak_drop", cover["pos"], d / FPS, action="replace", prefer="impact", match=0.9)
    for s in slots:
        e, hi, _ = heard[s["pos"]]
        if e >= hi and s["duration"] > int(1.4 * FPS) and not s["is_drop"]:
            add(1, "under_editing", s["pos"], s["track_start"] / FPS, action="shorten", to=int(0.8 * FPS))
    run = 0
    for s in slots:
        run = run + 1 if s["duration"] < int(0.3 * FPS) and not s["is_drop"] else 0
        if run >= 4:
            add(1, "over_editing", s["pos"], s["track_start"] / FPS, action="lengthen")
    used = {s["clip_id"] for s in slots}
    for c in [c for i, c in sorted(library.items()) if c["usable"] and c["impact"] > 0.8 and i not in used][:3]:
        add(2, "wasted_footage", None, 0.0, action="inject", clip=c)
    known = [library[s["clip_id"]]["cluster"] for s in slots if s["clip_id"] in library]
    if len(set(known)) / max(1, len(known)) < 0.55:
        add(2, "low_variety", None, 0.0, action="diversify")
    return sorted(out, key=lambda f: (-f["severity"], f["t"]))


def plain_pick(library, target, prefer, clusters, ids, usage, max_reuse):
    best, most = None, -1e9
    for i, c in sorted(library.items()):
        if not c["usable"] or i in ids or c["cluster"] in clusters:
            continue
        s = 0.9 * c["quality"] + 1.2 * (1.0 - abs(c["intensity"] - target))
        s += {"impact": 1.5 * c["impact"] + 0.3 * c["intensity"], "calm": 0.8 * (1.0 - c["intensity"])}.get(prefer, 0.0)
        s -= 0.6 * usage.get(i, 0)
        s -= 4.0 if usage.get(i, 0) >= max_reuse else 0.0
        if s > most:
            best, most = c, s
    return best


def plain_revise(slots, findings, library, rules):
    slots, done = [dict(s, name=str(s["pos"])) for s in slots], 0

    def put(s, c):
        s.update(clip_id=c["id"], intensity=round(c["intensity"], 3), impact=round(c["impact"], 3))

    for f in findings:
        if done >= rules.most:
            break
        where = {s["name"]: i for i, s in enumerate(slots)}
        i = where.get(str(f["pos"]))
        usage: dict = {}
        for s in slots:
            usage[s["clip_id"]] = usage.get(s["clip_id"], 0) + 1
        beside = [slots[j] for j in (i - 1, i + 1) if 0 <= j < len(slots)] if i is not None else []
        clusters = {library[s["clip_id"]]["cluster"] for s in beside if s["clip_id"] in library}
        if f["action"] == "replace" and i is not None:
            c = plain_pick(library, f["match"], f.get("prefer"), clusters, {slots[i]["clip_id"]} | {s["clip_id"] for s in beside}, usage, rules.max_reuse)
            if c:
                put(slots[i], c)
                done += 1
        elif f["action"] == "inject":
            strong = sorted((s for s in slots if s["level"] == "high" or s["is_drop"]), key=lambda s: s["impact"])
            if strong:
                put(strong[0], f["clip"])
                done += 1
        elif f["action"] == "diversify":
            over, unused, k = [c for c, n in usage.items() if n >= 2], [c for i, c in sorted(library.items()) if c["usable"] and i not in usage], 0
            for s in slots:
                if s["clip_id"] in over and unused:
                    put(s, unused.pop(0))
                    k += 1
                    if k >= 3:
                        break
            done += k > 0
        elif f["action"] == "shorten" and i is not None:
            s = slots[i]
            aim, end = s["track_start"] + f["to"], s["track_start"] + s["duration"]
            mid = min(range(0, end + 100, rules.beat), key=lambda b: abs(b - aim))
            if s["track_start"] + 4 < mid < end - 4:
                s["duration"] = mid - s["track_start"]
                c = plain_pick(library, s["intensity"], "impact", clusters, {s["clip_id"]}, usage, rules.max_reuse)
                if c:
                    new = dict(s, name=s["name"] + "b", track_start=mid, duration=end - mid)
                    put(new, c)
                    slots.insert(i + 1, new)
                    done += 1
        elif f["action"] == "lengthen" and i is not None and i + 1 < len(slots):
            after = slots.pop(i + 1)
            slots[i]["duration"] = after["track_start"] + after["duration"] - slots[i]["track_start"]
            done += 1
    for k, s in enumerate(slots):
        s["pos"] = k
    return slots, done


def plain_loop(slots, library, energy, drops, rules):
    """[(version, score, findings)], and the slots of each version."""
    history, versions, before = [], [], None
    for version in range(1, 5):
        found = plain_audit(slots, library, energy, drops)
        score = max(0, 100 - sum({1: 2, 2: 5, 3: 9}[f["severity"]] for f in found))
        history.append((version, score, len(found)))
        versions.append(slots)
        if score >= 96 or (before is not None and score - before < 2):
            break
        before = score
        slots, done = plain_revise(slots, found, library, rules)
        if not done:
            break
    return history, versions


@pytest.fixture(scope="module")
def weeks(spark, sf):
    return revisions.weeks(spark, sf)


@pytest.fixture(scope="module")
def world(weeks):
    listed = lambda c: None if c is None else list(c)
    library = {r["id"]: {**r.asDict(), "colour": listed(r["colour"])} for r in weeks.library.collect()}
    energy = {(r["track"], r["h"]): (r["e"], r["q_hi"], r["rel"]) for r in weeks.energy.collect()}
    plans: dict = {}
    for r in weeks.plans.orderBy("user_id", "week", "pos").collect():
        plans.setdefault((r["user_id"], r["week"]), []).append(r.asDict())
    return library, energy, [r["frame"] for r in weeks.drops.collect()], plans


def test_findings_equal_a_plain_audit(weeks, world):
    library, energy, drops, plans = world
    got: dict = {}
    for r in weeks.audit(weeks.plans).collect():
        got.setdefault((r["user_id"], r["week"]), []).append((r["severity"], r["type"], r["pos"], r["t"], r["action"], r["clip_id"]))
    kinds = set()
    for key, slots in plans.items():
        want = [(f["severity"], f["type"], f["pos"], f["t"], f["action"], f["clip"]["id"] if "clip" in f else None) for f in plain_audit(slots, library, energy, drops)]
        order = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
        assert sorted(got.get(key, []), key=order) == sorted(want, key=order)
        kinds |= {w[1] for w in want}
    assert {"repetition", "weak_in_strong", "weak_drop", "under_editing", "wasted_footage"} <= kinds


def view(slots):
    return [(s["pos"], s["clip_id"], s["track_start"], s["duration"], s["intensity"], s["impact"]) for s in slots]


def test_repetition_equals_a_plain_loop(weeks, world):
    """Every plan: versions, scores, findings, and the slots of the best version."""
    library, energy, drops, plans = world
    history, best = revision.converged(weeks.plans, weeks.audit, weeks.revise, revisions.KEYS)
    rows: dict = {}
    for r in history.collect():
        rows.setdefault((r["user_id"], r["week"]), []).append((r["version"], r["score"], r["n_issues"]))
    slots: dict = {}
    for r in best.orderBy("user_id", "week", "pos").collect():
        slots.setdefault((r["user_id"], r["week"]), []).append(r.asDict())
    assert set(rows) == set(plans)
    for key, plan in plans.items():
        want, versions = plain_loop(plan, library, energy, drops, revisions.RULES)
        assert sorted(rows[key]) == want, key
        top = max(range(len(want)), key=lambda k: (want[k][1], -k))
        assert view(slots[key]) == view(versions[top]), key
    assert max(len(r) for r in rows.values()) > 2


def slot(pos, clip, start, duration, **more):
    base = {"pos": pos, "track": "a", "clip_id": clip, "known": True, "cluster": f"k{clip}", "colour": [1.0, 0.0], "track_start": start, "duration": duration, "level": "mid", "is_drop": False, "intensity": 0.5, "impact": 0.5, "fitted": None, "cut_in": False}
    return base | more


@pytest.fixture(scope="module")
def shelf(spark):
    rows = [(i, 0.5 + i / 100, i / 10, (10 - i) / 10, 2.0, float(i), None if i == 0 else f"k{i}", [1.0, 0.0]) for i in range(10)]
    return shelved(spark.createDataFrame(rows, "id long, quality double, intensity double, impact double, dur double, start double, cluster string, colour array<double>"))


def finding(action, pos=None, **more):
    return {"action": action, "pos": pos, "prefer": None, "match_intensity": None, "to_frames": None, "clip": None} | more


def test_five_actions_move_slots_and_spend_one_budget(shelf):
    rules = revision.Rules(beat=10)
    plan = [slot(0, 1, 0, 40), slot(1, 2, 40, 5), slot(2, 3, 45, 5), slot(3, 1, 50, 90, level="high", impact=0.1)]
    got, done = revision.revise(plan, [finding("lengthen", 1), finding("lengthen", 2), finding("shorten", 3, to_frames=24), finding("diversify"), finding("replace", 0, prefer="impact", match_intensity=0.9)], shelf, rules)
    assert done[0] == "merge 1" and done[1].startswith("split 3 70") and done[2].startswith("diversify") and done[3].startswith("replace 0") and len(done) == 4  # slot 2 was taken in
    assert [(s["track_start"], s["duration"]) for s in got] == [(0, 40), (40, 10), (50, 20), (70, 70)] and got[3]["cut_in"]
    assert len(revision.revise(plan, [finding("replace", k % 4, match_intensity=0.1 * k) for k in range(12)], shelf, rules)[1]) == 8
    assert plan[0]["clip_id"] == 1  # the input stays


def test_what_can_not_be_done_costs_nothing(shelf):
    rules = revision.Rules(beat=50)
    plan = [slot(0, 1, 0, 30), slot(1, 2, 30, 10)]
    nothing = [finding("replace", 9, match_intensity=0.5), finding("inject"), finding("reorder", 0), finding(None), finding("shorten", 1, to_frames=4), finding("lengthen", 1), finding("diversify")]
    got, done = revision.revise(plan, nothing, shelf, rules)
    assert done == [] and view(got) == view(plan)
    assert revision.revise([], nothing, shelf, rules) == ([], [])


def test_neighbours_are_excluded_and_null_clusters_count(shelf):
    plan = [slot(0, 0, 0, 30, cluster=None), slot(1, 5, 30, 30), slot(2, 9, 60, 30, cluster="k9")]
    pick = revision.revise(plan, [finding("replace", 1, match_intensity=0.0)], shelf, revision.Rules())[0][1]
    assert pick["clip_id"] == 1 and pick["fitted"] == 30  # clip 0 would suit best, but stands beside


def test_plans_share_the_order_of_clips(shelf, monkeypatch):
    opened = []
    monkeypatch.setattr(Shelf, "open", (lambda f: lambda self, cell: opened.append(cell) or f(self, cell))(Shelf.open))
    plan = [slot(0, 1, 0, 30), slot(1, 2, 30, 30), slot(2, 3, 60, 30)]
    asked = [finding("replace", 1, match_intensity=0.123456, prefer="calm")]
    want = revision.revise(plan, asked, shelf, revision.Rules())
    once = len(opened)
    assert once and [revision.revise(plan, asked, shelf, revision.Rules()) for _ in range(20)] == [want] * 20
    assert len(opened) - once <= 20  # the clip that was taken, nothing else


def test_empty_plans(spark, weeks):
    none = weeks.plans.limit(0)
    history, best = revision.converged(none, weeks.audit, weeks.revise, revisions.KEYS)
    assert history.count() == 0 and best.count() == 0 and isinstance(history.toPandas(), pd.DataFrame)
    assert audit.scores(weeks.audit(none), none, revisions.KEYS).count() == 0
