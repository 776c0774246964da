"""Revision of plans by what an audit found, and its repetition until a plan stops getting better.

One revision is a fold over a plan's findings, worst first: each may change a
clip, cut a slot in two or join two, on the plan as the findings before it left
it, until ``most`` changes were made.  Plans are spread over the cluster by
key; a task holds one plan and its findings, and takes clips from the shelf of
cells (``shelf``), never from the whole library.

The loop runs all plans at once: every version of the plans that are still
going is a written table, the audit of it is a few joins and windows over all
of them, and a plan leaves the loop at its own stop.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions import exprs as X
from chronoloom.operators.audit import ordered, scores
from chronoloom.operators.shelf import NO_CLUSTER, Clips, Search, Shelf, Taken
from chronoloom.sources.store import busy, written


@dataclass(frozen=True)
class Rules:
    """How a revision changes plans.  ``beat`` is the frames between beats, 0 if there are none; ``most`` counts changes that were made."""

    fps: int = 30
    beat: int = 15
    max_reuse: int = 3
    most: int = 8
    exchanges: int = 3
    margin: int = 4


#: What a slot is to the fold; ``fitted`` is the duration for which its clip was cut, null where it is as it was.
SLOT = "pos int, track string, clip_id long, known boolean, cluster string, colour array<double>, track_start int, duration int, level string, is_drop boolean, intensity double, impact double, fitted int, cut_in boolean"
NAMES = [c.split()[0] for c in SLOT.split(", ")]


def replacement(shelf: Shelf, target: float, prefer: str | None, without_clusters: set, without_ids: set, usage: Counter, rules: Rules) -> Taken | None:
    """The clip that suits best, apart from some clips and clusters; used ones less the more they are used.

    Clips come in the order for ``target`` and ``prefer`` alone, which plans
    share; the first that the plan neither uses nor excludes is met after all
    that could still beat it in spite of their uses.
    """

    def scored(c: Clips, target: float) -> np.ndarray:
        s = 0.9 * c.quality
        s = s + 1.2 * (1.0 - np.abs(c.intensity - target))
        if prefer == "impact":
            s = s + (1.5 * c.impact + 0.3 * c.intensity)
        elif prefer == "calm":
            s = s + 0.8 * (1.0 - c.intensity)
        return s

    def search() -> Search:
        near = round(float(target), 2)

        def loose() -> np.ndarray:
            bound = 0.9 * shelf.quality_hi + 1.2 * (1.0 - shelf.apart(near, shelf.intensity_lo, shelf.intensity_hi))
            if prefer == "impact":
                bound = bound + 1.5 * shelf.impact_hi + 0.3 * shelf.intensity_hi
            elif prefer == "calm":
                bound = bound + 0.8 * (1.0 - shelf.intensity_lo)
            return bound

        return Search(("replace", near, prefer), loose, lambda c: scored(c, near), lambda c: scored(c, target), 1.2 * abs(target - near) + 1e-9)

    clusters = {NO_CLUSTER if c is None else c for c in without_clusters}
    found, most = None, -np.inf
    for s, id_, cell, place, cluster in shelf.ranked(("replace", target, prefer), search):
        if id_ in without_ids or cluster in clusters:
            continue
        uses = usage.get(id_, 0)
        if uses:
            s = s - 0.6 * uses
            if uses >= rules.max_reuse:
                s = s - 4.0
        if found is None or s > most or (s == most and id_ < found[0]):
            found, most = (id_, cell, place), s
        if not uses:
            break
    return shelf.taken(found[1], shelf.open(found[1]), found[2], most) if found else None


def put(slot: dict, clip: Taken) -> None:
    """The slot shows ``clip`` from now on."""
    slot |= {"clip_id": clip.id, "known": True, "cluster": None if clip.cluster == NO_CLUSTER else clip.cluster, "colour": clip.colour.tolist(), "intensity": round(clip.intensity, 3), "impact": round(clip.impact, 3), "fitted": slot["duration"]}


def revise(slots: list[dict], findings: list[dict], shelf: Shelf, rules: Rules) -> tuple[list[dict], list[str]]:
    """The slots after one revision, in order, and what was done.  ``findings`` come worst first."""
    slots = [dict(s) for s in slots]
    done: list[str] = []
    at = lambda pos: next((i for i, s in enumerate(slots) if s["pos"] == pos and not s.get("new")), None) if pos is not None else None

    def around(i: int) -> list[dict]:
        return [slots[j] for j in (i - 1, i + 1) if 0 <= j < len(slots)]

    for f in findings:
        if len(done) >= rules.most:
            break
        i = at(f["pos"])
        usage = Counter(s["clip_id"] for s in slots)
        beside = {s["cluster"] for s in around(i) if s["known"]} if i is not None else set()
        if f["action"] == "replace" and i is not None:
            ids = {slots[i]["clip_id"], *(s["clip_id"] for s in around(i))}
            target = f["match_intensity"] if f["match_intensity"] is not None else slots[i]["intensity"]
            new = replacement(shelf, target, f["prefer"], beside, ids, usage, rules)
            if new is not None:
                put(slots[i], new)
                done.append(f"replace {f['pos']} {new.id}")
        elif f["action"] == "inject" and f["clip"] is not None:
            strong = [s for s in slots if s["level"] == "high" or s["is_drop"]]
            if strong:
                weakest = min(strong, key=lambda s: s["impact"])
                put(weakest, f["clip"])
                done.append(f"inject {f['clip'].id} {weakest['pos']}")
        elif f["action"] == "diversify":
            again, taken, n = {c for c, k in usage.items() if k >= 2}, set(usage), 0
            for s in slots:
                if n < rules.exchanges and s["clip_id"] in again:
                    new = shelf.first_but(taken)
                    if new is None:
                        break
                    taken.add(new.id)
                    put(s, new)
                    n += 1
            if n:
                done.append(f"diversify {n}")
        elif f["action"] == "shorten" and i is not None:
            s, end = slots[i], slots[i]["track_start"] + slots[i]["duration"]
            to = s["track_start"] + (f["to_frames"] if f["to_frames"] is not None else s["duration"] // 2)
            mid = (2 * to + rules.beat - 1) // (2 * rules.beat) * rules.beat if rules.beat else to  # the earlier beat on ties
            if s["track_start"] + rules.margin < mid < end - rules.margin:
                s["duration"] = mid - s["track_start"]
                new = replacement(shelf, s["intensity"], "impact", beside, {s["clip_id"]}, usage, rules)
                if new is not None:
                    more = s | {"track_start": mid, "duration": end - mid, "cut_in": True, "new": True}
                    put(more, new)
                    slots.insert(i + 1, more)
                    done.append(f"split {f['pos']} {mid}")
        elif f["action"] == "lengthen" and i is not None and i + 1 < len(slots):
            after = slots.pop(i + 1)
            slots[i]["duration"] = after["track_start"] + after["duration"] - slots[i]["track_start"]
            done.append(f"merge {f['pos']}")
    return slots, done


CLIP = ("quality", "intensity", "impact", "cluster", "start", "dur")
ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}


def revised(plans: DataFrame, found: DataFrame, library: DataFrame, shelf: Shelf, keys: Sequence[str], rules: Rules) -> DataFrame:
    """keys, SLOT, applied: all plans after one revision, slots numbered anew from 0; ``applied`` (the same in all rows of a plan) says what was done.

    ``plans`` has keys and SLOT, ``found`` keys and an audit's findings;
    ``library`` has id and the columns of CLIP and colour, for what findings
    bring in by name.
    """
    spark = plans.sparkSession
    sent = spark.sparkContext.broadcast(shelf)
    footage = library.select(F.col("id").alias("clip_id"), F.struct(*CLIP, "colour").alias("clip"))
    asked = found.withColumn("turn", F.row_number().over(ordered(keys))).join(footage, "clip_id", "left")
    kinds = dict(plans.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + f", {SLOT}, applied string"
    made = pa.schema([(n, ARROW[kind]) for n, kind in (c.split() for c in f"{SLOT}, applied string".split(", "))])

    def taken(clip_id: int, c: dict) -> Taken:
        colour = np.array([x for x in c["colour"]], dtype=float)
        return Taken(-1, -1, int(clip_id), 0.0, c["quality"], c["intensity"], c["impact"], NO_CLUSTER if c["cluster"] is None else c["cluster"], colour, 0.0, c["start"], c["dur"])

    def change(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                turn, out = [], []
                slots, findings = (batch.column(n).slice(at, 256).to_pylist() for n in ("_slots", "_found"))
                for i, (mine, asked) in enumerate(zip(slots, findings, strict=True), at):
                    asked = sorted(asked, key=lambda f: f["turn"])
                    for f in asked:
                        f["clip"] = taken(f["clip_id"], f["clip"]) if f["clip"] is not None else None
                    now, done = revise(sorted(mine, key=lambda s: s["pos"]), asked, sent.value, rules)
                    turn += [i] * len(now)
                    out += [{**{n: s[n] for n in NAMES}, "pos": k, "applied": "; ".join(done)} for k, s in enumerate(now)]
                own = pa.RecordBatch.from_pylist(out, schema=made)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(turn, pa.int64())) for k in keys), *own.columns], names=[*keys, *made.names])

    # a plan is one row: its slots and what was found in them, in arrays; a plan without findings stays
    one, other = F.struct(*NAMES), F.struct("turn", "pos", "action", "prefer", "match_intensity", "to_frames", "clip_id", "clip")
    both = plans.select(*keys, one.alias("_s")).unionByName(asked.select(*keys, other.alias("_f")), allowMissingColumns=True)
    whole = both.repartition(busy(spark), *keys).groupBy(*keys).agg(F.collect_list("_s").alias("_slots"), F.collect_list("_f").alias("_found"))
    return whole.mapInArrow(change, schema)


def fitted(plans: DataFrame, library: DataFrame, kenburns: bool, shake: bool, flash: bool, fps: int = 30) -> DataFrame:
    """``plans`` with source_start, speed and effects of the slots whose clip was changed, for the duration that it was changed for; null elsewhere."""
    footage = library.select(F.col("id").alias("clip_id"), "start", "dur")
    rows = plans.join(footage, "clip_id", "left")
    start, speed = X.source_window(F.col("start"), F.col("start") + F.col("dur"), F.lit(None).cast("double"), F.col("fitted") / float(fps), F.lit(None).cast("double"))
    effects = X.effects(F.col("intensity") > 0.55, F.col("level") == "high", F.col("is_drop"), *map(F.lit, (kenburns, shake, flash)))
    changed = F.col("fitted").isNotNull()
    return rows.withColumns({"source_start": F.when(changed, start), "speed": F.when(changed, speed), "effects": F.when(changed, F.array_join(effects, ","))}).drop("start", "dur")


def converged(first: DataFrame, audit: Callable[[DataFrame], DataFrame], revision: Callable[[DataFrame, DataFrame], DataFrame], keys: Sequence[str], rounds: int = 4, good: int = 96, gain: int = 2) -> tuple[DataFrame, DataFrame]:
    """(history, best): keys, version, score, n_issues, stopped of every version of every plan; and the slots of each plan's best version.

    ``audit`` gives findings of plans (keys, SLOT), ``revision`` the next
    version from plans and findings.  A plan stops at ``good``, where it gains
    less than ``gain``, where nothing could be applied, or after ``rounds``
    versions; only those that go on are audited again.  The first of equally
    good versions is the best.
    """
    history: DataFrame | None = None
    versions: list[DataFrame] = []
    active = written(first.withColumn("applied", F.lit("")), "version")
    for version in range(1, rounds + 1):
        found = written(audit(active.drop("applied")), "findings")
        versions.append(active.withColumn("version", F.lit(version)))
        score = scores(found, active, keys).withColumn("version", F.lit(version))
        if version > 1:
            before = history.filter(F.col("version") == version - 1).select(*keys, F.col("score").alias("_before"))
            score = score.join(before, list(keys))
        else:
            score = score.withColumn("_before", F.lit(None).cast("int"))
        reason = F.when(F.col("score") >= good, "good").when(F.col("score") - F.col("_before") < gain, "no gain").when(F.lit(version == rounds), "rounds")
        score = written(score.select(*keys, "version", "score", "n_issues", reason.alias("stopped")), "scores")
        going = score.filter("stopped is null").select(*keys)
        if version < rounds and going.limit(1).count():
            later = written(revision(active.join(going, list(keys), "left_semi").drop("applied"), found.join(going, list(keys), "left_semi")), "version")
            idle = later.groupBy(*keys).agg(F.max(F.col("applied") == "").alias("_idle")).filter("_idle").select(*keys, F.lit("nothing to do").alias("_why"))
            score = written(score.join(idle, list(keys), "left").withColumn("stopped", F.coalesce("stopped", "_why")).drop("_why"), "scores")
            active = later.filter("applied <> ''")
        else:
            active = active.limit(0)
        history = score if history is None else history.unionByName(score)
        if not active.limit(1).count():
            break
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "version"))
    best = history.withColumn("_n", rank).filter("_n = 1").select(*keys, "version", "score")
    slots = versions[0]
    for v in versions[1:]:
        slots = slots.unionByName(v)
    return history, slots.join(best, [*keys, "version"])
