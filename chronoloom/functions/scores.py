"""Scores that don't depend on earlier choices, and small derived values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronoloom.functions.exprs import clamp01, coerced
from chronoloom.functions.vocab import EMOTIONS, SCENES


def slot_score(quality: Column, intensity: Column, impact: Column, duration: Column, rel: Column, slot: Column, is_peak: Column) -> Column:
    """Fit of a clip to a slot: quality, closeness of intensity, length (short clips lose), impact at peaks."""
    short = F.when(duration < 0.55 * slot, 1 - duration / F.nullif(0.55 * slot, F.lit(0.0))).otherwise(0.0)
    return 0.9 * quality + 1.2 * (1 - F.abs(intensity - rel)) - short + F.when(is_peak, 1.3 * impact + 0.4 * intensity).otherwise(0.3 * (1 - intensity))


def arc_score(quality: Column, intensity: Column, duration: Column, rel: Column, slot: Column, fight: Column, emotion: Column, scene: Column, characters: Column, act_emotions: Column, act_characters: Column, present: Column, proxy: Column) -> Column:
    """Fit of a clip to a slot of an act: a tagged one by its tag, an untagged one (null emotion) by its motion, both by who speaks then."""
    base = 0.9 * quality + 0.9 * (1 - F.abs(intensity - rel)) + F.when(fight, intensity).otherwise(-0.6 * intensity)
    here = F.coalesce(F.arrays_overlap(characters, act_characters), F.lit(False))
    some = F.coalesce(F.size(characters) > 0, F.lit(False))
    tagged = (
        F.when(F.array_contains(act_emotions, emotion), 1.6).otherwise(0.0)
        + F.when(fight & (scene == "action"), 0.7).when(~fight & scene.isin("dialogue", "establishing", "reaction"), 0.6).otherwise(0.0)
        + F.when(some & here, 1.3).otherwise(0.0)
        + F.when(some & (~here | F.array_contains(characters, "crowd")), -1.2).otherwise(0.0)
    )
    untagged = F.when(F.array_contains(act_emotions, proxy), 0.5).otherwise(0.0)
    fill = duration / F.nullif(slot, F.lit(0.0))
    return base + F.when(emotion.isNotNull(), tagged).otherwise(untagged) + F.when(present, 0.7).otherwise(0.0) + F.when(fill < 0.9, -3.2 * (0.9 - fill) / 0.9).otherwise(0.0)


def tempo(lag: Column, rate: float) -> Column:
    """Beats a minute of a lag, folded into 80 to 180; 120 where there is none."""
    bpm = 60.0 * rate / lag
    return F.round(F.coalesce(F.when(bpm < 80, bpm * 2).when(bpm > 180, bpm / 2).otherwise(bpm), F.lit(120.0)), 2)


def keyframe_times(start: Column, duration: Column, peaks: Column, action: Column) -> Column:
    """One to six times: an action's peaks in order of rank, more than 0.25 s apart, then evenly spaced ones inside the middle."""
    n = F.greatest(F.lit(1), F.least(F.lit(6), 1 + F.floor(duration / 2) + F.when(action, 2).otherwise(0))).cast("int")
    chosen = F.aggregate(
        F.when(action, peaks).otherwise(F.array().cast("array<double>")), F.array().cast("array<double>"),
        lambda acc, t: F.when((F.size(acc) < n) & ~F.exists(acc, lambda c: F.abs(c - t) <= 0.25), F.concat(acc, F.array(t))).otherwise(acc),
    )
    missing = n - F.size(chosen)
    lo, width = start + 0.12 * duration, 0.76 * duration
    filler = F.when(missing > 0, F.transform(F.sequence(F.lit(1), F.greatest(missing, F.lit(1))), lambda k: lo + width * k / (missing + 1))).otherwise(F.array().cast("array<double>"))
    return F.slice(F.array_sort(F.transform(F.concat(chosen, filler), lambda t: F.round(t, 3))), 1, n)


def tag(record: Column) -> Column:
    """A tag struct from a VARIANT: closed emotion and scene, description of 200 characters at most, confidence within 0 and 1."""
    get = lambda path, kind: F.try_variant_get(record, path, kind)
    return F.struct(
        F.coalesce(get("$.characters", "array<string>"), F.array().cast("array<string>")).alias("characters"),
        coerced(get("$.emotion", "string"), EMOTIONS, "neutral").alias("emotion"),
        coerced(get("$.scene_type", "string"), SCENES, "establishing").alias("scene_type"),
        F.substring(F.trim(F.coalesce(get("$.description", "string"), F.lit(""))), 1, 200).alias("description"),
        clamp01(F.coalesce(get("$.confidence", "double"), F.lit(0.0))).alias("confidence"),
    )


# Fields of a general description that are lists, and that are words.
LISTS = ("subjects", "actions", "objects", "emotion", "clothing", "color_palette", "observed", "inferred")
WORDS = ("scene", "environment", "setting_kind", "composition", "lighting", "mood")


def general(record: Column) -> Column:
    """A whole description from a VARIANT: lists of what is there (a bare value is a list of one), words or "unknown", text, camera, people_count, confidence."""
    get = lambda path, kind: F.try_variant_get(record, path, kind)
    none = F.array().cast("array<string>")

    def listed(name: str) -> Column:
        kind, bare = F.schema_of_variant(get(f"$.{name}", "variant")), get(f"$.{name}", "string")
        return F.when(kind.startswith("ARRAY"), F.coalesce(get(f"$.{name}", "array<string>"), none)).when(F.coalesce(bare, F.lit("")) == "", none).otherwise(F.array(bare))

    word = lambda path: F.coalesce(F.nullif(get(path, "string"), F.lit("")), F.lit("unknown"))
    return F.struct(
        *[listed(n).alias(n) for n in LISTS],
        *[word(f"$.{n}").alias(n) for n in WORDS],
        F.coalesce(get("$.text", "string"), F.lit("")).alias("text"),
        F.struct(*[word(f"$.camera.{n}").alias(n) for n in ("shot_type", "movement", "angle")]).alias("camera"),
        get("$.people_count", "int").alias("people_count"),
        F.coalesce(get("$.confidence", "double"), F.lit(0.0)).alias("confidence"),
    )


def has_model(installed: Column, wanted: str) -> Column:
    """Whether a model is installed under its full name or under the same name before the colon."""
    return F.exists(installed, lambda m: (m == wanted) | (F.split_part(m, F.lit(":"), F.lit(1)) == wanted.split(":")[0]))


def suggested_model(ram_gb: Column, small: str, middle: str, large: str) -> Column:
    return F.when((ram_gb > 0) & (ram_gb < 8), small).when((ram_gb > 0) & (ram_gb < 24), middle).otherwise(large)
