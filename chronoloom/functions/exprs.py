"""Column expressions for scores, levels, vectors and curves.  All stay inside Spark's generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Gates of usable material.
MIN_DURATION, BLACK, BLOWN_OUT, FLAT_SHARPNESS, FLAT_COLOUR = 0.4, 0.06, 0.97, 0.02, 0.05
# Frames of a transition where the profile gives none.
TRANSITION_FRAMES = {"cut": 0, "punch": 8, "whip": 10, "slide": 10, "flash": 7, "glitch": 9}
# Penalty by severity.
PENALTY = {1: 2, 2: 5, 3: 9}
EPS = 1e-9


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def normalised(v: Column, lo: Column, hi: Column) -> Column:
    return clamp01((v - lo) / (hi - lo + EPS))


def level(x: Column, lo: Column, hi: Column) -> Column:
    """high is tested first, so it wins where the bounds are equal."""
    return F.when(x >= hi, "high").when(x <= lo, "low").otherwise("mid")


def exposure(brightness: Column) -> Column:
    return F.when((brightness < BLACK) | (brightness > BLOWN_OUT), 0.0).otherwise(clamp01(1 - F.abs(brightness - 0.45) / 0.55))


def reject_reason(duration: Column, brightness: Column, sharpness: Column, colour: Column) -> Column:
    """The first gate that fails; null if usable."""
    return F.when(duration < MIN_DURATION, "too_short").when(brightness < BLACK, "black").when(brightness > BLOWN_OUT, "blown_out").when((sharpness < FLAT_SHARPNESS) & (colour < FLAT_COLOUR), "flat")


def quality(sharpness: Column, colour: Column, exposed: Column) -> Column:
    return F.round(0.42 * sharpness + 0.28 * colour + 0.30 * exposed, 4)


def emotion_from_motion(action: Column, intensity: Column) -> Column:
    return F.when(action | (intensity > 0.6), "action").when(intensity > 0.35, "tense").otherwise("tender")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """With a small number on the denominator, so zero vectors give 0."""
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + EPS)


def cosine_or_zero(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / F.nullif(norm, F.lit(0.0)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def packed_bits(flags: Column) -> Column:
    """A signed 64-bit integer from up to 64 booleans, the first in the highest bit."""
    return F.aggregate(flags, F.lit(0).cast("long"), lambda s, f: F.shiftleft(s, 1).bitwiseOR(f.cast("long")))


def median_of(values: Column) -> Column:
    """Mean of the two middle elements (or the middle one)."""
    ordered, n = F.array_sort(values), F.size(values)
    lo = F.element_at(ordered, F.floor((n - 1) / 2).cast("int") + 1)
    hi = F.element_at(ordered, F.floor(n / 2).cast("int") + 1)
    return (lo.cast("double") + hi.cast("double")) / 2


def coerced(value: Column, vocabulary: Sequence[str], default: str) -> Column:
    """Exact (trimmed, lower-cased), else the first of the vocabulary contained in it, else the default."""
    v = F.lower(F.trim(value))
    out = F.lit(default)
    for word in reversed(vocabulary):
        out = F.when(F.contains(v, F.lit(word)), word).otherwise(out)
    return F.when(v.isin(*vocabulary), v).when(v.isNull(), default).otherwise(out)


def clamped_line(x: Column, x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """Piecewise linear with clamped ends; a step at ``x1`` where the ends meet."""
    share = F.when(x1 <= x0, F.when(x >= x1, 1.0).otherwise(0.0)).otherwise(clamp01((x - x0) / F.nullif(x1 - x0, F.lit(0.0))))
    return y0 + (y1 - y0) * share


def ease_out(p: Column) -> Column:
    return 1 - (1 - p) * (1 - p) * (1 - p)


def fade_envelope(frame: Column, total: Column, fade_in: Column, fade_out: Column) -> Column:
    rise = F.when(fade_in <= 0, 1.0).otherwise(clamp01(frame / F.nullif(fade_in, F.lit(0))))
    fall = F.when(fade_out <= 0, 1.0).otherwise(clamp01((total - frame) / F.nullif(fade_out, F.lit(0))))
    return F.greatest(F.lit(0.0), F.least(rise, fall))


def duck_volume(frame: Column, start: Column, duration: Column, to: Column, base: Column, ramp: int = 9) -> Column:
    """base before and after, ``to`` within, straight ramps of ``ramp`` frames between."""
    down = clamped_line(frame.cast("double"), start - float(ramp), start.cast("double"), base, to)
    up = clamped_line(frame.cast("double"), (start + duration).cast("double"), start + duration + float(ramp), to, base)
    return F.when(frame <= start, down).when(frame >= start + duration, up).otherwise(to)


def transition_frames(kind: Column, crossfade: Column) -> Column:
    out = F.lit(0)
    for name, n in TRANSITION_FRAMES.items():
        out = F.when(kind == name, n).otherwise(out)
    return F.when(kind.isin("fade", "swell"), crossfade).otherwise(out)


def cycled(pool: Column, position: Column) -> Column:
    return F.element_at(pool, (position % F.size(pool) + 1).cast("int"))


def frames(seconds: Column, fps: float) -> Column:
    """Half to even."""
    return F.bround(seconds * fps).cast("int")


def source_window(lo: Column, hi: Column, peak: Column, slot: Column, force_speed: Column) -> tuple[Column, Column]:
    """(start, speed) of the part of [lo, hi] that fills ``slot``: around the peak where there is one, slowed down (to half at most) where it is short."""
    avail = hi - lo
    want = F.coalesce(force_speed, F.lit(1.0))
    speed = F.when(slot * want > avail, F.greatest(F.lit(0.5), F.round(avail / slot, 3))).otherwise(want)
    need = F.least(slot * speed, avail)
    start = F.coalesce(peak - need / 2, lo + 0.3 * (avail - need))
    return F.round(F.least(F.greatest(start, lo), F.greatest(lo, hi - need)), 3), speed


def penalty(severity: Column) -> Column:
    return F.when(severity == 1, PENALTY[1]).when(severity == 2, PENALTY[2]).when(severity == 3, PENALTY[3]).otherwise(0)


def effects(action: Column, strong: Column, drop: Column, kenburns: Column, shake: Column, flash: Column) -> Column:
    """Effects of a clip in their order, as its profile allows them."""
    return F.array_compact(F.array(F.when(~action & kenburns, "kenburns"), F.when(action & shake & (strong | drop), "shake"), F.when(drop & flash, "flash")))


def pulse(frame: Column, peak: float, last: int) -> Column:
    """A flash: 0, ``peak`` at frame 1, back to 0 at frame ``last``."""
    f = frame.cast("double")
    return F.when(f <= 1, clamp01(f) * peak).otherwise(peak * clamp01((last - f) / (last - 1.0)))


def source_trim(source_start: Column, lead: Column, fps: float) -> Column:
    """The source frame to begin at: half up, earlier by the lead, not below 0."""
    return F.greatest(F.lit(0), F.floor(source_start * fps + 0.5) - lead).cast("int")


def action_of(record: Column, default: str = "replace") -> Column:
    """An action struct from a VARIANT that is an object, a bare name or nothing."""
    name = F.when(F.schema_of_variant(record) == "STRING", F.try_variant_get(record, "$", "string")).otherwise(F.try_variant_get(record, "$.action", "string"))
    return F.struct(F.coalesce(name, F.lit(default)).alias("action"), F.try_variant_get(record, "$.clipId", "string").alias("clip_id"))


def float_range(start: Column, stop: Column, step: Column) -> Column:
    """start, start + step and so on below ``stop``, each from the one before (so rounding adds up as in a loop)."""
    n = F.greatest(F.lit(0), F.ceil((stop - start) / step) + 1).cast("int")
    grown = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.array(start.cast("double")), lambda a, _: F.concat(a, F.array(F.element_at(a, -1) + step)))
    return F.when(start < stop, F.filter(grown, lambda t: t < stop)).otherwise(F.array().cast("array<double>"))


def hue_bin(r: Column, g: Column, b: Column) -> Column:
    """One of 72 bins, 8 hues x 3 saturations x 3 values, of a colour with shares 0 to 1; the last of equal largest channels counts."""
    most, least_ = F.greatest(r, g, b), F.least(r, g, b)
    gap = most - least_ + EPS
    hue = F.when(most == b, (r - g) / gap + 4).when(most == g, (b - r) / gap + 2).otherwise(F.pmod((g - b) / gap, F.lit(6.0)))
    part = lambda x, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(x * n)))
    return (part(F.pmod(hue / 6, F.lit(1.0)), 8) * 9 + part(gap / (most + EPS), 3) * 3 + part(most, 3)).cast("int")
