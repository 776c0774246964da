"""Parsing of subtitles, lyrics, media banners and loose JSON, in Spark's string functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.functions.vocab import IMPACT_CUES, SPEAKERS

# The patterns of subtitle stamps, markup and stamped lyric lines.
STAMP = r"^(\d{2}):(\d{2}):(\d{2})[,.](\d{3})"
MARKUP = r"<[^>]+>"
LYRIC = r"^\[(\d{1,2}):(\d{2})(?:[.:](\d{1,3}))?\]\s*(.*)"


def group(text: Column, pattern: str, i: int) -> Column:
    """Group ``i`` of the first match, null if there is none."""
    return F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))


def srt_seconds(stamp: Column) -> Column:
    """Seconds of HH:MM:SS,mmm (or .mmm) at the start of the text; null if it isn't there with all its digits."""
    h, m, s, ms = (group(stamp, STAMP, i).try_cast("double") for i in range(1, 5))
    return h * 3600 + m * 60 + s + ms / 1000


def lyric_lines(texts: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """keys, line_no, t, text: stamped lines with a text, in their order; a fraction is padded to milliseconds."""
    line = F.col("_line")
    rows = texts.select(*keys, F.posexplode(F.split(text, r"\r?\n")).alias("line_no", "_line"))
    m, s = (F.regexp_extract(line, LYRIC, i) for i in (1, 2))
    frac = F.rpad(F.coalesce(group(line, LYRIC, 3), F.lit("0")), 3, "0")
    t = F.round(m.try_cast("double") * 60 + s.try_cast("double") + frac.try_cast("double") / 1000, 2)
    return rows.select(*keys, "line_no", t.alias("t"), F.trim(F.regexp_extract(line, LYRIC, 4)).alias("text")).filter("t is not null and text <> ''")


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def subtitle_cues(texts: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """keys, cue_no, start, end, text: blocks between empty lines with a valid time line; markup goes, lines are joined by spaces.

    Only lines without any character part blocks; those of white space within a
    block are skipped.  cue_no counts blocks, whether they are cues or not.
    """
    blocks = texts.select(*keys, F.posexplode(F.split(stripped(F.col(text)), r"\r?\n\r?\n")).alias("cue_no", "_block"))
    lines = F.filter(F.split("_block", r"\r\n|[\n\r\x0B\f]"), lambda l: l.rlike(r"\S"))
    at = F.array_position(F.transform(lines, lambda l: F.contains(l, F.lit("-->"))), F.lit(True)).cast("int")
    rows = blocks.select(*keys, "cue_no", lines.alias("_lines"), at.alias("_at")).filter("size(_lines) >= 2 and _at > 0")
    ends = F.split(F.get("_lines", F.col("_at") - 1), "-->")
    body = F.array_join(F.slice("_lines", F.col("_at") + 1, F.size("_lines")), " ")
    out = rows.select(*keys, "cue_no", srt_seconds(stripped(F.get(ends, 0))).alias("start"), srt_seconds(stripped(F.get(ends, 1))).alias("end"), stripped(F.regexp_replace(body, MARKUP, "")).alias("text"))
    return out.filter("start is not null and end is not null and text <> ''")


def speaker_of(label: Column, vocabulary: Sequence[str] = SPEAKERS) -> Column:
    """A capitalised label names a speaker (or other); any other label is a sound, and gives null."""
    name = F.regexp_replace(F.lower(label), "[^a-z]", "")
    return F.when(label.rlike(r"^\p{Lu}"), F.when(name.isin(*vocabulary), name).otherwise("other"))


def labelled(cues: DataFrame, text: str = "text", vocabulary: Sequence[str] = SPEAKERS) -> DataFrame:
    """``cues`` with speaker, sounds (array) and what is left as dialogue (null if nothing)."""
    lead = group(F.trim(F.col(text)), r"^\[([^\]]{1,40})\]", 1)
    rest = F.when(lead.isNotNull(), F.regexp_replace(F.trim(F.col(text)), r"^\[[^\]]{1,40}\]\s*", "")).otherwise(F.trim(F.col(text)))
    speaker = speaker_of(lead, vocabulary)
    found = F.regexp_extract_all(rest, F.lit(r"\[([^\]]{1,40})\]"), 1)
    sounds = F.transform(F.concat(F.when(lead.isNotNull() & speaker.isNull(), F.array(lead)).otherwise(F.array().cast("array<string>")), found), lambda s: F.trim(F.lower(s)))
    left = F.trim(F.regexp_replace(F.regexp_replace(rest, r"\[[^\]]{1,40}\]", ""), r"\s+", " "))
    return cues.withColumns({"speaker": speaker, "sounds": sounds, "dialogue": F.nullif(left, F.lit(""))})


def is_impact(cue: Column) -> Column:
    return cue.isin(*IMPACT_CUES)


def banner(lines: DataFrame, keys: Sequence[str], line: str) -> DataFrame:
    """keys, duration, width, height, fps, has_audio from a media tool's banner; the last matching line counts."""
    text, n = F.col(line), F.col("line_no")
    h, m, s = (group(text, r"Duration:\s*(\d+):(\d+):([\d.]+)", i).try_cast("double") for i in (1, 2, 3))
    video = F.contains(text, F.lit("Video:"))
    pick = lambda value: F.max_by(value, F.when(value.isNotNull(), n))
    return lines.groupBy(*keys).agg(
        pick(h * 3600 + m * 60 + s).alias("duration"),
        pick(F.when(video, group(text, r"(\d{2,5})x(\d{2,5})", 1).try_cast("int"))).alias("width"),
        pick(F.when(video, group(text, r"(\d{2,5})x(\d{2,5})", 2).try_cast("int"))).alias("height"),
        pick(F.when(video, group(text, r"([\d.]+)\s+fps", 1).try_cast("double"))).alias("fps"),
        F.bool_or(F.contains(text, F.lit("Audio:"))).alias("has_audio"),
    )


def scene_cuts(lines: DataFrame, keys: Sequence[str], line: str) -> DataFrame:
    """keys, t: distinct cut times of a filter's log."""
    return lines.select(*keys, group(F.col(line), r"pts_time:([0-9.]+)", 1).try_cast("double").alias("t")).filter("t is not null").distinct()


def subtitle_tracks(lines: DataFrame, keys: Sequence[str], line: str) -> DataFrame:
    """keys, stream, lang (und if unknown), forced."""
    p = r"Stream #0:(\d+)\(?(\w+)?\)?: Subtitle"
    return lines.select(*keys, group(F.col(line), p, 1).try_cast("int").alias("stream"), F.coalesce(group(F.col(line), p, 2), F.lit("und")).alias("lang"), F.contains(F.lower(line), F.lit("forced")).alias("forced")).filter("stream is not null")


def loudness(text: Column) -> Column:
    return F.coalesce(group(text, r"mean_volume:\s*(-?[0-9.]+) dB", 1).try_cast("double"), F.lit(-99.0))


def loose_json(text: Column) -> Column:
    """The text as a VARIANT, else what lies from its first { to its last }, else null."""
    first, after = F.locate("{", text), F.instr(F.reverse(text), "}")
    inner = F.when((first > 0) & (after > 0), F.substr(text, first, F.length(text) - after - first + F.lit(2)))
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(inner))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def dotenv(lines: DataFrame, line: str = "value") -> DataFrame:
    """name, value of lines name=value; blank lines and comments go, quotes are stripped."""
    t = F.trim(F.col(line))
    parts = F.split(t, "=", 2)
    return lines.filter((t != "") & ~t.startswith("#") & F.contains(t, F.lit("="))).select(F.trim(F.get(parts, 0)).alias("name"), F.regexp_replace(F.trim(F.get(parts, 1)), "^[\"']+|[\"']+$", "").alias("value"))


def number_or(text: Column, default: float) -> Column:
    """A setting as a number; the default where it is missing or no number."""
    return F.coalesce(F.trim(text).try_cast("double"), F.lit(float(default)))
