"""The parsers as functions of SQL, written in SQL themselves: Catalyst inlines them, and no Python runs.

Those that give rows return arrays of structs, for ``inline``
or ``inline_outer``.  Table functions
would be joined back to their argument by its value when called with LATERAL,
which shuffles whole texts; arrays are made and unrolled where the text is.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from chronoloom.functions.parse import LYRIC, MARKUP, STAMP


def _stamp(text: str) -> str:
    """Seconds of a subtitle stamp, null if it isn't one."""
    part = lambda i: f"try_cast(nullif(regexp_extract({text}, r'{STAMP}', {i}), '') AS DOUBLE)"
    return f"{part(1)} * 3600 + {part(2)} * 60 + {part(3)} + {part(4)} / 1000"


def _stripped(text: str) -> str:
    return rf"regexp_replace({text}, r'^\s+|\s+$', '')"


def _let(name: str, value: str, inside: str) -> str:
    """``inside``, in which ``name`` stands for ``value``."""
    return f"transform(array({value}), {name} -> {inside})[0]"


_part = lambda i: f"regexp_extract(line, r'{LYRIC}', {i})"
_LINE = f"""named_struct('line_no', i, 't', round(try_cast({_part(1)} AS DOUBLE) * 60 + try_cast({_part(2)} AS DOUBLE)
  + try_cast(rpad(coalesce(nullif({_part(3)}, ''), '0'), 3, '0') AS DOUBLE) / 1000, 2), 'text', trim({_part(4)}))"""
_CUE = f"""CASE WHEN size(ls) >= 2 AND p > 0 THEN named_struct('cue_no', i, 'start', {_stamp(_stripped("get(ends, 0)"))}, 'end', {_stamp(_stripped("get(ends, 1)"))},
  'text', {_stripped(f"regexp_replace(array_join(slice(ls, p + 1, size(ls)), ' '), r'{MARKUP}', '')")}) END"""
_BLOCK = _let("ls", r"filter(split(block, r'\r\n|[\n\r\x0B\f]'), l -> l RLIKE r'\S')", _let("p", "CAST(array_position(transform(ls, l -> contains(l, '-->')), true) AS INT)", _let("ends", "split(get(ls, p - 1), '-->')", _CUE)))

FUNCTIONS = {
    "srt_seconds(stamp STRING) RETURNS DOUBLE": _stamp("stamp"),
    "lyric_lines(lyrics STRING) RETURNS ARRAY<STRUCT<line_no: INT, t: DOUBLE, text: STRING>>": rf"filter(transform(split(lyrics, r'\r?\n'), (line, i) -> {_LINE}), x -> x.t IS NOT NULL AND x.text <> '')",
    "srt_cues(subtitles STRING) RETURNS ARRAY<STRUCT<cue_no: INT, start: DOUBLE, `end`: DOUBLE, text: STRING>>": rf"""filter(transform(split({_stripped("subtitles")}, r'\r?\n\r?\n'), (block, i) -> {_BLOCK}),
  x -> x.start IS NOT NULL AND x.`end` IS NOT NULL AND x.text <> '')""",
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions temporary ones of the session, in place of those of the same names; their names.

    ``SELECT key, inline(cues) FROM (SELECT key, srt_cues(text) AS cues FROM ...)``
    gives the rows of ``parse.subtitle_cues``, ``lyric_lines`` those of
    ``parse.lyric_lines``: none for a null, an empty text or one without cues.
    ``inline_outer`` with a filter on what came out parses each text once, where
    ``inline`` parses it again to see whether anything comes.  ``srt_seconds(stamp)``
    is a number.
    """
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in FUNCTIONS]
