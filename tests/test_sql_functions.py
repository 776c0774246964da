"""The parsers called from SQL give what they give as DataFrame functions."""

from chronoloom.functions import parse, tables

SRT = "1\r\n00:00:01,000 --> 00:00:02,500\r\n<i>Hi</i>\r\nthere\r\n\r\n2\n00:00:03.000 --> 00:00:04,000 X1:5\n \nyes\n\n3\nnope\n\n4\n0:00:05,000 --> 00:00:06,000\nodd\n\n00:00:07,000 --> 00:00:08,000\n<b></b>\n\n9\n00:00:09,000 --> 00:00:10,000\nlast one"
LRC = "[00:01.5] hi\n[x] no\n[01:02] there \n[00:09]   \n[2:03:25]\tso\r\n[00:01.2345] long"


def both(spark, function, plain, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    tables.register(spark)
    number = "cue_no" if function == "srt_cues" else "line_no"
    got = spark.sql(f"SELECT * FROM (SELECT id, inline_outer(r) FROM (SELECT id, {function}(text) AS r FROM {{t}})) WHERE {number} IS NOT NULL", t=df)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    got, want = (sorted(tuple(r) for r in f.collect()) for f in (got, plain(df, ["id"], "text")))
    assert got == want
    return got


def test_cues(spark):
    texts = [SRT, None, "", "no cue at all", "\n\n".join(f"{i}\n00:{i // 60 % 60:02d}:{i % 60:02d},000 --> 01:00:00,000\nword {i}" for i in range(3000))]
    got = both(spark, "srt_cues", parse.subtitle_cues, texts)
    assert [r[1:] for r in got if r[0] == 0] == [(0, 1.0, 2.5, "Hi there"), (1, 3.0, 4.0, "yes"), (5, 9.0, 10.0, "last one")] and len(got) == 3003


def test_lines(spark):
    got = both(spark, "lyric_lines", parse.lyric_lines, [LRC, None, "", "\n".join(["[00:01] x"] * 5000)])
    assert [r[2:] for r in got if r[0] == 0][:3] == [(1.5, "hi"), (62.0, "there"), (123.25, "so")] and len(got) > 5000


def test_stamps(spark):
    tables.register(spark)
    assert tuple(spark.sql("SELECT srt_seconds('01:01:02,500'), srt_seconds('0:01:02,500'), srt_seconds(NULL)").first()) == (3662.5, None, None)
