import gzip
import hashlib
import zlib

import numpy as np
import pytest

from chronoloom.llm import warc
from chronoloom.sources.store import shared_dir

BIG = "<p>ä body of a page</p>" * 60
FAKE = warc.plain_record(99, "http://x/", b"not a record", hashlib.sha1(b"not a record").hexdigest(), None, False)


def pages(spark, rows):
    return spark.createDataFrame([(h, i, "t", u, "x") for i, u, h in rows], "html string, page_id long, type string, url string, payload string").repartition(3)


def warc_id(row):
    digits = row["record_id"].split(":")[-1][:-1]
    return int(digits) if digits else None


def brute(rows, least=1000):
    groups: dict = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= least and i is not None:
            groups[h] = max(groups.get(h, i), i)
    out = []
    for i, _, h in rows:
        raw, first = (h or "").encode(), groups.get(h)
        again = first is not None and first != i
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r))


ROWS = [(1, "http://a/ü x\r\ny", BIG), (2, None, BIG), (7, "http://b", BIG), (7, "http://b", BIG), (3, "u", None), (4, "u", ""), (None, "u", BIG), (None, None, "short"), (5, "u", "same short"), (6, "u", "same short"),
        (8, "u", FAKE.decode() * 3 + "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n" + FAKE.decode()), (9, "u", "x" * 300_000), (10, "u", "WARC/1.1\r\n" * 500), (-3, "u", BIG + "x"), (-4, "u", BIG + "x")]


@pytest.mark.parametrize("level,span", [(None, 30_000), (4, 900)])
def test_what_is_written_is_read(spark, level, span):
    uri = shared_dir(spark, "archives")
    manifest = warc.write(pages(spark, ROWS), uri, level=level, file_bytes=60_000)
    got = [tuple(r) for r in warc.read(manifest, span).select(warc.key_column("record_id"), "payload_bytes", "payload_digest", "type", warc.key_column("refers_to")).collect()]
    assert sorted(got, key=lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)) == brute(ROWS)
    rows = warc.read(manifest, 1 << 20).collect()
    held = {(warc_id(r), r["payload"]) for r in rows if r["type"] == "response"}
    assert {(i, bytes(p)) for i, p in held} == {(i, (h or "").encode()) for i, _, h in ROWS if (i, h) not in ((1, BIG), (2, BIG), (None, BIG), (-4, BIG + "x"))}
    urls = {r["url"] for r in rows}
    assert "http://a/%C3%BC%20x%0D%0Ay" in urls and None in urls
    listed = warc.files(spark, uri)
    assert listed.count() == manifest.count() and len(rows) == len(ROWS)


@pytest.mark.parametrize("packed", [False, True])
def test_records_inside_payloads_are_rejected(spark, packed, tmp_path):
    """Payloads made of whole records, gzip members too (stored, so that their magic stands in the file): only the chain tells them apart."""
    make = (lambda c: gzip.compress(c)) if packed else (lambda c: c)  # foreign members without a length of their own
    inner = b"".join(make(FAKE) for _ in range(50))
    body = lambda p: warc.plain_record(1, "http://x", p, hashlib.sha1(p).hexdigest(), None, False)
    outer = [body(inner), body(b"plain"), body(inner * 3), body(b"")]
    stored = lambda c: gzip.compress(c, 0) if packed else c
    (tmp_path / "a.warc").write_bytes(b"".join(stored(c) for c in outer))
    manifest = spark.createDataFrame([(f"file://{tmp_path}/a.warc", (tmp_path / "a.warc").stat().st_size)], "path string, size long")
    found = warc.candidates(manifest, 3000).collect()
    assert sum(len(warc.numbers(r["starts"])) for r in found) > 190
    got = warc.read(manifest, 3000).orderBy("place").collect()
    assert [bytes(r["payload"]) for r in got] == [inner, b"plain", inner * 3, b""]


def test_a_torn_file_is_an_error(spark, tmp_path):
    whole = b"".join(warc.member(FAKE) for _ in range(20))
    for name, content in {"cut": whole[:-5], "gap": whole + b"junk" + warc.member(FAKE), "none": b"nothing"}.items():
        (tmp_path / name).write_bytes(content)
        manifest = spark.createDataFrame([(f"file://{tmp_path}/{name}", len(content))], "path string, size long")
        with pytest.raises(ValueError, match=name):
            warc.read(manifest, 500).count()


def test_a_payload_of_another_digest_is_an_error():
    bad = warc.plain_record(1, "u", b"payload", "00" * 20, None, False)
    with pytest.raises(ValueError, match="payload"):
        warc.parsed(bad)


def test_exits_equal_a_walk():
    rng = np.random.default_rng(3)
    for _ in range(200):
        starts = np.unique(rng.integers(0, 100, rng.integers(0, 30)))
        after = starts + rng.integers(1, 60, len(starts))
        to = dict(zip(starts.tolist(), after.tolist(), strict=True))
        want = []
        for s in starts.tolist():
            at = s
            while at in to:
                at = to[at]
            want.append(at if at >= 100 else warc.NOWHERE)
        assert warc.exits(starts, after, 100).tolist() == want


def test_members_say_how_long_they_are():
    raw = warc.member(b"content" * 100)
    assert gzip.decompress(raw) == b"content" * 100 and zlib.decompress(raw, 31) == b"content" * 100
    assert warc.EXTRA.unpack(raw[warc.MEMBER.size : warc.MEMBER.size + warc.EXTRA.size]) == (b"sl", 8, len(raw), 700)


def test_hot_and_cold_groups(spark):
    """A group of a third of all rows, many small ones, and single rows."""
    rows = [(i, "u", BIG) for i in range(700)] + [(1000 + i, "u", BIG + str(i % 400)) for i in range(800)] + [(3000 + i, "u", BIG + f"-{i}") for i in range(600)]
    got = warc.with_originals(pages(spark, rows)).select("key", "original").collect()
    assert {(k, None if o == k else o) for k, o in got} == {(i, o) for i, _, _, _, o in brute(rows)} and len(got) == len(rows)


def test_empty_table(spark):
    manifest = warc.write(pages(spark, []), shared_dir(spark, "archives"))
    assert manifest.count() == 0 and warc.read(manifest).count() == 0


def test_schemes_of_spark_are_known(monkeypatch):
    asked = []
    from chronoloom.llm import common

    monkeypatch.setattr(common, "pyarrow", type("P", (), {"fs": type("F", (), {"FileSystem": type("S", (), {"from_uri": staticmethod(lambda u: asked.append(u))})})}))
    for uri in ("s3a://b/k", "file:///tmp/x", "abfss://c@a/k"):
        common.filesystem(uri)
    assert asked == ["s3://b/k", "file:///tmp/x", "abfs://c@a/k"]
