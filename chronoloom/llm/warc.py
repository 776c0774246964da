"""WARC archives: written by tasks, and read back in parallel by following the chain of records from each file's start.

**Writing.**  Each record is a gzip member of its own (or plain, as asked).  A
member says in its "sl" extra field how long it is, so a reader finds the next
without inflating it.  Payloads of ``least`` bytes or more that are equal are
stored once: the row with the largest id is the response, others are revisit
records that refer to it and hold the HTTP header only, with the full length
and digest.  Files have names of their own and count only through the manifest
that Spark commits, so what a lost task leaves behind is never read.

**Reading.**  Files are cut into ranges of ``span`` bytes.  A task emits, for
each place in its range that looks like a record (the magic, in payloads too),
where the record after it would begin.  A false one points anywhere, a true one
at the next true one; only those that can be reached from the file's start are
records.  Within a range pointers are doubled in numpy until each candidate
knows where its chain leaves the range; only places that other ranges' chains
enter become rows of their own, and these are followed from the starts of all
files at once by pointer jumping: in round r the reached set is extended by
2^r ranges, and every pointer is replaced by the pointer of what it points to.
So rounds grow with the logarithm of the ranges of the longest file, rows with
their number, and no file's chain meets in one task.  A chain that doesn't end
at the end of its file is an error that names the place.

Then each range's task reads its records: it inflates them, checks lengths and,
for responses, that the payload has the digest that its header says.

Edge cases: null payloads are empty; rows without an id are responses unless
their payload is stored under one; rows that repeat the largest id of their
group are all responses; ids are kept in the record ids, null ones as well;
control characters and such beyond ASCII in urls are percent-encoded, and a
null url gives no such header; repeated rows give repeated records; payloads
longer than a range are read past its end by the task in whose range they
begin; an empty table gives no archive and no record; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm.common import filesystem, pick, written

# Fixed values of the formats.
PLAIN_MAGIC = b"WARC/1."
GZIP_MAGIC = b"\x1f\x8b\x08"
EXTRA = struct.Struct("<2sHII")  # "sl", 8, length of the member, length of its content
MEMBER = struct.Struct("<3sBIBBH")  # magic, flags, time, level, system, length of the extra field
END = b"\r\n\r\n"

MOST_HEADER = 1 << 20
DATE = "2024-01-01T00:00:00Z"
NOWHERE = -1


def quoted(url: str) -> str:
    return "".join(c if 33 <= ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url)


def record_id(key: int | None) -> str:
    return f"<urn:x-record:{'' if key is None else key}>"


def key_column(name: str) -> Column:
    """The id in a column of record ids, null where there is none."""
    return F.nullif(F.regexp_extract(name, "^<urn:x-record:(-?[0-9]*)>$", 1), F.lit("")).cast("long")


def base32_of(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def hex_of(digest: str) -> str:
    return base64.b32decode(digest.removeprefix("sha1:")).hex()


def plain_record(key: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record; a revisit has the HTTP header of its payload, but not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(key)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quoted(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{base32_of(digest)}")
    if revisit:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode("ascii") + END + body + END


def member(content: bytes, level: int = 4) -> bytes:
    """A gzip member of ``content`` that says how long it is, where 32 bits are enough."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    packed = packer.compress(content) + packer.flush()
    tail = struct.pack("<II", zlib.crc32(content), len(content) & 0xFFFFFFFF)
    size = MEMBER.size + EXTRA.size + len(packed) + len(tail)
    if max(size, len(content)) < 1 << 32:
        return MEMBER.pack(GZIP_MAGIC, 4, 0, 0, 255, EXTRA.size) + EXTRA.pack(b"sl", 8, size, len(content)) + packed + tail
    return GZIP_MAGIC + b"\x00" + bytes(4) + b"\x00\xff" + packed + tail


# --- writing


def with_originals(df: DataFrame, least: int = 1000, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """key, url, payload, digest (SHA-1), original: the largest id among the rows of an equal payload of ``least`` bytes or more, where there are several.

    Groups are found from digests alone.  A group with more than a thousandth of
    the rows (there are fewer than a thousand) is joined by broadcast, the others
    by shuffle; shorter payloads take no part in either.
    """
    rows = pick(df, key=id_col, url=url_col, payload=payload_col)
    rows = rows.select(F.col("key").cast("long").alias("key"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("payload").cast("binary"), F.lit(b"")).alias("payload"))
    long = F.octet_length("payload") >= least
    groups = rows.filter(long).groupBy(F.sha2("payload", 256).alias("same")).agg(F.count("*").alias("n"), F.max("key").alias("original")).filter("n > 1 and original is not null")
    groups = written(groups, "groups")
    hot = groups.filter(F.col("n") * 1000 > df.count()).select(F.col("same").alias("hot_same"), F.col("original").alias("hot"))
    rest = groups.join(F.broadcast(hot), groups["same"] == hot["hot_same"], "left_anti").select("same", F.col("original").alias("cold"))
    rows = rows.withColumn("same", F.when(long, F.sha2("payload", 256))).withColumn("digest", F.sha1("payload"))
    rows = rows.join(F.broadcast(hot), F.col("same") == F.col("hot_same"), "left")
    alone = ~long | F.col("hot").isNotNull()
    few = rows.filter(~alone).join(rest, "same", "left")
    columns = ["key", "url", "payload", "digest"]
    return rows.filter(alone).select(*columns, F.col("hot").alias("original")).unionByName(few.select(*columns, F.col("cold").alias("original")))


MANIFEST = "path string, size long, records long"


def write(df: DataFrame, uri: str, least: int = 1000, file_bytes: int = 256 << 20, level: int | None = 4, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes archives below ``uri``; returns the manifest.  ``level`` None writes plain records."""
    rows = with_originals(df, least, id_col, url_col, payload_col)

    def run(batches):
        fs, base = filesystem(uri)
        fs.create_dir(base)
        out, name, size, records = None, "", 0, 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{uri}/{name}"]), pa.array([size]), pa.array([records])], names=["path", "size", "records"])

        for batch in batches:
            for at in range(batch.num_rows):
                key, url, payload, digest, original = (c[at].as_py() for c in batch.columns)
                content = plain_record(key, url, payload, digest, original, original is not None and key != original)
                content = content if level is None else member(content, level)
                if out is None:
                    name, size, records = f"{uuid.uuid4().hex}.warc{'' if level is None else '.gz'}", 0, 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                out.write(content)
                size, records = size + len(content), records + 1
                if size >= file_bytes:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return written(rows.mapInArrow(run, MANIFEST), "manifest")


# --- candidates


class Source:
    """A file read by place, some at a time."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size

    def read(self, at: int, n: int) -> bytes:
        return self.file.read_at(min(n, self.size - at), at) if at < self.size else b""


def plain_length(source: Source, at: int) -> int | None:
    """Length of the plain record at ``at``, from its header; None if there is none."""
    n = 4096
    while True:
        head = source.read(at, n)
        end = head.find(END)
        if end >= 0 or n >= MOST_HEADER or at + n >= source.size:
            break
        n *= 4
    if end < 0:
        return None
    for line in head[:end].split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and (value := value.strip()).isdigit() and len(value) < 19:
            return end + len(END) + int(value) + len(END)
    return None


def gzip_length(source: Source, at: int) -> int | None:
    """Length of the gzip member at ``at``: as its "sl" field says, else by inflating it; None if it can't be one."""
    head = source.read(at, MEMBER.size + EXTRA.size)
    if len(head) < 18 or head[3] & 0xE0:
        return None
    if head[3] & 4 and len(head) == MEMBER.size + EXTRA.size:
        tag, wide, size, _ = EXTRA.unpack(head[MEMBER.size :])
        if tag == b"sl" and wide == 8:
            return size
    inflate, done = zlib.decompressobj(31), 0
    while not inflate.eof:
        data = source.read(at + done, 1 << 16)
        if not data:
            return None
        done += len(data)
        try:
            while data and not inflate.eof:  # a bounded part of the content at a time
                inflate.decompress(data, 1 << 20)
                data = inflate.unconsumed_tail
        except zlib.error:
            return None
    return done - len(inflate.unused_data)


def candidates_in(source: Source, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Where in [start, end) the magic stands, and where the record after each would begin."""
    gz = source.read(0, 3) == GZIP_MAGIC
    magic, length = (GZIP_MAGIC, gzip_length) if gz else (PLAIN_MAGIC, plain_length)
    data = source.read(start, end - start + len(magic) - 1)
    at, found = data.find(magic), []
    while at >= 0:
        n = length(source, start + at)
        if n is not None:
            found.append((start + at, start + at + n))
        at = data.find(magic, at + 1)
    pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def exits(starts: np.ndarray, after: np.ndarray, end: int) -> np.ndarray:
    """Where each candidate's chain leaves its range, which ends at ``end``; NOWHERE if it stops within."""
    n = len(starts)
    to = np.searchsorted(starts, after)
    inside = after < end
    there = inside & (to < n) & (starts[np.minimum(to, max(n - 1, 0))] == after) if n else inside
    # pointers to the next candidate of the range, or to one of two ends
    out = np.concatenate([np.where(inside, NOWHERE, after), [NOWHERE]])
    jump = np.concatenate([np.where(there, to, np.arange(n)), [n]])
    while not np.array_equal(further := jump[jump], jump):
        jump = further
    return out[jump][:n]


def walked(starts: np.ndarray, after: np.ndarray, entries: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The candidates of a range that chains from ``entries`` meet."""
    to, met = dict(zip(starts.tolist(), after.tolist(), strict=True)), set()
    for at in entries:
        while at in to and at not in met:
            met.add(at)
            at = to[at]
    keep = np.isin(starts, np.fromiter(met, dtype=np.int64, count=len(met)))
    return starts[keep], after[keep]


# --- reading

RANGE = "path string, size long, part long"
FOUND = "path string, size long, part long, starts binary, after binary"


def numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype="<i8").astype(np.int64)


def ranges(manifest: DataFrame, span: int) -> DataFrame:
    """path, size, part: one row for each ``span`` bytes, dealt out evenly."""
    parts = manifest.filter("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(size - 1) div {span}"))).alias("part"))
    return dealt(parts)


#: Most tasks that read archives.
READERS = 100_000


def dealt(df: DataFrame) -> DataFrame:
    """A row is little to shuffle but much to do, so rows are dealt out by number, not by bytes."""
    return df.repartition(min(max(df.count(), 1), READERS))


def candidates(manifest: DataFrame, span: int) -> DataFrame:
    """One row a range: where in it records may begin, and where the ones after them would."""

    def run(batches):
        for batch in batches:
            for path, size, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, name = filesystem(path)
                with fs.open_input_file(name) as file:
                    starts, after = candidates_in(Source(file, size), part * span, min((part + 1) * span, size))
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([part], pa.int64()), pa.array([starts.astype("<i8").tobytes()], pa.binary()), pa.array([after.astype("<i8").tobytes()], pa.binary())], names=["path", "size", "part", "starts", "after"])

    return ranges(manifest, span).mapInArrow(run, FOUND)


def reached(found: DataFrame, span: int) -> DataFrame:
    """path, entry: the places at which the chains from the files' starts enter ranges.  Raises where a chain breaks."""

    def leaving(batches):
        for batch in batches:
            for path, size, part, starts, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = np.unique(exits(numbers(starts), numbers(after), min((part + 1) * span, size)))
                out = out[(out != NOWHERE) & (out < size)]
                out = np.concatenate([[0], out]) if part == 0 else out
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(out), pa.string()), pa.array(out, pa.int64())], names=["path", "entry"])

    def edges(batches):
        for batch in batches:
            for path, size, part, starts, after, entries in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                starts, entries = numbers(starts), np.array(sorted(entries), dtype=np.int64)
                out = exits(starts, numbers(after), min((part + 1) * span, size))
                at = np.searchsorted(starts, entries)
                there = (at < len(starts)) & (starts[np.minimum(at, len(starts) - 1)] == entries) if len(starts) else np.zeros(len(entries), dtype=bool)
                to = np.full(len(entries), NOWHERE)
                to[there] = out[at[there]]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(entries), pa.string()), pa.array(entries), pa.array(to), pa.array(to == size)], names=["path", "entry", "to", "whole"])

    entries = found.mapInArrow(leaving, "path string, entry long").groupBy("path", F.expr(f"entry div {span}").alias("part")).agg(F.collect_set("entry").alias("entries"))
    graph = written(found.join(entries, ["path", "part"]).select("path", "size", "part", "starts", "after", "entries").mapInArrow(edges, "path string, entry long, to long, whole boolean"), "edges")
    nodes = graph.select("path", F.col("entry").alias("to"))
    jump = written(graph.select("path", "entry", "to").join(nodes, ["path", "to"], "left_semi"), "jump")
    met = graph.select("path", "entry").filter("entry = 0")
    # round r: what was reached jumps 2^r ranges; pointers double until none is left
    while jump.limit(1).count():
        step = met.join(jump, ["path", "entry"]).select("path", F.col("to").alias("entry"))
        met = written(met.unionByName(step).distinct(), "met")
        onward = jump.select("path", F.col("entry").alias("to"), F.col("to").alias("further"))
        jump = written(jump.join(onward, ["path", "to"]).select("path", "entry", F.col("further").alias("to")), "jump")
    torn = met.join(graph, ["path", "entry"]).groupBy("path").agg(F.max("whole").alias("whole"), F.max("entry").alias("entry")).filter("not whole").limit(1).collect()
    if torn:
        raise ValueError(f"{torn[0]['path']}: the chain of records that enters at byte {torn[0]['entry']} does not reach the end of the file")
    return met


RECORDS = "path string, place long, type string, record_id string, refers_to string, url string, payload_bytes long, payload_digest string, payload binary"


def parsed(content: bytes) -> tuple[str, str, str | None, str | None, int, str, bytes | None]:
    """type, record id, refers to, url, payload's length, its SHA-1 and, for responses, the payload itself."""
    head, end, body = content.partition(END)
    if not content.startswith(PLAIN_MAGIC) or not end:
        raise ValueError("not a record")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower().decode("ascii")] = value.strip().decode("utf-8")
    body, tail = body[: int(fields["content-length"])], body[int(fields["content-length"]) :]
    if tail != END:
        raise ValueError("a record of another length than its header says")
    http, _, payload = body.partition(END)
    length = next(int(v) for n, _, v in (line.partition(b":") for line in http.split(b"\r\n")[1:]) if n.strip().lower() == b"content-length")
    digest = hex_of(fields["warc-payload-digest"])
    if fields["warc-type"] == "revisit":
        return "revisit", fields["warc-record-id"], fields.get("warc-refers-to"), fields.get("warc-target-uri"), length, digest, None
    if len(payload) != length or hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"record {fields['warc-record-id']}: the payload is not what its header says")
    return fields["warc-type"], fields["warc-record-id"], None, fields.get("warc-target-uri"), length, digest, payload


def read(manifest: DataFrame, span: int = 16 << 20, payloads: bool = True) -> DataFrame:
    """One row a record of the files in ``manifest`` (path, size); ``payloads`` False leaves the payloads themselves out."""
    found = written(candidates(manifest, span), "candidates")
    entered = reached(found, span).groupBy("path", F.expr(f"entry div {span}").alias("part")).agg(F.collect_set("entry").alias("entries"))
    work = written(found.join(entered, ["path", "part"]).select("path", "size", "starts", "after", "entries"), "chains")

    def run(batches) -> Iterator[pa.RecordBatch]:
        names = ["path", "place", "type", "record_id", "refers_to", "url", "payload_bytes", "payload_digest", "payload"]
        kinds = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.binary()]

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for path, size, starts, after, entries in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, name = filesystem(path)
                with fs.open_input_file(name) as file:
                    source = Source(file, size)
                    starts, after = walked(numbers(starts), numbers(after), entries)
                    rows, held, window, base = [], 0, b"", 0
                    for a, b in zip(starts.tolist(), after.tolist(), strict=True):
                        if b > base + len(window):  # a megabyte or more in one request
                            window, base = source.read(a, max(b - a, 1 << 20)), a
                        raw = window[a - base : b - base]
                        got = parsed(zlib.decompress(raw, 31) if raw.startswith(GZIP_MAGIC) else raw)
                        rows.append((path, a, *got[:6], got[6] if payloads else None))
                        held += len(raw) + (len(got[6]) if payloads and got[6] else 0)
                        if held > 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch_of(rows)

    return dealt(work).mapInArrow(run, RECORDS)


def files(spark: SparkSession, uri: str) -> DataFrame:
    """path, size of the archives in a folder, for ``read``; listed by Spark, so any store that it reads will do."""
    return spark.read.format("binaryFile").load(uri).select("path", F.col("length").alias("size"))
