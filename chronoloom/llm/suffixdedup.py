"""Removal of byte strings that also start in an earlier document, with a logarithmic family of suffix arrays.

A byte goes if a string of ``length`` bytes that covers it also starts in a
document with a smaller id; matches never cross documents.

Every window of ``length`` bytes has an anchor: the position in it whose
20-byte string has the least hash (leftmost on ties).  Equal windows have equal
anchors at equal offsets, so all that can match meets when windows are dealt
out by their anchor's hash, and a run of windows with one anchor travels as one
short segment.  Anchors whose hash occurs in one document only are dropped
first.  A task then takes the distinct segments of its hashes in ascending
order of document, a batch at a time: each batch gets a suffix array (window
positions in the order of their first ``length`` bytes), is merge-scanned
against the existing levels for matches, and becomes the newest level; levels
of equal size are merged, so there are logarithmically many.

Documents are held in blocks of about 4 MB, which tasks write to the shared
folder once and read there; what is dealt out is where they are.  A block sends
each digit of the hash (there are ``fan``) one packet, and gets back one answer
to each, in the order of its own entries.  There are as many digits as keep a
digit's packets within what ``bucket_bytes`` of text can make, up to
``MOST_FAN`` (64 GB of text); beyond, packets are gathered into units of about a
block's size, which send packets by the next digit in turn, and pass the
answers on.  Packets of a level are written once
to the shared folder, too.  There are ``fan`` a block and a level, and levels
grow with the logarithm of the input.  Equal entries are
one from the block on, and again in every unit: a passage that a third of all
documents share is one entry a block, a few a unit.  Segments are compared byte
by byte.

Edge cases: null and empty texts have 0 bytes; texts shorter than ``length``
lose nothing; a text longer than a block is a block of its own, whose anchors
are found a stretch at a time; rows with a null id are kept whole and remove
nothing elsewhere; rows with equal ids remove nothing from each other; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import filesystem, groups_by_bytes, pick, shared_dir, written
from chronoloom.llm.jaccard import in_groups

GRAM = 20
STRETCH = 1 << 20
MOST_TASKS = 50_000
TASK_BYTES = 2 << 20
LEAST_FAN, MOST_FAN = 256, 4096


def pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


class Pieces:
    """A file in the shared folder that a task writes piece after piece; there is none without pieces."""

    def __init__(self, uri: str):
        self.uri, self.path, self.place, self.out = uri, f"{uri}/{uuid.uuid4().hex}", 0, None

    def add(self, data: bytes) -> int:
        """Where the piece begins."""
        if self.out is None:
            fs, base = filesystem(self.uri)
            fs.create_dir(base)
            self.out = fs.open_output_stream(filesystem(self.path)[1], compression=None)
        self.out.write(data)
        self.place += len(data)
        return self.place - len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()

    @staticmethod
    def read(at: list[tuple[str, int, int]]) -> list[bytes]:
        """Pieces by path, place and bytes; neighbours in one file are read with it open."""
        out, path, file = [], None, None
        for name, place, size in at:
            if name != path:
                if file is not None:
                    file.close()
                fs, inside = filesystem(name)
                path, file = name, fs.open_input_file(inside)
            out.append(file.read_at(size, place))
        if file is not None:
            file.close()
        return out


def least(values: np.ndarray, places: np.ndarray, shift: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Element-wise least of two stretches of ``n``, ``shift`` apart; the left one on ties."""
    a, b = values[:n], values[shift : shift + n]
    right = b < a
    return np.where(right, b, a), np.where(right, places[shift : shift + n], places[:n])


class Runs:
    """Runs of consecutive windows of one document that have one anchor: first window, count, document's place, anchor's hash."""

    def __init__(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray, judged: np.ndarray, length: int):
        self.text, self.length = text, length
        long = (ends - starts >= length) & judged
        self.starts, self.lasts = starts[long], ends[long] - length  # first and last windows of documents
        parts = [self._stretch(a, min(a + STRETCH, len(text) - length + 1)) for a in range(0, len(text) - length + 1, STRETCH)]
        parts = [p for p in parts if len(p[0])] or [(np.zeros(0, dtype=np.int64),) * 3 + (np.zeros(0, dtype=np.uint64),)]
        first, count, anchor, value = (np.concatenate(c) for c in zip(*parts, strict=True))
        if len(first):  # runs that a stretch's end cut
            new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (first[1:] != first[:-1] + count[:-1])])
            at = np.nonzero(new)[0]
            first, count, value = first[at], np.add.reduceat(count, at), value[at]
        self.first, self.count, self.hash = first, count, value
        self.doc = np.searchsorted(ends, first, side="right")

    def _stretch(self, a: int, z: int) -> tuple[np.ndarray, ...]:
        """Runs of the windows from ``a`` to before ``z``."""
        text, length = self.text[a : z + self.length - 1], self.length
        padded = np.concatenate([text, np.zeros(8, dtype=np.uint8)])
        n = z - a + length - 1
        words = np.ndarray(shape=(n + 1,), dtype="<u8", buffer=padded, strides=(1,))
        m = n - GRAM + 1
        h = words[:m] * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h += words[8 : 8 + m]
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        h += words[12 : 12 + m]
        h *= np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(32)
        values, places = (h >> np.uint64(32)).astype(np.uint32), np.arange(m, dtype=np.int32)
        width, reach = length - GRAM + 1, 1
        while reach * 2 <= width:
            values, places = least(values, places, reach, len(values) - reach)
            reach *= 2
        if reach < width:
            values, places = least(values, places, width - reach, m - width + 1)
        # places[p]: the anchor of the window at a + p
        change = np.zeros(z - a + 1, dtype=np.int32)
        np.add.at(change, np.clip(self.starts - a, 0, z - a), 1)
        np.add.at(change, np.clip(self.lasts + 1 - a, 0, z - a), -1)
        valid = np.nonzero(np.cumsum(change[:-1]) > 0)[0]
        at = places[valid]
        new = np.ones(len(valid), dtype=bool)
        new[1:] = (at[1:] != at[:-1]) | (np.diff(valid) != 1)
        begin = np.nonzero(new)[0]
        return valid[begin] + a, np.diff(np.concatenate([begin, [len(valid)]])), at[begin].astype(np.int64) + a, h[at[begin]]

    def select(self, chosen: np.ndarray) -> None:
        self.first, self.count, self.doc, self.hash = (x[chosen] for x in (self.first, self.count, self.doc, self.hash))

    def segments(self) -> pa.DictionaryArray:
        """Each run's bytes, from its first window's start to its last one's end; equal ones have one index."""
        out = []
        for a in range(0, max(len(self.first), 1), 1 << 15):
            first, size = self.first[a : a + (1 << 15)], self.count[a : a + (1 << 15)] + self.length - 1
            offsets = np.concatenate([[0], np.cumsum(size)])
            at = np.repeat(first - offsets[:-1], size) + np.arange(int(offsets[-1]))
            out.append(pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(self.text[at])]))
        return pa.chunked_array(out).dictionary_encode().combine_chunks()


class Block:
    """Texts of some documents: ids, ends, whether the id is null, bytes."""

    def __init__(self, n: int, packed: bytes, length: int):
        data = np.frombuffer(unpack(packed), dtype=np.uint8)
        self.ids, self.ends = data[: 8 * n].view("<i8"), data[8 * n : 16 * n].view("<i8")
        self.judged, self.text = data[16 * n : 17 * n] == 0, data[17 * n :]
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.runs = Runs(self.text, self.starts, self.ends, self.judged, length)


#: Entries of packets: bits of an anchor's hash (a collision only keeps a segment for the second round) and whether several
#: documents have it; a segment and its least document.  A packet holds what is left of hashes after its digits.
ANCHORS = pa.schema([("hash", pa.uint64()), ("several", pa.uint8())])
ANCHOR_BYTES = 5
ANCHOR_BITS = np.uint64((1 << 8 * ANCHOR_BYTES) - 1)
SEGMENTS = pa.schema([("hash", pa.uint64()), ("doc", pa.int64()), ("segment", pa.binary())])


def equal_hashes(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ascending order of hashes, where in it each distinct one begins, and which of them each row has."""
    order = np.argsort(hashes, kind="stable")
    new = np.ones(len(order), dtype=bool)
    new[1:] = hashes[order][1:] != hashes[order][:-1]
    which = np.empty(len(order), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    return order, np.nonzero(new)[0], which


def anchor_entries(hashes: np.ndarray, several: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(hashes, pa.uint64()), pa.array(several.astype(np.uint8))], schema=ANCHORS)


def distinct_segments(hashes: np.ndarray, docs: np.ndarray, segments: pa.DictionaryArray) -> tuple[pa.RecordBatch, np.ndarray]:
    """Distinct entries, and which of them each row has."""
    which = segments.indices.to_numpy().astype(np.int64)
    n = len(segments.dictionary)
    least_doc, value = np.full(n, np.iinfo(np.int64).max), np.zeros(n, dtype=np.uint64)
    np.minimum.at(least_doc, which, docs)
    value[which] = hashes
    return pa.RecordBatch.from_arrays([pa.array(value), pa.array(least_doc), segments.dictionary], schema=SEGMENTS), which


class AnchorWork:
    """First round: which anchors do several documents have?  Answers are 0 or 1.

    Two senders have two documents: where one id's rows lie apart, more than need be is kept for the second round.
    """

    schema, answer = ANCHORS, np.uint8

    @staticmethod
    def of_block(b: Block) -> tuple[pa.RecordBatch, np.ndarray]:
        hashes, docs = b.runs.hash & ANCHOR_BITS, b.ids[b.runs.doc]
        order, at, which = equal_hashes(hashes)
        if not len(at):
            return anchor_entries(hashes, which), which
        return anchor_entries(hashes[order[at]], np.minimum.reduceat(docs[order], at) != np.maximum.reduceat(docs[order], at)), which

    @staticmethod
    def gathered(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
        hashes, several = (c.to_numpy() for c in batch.columns)
        order, at, which = equal_hashes(hashes)
        if not len(at):
            return batch, which
        return anchor_entries(hashes[order[at]], np.maximum.reduceat(several[order], at) | (np.diff([*at, len(order)]) > 1)), which

    @staticmethod
    def packed(entries: pa.RecordBatch, last: bool) -> bytes:
        """Differences of ascending hashes, byte by byte, then the flags."""
        hashes, several = (c.to_numpy() for c in entries.columns)
        planes = np.diff(hashes, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :ANCHOR_BYTES]
        return pack(planes.T.tobytes() + several.tobytes())

    @staticmethod
    def unpacked(data: bytes) -> pa.RecordBatch:
        planes = np.frombuffer(unpack(data), dtype=np.uint8).reshape(ANCHOR_BYTES + 1, -1)
        apart = np.zeros((planes.shape[1], 8), dtype=np.uint8)
        apart[:, :ANCHOR_BYTES] = planes[:ANCHOR_BYTES].T
        return anchor_entries(np.cumsum(apart.view("<u8").ravel(), dtype=np.uint64), planes[ANCHOR_BYTES])

    @staticmethod
    def judged(entries: pa.RecordBatch, length: int, batch: int) -> np.ndarray:
        return entries.column("several").to_numpy()

    @staticmethod
    def passed_on(rows: pa.RecordBatch, entries: pa.RecordBatch, which: np.ndarray, answers: np.ndarray) -> np.ndarray:
        return answers[which]


class SegmentWork:
    """Second round: which windows of a segment also start in a smaller document?  Answers are bit masks."""

    schema, answer = SEGMENTS, np.uint64

    @staticmethod
    def of_block(b: Block) -> tuple[pa.RecordBatch, np.ndarray]:
        return distinct_segments(b.runs.hash, b.ids[b.runs.doc], b.runs.segments())

    @staticmethod
    def gathered(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
        return distinct_segments(batch.column("hash").to_numpy(), batch.column("doc").to_numpy(), batch.column("segment").dictionary_encode())

    @staticmethod
    def packed(entries: pa.RecordBatch, last: bool) -> bytes:
        """Zeros for hashes that nobody reads any more: they are most of what can't be compressed."""
        if last:
            entries = entries.set_column(0, entries.schema.field(0), pa.array(np.zeros(len(entries), dtype=np.uint64)))
        return pack(entries.serialize().to_pybytes())

    @staticmethod
    def unpacked(data: bytes) -> pa.RecordBatch:
        return pa.ipc.read_record_batch(pa.py_buffer(unpack(data)), SEGMENTS)

    @staticmethod
    def judged(entries: pa.RecordBatch, length: int, batch: int) -> np.ndarray:
        segments = entries.column("segment")
        offsets = np.frombuffer(segments.buffers()[1], dtype=np.int32)[segments.offset : segments.offset + len(segments) + 1].astype(np.int64)
        text = np.frombuffer(segments.buffers()[2] or b"", dtype=np.uint8)
        return judged_segments(entries.column("doc").to_numpy(), np.diff(offsets) - length + 1, offsets[:-1], text, length, batch)

    @staticmethod
    def passed_on(rows: pa.RecordBatch, entries: pa.RecordBatch, which: np.ndarray, answers: np.ndarray) -> np.ndarray:
        return masks_of(rows.column("doc").to_numpy(), entries, which, answers)


def masks_of(docs: np.ndarray, entries: pa.RecordBatch, which: np.ndarray, answers: np.ndarray) -> np.ndarray:
    """Masks of rows from their entries' answers: a later document than the entry's has all bits (readers look at a segment's own windows)."""
    return np.where(docs > entries.column("doc").to_numpy()[which], ~np.uint64(0), answers[which])


def stored_blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Documents in blocks of about ``block_bytes``, written by tasks to files of the shared folder: block, path, place, packed (bytes there), n (documents), size (bytes of text)."""
    uri = shared_dir(docs.sparkSession, "texts")
    schema = "block long, path string, place long, packed long, n long, size long"

    def run(batches):
        from pyspark import TaskContext

        part, seq, file = TaskContext.get().partitionId(), 0, Pieces(uri)
        for batch in batches:
            ids, texts = batch.columns
            raw = [(t or "").encode("utf-8") for t in texts.to_pylist()]
            for a, b in groups_by_bytes([len(r) for r in raw], block_bytes):
                mine, ends = ids.slice(a, b - a), np.cumsum([len(r) for r in raw[a:b]])
                data = pack(b"".join([mine.fill_null(0).to_numpy().astype("<i8").tobytes(), ends.astype("<i8").tobytes(), mine.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes(), *raw[a:b]]))
                yield pa.RecordBatch.from_pylist([{"block": part << 32 | seq, "path": file.path, "place": file.add(data), "packed": len(data), "n": b - a, "size": int(ends[-1])}])
                seq += 1
        file.close()

    return written(pick(docs, id="doc_id", text="text").select(F.col("id").cast("long"), "text").mapInArrow(run, schema), "blocks")


BLOCK = ["path", "place", "packed", "n"]


class SuffixLevels:
    """Suffix arrays over one text: positions of distinct windows in the order of their bytes, in levels of geometric size.

    A level holds its windows' first eight bytes as numbers beside the
    positions, so a scan passes over numbers and looks at the text only where
    they are equal.
    """

    def __init__(self, text: np.ndarray, length: int):
        self.text, self.length = text, length
        wide = min(8, length)
        self.windows, self.starts = (np.lib.stride_tricks.sliding_window_view(text, n) if len(text) >= n else np.zeros((0, n), dtype=np.uint8) for n in (length, wide))
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # heads, positions

    def keys(self, positions: np.ndarray) -> np.ndarray:
        return self.windows[positions].reshape(-1).view(f"S{self.length}")

    def heads(self, positions: np.ndarray) -> np.ndarray:
        first = np.zeros((len(positions), 8), dtype=np.uint8)
        first[:, : self.starts.shape[1]] = self.starts[positions]
        return first.view(">u8").ravel().astype(np.uint64)

    def scan(self, level: tuple[np.ndarray, np.ndarray], heads: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """Which of a batch's windows, in order, are in ``level``: one merge by heads, then a search by whole windows among those of equal heads."""
        low, high = np.searchsorted(level[0], heads, side="left"), np.searchsorted(level[0], heads, side="right")
        found = np.zeros(len(positions), dtype=bool)
        left = np.flatnonzero(low < high)
        while len(left):
            mid = (low[left] + high[left]) // 2
            there, mine = self.keys(level[1][mid]), self.keys(positions[left])
            found[left[there == mine]] = True
            below = there < mine
            low[left[below]] = mid[below] + 1
            high[left[~below]] = mid[~below]
            left = left[~found[left] & (low[left] < high[left])]
        return found

    def add(self, positions: np.ndarray, owners: np.ndarray) -> np.ndarray:
        """Which windows are in a level or belong to a smaller owner of the batch; then the batch joins the levels.

        Owners are ascending, and greater than all added before.
        """
        keys = self.keys(positions)
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        group = np.cumsum(new) - 1
        distinct = positions[order][new]
        heads = self.heads(distinct)
        known = owners[order] > owners[order][new][group]
        old = np.zeros(len(distinct), dtype=bool)
        for level in self.levels:
            todo = np.flatnonzero(~old)
            old[todo] = self.scan(level, heads[todo], distinct[todo])
        out = np.empty(len(order), dtype=bool)
        out[order] = known | old[group]
        self.levels.append((heads[~old], distinct[~old]))
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            (h1, p1), (h2, p2) = self.levels.pop(), self.levels.pop()
            both = np.concatenate([p2, p1])
            merged = np.argsort(self.keys(both), kind="stable")  # two ascending runs
            self.levels.append((np.concatenate([h2, h1])[merged], both[merged]))
        return out


def judged_segments(docs: np.ndarray, counts: np.ndarray, offsets: np.ndarray, text: np.ndarray, length: int, batch: int) -> np.ndarray:
    """For each of distinct segments a mask of its windows (bit j: the window at offset j) that also start in a smaller document."""
    by_doc = np.argsort(docs, kind="stable")
    levels, masks = SuffixLevels(text, length), np.zeros(len(docs), dtype=np.uint64)
    owners, total = docs[by_doc], np.cumsum(counts[by_doc])
    done = 0
    while done < len(by_doc):
        before = int(total[done - 1]) if done else 0
        end = max(int(np.searchsorted(total, before + batch, side="right")), done + 1)
        end = int(np.searchsorted(owners, owners[end - 1], side="right"))  # a document's windows stay in one batch
        part = by_doc[done:end]
        n = counts[part]
        entry = np.repeat(np.arange(len(part)), n)
        j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        hit = levels.add(offsets[part][entry] + j, owners[done:end][entry])
        np.bitwise_or.at(masks, part[entry[hit]], np.uint64(1) << j[hit].astype(np.uint64))
        done = end
    return masks


def by_digit(entries: pa.RecordBatch, fan: int) -> Iterator[tuple[int, np.ndarray]]:
    """Digits of the entries' hashes and the entries of each, in order."""
    digit = (entries.column("hash").to_numpy() % np.uint64(fan)).astype(np.int64)
    order = np.argsort(digit, kind="stable")
    found, start = np.unique(digit[order], return_index=True)
    yield from zip(found.tolist(), np.split(order, start[1:]), strict=False)  # no entries: no digits


#: A packet: its sender, the digits so far as a number, the bytes of its entries.
PACKET = "sender long, bucket long, size long, payload binary"
REPLY = "sender long, bucket long, answer binary"


def packets(entries: pa.RecordBatch, work: type, sender: int, bucket: int, fan: int, last: bool) -> pa.RecordBatch:
    """One packet a digit, with what is left of the hashes."""
    out: dict[str, list] = {"sender": [], "bucket": [], "size": [], "payload": []}
    rest = entries.set_column(0, entries.schema.field(0), pa.array(entries.column("hash").to_numpy() // np.uint64(fan), pa.uint64()))
    for digit, part in by_digit(entries, fan):
        mine = rest.take(pa.array(part))
        out["sender"].append(sender)
        out["bucket"].append(bucket * fan + digit)
        out["size"].append(mine.nbytes)
        out["payload"].append(work.packed(mine, last))
    return pa.RecordBatch.from_pydict(out, schema=pa.schema([("sender", pa.int64()), ("bucket", pa.int64()), ("size", pa.int64()), ("payload", pa.binary())]))


def answers_in_order(entries: pa.RecordBatch, replies: dict[int, bytes], fan: int, kind: type) -> np.ndarray:
    """Answers to all entries of a sender, from the replies by digit (none: all 0)."""
    out = np.zeros(len(entries), dtype=kind)
    for digit, part in by_digit(entries, fan):
        if digit in replies:
            out[part] = np.frombuffer(unpack(replies[digit]), dtype=kind)
    return out


def reply_batch(rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    kept = [(s, b, pack(a.tobytes())) for s, b, a in rows if a.any()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in kept], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["sender", "bucket", "answer"])


def concatenated(payloads: list[bytes], work: type) -> tuple[pa.RecordBatch, np.ndarray]:
    """The packets' entries one after another, and where each packet's begin."""
    tables = [work.unpacked(p) for p in payloads]
    joined = pa.Table.from_batches(tables, work.schema).combine_chunks().to_batches()
    batch = joined[0] if joined else pa.RecordBatch.from_pylist([], work.schema)
    return batch, np.cumsum([0] + [len(t) for t in tables])


def filed(sent: DataFrame) -> DataFrame:
    """Packets whose payloads are in files of the shared folder, to be read twice and dealt out by where they are: sender, bucket, size, path, place, packed."""
    uri = shared_dir(sent.sparkSession, "payloads")

    def run(batches):
        file = Pieces(uri)
        for batch in batches:
            payloads = batch.column("payload").to_pylist()
            places = [file.add(p) for p in payloads]
            kept = [batch.column(c) for c in ("sender", "bucket", "size")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([file.path] * len(places), pa.string()), pa.array(places, pa.int64()), pa.array([len(p) for p in payloads], pa.int64())], names=["sender", "bucket", "size", "path", "place", "packed"])
        file.close()

    return written(sent.mapInArrow(run, "sender long, bucket long, size long, path string, place long, packed long"), "packets")


def answered(sent: DataFrame, work: type, levels: int, length: int, batch: int, fan: int, unit_bytes: int, size: int) -> DataFrame:
    """Replies to the packets ``sent`` by blocks: sender, bucket, answer."""
    stages = []
    for level in range(1, levels):
        stored = filed(sent)
        many = stored.groupBy("bucket").agg(F.ceil(F.sum("size") / unit_bytes).alias("units"))
        unit = F.pmod(F.xxhash64("sender"), F.col("units"))
        # a sender of this level: a part of a bucket; a bucket's number is below fan ** level
        mine = stored.join(many, "bucket").select((unit * fan**level + F.col("bucket")).alias("unit"), F.lit(1).alias("kind"), "sender", "bucket", F.lit(None).cast("binary").alias("answer"), "path", "place", "packed")
        stages.append(mine)

        def regroup(batches, level=level):
            for group in in_groups(1)(batches):
                rows, _ = concatenated(Pieces.read([g[5:] for g in group]), work)
                entries, _ = work.gathered(rows)
                yield packets(entries, work, group[0][0], group[0][3], fan, level == levels - 1)

        sent = mine.repartition("unit").sortWithinPartitions("unit", "path", "place").mapInArrow(regroup, PACKET)

    def judge(batches):
        for group in in_groups(1)(batches):
            rows, at = concatenated([g[2] for g in group], work)
            entries, which = work.gathered(rows)
            answers = work.passed_on(rows, entries, which, work.judged(entries, length, batch))
            yield reply_batch([(g[1], g[0], answers[a:z]) for g, a, z in zip(group, at[:-1], at[1:], strict=True)])

    # by the text's size, up to two partitions a bucket, so that few tasks get several; a given number is not coalesced
    tasks = max(1, min(2 * fan**levels, -(-size // TASK_BYTES), MOST_TASKS))
    replies = sent.select("bucket", "sender", "payload").repartition(tasks, "bucket").sortWithinPartitions("bucket", "sender").mapInArrow(judge, REPLY)
    for mine in reversed(stages):
        back = replies.select(F.col("sender").alias("unit"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("sender"), "bucket", "answer")

        def pass_on(batches):
            for group in in_groups(1)(batches):
                got = {g[3] % fan: g[4] for g in group if g[1] == 0}
                own = [g for g in group if g[1] == 1]
                if not own:
                    continue  # no replies: none of the unit's entries is in another's, but later documents of the unit still have them
                rows, at = concatenated(Pieces.read([g[5:] for g in own]), work)
                entries, which = work.gathered(rows)
                answers = work.passed_on(rows, entries, which, answers_in_order(entries, got, fan, work.answer))
                yield reply_batch([(g[2], g[3], answers[a:z]) for g, a, z in zip(own, at[:-1], at[1:], strict=True)])

        replies = back.unionByName(mine, allowMissingColumns=True).select(*mine.columns).repartition("unit").sortWithinPartitions("unit", "kind", "path", "place").mapInArrow(pass_on, REPLY)
    return replies


def per_block(replies: DataFrame, name: str) -> DataFrame:
    """All replies of a block, ``fan`` at most, in one row: block, replies."""
    grouped = replies.groupBy(F.col("sender").alias("block")).agg(F.collect_list(F.struct("bucket", "answer")).alias(name))
    return written(grouped, name)


def digits(size: int, bucket_bytes: int) -> int:
    """As many digits as keep each within its bytes of text, so that packets go out once; a bounded number."""
    return min(max(LEAST_FAN, -(-size // bucket_bytes)), MOST_FAN)


def remove(docs: DataFrame, length: int = 50, block_bytes: int = 4 << 20, bucket_bytes: int = 16 << 20, batch: int = 1 << 14, fan: int | None = None) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.  ``fan`` is the number of digits; none: from the text's size."""
    if not GRAM + 1 <= length <= GRAM + 62:
        raise ValueError("length must be between 21 and 82")
    blocks = stored_blocks(docs, block_bytes)
    size, n_blocks = blocks.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    tasks, levels = min(max(n_blocks, 1), MOST_TASKS), 1
    fan = fan or digits(size, bucket_bytes)
    while size > bucket_bytes * fan**levels:
        levels += 1
    dealt = blocks.select("block", *BLOCK).repartition(tasks, "block")

    def loaded(rows: pa.RecordBatch) -> Iterator[tuple]:
        """A block and the other columns of each row."""
        for path, place, packed, n, *rest in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            yield Block(n, *Pieces.read([(path, place, packed)]), length), *rest

    def keep_shared(b: Block, marks: list | None) -> None:
        """Only the runs whose anchors other documents have."""
        entries, which = AnchorWork.of_block(b)
        b.runs.select(answers_in_order(entries, {m["bucket"]: m["answer"] for m in marks or []}, fan, np.uint8)[which] > 0)

    def anchors(batches):
        for rows in batches:
            for b, block in loaded(rows):
                yield packets(AnchorWork.of_block(b)[0], AnchorWork, block, 0, fan, levels == 1)

    marks = per_block(answered(dealt.select(*BLOCK, "block").mapInArrow(anchors, PACKET), AnchorWork, levels, length, batch, fan, block_bytes, size), "marks")

    def segments(batches):
        for rows in batches:
            for b, block, found in loaded(rows):
                keep_shared(b, found)
                yield packets(SegmentWork.of_block(b)[0], SegmentWork, block, 0, fan, levels == 1)

    sent = dealt.join(marks.repartition(tasks, "block"), "block").select(*BLOCK, "block", "marks").mapInArrow(segments, PACKET)
    hits = per_block(answered(sent, SegmentWork, levels, length, batch, fan, 4 * block_bytes, size), "hits")

    def cut(batches):
        for rows in batches:
            for b, found, windows in loaded(rows):
                covered = np.zeros(len(b.text) + 1, dtype=np.int32)
                if found:
                    keep_shared(b, found)
                    entries, which = SegmentWork.of_block(b)
                    answers = answers_in_order(entries, {w["bucket"]: w["answer"] for w in windows or []}, fan, np.uint64)
                    first, count = b.runs.first, b.runs.count
                    mine = masks_of(b.ids[b.runs.doc], entries, which, answers)
                    for a in range(0, len(first), 1 << 16):
                        part = slice(a, a + (1 << 16))
                        run = np.repeat(np.arange(len(first[part])), count[part])
                        j = np.arange(len(run)) - np.repeat(np.cumsum(count[part]) - count[part], count[part])
                        hit = (mine[part][run] >> j.astype(np.uint64)) & np.uint64(1) == 1
                        at = (first[part][run] + j)[hit]
                        np.add.at(covered, at, 1)
                        np.add.at(covered, at + length, -1)
                gone = np.cumsum(covered[:-1]) > 0
                edge = gone & np.concatenate([[True], ~gone[:-1]]) if len(gone) else gone
                removed, spans = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(edge)])
                out = []
                for i, (a, z) in enumerate(zip(b.starts.tolist(), b.ends.tolist(), strict=True)):
                    n_removed = int(removed[z] - removed[a])
                    n_spans = int(spans[z] - spans[a]) + int(z > a and gone[a] and not edge[a])  # a run that goes on from the document before
                    kept = b.text[a:z][~gone[a:z]] if n_removed else b.text[a:z]
                    out.append((int(b.ids[i]) if b.judged[i] else None, z - a, n_removed, n_spans, hashlib.sha256(kept.tobytes()).hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    final = dealt.join(marks.repartition(tasks, "block"), "block", "left").join(hits.repartition(tasks, "block"), "block", "left").select(*BLOCK, "marks", "hits")
    return final.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
