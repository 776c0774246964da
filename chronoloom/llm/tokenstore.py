"""Token ids in binary shards with a minimal perfect hash index from document keys to offsets.

Documents are dealt out by ranges of their key, encoded, and written in
ascending key order as shard files of raw little-endian ids.  Each shard holds
its own index: a minimal perfect hash (bit arrays by level: a key rests on the
first level where it meets no other key; its slot is its rank among the set
bits) over the distinct keys, and for each slot a fingerprint, the first record
and the number of records.  A lookup costs a constant expected number of
probes, whatever the shard's size; a missing key fails the fingerprint or, at
the latest, the comparison with the stored key.

Shards are written under another name and then renamed, and a repeated task
writes the same bytes, so lost executors leave no partial files.

Edge cases: a null text counts as empty (only the end id); rows that repeat a
key are separate records in order of their text, under one slot; rows with a
null key come first and can't be looked up; an empty table gives no shard.
"""

from __future__ import annotations

import functools
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.chunks import ByteLevelPieces, load
from chronoloom.llm.common import filesystem, groups_by_bytes, pick, shared_dir, written

MAGIC = b"idshard1"
HEADER = struct.Struct("<8sIIQQQI")  # magic, bytes an id, 0, records, keys, ids, levels


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of integer keys."""
    mask = (1 << 64) - 1
    x = keys.astype(np.int64).view(np.uint64) ^ np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & mask)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct integers: slots 0 .. n-1."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before = np.cumsum([0] + [int(b.sum()) for b in levels])
        self.ranks = [np.cumsum(b) - b for b in levels]

    @classmethod
    def build(cls, keys: np.ndarray, load: float = 0.5) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            size = max(8, int(len(left) / load))
            at = (mixed(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slots; a key that isn't there gets any slot or -1."""
        out = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            if not len(left):
                break
            at = (mixed(keys[left], k) % np.uint64(len(bits))).astype(np.int64)
            on = bits[at]
            out[left[on]] = self.before[k] + self.ranks[k][at[on]]
            left = left[~on]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 1000) >> np.uint64(32)).astype("<u4")


def shard_bytes(keys: list[int | None], ids: list[bytes], width: int) -> tuple[bytes, int]:
    """A shard file's content and its number of ids.  Records come in the given order; equal keys stand together."""
    counts = np.fromiter((len(x) // width for x in ids), dtype=np.int64, count=len(ids))
    null = np.array([k is None for k in keys], dtype=np.uint8)
    stored = np.array([0 if k is None else k for k in keys], dtype="<i8")
    distinct, first, many = np.unique(stored[null == 0], return_index=True, return_counts=True)
    first = np.nonzero(null == 0)[0][first] if len(distinct) else first
    perfect = PerfectHash.build(distinct)
    slot = perfect.slots(distinct)
    table = np.zeros(len(distinct), dtype=[("fingerprint", "<u4"), ("records", "<u4"), ("first", "<u8")])
    table["fingerprint"][slot], table["records"][slot], table["first"][slot] = fingerprints(distinct), many, first
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype("<u8")
    parts = [HEADER.pack(MAGIC, width, 0, len(keys), len(distinct), int(offsets[-1]), len(perfect.levels))]
    parts.append(np.array([len(b) for b in perfect.levels], dtype="<u8").tobytes())
    parts += [np.packbits(b, bitorder="little").tobytes() for b in perfect.levels]
    parts += [table.tobytes(), stored.tobytes(), null.tobytes(), offsets.tobytes(), *ids]
    return b"".join(parts), int(offsets[-1])


#: Bytes of ids read at once: neighbouring records are one request to the store.
STRETCH = 1 << 20


class Shard:
    """Reads one shard: the index at once, ids by offset."""

    def __init__(self, file):
        self.file = file
        magic, self.width, _, self.n_records, self.n_keys, self.n_ids, n_levels = HEADER.unpack(self._read(0, HEADER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at = HEADER.size
        sizes = np.frombuffer(self._read(at, 8 * n_levels), dtype="<u8").astype(np.int64)
        at += 8 * n_levels
        levels = []
        for n in sizes:
            wide = (int(n) + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(self._read(at, wide), dtype=np.uint8), count=int(n), bitorder="little").astype(bool))
            at += wide
        self.perfect = PerfectHash(levels)
        self.table = np.frombuffer(self._read(at, 16 * self.n_keys), dtype=[("fingerprint", "<u4"), ("records", "<u4"), ("first", "<u8")])
        at += 16 * self.n_keys
        self.keys = np.frombuffer(self._read(at, 8 * self.n_records), dtype="<i8")
        at += 8 * self.n_records
        self.null = np.frombuffer(self._read(at, self.n_records), dtype=np.uint8)
        at += self.n_records
        self.offsets = np.frombuffer(self._read(at, 8 * (self.n_records + 1)), dtype="<u8").astype(np.int64)
        self.payload = at + 8 * (self.n_records + 1)
        self.window, self.base = b"", 0  # what was read last of the ids, and where it begins

    def _read(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)

    def lookup(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First record (-1: absent) and number of records of each key."""
        keys = np.asarray(keys, dtype=np.int64)
        if not self.n_keys:
            return np.full(len(keys), -1), np.zeros(len(keys), dtype=np.int64)
        slot = self.perfect.slots(keys)
        row = self.table[np.maximum(slot, 0)]
        first = row["first"].astype(np.int64)
        good = (slot >= 0) & (row["fingerprint"] == fingerprints(keys)) & (self.keys[first] == keys)
        return np.where(good, first, -1), np.where(good, row["records"], 0)

    def ids(self, record: int, records: int = 1) -> np.ndarray:
        a, b = int(self.offsets[record]), int(self.offsets[record + records])
        at, end = self.payload + a * self.width, self.payload + b * self.width
        if not self.base <= at <= end <= self.base + len(self.window):
            self.window, self.base = self._read(at, max(end - at, STRETCH)), at
        return np.frombuffer(self.window[at - self.base : end - self.base], dtype=f"<u{self.width}")


class Encoder:
    """Ids of whole texts as packed bytes, with the end id."""

    def __init__(self, tokenizer_path: str, end_id: int):
        if sys.byteorder != "little":
            raise RuntimeError("ids are packed in native order, which must be little-endian")
        tokenizer = load(tokenizer_path)
        self.width = 2 if max(tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else 4
        kind = "H" if self.width == 2 else "I"
        self.pieces = ByteLevelPieces(tokenizer, lambda ids: array(kind, ids).tobytes())
        self.end = array(kind, [end_id]).tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        return [self.pieces(t) + self.end for t in texts]


@functools.lru_cache(maxsize=1)
def encoder(tokenizer_path: str, end_id: int) -> Encoder:
    """One encoder a Python worker: later tasks find the pieces of earlier ones."""
    return Encoder(tokenizer_path, end_id)


MANIFEST = "path string, part int, seq int, min_key long, max_key long, n_records long, n_ids long"


def write_shards(df: DataFrame, uri: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_bytes_limit: int = 16 << 20) -> DataFrame:
    """Writes the shards below ``uri``; returns the manifest, one row a shard, with ``start_id`` (ids of all shards before it)."""
    docs = pick(df, key=id_col, text=text_col).select(F.col("key").cast("long").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("tie", F.xxhash64("text"))
    docs = docs.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie", "text")

    def write(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs, base = filesystem(uri)
        fs.create_dir(base)
        encode = encoder(tokenizer_path, end_id)
        keys: list[int | None] = []
        ids: list[bytes] = []
        held, seq = 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal keys, ids, held, seq
            content, n_ids = shard_bytes(keys, ids, encode.width)
            path = f"{base}/part-{part:06d}-{seq:05d}.ids"
            with fs.open_output_stream(hidden := f"{base}/.{uuid.uuid4().hex}") as f:
                f.write(content)
            fs.move(hidden, path)
            there = [k for k in keys if k is not None]
            row = {"path": [f"{uri}/{path.rsplit('/', 1)[1]}"], "part": [part], "seq": [seq], "min_key": [there[0] if there else None], "max_key": [there[-1] if there else None], "n_records": [len(keys)], "n_ids": [n_ids]}
            keys, ids, held, seq = [], [], 0, seq + 1
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("path", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("min_key", pa.int64()), ("max_key", pa.int64()), ("n_records", pa.int64()), ("n_ids", pa.int64())]))

        for batch in batches:
            texts = batch.column(1)
            sizes = pc.binary_length(texts).to_pylist()
            for a, b in groups_by_bytes(sizes, 1 << 20):
                if keys and held + sum(sizes[a:b]) > shard_bytes_limit:
                    yield flush()
                keys += batch.column(0).slice(a, b - a).to_pylist()
                got = encode(texts.slice(a, b - a).to_pylist())
                ids += got
                held += sum(map(len, got))
        if keys:
            yield flush()

    manifest = written(docs.select("key", "text").mapInArrow(write, MANIFEST), "manifest")
    # one row a shard: ids before it within its part, then before the part
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    parts = parts.select("part", (F.sum("part_ids").over(Window.orderBy("part")) - F.col("part_ids")).alias("part_start"))
    inner = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    return manifest.withColumn("inner", inner).join(parts, "part").withColumn("start_id", F.col("part_start") + F.col("inner")).drop("inner", "part_start")


#: Most tasks that read shards back.
READERS = 100_000


def read_records(manifest: DataFrame) -> DataFrame:
    """One row a record, read from the shards by keyed lookup: doc_id, start, n_tokens, ids_crc32 (of unsigned 32-bit little-endian ids)."""

    def read(batches):
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, path = filesystem(uri)
                with fs.open_input_file(path) as file:
                    shard = Shard(file)
                    keys = np.unique(shard.keys[shard.null == 0])
                    first, many = shard.lookup(keys)
                    if (first < 0).any():
                        raise ValueError(f"{uri}: the index lost keys")
                    order = [(None, r) for r in np.nonzero(shard.null)[0]] + [(int(k), r) for k, f, n in zip(keys, first, many, strict=True) for r in range(f, f + n)]
                    for a in range(0, len(order), 4096):
                        part = order[a : a + 4096]
                        crc = [zlib.crc32(shard.ids(r).astype("<u4").tobytes()) for _, r in part]
                        at = [r for _, r in part]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([k for k, _ in part], pa.int64()), pa.array(start + shard.offsets[at], pa.int64()), pa.array(shard.offsets[np.add(at, 1)] - shard.offsets[at], pa.int64()), pa.array(crc, pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    # a manifest is small, so a plain exchange would be coalesced into one task: deal the shards out by number
    files = manifest.select("path", "start_id").repartition(min(max(manifest.count(), 1), READERS))
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch(manifest: DataFrame, keys: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """Ids of the given keys (columns key, ids array<int>), each found through its shard's index; absent keys give no row."""
    wanted = pick(keys, key=key_col).select(F.col("key").cast("long").alias("key")).filter("key is not null").distinct()
    there = manifest.filter("min_key is not null")
    # one row a range partition: as many as the writing job had partitions, whatever the number of documents
    parts = sorted(there.groupBy("part").agg(F.min("min_key").alias("least"), F.max("max_key").alias("most")).collect(), key=lambda r: r["part"])
    number, least, most = (np.array([r[i] for r in parts], dtype=np.int64) for i in range(3))

    def dealt(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy()
            first, end = np.searchsorted(most, key, side="left"), np.searchsorted(least, key, side="right")
            n = np.maximum(end - first, 0)
            at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(key, n)), pa.array(number[at].astype(np.int32))], names=["key", "part"])

    mine = wanted.mapInArrow(dealt, "key long, part int").join(there.select("part", "path", "min_key", "max_key"), "part")
    pairs = mine.filter(F.col("key").between(F.col("min_key"), F.col("max_key"))).select("path", "key").repartition("path").sortWithinPartitions("path")

    def read(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, keys_ = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), dtype=np.int64)
            for uri in dict.fromkeys(paths):
                mine = keys_[[p == uri for p in paths]]
                fs, path = filesystem(uri)
                with fs.open_input_file(path) as file:
                    shard = Shard(file)
                    first, many = shard.lookup(mine)
                    for k, f, n in zip(mine, first, many, strict=True):
                        if f >= 0:
                            found = [shard.ids(r).tolist() for r in range(f, f + n)]
                            yield pa.RecordBatch.from_arrays([pa.array([k] * len(found), pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["key", "ids"])

    return pairs.mapInArrow(read, "key long, ids array<bigint>")


def encode_and_read(df: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    uri = shared_dir(df.sparkSession, "shards")
    return read_records(write_shards(df, uri, tokenizer_path, end_id, id_col, text_col))
