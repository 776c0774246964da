"""N-gram Jaccard join by chosen paths.

Documents are sets of five-word shingles.  In each run every set chooses the
tokens whose hash falls below 1 / (threshold x size); two sets as similar as
the threshold choose at least one common token on average.  Sets that chose a
common token share a bucket; a bucket above ``small`` is split again by tokens
chosen with the next level's hash.  Small buckets are compared by brute force
on bottom-k sketches; what is still large at the last level is compared in
pairs of blocks, none left out.  Runs are repeated until a pair at the
threshold has been put together with the target probability.

The sketch comparison only proposes, at a bound far below the threshold: of a
set inside the other at 0.8 about Binomial(64, 0.8) elements of the sketches are
common, and fewer than half of them with a probability below 1e-6 (sketches are
the same in all runs, so a pair that fails here is lost).  Sets that it links
form candidate groups,
within which every pair of sets is compared exactly (again in pairs of blocks).
Equal sets are one row with a count from the start, so copies never meet.
Pairs never leave a task: a task returns, for each set, how many documents it
is linked to and one edge towards its component.

Edge cases: null and empty texts, or those without words, are linked to
nothing and are classes of their own; texts of fewer than five words have one
shingle, all their words; rows with a null id take no part and are returned
with a null class; repeated rows are copies of each other; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.llm.common import groups_by_bytes, pick, position, with_text_columns, written
from chronoloom.llm.decontaminate import WORD_BYTES
from chronoloom.operators.graph import connected_components

SKETCH = 64
SLICE = 1 << 20
#: A set with more than this share of all documents is hot; there are at most 1 / HOT such sets.
HOT = 1 / 500


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[str], words: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; words are lower-cased runs of letters, digits and non-ASCII characters."""
    raws = [t.lower().encode("utf-8", errors="replace").translate(WORD_BYTES) for t in texts]
    code = np.frombuffer(b" " + b" ".join(raws) + b" ", dtype=np.uint8)
    inside = code != 32
    edge = np.diff(inside.astype(np.int8))
    starts, ends = np.nonzero(edge == 1)[0] + 1, np.nonzero(edge == -1)[0] + 1
    at = np.searchsorted(starts, np.cumsum([1] + [len(r) + 1 for r in raws]))
    if not len(starts):
        return [np.zeros(0, dtype=np.uint64) for _ in texts]
    lengths = ends - starts
    power = np.multiply.accumulate(np.full(int(lengths.max()), 0x9DDFEA08EB382D69, dtype=np.uint64))
    total = np.cumsum(lengths)
    hashed = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):  # words of about SLICE bytes at a time, so that a long text takes little more than itself
        j = max(i + 1, int(np.searchsorted(total, total[i] + SLICE)))
        size = lengths[i:j]
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        place = np.arange(int(size.sum())) - np.repeat(first, size)
        chars = place + np.repeat(starts[i:j], size)
        hashed[i:j] = np.add.reduceat((code[chars].astype(np.uint64) + np.uint64(1)) * power[place], first)
        i = j
    hashed = mix(hashed)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        w = hashed[a:b]
        if len(w) == 0:
            out.append(np.zeros(0, dtype=np.uint64))
            continue
        n = min(words, len(w))
        total = np.zeros(len(w) - n + 1, dtype=np.uint64)
        for i in range(n):
            total = total * np.uint64(0x9FB21C651E98DF25) + w[i : len(w) - n + 1 + i]
        out.append(np.unique(mix(total, n)))
    return out


def set_ids(sets: list[np.ndarray]) -> list[bytes | None]:
    """16 bytes that equal sets share; None for an empty set."""
    return [None if not len(s) else np.array([mix(s, 101).sum(), mix(s, 202).sum() + np.uint64(len(s))], dtype=np.uint64).tobytes() for s in sets]


def runs_needed(target: float, threshold: float, levels: int = 2) -> int:
    """Runs after which a pair at the threshold has shared a bucket of the last level with probability ``target``.

    Counted for a set inside the other, the worst case: its threshold x n tokens
    are common and the larger set chooses each with 1 / (threshold n), so 1 on
    average; equal-sized sets share 2 / (1 + threshold).
    """
    shared = 1.0
    once = (1 - math.exp(-shared)) ** levels
    return math.ceil(math.log(1 - target) / math.log(1 - once))


PATHS = T.ArrayType(T.StructType([T.StructField("r", T.IntegerType()), T.StructField("k", T.LongType())]))
FEATURES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("sid", T.BinaryType()), T.StructField("n", T.IntegerType()), T.StructField("sketch", T.BinaryType()), T.StructField("p1", PATHS), T.StructField("p2", PATHS)])


def features(docs: DataFrame, threshold: float, runs: int) -> DataFrame:
    """doc_id, sid, n (shingles), sketch (least shingle hashes) and the chosen tokens of both levels by run."""
    arrow_paths = pa.list_(pa.struct([("r", pa.int32()), ("k", pa.int64())]))

    def paths(flat: np.ndarray, owner: np.ndarray, limit: np.ndarray, n: int, level: int) -> pa.Array:
        who, run, token = [], [], []
        for r in range(runs):
            chosen = np.nonzero(mix(flat, 1000 * level + r) < limit)[0]
            who.append(owner[chosen])
            run.append(np.full(len(chosen), r, dtype=np.int32))
            token.append(flat[chosen])
        who, run, token = np.concatenate(who), np.concatenate(run), np.concatenate(token)
        order = np.argsort(who, kind="stable")
        offsets = np.searchsorted(who[order], np.arange(n + 1))
        inner = pa.StructArray.from_arrays([pa.array(run[order]), pa.array(token[order].view(np.int64))], names=["r", "k"])
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), inner).cast(arrow_paths)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column(1)).fill_null(0).to_pylist()
            for a, b in groups_by_bytes(sizes, 4 << 20):
                sets = shingle_sets([t or "" for t in batch.column(1).slice(a, b - a).to_pylist()])
                flat = np.concatenate(sets)
                size = np.array([len(s) for s in sets])
                owner = np.repeat(np.arange(len(sets)), size)
                limit = np.repeat(np.array([min((1 << 64) - 1, int(2.0**64 / (threshold * max(n, 1)))) for n in size], dtype=np.uint64), size)
                sketch = [(s[:SKETCH] >> np.uint64(32)).astype("<u4").tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(set_ids(sets), pa.binary()), pa.array(size.astype(np.int32)), pa.array(sketch, pa.binary()), paths(flat, owner, limit, len(sets), 1), paths(flat, owner, limit, len(sets), 2)],
                    names=FEATURES.names,
                )

    import pyarrow.compute  # noqa: F401

    return pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FEATURES)


def common_counts(tokens: list[np.ndarray]) -> np.ndarray:
    """Numbers of common elements of each pair of sets of distinct elements."""
    m = len(tokens)
    if m == 2:
        c = len(np.intersect1d(tokens[0], tokens[1], assume_unique=True))
        return np.array([[len(tokens[0]), c], [c, len(tokens[1])]], dtype=np.float32)
    row = np.repeat(np.arange(m), [len(t) for t in tokens])
    _, column, count = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    shared, everywhere = (count >= 2) & (count < m), int((count == m).sum())
    new = np.cumsum(shared) - 1
    use = shared[column]
    row, column = row[use], new[column[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.full((m, m), everywhere, dtype=np.float32)
    for a in range(0, int(shared.sum()), 2048):
        i, j = np.searchsorted(column, [a, a + 2048])
        block = np.zeros((m, 2048), dtype=np.float32)
        block[row[i:j], column[i:j] - a] = 1
        total += block @ block.T
    return total


def roots(linked: np.ndarray) -> np.ndarray:
    """Least index of each row's component under a symmetric matrix of links."""
    m = len(linked)
    label = np.full(m, -1)
    for i in range(m):
        if label[i] >= 0:
            continue
        label[i] = i
        todo = [i]
        while todo:
            near = np.nonzero(linked[todo].any(axis=0) & (label < 0))[0]
            label[near] = i
            todo = near.tolist()
    return label


def in_groups(key_columns: int):
    """Rows of consecutive equal keys, gathered from sorted Arrow batches; groups are bounded by the callers."""

    def gather(batches) -> Iterator[list[tuple]]:
        held, key = [], None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:key_columns] != key:
                    if held:
                        yield held
                    held, key = [], row[:key_columns]
                held.append(row)
        if held:
            yield held

    return gather


def in_blocks(rows: DataFrame, sizes: DataFrame, key: list[str], limit: int) -> DataFrame:
    """``rows`` with block numbers i <= j, so that any two rows of a key meet in some pair of blocks of at most ``limit`` rows each."""
    joined = rows.join(sizes, key).withColumn("blocks", F.ceil(F.col("size") / limit).cast("int"))
    mine = joined.withColumn("own", F.pmod(F.xxhash64("sid", F.lit(5)), F.col("blocks")).cast("int"))
    other = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other", "blocks", "size")


def candidate_edges(sets: DataFrame, small: int, propose: float) -> DataFrame:
    """(a, b) set ids: one edge from each set of a bucket towards its sketch component there."""
    first = sets.select("sid", F.explode("p1").alias("p")).select("sid", F.col("p.r").alias("r"), F.col("p.k").alias("k"))
    count1 = first.groupBy("r", "k").agg(F.count("*").alias("size")).filter("size > 1")
    level1 = written(first.join(count1, ["r", "k"]), "paths")
    large = level1.filter(F.col("size") > small).select("sid", "r", "k")
    second = large.join(sets.select("sid", "p2"), "sid").select("sid", "r", "k", F.explode(F.filter("p2", lambda p: p["r"] == F.col("r"))).alias("p")).select("sid", F.col("r"), F.xxhash64("k", "p.k").alias("k"))
    second = second.distinct()
    count2 = second.groupBy("r", "k").agg(F.count("*").alias("size")).filter("size > 1")
    buckets = level1.filter(F.col("size") <= small).select("sid", "r", "k", F.lit(0).alias("i"), F.lit(0).alias("j"))
    buckets = buckets.unionByName(in_blocks(second, count2, ["r", "k"], small).select("sid", "r", "k", "i", "j"))
    sketched = buckets.join(sets.select("sid", "sketch"), "sid").select("r", "k", "i", "j", "sid", "sketch")
    key = ["r", "k", "i", "j"]

    def compare(batches):
        for group in in_groups(4)(batches):
            sids = [g[4] for g in group]
            tokens = [np.unique(np.frombuffer(g[5], dtype="<u4")) for g in group]
            if len(sids) < 2:
                continue
            length = np.array([len(t) for t in tokens])
            linked = common_counts(tokens) >= propose * np.maximum(length[:, None], length[None, :])
            root = roots(linked)
            far = np.nonzero(root != np.arange(len(root)))[0]
            if len(far):
                yield pa.RecordBatch.from_arrays([pa.array([sids[i] for i in far], pa.binary()), pa.array([sids[root[i]] for i in far], pa.binary())], names=["a", "b"])

    return sketched.repartition(*key).sortWithinPartitions(*key).mapInArrow(compare, "a binary, b binary").distinct()


def classes(docs: DataFrame, threshold: float = 0.8, target: float = 0.999, small: int = 1000, block: int = 512, propose: float = 0.5) -> DataFrame:
    """One row a document: doc_id, sid, class_id (least doc_id of its class), n_links (documents linked to it), and
    ``chosen`` (whether its set is the class's representative)."""
    runs = runs_needed(target, threshold)
    all_docs = written(features(docs, threshold, runs), "features")
    known = all_docs.filter("sid is not null and doc_id is not null")
    groups = written(known.groupBy("sid").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "groups")
    sets = written(known.select("sid", "n", "sketch", "p1", "p2").dropDuplicates(["sid"]), "sets")
    edges = written(candidate_edges(sets, small, propose), "proposed")
    near = connected_components(edges, written)
    sizes = near.groupBy("component").agg(F.count("*").alias("size"))
    members = near.select(F.col("node").alias("sid"), "component").join(groups, "sid")
    linked = exact_links(pick(docs, doc_id="doc_id", text="text"), members, sizes, threshold, block)
    counted = linked.groupBy("sid").agg(F.sum("links").alias("links"))
    joined = connected_components(linked.filter("sid <> root").select(F.col("sid").alias("a"), F.col("root").alias("b")), written)
    # a class's representative: the least (rep, sid) among its sets
    with_rep = joined.join(groups, joined["node"] == groups["sid"]).select("sid", "component", "rep")
    best = with_rep.groupBy("component").agg(F.min(F.struct("rep", "sid")).alias("best"))
    of_set = with_rep.join(best, "component").select("sid", F.col("best.rep").alias("class_rep"), F.col("best.sid").alias("class_sid"))
    per_set = groups.join(of_set, "sid", "left").join(counted, "sid", "left")
    per_set = per_set.select("sid", F.coalesce("class_rep", "rep").alias("class_rep"), F.coalesce("class_sid", "sid").alias("class_sid"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("set_links"))
    # documents of hot sets meet their few rows in a broadcast, so no task gets all copies of one text
    per_set = written(per_set, "per_set")
    many = groups.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    hot = F.broadcast(per_set.join(groups.filter(F.col("copies") > many * HOT).select("sid"), "sid", "left_semi"))
    ids = all_docs.select("doc_id", "sid")
    columns = ["doc_id", "sid", "class_rep", "class_sid", "set_links"]
    out = ids.join(hot, "sid").select(columns).unionByName(ids.join(hot.select("sid"), "sid", "left_anti").join(per_set, "sid", "left").select(columns))
    lone = F.col("sid").isNull() | F.col("doc_id").isNull()
    return out.select(
        "doc_id",
        "sid",
        F.when(lone, F.col("doc_id")).otherwise(F.col("class_rep")).alias("class_id"),
        F.when(lone, F.lit(0).cast("long")).otherwise(F.col("set_links")).alias("n_links"),
        F.when(lone, F.lit(True)).otherwise((F.col("class_rep") == F.col("doc_id")) & (F.col("class_sid") == F.col("sid"))).alias("chosen"),
    )


def exact_links(docs: DataFrame, members: DataFrame, sizes: DataFrame, threshold: float, block: int) -> DataFrame:
    """(sid, links, root): exact comparison of all pairs of sets within a candidate group, partial by pair of blocks."""
    wanted = members.select("sid", "component", "copies", F.col("rep").alias("doc_id"))

    def sets_of(batches):
        for batch in batches:
            sizes_ = pa.compute.binary_length(batch.column(3)).fill_null(0).to_pylist()
            for a, b in groups_by_bytes(sizes_, 4 << 20):
                part = batch.slice(a, b - a)
                sets = shingle_sets([t or "" for t in part.column(3).to_pylist()])
                same = np.array([x == y for x, y in zip(set_ids(sets), part.column(0).to_pylist(), strict=True)], dtype=bool)
                packed = pa.array([s.tobytes() for s in sets], pa.binary())
                kept = pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), packed], names=["sid", "component", "copies", "tokens"])
                yield kept.filter(pa.array(same))

    import pyarrow.compute  # noqa: F401

    texts = docs.select(F.col("doc_id").cast("long"), "text").join(wanted, "doc_id").select("sid", "component", "copies", "text")
    tokens = texts.mapInArrow(sets_of, "sid binary, component binary, copies long, tokens binary")
    dealt = in_blocks(tokens, sizes, ["component"], block).select("component", "i", "j", "own", "sid", "copies", "tokens")
    key = ["component", "i", "j"]

    def compare(batches):
        for group in in_groups(3)(batches):
            seen = {g[4]: g for g in group}  # repeated rows of one document
            rows = list(seen.values())
            if len(rows) < 2:
                continue
            sets = [np.frombuffer(g[6], dtype=np.uint64) for g in rows]
            own, copies = np.array([g[3] for g in rows]), np.array([g[5] for g in rows], dtype=np.int64)
            length = np.array([len(s) for s in sets], dtype=np.float64)
            common = common_counts(sets).astype(np.float64)
            linked = common >= threshold * (length[:, None] + length[None, :] - common) - 1e-9
            np.fill_diagonal(linked, False)
            if rows[0][1] != rows[0][2]:  # pairs within one block are counted where that block meets itself
                linked &= own[:, None] != own[None, :]
            links = linked @ copies
            root = roots(linked)
            use = np.nonzero(links > 0)[0]
            if len(use):
                sids = [g[4] for g in rows]
                yield pa.RecordBatch.from_arrays([pa.array([sids[i] for i in use], pa.binary()), pa.array(links[use], pa.int64()), pa.array([sids[root[i]] for i in use], pa.binary())], names=["sid", "links", "root"])

    return written(dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(compare, "sid binary, links long, root binary"), "links")


def with_set_ids(df: DataFrame, text_col: str = "text", into: str = "sid") -> DataFrame:
    return with_text_columns(df, lambda: lambda texts: [set_ids(shingle_sets(texts))], [(into, T.BinaryType(), pa.binary())], text_col)


def one_of_each(docs: DataFrame, threshold: float = 0.8, target: float = 0.999) -> DataFrame:
    """``docs`` without all but one document of each class; documents without words or id stay."""
    found = classes(docs, threshold, target).filter(F.col("chosen") & F.col("sid").isNotNull() & F.col("doc_id").isNotNull())
    chosen = found.select(F.col("doc_id").alias("doc"), F.col("sid").alias("set"), F.lit(True).alias("stays")).distinct()
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    doc, text = (names[position(docs.columns, c)] for c in ("doc_id", "text"))
    marked = with_set_ids(plain, text, "sid").withColumn("doc", F.col(doc).cast("long"))
    joined = marked.join(chosen, (marked["doc"] == chosen["doc"]) & (marked["sid"] == chosen["set"]), "left").select(*names, marked["doc"], "sid", "stays")
    lone = F.col("sid").isNull() | F.col("doc").isNull()
    words = joined.filter(~lone & F.col("stays")).dropDuplicates(["doc", "sid"])
    return words.unionByName(joined.filter(lone)).select(*names).toDF(*docs.columns)
