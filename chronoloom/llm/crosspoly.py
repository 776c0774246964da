"""Approximate nearest neighbours by cross-polytope hashing.

A hash turns unit vectors by a fast pseudo-rotation (three rounds of random
signs and a Hadamard transform) and takes the nearest signed axis.  A table's
buckets are named by the axes of several rotations, one more each time the
number of vectors grows by as many times as there are axes, so that buckets
stay small.  A query probes, in each rotation of a table, its nearest signed
axes, and all their combinations; candidates are ranked exactly, by inner
products in double precision.

How many axes are probed is the least number that reaches ``recall`` on a
sample of at most ``SAMPLE`` vectors, whose nearest are looked up as deep as
the sample's share of all vectors says, so that they are about as far as the
``k`` nearest among all.  Every vector is indexed.

Vectors are hashed as directions, whatever their norms, so no vector changes
how others are hashed.  They form two norm ranges with buckets of their own: a
vector longer than 1.05 times the median needs a smaller cosine to be among the
nearest, so in that range so many axes are probed that even a vector without
any correlation is met in some table with a probability of about 0.95.
Queries that found fewer than ``k`` are searched through every bucket of one
table, which is exact.

Work is dealt out by table, norm range and first axis, in blocks of at most
``block`` vectors and ``block`` queries, from counts (there are tables x 4 x
dimension of them); a block takes the other rotations into account by masks.
So a bucket that holds a third of all vectors is split, not capped: every pair
of a probed bucket is ranked.  A block gives each query its ``k`` best, ties to
the smaller id.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite
components take no part, nor do those of another dimension than most, with
which no inner product exists; equal vectors are ranked by id; rows with null
ids take no part; repeated ids count as one candidate (with the better score),
and query rows that repeat an id with other components are queries of their
own; inner products beyond the range of doubles are infinite, undefined ones
rank last; where there are fewer candidates than ``k``, all are returned; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.llm.common import pick, position, written


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows; their number of columns is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotated(x: np.ndarray, table: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng([seed, table])
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], x.shape[1]))
    return x


def padded(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """Rows (id, vector array<double>, log_norm) that take part, and their dimension: the most frequent one."""
    v = pick(vectors, id=id_col, vector=vector_col).select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.filter(F.col("id").isNotNull() & F.col("vector").isNotNull() & fine)
    v = v.withColumn("peak", F.array_max(F.transform("vector", F.abs))).filter("peak > 0")
    # of the components as shares of the largest, so that no square over- or underflows
    share = F.aggregate("vector", F.lit(0.0), lambda s, x: s + (x / F.col("peak")) * (x / F.col("peak")))
    v = v.withColumn("log_norm", F.log("peak") + 0.5 * F.log(share)).drop("peak")
    most = v.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = most["d"] if most else 0
    return v.filter(F.size("vector") == dim), dim


HASHED = "t int, axis int, far boolean, id long, row long, vector binary, code binary"
RESULT = "query_id long, row long, rank int, vec_id long, score double"
FAR = 1.05  # times the median norm: where the range of long vectors begins
SAMPLE = 4096
SAMPLE_QUERIES = 256


def rotations(n: int, every: int) -> int:
    """How many rotations name a bucket: one for a few hundred vectors, one more whenever a thousand have grown ``every`` times."""
    return 1 if n < 1000 else 2 + int(np.log(n / 1000) / np.log(every))


def signed(y: np.ndarray) -> np.ndarray:
    """Inner products with +axis i at 2 i and -axis i at 2 i + 1."""
    both = np.empty((len(y), 2 * y.shape[1]))
    both[:, 0::2], both[:, 1::2] = y, -y
    return both


def probes_for(x: np.ndarray, n: int, k: int, tables: int, m: int, seed: int, recall: float) -> int:
    """The least number of axes to probe in each rotation that finds a share of ``recall`` of the neighbours in the sample ``x``."""
    width = 1 << (x.shape[1] - 1).bit_length()
    every = 2 * width
    asked = x[:SAMPLE_QUERIES]
    with np.errstate(over="ignore", invalid="ignore"):
        s = asked @ x.T
    s[np.isnan(s)] = -np.inf
    s[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    deep = min(max(1, -(-k * len(x) // n)), len(x) - 1)
    if deep < 1:
        return every
    near = np.argpartition(-s, deep - 1, axis=1)[:, :deep]
    unit = x / np.abs(x).max(axis=1)[:, None]
    unit = padded(unit / np.sqrt((unit * unit).sum(axis=1))[:, None], width)
    needed = np.full(near.shape, every)  # axes that must be probed to meet the pair in some table
    for t in range(tables):
        worst = np.zeros(near.shape, dtype=np.int64)
        for r in range(m):
            both = signed(rotated(unit, t * m + r, seed))
            axis = both.argmax(axis=1)[near]
            mine = np.take_along_axis(both[: len(asked)], axis, axis=1)
            worst = np.maximum(worst, (both[: len(asked), None, :] > mine[:, :, None]).sum(axis=2) + 1)
        needed = np.minimum(needed, worst)
    return int(np.quantile(needed, recall, method="higher"))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, tables: int = 24, recall: float = 0.95, probes: int | None = None, block: int = 4096, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row of ``queries`` among ``vectors`` but itself.

    ``probes``, if given, is the number of axes probed in each rotation, whatever the sample says.
    """
    spark = vectors.sparkSession
    base, dim = usable(vectors, id_col, vector_col)
    if not dim:
        return spark.createDataFrame([], RESULT).drop("row")
    asked, _ = usable(queries, id_col, vector_col)
    asked = asked.filter(F.size("vector") == dim)
    norms = base.agg(F.max("log_norm").alias("most"), F.percentile_approx("log_norm", 0.5).alias("median"), F.count("*").alias("n")).first()
    limit = float(norms["median"]) + float(np.log(FAR))
    given = vectors.schema[position(vectors.columns, vector_col)].dataType
    kind = "<f4" if given == T.ArrayType(T.FloatType(), given.containsNull) else "<f8"  # exact either way
    width = 1 << (dim - 1).bit_length()
    every, tables = 2 * width, int(tables)
    m = rotations(norms["n"], every)
    if probes is None:
        sample = base.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toPandas()["vector"]
        probes = probes_for(np.array(sample.tolist(), dtype=np.float64), norms["n"], k, tables, m, seed, recall)
    probes = min(max(int(probes), 1), every)
    probed_axes = {False: probes}
    if float(norms["most"]) > limit:
        probed_axes[True] = min(every, max(probes, int(np.ceil(every * (1 - 0.05 ** (1 / tables)) ** (1 / m)))))

    def axes(y: np.ndarray, n: int) -> np.ndarray:
        """The n nearest signed axes of each row."""
        both = signed(y)
        if n == 1:
            return both.argmax(axis=1)[:, None]
        return np.argpartition(-both, n - 1, axis=1)[:, :n] if n < both.shape[1] else np.tile(np.arange(both.shape[1]), (len(y), 1))

    def hashing(among: int, counts: dict[bool, int] | None = None):
        """Rows by table and axis: of vectors in their own norm range, or of queries in each range's ``counts`` axes."""

        def run(batches):
            for batch in batches:
                for a in range(0, batch.num_rows, 2048):
                    rows = batch.slice(a, 2048)
                    x = matrix(rows.column(1), dim)
                    x1 = x / np.abs(x).max(axis=1)[:, None]
                    x1 = padded(x1 / np.sqrt((x1 * x1).sum(axis=1))[:, None], width)
                    packed = np.array([r.tobytes() for r in x.astype(kind)], dtype=object)
                    number = np.array([zlib.crc32(r) for r in packed], dtype=np.int64)
                    ids, long = rows.column(0).to_numpy(), rows.column(2).to_numpy() > limit
                    for t in range(among):
                        turned = [rotated(x1, t * m + r, seed) for r in range(m)]
                        for far, n in (counts or {False: 1}).items():
                            first, *others = [axes(y, n) for y in turned]
                            size = first.shape[1]
                            codes = np.array([c.tobytes() for c in np.stack(others, axis=1).astype("<u2")] if others else [b""] * len(ids), dtype=object)
                            in_range = np.full(len(ids) * size, far) if counts else long
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids) * size, t, dtype=np.int32)), pa.array(first.ravel().astype(np.int32)), pa.array(in_range), pa.array(np.repeat(ids, size)), pa.array(np.repeat(number, size)), pa.array(np.repeat(packed, size), pa.binary()), pa.array(np.repeat(codes, size), pa.binary())], names=["t", "axis", "far", "id", "row", "vector", "code"])

        return run

    index = written(base.select("id", "vector", "log_norm").mapInArrow(hashing(tables), HASHED), "index")
    probed = written(asked.select("id", "vector", "log_norm").mapInArrow(hashing(tables, probed_axes), HASHED), "probes")
    key = ["t", "axis", "far", "v", "q"]

    def rank(_, vs: pa.Table, qs: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "row": pa.array([], pa.int64()), "ids": pa.array([], pa.binary()), "scores": pa.array([], pa.binary())})
        if not vs.num_rows or not qs.num_rows:
            return empty
        ids = vs.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        code = np.frombuffer(b"".join(vs.column("code").to_pylist()), dtype="<u2").reshape(len(ids), m - 1)[order]
        probed = np.frombuffer(b"".join(qs.column("code").to_pylist()), dtype="<u2").reshape(qs.num_rows, m - 1, -1) if m > 1 else None
        x = np.frombuffer(b"".join(vs.column("vector").to_pylist()), dtype=kind).astype(np.float64).reshape(-1, dim)[order]
        q_ids = qs.column("id").to_numpy()
        q = np.frombuffer(b"".join(qs.column("vector").to_pylist()), dtype=kind).astype(np.float64).reshape(-1, dim)
        out_ids, out_scores = [], []
        for a in range(0, len(q), 512):
            with np.errstate(over="ignore", invalid="ignore"):
                s = q[a : a + 512] @ x.T
            s[np.isnan(s)] = -np.inf
            out = q_ids[a : a + 512, None] == ids[None, :]
            for r in range(m - 1):
                meets = np.zeros((len(s), every), dtype=bool)
                np.put_along_axis(meets, probed[a : a + 512, r].astype(np.int64), True, axis=1)
                out |= ~meets[:, code[:, r]]
            s[out] = -np.inf
            n = min(k, len(ids))
            least = np.partition(s, len(ids) - n, axis=1)[:, len(ids) - n]
            slack = np.where(np.isfinite(least), 1e-9 * (1 + np.abs(least)), 0)
            i, j = np.nonzero((s >= (least - slack)[:, None]) & ~out)
            with np.errstate(over="ignore", invalid="ignore"):
                exact = (x[j] * q[a + i]).sum(axis=1)
            best = np.lexsort((ids[j], np.where(np.isnan(exact), np.inf, -exact), i))
            best = best[np.arange(len(i)) - np.searchsorted(i, i) < k]
            ends = np.searchsorted(i[best], np.arange(len(s) + 1)).tolist()
            near, score = ids[j[best]].astype("<i8"), exact[best].astype("<f8")
            out_ids += [near[b:c].tobytes() for b, c in zip(ends[:-1], ends[1:], strict=True)]
            out_scores += [score[b:c].tobytes() for b, c in zip(ends[:-1], ends[1:], strict=True)]
        some = np.array([len(o) > 0 for o in out_ids], dtype=bool)  # a block has nothing for many of its queries
        return pa.table({"query_id": pa.array(q_ids[some], pa.int64()), "row": qs.column("row").filter(pa.array(some)), "ids": pa.array([o for o in out_ids if o], pa.binary()), "scores": pa.array([o for o in out_scores if o], pa.binary())})

    def best_of(batches):
        query, ids, scores = None, [], []

        def done():
            i, s = np.frombuffer(b"".join(ids), dtype="<i8"), np.frombuffer(b"".join(scores), dtype="<f8")
            order = np.lexsort((i, np.where(np.isnan(s), np.inf, -s)))
            _, first = np.unique(i[order], return_index=True)
            top = order[np.sort(first)][:k]
            n = len(top)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, query[0]), pa.int64()), pa.array(np.full(n, query[1]), pa.int64()), pa.array(np.arange(1, n + 1, dtype=np.int32)), pa.array(i[top], pa.int64()), pa.array(s[top], pa.float64())], names=["query_id", "row", "rank", "vec_id", "score"])

        for batch in batches:
            for qid, row, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (qid, row) != query:
                    if query is not None:
                        yield done()
                    query, ids, scores = (qid, row), [], []
                ids.append(a)
                scores.append(b)
                if len(ids) >= 256:  # keeps what one query holds small
                    kept = done()
                    ids, scores = [kept.column(3).to_numpy().astype("<i8").tobytes()], [kept.column(4).to_numpy().astype("<f8").tobytes()]
        if query is not None:
            yield done()

    def matched(index: DataFrame, probed: DataFrame) -> DataFrame:
        # counts of tables x axes x ranges buckets: bounded by the parameters
        bucket = ["t", "axis", "far"]
        blocks = index.groupBy(*bucket).agg(F.ceil(F.count("*") / block).cast("int").alias("vs")).join(probed.groupBy(*bucket).agg(F.ceil(F.count("*") / block).cast("int").alias("qs")), bucket)
        blocks = F.broadcast(blocks)
        left = index.join(blocks, bucket).withColumn("v", F.pmod(F.xxhash64("id"), F.col("vs")).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)))
        right = probed.join(blocks, bucket).withColumn("q", F.pmod(F.xxhash64("id"), F.col("qs")).cast("int")).withColumn("v", F.explode(F.sequence(F.lit(0), F.col("vs") - 1)))
        found = left.select(*key, "id", "vector", "code").groupBy(*key).cogroup(right.select(*key, "id", "row", "vector", "code").groupBy(*key)).applyInArrow(rank, "query_id long, row long, ids binary, scores binary")
        return found.repartition("query_id", "row").sortWithinPartitions("query_id", "row").mapInArrow(best_of, RESULT)

    if all(n >= every for n in probed_axes.values()):
        return matched(index, probed).drop("row")
    result = written(matched(index, probed), "nearest")
    full = result.filter(F.col("rank") == k).select("query_id", "row").distinct()
    rows = probed.filter("t = 0").select(F.col("id").alias("query_id"), "row").distinct()
    short = written(rows.join(full, ["query_id", "row"], "left_anti"), "short")
    if short.limit(1).count() == 0:
        return result.drop("row")
    again = asked.join(short.select(F.col("query_id").alias("id")).distinct(), "id", "left_semi").select("id", "vector", "log_norm").mapInArrow(hashing(1, dict.fromkeys(probed_axes, every)), HASHED)
    more = matched(index.filter("t = 0"), written(again, "probes")).join(short, ["query_id", "row"], "left_semi")
    return result.join(full, ["query_id", "row"], "left_semi").unionByName(more).drop("row")
