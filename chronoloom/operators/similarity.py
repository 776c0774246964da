"""Vector and hash similarity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.functions.exprs import cosine, hamming, median_of, packed_bits
from chronoloom.operators.series import neighbours, ranged
from chronoloom.sources.store import busy, filesystem, shared_dir


def sign_hash(vectors: DataFrame, vector: str, into: str = "hash") -> DataFrame:
    """64 bits, first component highest: whether a component is above the vector's median."""
    return vectors.withColumn("_m", median_of(F.col(vector))).withColumn(into, packed_bits(F.transform(vector, lambda x: x.cast("double") > F.col("_m")))).drop("_m")


#: Bits of a band from which on bands are worth a join: below, most pairs would meet in some band.
BAND_BITS = 12


def hamming_pairs(hashes: DataFrame, most: int, key: str = "id", value: str = "hash", block: int = 8192) -> DataFrame:
    """(a, b, distance) of pairs a < b at most ``most`` bits apart.

    For a few bits, 64 bits are cut into ``most`` + 1 bands; a pair that close
    agrees on one of them, so pairs meet in an equality join on band and value
    and are made at their first equal band only.  Bands narrower than BAND_BITS
    would join a large share of all pairs in every band; then packed blocks of
    ``block`` hashes are compared, each pair of blocks once, 64 bits an
    operation, and nothing but the pairs that are close enough is made.
    """
    rows = hashes.select(F.col(key).cast("long").alias("k"), F.col(value).alias("h")).filter("k is not null and h is not null")
    bands = most + 1
    return banded_pairs(rows, most) if 64 // bands >= BAND_BITS else blocked_pairs(rows, most, block)


def banded_pairs(rows: DataFrame, most: int) -> DataFrame:
    bands = most + 1
    edges = [64 * i // bands for i in range(bands + 1)]
    part = lambda h, i: F.shiftrightunsigned(F.shiftleft(h, 64 - edges[i + 1]), 64 - edges[i + 1] + edges[i])
    parts = F.array(*[F.struct(F.lit(i).alias("band"), part(F.col("h"), i).alias("part")) for i in range(bands)])
    split = rows.select("k", "h", F.explode(parts).alias("p")).select("k", "h", "p.*")
    a, b = (split.select(F.col("k").alias(n), F.col("h").alias(n + "_h"), "band", "part") for n in "ab")
    met = a.join(b, ["band", "part"]).filter("a < b").withColumn("distance", hamming(F.col("a_h"), F.col("b_h"))).filter(F.col("distance") <= most)
    first = F.coalesce(*[F.when(part(F.col("a_h"), i) == part(F.col("b_h"), i), F.lit(i)) for i in range(bands)])
    return met.filter(F.col("band") == first).select("a", "b", "distance").distinct()


def blocked_pairs(rows: DataFrame, most: int, block: int) -> DataFrame:
    """All pairs of packed blocks; the number of blocks comes from a count."""
    n = max(1, -(-rows.count() // block))
    dealt = rows.withColumn("i", F.pmod(F.xxhash64("k"), F.lit(n)).cast("int"))

    def pack(part):
        ids, h = (part.column(c).to_numpy().astype("<i8").tobytes() for c in ("k", "h"))
        return pa.table({"i": pa.array([part.column("i")[0].as_py()], pa.int32()), "ids": pa.array([ids], pa.binary()), "bits": pa.array([h], pa.binary())})

    packed = dealt.select("i", "k", "h").groupBy("i").applyInArrow(pack, "i int, ids binary, bits binary")
    left = packed.select(F.col("i").alias("li"), F.col("ids").alias("lids"), F.col("bits").alias("lbits"), F.explode(F.sequence("i", F.lit(n - 1))).alias("i"))

    def compare(batches):
        for batch in batches:
            for li, lids, lbits, i, ids, bits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a_ids, b_ids = np.frombuffer(lids, dtype="<i8"), np.frombuffer(ids, dtype="<i8")
                a, b = np.frombuffer(lbits, dtype="<u8"), np.frombuffer(bits, dtype="<u8")
                for at in range(0, len(a), 256):
                    apart = np.bitwise_count(a[at : at + 256, None] ^ b[None, :])
                    x, y = np.nonzero(apart <= most)
                    first, second, distance = a_ids[at + x], b_ids[y], apart[x, y]
                    use = first < second if li == i else first != second
                    lo, hi = np.minimum(first, second)[use], np.maximum(first, second)[use]
                    yield pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi), pa.array(distance[use].astype(np.int32))], names=["a", "b", "distance"])

    met = left.join(packed, "i").select("li", "lids", "lbits", "i", "ids", "bits")
    return met.repartition(min(max(n * (n + 1) // 2, 1), 4096)).mapInArrow(compare, "a long, b long, distance int").distinct()


def vector_mean(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """key, dim, mean: component-wise means by key, summed before the shuffle."""
    return vectors.select(key, F.posexplode(vector).alias("dim", "x")).groupBy(key, "dim").agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"))


def adjacent(vectors: DataFrame, key: str, order: str, vector: str) -> DataFrame:
    """Each row with the one before it in its group, and their cosine: key, order, before, cos."""
    held = ranged(vectors.select(key, order, vector), [key], order)
    near = neighbours(held, [key], order, before=[order, vector])
    return near.filter(f"_before.{order} is not null").select(key, order, F.col(f"_before.{order}").alias("before"), F.round(cosine(F.col(f"_before.{vector}"), F.col(vector)), 4).alias("cos"))


def best_reference(vectors: DataFrame, references: DataFrame, least: float, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", block: int = 1024) -> DataFrame:
    """id, label, score: for each vector and label the best cosine with that label's references, if at least ``least``.

    References are packed into matrices of one label and about ``block`` rows
    and written to the shared folder; a task takes batches of vectors, reads
    one matrix after another for each, and keeps one score a vector and matrix,
    so it holds a batch and a matrix, however many there are.
    Sums are in double precision, in the order of numpy's product; scores are
    rounded to four places.  Null vectors take no part; zero ones score 0.
    """
    spark = vectors.sparkSession
    refs = references.select(F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("r")).filter("r is not null")
    kind = dict(refs.dtypes)["label"]
    counts = refs.groupBy(F.col("label").alias("of")).agg(F.ceil(F.count("*") / block).alias("parts"))
    numbered = refs.join(counts, F.col("label").eqNullSafe(F.col("of"))).select(F.col("label").cast("string").alias("label"), "r", F.pmod(F.xxhash64("r"), "parts").alias("part"))

    def pack(part: pa.Table) -> pa.Table:
        x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in part.column("r").chunks]).astype("<f8")
        return pa.table({"label": part.column("label").slice(0, 1).combine_chunks(), "n": pa.array([part.num_rows], pa.int32()), "x": pa.array([x.tobytes()], pa.binary())})

    uri = shared_dir(spark, "references")
    numbered.groupBy("label", "part").applyInArrow(pack, "label string, n int, x binary").write.parquet(uri)

    def matrices():
        fs, base = filesystem(uri)
        for path in sorted(f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(base)) if f.path.endswith(".parquet")):
            with fs.open_input_file(path) as file:
                for batch in pyarrow.parquet.ParquetFile(file).iter_batches(batch_size=1):
                    for of, n, x in zip(*(batch.column(c) for c in ("label", "n", "x")), strict=True):
                        yield of.as_py(), np.frombuffer(x.as_buffer(), dtype="<f8").reshape(n.as_py(), -1)

    def compare(batches):
        for batch in batches:
            ids = batch.column("id")
            for of, r in matrices() if batch.num_rows else ():
                nr = np.sqrt((r * r).sum(axis=1))
                for at in range(0, batch.num_rows, 1024):
                    mine = batch.column("v").slice(at, 1024)
                    v = mine.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(mine), -1)
                    norm = np.sqrt((v * v).sum(axis=1))[:, None] * nr[None, :]
                    score = np.where(norm == 0, 0.0, (v @ r.T) / np.where(norm == 0, 1.0, norm)).max(axis=1)
                    good = np.flatnonzero(score >= least - 1e-4)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at + good)), pa.array([of] * len(good), pa.string()), pa.array(score[good])], names=["id", "label", "score"])

    mine = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v")).filter("v is not null")
    scored = mine.repartition(busy(spark)).mapInArrow(compare, "id long, label string, score double")
    best = scored.groupBy("id", "label").agg(F.round(F.max("score"), 4).alias("score")).filter(F.col("score") >= least)
    return best.select(F.col("id").alias(id_col), F.col("label").cast(kind).alias("label"), "score")
