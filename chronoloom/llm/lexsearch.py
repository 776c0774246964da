"""Ranked lexical search, reversed: the items are indexed and the documents stream through the index.

Terms are the maximal runs of letters, digits and characters from U+0080 on,
with A-Z lower-cased.  N counts the documents with a term, L all terms, n one
document's; df is the number of documents that hold a term, tf its occurrences
in one.  A term weighs floor(1000 ln((2 N + 2) / (2 df + 1))); a document has
m = 25 + 75 n N div L, and scores, for each of an item's terms (repeats
included), weight * (10^9 tf div (1000 tf + 8 m)).

The documents are read twice: once for N, L and the df of the items' terms, of
which a task sends one row each, and once for the scores.  In the second pass
each task counts its documents' terms, looks them up in the broadcast index
and keeps the ``k`` best documents of each item in a bounded heap; heaps are
merged in two steps, so no task meets the heaps of all others.

The index goes out in blocks of at most ``block_postings`` distinct terms of
items and ``block_items`` items, so its size is bounded, whatever the number of
items; with several blocks each is a pass of its own and is taken back before
the next.  Only an item with more distinct terms than that makes a larger one.

Edge cases: null and empty texts have no terms, count nowhere and score
nowhere; items without terms, or without a document above 0, give no row; rows
with equal item ids are one item with all their terms, a null id being one as
well; documents with equal ids are ranked one by one, those without an id after
others of the same score; equal scores go by ascending id; very long texts are
counted whole; an empty table on either side gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import pickle
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from chronoloom.llm.common import groups_by_bytes, pick, written

# ASCII bytes: letters (lower-cased) and digits stay, others separate terms; bytes from 0x80 are term bytes.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Cells of the table of scores, and additions to it, that are worked on at once.
CELLS = 1 << 21
GROUP_BYTES = 1 << 20


def terms_of(text: str) -> list[bytes]:
    """Normalised terms in UTF-8."""
    return text.encode("utf-8").translate(TERM_BYTES).split()


class Index:
    """Distinct terms of some items; each has its items and how often they hold it."""

    def __init__(self, postings: list[tuple[int, bytes, int]]):
        self.number: dict[bytes, int] = {}
        rows = np.array([(self.number.setdefault(t, len(self.number)), i, n) for i, t, n in postings], dtype=np.int64).reshape(-1, 3)
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        self.items, self.times = rows[:, 1].copy(), rows[:, 2].copy()
        self.first = np.searchsorted(rows[:, 0], np.arange(len(self.number) + 1))
        self.n_items = int(self.items.max()) + 1 if len(rows) else 0

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each text the number of terms; and (text, term, occurrences) for the terms that the items have."""
        lengths, at = np.zeros(len(texts), dtype=np.int64), []
        for k, text in enumerate(texts):
            terms = terms_of(text)
            lengths[k] = len(terms)
            numbers = np.fromiter(map(self.number.get, terms, itertools.repeat(-1)), dtype=np.int64, count=len(terms))
            at.append(k * len(self.number) + numbers[numbers >= 0])
        key, tf = np.unique(np.concatenate(at) if at else np.zeros(0, dtype=np.int64), return_counts=True)
        wide = max(len(self.number), 1)
        return lengths, key // wide, key % wide, tf.astype(np.int64)

    def scores(self, doc: np.ndarray, term: np.ndarray, value: np.ndarray, docs: int) -> np.ndarray:
        """Documents x items: the sum of ``value`` over the item's terms, in whole numbers."""
        table = np.zeros(docs * self.n_items, dtype=np.int64)
        many = self.first[term + 1] - self.first[term]
        so_far = np.cumsum(many)
        a = 0
        while a < len(term):
            b = max(a + 1, int(np.searchsorted(so_far, (so_far[a - 1] if a else 0) + CELLS, side="right")))
            n = many[a:b]
            post = np.repeat(self.first[term[a:b]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            np.add.at(table, np.repeat(doc[a:b], n) * self.n_items + self.items[post], np.repeat(value[a:b], n) * self.times[post])
            a = b
        return table.reshape(docs, self.n_items)


class Heaps:
    """The ``k`` best documents of each item: highest score first, then least id, then those without an id."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, dtype=np.int64)
        self.held = [np.zeros(0, dtype=np.int64) for _ in range(4)]  # item, score, id, without an id
        self.new: list[list[np.ndarray]] = []
        self.waiting, self.most = 0, max(1 << 17, 2 * k * items)

    def offer(self, scores: np.ndarray, ids: np.ndarray, absent: np.ndarray) -> None:
        doc, item = np.nonzero(scores >= self.least)
        self.new.append([item, scores[doc, item], ids[doc], absent[doc]])
        self.waiting += len(doc)
        if self.waiting > self.most:
            self.best()

    def best(self) -> list[np.ndarray]:
        item, score, ids, absent = (np.concatenate([h, *more]) for h, *more in zip(self.held, *self.new, strict=True))
        order = np.lexsort((ids, absent, -score, item))
        item = item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        keep = order[rank < self.k]
        self.held = [x[keep] for x in (np.concatenate([h, *more]) for h, *more in zip(self.held, *self.new, strict=True))]
        last = rank == self.k - 1
        self.least[item[last]] = score[order][last]
        self.new, self.waiting = [], 0
        return self.held


def postings(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """item, term, n: how often each item holds each of its terms."""
    rows = pick(items, item=item_col, text=text_col)
    kind = to_arrow_type(rows.schema["item"].dataType)

    def count(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                found = Counter(terms_of(batch.column(1)[at].as_py() or ""))
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[at], len(found)).cast(kind), pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["item", "term", "n"])

    schema = T.StructType([T.StructField("item", rows.schema["item"].dataType), T.StructField("term", T.BinaryType()), T.StructField("n", T.LongType())])
    return rows.mapInArrow(count, schema).groupBy("item", "term").agg(F.sum("n").alias("n"))


def blocks(found: DataFrame, block_postings: int, block_items: int) -> Iterator[tuple[list, list[tuple[int, bytes, int]]]]:
    """Items and their postings, in order of the items, some at a time."""
    items: list = []
    part: list[tuple[int, bytes, int]] = []
    for row in found.orderBy("item", "term").toLocalIterator():
        if not items or row["item"] != items[-1]:
            if len(part) >= block_postings or len(items) >= block_items:
                yield items, part
                items, part = [], []
            items.append(row["item"])
        part.append((len(items) - 1, bytes(row["term"]), row["n"]))
    if items:
        yield items, part


def statistics(docs: DataFrame, sent) -> tuple[int, int, dict[int, int]]:
    """Documents with a term, terms of all documents, and of each indexed term the documents that hold it."""

    def count(batches):
        index = Index(pickle.loads(zlib.decompress(sent.value)))
        df, some, all_terms = np.zeros(len(index.number), dtype=np.int64), 0, 0
        for batch in batches:
            texts = batch.column(1)
            for a, b in groups_by_bytes(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), GROUP_BYTES):
                lengths, _, term, _ = index.counts([t or "" for t in texts.slice(a, b - a).to_pylist()])
                df += np.bincount(term, minlength=len(df))
                some += int((lengths > 0).sum())
                all_terms += int(lengths.sum())
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], there])), pa.array(np.concatenate([[some, all_terms], df[there]]))], names=["term", "n"])

    got = docs.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    by_term = {r["term"]: r["n"] for r in got}
    return by_term.pop(-2, 0), by_term.pop(-1, 0), by_term


def ranked(docs: DataFrame, sent, weights, items: pa.Array, item_type: T.DataType, k: int) -> DataFrame:
    """item_id, rank, doc_id, score from one pass over ``docs`` with the index, N, L and weights that were sent."""

    def score(batches):
        index = Index(pickle.loads(zlib.decompress(sent.value)))
        some, all_terms, weight = weights.value
        heaps = Heaps(index.n_items, k)
        most = max(1, CELLS // index.n_items)
        for batch in batches:
            absent = batch.column(0).is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            ids, texts = pc.fill_null(batch.column(0), 0).to_numpy(), batch.column(1)
            for a, end in groups_by_bytes(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), GROUP_BYTES):
                for b in range(a, end, most):
                    n = min(most, end - b)
                    lengths, doc, term, tf = index.counts([t or "" for t in texts.slice(b, n).to_pylist()])
                    m = np.array([25 + 75 * int(x) * some // max(all_terms, 1) for x in lengths], dtype=np.int64)
                    value = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
                    heaps.offer(index.scores(doc, term, value, n), ids[b : b + n], absent[b : b + n])
        item, score, ids, absent = heaps.best()
        for a in range(0, len(item), 1 << 16):
            part = slice(a, a + (1 << 16))
            yield pa.RecordBatch.from_arrays([items.take(pa.array(item[part])), pa.array(ids[part], mask=absent[part] > 0), pa.array(score[part])], names=["item_id", "doc_id", "score"])

    schema = T.StructType([T.StructField("item_id", item_type, True), T.StructField("doc_id", T.LongType(), True), T.StructField("score", T.LongType(), True)])
    heaps = docs.mapInArrow(score, schema).withColumn("part", F.spark_partition_id() % 256)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    near = heaps.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order))).filter(F.col("rank") <= k)
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).filter(F.col("rank") <= k)
    return best.select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_postings: int = 1_000_000, block_items: int = 20_000) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` highest-scoring documents of each item, all documents being scored."""
    spark = docs.sparkSession
    read = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = postings(items, item_col, item_text_col)
    item_type = found.schema["item"].dataType

    def pass_over(block: tuple[list, list]) -> tuple[DataFrame, list]:
        values, part = block
        sent = spark.sparkContext.broadcast(zlib.compress(pickle.dumps(part)))
        some, all_terms, df = statistics(read, sent)
        weight = np.array([math.floor(1000 * math.log((2 * some + 2) / (2 * df.get(t, 0) + 1))) for t in range(len({t for _, t, _ in part}))], dtype=np.int64)
        weights = spark.sparkContext.broadcast((some, all_terms, weight))
        return ranked(read, sent, weights, pa.array(values, to_arrow_type(item_type)), item_type, k), [sent, weights]

    todo = blocks(found, block_postings, block_items)
    this, more = next(todo, None), None
    if this is None:
        return spark.createDataFrame([], T.StructType([T.StructField("item_id", item_type), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())]))
    results = []
    while this is not None:
        more = next(todo, None)
        result, sent = pass_over(this)
        if more is not None or results:  # one block's index at a time: its result is written before the next goes out
            result = written(result, "ranked")
            for b in sent:
                b.destroy()
        results.append(result)
        this = more
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out
