"""Runs of periodic words, found with string synchronising sets at dyadic scales.

A run is a stretch of consecutive words with smallest period q (words q apart
are identical) of at least ``max(least, times * q)`` words that no neighbouring
word extends keeping period q; ``times`` is 3 or more.

At scale t (a power of two) every word position has the hash of the t words
from it.  A position belongs to the synchronising set if the least hash among
it and the t positions after it stands at either end of these; that depends on
the 2 t words from the position only, so both copies of a repeated context are
chosen or neither.  Positions whose t words have a period of at most t / 3 take
no part, or the set would be dense there: they lie in runs of small periods,
which are known by then, from smaller scales.  Any stretch of 3 t - 1 words
without such a period has a member in its first t positions, so a run with q
from 4 t to 8 t - 1 words holds two members with equal contexts of 2 t words at
distance q.  These pairs propose (position, period); what is proposed is
compared word by word.  Periods below 8 are found directly, by comparing each
word with that q further on.

Hashes never decide: equal contexts have equal hashes, so none is missed, and
a collision only proposes what the comparison rejects.

Documents are worked on in blocks, joined with separators that are equal to
nothing; the longest come first, so larger scales touch a shrinking front part.
A document longer than a block is a block of its own: a task's memory follows
``block_bytes`` or its longest text (about 100 bytes a word).

Edge cases: null and empty texts have no words and no runs, and collapse to an
empty text; words are cut at ASCII white space only and compared as bytes, in
their case; runs of equal start are ordered by period; repeated rows are worked
on alike; rows keep all their columns, but those named like a result (in any
case) are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from chronoloom.llm.common import with_text_columns

#: Periods below this are found directly; scale t proposes those from 4 t to 8 t - 1, and the first scale is 2.
DIRECT = 8
NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, in UTF-8."""
    return text.encode("utf-8").split()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that looks random, and never gives NEVER for small ones."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def doubled(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of 2 ``width`` words from those of ``width`` words."""
    return mixed(h[:-width] * np.uint64(0x9E3779B97F4A7C15) + (h[width:] ^ np.uint64(width)))


def stretches(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each sequence of consecutive numbers in ascending ``at``."""
    cut = np.flatnonzero(np.diff(at) != 1)
    return at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]


class Block:
    """Words of several documents as numbers, each document with a separator after it, the longest first."""

    def __init__(self, documents: Sequence[list[bytes]], times: int):
        self.times = times
        self.order = sorted(range(len(documents)), key=lambda d: -len(documents[d]))
        self.lengths = np.array([len(documents[d]) for d in self.order], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths + 1)])[:-1].astype(np.int64)
        flat: list[bytes] = []
        for d in self.order:
            flat += documents[d]
        number = {w: i for i, w in enumerate(dict.fromkeys(flat))}
        self.words = np.arange(len(number), len(number) + len(flat) + len(documents), dtype=np.int64)  # separators keep these
        inside = np.ones(len(self.words), dtype=bool)
        inside[self.starts + self.lengths] = False
        self.words[inside] = np.fromiter(map(number.__getitem__, flat), dtype=np.int64, count=len(flat))
        self.found = np.zeros((0, 3), dtype=np.int64)  # start, end, period; at least ``times`` periods long

    def front(self, least: int) -> int:
        """Length of the part with the documents of at least ``least`` words and their separators."""
        n = int(np.searchsorted(-self.lengths, -least, side="right"))
        return int(self.starts[n - 1] + self.lengths[n - 1]) + 1 if n else 0

    def add(self, runs: np.ndarray) -> None:
        """Takes in runs of larger periods than before; a stretch that is known has a smaller period already."""
        if len(runs):
            size = len(self.words) + 1
            new = ~np.isin(runs[:, 0] * size + runs[:, 1], self.found[:, 0] * size + self.found[:, 1])
            self.found = np.concatenate([self.found, runs[new]])

    def direct(self, q: int, end: int) -> np.ndarray:
        """All stretches of period ``q`` before ``end``, by comparison of every word."""
        at = np.flatnonzero(self.words[: max(end - q, 0)] == self.words[q:end])
        if not len(at):
            return self.found[:0]
        a, b = stretches(at)
        long = b - a + 1 >= (self.times - 1) * q
        return np.stack([a[long], b[long] + 1 + q, np.full(int(long.sum()), q)], axis=1)

    def periodic(self, t: int, n: int) -> np.ndarray:
        """Which of the first ``n`` positions have ``t`` words with a period of at most t / 3."""
        start, end, q = self.found.T
        some = (3 * q <= t) & (end - start >= t) & (start < n)
        edge = np.zeros(n + 1, dtype=np.int64)
        np.add.at(edge, start[some], 1)
        np.add.at(edge, np.minimum(end[some] - t + 1, n), -1)
        return np.cumsum(edge[:-1]) > 0

    def members(self, h: np.ndarray, t: int) -> np.ndarray:
        """Positions in the synchronising set of scale ``t``, from the hashes of ``t`` words."""
        if len(h) <= t:
            return np.zeros(0, dtype=np.int64)
        h = h.copy()
        h[self.periodic(t, len(h))] = NEVER
        least, width = h, 1
        while width < t:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[: len(h) - t], h[t:])
        return np.flatnonzero(((least == h[: len(h) - t]) | (least == h[t:])) & (least != NEVER))

    def proposed(self, at: np.ndarray, context: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and periods of pairs of members with equal contexts, 4 t to 8 t - 1 apart."""
        order = np.argsort(context[at], kind="stable")
        at, key = at[order], context[at][order]
        left, lag, out = np.arange(len(at)), 1, []
        while True:
            left = left[left + lag < len(at)]
            left = left[(key[left] == key[left + lag]) & (at[left + lag] - at[left] < 8 * t)]
            if not len(left):
                break
            apart = at[left + lag] - at[left]
            out.append(np.stack([at[left], apart])[:, apart >= 4 * t])
            lag += 1
        a, q = np.concatenate(out, axis=1) if out else np.zeros((2, 0), dtype=np.int64)
        # a run of 3 q holds another q words either before or after a: their last or first 2 t must agree as well
        last = len(context) - 1
        after = (a + 2 * q - 2 * t <= last) & (context[np.minimum(a + q - 2 * t, last)] == context[np.minimum(a + 2 * q - 2 * t, last)])
        before = (a >= q) & (context[np.maximum(a - q, 0)] == context[a])
        keep = after | before
        return a[keep], q[keep]

    def unknown(self, a: np.ndarray, q: np.ndarray, t: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Proposals but those that lie in a known run whose period divides theirs."""
        if len(a) and len(self.found):
            cover = np.full(n, -1, dtype=np.int64)
            for i in np.argsort(self.found[:, 1] - self.found[:, 0], kind="stable"):
                start, end, _ = self.found[i]
                cover[start : min(end, n)] = i
            start, end, p = self.found[cover[a]].T
            keep = ~((cover[a] >= 0) & (a + q + 2 * t <= end) & (q % p == 0))
            a, q = a[keep], q[keep]
        return a, q

    def same(self, a: int, q: int, step: int) -> int:
        """How many words from ``a`` on (``step`` 1) or before it (-1) are equal to those q further on."""
        w, n, size = self.words, 0, 64
        while True:
            if step > 0:
                equal = w[a + n : a + n + size][: max(len(w) - q - a - n, 0)] == w[a + q + n : a + q + n + size]
            else:
                lo = max(a - n - size, 0)
                equal = (w[lo : a - n] == w[lo + q : a - n + q])[::-1]
            first = int(np.argmin(equal)) if len(equal) and not equal.all() else len(equal)
            n += first
            if first < size:
                return n
            size *= 2

    def confirmed(self, a: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Maximal stretches around the proposals, compared word by word; those of one stretch are one."""
        order = np.lexsort((a, q))
        a, q, out, i = a[order], q[order], [], 0
        while i < len(a):
            x, p = int(a[i]), int(q[i])
            start, end = x - self.same(x, p, -1), x + self.same(x, p, 1) + p
            if end - start >= self.times * p:
                out.append((start, end, p))
            i += 1
            same_q = i + int(np.searchsorted(q[i:], p, side="right"))
            i += int(np.searchsorted(a[i:same_q], end - p, side="left"))
        return np.array(out, dtype=np.int64).reshape(-1, 3)

    def run(self) -> np.ndarray:
        """start, end, period of all stretches of at least ``times`` smallest periods."""
        for q in range(1, DIRECT):
            self.add(self.direct(q, self.front(self.times * q)))
        t, h = 2, mixed(self.words[: self.front(self.times * DIRECT)])
        h = doubled(h, 1) if len(h) > 1 else h[:0]
        while n := self.front(self.times * 4 * t):
            h = h[: n - t + 1]
            context = doubled(h, t)
            a, q = self.proposed(self.members(h, t), context, t)
            self.add(self.confirmed(*self.unknown(a, q, t, n)))
            h, t = context, 2 * t
        return self.found

    def by_document(self, least: int) -> list[list[tuple[int, int, int]]]:
        """(start, length, period) of the runs of each document, by start, then period."""
        start, end, q = self.run().T
        keep = end - start >= np.maximum(least, self.times * q)
        start, end, q = start[keep], end[keep], q[keep]
        order = np.lexsort((q, start))
        out: list[list[tuple[int, int, int]]] = [[] for _ in self.order]
        doc = np.searchsorted(self.starts, start, side="right") - 1
        for i in order:
            out[self.order[doc[i]]].append((int(start[i] - self.starts[doc[i]]), int(end[i] - start[i]), int(q[i])))
        return out


def runs_of(documents: Sequence[list[bytes]], least: int = 24, times: int = 3) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each list of words."""
    if times < 3:
        raise ValueError("runs of less than three periods are not all proposed")
    return Block(documents, times).by_document(least) if documents else []


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, joined by single spaces, of which each run keeps its first period."""
    if runs:
        drop = np.zeros(len(words) + 1, dtype=np.int64)
        for start, length, q in runs:
            drop[start + q] += 1
            drop[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0)]
    return b" ".join(words)


RUN = T.ArrayType(T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")]), False)
ARROW_RUN = pa.list_(pa.struct([pa.field(c, pa.int64(), False) for c in ("start", "length", "period")]))


def with_runs(df: DataFrame, text_col: str = "text", least: int = 24, times: int = 3, block_bytes: int = 4 << 20) -> DataFrame:
    """``df`` with n_words, runs (by start, then period) and collapsed, the text without what repeats in them."""

    def make():
        def compute(texts: list[str]) -> list[list]:
            words = [words_of(t) for t in texts]
            found = runs_of(words, least, times)
            rows = [[{"start": s, "length": n, "period": q} for s, n, q in runs] for runs in found]
            return [[len(w) for w in words], rows, [collapsed(w, r).decode("utf-8") for w, r in zip(words, found, strict=True)]]

        return compute

    fields = [("n_words", T.LongType(), pa.int64()), ("runs", RUN, ARROW_RUN), ("collapsed", T.StringType(), pa.string())]
    return with_text_columns(df, make, fields, text_col, block_bytes)
