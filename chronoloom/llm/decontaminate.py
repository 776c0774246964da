"""Benchmark decontamination with one Aho-Corasick automaton over normalised test texts.

Texts are lower-cased (A-Z) and cut into words; every window of ``width``
consecutive words of a benchmark item (or the whole of a shorter item) is one
pattern.  Each document is scanned once; matches are mapped to word positions
and, through the words' offsets, to the original text.

The automaton's alphabet are the words that occur in the benchmark, so a window
is ``width`` nodes.  Benchmark text of more than ``block_words`` words makes
several automata; a task builds them one after another over the same group of
documents and holds one at a time, besides the compressed texts.

Edge cases: null or empty texts have no words and no hits; items without words
never occur; repeated items count once per item_id; windows of an item without
an id hit words, but name no item; an empty benchmark leaves every document
clean; columns named like a result are replaced.
"""

from __future__ import annotations

import hashlib
import itertools
import pickle
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from chronoloom.llm.common import pick, with_text_columns

# ASCII bytes: letters (lower-cased) and digits stay, others separate words; bytes from 0x80 are word bytes.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Normalised words in UTF-8."""
    return text.encode("utf-8").translate(WORD_BYTES).split()


class Patterns:
    """The windows of some items as one automaton over word numbers."""

    def __init__(self, items: list[tuple[object, str]], width: int):
        self.number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set] = {}
        for item, text in items:
            words = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text or "")]
            for i in range(max(1, len(words) - width + 1) if words else 0):
                owners.setdefault(tuple(words[i : i + width]), set()).add(item)
        self.kinds: list[tuple[int, frozenset]] = []  # words of a pattern and its items; many patterns have the same
        place: dict[tuple[int, frozenset], int] = {}
        self.built = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for window, ids in owners.items():
            kind = (len(window), frozenset(i for i in ids if i is not None))
            if kind not in place:
                place[kind] = len(self.kinds)
                self.kinds.append(kind)
            self.built.add_word(window, place[kind])
        if owners:
            self.built.make_automaton()
        self.any, self.shortest = bool(owners), min(map(len, owners), default=0)

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Which words lie inside an occurrence, and the items that occur."""
        hit = np.zeros(len(words) + 1, dtype=np.int32)
        found: set = set()
        if self.any and len(words) >= self.shortest:
            numbers = np.fromiter(map(self.number.get, words, itertools.repeat(0)), dtype=np.int64, count=len(words))
            # only stretches of words that the benchmark has can hold a pattern
            edge = np.diff(np.concatenate([[0], (numbers > 0).astype(np.int8), [0]]))
            starts, ends = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
            long = ends - starts >= self.shortest
            for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
                for last, kind in self.built.iter(tuple(numbers[a:b].tolist())):
                    n, ids = self.kinds[kind]
                    hit[a + last + 1 - n] += 1
                    hit[a + last + 1] -= 1
                    found |= ids
        return np.cumsum(hit[:-1]) > 0, found


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[bytes]:
    """Benchmark items, compressed, a bounded part at a time."""
    part, size = [], 0
    for item, text in pick(benchmark, item=id_col, text=text_col).toLocalIterator():
        n = len(words_of(text or ""))
        if part and size + n > block_words:
            yield zlib.compress(pickle.dumps(part))
            part, size = [], 0
        part.append((item, text))
        size += n
    if part:
        yield zlib.compress(pickle.dumps(part))


def in_turn(sent: list, width: int):
    """A function that gives each block's patterns one after another; those of a single block are kept."""
    built = lambda b: Patterns(pickle.loads(zlib.decompress(b.value)), width)
    if len(sent) == 1:
        only = built(sent[0])
        return lambda: [only]
    return lambda: map(built, sent)


#: Documents' bytes that meet an automaton before the next is built, where there are several.
GROUP_BYTES = 32 << 20
BLOCK_WORDS = 250_000

FIELDS = (
    ("n_words", T.LongType(), pa.int64()),
    ("n_hit", T.LongType(), pa.int64()),
    ("n_items", T.LongType(), pa.int64()),
    ("items_sha256", T.StringType(), pa.string()),
    ("contaminated", T.BooleanType(), pa.bool_()),
)


def flag(df: DataFrame, benchmark: DataFrame, width: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``df`` with n_words, n_hit, n_items, items_sha256 and contaminated; other columns are passed on."""
    sent = [df.sparkSession.sparkContext.broadcast(b) for b in blocks(benchmark, item_col, item_text_col, block_words)]

    def make():
        patterns = in_turn(sent, width)

        def compute(texts: list[str]) -> list[list]:
            words = [words_of(t) for t in texts]
            hits, items = [np.zeros(len(w), dtype=bool) for w in words], [set() for _ in words]
            for one in patterns():
                for k, w in enumerate(words):
                    more, found = one.scan(w)
                    if more.any():
                        hits[k] |= more
                        items[k] |= found
            rows = []
            for w, hit, ids in zip(words, hits, items, strict=True):
                digest = hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
                rows.append((len(w), int(hit.sum()), len(ids), digest, bool(hit.any())))
            return [list(c) for c in zip(*rows, strict=True)]

        return compute

    return with_text_columns(df, make, FIELDS, text_col, GROUP_BYTES if len(sent) > 1 else 4 << 20)


def spans_in_text(text: str, patterns: Patterns) -> list[tuple[int, int]]:
    """Code point ranges of ``text`` that lie inside occurrences: word positions mapped to the original."""
    raw = text.encode("utf-8").translate(WORD_BYTES)
    hit, _ = patterns.scan(raw.split())
    bytes_at = np.frombuffer(raw, dtype=np.uint8)
    word = np.concatenate([[False], bytes_at != 32, [False]])
    starts, ends = np.nonzero(word[1:] & ~word[:-1])[0], np.nonzero(~word[1:] & word[:-1])[0]
    points = np.concatenate([[0], np.cumsum((np.frombuffer(text.encode("utf-8"), dtype=np.uint8) & 0xC0) != 0x80)])
    out: list[tuple[int, int]] = []
    for i in np.nonzero(hit)[0]:
        a, b = int(points[starts[i]]), int(points[ends[i]])
        if out and i and hit[i - 1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def without_spans(df: DataFrame, benchmark: DataFrame, width: int = 10, text_col: str = "text", into: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``df`` with all passages of the benchmark cut out of its texts (null texts become empty)."""
    sent = [df.sparkSession.sparkContext.broadcast(b) for b in blocks(benchmark, "item_id", "text", block_words)]

    def make():
        patterns = in_turn(sent, width)

        def compute(texts: list[str]) -> list[list[str]]:
            spans: list[list[tuple[int, int]]] = [[] for _ in texts]
            for one in patterns():
                for k, t in enumerate(texts):
                    spans[k] += spans_in_text(t, one)
            return [[without(t, s) for t, s in zip(texts, spans, strict=True)]]

        return compute

    return with_text_columns(df, make, [(into, T.StringType(), pa.string())], text_col, GROUP_BYTES if len(sent) > 1 else 4 << 20)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in sorted(spans):
        out.append(text[at : max(at, a)])
        at = max(at, b)
    return "".join(out) + text[at:]
