"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of its character n-gram vectors (and its own), so
misspellings and unseen forms share the vectors of their n-grams.  A text is
scored by windows of words: the mean of a window's word vectors goes into the
softmax, and the text's evidence is its best window, so a few toxic words in a
long text are not averaged away.  Training sees labels of whole texts only: of
a toxic text the windows that score best count as toxic, of others all count
as clean.  The evidence is turned into a probability by a logistic fit.

The model is fitted on a bounded sample: ``max_texts`` labelled texts (of which
at most ``toxic_share`` toxic), each of at most ``max_chars`` characters, and
``max_windows`` windows a text.  Scoring covers every whole text; as averaging
and the softmax are linear, a word's part of the score is a mean over its
n-grams, computed for a batch of texts, or a piece of a very long one, at once.

Edge cases: a text without words (null, empty) gets the score of no evidence;
texts with several labels count by their highest; null labels and null ids
don't train; without both labels in the sample every score is the share of
toxic ones; repeated rows score alike; an empty table gives an empty result;
columns named like a result are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.llm.common import groups_by_bytes, pick, with_text_columns

WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Settings:
    max_texts: int = 4500
    toxic_share: float = 1 / 3
    max_chars: int = 60_000
    max_windows: int = 24
    window: int = 8
    stride: int = 4
    buckets: int = 1 << 17
    dim: int = 4
    shortest: int = 3
    longest: int = 6
    steps: int = 80
    rate: float = 0.1
    decay: float = 2e-3
    seed: int = 7


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


@dataclass
class Bags:
    """Words of texts in order, and the buckets of each word's n-grams and of itself."""

    n_words: np.ndarray  # of each text
    gram: np.ndarray  # bucket, one a gram, by place
    place: np.ndarray  # of each gram: index of a character in its word
    starts: np.ndarray  # first character of each word
    ends: np.ndarray
    n_chars: int


def bags(texts: list[str], s: Settings) -> Bags:
    """All character n-grams at once: a gram may have the word's border at either end, its inner characters are letters."""
    lowered = [t.lower() for t in texts]
    code = np.frombuffer((" " + " ".join(lowered) + " ").encode("utf-32-le", errors="replace"), dtype="<u4")
    letter = letters()[code]
    sym = np.where(letter, code, 1).astype(np.uint64)
    edge = np.diff(letter.astype(np.int8))
    starts, ends = np.nonzero(edge == 1)[0] + 1, np.nonzero(edge == -1)[0] + 1
    text_at = np.cumsum([1] + [len(t) + 1 for t in lowered])
    n_words = np.diff(np.searchsorted(starts, text_at))
    hashed = sym * np.uint64(0x9E3779B97F4A7C15)
    hashed ^= hashed >> np.uint64(29)
    rolled = hashed.copy()
    inner = np.ones(len(sym), dtype=bool)
    grams, places = [], []
    for n in range(2, s.longest + 1):
        # rolled[p]: of characters p .. p+n-1; inner[p]: p+1 .. p+n-2 are letters
        rolled = rolled[:-1] * np.uint64(0x100000001B3) + hashed[n - 1 :]
        inner = inner[: len(rolled)] if n == 2 else inner[: len(rolled)] & letter[n - 2 : n - 2 + len(rolled)]
        if n >= s.shortest:
            at = np.nonzero(inner)[0]
            h = rolled[at]
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            grams.append((h >> np.uint64(40)).astype(np.int64) % s.buckets)
            places.append(at + 1)
    if len(starts):
        index = np.arange(len(code)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(code)]])))
        power = np.uint64(0x9DDFEA08EB382D69) ** np.arange(min(index.max() + 1, 64), dtype=np.uint64)
        with np.errstate(over="ignore"):
            whole = np.add.reduceat(np.where(letter, hashed * power[index % 64], np.uint64(0)), starts)
        key = (whole ^ (whole >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        grams.append((key >> np.uint64(40)).astype(np.int64) % s.buckets)
        places.append(starts)
    return Bags(n_words, np.concatenate(grams) if grams else np.zeros(0, np.int64), np.concatenate(places) if places else np.zeros(0, np.int64), starts, ends, len(code))


def word_means(b: Bags, value: np.ndarray) -> np.ndarray:
    """Mean over each word's grams of ``value[bucket]``."""
    if not len(b.starts):
        return np.zeros(0)
    total = np.concatenate([[0.0], np.cumsum(np.bincount(b.place, weights=value[b.gram], minlength=b.n_chars))])
    count = np.concatenate([[0], np.cumsum(np.bincount(b.place, minlength=b.n_chars))])
    return (total[b.ends] - total[b.starts]) / np.maximum(count[b.ends] - count[b.starts], 1)


def words_of(text: str) -> list[str]:
    """The same words as in :func:`bags`: runs of letters, lower-cased."""
    out: list[str] = []
    for w in WORD.findall(text.lower()):
        out += [w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split()
    return out


def window_starts(n: int, s: Settings) -> np.ndarray:
    """Starts of windows that cover ``n`` words; one for short texts."""
    return np.arange(0, max(n - s.window, 0) + s.stride, s.stride) if n > s.window else np.zeros(1, dtype=np.int64)


def pieces(text: str, most: int):
    """``text`` cut before spaces and line breaks, where no word and no n-gram goes on, into pieces of at most ``most`` characters (a longer run without either stays whole)."""
    at = 0
    while len(text) - at > most:
        cut = max(text.rfind(c, at + 1, at + most) for c in " \n")
        if cut < 0:
            cut = min((p for c in " \n" if (p := text.find(c, at + most)) >= 0), default=len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


@dataclass
class Model:
    settings: Settings
    gram_logit: np.ndarray  # each n-gram vector times the difference of the softmax's two columns
    bias: float
    slope: float
    length_slope: float
    intercept: float

    def evidences(self, texts: list[str], most: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
        """Evidence and number of words of each text; n-grams of at most about ``most`` characters are held at once."""
        cut = [list(pieces(t, most)) for t in texts]
        flat = [p for own in cut for p in own]
        parts, words = [np.zeros(0)], []
        for i, j in groups_by_bytes([len(p) for p in flat], most):
            b = bags(flat[i:j], self.settings)
            parts.append(word_means(b, self.gram_logit))
            words += b.n_words.tolist()
        by_piece = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
        at = by_piece[np.concatenate([[0], np.cumsum([len(own) for own in cut], dtype=np.int64)])]
        part = np.concatenate(parts)
        return np.array([self.evidence(part[k:m]) for k, m in zip(at[:-1], at[1:], strict=True)]), np.diff(at)

    def evidence(self, parts: np.ndarray) -> float:
        """Logit of the best window, from the words' parts."""
        s = self.settings
        if not len(parts):
            return -30.0
        total = np.concatenate([[0.0], np.cumsum(parts)])
        starts = window_starts(len(parts), s)
        ends = np.minimum(starts + s.window, len(parts))
        starts = np.maximum(ends - s.window, 0)
        return float(((total[ends] - total[starts]) / (ends - starts)).max()) + self.bias

    def probability(self, evidence: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        z = self.slope * evidence + self.length_slope * np.log1p(n_words) + self.intercept
        return 1.0 / (1.0 + np.exp(-np.clip(z, -50, 50)))


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Weights of a slightly ridged logistic regression, by Newton's method; the last column of ``x`` is 1."""
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(texts: list[str], labels: list[int], s: Settings = Settings()) -> Model:
    """Embeddings and softmax from three of four texts, the logistic fit from the others."""
    y = np.asarray(labels, dtype=np.int64)
    aside = np.arange(len(y)) % 4 == 3
    share = float(y.mean()) if len(y) else 0.0
    if len({0, 1} & set(y[~aside].tolist())) < 2:
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Model(s, np.zeros(s.buckets), 0.0, 0.0, 0.0, float(np.log(share / (1 - share))))
    model = train([t for t, a in zip(texts, aside, strict=True) if not a], y[~aside], s)
    evidence, length = model.evidences(texts)
    use = (length > 0) & (aside if len(set(y[aside].tolist())) == 2 else True)
    x = np.column_stack([evidence, np.log1p(length), np.ones(len(y))])[use]
    model.slope, model.length_slope, model.intercept = map(float, logistic(x, y[use].astype(float)))
    return model


def train(texts: list[str], y: np.ndarray, s: Settings) -> Model:
    rng = np.random.default_rng(s.seed)
    # windows of words: (text, words); of a text with many, a random choice
    index: dict[str, int] = {}
    owner, row_list, sizes = [], [], []
    for i, text in enumerate(texts):
        words = words_of(text)
        starts = window_starts(len(words), s)
        if len(starts) > s.max_windows:
            starts = np.sort(rng.choice(starts, s.max_windows, replace=False))
        for a in starts.tolist():
            if part := words[a : a + s.window]:
                owner.append(i)
                sizes.append(len(part))
                row_list += [index.setdefault(w, len(index)) for w in part]
    owner, rows, size = np.array(owner), np.array(row_list, dtype=np.int32), np.array(sizes, dtype=np.float32)
    of_row = np.repeat(np.arange(len(owner), dtype=np.int32), sizes)
    row_starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    # grams of the distinct words, one word after another
    b = bags([" ".join(index)], s)
    order = np.argsort(b.place, kind="stable")
    gram_word = (np.searchsorted(b.starts, b.place[order], side="right") - 1).astype(np.int32)
    buckets, gram = np.unique(b.gram[order], return_inverse=True)
    gram = gram.astype(np.int32)
    n_grams = np.bincount(gram_word, minlength=len(index)).astype(np.float32)
    word_starts = np.concatenate([[0], np.cumsum(n_grams.astype(np.int64))[:-1]])
    del b, order, row_list
    row_order, gram_order = np.argsort(rows, kind="stable"), np.argsort(gram, kind="stable")
    row_first, gram_first = (np.searchsorted(k[o], np.arange(n)) for k, o, n in ((rows, row_order, len(index)), (gram, gram_order, len(buckets))))
    of_row_by_word, word_by_gram = of_row[row_order], gram_word[gram_order]
    del row_order, gram_order, gram_word
    text_starts = np.concatenate([[0], np.nonzero(np.diff(owner))[0] + 1])
    text_sizes = np.diff(np.concatenate([text_starts, [len(owner)]]))

    params = {"e": rng.normal(0, 0.1, (len(buckets), s.dim)).astype(np.float32), "w": rng.normal(0, 0.3, (s.dim, 2)).astype(np.float32), "b": np.zeros(2, dtype=np.float32)}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    toxic = y[owner] == 1
    for step in range(1, s.steps + 1):
        word = np.add.reduceat(params["e"][gram], word_starts, axis=0) / n_grams[:, None]
        mean = np.add.reduceat(word[rows], row_starts, axis=0) / size[:, None]
        logits = mean @ params["w"] + params["b"]
        p = 1 / (1 + np.exp(-np.clip(logits[:, 1] - logits[:, 0], -30, 30)))
        use = np.ones(len(owner), dtype=np.float32)
        if step > s.steps // 5:  # of a toxic text, the best window and others that score high
            best = np.repeat(np.maximum.reduceat(p, text_starts), text_sizes)
            use = np.where(toxic, (p >= best) | (p > 0.7), True).astype(np.float32)
        weight = use * np.where(toxic, 0.5 / max(float((use * toxic).sum()), 1), 0.5 / max(float((~toxic).sum()), 1))
        slope = ((p - toxic) * weight * 100).astype(np.float32)
        grad_logits = np.column_stack([-slope, slope])
        grad_mean = (grad_logits @ params["w"].T) / size[:, None]
        grad_word = np.add.reduceat(grad_mean[of_row_by_word], row_first, axis=0) / n_grams[:, None]
        grads = {"e": np.add.reduceat(grad_word[word_by_gram], gram_first, axis=0) + s.decay * params["e"], "w": mean.T @ grad_logits + s.decay * params["w"], "b": grad_logits.sum(axis=0)}
        for k, g in grads.items():
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            params[k] -= s.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    gram_logit = np.zeros(s.buckets)
    gram_logit[buckets] = params["e"] @ (params["w"][:, 1] - params["w"][:, 0])
    return Model(s, gram_logit, float(params["b"][1] - params["b"][0]), 1.0, 0.0, 0.0)


def training_sample(docs: DataFrame, labels: DataFrame, s: Settings, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[list[str], list[int]]:
    """At most ``s.max_texts`` labelled texts of at most ``s.max_chars`` characters, chosen by a hash of their ids; so what comes to the driver is bounded."""
    n_toxic = int(s.max_texts * s.toxic_share)
    marks = pick(labels, key=id_col, toxic=label_col).filter("key is not null and toxic is not null").groupBy("key").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.col("key"), F.lit(11))
    parts = [marks.filter(cond).orderBy(order, "key").limit(n) for cond, n in (("toxic = 1", n_toxic), ("toxic <> 1", s.max_texts - n_toxic))]
    chosen = parts[0].unionByName(parts[1])  # bounded by s.max_texts
    short = pick(docs, key=id_col, text=text_col).filter(F.coalesce(F.length("text"), F.lit(0)) <= s.max_chars)
    texts = short.join(F.broadcast(chosen), "key").groupBy("key").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = sorted(texts.collect(), key=lambda r: r["key"])
    return [r["text"] or "" for r in rows], [int(r["toxic"] == 1) for r in rows]


FIELDS = (("score", T.DoubleType(), pa.float64()), ("predicted", T.IntegerType(), pa.int32()))


def with_scores(df: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """``df`` with score (probability of label 1) and predicted (1 if score >= ``threshold``)."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # bounded: one number a bucket

    def make():
        m = sent.value

        def compute(texts: list[str]) -> list:
            score = m.probability(*m.evidences(texts))
            return [score, (score >= threshold).astype(np.int32)]

        return compute

    return with_text_columns(df, make, FIELDS, text_col)
