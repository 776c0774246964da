"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are compiled from the model file: the normaliser (spaces to the
meta symbol, one put in front), the lexicon (a trie over pieces, with byte
arcs for characters that no piece spells) and a bigram acceptor over pieces.
They are composed with each input on the fly and the shortest path in the
tropical semiring (min, +) is the encoding.

For unigram models an arc weighs minus the piece's score, and every bigram 0.
For BPE models the result of merging is the only segmentation in which every
adjacent pair of pieces, merged alone, stays that pair; so the bigram weighs 0
if the pair is stable and infinity if not, and each arc weighs 1.  Pairs are
judged when they are first met, from the model's merge priorities.

Inputs are cut before each meta symbol that follows another character and
around characters that only bytes spell, which no piece spans; each distinct
chunk is composed once a task.

Edge cases: null and empty texts have no pieces; decoding gives the text back,
but for meta symbols in the input, which come back as spaces (``lossless`` is
false then); repeated rows are encoded each on their own; an empty table gives
an empty result; columns named like a result are replaced.
"""

from __future__ import annotations

import hashlib
import re
import sys
import zlib
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from chronoloom.llm.common import position, with_text_columns

META = "▁"
# Fixed values of the model format: kinds of piece, kinds of model.
NORMAL, USER_DEFINED, BYTE = 1, 4, 6
UNIGRAM, BPE = 1, 2
#: Judged pairs and words' ids that a task holds (as many again of the older ones).
MOST_PAIRS, MOST_WORDS = 150_000, 120_000


class PieceTransducer:
    def __init__(self, path: str):
        if sys.byteorder != "little":
            raise RuntimeError("ids are packed in native order, which must be little-endian")
        model = model_pb2.ModelProto()
        with open(path if "/" in path else public_tokenizers.path(path), "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or not model.trainer_spec.byte_fallback or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models with identity normalisation and byte fallback are compiled")
        self.bpe = model.trainer_spec.model_type == BPE
        self.prefix = META if spec.add_dummy_prefix else ""
        self.pieces = [p.piece for p in model.pieces]
        self.id_of = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (NORMAL, USER_DEFINED)}
        self.score = {p.piece: p.score for p in model.pieces if p.type in (NORMAL, USER_DEFINED)}
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.byte_of = {i: bytes([b]) for b, i in self.byte_id.items()}
        self.spelling = [self.byte_of.get(i, p.encode("utf-8")) for i, p in enumerate(self.pieces)]
        if any(META in p.lstrip(META) for p in self.id_of):
            raise ValueError("a piece spans the start of a word")
        self.single = {p for p in self.id_of if len(p) == 1}
        self.spelled = {c for p in self.id_of for c in p}
        self.stable: dict[tuple[str, str], bool] = {}
        self.older_stable: dict[tuple[str, str], bool] = {}
        # lexicon: a trie; a state is a dict from characters to states, None holds the piece that ends there
        self.lexicon: dict = {}
        for p in self.id_of:
            if self.bpe and len(p) > 1 and self.merge(p) != [p]:
                continue  # merging never makes it
            state = self.lexicon
            for c in p:
                state = state.setdefault(c, {})
            state[None] = p
        # marks that no piece has next to a letter: a word and the mark after it are chunks of their own
        beside = {c for p in self.id_of for pair in zip(p, p[1:]) if pair[0].isalpha() != pair[1].isalpha() for c in pair}
        self.marks = frozenset(c for c in ".,!?;:" if c not in beside)
        self.word_ids = Memo(self, META)
        self.plain_ids = Memo(self, "")

    def merge(self, text: str) -> list[str]:
        """Pieces of a short string by its merges, best score first, then leftmost."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def bigram(self, a: str | None, b: str) -> bool:
        """Whether the acceptor lets ``b`` follow ``a``."""
        if a is None or not self.bpe:
            return True
        known = self.stable.get((a, b))
        if known is None:
            known = self.older_stable.get((a, b))
            if known is None:
                known = a[-1] not in self.spelled or b[0] not in self.spelled or self.merge(a + b) == [a, b]
            if len(self.stable) >= MOST_PAIRS:
                self.older_stable, self.stable = self.stable, {}
            self.stable[a, b] = known
        return known

    def arcs(self, text: str, at: int) -> list[str]:
        """Pieces that the lexicon reads at ``at``; a character outside it is read alone (as bytes)."""
        out, state, i = [], self.lexicon, at
        n = len(text)
        while i < n and (state := state.get(text[i])) is not None:
            i += 1
            if (piece := state.get(None)) is not None:
                out.append(piece)
        if not out or len(out[0]) > 1:
            out.append(text[at])  # spelled in bytes unless it is merged
        return out

    def shortest(self, text: str) -> list[str]:
        """Labels of the shortest path through the composition with ``text``; its states are (position, last piece)."""
        return self.finite_path(text) if self.bpe else self.least_path(text)

    def finite_path(self, text: str) -> list[str]:
        """The only path of finite weight: a state is where its last piece starts and ends; states are composed when they are reached, longest arcs first."""
        n, lexicon, stable = len(text), self.lexicon, self.stable
        seen: set[int] = set()
        todo: list[tuple] = [(0, None, None)]
        while todo:
            state = todo.pop()
            at, a, _ = state
            if at == n:
                out = []
                while state[2] is not None:
                    out.append(state[1])
                    state = state[2]
                return out[::-1]
            i, node, alone = at, lexicon, False
            while i < n:
                node = node.get(text[i])
                if node is None:
                    break
                i += 1
                b = node.get(None)
                if b is not None:
                    alone = alone or i == at + 1
                    if (at * (n + 1) + i) not in seen and (a is None or (ok := stable.get((a, b))) or ok is None and self.bigram(a, b)):
                        seen.add(at * (n + 1) + i)
                        todo.append((i, b, state))
            if not alone and (at * (n + 1) + at + 1) not in seen and self.bigram(a, text[at]):  # spelled in bytes unless it is merged
                seen.add(at * (n + 1) + at + 1)
                todo.append((at + 1, text[at], state))
        raise ValueError(f"no segmentation of {text!r}")

    def least_path(self, text: str) -> list[str]:
        """Dynamic programme over positions: every arc reads something, so position order is topological."""
        best: list[tuple[float, str] | None] = [(0.0, "")] + [None] * len(text)
        for i in range(len(text)):
            if best[i] is not None:
                for b in self.arcs(text, i):
                    w, j = best[i][0] - self.score.get(b, -1e4), i + len(b)
                    if best[j] is None or w < best[j][0]:
                        best[j] = (w, b)
        at, out = len(text), []
        while at:
            out.append(best[at][1])
            at -= len(out[-1])
        return out[::-1]

    def ids_of(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            if p in self.id_of:
                out.append(self.id_of[p])
            else:
                out += [self.byte_id[b] for b in p.encode("utf-8")]
        return out

    def normalise(self, text: str) -> str:
        return (self.prefix + text.replace(" ", META)) if text else ""

    def packed(self, chunk: str) -> bytes:
        return array("I", self.ids_of(self.shortest(chunk))).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as unsigned 32-bit little-endian integers."""
        if not self.prefix or META in text or "  " in text or text[:1] == " ":
            return b"".join(map(self.plain_ids.__getitem__, CHUNK.findall(self.normalise(text))))
        if not text:
            return b""
        # single spaces only: each word after one is a chunk, and so is each line's first word
        word = self.word_ids.__getitem__
        first, *lines = text.split("\n")
        parts = list(map(word, first.split(" ")))
        for line in lines:
            start, *words = line.split(" ")
            parts += (self.plain_ids["\n"], self.plain_ids[start], *map(word, words))
        return b"".join(parts)

    def decode(self, ids: bytes) -> str:
        parts = map(self.spelling.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())
        text = b"".join(parts).decode("utf-8", errors="replace").replace(META, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


class Memo(dict):
    """Ids of distinct chunks after ``lead``, computed when first asked for; the newest ``most`` and those used since are held."""

    def __init__(self, machine: PieceTransducer, lead: str, most: int = MOST_WORDS):
        super().__init__()
        self.machine, self.lead, self.most = machine, lead, most
        self.older: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        got = self.older.get(key)
        if got is None:
            if len(key) > 1 and key[-1] in self.machine.marks and (word := key[:-1]).isalpha():
                return self[word] + self.machine.plain_ids[key[-1]]
            got = self.machine.packed(self.lead + key)
        if len(key) <= 40:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = got
        return got


#: A line break stands alone (bytes spell it); else a run of meta symbols and what follows up to the next.
CHUNK = re.compile(f"\n|{META}+[^{META}\n]*|[^{META}\n]+")


@lru_cache(maxsize=2)
def compiled(path: str) -> PieceTransducer:
    return PieceTransducer(path)


class Codec:
    """Encodes texts and decodes them again."""

    def __init__(self, path: str, with_ids: bool):
        self.machine, self.with_ids = compiled(path), with_ids
        if "\n" in self.machine.spelled:
            raise ValueError("a piece spells the line break")
        self.is_byte = np.zeros(len(self.machine.pieces), dtype=bool)
        self.is_byte[list(self.machine.byte_of)] = True

    def __call__(self, texts: list[str]) -> list:
        rows, crc, fallback, digest, lossless = [], [], [], [], []
        for text in texts:
            ids = self.machine.encode(text)
            row = np.frombuffer(ids, dtype="<u4")
            back = self.machine.decode(ids)
            rows.append(row)
            crc.append(zlib.crc32(ids))
            fallback.append(int(self.is_byte[row].sum()))
            digest.append(hashlib.sha256(back.encode("utf-8")).hexdigest())
            lossless.append(back == text)
        return [[len(r) for r in rows], crc, fallback, digest, lossless, *([id_lists(rows)] if self.with_ids else [])]


def id_lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    values = np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


FIELDS = (
    ("n_pieces", T.LongType(), pa.int64()),
    ("pieces_crc32", T.LongType(), pa.int64()),
    ("n_byte_pieces", T.LongType(), pa.int64()),
    ("decoded_sha256", T.StringType(), pa.string()),
    ("lossless", T.BooleanType(), pa.bool_()),
)
IDS = (T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))
GROUP_BYTES = 1 << 20


def with_round_trip(df: DataFrame, model_path: str, text_col: str = "text", ids_into: str | None = None) -> DataFrame:
    """``df`` with n_pieces, pieces_crc32 (of the ids as unsigned 32-bit little-endian), n_byte_pieces, decoded_sha256 and lossless; with the ids themselves too if ``ids_into`` names a column."""
    fields = [*FIELDS, *([(ids_into, *IDS)] if ids_into else [])]
    return with_text_columns(df, lambda: Codec(model_path, bool(ids_into)), fields, text_col, GROUP_BYTES)


def with_ids(df: DataFrame, model_path: str, text_col: str = "text", into: str = "ids") -> DataFrame:
    """``df`` with the ids of each text (array<int>)."""

    def make():
        machine = compiled(model_path)
        return lambda texts: [id_lists([np.frombuffer(machine.encode(t), dtype="<u4") for t in texts])]

    return with_text_columns(df, make, [(into, *IDS)], text_col, GROUP_BYTES)


def with_decoded(df: DataFrame, model_path: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """``df`` with the text that each array of ids spells (null ids: empty)."""
    from pyspark.sql import functions as F

    def make():
        machine = compiled(model_path)
        return lambda rows: [[machine.decode(np.array([int(x) for x in r.split(",") if x], dtype="<u4").tobytes()) for r in rows]]

    names, joined = df.columns, "joined"
    while joined in (c.lower() for c in [*names, into]):
        joined += "_"
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    ids = F.col(f"c{position(names, ids_col)}").cast("array<string>")
    as_text = plain.withColumn(joined, F.array_join(ids, ",")).toDF(*names, joined)
    return with_text_columns(as_text, make, [(into, T.StringType(), pa.string())], joined).drop(joined)
