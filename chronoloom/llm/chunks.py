"""Texts cut into pieces at boundaries that no token spans, and values of distinct pieces, which are encoded in batches.

A boundary is safe where both parts, encoded on their own, give the ids of the
whole: for the word tokenizer at any white space (it is dropped), for the
byte-level one after any run of other characters (its pre-tokens hold white
space in front only, and look ahead by one character).  Special strings hold no
white space, so a piece keeps them whole and the library finds them there.

Only pieces that are new to a worker are encoded, many in a call.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import public_tokenizers
from tokenizers import Tokenizer

from chronoloom.llm.common import groups_by_bytes

#: White space to one of Python and the tokenizers only.
ODD_SPACE = re.compile("[\x1c-\x1f᠎]")
#: White space and what follows it, or white space at the end.
SPACED = re.compile(r"\s*\S+|\s+")
LONGEST = 48
#: Marks that are a pre-token of their own after letters.
MARKS = frozenset(".,!?;:")
#: Bytes of pieces in one call of the library.
CALL_BYTES = 1 << 18

# Byte-level alphabet: printable bytes stand for themselves, the others for characters from U+0100 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_ALPHABET = {b: b for b in PRINTABLE} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(PRINTABLE)))}
#: Pre-tokens of the byte-level tokenizer that can be told without its tables: letters, ASCII digits, ASCII marks without the apostrophe, a line break.
PLAIN = re.compile(r" ?[^\W\d_]+| ?[0-9]+| ?[!-&(-/:-@\[-`{-~]+|\n")
#: White space in front of a piece that PLAIN cuts as the tokenizer does.
PLAIN_FRONT = frozenset(["", " ", "\n", "\n ", "\n\n"])


def load(path: str) -> Tokenizer:
    """The tokenizer in ``path``, without truncation or padding; a bare file name is looked up among the public ones."""
    tokenizer = Tokenizer.from_file(path if "/" in path else public_tokenizers.path(path))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def in_calls(tokenizer: Tokenizer, pieces: list[str], value: Callable[[object], object]) -> list:
    """``value`` of the library's encoding of each piece, in batches balanced by bytes."""
    out = []
    for a, b in groups_by_bytes([len(p.encode("utf-8")) + 16 for p in pieces], CALL_BYTES):
        out += map(value, tokenizer.encode_batch_fast(pieces[a:b], add_special_tokens=False))
    return out


class Known(dict):
    """Values of pieces by ``encode`` (a list of pieces to a list of values); the newest ``most`` and those used since are held."""

    def __init__(self, encode: Callable[[list[str]], list], most: int = 250_000):
        super().__init__()
        self.encode, self.most = encode, most
        self.older: dict[str, object] = {}
        self.passing: list[str] = []

    def admit(self, wanted: Iterable[Iterable[str]]) -> None:
        """Makes the values of all pieces in ``wanted`` available until the next call."""
        for p in self.passing:
            self.pop(p, None)
        pieces = set().union(*wanted)
        missing = pieces.difference(self)
        if len(self) + len(missing) > self.most and len(self):
            self.older = dict(self)
            self.clear()
            missing = pieces
        if self.older:
            for p in missing.intersection(self.older):
                self[p] = self.older[p]
            missing = missing.difference(self)
        new = list(missing)
        self.update(zip(new, self.encode(new), strict=True))
        self.passing = [p for p in new if len(p) > LONGEST]


class Packed(dict):
    """Packed ids of pieces after ``lead`` (a space that is no part of the key, or nothing), made where they are first asked for."""

    def __init__(self, tokenizer: Tokenizer, pack: Callable[[list[int]], bytes], lead: str, most: int = 250_000):
        super().__init__()
        self.tokenizer, self.model, self.pack, self.lead, self.most = tokenizer, tokenizer.model, pack, lead, most
        self.mapped_lead = "".join(chr(BYTE_ALPHABET[b]) for b in lead.encode())
        self.older: dict[str, bytes] = {}
        #: Values without a lead.
        self.bare = self if not lead else Packed(tokenizer, pack, "", most)

    def __missing__(self, piece: str) -> bytes:
        got = self.older.get(piece)
        if got is None:
            got = self.made(piece)
        if len(piece) <= LONGEST:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[piece] = got
        return got

    def made(self, piece: str) -> bytes:
        if piece.isalpha():
            return self.word(piece)
        last = piece[-1:]
        if last in MARKS and piece[:-1].isalpha():
            return self[piece[:-1]] + self.bare[last]
        if self.lead and piece[:1] == "\n":  # a line break is no part of what follows
            return self.bare["\n"] + self.bare[piece[1:]] if len(piece) > 1 else self.bare[piece]
        whole = self.lead + piece
        front = whole[: len(whole) - len(whole.lstrip())]
        parts = PLAIN.findall(whole)
        certain = len(parts) > 1 and "".join(parts) == whole and "<|" not in whole and front in PLAIN_FRONT and len(front) < len(whole)
        if certain and all(x.isascii() or x.removeprefix(" ").isalpha() for x in parts):
            first = self[parts[0][1:]] if self.lead else self.bare[parts[0]]
            return b"".join([first, *map(self.bare.__getitem__, parts[1:])])
        return self.pack(self.tokenizer.encode_batch_fast([whole], add_special_tokens=False)[0].ids)

    def word(self, letters: str) -> bytes:
        """Letters are one pre-token, which goes straight to the library's model."""
        mapped = letters if letters.isascii() else letters.encode("utf-8").decode("latin-1").translate(BYTE_ALPHABET)
        return self.pack([t.id for t in self.model.tokenize(self.mapped_lead + mapped)])


class ByteLevelPieces:
    """Ids of texts, each text's as the sum (bytes joined) of its pieces' packed ids."""

    def __init__(self, tokenizer: Tokenizer, pack: Callable[[list[int]], bytes]):
        self.after = Packed(tokenizer, pack, " ")
        self.raw = self.after.bare

    def __call__(self, text: str) -> bytes:
        flat = text.replace("\n", " ")
        if flat.isprintable() and "  " not in flat:  # single spaces and line breaks are its only white space
            first, *rest = text.replace("\n", " \n").split(" ")
            return b"".join([self.raw[first] if first else b"", *map(self.after.__getitem__, rest)])
        return b"".join(map(self.raw.__getitem__, [text] if ODD_SPACE.search(text) else SPACED.findall(text)))


class WordCounts:
    """Numbers of tokens of texts for a tokenizer that drops white space: sums over the pieces between it."""

    def __init__(self, tokenizer: Tokenizer):
        self.known = Known(lambda pieces: in_calls(tokenizer, pieces, len))

    def __call__(self, texts: list[str]) -> list[int]:
        pieces = [[t] if ODD_SPACE.search(t) else t.split() for t in texts]
        self.known.admit(pieces)
        get = self.known.__getitem__
        return [sum(map(get, p)) for p in pieces]
