"""Secret scans with structural confirmation.

Three base kinds are found by pattern.  Further spans are reported only after
their content was decoded and parsed: every base64 run of 40 characters (in
either alphabet, also over several lines) and every hex run of 48 must hold a
private key in DER, whose nested lengths fit exactly down to the key of the
algorithm that is named, an OpenSSH key container with equal check numbers, or
a PEM text of one; signed tokens must have a JSON header that names an
algorithm, a JSON object as payload and a signature of that algorithm's length.
The search is linear in the text's length.

Edge cases: a null text counts as empty and has no spans; repeated rows are
scanned each on their own; an empty table gives an empty result; other columns
are passed on by :func:`scan`, and one named like a result column is replaced.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from chronoloom.llm.common import with_text_columns

# Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "pem", "key", "jwt")
# The base patterns.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
# Signature bytes by algorithm; RSA signatures have the length of the modulus.
SIGNATURE_BYTES = {"HS256": (32,), "HS384": (48,), "HS512": (64,), "ES256": (64,), "ES256K": (64,), "ES384": (96,), "ES512": (132,), "EdDSA": (64, 114)}
# Object identifiers of key algorithms in DER (RSA, RSA-PSS; EC; Ed25519, Ed448, X25519, X448 with their key lengths; DSA, DH) and of encryption schemes (PKCS 5, PKCS 12).
RSA_OIDS = frozenset(bytes.fromhex(x) for x in ("2a864886f70d010101", "2a864886f70d01010a"))
EC_OID = bytes.fromhex("2a8648ce3d0201")
RAW_KEY_BYTES = {bytes.fromhex("2b6570"): 32, bytes.fromhex("2b6571"): 57, bytes.fromhex("2b656e"): 32, bytes.fromhex("2b656f"): 56}
INTEGER_OIDS = frozenset(bytes.fromhex(x) for x in ("2a8648ce380401", "2a864886f70d010301"))
ENCRYPTION_ARCS = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))

BASE64_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}(?:\r?\n[A-Za-z0-9+/_-]+={0,2})*")
HEX_RUN = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{48,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])ey[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
LINE = re.compile(r"[^\r\n]+")
BEGIN, LABEL, MARK_END = "-----BEGIN ", "PRIVATE KEY-----", "-----END "
LABEL_WORDS = re.compile(r"[A-Z0-9 ]*\Z")
PEM_BODY = re.compile(r"[A-Za-z0-9+/=\s:,.-]*\Z")


def decode64(run: str) -> bytes | None:
    """Bytes of a base64 run in either alphabet, or None."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return None


def elements(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of consecutive DER elements that fill ``data`` exactly, or None."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, length = data[at], data[at + 1]
        at += 2
        if length & 0x80:
            wide = length & 0x7F
            if not 1 <= wide <= 4 or at + wide > len(data):
                return None
            length = int.from_bytes(data[at : at + wide], "big")
            if length < 0x80 or data[at] == 0:
                return None
            at += wide
        if at + length > len(data):
            return None
        out.append((tag, data[at : at + length]))
        at += length
    return out


def is_integer_list(data: bytes, least: int) -> bool:
    """A sequence that begins with ``least`` integers, the first of them 0 or 1 (an RSA or DSA key)."""
    top = elements(data)
    parts = elements(top[0][1]) if top and len(top) == 1 and top[0][0] == 0x30 else None
    return bool(parts) and len(parts) >= least and all(t == 0x02 and c for t, c in parts[:least]) and parts[0][1] in (b"\0", b"\1")


def is_ec_key(data: bytes) -> bool:
    top = elements(data)
    parts = elements(top[0][1]) if top and len(top) == 1 and top[0][0] == 0x30 else None
    return bool(parts) and len(parts) > 1 and parts[0] == (0x02, b"\1") and parts[1][0] == 0x04 and len(parts[1][1]) in (28, 32, 48, 66) and all(t in (0xA0, 0xA1) and elements(c) for t, c in parts[2:])


def holds_key_of(oid: bytes, octets: bytes) -> bool:
    """Whether an octet string is a key of the algorithm."""
    if oid in RSA_OIDS:
        return is_integer_list(octets, 9)
    if oid == EC_OID:
        return is_ec_key(octets)
    inner = elements(octets)
    if oid in RAW_KEY_BYTES:
        return bool(inner) and len(inner) == 1 and inner[0][0] == 0x04 and len(inner[0][1]) == RAW_KEY_BYTES[oid]
    return oid in INTEGER_OIDS and bool(inner) and len(inner) == 1 and inner[0][0] == 0x02 and len(inner[0][1]) > 0


def is_der_key(data: bytes) -> bool:
    """A private key: RSA or DSA integers, an EC key, or PKCS 8 (plain, parsed by its algorithm, or encrypted by whole blocks)."""
    top = elements(data) if data[:1] == b"\x30" else None
    if not top or len(top) != 1:
        return False
    parts = elements(top[0][1])
    if not parts:
        return False
    tags = [t for t, _ in parts]
    if tags == [0x30, 0x04]:
        scheme = elements(parts[0][1])
        return bool(scheme) and scheme[0][0] == 0x06 and scheme[0][1].startswith(ENCRYPTION_ARCS) and len(parts[1][1]) >= 16 and len(parts[1][1]) % 8 == 0
    if tags[:3] == [0x02, 0x30, 0x04] and parts[0][1] in (b"\0", b"\1") and all(t in (0xA0, 0x81, 0xA1) for t in tags[3:]):
        algorithm = elements(parts[1][1])
        return bool(algorithm) and algorithm[0][0] == 0x06 and holds_key_of(algorithm[0][1], parts[2][1])
    if len(parts) == 6:
        return is_integer_list(data, 6)
    return is_integer_list(data, 9) or is_ec_key(data)


def is_openssh_key(data: bytes) -> bool:
    """An OpenSSH container: cipher, derivation, public keys and the private part, which must start with equal check numbers if it isn't encrypted."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)

    def take() -> bytes | None:
        nonlocal at
        if at + 4 > len(data):
            return None
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return None
        at += 4 + n
        return data[at - n : at]

    cipher, derivation, options = take(), take(), take()
    if cipher is None or derivation is None or options is None or at + 4 > len(data):
        return False
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= keys <= 64 or not all(take() for _ in range(keys)):
        return False
    private = take()
    if not private or at != len(data):
        return False
    if cipher == b"none":
        return len(private) % 8 == 0 and len(private) >= 16 and private[:4] == private[4:8]
    return len(private) % 8 == 0


def is_key(data: bytes | None) -> bool:
    if data is None:
        return False
    if data[:1] == b"\x30":
        return is_der_key(data)
    if data.startswith(b"openssh-key-v1"):
        return is_openssh_key(data)
    return BEGIN.encode() in data and any(True for _ in pem_spans(data.decode("latin-1")))


def pem_spans(text: str):
    """(start, end) of PEM texts of private keys whose content parses; each marker is looked at once."""
    at = text.find(BEGIN)
    while at >= 0:
        following = text.find(BEGIN, at + 1)
        stop = following if following >= 0 else len(text)
        label = text.find(LABEL, at, stop)
        head = text[at + len(BEGIN) : label] if label >= 0 else "?"
        if label >= 0 and LABEL_WORDS.match(head):
            body_at, tail = label + len(LABEL), f"{MARK_END}{head}{LABEL}"
            end = text.find(tail, body_at, stop)
            body = text[body_at:end] if end >= 0 else "?"
            if PEM_BODY.match(body) and is_pem_body(body.strip()):
                yield at, end + len(tail)
        at = following


def is_pem_body(body: str) -> bool:
    if "DEK-Info:" in body:  # headers end with a blank line
        data = decode64(re.sub(r"\s+", "", re.split(r"\r?\n\r?\n", body, maxsplit=1)[-1]))
        return data is not None and len(data) >= 16 and len(data) % 8 == 0  # whole cipher blocks
    data = decode64(re.sub(r"\s+", "", body))
    return data is not None and (is_der_key(data) or is_openssh_key(data))


def base64_keys(text: str):
    """(start, end) of base64 runs that hold a key: a line, or lines of one length and a shorter one after them."""
    for m in BASE64_RUN.finditer(text):
        lines = [(x.start() + m.start(), x.end() + m.start()) for x in LINE.finditer(m[0])]
        i = 0
        while i < len(lines):
            start, end = lines[i]
            if end - start >= 40 and is_key(decode64(text[start:end])):
                yield start, end
            n = 1
            while i + n < len(lines) and lines[i + n][1] - lines[i + n][0] == end - start:
                n += 1
            for more in (n + 1, n):
                if i + more <= len(lines) and more > 1 and lines[i + more - 1][1] - lines[i + more - 1][0] <= end - start and is_key(decode64("".join(text[a:b] for a, b in lines[i : i + more]))):
                    yield start, lines[i + more - 1][1]
                    break
            for a, b in lines[i + 1 : i + n]:
                if b - a >= 40 and is_key(decode64(text[a:b])):
                    yield a, b
            i += n


def is_signed_token(run: str) -> bool:
    parts = [decode64(p) for p in run.split(".")]
    if len(parts) != 3 or any(p is None for p in parts):
        return False
    try:
        header, payload = (json.loads(p.decode("utf-8")) for p in parts[:2])
    except (ValueError, RecursionError):
        return False
    if not isinstance(header, dict) or not isinstance(payload, dict) or not isinstance(header.get("alg"), str):
        return False
    alg, n = header["alg"], len(parts[2])
    if alg.lower() == "none":
        return n == 0
    if alg[:2] in ("RS", "PS"):
        return n >= 128 and n % 64 == 0
    return n in SIGNATURE_BYTES.get(alg, ())


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """All spans as (start, end, kind), ends exclusive, by start, then kind as listed in KINDS."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if LABEL in text:
        out += [(a, b, "pem") for a, b in pem_spans(text)]
    out += [(a, b, "key") for a, b in base64_keys(text)]
    out += [(m.start(), m.end(), "key") for m in HEX_RUN.finditer(text) if len(m[0]) % 2 == 0 and is_key(bytes.fromhex(m[0]))]
    if "ey" in text:
        out += [(m.start(), m.end(), "jwt") for m in TOKEN.finditer(text) if is_signed_token(m[0])]
    return sorted(set(out), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


FIELDS = (
    ("n_assign", T.LongType(), pa.int64()),
    ("n_access", T.LongType(), pa.int64()),
    ("n_hex", T.LongType(), pa.int64()),
    ("base_sha256", T.StringType(), pa.string()),
    ("spans", T.StringType(), pa.string()),
)


def scan(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with counts of base spans, their digest, and all spans."""

    def make():
        def compute(texts: list[str]) -> list[list]:
            rows = []
            for text in texts:
                spans = find_spans(text)
                base = [s for s in spans if s[2] in KINDS[:3]]
                count = {k: sum(s[2] == k for s in base) for k in KINDS[:3]}
                rows.append((count["assign"], count["access"], count["hex"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            return [list(c) for c in zip(*rows, strict=True)]

        return compute

    return with_text_columns(df, make, FIELDS, text_col)


def masked(text: str, mark: str) -> str:
    """``text`` with each maximal run of spans replaced by ``mark``."""
    out, at, end = [], 0, -1
    for a, b, _ in find_spans(text):
        if a > end:
            if end >= 0:
                at = end
            out += [text[at:a], mark]
            end = b
        end = max(end, b)
        at = end
    return "".join(out) + text[at:] if end >= 0 else text


def mask(df: DataFrame, text_col: str = "text", into: str = "text", mark: str = "[secret]") -> DataFrame:
    """``df`` with every secret in its texts replaced by ``mark``; null texts become empty."""
    return with_text_columns(df, lambda: lambda texts: [[masked(t, mark) for t in texts]], [(into, T.StringType(), pa.string())], text_col)
