"""Secret scans with structural confirmation.

Three base kinds are taken as their patterns say: ``assign`` (a value given to a password, token, secret
or API key), ``access`` (AKIA access key ids) and ``hex`` (long lower-case hex runs).

Beside them, runs of base64, base64url or hex digits and PEM blocks are only candidates. Each is decoded,
and it is reported only if what it decodes to parses, to the last byte, as one of

* ``pem``: a PEM block with a private-key label whose body parses as that label's encoding (or, for
  the old encrypted form, whose DEK-Info line names a cipher with an IV and whole blocks that fit it);
* ``key``: a private key in DER, that is PKCS#1 RSA, SEC1 EC, DSA, PKCS#8 plain or encrypted, or an
  openssh-key-v1 blob. Every nested length must be minimal, stay within its parent and use it up, and
  the fields must be those of the key (versions, curve or algorithm identifiers, an RSA modulus that is
  the product of its primes, matching check numbers and padding in an OpenSSH key);
* ``jwt``: a signed compact token, three base64url parts whose header is a JSON object with a known
  signing ``alg``, whose payload is a JSON object, and whose signature has a length of that ``alg``;
* ``nested``: base64 or hex of a text (to ``depth`` layers) that itself holds one of these or an access
  key id.

Public keys, certificates, hashes, identifiers and unsigned tokens decode to something else and stay
out. A key written over several lines of base64 outside of PEM armour is no candidate.

A document is one row, worked on where it is read: no shuffle, no state between rows. Patterns have
no nested repeats, so time is linear in the text; lengths are read before anything is copied.

Edge cases: null or empty text has no findings; very long texts are read whole; equal and
overlapping findings of different kinds are all kept (one per kind and place); null ids and repeated
rows each keep their row; other columns pass through, and ``findings`` gets a free name when that
is taken; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajens.llm.common import free_name, table

BASE_KINDS = ("assign", "access", "hex")
#: all kinds in the order that breaks ties between findings that start at one place
KINDS = (*BASE_KINDS, "pem", "key", "jwt", "nested")

#: base kind -> pattern, group whose length counts, least length
_BASE = {
    "assign": (re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}
_HEX_RUN = re.compile(r"[0-9a-f]{24,}")
_PEM = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{0,60})-----")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
#: where a DER sequence may begin behind a separator inside a run (0x30 and a length)
_DER_START = re.compile(r"(?<=[/+_-])M[A-P]")
_HEX_ANY = re.compile(r"(?:[0-9a-f]{2})+|(?:[0-9A-F]{2})+")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+|e30)\.([A-Za-z0-9_-]+)(?![A-Za-z0-9_.-])")
#: fixed values: signature bytes of the JOSE algorithms; RSA signatures are as long as their key
_SIGNATURES = {"HS256": (32,), "HS384": (48,), "HS512": (64,), "ES256": (64,), "ES256K": (64,), "ES384": (96,),
               "ES512": (132,), "EdDSA": (64, 114)} | {f"{x}{n}": (128, 256, 384, 512, 1024) for x in ("RS", "PS") for n in (256, 384, 512)}
#: fixed values: block bytes of the ciphers of the old PEM encryption
_PEM_BLOCKS = {"DES-CBC": 8, "DES-EDE3-CBC": 8, "AES-128-CBC": 16, "AES-192-CBC": 16, "AES-256-CBC": 16}


class Malformed(ValueError):
    """The bytes aren't what they were taken for."""


def need(ok) -> None:
    if not ok:
        raise Malformed


# --- decoding ------------------------------------------------------------------------------------

def unbase64(s: str) -> bytes:
    """Standard or URL alphabet (not both), padding whole or left out."""
    need(not ("-" in s or "_" in s) or not ("+" in s or "/" in s))
    body = s.rstrip("=").replace("-", "+").replace("_", "/")
    need(len(body) % 4 != 1 and (len(body) == len(s) or len(s) % 4 == 0))
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except binascii.Error as e:
        raise Malformed from e


def unhex(s: str) -> bytes:
    need(_HEX_ANY.fullmatch(s))
    return bytes.fromhex(s)


# --- DER: tag, minimal length, content within its parent -----------------------------------------

def elements(b: bytes) -> list[tuple[int, bytes]]:
    """(tag, content) of the elements that fill ``b`` exactly."""
    out, at = [], 0
    while at < len(b):
        need(at + 2 <= len(b) and b[at] & 31 != 31)
        tag, n, at = b[at], b[at + 1], at + 2
        if n & 128:
            size = n & 127
            need(1 <= size <= 4 and at + size <= len(b) and b[at])
            n, at = int.from_bytes(b[at:at + size], "big"), at + size
            need(n >= 128)
        need(at + n <= len(b))
        out.append((tag, b[at:at + n]))
        at += n
    return out


def only(b: bytes, tag: int) -> bytes:
    got = elements(b)
    need(len(got) == 1 and got[0][0] == tag)
    return got[0][1]


def number(e: tuple[int, bytes]) -> int:
    tag, c = e
    need(tag == 2 and c and (len(c) == 1 or c[0] or c[1] & 128))
    return int.from_bytes(c, "big", signed=True)


def rsa_key(parts) -> str:
    need(len(parts) == 9)
    version, n, e, d, p, q, *_ = map(number, parts)
    need(version == 0 and p > 1 and q > 1 and n == p * q and e > 1 and d > 1)
    return f"RSA {n.bit_length()}"


def dsa_key(parts) -> str:
    need(len(parts) == 6)
    version, p, q, g, y, x = map(number, parts)
    need(version == 0 and q > 1 and (p - 1) % q == 0 and 0 < x < q and pow(g, x, p) == y)
    return f"DSA {p.bit_length()}"


def ec_key(parts, named: bool = False) -> str:
    """SEC1: version 1, secret number, optional curve [0] and public point [1]. The curve may be
    left out only where the wrapping names it."""
    need(2 <= len(parts) <= 4 and number(parts[0]) == 1 and parts[1][0] == 4 and 16 <= len(parts[1][1]) <= 72)
    tags = [t for t, _ in parts[2:]]
    need(tags in ([], [0xA0], [0xA1], [0xA0, 0xA1]) and (named or 0xA0 in tags))
    for tag, c in parts[2:]:
        if tag == 0xA0:
            need(elements(c)[0][0] in (6, 0x30) and len(elements(c)) == 1)
        else:
            point = only(c, 3)
            need(len(point) > 2 and point[:2] in (b"\0\2", b"\0\3", b"\0\4"))
    return f"EC {8 * len(parts[1][1])}"


_RSA, _DSA, _EC = (bytes.fromhex(x) for x in ("2a864886f70d010101", "2a8648ce380401", "2a8648ce3d0201"))
#: fixed values: 1.3.101.110 to 113 (X25519, X448, Ed25519, Ed448) and the bytes of their keys
_EDWARDS = {bytes([0x2B, 0x65, 0x6E + i]): n for i, n in enumerate((32, 56, 32, 57))}


def pkcs8_key(parts) -> str:
    need(3 <= len(parts) <= 5 and number(parts[0]) in (0, 1) and parts[1][0] == 0x30 and parts[2][0] == 4)
    need(all(t in (0xA0, 0x81, 0xA1) for t, _ in parts[3:]))
    alg, inner = elements(parts[1][1]), parts[2][1]
    need(alg and alg[0][0] == 6)
    oid = alg[0][1]
    if oid == _RSA:
        return rsa_key(elements(only(inner, 0x30)))
    if oid == _EC:
        return ec_key(elements(only(inner, 0x30)), named=len(alg) == 2)
    if oid == _DSA:
        number(elements(inner)[0])
        need(len(elements(inner)) == 1)
        return "DSA"
    need(oid in _EDWARDS and len(only(inner, 4)) == _EDWARDS[oid])
    return "Edwards"


def encrypted_key(parts) -> str:
    """EncryptedPrivateKeyInfo: password-based (PKCS#5 or PKCS#12) algorithm, then whole cipher bytes."""
    need(len(parts) == 2 and parts[0][0] == 0x30 and parts[1][0] == 4 and len(parts[1][1]) >= 32 and len(parts[1][1]) % 8 == 0)
    alg = elements(parts[0][1])
    need(len(alg) == 2 and alg[0][0] == 6 and alg[0][1].startswith(bytes.fromhex("2a864886f70d01")) and alg[1][0] == 0x30)
    need(alg[0][1][7] in (5, 12) and len(elements(alg[1][1])) == 2)
    return "encrypted"


def der_key(b: bytes, forms=(rsa_key, ec_key, dsa_key, pkcs8_key, encrypted_key)) -> str:
    need(len(b) >= 32 and b[0] == 0x30)
    parts = elements(only(b, 0x30))
    for form in forms:
        try:
            return form(parts)
        except (Malformed, IndexError):
            continue
    raise Malformed


# --- OpenSSH -------------------------------------------------------------------------------------

_MAGIC = b"openssh-key-v1\0"
#: fixed values: byte strings of a private key behind its kind
_FIELDS = {b"ssh-ed25519": 2, b"ssh-rsa": 6, b"ssh-dss": 5}


def strings(b: bytes, n: int) -> tuple[list[bytes], bytes]:
    """``n`` byte strings, each behind its 4-byte length, and what follows."""
    out = []
    for _ in range(n):
        need(len(b) >= 4)
        size = int.from_bytes(b[:4], "big")
        need(4 + size <= len(b))
        out.append(b[4:4 + size])
        b = b[4 + size:]
    return out, b


def openssh_key(b: bytes) -> str:
    need(b.startswith(_MAGIC))
    (cipher, kdf, options), rest = strings(b[len(_MAGIC):], 3)
    need(len(rest) >= 4)
    keys = int.from_bytes(rest[:4], "big")
    need(1 <= keys <= 16)
    public, rest = strings(rest[4:], keys)
    (private,), rest = strings(rest, 1)
    (kind,), _ = strings(public[0], 1)
    need(kind.isascii() and kind.decode().isprintable() and kind)
    if cipher != b"none":  # some ciphers put a tag of 16 bytes behind
        need(kdf == b"bcrypt" and len(strings(options, 1)[1]) == 4 and len(private) % 8 == 0 and len(rest) in (0, 16))
        return f"{kind.decode()} encrypted"
    need(kdf == b"none" and not options and not rest and len(private) >= 16 and len(private) % 8 == 0 and private[:4] == private[4:8])
    rest = private[8:]
    for _ in range(keys):
        (own,), rest = strings(rest, 1)
        need(own == kind or keys > 1)
        fields = 3 if own.startswith(b"ecdsa-sha2-") else _FIELDS.get(own)
        if fields is None:  # a hardware-backed or future kind: its fields aren't known here
            return kind.decode()
        rest = strings(rest, fields + 1)[1]  # and the comment
    need(len(rest) < 16 and rest == bytes(range(1, len(rest) + 1)))
    return kind.decode()


# --- candidates ----------------------------------------------------------------------------------

def private_key(b: bytes) -> str:
    return openssh_key(b) if b.startswith(_MAGIC) else der_key(b)


_LABELS = {"RSA PRIVATE KEY": (rsa_key,), "EC PRIVATE KEY": (ec_key,), "DSA PRIVATE KEY": (dsa_key,),
           "PRIVATE KEY": (pkcs8_key,), "ENCRYPTED PRIVATE KEY": (encrypted_key,)}


def pem_block(label: str, body: str) -> str:
    """What the lines between the label lines hold; line ends may be written as \\n."""
    body = body.replace("\\n", "\n").replace("\\r", "").replace("\r", "")
    head, _, body = body.partition("\n\n") if ":" in body else ("", "", body)
    raw = unbase64("".join(body.split()))
    if "DEK-Info" in head:
        m = re.search(r"DEK-Info: ([A-Z0-9-]+),([0-9A-Fa-f]+)", head)
        need(m and label in _LABELS and m[1] in _PEM_BLOCKS and len(m[2]) == 2 * _PEM_BLOCKS[m[1]])
        need(raw and len(raw) % _PEM_BLOCKS[m[1]] == 0)
        return f"{label} {m[1]}"
    if label == "OPENSSH PRIVATE KEY":
        return openssh_key(raw)
    need(label in _LABELS)
    return der_key(raw, _LABELS[label])


def pem_blocks(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, label, body) of each BEGIN line of a private key whose next label line is its END."""
    begin = None
    for m in _PEM.finditer(text) if "PRIVATE KEY-----" in text else ():
        if begin and m[1] == "END" and m[2] == begin[2]:
            yield begin.start(), m.end(), m[2], text[begin.end():m.start()]
        begin = m if m[1] == "BEGIN" and m[2].endswith("PRIVATE KEY") else None


def behind_separator(run: str) -> Iterator[int]:
    """Places in a base64 run from which a DER sequence of just the remaining length may begin."""
    body = run.rstrip("=")
    for m in _DER_START.finditer(body):
        b = tried(unbase64, body[m.start():m.start() + 8])
        if not b or len(b) < 6:
            continue
        size = b[1] & 127 if b[1] & 128 else 0
        length = 2 + size + (int.from_bytes(b[2:2 + size], "big") if size else b[1])
        if size <= 4 and length == (len(body) - m.start()) * 3 // 4:
            yield m.start()


def json_object(part: str) -> dict:
    try:
        got = json.loads(unbase64(part).decode())
    except (UnicodeDecodeError, json.JSONDecodeError, RecursionError) as e:
        raise Malformed from e
    need(isinstance(got, dict))
    return got


def signed_token(header: str, payload: str, signature: str) -> str:
    need("=" not in header + payload + signature)
    alg = json_object(header).get("alg")
    need(isinstance(alg, str) and alg in _SIGNATURES)
    json_object(payload)
    need(len(unbase64(signature)) in _SIGNATURES[alg])
    return alg


def tried(act, *args) -> str | None:
    try:
        return act(*args)
    except (Malformed, IndexError):
        return None


def readable(b: bytes) -> str:
    """The bytes as text, or Malformed if they are no text."""
    need(len(b) >= 16 and b.count(0) == 0)
    try:
        return b.decode()
    except UnicodeDecodeError as e:
        raise Malformed from e


def hidden(b: bytes, depth: int) -> str | None:
    """What a decoded text holds, or None."""
    text = tried(readable, b)
    if text is None:
        return None
    for m in _BASE["access"][0].finditer(text):
        if len(m[0]) >= 20:
            return "access"
    inner = min(confirmed(text, depth), default=None)
    return f"{inner[2]}: {inner[3]}" if inner else None


def confirmed(text: str, depth: int = 1) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, what it is) of the candidates that their structure confirms."""
    out, blocks = [], []
    for start, end, label, body in pem_blocks(text):
        blocks.append((start, end))
        what = tried(pem_block, label, body)
        if what is not None:
            out.append((start, end, "pem", what))
    tokens = []
    for m in _TOKEN.finditer(text) if "eyJ" in text else ():
        what = tried(signed_token, *m.groups())
        if what is not None:
            tokens.append(m.span())
            out.append((*m.span(), "jwt", what))
    taken, at = sorted(blocks + tokens), 0
    for m in _RUN.finditer(text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if at < len(taken) and taken[at][0] < m.end():
            continue  # part of a block or token that has been judged
        run = m[0].rstrip("=")
        is_hex = bool(_HEX_ANY.fullmatch(run))
        start, end = m.start(), m.start() + len(run) if is_hex else m.end()
        b = tried(unhex, run) if is_hex else tried(unbase64, m[0])
        what = tried(private_key, b) if b else None
        if what is None and not is_hex:
            for k in behind_separator(m[0]):
                if (what := tried(lambda: private_key(unbase64(m[0][k:])))) is not None:
                    start += k
                    break
        if what is not None:
            out.append((start, end, "key", what))
        elif b and depth > 0 and (inner := hidden(b, depth - 1)) is not None:
            out.append((start, end, "nested", inner))
    return out


def base_findings(text: str) -> list[tuple[int, int, str, str]]:
    out = []
    for kind, (pattern, group, least) in _BASE.items():
        # shorter hex runs fail anyway: skipping them early changes nothing
        for m in (_HEX_RUN if kind == "hex" else pattern).finditer(text):
            if len(m[group]) >= least:
                out.append((*m.span(), kind, ""))
    return out


def findings(text: str | None, depth: int = 2) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, what it is) in code points, end exclusive, by start, then kind."""
    if not text:
        return []
    return sorted(base_findings(text) + confirmed(text, depth), key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


_FINDINGS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                                      T.StructField("kind", T.StringType()), T.StructField("what", T.StringType())]))


def scan(docs: DataFrame, text_col: str = "text", depth: int = 2) -> DataFrame:
    """``docs`` with ``findings``: an array of (start, end, kind, what), by start, then kind."""
    at = docs.columns.index(text_col)
    name = free_name(docs, "findings")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, _FINDINGS)])
    found_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("what", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[dict(zip(("start", "end", "kind", "what"), x)) for x in findings(t.as_py(), depth)] for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, found_type)], names=schema.names)

    return docs.mapInArrow(run, schema)


def op13_secrets(spark, sf_dir: str) -> DataFrame:
    """All documents: base findings counted and digested, and the spans of all kinds."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")

    def spans(of) -> Column:
        return F.array_join(F.transform(of, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("findings", lambda x: x["kind"].isin(*BASE_KINDS))
    counts, own = [count(k) for k in KINDS], len(BASE_KINDS)
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), *counts[:own], F.sha2(spans(base), 256).alias("base_sha256"),
                        spans("findings").alias("spans"), *counts[own:])
