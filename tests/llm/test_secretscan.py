import base64
import hashlib
import json
import random
import re
import struct

import duckdb
import pytest

from trajens.llm import secretscan as S

P = 2 ** 521 - 1  # primes
Q = 2 ** 607 - 1


# --- encoders of the tests' own --------------------------------------------------------------------

def tlv(tag, c):
    n = len(c)
    size = bytes([n]) if n < 128 else bytes([128 + (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + c


def integer(x):
    return tlv(2, x.to_bytes(x.bit_length() // 8 + 1, "big"))


def seq(*parts):
    return tlv(0x30, b"".join(parts))


def rsa(p=P, q=Q, n=None):
    e = 65537
    d = pow(e, -1, (p - 1) * (q - 1))
    return seq(*map(integer, (0, n or p * q, e, d, p, q, d % (p - 1), d % (q - 1), pow(q, -1, p))))


def oid(h):
    return tlv(6, bytes.fromhex(h))


P256 = oid("2a8648ce3d030107")
EC = seq(integer(1), tlv(4, bytes(range(32))), tlv(0xA0, P256), tlv(0xA1, tlv(3, b"\0\4" + bytes(range(64)))))
BARE_EC = seq(integer(1), tlv(4, bytes(range(32))))
PK8_RSA = seq(integer(0), seq(oid("2a864886f70d010101"), tlv(5, b"")), tlv(4, rsa()))
PK8_EC = seq(integer(0), seq(oid("2a8648ce3d0201"), P256), tlv(4, BARE_EC))
PK8_ED = seq(integer(0), seq(oid("2b6570")), tlv(4, tlv(4, bytes(range(32)))))
ENCRYPTED = seq(seq(oid("2a864886f70d01050d"), seq(seq(), seq())), tlv(4, bytes(64)))
DSA = seq(*map(integer, (0, 23, 11, 4, pow(4, 7, 23), 7))) + b""
PUBLIC = seq(seq(oid("2a864886f70d010101"), tlv(5, b"")), tlv(3, b"\0" + seq(integer(P * Q), integer(65537))))


def ssh(check=(5, 5), count_up=True, cipher=b"none"):
    s = lambda b: struct.pack(">I", len(b)) + b
    public = s(b"ssh-ed25519") + s(bytes(32))
    private = struct.pack(">II", *check) + public + s(bytes(64)) + s(b"me@home")
    k = -len(private) % 8
    assert k
    private += bytes(range(1, k + 1)) if count_up else bytes(k)
    kdf, options = (b"none", b"") if cipher == b"none" else (b"bcrypt", s(bytes(16)) + struct.pack(">I", 16))
    return b"openssh-key-v1\0" + s(cipher) + s(kdf) + s(options) + struct.pack(">I", 1) + s(public) + s(private)


def b64(b, url=False, pad=True):
    t = (base64.urlsafe_b64encode if url else base64.b64encode)(b).decode()
    return t if pad else t.rstrip("=")


def pem(label, b, head="", line="\n"):
    t = b64(b)
    return line.join([f"-----BEGIN {label}-----", *([head] if head else []), *[t[i:i + 64] for i in range(0, len(t), 64)], f"-----END {label}-----"])


def jwt(alg="HS256", size=32, payload=b'{"sub":"1"}', header=None):
    return ".".join(b64(x, True, False) for x in (header or json.dumps({"alg": alg, "typ": "JWT"}).encode(), payload, bytes(range(size))))


def confirmed(text, **kw):
    return [(text[s:e], k) for s, e, k, _ in S.findings(text, **kw) if k not in S.BASE_KINDS]


KEYS = [rsa(), EC, PK8_RSA, PK8_EC, PK8_ED, ENCRYPTED, ssh(), ssh(cipher=b"aes256-ctr")]


@pytest.mark.parametrize("key", KEYS)
def test_bare_keys(key):
    for form in (b64(key), b64(key, pad=False), b64(key, True), key.hex(), key.hex().upper()):
        for before, after in (("", ""), ("my key: ", " ok"), ('{"k":"', '"}')):
            assert confirmed(before + form + after) == [(form, "key")]
    # one bit less, one byte more, a byte cut off: no longer that structure
    for broken in (key + b"\0", key[:-1], bytes([key[0] ^ 1]) + key[1:]):
        assert confirmed(b64(broken)) == [] and confirmed(broken.hex()) == []
    if key[0] == 0x30:
        form = b64(key)
        assert confirmed("see /srv/keys/" + form) == [(form, "key")]


def test_fields_must_fit():
    assert confirmed(b64(rsa(n=P * Q + 2))) == []
    assert confirmed(b64(ssh(check=(5, 6)))) == [] and confirmed(b64(ssh(count_up=False))) == []
    assert confirmed(b64(BARE_EC + b"")) == []  # no curve named
    assert confirmed(b64(PUBLIC)) == [] and confirmed(b64(hashlib.sha512(b"x").digest())) == []
    long_form = bytes([0x30, 0x82, 0, len(PK8_ED) - 2]) + PK8_ED[2:]  # length not minimal
    assert confirmed(b64(long_form)) == []
    assert S.dsa_key(S.elements(S.only(DSA, 0x30))) == "DSA 5"


def test_pem_blocks():
    good = [pem("RSA PRIVATE KEY", rsa()), pem("EC PRIVATE KEY", EC), pem("PRIVATE KEY", PK8_EC), pem("OPENSSH PRIVATE KEY", ssh()),
            pem("ENCRYPTED PRIVATE KEY", ENCRYPTED), pem("PRIVATE KEY", PK8_RSA, line="\r\n"), pem("PRIVATE KEY", PK8_ED, line="\\n"),
            pem("RSA PRIVATE KEY", bytes(160), "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC," + "0F" * 16 + "\n")]
    for g in good:
        assert confirmed(f"x {g} y") == [(g, "pem")], g[:40]
    bad = [pem("RSA PRIVATE KEY", PK8_RSA), pem("PRIVATE KEY", bytes(200)), pem("PUBLIC KEY", PUBLIC), good[0].replace("END RSA", "END EC"),
           pem("RSA PRIVATE KEY", bytes(159), "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC," + "0F" * 16 + "\n"),
           "-----BEGIN PRIVATE KEY-----\nyour key here\n-----END PRIVATE KEY-----", good[1][:-5]]
    for b in bad[:-1]:
        assert confirmed(b) == [], b[:60]
    assert [k for _, k in confirmed(bad[-1] + "\n" + good[2])] == ["pem"] or "key" in [k for _, k in confirmed(bad[-1])]


def test_tokens():
    for alg, sizes in S._SIGNATURES.items():
        t = jwt(alg, sizes[0])
        assert confirmed(f"Bearer {t}, next") == [(t, "jwt")]
        assert confirmed(jwt(alg, sizes[0] + 3)) == []
    for t in (jwt("none", 0) + "x", jwt("HS999"), jwt(payload=b"[1]"), jwt(header=b'{"typ":"JWT"}'), jwt(header=b'{"alg":7}'),
              jwt() + "." + "a" * 8, jwt(header=b'{"alg":"HS256"')):
        assert confirmed(t) == []


def test_nested():
    inner = pem("EC PRIVATE KEY", EC)
    once = b64(inner.encode())
    twice = b64(("data: " + once).encode())
    assert confirmed(once) == [(once, "nested")] and confirmed(twice) == [(twice, "nested")]
    assert confirmed(twice, depth=1) == [] and confirmed(once, depth=0) == []
    for text in ("id = AKIA" + "Q7" * 8, "token " + jwt()):
        h = (text + " and some more").encode().hex()
        assert confirmed(h) == [(h, "nested")]
    assert confirmed(b64(b"just a plain sentence of no importance at all")) == []


# --- the base kinds, from the contract --------------------------------------------------------------

def base(text):
    t, out = text or "", []
    for m in re.finditer(r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
                         r"|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t):
        if len(m[1]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 24]
    return sorted(out)


def expected(doc_id, text):
    got = base(text)
    n = [sum(k == i for _, k, _ in got) for i in range(3)]
    line = ",".join(f"{S.BASE_KINDS[k]}:{s}:{e}" for s, k, e in got)
    return (doc_id, *n, hashlib.sha256(line.encode()).hexdigest())


#: base kinds by splitting at the pattern and adding up lengths
SQL = r"""
WITH k AS (SELECT * FROM (VALUES (0, 'assign', 6,
  '(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
  (1, 'access', 20, '(AKIA[A-Z0-9]+)'), (2, 'hex', 24, '([0-9a-f]+)')) AS k(i, kind, least, pattern)),
m AS (SELECT doc_id, i, kind, least, regexp_extract_all(t, pattern) AS whole, regexp_extract_all(t, pattern, 1) AS part,
        string_split_regex(t, pattern) AS gaps FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents), k),
s AS (SELECT doc_id, i, kind, least, unnest(range(1, len(whole) + 1)) AS n, whole, part, gaps FROM m),
f AS (SELECT doc_id, i, kind, coalesce(list_sum(list_transform(gaps[1:n], lambda x: length(x))), 0)
        + coalesce(list_sum(list_transform(whole[1:n - 1], lambda x: length(x))), 0) AS start, length(whole[n]) AS len
      FROM s WHERE length(part[n]) >= least)
SELECT d.doc_id, count(*) FILTER (i = 0), count(*) FILTER (i = 1), count(*) FILTER (i = 2),
       sha256(coalesce(string_agg(concat(kind, ':', CAST(start AS BIGINT), ':', CAST(start + len AS BIGINT)), ',' ORDER BY start, i) FILTER (i IS NOT NULL), ''))
FROM documents d LEFT JOIN f ON d.doc_id = f.doc_id GROUP BY d.doc_id
"""


def texts():
    rng = random.Random(2)
    bits = ["password", "Passwd", "SECRET", "token", "api_key", "ApiKey", "toKen", "ſecret", "AKIA", "akia", "ABCDEFGHIJKLMNOPQRST",
            "0123456789abcdef", "deadbeef", "=", ":", " ", "  ", '"', "'", "abc", "x.y-z_", "\n", "\t", "é", "\U0001f511", "F" * 9]
    out = ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(700)]
    return out + ["password = " + b64(rsa()), jwt(), 'secret: "' + jwt() + '"', "token=" * 9, "a" * 23, "a" * 24, "AKIA" + "Z" * 15, "AKIA" + "Z" * 16]


def test_base_is_the_contract(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(texts())] + [(9001, ""), (9002, None), (9003, ("lorem ipsum " * 20_000) + "token = " + "f0" * 20)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = S.op13_secrets(spark, str(tmp_path))
    have = sorted(tuple(r)[:5] for r in got.collect())
    assert have == sorted(expected(*r) for r in rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(con.sql(SQL).fetchall()) == have
    by = {r.doc_id: r for r in got.collect()}
    for i, t in rows:  # all base spans are among the spans; every span lies in its text
        spans = [x.split(":") for x in by[i].spans.split(",") if x]
        assert [(int(s), S.BASE_KINDS.index(k), int(e)) for k, s, e in spans if k in S.BASE_KINDS] == base(t)
        assert all(0 <= int(s) < int(e) <= len(t) for _, s, e in spans) and [int(x[1]) for x in spans] == sorted(int(x[1]) for x in spans)


def test_operator_edge_cases(spark):
    rows = [(None, "token=abcdef", "a"), (1, "token=abcdef", "b"), (1, "token=abcdef", "b"), (2, None, "c"), (3, "\U0001f511 " + jwt(), "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, Findings string")
    got = S.scan(df)
    assert got.columns == ["doc_id", "text", "Findings", "_findings"]
    out = {r.Findings: r._findings for r in got.collect()}
    assert [tuple(x) for x in out["a"]] == [(0, 12, "assign", "")] == [tuple(x) for x in out["b"]] and out["c"] == []
    assert [tuple(x) for x in out["d"]] == [(2, 2 + len(jwt()), "jwt", "HS256")]
    assert got.count() == 5 and S.scan(df.limit(0)).count() == 0


def test_linear_on_hostile_texts():
    import time
    hostile = ["-----BEGIN PRIVATE KEY-----\n", "eyJ" * 3, "eyJh.eyJh.", "token ", "M" + "A" * 50 + "/", "a-", "0f", "/MA", "api_key :   "]
    for h in hostile:
        took = []
        for n in (40_000, 160_000):
            t = (h * (n // len(h)))
            t0 = time.process_time()
            S.findings(t)
            took.append(time.process_time() - t0)
        assert took[1] < 0.5 or took[1] < 9 * took[0], (h, took)
