"""Format-preserving pseudonyms for personal data.

Detectors find candidates; validators keep those that are what they look like (Luhn, mod 97,
calendar, octet and area ranges). A validated value is a list of positions, each with its own
alphabet, and so a number below the product of the alphabet sizes. A keyed permutation of that range gives
the pseudonym, written back in the same positions: same length, same punctuation, check digits
recomputed. The same value gives the same pseudonym in every document and every spelling
(separators and the script of the digits are not part of the value), so links between documents stay; without the key nothing
leads back.

Permutation: E is a balanced Feistel network over [0, a*b), a*b >= n, with keyed BLAKE2b round
functions, walked until it lands below n. The pseudonym is E^-1(E(x) + s mod n) with a keyed shift
s != 0 mod n, a bijection without fixed points: no value stays as it was (if n > 1).

Kinds: email (local part and host labels before the last two), phone (+country, +1 with ten digits
in any grouping, or ten digits grouped as in North America; area codes and exchanges that begin with
0 or 1 stay among such), card (first digit kept), iban (country kept), ssn, ip (IPv4 but 127.0.0.1;
unicast stays unicast), date (1900-2099 in digits or with an English month name, same calendar
day in any of the formats gives the same day; its length may change with a month name or a number
without leading zero), secret (access keys, and values after password,
token, secret or api key; per character class, hex stays hex).

Edge cases: null text stays null with no findings; empty and very long texts are read whole; where
findings overlap, secrets and emails come first, then IBANs and cards of a usual form, then the
earlier, then the longer; a match that is not valid is tried again without its last groups, and
from its later ones; repeated rows and null ids keep
their rows; all columns pass through, and count columns get a free name when theirs is taken; an
empty table gives an empty result.

The key has no default: :func:`configured_key` takes it from the session, or draws one that nobody keeps.
"""

from __future__ import annotations

import calendar
import datetime as dt
import hashlib
import re
import secrets
import unicodedata
from collections.abc import Iterator
from math import isqrt, prod

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajens.llm.common import free_name, slices, table

KINDS = ("email", "phone", "card", "iban", "ssn", "ip", "date", "secret")
DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
UPPER, HEX = LOWER.upper(), DIGITS + "abcdef"
#: session setting with the key in hex (Spark redacts settings with "secret" in their name in its logs)
KEY_SETTING = "spark.trajens.pseudonym.secret"


class Permutation:
    """Keyed permutation of [0, n) without fixed points."""

    rounds = 8

    def __init__(self, key: bytes, label: str, n: int):
        self.n, self.a = n, isqrt(max(n - 1, 0)) + 1
        self.key = hashlib.blake2b(f"{label}:{n}".encode(), key=key[:64], digest_size=32).digest()
        self.width = (self.a.bit_length() + 7) // 8 + 8
        self.shift = 1 + self._f(255, n) % (n - 1) if n > 1 else 0

    def _f(self, i: int, x: int) -> int:
        out, block = b"", 0
        data = bytes([i]) + x.to_bytes((x.bit_length() + 7) // 8 or 1, "big")
        while len(out) < self.width:
            out += hashlib.blake2b(data + bytes([block]), key=self.key, digest_size=64).digest()
            block += 1
        return int.from_bytes(out[:self.width], "big")

    def _walk(self, x: int, forward: bool) -> int:
        a = self.a
        while True:
            left, right = divmod(x, a)
            for i in range(self.rounds) if forward else reversed(range(self.rounds)):
                if forward:
                    left, right = right, (left + self._f(i, right)) % a
                else:
                    left, right = (right - self._f(i, left)) % a, left
            x = left * a + right
            if x < self.n:
                return x

    def __call__(self, x: int) -> int:
        if self.n < 2:
            return x
        return self._walk((self._walk(x, True) + self.shift) % self.n, False)


def permuted(key: bytes, label: str, text: str, alphabets: list[str]) -> str:
    """``text`` with character i permuted within ``alphabets[i]``, all positions together."""
    sizes = [len(a) for a in alphabets]
    x = 0
    for c, a in zip(text, alphabets):
        x = x * len(a) + a.index(c)
    y, out = Permutation(key, label + "|" + ",".join(map(str, sizes)), prod(sizes))(x), []
    for a in reversed(alphabets):
        y, k = divmod(y, len(a))
        out.append(a[k])
    return "".join(reversed(out))


def class_of(c: str) -> str:
    for a in (DIGITS, LOWER, UPPER):
        if c in a:
            return a
    return c  # a fixed position


def by_class(key: bytes, label: str, text: str) -> str:
    if len(text) >= 8 and all(c in HEX for c in text) and not text.isdigit():
        return permuted(key, label, text, [HEX] * len(text))
    return permuted(key, label, text, [class_of(c) for c in text])


def put_back(shape: str, chars: str, where) -> str:
    """``shape`` with the characters that satisfy ``where`` replaced in turn by ``chars``."""
    it = iter(chars)
    return "".join(next(it) if where(c) else c for c in shape)


# --- validated values -> pseudonym, or None if the value isn't valid -----------------------------

def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def card(key: bytes, text: str) -> str:
    d = re.sub(r"\D", "", text)
    body = d[0] + permuted(key, "card", d[1:-1], [DIGITS] * (len(d) - 2))
    return put_back(text, body + luhn_digit(body), str.isdigit)


def usual(d: str, sizes: tuple[int, ...]) -> bool:
    """Whether an issuer gives out cards of this prefix and length, and prints them in these groups."""
    if len(sizes) > 1 and sizes not in ((4, 6, 5), (4, 6, 4)) and (set(sizes[:-1]) != {4} or sizes[-1] > 4):
        return False
    a, b, c = int(d[0]), int(d[:2]), int(d[:4])
    return len(d) in ((13, 16, 19) if a == 4 else (16,) if 51 <= b <= 55 or 2221 <= c <= 2720 else (15,) if b in (34, 37)
                      else range(14, 20) if b in (30, 36, 38, 39) else range(16, 20) if b == 35 else range(13, 20) if a in (5, 6) else ())


def cards(key: bytes, text: str, pattern: re.Pattern) -> Iterator[tuple[int, int, str, bool]]:
    """Valid ranges of each run of digit groups that begin and end with a group: first the usual
    ones, then the longer, then the earlier. The last item says whether the range is a usual one."""
    for m in pattern.finditer(text):
        groups = [g.span() for g in re.finditer(r"\d+", m[0])]
        if groups[-1][1] - groups[0][0] < 13:
            continue
        d = "".join(m[0][a:b] for a, b in groups)
        # Luhn sums of the digits before a place, with the digits at even or at odd places doubled
        before = [[0], [0]]
        for i, c in enumerate(d):
            for odd in (0, 1):
                x = int(c) << (i % 2 == odd)
                before[odd].append(before[odd][-1] + (x - 9 if x > 9 else x))
        starts = [0]
        for a, b in groups:
            starts.append(starts[-1] + b - a)
        # a group that runs on into a word with digits ends no number
        n, found = len(groups) - bool(re.compile(r"[^\W\d]\d").match(text, m.end())), []
        for i in range(n):
            if d[starts[i]] not in "23456":
                continue
            for j in range(i, n):
                at, end = starts[i], starts[j + 1]
                if end - at > 19:
                    break
                sums = before[end % 2]
                if end - at >= 13 and (sums[end] - sums[at]) % 10 == 0:
                    sizes = tuple(b - a for a, b in groups[i:j + 1])
                    found.append((not usual(d[at:end], sizes), at - end, i, j))
        taken = bytearray(len(groups))
        for other, _, i, j in sorted(found):
            if not any(taken[i:j + 1]):
                taken[i:j + 1] = b"\1" * (j + 1 - i)
                s, e = m.start() + groups[i][0], m.start() + groups[j][1]
                yield s, e, card(key, text[s:e]), not other


def longest(act, border: re.Pattern, key: bytes, text: str, pattern: re.Pattern) -> Iterator[tuple[int, int, str, bool]]:
    """Each match, or the longest part from its start to a border that is valid; after one that
    isn't, the search goes on behind its first group."""
    at = 0
    while m := pattern.search(text, at):
        ends = [m.start() + b.start() for b in border.finditer(m[0])] + [m.end()]
        at = max(ends[0], m.start() + 1)
        for e in reversed(ends):
            new = act(key, text[m.start():e])
            if new is not None:
                yield m.start(), e, new, True
                at = e
                break


def phone(key: bytes, text: str) -> str | None:
    d = re.sub(r"\D", "", text)
    if text.startswith("+") and not text.startswith("+1"):
        if not 8 <= len(d) <= 15:
            return None
        keep = min(2, len(d) - 6)
        return "+" + put_back(text[1:], d[:keep] + permuted(key, "phone", d[keep:], [DIGITS] * (len(d) - keep)), str.isdigit)
    if len(d) < 10:
        return None
    lead, rest = d[:-10], d[-10:]
    first = DIGITS[2:]
    if rest[0] in first and rest[3] in first:
        out = permuted(key, "nanp", rest, [first, DIGITS, DIGITS, first, *[DIGITS] * 6])
    else:  # not assigned, but written as a phone: permuted among the numbers of this sort
        pairs = [a + b for a in DIGITS for b in DIGITS if a not in first or b not in first]
        x = pairs.index(rest[0] + rest[3]) * 10**8 + int(rest[1:3] + rest[4:])
        pair, x = divmod(Permutation(key, "nanp-other", len(pairs) * 10**8)(x), 10**8)
        out = pairs[pair][0] + f"{x:08d}"[:2] + pairs[pair][1] + f"{x:08d}"[2:]
    return put_back(text, lead + out, str.isdigit)


def ssn(key: bytes, m: re.Match) -> str | None:
    area, group, serial = map(int, m.group(1, 3, 4))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    n = 898 * 99 * 9999
    a = area - 1 if area < 666 else area - 2
    x = Permutation(key, "ssn", n)((a * 99 + group - 1) * 9999 + serial - 1)
    x, s = divmod(x, 9999)
    a, g = divmod(x, 99)
    return f"{a + 1 if a < 665 else a + 2:03d}{m[2]}{g + 1:02d}{m[2]}{s + 1:04d}"


_LOCALHOST, _NOT_UNICAST = [127, 0, 0, 1], [0, 127, *range(224, 256)]


def ip(key: bytes, m: re.Match) -> str | None:
    o = [int(x) for x in m[0].split(".")]
    if max(o) > 255 or any(len(x) > 1 and x[0] == "0" for x in m[0].split(".")) or o == _LOCALHOST:
        return None
    if o[0] in _NOT_UNICAST:
        # among the addresses of this sort; localhost's place, the same on every host, is left out
        here = int.from_bytes(bytes(_LOCALHOST[1:]), "big") + (_NOT_UNICAST.index(127) << 24)
        x = _NOT_UNICAST.index(o[0]) << 24 | o[1] << 16 | o[2] << 8 | o[3]
        x = Permutation(key, "ip-other", (len(_NOT_UNICAST) << 24) - 1)(x - (x > here))
        x += x >= here
        return ".".join(map(str, (_NOT_UNICAST[x >> 24], x >> 16 & 255, x >> 8 & 255, x & 255)))
    first = o[0] - 1 if o[0] < 127 else o[0] - 2
    x = Permutation(key, "ip", 222 << 24)((first << 24) | o[1] << 16 | o[2] << 8 | o[3])
    first = x >> 24
    return ".".join(map(str, (first + 1 if first < 126 else first + 2, x >> 16 & 255, x >> 8 & 255, x & 255)))


def iban(key: bytes, text: str) -> str | None:
    v = re.sub(r"\s", "", text)
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(v) <= 34 or number(v[4:] + v[:4]) % 97 != 1:
        return None
    body = permuted(key, "iban", v[4:], [class_of(c) for c in v[4:]])
    return put_back(text, f"{v[:2]}{98 - number(body + v[:2] + '00') % 97:02d}{body}", str.isalnum)


_DAY0, _DAYS = dt.date(1900, 1, 1).toordinal(), dt.date(2100, 1, 1).toordinal() - dt.date(1900, 1, 1).toordinal()


def day(key: bytes, y: int, mo: int, d: int) -> dt.date | None:
    if not (1900 <= y < 2100 and 1 <= mo <= 12 and 1 <= d <= calendar.monthrange(y, mo)[1]):
        return None
    return dt.date.fromordinal(_DAY0 + Permutation(key, "date", _DAYS)(dt.date(y, mo, d).toordinal() - _DAY0))


def date(key: bytes, m: re.Match) -> str | None:
    a, sep, b, c = m.group("a", "sep", "b", "c")
    if len(a) == 4:
        y, mo, d, form = int(a), int(b), int(c), "ymd"
    else:
        # dots and dashes: day first; slashes: month first unless the first number can't be a month
        y, form = int(c), "dmy" if sep != "/" or int(a) > 12 else "mdy"
        d, mo = (int(a), int(b)) if form == "dmy" else (int(b), int(a))
    t = day(key, y, mo, d)
    if t is None:
        return None
    # written without leading zeros if it has a single digit
    year, month, dom = f"{t.year:04d}", str(t.month), str(t.day)
    if min(len(a), len(b), len(c)) > 1:
        month, dom = month.zfill(2), dom.zfill(2)
    return sep.join({"ymd": (year, month, dom), "dmy": (dom, month, year), "mdy": (month, dom, year)}[form])


_MONTHS = [x.lower() for x in ("January", "February", "March", "April", "May", "June", "July", "August", "September",
                               "October", "November", "December")]
_MONTH = "|".join(f"{x}|{x[:3]}" for x in _MONTHS) + "|sept"
#: a date with the month's English name, up to the end of its year
_NAMED = re.compile(rf"(?<!\w)(?:(?P<d>\d{{1,2}})(?P<th>st|nd|rd|th)?(?: of |\. |[ \-])(?P<mo>{_MONTH})\.?(?:,? |-)"
                    rf"|(?P<mo2>{_MONTH})\.?[ \-](?P<d2>\d{{1,2}})(?P<th2>st|nd|rd|th)?(?:,? |-))(?P<y>\d{{4}})\Z", re.I | re.A)


def named_dates(key: bytes, text: str, years: re.Pattern) -> Iterator[tuple[int, int, str, bool]]:
    for at in years.finditer(text):
        m = _NAMED.search(text, max(0, at.start() - 24), at.end())
        if m is None:
            continue
        mo, d, th = (n if m[n] is not None else f"{n}2" for n in ("mo", "d", "th"))
        t = day(key, int(m["y"]), [x[:3] for x in _MONTHS].index(m[mo][:3].lower()) + 1, int(m[d]))
        if t is None:
            continue
        name = _MONTHS[t.month - 1]
        name = name[:3] if len(m[mo]) < 5 and m[mo].lower() not in _MONTHS or text[m.end(mo)] == "." else name
        ordinal = "th" if 11 <= t.day <= 13 else {1: "st", 2: "nd", 3: "rd"}.get(t.day % 10, "th")
        new = {mo: name.upper() if m[mo].isupper() else name.title() if m[mo][0].isupper() else name,
               d: f"{t.day:02d}" if m[d][0] == "0" else str(t.day), "y": str(t.year)}
        if m[th]:
            new[th] = ordinal.upper() if m[th].isupper() else ordinal
        out, end = [], m.start()
        for n in sorted(new, key=m.start):
            out += [text[end:m.start(n)], new[n]]
            end = m.end(n)
        yield m.start(), m.end(), "".join(out), True


def email(key: bytes, m: re.Match) -> str | None:
    local, host = m[0].split("@")
    labels = host.split(".")
    if any(not x or x[0] == "-" or x[-1] == "-" for x in labels) or local[0] == "." or local[-1] == "." or ".." in local:
        return None
    # letter case is no part of an address: equal addresses stay equal
    front = ".".join(labels[:-2])
    value = f"{local}@{front}".lower()
    got = permuted(key, "email", value, [class_of(c) for c in value])
    if got == value:  # nothing to permute
        return None
    new_local, new_front = got[:len(local)], got[len(local) + 1:]
    return f"{new_local}@{'.'.join([*([new_front] if front else []), *labels[-2:]])}"


def secret(key: bytes, m: re.Match) -> str | None:
    value = m["key"] or m["value"]
    if m["key"]:
        new = value[:4] + permuted(key, "access", value[4:], [DIGITS + UPPER] * (len(value) - 4))
    else:
        new = by_class(key, "secret", value)
    return m[0][:len(m[0]) - len(value) - len(m["close"] or "")] + new + (m["close"] or "") if new != value else None


#: kind, characters one of which must occur, pattern, pseudonym. Bounded repeats: linear time.
_DETECTORS = [
    ("secret", "AKp=:", re.compile(
        r"(?<![A-Za-z0-9])(?P<key>(?:AKIA|ASIA)[A-Z0-9]{16})(?![A-Za-z0-9])"
        r"|(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\b[ \t]{0,3}[=:][ \t]{0,3}[\"']?)"
        r"(?P<value>[A-Za-z0-9_+/\-]{6,256})(?P<close>[\"']?)"), secret),
    ("email", "@", re.compile(
        r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){0,8}\.[A-Za-z]{2,24}"), email),
    ("iban", DIGITS, re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), iban),
    ("ip", ".", re.compile(r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)"), ip),
    ("date", DIGITS, re.compile(
        r"(?<![\d\-/.])(?:(?P<a>\d{4})(?P<sep>[\-/.])(?P<b>\d{1,2})(?P=sep)(?P<c>\d{1,2})"
        r"|(?P<a2>\d{1,2})(?P<sep2>[\-/.])(?P<b2>\d{1,2})(?P=sep2)(?P<c2>\d{4}))(?![\d\-/]|\.\d)"), None),
    ("date", DIGITS, re.compile(r"(?<=[,.\- ])(?:19|20)\d\d(?![^\W_])"), named_dates),
    ("ssn", DIGITS, re.compile(r"(?<![\d\-])(\d{3})([\- ])(\d{2})\2(\d{4})(?![\d\-])"), ssn),
    ("phone", DIGITS, re.compile(
        r"(?<![\w+])(?:\+1[ .\-]?)?(?:\(\d{3}\)[ .\-]?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?!\w)"
        r"|(?<![\w+])\+[2-9]\d{0,2}(?:[ .\-]?\(?\d{1,4}\)?){2,5}(?!\w)"
        r"|(?<![\w+])\+1(?:[ .\-]?\(?\d\)?){10}(?!\w)"), phone),
    ("card", DIGITS, re.compile(r"(?<![\w\-])\d+(?:[ \-]\d+)*"), None),
]
#: where a shorter part of a match may end
_BORDERS = {"iban": re.compile(" "), "phone": re.compile(r"(?<=[\d)])(?=[ .\-(])")}
#: kinds known by their context, then those with check digits (cards of usual form), then the rest
_STEPS = (("secret", "email"), ("iban", "card"), ("ip", "date", "ssn", "phone", "card"))


class _Date:
    """Either branch of the date pattern under one set of names."""

    def __init__(self, m: re.Match):
        self.m = m

    def group(self, *names: str):
        return tuple(self.m[n] if self.m[n] is not None else self.m[f"{n}2"] for n in names)


def candidates(kind: str, pattern: re.Pattern, act, text: str, key: bytes) -> Iterator[tuple[int, int, str, bool]]:
    """(start, end, pseudonym, sure) of the valid values of a kind."""
    if kind == "card":
        yield from cards(key, text, pattern)
    elif act is named_dates:
        yield from named_dates(key, text, pattern)
    elif kind in _BORDERS:
        yield from longest(act, _BORDERS[kind], key, text, pattern)
    else:
        for m in pattern.finditer(text):
            new = date(key, _Date(m)) if kind == "date" else act(key, m)
            if new is not None:
                yield m.start(), m.end(), new, True


_OTHER_DIGIT = re.compile(r"[^\D0-9]")


def in_digits_of(new: str, old: str) -> str:
    """``new`` with its n-th digit written in the digit set of the n-th (or the last) digit of ``old``."""
    zeros = [ord(c) - unicodedata.decimal(c) for c in old if c.isdecimal()]
    if not zeros:
        return new
    n, out = 0, []
    for c in new:
        if c.isdecimal():
            c = chr(zeros[min(n, len(zeros) - 1)] + int(c))
            n += 1
        out.append(c)
    return "".join(out)


def findings(text: str, key: bytes) -> list[tuple[int, int, str, str]]:
    """[(start, end, kind, pseudonym)] in order, without overlaps. Each step reads what the steps
    before it left, so that a value is not lost to a neighbour that a looser pattern draws in.
    Decimal digits of any script are read by their value and written back in their script."""
    if not text.isascii() and _OTHER_DIGIT.search(text):
        plain = _OTHER_DIGIT.sub(lambda m: str(unicodedata.decimal(m[0])), text)
        return [(s, e, kind, in_digits_of(new, text[s:e])) for s, e, kind, new in findings(plain, key)]
    kept = []
    for step in _STEPS:
        out = []
        for kind, need, pattern, act in _DETECTORS:
            if kind in step and any(c in text for c in need):
                out += [(s, e, kind, new) for s, e, new, sure in candidates(kind, pattern, act, text, key) if sure or step is _STEPS[-1]]
        out.sort(key=lambda x: (x[0], -x[1]))
        end, parts, at = 0, [], 0
        for x in out:
            if x[0] >= end:
                kept.append(x)
                parts += [text[at:x[0]], "\0" * (x[1] - x[0])]
                at = end = x[1]
        if parts:
            text = "".join([*parts, text[at:]])
    return sorted(kept)


def pseudonymized(text: str | None, key: bytes) -> tuple[str | None, dict[str, int]]:
    counts = dict.fromkeys(KINDS, 0)
    if not text:
        return text, counts
    parts, at = [], 0
    for s, e, kind, new in findings(text, key):
        parts += [text[at:s], new]
        at = e
        counts[kind] += 1
    return ("".join([*parts, text[at:]]) if parts else text), counts


def configured_key(spark: SparkSession) -> bytes:
    """The key that the session's setting ``spark.trajens.pseudonym.secret`` gives in hex. Where it is unset,
    a fresh random one: values stay linked within what it is used for, two runs differ, and nobody can
    lead the pseudonyms back."""
    given = spark.conf.get(KEY_SETTING, None)
    return bytes.fromhex(given) if given else secrets.token_bytes(32)


def pseudonymize(docs: DataFrame, key: bytes, text_col: str = "text", counted: bool = True) -> DataFrame:
    """``docs`` with ``text_col`` pseudonymized and, if ``counted``, a column n_<kind> per kind. ``key``: 16
    to 64 secret bytes; tables whose values shall stay linked need the same one."""
    if not 16 <= len(key) <= 64:
        raise ValueError("a pseudonym key has 16 to 64 bytes")
    at = docs.columns.index(text_col)
    extra: dict[str, str] = {}
    if counted:
        for k in KINDS:
            extra[k] = free_name(docs, f"n_{k}")
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, T.LongType()) for n in extra.values()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            done = [pseudonymized(t, key) for t in b.column(at).to_pylist()]
            columns = list(b.columns)
            columns[at] = pa.array([t for t, _ in done], b.schema.field(at).type)
            columns += [pa.array([c[k] for _, c in done], pa.int64()) for k in extra]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


def op5_pii(spark, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms in place of personal data, and findings per kind."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymize(docs, configured_key(spark)).withColumn("n_found", sum(F.col(f"n_{k}") for k in KINDS))
