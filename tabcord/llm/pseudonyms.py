"""Format-preserving pseudonyms for personal data.

Numbers and dates that pass their own check (Luhn, octet range, calendar,
check digits) are replaced by a keyed permutation of all values of the same
format: a Feistel network over mixed-radix digits, walked until the result
passes the same check.  Layout, separators and check digits stay right, equal
values get equal pseudonyms in every document, and whoever has the key can
invert them.  Names in e-mail addresses and secrets (access keys, tokens,
passwords) go through the same network, each character within its class.

Digits of other scripts stay in their script: a value is checked and permuted
by its digits' values, so equal values of two scripts stay linked too.

Null texts stay null and empty ones empty.  Text outside the found values is
never changed.  Long texts are searched whole, in time that grows with their
length.  Of several kinds at one place the first that is valid counts.
Repeated rows get equal results; an empty table gives an empty result; columns
of clashing names stay apart in ``row``.  Values whose format has a single
member cannot change; dates outside 1900 to 2099 stay.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import by_batch, whole_row, with_row

ROUNDS = 10

#: What each kind of value looks like; of several kinds at one place the first that is valid counts.
PATTERNS = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "secret": r"""\bAKIA[0-9A-Z]{16}\b
        | (?i:\b(?:password|passwd|token|secret|api_?key)\b["']?\s?[=:]\s?["']?[\w+/.-]{8,})""",
    "date": r"""(?<![\w.,/-])
        (?:\d{4}-\d{1,2}-\d{1,2} | \d{1,2}/\d{1,2}/\d{4} | \d{1,2}\.\d{1,2}\.\d{4})
        (?![\w/-]|[.,]\d)""",
    "iban": r"\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"""(?<![\w+])\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\w)
        | (?<![\w+])\+[2-9]\d{0,2}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}(?!\w)
        | (?<![\w(])\(\d{3}\)[ ]?\d{3}[ .-]\d{4}(?!\w)
        | (?<![\w.+-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\w-])""",
    "card": r"(?<![\w.,+-])\d(?:[ -]?\d){12,18}(?![\w-])",
}
KINDS = tuple(PATTERNS)
_ALONE = {k: re.compile(p, re.VERBOSE) for k, p in PATTERNS.items()}
_SPAN = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()), re.VERBOSE)
_MAY = re.compile(r"[\d@]|AKIA|(?i:password|passwd|token|secret|api)")


def feistel(digits: list[int], radices: list[int], key: bytes, tweak: str) -> list[int]:
    """A keyed permutation of all digit strings with these radices."""
    half = len(digits) // 2
    parts = [_pack(digits[:half], radices[:half]), _pack(digits[half:], radices[half:])]
    sizes = [_size(radices[:half]), _size(radices[half:])]
    for k in range(ROUNDS):
        side = k % 2
        seed = f"{tweak}|{sizes[0]}|{sizes[1]}|{k}|{parts[1 - side]}".encode()
        noise = int.from_bytes(hashlib.blake2b(seed, key=key, digest_size=32).digest(), "big")
        parts[side] = (parts[side] + noise) % sizes[side]
    return _unpack(parts[0], radices[:half]) + _unpack(parts[1], radices[half:])


def unfeistel(digits: list[int], radices: list[int], key: bytes, tweak: str) -> list[int]:
    """The inverse of :func:`feistel`."""
    half = len(digits) // 2
    parts = [_pack(digits[:half], radices[:half]), _pack(digits[half:], radices[half:])]
    sizes = [_size(radices[:half]), _size(radices[half:])]
    for k in reversed(range(ROUNDS)):
        side = k % 2
        seed = f"{tweak}|{sizes[0]}|{sizes[1]}|{k}|{parts[1 - side]}".encode()
        noise = int.from_bytes(hashlib.blake2b(seed, key=key, digest_size=32).digest(), "big")
        parts[side] = (parts[side] - noise) % sizes[side]
    return _unpack(parts[0], radices[:half]) + _unpack(parts[1], radices[half:])


def _size(radices: list[int]) -> int:
    out = 1
    for r in radices:
        out *= r
    return out


def _pack(digits: list[int], radices: list[int]) -> int:
    out = 0
    for d, r in zip(digits, radices, strict=True):
        out = out * r + d
    return out


def _unpack(value: int, radices: list[int]) -> list[int]:
    out = []
    for r in reversed(radices):
        value, d = divmod(value, r)
        out.append(d)
    return out[::-1]


def walk(
    digits: list[int],
    radices: list[int],
    key: bytes,
    tweak: str,
    valid: Callable[[list[int]], bool] = lambda d: True,
) -> list[int]:
    """Permute until the result is valid: a permutation of the valid strings."""
    if _size(radices) < 2:
        return digits
    while True:
        digits = feistel(digits, radices, key, tweak)
        if valid(digits):
            return digits


def luhn_digit(digits: list[int]) -> int:
    """The check digit that follows these digits."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = d * 2 if i % 2 == 0 else d
        total += d - 9 if d > 9 else d
    return -total % 10


def refill(text: str, digits: list[int]) -> str:
    """The text with its digits replaced in order."""
    new = iter(digits)
    return "".join(str(next(new)) if c.isdigit() else c for c in text)


def _digits(text: str) -> list[int]:
    return [int(c) for c in text if c.isdigit()]


def card(text: str, key: bytes) -> str | None:
    """Luhn numbers: the first digit stays (the scheme), the check digit follows the others."""
    d = _digits(text)
    if luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    body = walk(d[1:-1], [10] * (len(d) - 2), key, f"card{d[0]}")
    body = [d[0], *body]
    return refill(text, [*body, luhn_digit(body)])


def phone(text: str, key: bytes) -> str | None:
    """Phone numbers: the country code stays; groups keep a first digit that is not 0 (in +1: 2 to 9)."""
    m = re.match(r"\+(\d{1,3})(?=[ .(-])", text)
    code = m[1] if m else "1" if text[0] == "+" else ""
    start = len(code) + 1 if text[0] == "+" else 0
    body = text[start:]
    d = _digits(body)
    if not 7 <= len(d) + len(code) <= 15 or len(d) < 6:
        return None
    north = code in ("", "1") and len(d) == 10
    leads = [0, 3] if north else [0]
    least = 2 if north else 1

    def valid(x: list[int]) -> bool:
        return all(x[i] >= least for i in leads)

    if not valid(d):
        return None
    return text[:start] + refill(body, walk(d, [10] * len(d), key, f"phone{code}", valid))


def _ip_kind(o: list[int]) -> str:
    if o[0] in (0, 127) or o[0] >= 224 or o[:2] == [169, 254]:
        return "special"
    if o[0] == 10 or (o[0] == 172 and 16 <= o[1] < 32) or o[:2] == [192, 168]:
        return "private"
    return "public"


def ip(text: str, key: bytes) -> str | None:
    """IPv4 addresses: public ones stay public; private and special ones name no person and stay."""
    parts = text.split(".")
    octets = [int(p) for p in parts]
    if max(octets) > 255 or any(p != str(o) for p, o in zip(parts, octets, strict=True)):
        return None
    if _ip_kind(octets) != "public":
        return None
    out = walk(octets, [256] * 4, key, "ip", lambda o: _ip_kind(o) == "public")
    return ".".join(map(str, out))


def ssn(text: str, key: bytes) -> str | None:
    """Social security numbers: area, group and serial stay in their allowed ranges."""

    def valid(d: list[int]) -> bool:
        area = d[0] * 100 + d[1] * 10 + d[2]
        return area not in (0, 666) and area < 900 and any(d[3:5]) and any(d[5:])

    d = _digits(text)
    return refill(text, walk(d, [10] * 9, key, "ssn", valid)) if valid(d) else None


FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)


def date(text: str, key: bytes) -> str | None:
    """Calendar dates of 1900 to 2099: a permutation of the days, the same in every layout."""
    mark = next(c for c in text if not c.isdigit())
    parts = [int(p) for p in text.split(mark)]
    orders = {"-": [(0, 1, 2)], ".": [(2, 1, 0)], "/": [(2, 0, 1), (2, 1, 0)]}[mark]
    for order in orders:
        try:
            day = datetime.date(*(parts[i] for i in order))
        except ValueError:
            continue
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        span = (LAST_DAY - FIRST_DAY).days + 1
        # 300 times 300 holds all days
        place = (day - FIRST_DAY).days
        out = walk(
            list(divmod(place, 300)), [300, 300], key, "date", lambda d: d[0] * 300 + d[1] < span
        )
        new = FIRST_DAY + datetime.timedelta(out[0] * 300 + out[1])
        values = [0, 0, 0]
        for i, v in zip(order, (new.year, new.month, new.day), strict=True):
            values[i] = v
        widths = [len(p) for p in text.split(mark)]
        return mark.join(f"{v:0{w}d}" for v, w in zip(values, widths, strict=True))
    return None


def _iban_check(country: str, body: str) -> int:
    number = "".join(str(int(c, 36)) for c in body + country + "00")
    return 98 - int(number) % 97


def iban(text: str, key: bytes) -> str | None:
    """IBANs: country and layout stay, check digits follow the permuted body."""
    plain = text.replace(" ", "")
    body = plain[4:]
    if len(plain) < 15 or _iban_check(plain[:2], body) != int(plain[2:4]):
        return None
    new = _by_class(body, key, "iban" + plain[:2])
    full = iter(f"{plain[:2]}{_iban_check(plain[:2], new):02d}{new}")
    return "".join(" " if c == " " else next(full) for c in text)


#: Classes of characters that stay among themselves.
_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _by_class(text: str, key: bytes, tweak: str) -> str:
    """Permute letters and digits, each within its class; other characters stay."""
    classes = [next((c for c in _CLASSES if x in c), None) for x in text]
    moved = [(c, x) for c, x in zip(classes, text, strict=True) if c]
    shape = "".join(c[0] if c else x for c, x in zip(classes, text, strict=True))
    out = iter(
        walk([c.index(x) for c, x in moved], [len(c) for c, _ in moved], key, tweak + shape)
    )
    return "".join(c[next(out)] if c else x for c, x in zip(classes, text, strict=True))


def email(text: str, key: bytes) -> str | None:
    """E-mail addresses: the name is permuted, the domain stays."""
    name, domain = text.rsplit("@", 1)
    return f"{_by_class(name, key, 'email' + domain)}@{domain}"


def secret(text: str, key: bytes) -> str | None:
    """Access keys, tokens and passwords: their characters are permuted, the label stays."""
    if text.startswith("AKIA"):
        return "AKIA" + _by_class(text[4:], key, "akia")
    m = re.search(r"[\w+/.-]+$", text)
    value = m[0]
    hexadecimal = re.fullmatch(r"[0-9a-f]+", value)
    if hexadecimal:
        digits = [int(c, 16) for c in value]
        new = "".join(f"{d:x}" for d in walk(digits, [16] * len(digits), key, f"hex{len(value)}"))
    else:
        new = _by_class(value, key, "secret")
    return text[: m.start()] + new


REPLACE = {f.__name__: f for f in (email, secret, date, iban, ip, ssn, phone, card)}


def pseudonym(kind: str, text: str, key: bytes) -> str | None:
    """A value's pseudonym in the script of its digits, or None if the value is not valid."""
    if text.isascii():
        return REPLACE[kind](text, key)
    zeros = [ord(c) - unicodedata.decimal(c) for c in text if c.isdecimal()]
    plain = "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in text)
    new = REPLACE[kind](plain, key)
    if new is None or not zeros:
        return new
    if len(zeros) != sum(c.isdecimal() for c in new):
        zeros = [zeros[0]] * len(new)  # a date or address may get more digits or fewer
    own = iter(zeros)
    return "".join(chr(next(own) + int(c)) if c.isdecimal() else c for c in new)


def replace(text: str, key: bytes) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with pseudonyms, and (start, end, kind) of what was replaced in it."""
    out, spans, at = [], [], 0
    place = 0
    while m := _SPAN.search(text, place):
        kind = m.lastgroup
        new = pseudonym(kind, m[0], key)
        if new is None:
            # not valid as what it looks like: another kind may begin at the same place or after
            m, kind, new = _other(text, m, key)
        if new is None:
            # go on behind the digits or letters that were just looked at
            place = m.start() + 1
            while place < len(text) and text[place].isalnum() and text[place - 1].isalnum():
                place += 1
            continue
        out += [text[at : m.start()], new]
        spans.append((m.start(), m.end(), kind))
        at = place = m.end()
    return "".join([*out, text[at:]]), spans


def _other(text: str, m: re.Match, key: bytes):
    """A later kind's valid value at the place of a match that was not valid."""
    for kind in KINDS[KINDS.index(m.lastgroup) + 1 :]:
        again = _ALONE[kind].match(text, m.start())
        if again and (new := pseudonym(kind, again[0], key)) is not None:
            return again, kind, new
    return m, m.lastgroup, None


SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("kind", T.StringType()),
        ]
    )
)


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """(row, new_text, spans): every row as one struct, its text with pseudonyms, what was replaced.

    Span positions are characters of the text before replacement.
    """
    if not 16 <= len(key) <= 64:
        raise ValueError("the key has 16 to 64 bytes")
    rows = whole_row(docs, text=F.col(text_col).cast("string"))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        new, spans = [], []
        for text in batch.column("text").to_pylist():
            if text and _MAY.search(text):
                text, found = replace(text, key)
                spans.append([{"start": a, "end": b, "kind": k} for a, b, k in found])
            else:
                spans.append([])
            new.append(text)
        kind = pa.list_(
            pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])
        )
        return pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array(new, pa.string()), pa.array(spans, kind)],
            ["row", "new_text", "spans"],
        )

    schema = with_row(docs, "new_text string")
    schema = T.StructType([*schema.fields, T.StructField("spans", SPANS)])
    return by_batch(rows, step, schema)


def replace_text(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """The documents with pseudonyms in their text, all columns in place."""
    found = pseudonymise(docs, key, text_col)
    columns = [
        F.col("new_text").alias(c) if c == text_col else F.col("row")[c].alias(c)
        for c in docs.columns
    ]
    return found.select(*columns)
