"""Format-preserving Feistel pseudonyms for personal data.

Validated numbers and dates (payment cards, phone numbers, social security numbers, IPv4 addresses, IBANs, dates) and
the local parts of e-mail addresses are replaced by a keyed permutation of their own format: a Feistel network of ten
keyed BLAKE2b rounds over the value's number, walked along its cycle until the result is valid again. Equal values get
equal pseudonyms in every document, different ones different pseudonyms, and the key's holder can invert them. A text
is read once from left to right, an address before any number that starts where it does.

Dates: a day has one pseudonym in every way of writing it (2024-02-01, 01/02/2024, 1/2/2024, 1.2.2024). `a/b/year` is
read day first if that is a day, else month first; so that every way reads back, the permutation keeps whether the day
of the month is over 12 and whether day and month have one digit or two. Days of 1900 to 2099 stay among themselves, as do
all others from year 1 to 9999.

Phones: numbers of the North American plan with separators, and numbers in international form, a plus sign and 8 to 15
digits, of which the first two (the country) stay. Bare runs of digits carry no check and are not taken for phones.

Defined cases: null texts stay null and empty texts empty, both with no findings; repeated rows get equal results;
invalid look-alikes (a failed check digit, no such day) are left as they are; an empty table gives an empty result;
other columns do not matter.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from marlspike.session import ship

KINDS = ("email", "iban", "card", "phone", "ssn", "ip", "date")
VALUES = re.compile(
    r"(?P<local>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+)(?P<host>@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24})(?![A-Za-z0-9-])"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<card>(?<![\w.-])(?:\d{13,19}|\d{4}(?P<s1>[\x20-])\d{4}(?P=s1)\d{4}(?P=s1)\d{1,7}|\d{4}(?P<s2>[\x20-])\d{6}(?P=s2)\d{5})(?![\w-]))"
    r"|(?P<phone>(?<![\w])(?:\+?1[\x20.-]?)?(?:\(\d{3}\)\x20?|\d{3}[\x20.-])\d{3}[\x20.-]\d{4}(?![\w]))"
    r"|(?P<intl>(?<![\w+])\+\d{1,3}(?:[\x20.-]?\(?\d{1,14}\)?){1,6}(?![\w]))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d))"
    r"|(?P<date>(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}(?P<s3>[./-])\d{1,2}(?P=s3)\d{4})(?![\w/-]))",
    re.A,
)
DIGIT = re.compile("[0-9]")
LAST_DAY, NEAR = dt.date.max.toordinal(), range(dt.date(1900, 1, 1).toordinal(), dt.date(2100, 1, 1).toordinal())


def feistel(key: bytes, tweak: str, value: int, size: int, back: bool = False, rounds: int = 10) -> int:
    """A keyed permutation of range(size)."""
    half = max(1, (max(2, size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8

    def turn(i: int, x: int) -> int:
        h = hashlib.blake2b(bytes([i]) + x.to_bytes(width, "big") + tweak.encode(), key=key, digest_size=width)
        return int.from_bytes(h.digest(), "big") & mask

    while True:
        left, right = value >> half, value & mask
        for i in range(rounds - 1, -1, -1) if back else range(rounds):
            left, right = (right ^ turn(i, left), left) if back else (right, left ^ turn(i, right))
        value = left << half | right
        if value < size:
            return value


def walk(key: bytes, tweak: str, value: int, size: int, valid: Callable[[int], bool], back: bool = False) -> int:
    """The same permutation restricted to the valid numbers."""
    while True:
        value = feistel(key, tweak, value, size, back)
        if valid(value):
            return value


def luhn(digits: str) -> int:
    """The check sum; 0 for a valid number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def refill(shape: str, digits: str) -> str:
    """`shape` with its digits replaced in order."""
    fresh = iter(digits)
    return "".join(next(fresh) if c.isdigit() else c for c in shape)


def card(key: bytes, text: str, back: bool) -> str | None:
    digits = re.sub(r"\D", "", text)
    n = len(digits)
    if digits[0] == "0" or not 13 <= n <= 19 or luhn(digits):
        return None
    low = 10 ** (n - 2)
    body = str(feistel(key, f"card{n}", int(digits[:-1]) - low, 9 * low, back) + low)
    return refill(text, body + str(-luhn(body + "0") % 10))


def phone(key: bytes, text: str, back: bool) -> str | None:
    digits = re.sub(r"\D", "", text)
    regular = lambda v: (s := f"{v:010}")[0] > "1" and s[3] > "1"  # noqa: E731  numbering-plan form
    same = regular(int(digits[-10:]))
    fresh = walk(key, "phone", int(digits[-10:]), 10**10, lambda v: regular(v) == same, back)
    return refill(text, digits[:-10] + f"{fresh:010}")


def ssn(key: bytes, text: str, back: bool) -> str | None:
    good = lambda v: (s := f"{v:09}")[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"
    v = int(text.replace("-", ""))
    return refill(text, f"{walk(key, 'ssn', v, 10**9, good, back):09}") if good(v) else None


def ip(key: bytes, text: str, back: bool) -> str | None:
    parts = [int(x) for x in text.split(".")]
    if max(parts) > 255:
        return None
    v = feistel(key, "ip", int.from_bytes(bytes(parts), "big"), 2**32, back)
    return ".".join(map(str, v.to_bytes(4, "big")))


def in_place(key: bytes, tweak: str, text: str, back: bool) -> str:
    """Each digit stays a digit, each letter a letter of its case; the rest stays."""
    bases = [("0", 10) if c.isdigit() else ("a", 26) if "a" <= c <= "z" else ("A", 26) if "A" <= c <= "Z" else None for c in text]
    value, size = 0, 1
    for c, b in zip(text, bases):
        if b:
            value, size = value * b[1] + ord(c) - ord(b[0]), size * b[1]
    if size == 1:
        return text
    value, out = feistel(key, tweak, value, size, back), []
    for c, b in reversed([*zip(text, bases)]):
        if b:
            value, digit = divmod(value, b[1])
            c = chr(ord(b[0]) + digit)
        out.append(c)
    return "".join(reversed(out))


def iban(key: bytes, text: str, back: bool) -> str | None:
    flat = text.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(flat) <= 34 or number(flat[4:] + flat[:4]) % 97 != 1:
        return None
    body = in_place(key, "iban" + flat[:2] + re.sub(r"[A-Z]", "A", re.sub(r"\d", "0", flat[4:])), flat[4:], back)
    fresh = iter(flat[:2] + f"{98 - number(body + flat[:2] + '00') % 97:02}" + body)
    return "".join(c if c == " " else next(fresh) for c in text)


def intl(key: bytes, text: str, back: bool) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not 8 <= len(digits) <= 15:
        return None
    return refill(text, digits[:2] + in_place(key, f"intl{digits[:2]}", digits[2:], back))


def day_kind(v: int) -> tuple[bool, bool, bool, bool]:
    """What a day's pseudonym has in common with it."""
    d = dt.date.fromordinal(v)
    return v in NEAR, d.day > 12, d.day > 9, d.month > 9


def other_day(key: bytes, d: dt.date, back: bool) -> dt.date:
    """The day's pseudonym: the permutation of its era, walked to a day of the same kind."""
    v = d.toordinal()
    kind = day_kind(v)
    if v in NEAR:
        fresh = walk(key, "day", v - NEAR.start, len(NEAR), lambda x: day_kind(x + NEAR.start) == kind, back) + NEAR.start
    else:
        fresh = walk(key, "far day", v - 1, LAST_DAY, lambda x: day_kind(x + 1) == kind, back) + 1
    return dt.date.fromordinal(fresh)


def date(key: bytes, text: str, back: bool) -> str | None:
    parts = re.split(r"[./-]", text)
    a, b, c = map(int, parts)

    def day(y: int, m: int, d: int) -> dt.date | None:
        try:
            return dt.date(y, m, d)
        except ValueError:
            return None

    if len(parts[0]) == 4:
        return other_day(key, d, back).isoformat() if (d := day(a, b, c)) else None
    at = re.search(r"[./-]", text)[0]
    write = lambda n, part: f"{n:0{len(part)}}"
    if d := day(c, b, a):
        d = other_day(key, d, back)
        return f"{write(d.day, parts[0])}{at}{write(d.month, parts[1])}{at}{d.year:04}"
    if d := day(c, a, b):
        d = other_day(key, d, back)
        return f"{write(d.month, parts[0])}{at}{write(d.day, parts[1])}{at}{d.year:04}"
    return None


MAKERS = {"card": card, "phone": phone, "intl": intl, "ssn": ssn, "ip": ip, "iban": iban, "date": date}


def pseudonymise(text: str, key: bytes, back: bool = False) -> tuple[str, dict[str, int]]:
    """(text with pseudonyms, findings by kind); `back` inverts."""
    counts = dict.fromkeys(KINDS, 0)

    def fresh(m: re.Match) -> str:
        if m["local"]:
            counts["email"] += 1
            shape = re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "0", m["local"])))
            return in_place(key, "email" + shape, m["local"], back) + m["host"]
        kind = next(k for k in MAKERS if m[k])
        made = MAKERS[kind](key, m[0], back)
        if made is None:
            return m[0]
        counts["phone" if kind == "intl" else kind] += 1
        return made

    if DIGIT.search(text) or "@" in text:
        text = VALUES.sub(fresh, text)
    return text, counts


def mask(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", back: bool = False) -> DataFrame:
    """doc_id, text with pseudonyms, and n_<kind> for every row; one narrow pass."""
    ship(docs.sparkSession)

    @F.pandas_udf(f"struct<text: string, {', '.join(f'n_{k}: long' for k in KINDS)}>")
    def masked(texts: pd.Series) -> pd.DataFrame:
        rows = [(None, dict.fromkeys(KINDS, 0)) if not isinstance(t, str) else pseudonymise(t, key, back) for t in texts]
        return pd.DataFrame({"text": pd.Series([r[0] for r in rows], dtype=object)} | {f"n_{k}": pd.Series([r[1][k] for r in rows], dtype="int64") for k in KINDS})

    return docs.select(F.col(id_col).alias("doc_id"), masked(text_col).alias("m")).select("doc_id", "m.*")
