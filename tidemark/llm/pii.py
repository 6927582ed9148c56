"""Format-preserving pseudonyms of personal data.

Validated numbers and dates are replaced by others of the same format: a keyed Feistel network
permutes the numbers of the format, walking on until it lands inside. It is a permutation, so equal
values get equal pseudonyms in all documents and different values stay different. Recognised:
payment cards (Luhn), phone numbers, IPv4 addresses, US social security numbers, IBANs (mod 97),
dates from 1900 to 2099, and the local part of e-mail addresses. What doesn't validate is left alone.
A phone number gets the same digits however it is grouped; a date keeps the number of digits of its day
and month. Each place of a text is replaced once: numbers inside an address belong to it.

Defined results: a null text stays null; an empty text stays empty; equal texts get equal results;
an empty table yields no rows; other columns pass through untouched.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from datetime import date
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._scratch import col, fresh, kept, released

#: For tests and queries; a production job passes its own secret.
DEFAULT_KEY = b"tidemark pseudonyms"
ROUNDS = 8

NUMBER = re.compile(
    r"(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<phone>(?<![\w+])\+\d(?:[ .-]?\d){0,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d){4,13}(?!\d)"
    r"|(?<![\w+])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\w.+-])\d{3}([ .-])\d{3}\3\d{4}(?![\w-]))"
    r"|(?P<ip>(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w]|\.\w))"
    r"|(?P<iso>(?<![\w-])\d{4}-\d{2}-\d{2}(?!\d|-\d))"
    r"|(?P<dmy>(?<![\w.])\d{1,2}\.\d{1,2}\.\d{4}(?![\w]|\.\w))"
    r"|(?P<mdy>(?<![\w/])\d{1,2}/\d{1,2}/\d{4}(?![\w/]))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w])(?:\d{13,19}|\d{4}([ -])\d{4}\10\d{4}\10\d{4}|\d{4}([ -])\d{6}\11\d{5})(?!\w))"
)
EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])")
LIKELY = re.compile(r"\d.*?\d", re.S)
FIRST_DAY, DAYS = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal() - date(1900, 1, 1).toordinal() + 1
#: The country calling codes of two digits.
TWO_DIGIT_CODES = frozenset(
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
)
#: Pseudonyms that a worker remembers.
CACHE = 20_000
UPPER, LOWER, DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"


def permute(key: bytes, tweak: str, n: int, size: int) -> int:
    """A keyed permutation of 0..size-1: a balanced Feistel network on the next even number of
    bits, applied again while it lands outside."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8
    while True:
        left, right = n >> half, n & mask
        for r in range(ROUNDS):
            seed = f"{tweak}/{size}/{r}/".encode() + right.to_bytes(width, "big")
            left, right = right, left ^ (int.from_bytes(hashlib.blake2b(seed, key=key[:64], digest_size=width + 1).digest(), "big") & mask)
        n = left << half | right
        if n < size:
            return n


def mixed(key: bytes, tweak: str, values: list[int], sizes: list[int]) -> list[int]:
    """The permutation of a number written with these bases."""
    n, size = 0, 1
    for v, s in zip(values, sizes):
        n, size = n * s + v, size * s
    n, out = permute(key, tweak, n, size) if size > 1 else n, []
    for s in reversed(sizes):
        n, v = divmod(n, s)
        out.append(v)
    return out[::-1]


def alike(key: bytes, tweak: str, text: str) -> str:
    """Each letter and digit by one of its kind, everything else in place."""
    kinds = [(k, next(a for a in (DIGIT, LOWER, UPPER) if c in a)) for k, c in enumerate(text) if c in DIGIT or c in LOWER or c in UPPER]
    new = mixed(key, tweak, [a.index(text[k]) for k, a in kinds], [len(a) for _, a in kinds])
    out = list(text)
    for (k, a), v in zip(kinds, new):
        out[k] = a[v]
    return "".join(out)


def refill(text: str, digits: str) -> str:
    """The digits of ``text`` replaced one by one."""
    new = iter(digits)
    return "".join(next(new) if c in DIGIT else c for c in text)


def luhn(digits: str) -> int:
    """0 for a valid number."""
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10


def card(key: bytes, text: str) -> str | None:
    digits = "".join(filter(str.isdigit, text))
    if luhn(digits) or len(set(digits)) == 1:
        return None
    new = digits[0] + f"{permute(key, f'card{digits[0]}', int(digits[1:-1]), 10 ** (len(digits) - 2)):0{len(digits) - 2}d}"
    return refill(text, new + str(-luhn(new + "0") % 10))


def country_code(digits: str) -> str:
    """How many of the first digits are the country's follows from them alone, however a number is
    written: one for zones 1 and 7, two for the listed ones, else three."""
    return digits[:1] if digits[0] in "17" else digits[:2] if digits[:2] in TWO_DIGIT_CODES else digits[:3]


def phone(key: bytes, text: str) -> str | None:
    digits = "".join(filter(str.isdigit, text))
    code = country_code(digits) if text[0] == "+" else ""
    own = digits[len(code):]
    if not 7 <= len(digits) <= 15 or len(own) < 4 or digits[0] == "0" or len(re.findall(r"(?<!\d)\d(?!\d)", text)) > 3:
        return None
    if (code == "1" or not code) and len(own) == 10:  # area and exchange begin with 2-9
        if own[0] in "01" or own[3] in "01":
            return None
        v = [int(own[0]) - 2, int(own[1:3]), int(own[3]) - 2, int(own[4:])]
        a, b, c, d = mixed(key, "phone1", v, [8, 100, 8, 1_000_000])
        return refill(text, code + f"{a + 2}{b:02d}{c + 2}{d:06d}")
    if not code:
        return None
    return refill(text, code + f"{permute(key, f'phone{code}', int(own), 10 ** len(own)):0{len(own)}d}")


def ip(key: bytes, text: str) -> str | None:
    parts = text.split(".")
    if any(len(p) > 1 and p[0] == "0" or int(p) > 255 for p in parts) or not 1 <= int(parts[0]) <= 223:
        return None
    a, b, c, d = mixed(key, "ip", [int(parts[0]) - 1, *map(int, parts[1:])], [223, 256, 256, 256])
    return f"{a + 1}.{b}.{c}.{d}"


def ssn(key: bytes, text: str) -> str | None:
    a, b, c = map(int, text.split("-"))
    if a in (0, 666) or a > 899 or not b or not c:
        return None
    a, b, c = mixed(key, "ssn", [a - 1 - (a > 666), b - 1, c - 1], [898, 99, 9999])
    return f"{a + 1 + (a >= 665):03d}-{b + 1:02d}-{c + 1:04d}"


def iban_rest(country: str, check: str, own: str) -> int:
    return int("".join(str(int(c, 36)) for c in own + country + check)) % 97


def iban(key: bytes, text: str) -> str | None:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or iban_rest(plain[:2], plain[2:4], plain[4:]) != 1:
        return None
    own = alike(key, f"iban{plain[:2]}", plain[4:])
    new = iter(plain[:2] + f"{98 - iban_rest(plain[:2], '00', own):02d}" + own)
    return "".join(c if c == " " else next(new) for c in text)


@lru_cache(maxsize=16)
def days_of(day_width: int, month_width: int, day_above: int) -> list[int]:
    """The days that can be written so: one digit holds no more than 9."""
    fits = lambda d: (day_width == 2 or d.day <= 9) and (month_width == 2 or d.month <= 9) and d.day > day_above
    return [n for n in range(DAYS) if fits(date.fromordinal(FIRST_DAY + n))]


def day(key: bytes, y: str, m: str, d: str, above: int = 0) -> tuple[str, str, str] | None:
    """The day that this one is permuted to among those of the same format, as (year, month, day)
    with as many digits each."""
    try:
        n = date(int(y), int(m), int(d)).toordinal() - FIRST_DAY
    except ValueError:
        return None
    of = days_of(len(d), len(m), above)
    at = bisect_left(of, n)
    if not 0 <= n < DAYS or at == len(of) or of[at] != n:
        return None
    whole = len(of) == DAYS
    new = date.fromordinal(FIRST_DAY + of[permute(key, "day" if whole else f"day{len(d)}{len(m)}{above}", at, len(of))])
    return f"{new.year:04d}", f"{new.month:0{len(m)}d}", f"{new.day:0{len(d)}d}"


def iso(key: bytes, text: str) -> str | None:
    new = day(key, *text.split("-"))
    return new and "-".join(new)


def dmy(key: bytes, text: str) -> str | None:
    d, m, y = text.split(".")
    new = day(key, y, m, d)
    return new and ".".join(new[::-1])


def mdy(key: bytes, text: str) -> str | None:
    """Month first; day first only where the day is no month, and among such days."""
    a, b, y = text.split("/")
    if new := day(key, y, a, b):
        return "/".join((new[1], new[2], new[0]))
    new = day(key, y, b, a, above=12)
    return new and "/".join(new[::-1])


KINDS = {"card": card, "phone": phone, "ip": ip, "ssn": ssn, "iban": iban, "iso": iso, "dmy": dmy, "mdy": mdy}


def pseudonym(key: bytes, kind: str, value: str) -> str | None:
    """None for a value that doesn't validate."""
    known = kept("pii", None, dict)
    if (key, kind, value) not in known:
        if len(known) >= CACHE:
            known.clear()
        known[key, kind, value] = made(key, kind, value)
    return known[key, kind, value]


def made(key: bytes, kind: str, value: str) -> str | None:
    if kind == "email":
        local, at, domain = value.partition("@")
        return alike(key, "email@" + domain.lower(), local) + at + domain
    return KINDS[kind](key, value)


def pseudonymise(text: str, key: bytes = DEFAULT_KEY) -> tuple[str, int]:
    """The text, and how many values were replaced."""
    count = 0

    def swap(kind: str, value: str) -> str:
        nonlocal count
        new = pseudonym(key, kind, value)
        count += new is not None
        return value if new is None else new

    emails = [m.span() for m in EMAIL.finditer(text)] if "@" in text else []
    if not emails and not LIKELY.search(text):
        return text, 0
    out, at = [], 0
    for a, b in [*emails, (len(text), len(text))]:
        for m in NUMBER.finditer(text, at, a):  # between addresses; what stands before ``at`` is still seen
            out += [text[at : m.start()], swap(next(k for k in (*KINDS,) if m[k]), m[0])]
            at = m.end()
        out += [text[at:a], swap("email", text[a:b]) if b > a else ""]
        at = b
    return "".join(out), count


def pii(docs: DataFrame, text_col: str = "text", key: bytes = DEFAULT_KEY, count_col: str | None = None) -> DataFrame:
    """``docs`` with pseudonyms in ``text_col`` (and the number of them in ``count_col``)."""
    def swapped(text: pd.Series) -> pd.DataFrame:
        found = [(None, 0) if t is None else pseudonymise(t, key) for t in text]
        return pd.DataFrame({"text": pd.Series([t for t, _ in found], dtype=object), "n": [n for _, n in found]})

    @F.pandas_udf("text string, n bigint")
    def swap(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        kept("pii", None, dict)
        yield from released(map(swapped, texts))

    (new,) = fresh(docs, "_new")
    rows = docs.select(*[col(c) for c in docs.columns], swap(col(text_col)).alias(new))
    out = [F.col(f"`{new}`.text").alias(c) if c == text_col else col(c) for c in docs.columns]
    return rows.select(*out, *([F.col(f"`{new}`.n").alias(count_col)] if count_col else []))


def pii_report(docs: DataFrame) -> DataFrame:
    """doc_id, the text with pseudonyms, and their number."""
    return pii(docs.select("doc_id", "text"), count_col="n_values")
