"""Format-preserving pseudonyms: validated numbers, dates and addresses under a keyed Feistel permutation.

A value is changed only where it passes its own check (card and account check digits, real dates, number
ranges); its free digits go through a keyed permutation of their format's whole domain and check digits are
computed anew. Equal values get equal pseudonyms in every document, different ones different pseudonyms, and no
table of values is kept or exchanged.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
FIRST, LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
KINDS = ("email", "iban", "card", "ssn", "phone", "ip", "date")

_PATTERNS = {
    "email": r"(?P<email>[^\W_](?:[\w.+-]*\w)?@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)",
    "iban": r"(?<![\w])(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?!\w)",
    "ip": r"(?<![\w.])(?P<ip>\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?![\w]|\.\d)",
    "date": r"(?<![\w/.-])(?P<date>\d{4}-\d\d-\d\d|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\w/]|[.-]\d)",
    "ssn": r"(?<![\w-])(?P<ssn>\d{3}-\d\d-\d{4})(?![\w]|-\d)",
    "card": r"(?<![\w.,-])(?P<card>\d(?:[ -]?\d){12,18})(?![\w]|[.,-]\d)",
    "phone": r"(?<![\w])(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w]|-\d)",
}
_FIND = re.compile("|".join(_PATTERNS.values()))
#: For a place where the first kind fails its check.
_EACH = {kind: re.compile(p) for kind, p in _PATTERNS.items()}
_DIGITS = re.compile(r"\d")
#: Characters of an account number by country.
IBAN_LENGTH = {c: int(x[:2]) for x in (
    "15 NO", "16 BE", "18 DK FI FO GL NL", "19 MK SI", "20 AT BA EE KZ LT LU XK", "21 CH HR LI LV", "22 BG BH CR DE GB GE IE ME RS VA", "23 AE GI IL IQ TL",
    "24 AD CZ ES MD PK RO SA SE SK TN VG", "25 LY PT ST", "26 IS TR", "27 FR GR IT MC MR SM", "28 AL AZ BY CY DO GT HU LB PL", "29 BR EG PS QA UA", "30 JO KW MU", "31 MT SC", "32 LC",
) for c in x[3:].split()}


def luhn(digits: str) -> int:
    """The Luhn sum of ``digits`` modulo 10; 0 if the last one is a right check digit."""
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10


def mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


class Pseudonyms:
    """Keyed permutations of whole formats."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.known: dict[tuple[str, str], str] = {}

    def permute(self, x: int, size: int, tweak: str) -> int:
        """A keyed permutation of range(size): alternating Feistel on two factors, walked until it is in range."""
        if size < 2:
            return x
        a = math.isqrt(size - 1) + 1
        b = -(-size // a)
        while True:
            left, right = divmod(x, b)
            for k in range(ROUNDS):
                f = lambda v: int.from_bytes(hashlib.blake2b(f"{tweak}|{size}|{k}|{v}".encode(), key=self.key, digest_size=16).digest(), "big")  # noqa: E731, B023
                if k % 2:
                    right = (right + f(left)) % b
                else:
                    left = (left + f(right)) % a
            x = left * b + right
            if x < size:
                return x

    def digits(self, digits: str, tweak: str) -> str:
        return str(self.permute(int(digits), 10 ** len(digits), tweak)).zfill(len(digits)) if digits else ""

    def letters(self, text: str, tweak: str) -> str:
        x = 0
        for c in text:
            x = 26 * x + ord(c) - 97
        x, out = self.permute(x, 26 ** len(text), tweak), ""
        for _ in text:
            x, c = divmod(x, 26)
            out = chr(97 + c) + out
        return out

    def refilled(self, shape: str, digits: str) -> str:
        it = iter(digits)
        return _DIGITS.sub(lambda _: next(it), shape)

    def email(self, s: str) -> str:
        local, domain = s.rsplit("@", 1)
        low = "".join(re.findall("[a-z]", local.lower()))
        new_letters, new_digits = iter(self.letters(low, f"email {domain.lower()}")), iter(self.digits("".join(re.findall(r"[0-9]", local)), f"email {domain.lower()} {low}"))
        return "".join(next(new_digits) if "0" <= c <= "9" else (lambda n: n.upper() if c.isupper() else n)(next(new_letters)) if c.isascii() and c.isalpha() else c for c in local) + "@" + domain

    def iban(self, s: str) -> str | None:
        bare = s.replace(" ", "")
        if not 15 <= len(bare) <= 34 or mod97(bare) != 1:
            return None
        body = self.refilled(bare[4:], self.digits("".join(_DIGITS.findall(bare[4:])), "iban " + _DIGITS.sub("#", bare[:2] + bare[4:])))
        new = iter(bare[:2] + f"{98 - mod97(bare[:2] + '00' + body):02d}" + body)
        return "".join(c if c == " " else next(new) for c in s)

    def card(self, s: str) -> str | None:
        bare = "".join(_DIGITS.findall(s))
        if luhn(bare) or len(set(bare)) == 1:
            return None
        body = self.digits(bare[:-1], f"card {len(bare)}")
        return self.refilled(s, body + str(-luhn(body + "0") % 10))

    def ssn(self, s: str) -> str | None:
        area, group, serial = map(int, s.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        areas = [n for n in range(1, 900) if n != 666]
        x = self.permute((areas.index(area) * 99 + group - 1) * 9999 + serial - 1, len(areas) * 99 * 9999, "ssn")
        x, serial = divmod(x, 9999)
        area, group = divmod(x, 99)
        return f"{areas[area]:03d}-{group + 1:02d}-{serial + 1:04d}"

    def phone(self, s: str) -> str | None:
        bare = _DIGITS.findall(s)
        if not 7 <= len(bare) <= 15:
            return None
        keep = len(re.match(r"\+(\d*)", s)[1]) if s[0] == "+" else 0
        return self.refilled(s, "".join(bare[:keep]) + self.digits("".join(bare[keep:]), f"phone {''.join(bare[:keep])} {len(bare)}"))

    def ip(self, s: str) -> str | None:
        parts = s.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        x = self.permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ip")
        return ".".join(map(str, x.to_bytes(4, "big")))

    def date(self, s: str) -> str | None:
        sep = next(c for c in s if not c.isdigit())
        p = s.split(sep)
        try:
            y, m, d = (int(p[0]), int(p[1]), int(p[2])) if sep == "-" else (int(p[2]), int(p[1]), int(p[0]))
            if sep == "/" and m > 12:  # month first
                m, d = d, m
            day = datetime.date(y, m, d).toordinal()
        except ValueError:
            return None
        if not FIRST <= day <= LAST:
            return None
        new = datetime.date.fromordinal(FIRST + self.permute(day - FIRST, LAST - FIRST + 1, "date"))
        if sep == "-":
            return new.isoformat()
        a, b = (new.month, new.day) if sep == "/" and int(p[1]) > 12 else (new.day, new.month)
        return f"{a:0{len(p[0])}d}{sep}{b:0{len(p[1])}d}{sep}{new.year:04d}"

    def new(self, kind: str, value: str) -> str:
        """The pseudonym of ``value``, empty where it fails its check."""
        new = self.known.get((kind, value))
        if new is None:
            if len(self.known) > 100_000:
                self.known.clear()
            new = self.known[kind, value] = getattr(self, kind)(value) or ""
        return new

    def replace(self, text: str) -> tuple[str, dict[str, int]]:
        """``text`` with pseudonyms and their counts by kind.

        Where a match fails its check, its shorter prefixes are tried, then the other kinds at this place; then the
        search goes on inside the match.
        """
        counts: dict[str, int] = {}
        out, done, at = [], 0, 0
        while m := _FIND.search(text, at):
            at, kind = m.start(), m.lastgroup
            tried = [(kind, m[0])]
            new = self.new(*tried[0])
            if not new:
                others = [(k, x[0]) for k, p in _EACH.items() if k != kind and (x := p.match(text, at))]
                tried = [(k, p) for k, v in (*tried, *others) for p in (v, *prefixes(k, v))]
            for kind, value in tried:  # noqa: B007
                if new := new or self.new(kind, value):
                    out += [text[done:at], new]
                    at = done = at + len(value)
                    counts[kind] = counts.get(kind, 0) + 1
                    break
            else:
                at += 1
        return "".join([*out, text[done:]]), counts


def prefixes(kind: str, value: str) -> Iterator[str]:
    """Shorter values that ``value`` may begin with, the longest first; each ends at a separator."""
    if kind not in ("card", "iban", "phone"):
        return
    for k in range(len(value) - 1, 0, -1):
        if value[k] not in " .-" or not value[k - 1].isalnum():
            continue
        n = sum(c.isalnum() for c in value[:k])
        if kind == "iban" and n == IBAN_LENGTH.get(value[:2], n) or kind == "card" and n >= 13 or kind == "phone" and _EACH["phone"].fullmatch(value[:k]):
            yield value[:k]


def pseudonymised(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text with pseudonyms, and n_<kind> for each of KINDS.

    Null text stays null with zero counts; a text without validated values comes back unchanged, whatever its length.
    Repeated rows and values get equal pseudonyms; ids may be null; other columns are ignored; an empty table
    gives no rows.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = Pseudonyms(key)
        for b in batches:
            done = [names.replace(t) if t else (t, {}) for t in b["text"]]
            out = pd.DataFrame({"id": b["id"].astype("Int64"), "text": [t for t, _ in done]})
            for kind in KINDS:
                out[f"n_{kind}"] = [n.get(kind, 0) for _, n in done]
            yield out

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return slim.mapInPandas(rows, "id long, text string, " + ", ".join(f"n_{k} int" for k in KINDS)).withColumnRenamed("id", id_col)
