"""Format-preserving pseudonyms for personal data.

Numbers and dates are found by pattern, validated, and permuted within their own format by a keyed Feistel
network, so equal values get equal pseudonyms in every document and different values stay different.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents, in_batches, slices

ROWS = 256
ROUNDS = 8
KINDS = ["email", "ip", "card", "phone", "date", "iban", "ipv6", "ssn"]
# Kinds whose form or check is strict: valid ones go first wherever they start, and phones are sought between them.
STRICT = {
    kind: re.compile(pattern)
    for kind, pattern in {
        "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
        "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
        "date": r"(?<![\w.+-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{4}\.\d{2}\.\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4}|\d{2}-\d{2}-\d{4})(?![\w-]|[./]\d)",
        "ssn": r"(?<![\w.+-])\d{3}-\d{2}-\d{4}(?![\w-]|[./]\d)",
        "ip": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w-]|\.\d)",
        "ipv6": r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:|:(?=:))(?:[0-9A-Fa-f]{0,4}:){1,6}[0-9A-Fa-f]{0,4}(?![\w:]|\.\d)",
        "card": r"(?<![\w.+-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-])",
    }.items()
}
FIND = re.compile("|".join(f"(?P<{kind}>{pattern.pattern})" for kind, pattern in STRICT.items()))
#: Ten digits in a row are a phone where they could be one of the North American plan.
BARE = r"(?<![\w.+-])[2-9]\d{2}[2-9]\d{6}(?![\w-]|\.\d)"
PHONE = re.compile(
    r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{2,4}(?:[ .-]\d{2,5}){1,3}(?![\w-])|(?<!\w)\+\d{7,15}(?!\w)"
    r"|(?<![\w.+-])(?:\+\d{1,3}[ .-]\(?\d{2,4}\)?|0\d{2,4})[ -]\d{6,8}(?![\w-]|\.\d)|" + BARE
)
# Joined by dots or hyphens alone but for a country code or an area in parentheses: spaces around it end the number.
COMPACT = re.compile(
    r"(?<![\w.])(?:\+\d{1,3}[ .-]?|1[.-])?(?:\(\d{2,4}\)[ .-]|\d{2,4}[.-])\d{2,4}(?:[.-]\d{2,5}){1,3}(?![\w-])"
)
#: Four digits before what may be a whole number: no country code is as long.
LED = re.compile(r"\d{4} (?=\d)")
# Country calling codes of one and of two digits; all others have three.
SHORT_CODES = ("1", "7")
CODES = (
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
).split()
#: Dates keep to their range of years, and whether the day is beyond the 12th: only then can the month come first.
YEARS = ((1, 1899), (1900, 2099), (2100, 9999))
#: Letters or digits of an address that are permuted as one number.
SEGMENT = 48
#: Most recent pseudonyms that a worker remembers.
REMEMBERED = 200_000


class Permutation:
    """Keyed permutations of 0 to n - 1 by an unbalanced Feistel network with cycle walking."""

    def __init__(self, key: bytes):
        self.key = key

    def noise(self, label: str, step: int, value: int, bits: int) -> int:
        """A number of 64 bits more than `bits`."""
        text = f"{label}:{step}:{value}".encode()
        parts = [hashlib.blake2b(text, key=self.key, digest_size=64, salt=k.to_bytes(2, "big")).digest() for k in range(-(-(bits + 64) // 512))]
        return int.from_bytes(b"".join(parts), "big")

    def of(self, label: str, n: int, value: int) -> int:
        """Where value goes; label separates the permutations of different formats."""
        if n < 2:
            return value
        a = max(2, math.isqrt(n - 1) + 1)
        b = -(-n // a)
        bits = a.bit_length()
        while True:
            left, right = divmod(value, b)
            for step in range(ROUNDS):
                if step % 2:
                    right = (right + self.noise(label, step, left, bits)) % b
                else:
                    left = (left + self.noise(label, step, right, bits)) % a
            value = left * b + right
            if value < n:
                return value


class Days:
    """The days of a range of years beyond the 12th of a month, numbered."""

    def __init__(self, first: int, last: int):
        year, month = np.divmod(np.arange((last - first + 1) * 12), 12)
        year, month = year + first, month + 1
        leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
        long = np.where(month == 2, 28 + leap, np.where(np.isin(month, (4, 6, 9, 11)), 30, 31))
        self.first, self.up_to = first, np.cumsum(long - 12)

    def __len__(self) -> int:
        return int(self.up_to[-1])

    def number(self, d: datetime.date) -> int:
        m = (d.year - self.first) * 12 + d.month - 1
        return (int(self.up_to[m - 1]) if m else 0) + d.day - 13

    def day(self, n: int) -> datetime.date:
        m = int(np.searchsorted(self.up_to, n, side="right"))
        return datetime.date(self.first + m // 12, m % 12 + 1, n - (int(self.up_to[m - 1]) if m else 0) + 13)


@lru_cache(maxsize=None)
def days_of(first: int, last: int) -> Days:
    return Days(first, last)


def luhn(digits: str) -> int:
    """The check sum of a card number: 0 if it is valid."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10


def fill(shape: str, digits: str) -> str:
    """shape with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


class Pseudonyms:
    def __init__(self, key: bytes):
        self.permute = Permutation(key).of
        self.known: dict[tuple[str, str], str | None] = {}

    def get(self, kind: str, value: str) -> str | None:
        """The pseudonym, or None if the value is not valid for its kind."""
        if (at := (kind, value)) not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[at] = getattr(self, kind)(value)
        return self.known[at]

    def number(self, label: str, digits: str) -> str:
        return str(self.permute(f"{label}{len(digits)}", 10 ** len(digits), int(digits))).zfill(len(digits))

    def card(self, value: str) -> str | None:
        """The issuer's first digit stays, the check digit is made valid again."""
        digits = only_digits(value)
        if luhn(digits) or len(set(digits)) == 1:
            return None
        body = digits[0] + self.number("card" + digits[0], digits[1:-1])
        return fill(value, body + str((10 - luhn(body + "0")) % 10))

    def phone(self, value: str) -> str | None:
        """Country code and zeros stay, the national number is permuted: the same in every spelling, with a code or without.

        The code follows from the digits after + or 00, or is the 1 before ten digits. Numbers have 9 to 15 digits with
        a code, or 10 to 15 without.
        """
        digits = only_digits(value)
        lead = "" if value[0] == "+" else "00" if digits.startswith("00") else None
        if lead is None:
            code = "1" if len(digits) == 11 and digits[0] == "1" else ""
            lead = ""
        else:
            rest = digits[len(lead) :]
            code = rest[0] if rest[:1] in SHORT_CODES else rest[:2] if rest[:2] in CODES else rest[:3]
        national = digits[len(lead) + len(code) :]
        if not (9 if value[0] == "+" else 10) <= len(digits) <= 15 or not national.strip("0"):
            return None
        bare = national.lstrip("0")
        zeros = national[: len(national) - len(bare)]
        return fill(value, lead + code + zeros + self.national(bare, len(digits) == 11 and not code and not zeros))

    def national(self, digits: str, other: bool) -> str:
        """A number that begins with no 0 as another; `other`: one of eleven digits that shall not begin with 1 either."""
        low = 10 ** (len(digits) - 1)
        n = int(digits)
        while True:
            n = low + self.permute(f"phone{len(digits)}", 9 * low, n - low)
            if not other or n >= 2 * low:
                return str(n)

    def ip(self, value: str) -> str | None:
        parts = value.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        n = 0
        for p in parts:
            n = n * 256 + int(p)
        n = self.permute("ip", 1 << 32, n)
        return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))

    def ipv6(self, value: str) -> str | None:
        """The shortest form; loopback and unspecified addresses name nobody."""
        try:
            n = int(ipaddress.IPv6Address(value))
        except ValueError:
            return None
        if n < 2:
            return None
        new = str(ipaddress.IPv6Address(2 + self.permute("ipv6", (1 << 128) - 2, n - 2)))
        return new.upper() if any("A" <= c <= "F" for c in value) else new

    def ssn(self, value: str) -> str | None:
        """Area, group and serial number within what is given out."""
        area, group, serial = map(int, value.split("-"))
        if area in (0, 666) or area > 899 or not group or not serial:
            return None
        n = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        n, serial = divmod(self.permute("ssn", 898 * 99 * 9999, n), 9999)
        area, group = divmod(n, 99)
        return f"{area + 1 + (area >= 665):03}-{group + 1:02}-{serial + 1:04}"

    def iban(self, value: str) -> str | None:
        """The country stays, digits and letters of the account keep their places, the check digits are made valid again."""
        plain = value.replace(" ", "")
        number = lambda x: int("".join(str(int(c, 36)) for c in x))
        if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
            return None
        country, account = plain[:2], plain[4:]
        account = self.classes(f"iban:{country}", account, "")
        check = 98 - number(account + country + "00") % 97
        it = iter(f"{country}{check:02}{account}")
        return "".join(" " if c == " " else next(it) for c in value)

    def date(self, value: str) -> str | None:
        """One permutation for all spellings: year first, or day and month around a mark in the order that is valid, day
        first if both are."""
        a, b, c = map(int, re.split(r"[-/.]", value))
        year_first = value[4:5] in "-/."
        orders = [(a, b, c)] if year_first else [(c, b, a), (c, a, b)]
        for k, (year, month, day) in enumerate(orders):
            try:
                d = datetime.date(year, month, day)
            except ValueError:
                continue
            first, last = next(y for y in YEARS if y[0] <= year <= y[1])
            if d.day > 12:
                days = days_of(first, last)
                d = days.day(self.permute(f"day{first}", len(days), days.number(d)))
            else:
                months = (last - first + 1) * 12
                m, n = divmod(self.permute(f"early{first}", months * 12, ((d.year - first) * 12 + d.month - 1) * 12 + d.day - 1), 12)
                d = datetime.date(first + m // 12, m % 12 + 1, n + 1)
            s = value[4] if year_first else value[2]
            parts = (f"{d.year:04}", f"{d.month:02}", f"{d.day:02}") if year_first else (f"{d.day:02}", f"{d.month:02}", f"{d.year:04}")
            return s.join(parts if year_first or k == 0 else (parts[1], parts[0], parts[2]))
        return None

    def classes(self, label: str, text: str, domain: str) -> str:
        """text with its letters and digits permuted class by class, SEGMENT of a class at a time."""
        out = list(text)
        for name, chars in (("lower", "abcdefghijklmnopqrstuvwxyz"), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", "0123456789")):
            every = [i for i, c in enumerate(text) if c in chars]
            rest = "".join("*" if c in chars else o for c, o in zip(text, out))
            for at in (every[k : k + SEGMENT] for k in range(0, len(every), SEGMENT)):
                n = 0
                for i in at:
                    n = n * len(chars) + chars.index(text[i])
                n = self.permute(f"{label}:{name}:{at[0]}:{rest}:{domain}", len(chars) ** len(at), n)
                for i in reversed(at):
                    n, k = divmod(n, len(chars))
                    out[i] = chars[k]
        return "".join(out)

    def email(self, value: str) -> str | None:
        """Letters and digits of the local part are permuted class by class; the domain stays."""
        local, _, domain = value.rpartition("@")
        return self.classes("email", local, domain.lower()) + "@" + domain


@lru_cache(maxsize=4)
def pseudonyms(key: bytes) -> Pseudonyms:
    return Pseudonyms(key)


def strict_spans(text: str, names: Pseudonyms) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of valid strict kinds, leftmost first. Where a match fails its check the other
    kinds are tried at its start, and the search goes on behind its first character; an account number that fails
    holds nothing else (its kind is empty)."""
    out, pos = [], 0
    while first := FIND.search(text, pos):
        pos = first.start() + 1
        for kind, pattern in STRICT.items():
            m = pattern.match(text, first.start())
            if m and (new := names.get(kind, m[0])) is not None:
                out.append((m.start(), m.end(), kind, new))
                pos = m.end()
                break
            if m and kind == "iban":
                out.append((m.start(), m.end(), "", m[0]))
                pos = m.end()
                break
    return out


def phone_spans(text: str, names: Pseudonyms, pattern: re.Pattern, taken: list) -> list[tuple[int, int, str, str]]:
    """Spans of valid phones of a pattern between the taken spans."""
    out, pos = [], 0
    for start, end in [(s, e) for s, e, _, _ in taken] + [(len(text), len(text))]:
        while m := pattern.search(text, pos, start):
            at = m.start()
            if (lead := LED.match(m[0])) and (rest := pattern.match(text, at + lead.end(), start)):
                if names.get("phone", rest[0]) is not None and not STRICT["card"].match(text, at):
                    m = rest
            new = names.get("phone", m[0])
            if new is not None:
                out.append((m.start(), m.end(), "phone", new))
                pos = m.end()
            else:  # the groups of a card that fails its check are no phones either
                card = STRICT["card"].match(text, at, start)
                pos = card.end() if card else at + 1
        pos = end
    return out


def replaced(text: str, names: Pseudonyms) -> tuple[str, list[tuple[str, int, int]]]:
    """text with pseudonyms, and the (kind, start, end) of what was replaced, in code points of the input."""
    found = strict_spans(text, names)
    for pattern in (COMPACT, PHONE):
        found = sorted(found + phone_spans(text, names, pattern, found))
    found = [x for x in found if x[2]]
    out, at = [], 0
    for start, end, _, new in found:
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]]), [(kind, start, end) for start, end, kind, _ in found]


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, counts by kind, spans (kind:start:end, code points of the input) and the text with pseudonyms.

    A null text stays null and has no spans; numbers that fail their check (card and account sums, octets, calendar)
    stay as they are. Equal values have equal pseudonyms in all spellings of their kind, different ones different ones.
    Rows are independent: repeated rows and null doc_ids come back as given, an empty table gives no rows, and extra
    columns are ignored. The search of a long text takes time in proportion to it, and memory of its size.
    """
    counts = [f"n_{k}" for k in KINDS]
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in counts) + ", spans string, text string"

    def run(batches):
        names = pseudonyms(key)
        for batch in batches:
            for part in slices(batch, ROWS):
                found = [replaced(t or "", names) for t in part.column("text").to_pylist()]
                kinds = [[k for k, _, _ in spans] for _, spans in found]
                valid = part.column("text").is_valid().to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64())]
                    + [pa.array([x.count(k) for x in kinds], pa.int64()) for k in KINDS]
                    + [pa.array([",".join(f"{k}:{s}:{e}" for k, s, e in spans) for _, spans in found], pa.string())]
                    + [pa.array([t if ok else None for (t, _), ok in zip(found, valid)], pa.string())],
                    names=["doc_id", *counts, "spans", "text"],
                )

    return in_batches(docs).select("doc_id", "text").mapInArrow(run, schema)


def op9_pii(spark, sf_dir):
    """The key would come from a secret store in production; here it is fixed, so that runs agree."""
    return pseudonymise(documents(spark, sf_dir), b"voxloom pseudonym key, example")
