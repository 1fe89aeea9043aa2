"""Format-preserving pseudonyms by keyed Feistel networks.

A value that is found and validated is turned into a number of its format's
domain, permuted there by the key, and written back in the format.  The
permutation is the same for all documents, so equal values stay linked, and it
has an inverse, so no two values become one.

==========  ===============================================================
card        13 to 19 digits, or 4 groups of 4, that pass Luhn; so does the pseudonym
iban        two letters, check digits, 11 to 30 letters and digits, mod 97 = 1
phone       +1 (ddd) ddd-dddd or ddd-ddd-dddd
ip          four numbers up to 255
date        yyyy-mm-dd, dd.mm.yyyy or mm/dd/yyyy that exists, from 1900 to 2099
email       letters and digits of the local part, by class; the domain stays
secret      32 to 64 hexadecimal digits with a letter and a digit
==========  ===============================================================

The Feistel network has ten rounds over an even number of bits, with
HMAC-SHA-256 as the round function; values outside the domain are permuted on
until they are inside (cycle walking).  Domain and format go into the rounds,
so formats don't share permutations.

Null texts stay null and have no values; nothing else changes in a text.
Repeated rows get the same pseudonyms.  Extra columns are ignored.  Texts are
searched whole, however long; no rows give no rows.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import freed, rows

ROUNDS = 10
KINDS = ("card", "iban", "phone", "ip", "date", "email", "secret")
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

#: All kinds but addresses.
_FOUND = re.compile(
    r"""(?P<iban>\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b)
    |(?P<secret>\b(?=[0-9a-f]*[a-f])(?=[0-9a-f]*[0-9])[0-9a-f]{32,64}\b)
    |(?P<phone>\+1\ \([0-9]{3}\)\ [0-9]{3}-[0-9]{4}(?![0-9])|\b[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-]))
    |(?P<ip>\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9]))
    |(?P<date>\b(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9]))
    |(?P<card>\b(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{13,19})(?![0-9]))""",
    re.VERBOSE | re.ASCII,
)
#: What follows the local part of an address.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", re.ASCII)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A local part begins with a letter or digit at the start of a word.
_FIRST = re.compile(r"\b[A-Za-z0-9]", re.ASCII)


def _address(text: str, at: int) -> tuple[int, int] | None:
    """The first address that begins at ``at`` or later.

    Looked for from its @, so each stretch of text is read once, however many
    words could begin a local part.
    """
    low, sign = at, text.find("@", at)
    while sign >= 0:
        if domain := _DOMAIN.match(text, sign):
            lo = sign
            while lo > low and text[lo - 1] in _LOCAL:
                lo -= 1
            if first := _FIRST.search(text, lo, sign):
                return first.start(), domain.end()
        low, sign = sign + 1, text.find("@", sign + 1)
    return None


def found(text: str) -> Iterator[tuple[str, int, int]]:
    """Kind, start and end of what looks like a value, from left to right without overlaps; of two that begin together, the address."""
    at = 0
    address, other = _address(text, 0), _FOUND.search(text)
    while address or other:
        if address and (not other or address[0] <= other.start()):
            kind, (lo, hi) = "email", address
        else:
            kind, lo, hi = other.lastgroup, *other.span()
        yield kind, lo, hi
        at = hi
        if address and address[0] < at:
            address = _address(text, at)
        if other and other.start() < at:
            other = _FOUND.search(text, at)


class Permutation:
    """A keyed permutation of 0 .. size-1."""

    def __init__(self, key: bytes, name: str, size: int):
        self.size = size
        self.half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
        self.keys = [hmac.new(key, f"{name}:{size}:{r}".encode(), hashlib.sha256).digest() for r in range(ROUNDS)]

    def _round(self, r: int, x: int) -> int:
        n = (self.half + 7) // 8
        out, block = b"", 0
        while len(out) < n:
            out += hmac.digest(self.keys[r], block.to_bytes(2, "big") + x.to_bytes(n, "big"), "sha256")
            block += 1
        return int.from_bytes(out[:n], "big") & ((1 << self.half) - 1)

    def _once(self, x: int, rounds: range) -> int:
        a, b = x >> self.half, x & ((1 << self.half) - 1)
        if rounds.step > 0:
            for r in rounds:
                a, b = b, a ^ self._round(r, b)
        else:
            for r in rounds:
                a, b = b ^ self._round(r, a), a
        return a << self.half | b

    def _walk(self, x: int, rounds: range) -> int:
        x = self._once(x, rounds)
        while x >= self.size:
            x = self._once(x, rounds)
        return x

    def apply(self, x: int) -> int:
        return self._walk(x, range(ROUNDS))

    def undo(self, x: int) -> int:
        return self._walk(x, range(ROUNDS - 1, -1, -1))


def luhn(digits: str) -> int:
    """The check digit that follows ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _iban_check(country: str, body: str) -> str:
    number = int("".join(str(int(c, 36)) for c in body + country + "00"))
    return f"{98 - number % 97:02d}"


_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_CLASS = {c: a for a in _ALPHABETS for c in a}


def _refill(template: str, chars: str) -> str:
    """``template`` with its letters and digits replaced by ``chars``, in order."""
    it = iter(chars)
    return "".join(next(it) if c in _CLASS else c for c in template)


class Pseudonyms:
    def __init__(self, key: bytes):
        self.key = key
        self.permutation = lru_cache(4096)(lambda name, size: Permutation(key, name, size))
        self.replaced = lru_cache(100_000)(self._replaced)

    def _permuted(self, name: str, value: int, size: int, back: bool) -> int:
        p = self.permutation(name, size)
        return p.undo(value) if back else p.apply(value)

    def _by_class(self, name: str, text: str, back: bool, alphabets: dict[str, str] = _CLASS) -> str:
        """Letters and digits permuted together, each within its class."""
        chars = [c for c in text if c in alphabets]
        value, size = 0, 1
        for c in chars:
            a = alphabets[c]
            value, size = value * len(a) + a.index(c), size * len(a)
        shape = "".join(str(len(alphabets[c])) + "." for c in chars)
        value = self._permuted(f"{name}:{shape}", value, size, back)
        out = []
        for c in reversed(chars):
            value, d = divmod(value, len(alphabets[c]))
            out.append(alphabets[c][d])
        return _refill(text, "".join(reversed(out)))

    def _replaced(self, kind: str, text: str, back: bool) -> str | None:
        """The pseudonym, or the value of a pseudonym; None if it isn't valid."""
        if kind == "card":
            digits = "".join(c for c in text if c.isdigit())
            if luhn(digits[:-1]) != int(digits[-1]):
                return None
            n = len(digits) - 1
            own = f"{self._permuted('card', int(digits[:-1]), 10**n, back):0{n}d}"
            return _refill(text, own + str(luhn(own)))
        if kind == "iban":
            country, check, body = text[:2], text[2:4], text[4:]
            if _iban_check(country, body) != check:
                return None
            own = self._by_class(f"iban:{country}", body, back)
            return country + _iban_check(country, own) + own
        if kind == "phone":
            head = "+1" if text[0] == "+" else ""
            return head + self._by_class("phone", text[len(head) :], back)
        if kind == "ip":
            parts = text.split(".")
            if any(int(x) > 255 or (len(x) > 1 and x[0] == "0") for x in parts):
                return None
            value = self._permuted("ip", int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, back)
            return ".".join(map(str, value.to_bytes(4, "big")))
        if kind == "date":
            shape = "%Y-%m-%d" if text[4] == "-" else "%d.%m.%Y" if text[2] == "." else "%m/%d/%Y"
            try:
                day = datetime.datetime.strptime(text, shape).date().toordinal()
            except ValueError:
                return None
            if not FIRST_DAY <= day <= LAST_DAY:
                return None
            day = FIRST_DAY + self._permuted("date", day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, back)
            d = datetime.date.fromordinal(day)
            parts = {"%Y": f"{d.year:04d}", "%m": f"{d.month:02d}", "%d": f"{d.day:02d}"}
            return re.sub("%[Ymd]", lambda m: parts[m[0]], shape)
        if kind == "email":
            local, at, domain = text.partition("@")
            return self._by_class("email", local, back) + at + domain
        return self._by_class("secret", text, back, dict.fromkeys("0123456789abcdef", "0123456789abcdef"))

    def text(self, text: str, back: bool = False) -> tuple[str, dict[str, int]]:
        counts: dict[str, int] = {}
        out, at = [], 0
        for kind, lo, hi in found(text):
            new = self.replaced(kind, text[lo:hi], back)
            if new is not None:
                counts[kind] = counts.get(kind, 0) + 1
                out += [text[at:lo], new]
                at = hi
        return "".join([*out, text[at:]]), counts


def pseudonymise(docs: DataFrame, key: bytes, doc_id: str = "doc_id", text: str = "text", back: bool = False) -> DataFrame:
    """Rows doc_id, text with pseudonyms, and how many values of each kind were replaced.

    ``back`` with the same key restores the values.
    """
    body = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = body.schema["doc_id"].dataType.simpleString()

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pseudonyms(key)
        for batch in batches:
            ids, column = rows(batch, ["doc_id", "text"])
            for lo in range(0, len(column), 256):
                part = column.slice(lo, 256)
                # All kinds hold a digit or an @; other texts aren't searched.
                some = pc.match_substring_regex(part, "[0-9@]").fill_null(False).to_pylist()
                got = [own.text(t, back) if m else (t, {}) for t, m in zip(part.to_pylist(), some, strict=True)]
                counts = [pa.array([c.get(k, 0) for _, c in got], pa.int64()) for k in KINDS]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, 256), pa.array([t for t, _ in got], pa.string()), *counts], names=["doc_id", "text", *(f"n_{k}" for k in KINDS)])

    return body.mapInArrow(freed(replace), f"doc_id {kind}, text string, " + ", ".join(f"n_{k} long" for k in KINDS))
