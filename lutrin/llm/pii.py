"""Personal data replaced by format-preserving pseudonyms.

A value that a detector finds and validates is permuted within its own format by a keyed Feistel network, so equal values
get equal pseudonyms in all documents, different ones different, and the key's holder can invert them. Values are equal however they
are written: phone numbers, cards and IBANs whatever separates their digits, e-mail addresses in any case. Card numbers keep the Luhn check,
IBANs their check digits, dates stay dates, social security numbers stay of areas and groups that are given out, phone numbers keep
their country's code, e-mail addresses their last domain.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructField, StructType

from .common import fresh, others

ROUNDS = 8
FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
DAYS = datetime.date(2100, 1, 1).toordinal() - FIRST_DAY


class Feistel:
    """Keyed permutations of 0..n-1, one for each format (tweak)."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tweak: bytes, i: int, x: int, bits: int) -> int:
        data = b"%d|%d|%d|" % (i, bits, x) + tweak
        return int.from_bytes(hashlib.blake2b(data, key=self.key[:64], digest_size=(bits + 7) // 8).digest(), "big") & ((1 << bits) - 1)

    def permute(self, x: int, n: int, tweak: bytes, inverse: bool = False) -> int:
        """A balanced network over the next even number of bits, walked until the value is below n again."""
        half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
        if n <= 1:
            return x
        mask = (1 << half) - 1
        while True:
            a, b = x >> half, x & mask
            for i in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
                if inverse:
                    a, b = b ^ self._round(tweak, i, a, half), a
                else:
                    a, b = b, a ^ self._round(tweak, i, b, half)
            x = a << half | b
            if x < n:
                return x

    def text(self, value: str, tweak: bytes, inverse: bool = False) -> str:
        """Digits stay digits, lower-case letters such, capitals such; other characters stay as they are."""
        sizes = [10 if "0" <= c <= "9" else 26 if "a" <= c <= "z" or "A" <= c <= "Z" else 1 for c in value]
        base = [ord("0") if "0" <= c <= "9" else ord("a") if "a" <= c <= "z" else ord("A") if s == 26 else ord(c) for c, s in zip(value, sizes, strict=True)]
        x, n = 0, 1
        for c, s, b in zip(value, sizes, base, strict=True):
            x, n = x * s + ord(c) - b, n * s
        shape = "".join("x" if s > 1 else c for c, s in zip(value, sizes, strict=True)).encode() + bytes(s for s in sizes)
        x = self.permute(x, n, tweak + shape, inverse)
        out = []
        for s, b in zip(reversed(sizes), reversed(base), strict=True):
            x, r = divmod(x, s)
            out.append(chr(b + r))
        return "".join(reversed(out))


def luhn(digits: str) -> int:
    """The sum modulo 10 that is 0 for valid numbers."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 * (d > 9)
    return total % 10


def iban_rest(value: str) -> int:
    moved = value[4:] + value[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97


def refill(pattern: str, digits: str) -> str:
    """The pattern with its alphanumeric characters replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isalnum() else c for c in pattern)


def _date(value: str, parts: tuple[str, str, str]) -> datetime.date | None:
    y, m, d = (int(x) for x in parts)
    try:
        day = datetime.date(y, m, d)
    except ValueError:
        return None
    return day if FIRST_DAY <= day.toordinal() < FIRST_DAY + DAYS else None


#: The written forms that are looked for, the more specific first. Prefilter: without a digit or @ nothing matches.
FORMS = re.compile(
    r"""(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9]))
|(?P<secret>(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|ghp_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64}|(?=[a-f]*[0-9])[0-9a-f]{40}|(?=[a-f]*[0-9])[0-9a-f]{64}|(?=[a-f]*[0-9])[0-9a-f]{32})(?![A-Za-z0-9]))
|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))
|(?P<iso>(?<![0-9.-])(?P<iy>[0-9]{4})(?P<is>[-/.])(?P<im>[0-9]{2})(?P=is)(?P<id>[0-9]{2})(?![0-9]))
|(?P<dmy>(?<![0-9./-])(?P<da>[0-9]{2})(?P<ds>[-/.])(?P<db>[0-9]{2})(?P=ds)(?P<dy>[0-9]{4})(?![0-9]))
|(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))
|(?P<ip>(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9]))
|(?P<card>(?<![A-Za-z0-9.-])(?!00)[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z]))
|(?P<phone>(?<![A-Za-z0-9.,+-])(?:00[1-9][0-9]{0,2}(?:[ .-][0-9]{1,4}){2,6}|0[1-9](?:[ .-][0-9]{2}){4}|0[1-9][0-9]{1,3}[ /-][0-9]{5,8})(?![0-9A-Za-z])|(?<![A-Za-z0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9A-Za-z])|(?<![A-Za-z0-9])\+[0-9]{1,3}[ .-]?[0-9]{1,4}(?:[ .-]?[0-9]{2,4}){1,5}(?![0-9A-Za-z]))""",
    re.VERBOSE,
)
#: Country codes of two digits; 1 and 7 have one, all others three.
TWO_DIGIT_CODES = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
ANY = re.compile(r"[0-9@]")
KINDS = ("email", "secret", "iban", "iso", "dmy", "ssn", "ip", "card", "phone")


class Pseudonyms:
    def __init__(self, key: bytes):
        self.feistel = Feistel(key)

    def value(self, kind: str, x: str, m: re.Match | None = None, inverse: bool = False) -> str | None:
        """The pseudonym, or None if the value isn't valid."""
        f, tweak = self.feistel, kind.encode()
        m = m or FORMS.fullmatch(x)
        if kind == "email":
            local, _, domain = x.partition("@")
            host, _, last = domain.rpartition(".")
            return f"{self._cased(local, b'email', inverse)}@{self._cased(host, b'host', inverse)}.{last}"
        if kind == "secret":
            if x[:4] in ("AKIA", "ghp_"):
                return x[:4] + f.text(x[4:], x[:4].encode(), inverse)
            if x[:3] == "sk-":
                return x[:3] + f.text(x[3:], b"sk-", inverse)
            return f"{f.permute(int(x, 16), 16 ** len(x), b'hex', inverse):0{len(x)}x}"
        if kind == "iban":
            flat = x.replace(" ", "")
            if not 15 <= len(flat) <= 34 or iban_rest(flat) != 1:
                return None
            new = flat[:2] + "00" + f.text(flat[4:], flat[:2].encode(), inverse)
            return refill(x, new[:2] + f"{98 - iban_rest(new):02d}" + new[4:])
        if kind in ("iso", "dmy"):
            a, b = (m["im"], m["id"]) if kind == "iso" else (m["db"], m["da"])
            day = _date(x, ((m["iy"] if kind == "iso" else m["dy"]), a, b))
            swapped = day is None and kind == "dmy"
            if swapped:  # month first
                day = _date(x, (m["dy"], m["da"], m["db"]))
            if day is None:
                return None
            # Days that read the same in either order are permuted among themselves, so that the order stays readable; in every form alike, so
            # that equal dates stay so.
            new = day
            while True:
                new = datetime.date.fromordinal(FIRST_DAY + f.permute(new.toordinal() - FIRST_DAY, DAYS, b"date", inverse))
                if (new.day > 12) == (day.day > 12):
                    break
            sep = m["is"] if kind == "iso" else m["ds"]
            if kind == "iso":
                return new.strftime("%Y") .rjust(4, "0") + f"{sep}{new.month:02d}{sep}{new.day:02d}"
            return f"{new.month:02d}{sep}{new.day:02d}{sep}{new.year:04d}" if swapped else f"{new.day:02d}{sep}{new.month:02d}{sep}{new.year:04d}"
        if kind == "ip":
            parts = x.split(".")
            if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
                return None
            n = int.from_bytes(bytes(map(int, parts)), "big")
            return ".".join(map(str, f.permute(n, 1 << 32, tweak, inverse).to_bytes(4, "big")))
        if kind == "card":
            flat = re.sub("[ -]", "", x)
            if not 13 <= len(flat) <= 19 or luhn(flat) or len(set(flat)) == 1:
                return None
            new = f.text(flat[:-1], tweak, inverse)
            while new[:2] == "00":  # that begins a number abroad
                new = f.text(new, tweak, inverse)
            return refill(x, new + str(-luhn(new + "0") % 10))
        if kind == "ssn":
            area, group, serial = map(int, x.split("-"))
            if area in (0, 666) or area >= 900 or not group or not serial:
                return None
            n = f.permute(((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, tweak, inverse)
            area, group, serial = n // 9999 // 99 + 1, n // 9999 % 99 + 1, n % 9999 + 1
            return f"{area + (area >= 666):03d}-{group:02d}-{serial:04d}"
        flat = re.sub("[^0-9]", "", x)
        # What stays: a country's code, with + or 00 before it, or the 0 that stands for it within the country.
        abroad = flat[2:] if flat[:2] == "00" else flat if x[0] == "+" else ""
        code = len(flat) - len(abroad) + (1 if abroad[0] in "17" else 2 if abroad[:2] in TWO_DIGIT_CODES else 3) if abroad else int(flat[0] == "0")
        size = len(flat) - code
        if not 7 <= size <= 15:
            return None
        n = int(flat[code:])
        while True:  # a number that begins with 0 keeps doing so, and another doesn't begin to
            n = f.permute(n, 10**size, b"phone%d" % size, inverse)
            if (n < 10 ** (size - 1)) == (flat[code] == "0"):
                return refill(x, f"{flat[:code]}{n:0{size}d}")

    def _cased(self, x: str, tweak: bytes, inverse: bool) -> str:
        """Letters are permuted as lower-case ones and written in the case of those at their places."""
        new = self.feistel.text(x.lower(), tweak, inverse)
        return "".join(b.upper() if a.isupper() else b for a, b in zip(x, new, strict=True))

    def replace(self, text: str, inverse: bool = False) -> tuple[str, list[str]]:
        """The text with pseudonyms, and the kinds found in their order."""
        if not ANY.search(text):
            return text, []
        kinds: list[str] = []
        out, at, start = [], 0, 0
        while m := FORMS.search(text, start):
            kind = next(k for k in KINDS if m[k] is not None)
            new = self.value(kind, m[0], m, inverse)
            if new is None:  # a shorter match from here, or another kind, may be valid
                start = m.start() + 1
                other = self._shorter(kind, m[0], m.start(), inverse)
                other = other or next((y for k in KINDS[KINDS.index(kind) + 1 :] if (y := self._at(k, text, m.start(), inverse))), None)
                if other is None:
                    continue
                kind, end, new = other
            else:
                end = m.end()
            kinds.append(kind)
            out += [text[at : m.start()], new]
            at = start = end
        return "".join([*out, text[at:]]), kinds

    def _at(self, kind: str, text: str, at: int, inverse: bool = False) -> tuple[str, int, str] | None:
        m = SINGLE[kind].match(text, at)
        if not m:
            return None
        new = self.value(kind, m[0], m, inverse)
        return (kind, m.end(), new) if new is not None else self._shorter(kind, m[0], at, inverse)

    def _shorter(self, kind: str, x: str, at: int, inverse: bool = False) -> tuple[str, int, str] | None:
        """The longest valid part of a card's or IBAN's match that begins with it and ends where one of its groups does."""
        if kind not in ("card", "iban"):
            return None
        for end in reversed([i for i, c in enumerate(x) if c in " -"]):
            new = self.value(kind, x[:end], inverse=inverse) if SINGLE[kind].fullmatch(x, 0, end) else None
            if new is not None:
                return kind, at + end, new
        return None


def _single(kind: str) -> re.Pattern:
    lines = [x.removeprefix("|") for x in FORMS.pattern.split("\n")]
    return re.compile(next(x for x in lines if x.startswith(f"(?P<{kind}>")), re.VERBOSE)


SINGLE = {k: _single(k) for k in KINDS}


def pseudonymise(df: DataFrame, key: bytes, text: str = "text", out: str = "text") -> DataFrame:
    """df with the text's personal data replaced (column ``out``, by default in place), ``pii_kinds`` (array, in order of place).

    Null stays null with no kinds, empty stays empty. Rows are independent: ties, repeated rows and empty tables need nothing
    special. A column of df named pii_kinds, or as ``out``, in any case, is replaced; all others stay.
    """
    source = fresh(df, "text")
    new = StructField(out, T.StringType())
    order = [new if f.name.lower() == out.lower() else f for f in others(df, ("pii_kinds",))]
    if new not in order:
        order.append(new)
    schema = StructType([*order, StructField("pii_kinds", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key)
        for batch in batches:
            made = [(None, []) if x is None else names.replace(x) for x in batch.column(source).to_pylist()]
            new = pa.array([x for x, _ in made], pa.string())
            yield pa.RecordBatch.from_arrays([*(new if f.name == out else batch.column(f.name) for f in order), pa.array([k for _, k in made], pa.list_(pa.string()))], names=schema.fieldNames())

    keep = [F.col(f"`{f.name}`") for f in order if f.name != out]
    return df.select(*keep, F.col(f"`{text}`").cast("string").alias(source)).mapInArrow(run, schema)
