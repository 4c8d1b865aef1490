"""Format-preserving pseudonyms for personal data, by a keyed Feistel permutation.

Validated values (card numbers by Luhn, IBANs by mod 97, phone numbers, social security numbers, IPv4
addresses, calendar dates, e-mail addresses, secrets) are mapped to a number below the size N of their
format, permuted by a Feistel network with cycle walking, and written in the same format: same length, grouping,
letter case and a valid check digit; a date stays a date of 1900 to 2099 with as many digits in each field, and in the same order of
day and month. The permutation depends on the key and the format only, so equal values
stay equal across documents and whoever has the key can invert it. Digits that don't validate stay.

The key is the caller's. session_key() takes it from the session's setting KEY_CONF; where that is unset it draws a
random one for the session, so pseudonyms then link the documents of one session only and nobody can invert them later.

Where values overlap, secrets go before addresses, these before numbers, and numbers before IBANs.
Null texts stay null, empty texts empty; each has n_pii 0. Texts of any length are read whole. Repeated rows give repeated results; null doc_ids
are treated like any other; no rows give no rows. All columns of the input are kept, text is replaced; where they have the names of the
operator's own columns, underscores are added to these.
"""

from __future__ import annotations

import hashlib
import re
import secrets
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_names, mapped

ROUNDS = 8
KEY_CONF = "spark.stakeweave.pseudonyms.key"
NUMBER = re.compile(
    r"(?P<phone>\+\d{1,3}[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}|\+\d{1,3}(?:[ -]?\(\d{1,4}\))?(?:[ -]?\d{1,5}){2,5}|\(\d{2,5}\) ?\d{2,4}(?:[ .-]?\d{2,4}){1,2}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4})(?!\w)|(?P<date>\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\w])"
    r"|(?P<ip>\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?!\w)|(?P<card>\d{13,19}|\d{4}(?P<gap>[ -])\d{4}(?P=gap)\d{4}(?P=gap)\d{4}|\d{4}(?P<gap2>[ -])\d{6}(?P=gap2)\d{5})(?!\w)|\d+"
)
IBAN = re.compile(r"[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}(?![A-Za-z0-9])|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?(?![A-Za-z0-9]))")
SECRET = re.compile(r"[=:]\s*(?:\"(?P<secret>[0-9A-Za-z+/_-]{16,})\"|'(?P<single>[0-9A-Za-z+/_-]{16,})'|(?P<bare>[0-9A-Za-z+/_-]{16,})(?![\w+/=-]))")
EMAIL = re.compile(r"(?P<local>[\w.%+-]+)@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NAMED = ("token", "secret", "password", "passwd", "key")


class Feistel:
    """A keyed permutation of 0..size-1 for each format (tweak)."""

    def __init__(self, key: bytes, inverse: bool = False):
        self.key, self.inverse = hashlib.blake2b(key, digest_size=32).digest(), inverse

    def part(self, tweak: bytes, turn: int, x: int, bits: int) -> int:
        size = (bits + 7) // 8
        data = tweak + bytes([turn]) + x.to_bytes(size + 1, "big")
        out = b"".join(hashlib.blake2b(data, key=self.key, salt=i.to_bytes(2, "big")).digest() for i in range(size // 64 + 1))
        return int.from_bytes(out[:size], "big") & ((1 << bits) - 1)

    def once(self, x: int, half: int, tweak: bytes) -> int:
        a, b = x >> half, x & ((1 << half) - 1)
        for turn in reversed(range(ROUNDS)) if self.inverse else range(ROUNDS):
            if self.inverse:
                a, b = b ^ self.part(tweak, turn, a, half), a
            else:
                a, b = b, a ^ self.part(tweak, turn, b, half)
        return a << half | b

    def permute(self, x: int, size: int, tweak: str) -> int:
        if size < 2:
            return x
        half = ((size - 1).bit_length() + 1) // 2
        mark = f"{tweak}/{size}".encode()
        x = self.once(x, half, mark)
        while x >= size:
            x = self.once(x, half, mark)
        return x


def luhn(digits: str) -> bool:
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def refill(shape: str, digits: str) -> str:
    """shape with its digits replaced in order."""
    take = iter(digits)
    return "".join(next(take) if c.isdigit() else c for c in shape)


def card(f: Feistel, text: str) -> str | None:
    d = re.sub(r"\D", "", text)
    if not luhn(d) or len(set(d)) == 1:
        return None
    body = str(f.permute(int(d[:-1]), 10 ** (len(d) - 1), "card")).zfill(len(d) - 1)
    return refill(text, body + next(c for c in "0123456789" if luhn(body + c)))


def phone(f: Feistel, text: str) -> str | None:
    """The country's digits (up to the first separator after +) stay."""
    d = re.sub(r"\D", "", text)
    if not 7 <= len(d) <= 15:
        return None
    country = re.match(r"\+(\d{1,3})(?=\D)", text)
    n = len(d) - len(country[1]) if country else min(10, len(d) - (text[0] == "+"))
    return refill(text, d[:-n] + str(f.permute(int(d[-n:]), 10**n, "phone")).zfill(n))


def ssn(f: Feistel, text: str) -> str | None:
    a, g, s = map(int, text.split("-"))
    if a in (0, 666) or a > 899 or not g or not s:
        return None
    x = f.permute(((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + s - 1, 898 * 99 * 9999, "ssn")
    a, g, s = x // 9999 // 99 + 1, x // 9999 % 99 + 1, x % 9999 + 1
    return f"{a + (a >= 666):03d}-{g:02d}-{s:04d}"


def ip(f: Feistel, text: str) -> str | None:
    parts = [int(x) for x in text.split(".")]
    if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
        return None
    return ".".join(map(str, f.permute(int.from_bytes(bytes(parts), "big"), 1 << 32, "ip").to_bytes(4, "big")))


def calendar(f: Feistel, text: str) -> str | None:
    """Days of 1900 to 2099 among themselves; day first with / or ., unless only month first is a date. Fields keep their lengths."""
    sep = re.search(r"\D", text)[0]
    parts, low, n = text.split(sep), date(1900, 1, 1).toordinal(), 73049
    order = ((0, 1, 2),) if sep == "-" else ((2, 1, 0), (2, 0, 1))
    for i, (y, m, d) in enumerate(order):

        def ok(x: int, i=i, m=m, d=d) -> bool:
            """Whether the day can be written in this shape; a month-first date must not be one with the day first."""
            day = date.fromordinal(low + x)
            return (day.day < 10 or len(parts[d]) == 2) and (day.month < 10 or len(parts[m]) == 2) and (not i or day.day > 12)

        try:
            day = date(*[int(parts[j]) for j in (y, m, d)]).toordinal() - low
        except ValueError:
            continue
        if not 0 <= day < n or not ok(day):
            return None
        day = f.permute(day, n, "date")
        while not ok(day):
            day = f.permute(day, n, "date")
        new = date.fromordinal(low + day)
        values = {y: f"{new.year:04d}", m: str(new.month).zfill(len(parts[m])), d: str(new.day).zfill(len(parts[d]))}
        return sep.join(values[j] for j in range(3))
    return None


def classes(f: Feistel, text: str, tweak: str, hexadecimal: bool = False) -> str:
    """Letters for letters (case by place), digits for digits, as one number of mixed radix; the rest stays."""
    low = text.lower()
    sets = ["0123456789abcdef" if hexadecimal else "0123456789" if c in "0123456789" else "abcdefghijklmnopqrstuvwxyz" if "a" <= c <= "z" else "" for c in low]
    x, size = 0, 1
    for c, s in zip(low, sets, strict=True):
        if s:
            x, size = x * len(s) + s.index(c), size * len(s)
    shape = "".join("-" if not s else "9" if len(s) == 10 else "a" for s in sets)
    x, out = f.permute(x, size, f"{tweak}/{shape}"), []
    for c, s in zip(reversed(text), reversed(sets), strict=True):
        if s:
            x, r = divmod(x, len(s))
            out.append(s[r].upper() if c.isupper() else s[r])
        else:
            out.append(c)
    return "".join(reversed(out))


def looks_hexadecimal(text: str) -> bool:
    return re.fullmatch("[0-9a-f]+|[0-9A-F]+", text) is not None and not text.isdigit() and not text.isalpha()


def secret(f: Feistel, text: str) -> str:
    """Digits and letters of one case below g as a hexadecimal number, other secrets by classes; what is one kind stays that kind."""
    kind, new = looks_hexadecimal(text), text
    while True:
        if kind:
            new = f"{f.permute(int(new, 16), 16 ** len(new), 'hex'):0{len(new)}x}"
            new = new.upper() if text.isupper() else new
        else:
            new = classes(f, new, "secret")
        if looks_hexadecimal(new) == kind:
            return new


def iban(f: Feistel, text: str) -> str | None:
    """Groups of four keep their spaces."""
    own = text.replace(" ", "")
    check = lambda body, head: int("".join(str(int(c, 36)) for c in body + head))
    if not 15 <= len(own) <= 34 or check(own[4:], own[:4]) % 97 != 1:
        return None
    body = classes(f, own[4:], "iban/" + own[:2])
    new = f"{own[:2]}{98 - check(body, own[:2] + '00') % 97:02d}{body}"
    return " ".join(new[i : i + 4] for i in range(0, len(new), 4)) if " " in text else new


KINDS: dict[str, Callable[[Feistel, str], str | None]] = {"phone": phone, "ssn": ssn, "date": calendar, "ip": ip, "card": card}


def pseudonymise(text: str, f: Feistel) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms, and how many values of each kind it had. Values are all found in the text as it came."""
    found: dict[str, int] = {}
    spans: list[tuple[int, int, str]] = []

    def put(begin: int, end: int, kind: str, new: str | None) -> None:
        at = bisect_left(spans, (begin,))
        if new is None or at and spans[at - 1][1] > begin or at < len(spans) and spans[at][0] < end:
            return
        found[kind] = found.get(kind, 0) + 1
        insort(spans, (begin, end, new))

    if "=" in text or ":" in text:
        for m in SECRET.finditer(text):
            kind = next(k for k in ("secret", "single", "bare") if m[k])
            own = re.sub(r"[\W\d]+$", "", text[max(0, m.start() - 24) : m.start()]).lower().endswith(NAMED)
            # without quotes a long word is none
            if own and (kind != "bare" or re.search("[0-9]", m[kind]) and re.search("[A-Za-z]", m[kind])):
                put(m.start(kind), m.end(kind), "secret", secret(f, m[kind]))
    at = text.find("@")
    while at >= 0:  # only what stands around an @ is matched against the address pattern
        begin = at
        while begin and (text[begin - 1].isalnum() or text[begin - 1] in "_.%+-"):
            begin -= 1
        m = EMAIL.match(text, begin) if begin < at else None
        if m:
            put(m.start(), m.end(), "email", classes(f, m["local"], "email") + m[0][len(m["local"]) :])
        at = text.find("@", max(at + 1, m.end() if m else 0))
    for m in NUMBER.finditer(text):
        before = text[m.start() - 1 : m.start()]
        if m.lastgroup and not (before.isalnum() or before == "_" or text[m.end() : m.end() + 1] == "@"):
            kind = next(k for k in KINDS if m[k])
            put(m.start(), m.end(), kind, KINDS[kind](f, m[0]))
    for m in IBAN.finditer(text):
        if text[m.start() - 1 : m.start()].isalnum():
            continue
        groups = m[0].split(" ")
        for n in range(len(groups), min(2, len(groups) - 1), -1):  # words that follow may look like groups of it
            own = " ".join(groups[:n])
            if (new := iban(f, own)) is not None:
                put(m.start(), m.start() + len(own), "iban", new)
                break
    if not spans:
        return text, found
    out, at = [], 0
    for begin, end, new in spans:
        out += [text[at:begin], new]
        at = end
    return "".join([*out, text[at:]]), found


def session_key(spark: SparkSession) -> bytes:
    """The key that the session's setting KEY_CONF holds; a random one, kept for the session, where it is unset."""
    key = spark.conf.get(KEY_CONF, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_CONF, key)
    return key.encode()


def pseudonymised(docs: DataFrame, key: bytes, inverse: bool = False) -> DataFrame:
    """docs with text replaced, and columns n_pii long, pii_kinds string (kind:count, sorted)."""
    own = free_names(docs.columns, "n_pii", "pii_kinds")
    schema = T.StructType([*docs.schema, T.StructField(own[0], T.LongType()), T.StructField(own[1], T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = Feistel(key, inverse)
        for batch in batches:
            both = [(t, {}) if t is None else pseudonymise(t, f) for t in batch["text"]]
            batch["text"] = [t for t, _ in both]
            batch[own[0]] = [sum(k.values()) for _, k in both]
            batch[own[1]] = [",".join(f"{k}:{n}" for k, n in sorted(ks.items())) for _, ks in both]
            yield batch

    return mapped(docs, run, schema)
