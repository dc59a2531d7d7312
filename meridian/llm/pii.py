"""Format-preserving pseudonyms for personal data.

Values are found, validated, and mapped within their format by a keyed Feistel
permutation: payment cards keep their length and a right Luhn digit, dates stay
dates of 1900 to 2099, addresses stay valid, letters become letters of the same case.  A
permutation maps different values to different pseudonyms and equal values to equal
ones, whatever separators they were written with, so records stay linked across
documents.  Where a format does not fill its domain the permutation is walked until
it falls into the format again.  No state is kept: every task computes the same.

Kinds: email (local part), card (13 to 19 digits, Luhn), iban (mod 97), phone (the
country code stays; numbers of ten digits without one are taken for code 1, so
``+1 415 555 1234``, ``+14155551234`` and ``415-555-1234`` stay one number), ip
(IPv4), date (ISO, and d.m.y or m/d/y with four-digit years; days and months of one
digit stay of one digit, so a date is the same in every layout), key (access keys: one of
five known prefixes and 16 or more letters and digits), secret (eight or more
characters with a digit that are assigned to a token, secret, password or key; hexadecimal ones
stay hexadecimal).

The key is a parameter: whoever has it can invert every pseudonym, so it belongs to
a secret store.  (Only the registered query, over synthetic tables, falls back to a
sample key where the session sets none in ``spark.meridian.pseudonym.key``.)

Defined results: a null text stays null; texts without values return unchanged;
where kinds overlap the earlier and longer value counts; values that fail
validation stay, unless another kind or a part that ends at a group is valid from
the same start; repeated rows agree; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
import string
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

ROUNDS = 10
#: Bytes that a key has at least and at most.
KEY_BYTES = (16, 64)
#: Characters of a value permuted as one number.
PIECE = 1024
KINDS = ("email", "card", "iban", "phone", "ip", "date", "key", "secret")

_KINDS = {
    "secret": r"(?<![A-Za-z0-9])(?i:token|secret|password|passwd|(?:api|access|secret|private)[_-]?key)[\"']?[ \t]{0,4}[=:][ \t]{0,4}[\"']?[A-Za-z0-9+/_.~-]{8,}",
    "email": r"(?<![\w.+%-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b",
    "key": r"\b(?:AKIA|ASIA|AIza|ghp_|sk-)[A-Za-z0-9]{16,}\b",
    "date": r"(?<![\d.])(?:\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?![\d-])",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)",
    "card": r"(?<![\d.])\d(?:[ -]?\d){12,18}(?![\d])",
    "phone": r"(?<![\w.])\+?\d{0,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\w.])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\w.-])(?:1[ .-])?\d{3}[.-]\d{3}[.-]\d{4}(?![\d.-])",
}
_VALUE = re.compile(r"[A-Za-z0-9+/_.~-]{8,}$")
#: Country calling codes of one and two digits; all others have three.
_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
_FIND = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _KINDS.items()))
_EACH = {k: re.compile(p) for k, p in _KINDS.items()}


def digest(data: bytes, width: int, key: bytes) -> bytes:
    """A keyed hash of any number of bytes."""
    if width <= 64:
        return hashlib.blake2b(data, key=key, digest_size=width).digest()
    seed = hashlib.blake2b(data, key=key).digest()
    return b"".join(hashlib.blake2b(seed + k.to_bytes(8, "big"), key=key).digest() for k in range(-(-width // 64)))[:width]


def permuted(value: int, size: int, label: bytes, key: bytes) -> int:
    """A keyed permutation of range(size): a Feistel network over a * b >= size, walked back into range."""
    if size < 2:
        return value
    a = b = math.isqrt(size - 1) + 1
    head = label + size.to_bytes((size.bit_length() + 7) // 8, "big")
    # Halves beyond 24 bytes get a digest of 8 bytes more than they have.
    width = (a.bit_length() + 7) // 8
    width = 24 if width <= 24 else width + 8

    def once(v: int) -> int:
        left, right = divmod(v, b)
        for r in range(ROUNDS):
            f = int.from_bytes(digest(head + bytes([r]) + right.to_bytes(width, "big"), width, key), "big")
            left, right = right, (left + f) % a
        return left * b + right

    v = once(value)
    while v >= size:
        v = once(v)
    return v


def mapped(text: str, label: bytes, key: bytes, keep: Callable[[str], bool] | None = None, lower: str = string.ascii_lowercase, upper: str = string.ascii_uppercase) -> str:
    """Letters and digits of ``text`` permuted as one number in their mixed radix, walked until ``keep`` holds."""
    if keep is None and len(text) > PIECE:
        # Big numbers cost their square: pieces, each keyed by all that stands before it, are a permutation too.
        before, made = hashlib.blake2b(label), []
        for at in range(0, len(text), PIECE):
            made.append(mapped(text[at : at + PIECE], label + before.digest(), key, None, lower, upper))
            before.update(text[at : at + PIECE].encode())
        return "".join(made)
    pools = [next((p for p in (string.digits, lower, upper) if c in p), "") for c in text]
    size = 1
    for p in pools:
        size *= len(p) or 1

    def once(t: str) -> str:
        v = 0
        for c, p in zip(t, pools, strict=True):
            if p:
                v = v * len(p) + p.index(c)
        v = permuted(v, size, label + "".join(p[0] if p else c for c, p in zip(t, pools, strict=True)).encode(), key)
        out = []
        for c, p in zip(reversed(t), reversed(pools), strict=True):
            if p:
                v, d = divmod(v, len(p))
                out.append(p[d])
            else:
                out.append(c)
        return "".join(reversed(out))

    t = once(text)
    while keep is not None and not keep(t):
        t = once(t)
    return t


def luhn(digits: str) -> bool:
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def check_digit(body: str) -> str:
    return next(d for d in string.digits if luhn(body + d))


def spread(pattern: str, digits: str) -> str:
    """``pattern`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in pattern)


def mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


_FIRST = datetime.date(1900, 1, 1).toordinal()
_LAST = datetime.date(2099, 12, 31).toordinal()
_LAYOUTS = {
    "-": (re.compile(r"(?P<y>\d{4})-(?P<m>\d{2})-(?P<d>\d{2})"), "ymd"),
    ".": (re.compile(r"(?P<d>\d{1,2})\.(?P<m>\d{1,2})\.(?P<y>\d{4})"), "dmy"),
    "/": (re.compile(r"(?P<m>\d{1,2})/(?P<d>\d{1,2})/(?P<y>\d{4})"), "mdy"),
}


def short_parts(day: datetime.date) -> tuple[bool, bool]:
    """Whether month and day can be written with one digit."""
    return day.month < 10, day.day < 10


@lru_cache(maxsize=4)
def days_like(month: bool, day: bool) -> tuple[list[int], dict[int, int]]:
    """All days with such parts, and the place of each."""
    days = [n for n in range(_FIRST, _LAST + 1) if short_parts(datetime.date.fromordinal(n)) == (month, day)]
    return days, {n: k for k, n in enumerate(days)}


def new_date(text: str, key: bytes) -> str | None:
    for mark, (pattern, parts) in _LAYOUTS.items():
        m = pattern.fullmatch(text)
        if not m:
            continue
        try:
            day = datetime.date(int(m["y"]), int(m["m"]), int(m["d"]))
        except ValueError:
            return None
        if not 1900 <= day.year <= 2099:
            return None
        days, at = days_like(*short_parts(day))
        new = datetime.date.fromordinal(days[permuted(at[day.toordinal()], len(days), b"date" + bytes(short_parts(day)), key)])
        value = {"y": new.year, "m": new.month, "d": new.day}
        return mark.join(str(value[p]).zfill(len(m[p])) for p in parts)
    return None


def phone_parts(value: str) -> tuple[str, str]:
    """Country code and national number of a phone number, whatever separators it has."""
    digits = re.sub(r"\D", "", value)
    national = lambda n: len(n) == 10 and n[0] not in "01" and n[3] not in "01"
    if value.startswith("+"):
        code = next((c for c in _CODES if digits.startswith(c)), digits[:3])
        return code, digits[len(code) :]
    if len(digits) == 11 and digits[0] == "1" and national(digits[1:]):
        return "1", digits[1:]
    return ("1" if national(digits) else ""), digits


def checked(key: bytes) -> bytes:
    if not isinstance(key, bytes) or not KEY_BYTES[0] <= len(key) <= KEY_BYTES[1]:
        raise ValueError(f"a key has {KEY_BYTES[0]} to {KEY_BYTES[1]} bytes")
    return key


def new_secret(text: str, key: bytes) -> str:
    hexadecimal = lambda t: re.fullmatch("[0-9a-f]{16,}|[0-9A-F]{16,}", t) is not None
    if hexadecimal(text):
        return mapped(text, b"hex", key, None, "abcdef", "ABCDEF")
    return mapped(text, b"secret", key, (lambda t: not hexadecimal(t)) if len(text) <= PIECE else None)


@lru_cache(maxsize=100_000)
def pseudonym(kind: str, value: str, key: bytes) -> str | None:
    """The pseudonym of a value, or None if it isn't valid."""
    if kind == "email":
        local, _, domain = value.partition("@")
        return mapped(local, b"email" + domain.lower().encode(), key) + "@" + domain
    if kind == "card":
        digits = re.sub(r"\D", "", value)
        if not luhn(digits) or len(set(digits)) == 1:
            return None
        body = mapped(digits[:-1], b"card", key, lambda t: len(set(t)) > 1)
        return spread(value, body + check_digit(body))
    if kind == "iban":
        plain = value.replace(" ", "")
        if not 15 <= len(plain) <= 34 or mod97(plain) != 1:
            return None
        body = mapped(plain[4:], b"iban" + plain[:2].encode(), key)
        full = plain[:2] + f"{98 - mod97(plain[:2] + '00' + body):02d}" + body
        it = iter(full)
        return "".join(c if c == " " else next(it) for c in value)
    if kind == "date":
        return new_date(value, key)
    if kind == "ip":
        octets = [int(x) for x in value.split(".")]
        if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in value.split(".")):
            return None
        v = permuted(int.from_bytes(bytes(octets), "big"), 1 << 32, b"ip", key)
        return ".".join(map(str, v.to_bytes(4, "big")))
    if kind == "phone":
        digits = re.sub(r"\D", "", value)
        code, rest = phone_parts(value)
        if not 7 <= len(digits) <= 15 or len(rest) < 4:
            return None
        # Numbers of code 1 stay valid: area and exchange don't start with 0 or 1; others keep a leading zero or none.
        if code == "1" and len(rest) == 10 and rest[0] not in "01" and rest[3] not in "01":
            sane = lambda t: t[0] not in "01" and t[3] not in "01"
        else:
            sane = lambda t: (t[0] == "0") == (rest[0] == "0") and not (code == "1" and len(t) == 10 and t[0] not in "01" and t[3] not in "01")
        return spread(value, digits[: len(digits) - len(rest)] + mapped(rest, b"phone" + code.encode(), key, sane))
    if kind == "key":
        cut = 4 if value[:2] != "sk" else 3
        return value[:cut] + mapped(value[cut:], b"key" + value[:cut].encode(), key)
    if kind == "secret":
        at = _VALUE.search(value).start()
        return value[:at] + new_secret(value[at:], key) if any(c.isdigit() for c in value[at:]) else None
    return None


def other_value(text: str, at: int, failed: str | None, key: bytes) -> tuple[str, int, str] | None:
    """(kind, end, pseudonym) of the value of another kind than ``failed`` that starts at ``at``."""
    for kind, pattern in _EACH.items():
        if kind != failed and (m := pattern.match(text, at)) and (new := pseudonym(kind, m.group(), key)) is not None:
            return kind, m.end(), new
    return None


def longer_at(text: str, kind: str, at: int, end: int, key: bytes) -> bool:
    """Whether a value that starts at ``at`` goes on beyond ``end``."""
    found = other_value(text, at, kind, key)
    own = _EACH[kind].match(text, at)
    return bool(found and found[1] > end or own and own.end() > end and pseudonym(kind, own.group(), key) is not None)


def shorter_value(text: str, kind: str, start: int, end: int, key: bytes) -> tuple[str, int, str] | None:
    """(kind, end, pseudonym) of the longest valid value at ``start`` that ends at a group before ``end``.

    A part that would cut a value starting at a later group is passed over.
    """
    gaps = [g.start() for g in re.finditer(r"[ .-]+", text[start:end])]
    for gap in reversed(gaps):
        m = _EACH[kind].fullmatch(text, start, start + gap)
        if not m or (new := pseudonym(kind, m.group(), key)) is None:
            continue
        if not any(longer_at(text, kind, start + g + 1, m.end(), key) for g in gaps if g + 1 < gap):
            return kind, m.end(), new
    return None


def pseudonymised(text: str, key: bytes) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of each value in the input."""
    spans: list[tuple[str, int, int]] = []
    out, done, at = [], 0, 0
    while m := _FIND.search(text, at):
        kind, value = m.lastgroup, m.group()
        end, new = m.end(), pseudonym(kind, value, key)
        if new is None and (found := other_value(text, m.start(), kind, key) or shorter_value(text, kind, m.start(), end, key)):
            kind, end, new = found
        if new is None:
            # Not valid as this kind: look on behind its first character run.
            at = m.start() + max(1, len(re.match(r"\+?\d+|\w+|.", value, re.DOTALL).group()))
            continue
        out += [text[done : m.start()], new]
        spans.append((kind, m.start(), end))
        done = at = end
    return ("".join(out) + text[done:] if spans else text), spans


_MAYBE = re.compile(r"\d|@")
SCHEMA = "text string, n_values long, kinds array<string>, starts array<int>, ends array<int>"


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text with pseudonyms, number, kinds and places of the values of every row."""
    checked(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, spans = [], []
            for t in b["text"].to_pylist():
                new, found = pseudonymised(t, key) if t and _MAYBE.search(t) else (t, [])
                texts.append(new)
                spans.append(found)
            cols = [pa.array(texts, pa.string()), pa.array([len(s) for s in spans], pa.int64()), pa.array([[x[0] for x in s] for s in spans], pa.list_(pa.string()))]
            cols += [pa.array([[x[k] for x in s] for s in spans], pa.list_(pa.int32())) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *cols], names=["doc_id", "text", "n_values", "kinds", "starts", "ends"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {SCHEMA}")


#: Not a secret: for the registered query over synthetic tables only.
SAMPLE_KEY = b"sample key for synthetic tables"


def op6_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with format-preserving pseudonyms for the personal data in them."""
    own = spark.conf.get("spark.meridian.pseudonym.key", None)
    return pseudonymise(table(spark, sf_dir, "documents"), own.encode() if own else SAMPLE_KEY)
