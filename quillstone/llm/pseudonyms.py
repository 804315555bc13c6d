"""Operator 6, PII: format-preserving Feistel pseudonyms.

Numbers and dates that pass their kind's validation (check digits, ranges, the calendar) are replaced by others of the same kind and
format. The replacement is a keyed permutation of all valid values of the kind: a Feistel network whose two halves are residues
modulo two numbers about the root of the domain's size, walked until the result is in the domain. So equal values have equal
pseudonyms in all documents however they are written, different ones differ, and who holds the key can undo it.

Days up to the 12th of a month go to such days and later ones to later ones, in every spelling, as 03/04/2001 can be read in
two ways (here: day first) and 25/04/2001 in one. International phone numbers are parted by the public list of country codes,
wherever separators stand; ten digits without a code are numbers of code 1.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm._shared import documents

ROUNDS = 8
#: Key of the query; a real one is the caller's.
KEY = b"quillstone example key"
FOUND = "doc_id long, n_values int, spans string, pseudonyms string, text string"

# What the kinds look like. A match is only taken if its kind's rule accepts it.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w@])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "date": r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?![\w/-]|\.\d)",
    "ip": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w-])(?:\d{13,19}|\d{4}( |-)\d{4}\1\d{4}\1\d{4}|\d{4}( |-)\d{6}\2\d{5})(?![\w-])",
    "phone": r"(?<!\w)(?:\+\d{1,3}[ .-]?\(\d{2,4}\)(?:[ .-]?\d{2,4}){2,3}|\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}([.-])\d{3}\1\d{4})(?!\d)",
}
_PATTERN = {k: re.compile(p, re.ASCII) for k, p in PATTERNS.items()}


class Permutation:
    """A keyed permutation of 0 .. size-1 for any size that leaves no number where it is: there by the network, a turn, and back. label parts the kinds from one another."""

    def __init__(self, key: bytes, label: str, size: int) -> None:
        self.size, self.a = size, math.isqrt(size - 1) + 1
        self.b = -(-size // self.a)
        self.key = hashlib.blake2b(label.encode(), key=hashlib.sha256(key).digest(), digest_size=32).digest()

    def _f(self, k: int, half: int) -> int:
        raw = k.to_bytes(1, "big") + half.to_bytes(48, "big")
        return int.from_bytes(hashlib.blake2b(raw, key=self.key, digest_size=32).digest(), "big")

    def _once(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for k in range(0, ROUNDS, 2):
            left = (left + self._f(k, right)) % self.a
            right = (right + self._f(k + 1, left)) % self.b
        return left * self.b + right

    def _back(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for k in reversed(range(0, ROUNDS, 2)):
            right = (right - self._f(k + 1, left)) % self.b
            left = (left - self._f(k, right)) % self.a
        return left * self.b + right

    def _walked(self, step: Callable[[int], int], x: int) -> int:
        x = step(x)
        while x >= self.size:
            x = step(x)
        return x

    def __call__(self, x: int, undo: bool = False) -> int:
        if self.size < 2:
            return x
        turn = 1 + self._f(255, self.size) % (self.size - 1)
        x = (self._walked(self._once, x) + (-turn if undo else turn)) % self.size
        return self._walked(self._back, x)


def luhn(digits: str) -> int:
    """The check digit that belongs behind digits."""
    total = sum(int(d) if i % 2 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return -total % 10


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _written(shape: str, digits: str) -> str:
    """digits in the places of shape's digits."""
    it = iter(digits)
    return "".join(next(it) if "0" <= c <= "9" else c for c in shape)


#: A kind gives, for a match, (domain label, its size, the value's number in it, how a number is written), or None if it isn't valid.
Coded = tuple[str, int, int, Callable[[int], str]] | None


def _card(m: str) -> Coded:
    d = _digits(m)
    if d[0] == "0" or luhn(d[:-1]) != int(d[-1]):
        return None
    low, size = 10 ** (len(d) - 2), 9 * 10 ** (len(d) - 2)

    def write(x: int) -> str:
        payload = str(low + x)
        return _written(m, payload + str(luhn(payload)))

    return f"card{len(d)}", size, int(d[:-1]) - low, write


def _ip(m: str) -> Coded:
    parts = [int(x) for x in m.split(".")]
    if any(x > 255 for x in parts) or any(len(x) > 1 and x[0] == "0" for x in m.split(".")):
        return None
    number = (parts[0] << 24) + (parts[1] << 16) + (parts[2] << 8) + parts[3]
    return "ip", 1 << 32, number, lambda x: f"{x >> 24}.{x >> 16 & 255}.{x >> 8 & 255}.{x & 255}"


def _date(m: str) -> Coded:
    mark = next(c for c in m if not c.isdigit())
    parts = m.split(mark)
    first = len(parts[0]) == 4
    y, mo, d = parts if first else [parts[2], parts[1], parts[0]]
    swap = not first and mark == "/" and int(mo) > 12  # month first
    try:
        day = date(int(y), int(d) if swap else int(mo), int(mo) if swap else int(d))
    except ValueError:
        return None
    if not date(1900, 1, 1) <= day <= date(2099, 12, 31):
        return None
    days, label = (_LATE_DAYS, "date-late") if day.day > 12 else (_EARLY_DAYS, "date-early")
    padded = len(parts[0]) == 2 and len(parts[1]) == 2 and not first and (parts[0][0] == "0" or parts[1][0] == "0")

    def write(x: int) -> str:
        t = date.fromordinal(days[x])
        if first:
            return f"{t.year:04d}{mark}{t.month:02d}{mark}{t.day:02d}"
        width = 2 if padded else 1
        a, b = (t.month, t.day) if swap else (t.day, t.month)
        return f"{a:0{width}d}{mark}{b:0{width}d}{mark}{t.year:04d}"

    return label, len(days), days.index(day.toordinal()), write


class _Days:
    """Days of 1900 to 2099 up to, or beyond, the 12th of a month, by number."""

    def __init__(self, late: bool) -> None:
        days = range(date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal() + 1)
        self.days = [d for d in days if (date.fromordinal(d).day > 12) == late]
        self.place = {d: i for i, d in enumerate(self.days)}

    def index(self, day: int) -> int:
        return self.place[day]

    def __getitem__(self, i: int) -> int:
        return self.days[i]

    def __len__(self) -> int:
        return len(self.days)


_LATE_DAYS, _EARLY_DAYS = _Days(True), _Days(False)


def _ssn(m: str) -> Coded:
    area, group, serial = (int(x) for x in m.split("-"))
    if not 1 <= area <= 899 or area == 666 or not group or not serial:
        return None
    areas = area - 1 - (area > 666)
    number = (areas * 99 + group - 1) * 9999 + serial - 1

    def write(x: int) -> str:
        rest, s = divmod(x, 9999)
        a, g = divmod(rest, 99)
        return f"{a + 1 + (a >= 665):03d}-{g + 1:02d}-{s + 1:04d}"

    return "ssn", 898 * 99 * 9999, number, write


# Country calling codes of one and of two digits; all others have three.
ONE_DIGIT = ("1", "7")
TWO_DIGITS = (
    "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56",
    "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98",
)


def country_code(digits: str) -> str:
    return digits[:1] if digits[:1] in ONE_DIGIT else digits[:2] if digits[:2] in TWO_DIGITS else digits[:3]


def _phone(m: str) -> Coded:
    d = _digits(m)
    head = country_code(d) if m[0] == "+" else ""
    own = d[len(head) :]
    if head[:1] == "0" or len(own) < 5 or len(d) > 15 or (head in ("", "1") and len(own) != 10):
        return None
    return f"phone{head or '1'}-{len(own)}", 10 ** len(own), int(own), lambda x: _written(m, f"{head}{x:0{len(own)}d}")


def _by_class(s: str) -> tuple[str, int, int, Callable[[int], str]]:
    """Letters of s to letters, digits to digits, the rest and the case as they are."""
    radix = [10 if "0" <= c <= "9" else 26 if c.isascii() and c.isalpha() else 1 for c in s]
    number = 0
    for c, r in zip(s, radix, strict=True):
        number = number * r + (0 if r == 1 else int(c) if r == 10 else ord(c.lower()) - 97)

    def write(x: int) -> str:
        out = []
        for c, r in zip(reversed(s), reversed(radix), strict=True):
            x, k = divmod(x, r)
            out.append(c if r == 1 else str(k) if r == 10 else chr(97 + k).upper() if c.isupper() else chr(97 + k))
        return "".join(reversed(out))

    return "".join("9" if r == 10 else "a" if r == 26 else c for c, r in zip(s, radix, strict=True)), math.prod(radix), number, write


def _email(m: str) -> Coded:
    local, _, host = m.rpartition("@")
    label, size, number, write = _by_class(local)
    if size == 1 or ".." in local or local[0] == "." or local[-1] == "." or ".." in host or any(x.startswith("-") or x.endswith("-") for x in host.split(".")):
        return None
    return f"email{label}@{host.lower()}", size, number, lambda x: f"{write(x)}@{host}"


def _mod97(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s)) % 97


def _iban(m: str) -> Coded:
    s = m.replace(" ", "")
    if not 15 <= len(s) <= 34 or _mod97(s[4:] + s[:4]) != 1 or not 2 <= int(s[2:4]) <= 98:
        return None
    label, size, number, write = _by_class(s[4:])

    def spelled(x: int) -> str:
        own = write(x)
        whole = iter(s[:2] + f"{98 - _mod97(own + s[:2] + '00'):02d}" + own)
        return "".join(c if c == " " else next(whole) for c in m)

    return f"iban{s[:2]}{label}", size, number, spelled


KINDS: dict[str, Callable[[str], Coded]] = {"email": _email, "iban": _iban, "date": _date, "ip": _ip, "ssn": _ssn, "card": _card, "phone": _phone}
_DIGIT = re.compile("[0-9]")


_LOCAL = re.compile(r"[A-Za-z0-9._%+-]{1,64}\Z")


def _matches(text: str, kind: str) -> Iterator[tuple[int, int]]:
    if kind != "email":
        yield from (m.span() for m in _PATTERN[kind].finditer(text))
        return
    at = text.find("@")
    while at >= 0:  # from each @ outwards: names before it needn't be tried at every letter
        if local := _LOCAL.search(text, max(0, at - 64), at):
            if m := _PATTERN[kind].match(text, local.start()):
                yield m.span()
        at = text.find("@", at + 1)


def validated(text: str) -> list[tuple[int, int, str, tuple]]:
    """(start, end, kind, coded) of the valid values in text, leftmost first, none over another; where kinds begin together, in KINDS' order."""
    found = []
    digits = _DIGIT.search(text) is not None
    for order, kind in enumerate(KINDS):
        if "@" not in text if kind == "email" else not digits:
            continue
        for start, end in _matches(text, kind):
            if coded := KINDS[kind](text[start:end]):
                found.append((start, order, end, kind, coded))
    out, reach = [], 0
    for start, _, end, kind, coded in sorted(found, key=lambda f: f[:2]):
        if start >= reach:
            out.append((start, end, kind, coded))
            reach = end
    return out


def pseudonymised(text: str | None, key: bytes = KEY, undo: bool = False) -> tuple[str | None, list[tuple[str, int, int, str]]]:
    """text with its values replaced, and (kind, start, end, what stands there now), places being those in the text before."""
    parts, at, values = [], 0, []
    for start, end, kind, (label, size, number, write) in validated(text or ""):
        new = write(Permutation(key, label, size)(number, undo))
        parts += [text[at:start], new]
        values.append((kind, start, end, new))
        at = end
    return ("".join([*parts, text[at:]]) if parts else text), values


def _scan(key: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                done = [pseudonymised(t, key) for t in part.column(1).to_pylist()]
                spans = [",".join(f"{kind}:{a}:{b}" for kind, a, b, _ in v) for _, v in done]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(v) for _, v in done], pa.int32()), pa.array(spans), pa.array(["\n".join(x for *_, x in v) for _, v in done]), pa.array([t for t, _ in done], pa.string())], names=["doc_id", "n_values", "spans", "pseudonyms", "text"])

    return run


def pseudonyms(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """Rows of FOUND, one for each row of docs (doc_id, text): its values' places, their pseudonyms (a line each), the new text.

    A text without values comes back as it is, a null one as null. Repeated rows are done each; an empty table gives no rows; other columns are
    ignored. Rows don't move between tasks, and no table of values is kept: the key alone links them.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scan(key), FOUND)


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its private values replaced."""
    return pseudonyms(documents(spark, sf_dir))
