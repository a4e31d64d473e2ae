"""Personal data replaced by format-preserving Feistel pseudonyms.

Numbers and dates are recognised by pattern and validated: payment cards by the Luhn digit, IBANs by
their mod-97 check, dates by the calendar, IPv4 addresses by their ranges, telephone numbers and
social security numbers by their layout. A valid value is replaced by a keyed permutation of its own
format: a Feistel network over its digits, or over day numbers, walks until the result is valid
again, and check digits are computed anew. Separators stay where they are. E-mail addresses keep
their layout too; letters and digits of both sides are permuted, the last label stays.

A permutation is a function of key, kind and format alone. So equal values get equal pseudonyms in
all documents, different values different ones, and whoever holds the key can take them back.
"""

from __future__ import annotations

import calendar
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlab.llm.common import blank, text_batches

ROUNDS = 10
# For the registered query and tests. A production key is passed as ``key`` and kept elsewhere.
EXAMPLE_KEY = b"example key, not secret"
FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()

def _date_pattern() -> str:
    """Year first or last, with one of three separators throughout; a time or zone may follow."""
    short = "[0-9]{1,2}"
    forms = [x for c in ("-", "/", "[.]") for x in (f"[0-9]{{4}}{c}{short}{c}{short}", f"{short}{c}{short}{c}[0-9]{{4}}")]
    end = r"(?=T[0-9]{2}:|Z(?![0-9A-Za-z]))|(?![0-9A-Za-z/-]|\.[0-9])"
    return rf"(?<![0-9A-Za-z./-])(?:{'|'.join(forms)})(?:{end})"


def _card_pattern() -> str:
    """Digits alone, or in groups with one separator that no further digits join."""
    groups = "|".join(f"[0-9]{{4}}{c}(?:[0-9]{{4}}{c}[0-9]{{4}}{c}[0-9]{{4}}(?:{c}[0-9]{{3}})?|[0-9]{{6}}{c}[0-9]{{4,5}})" for c in (r"\x20", "-"))
    return rf"(?<![0-9A-Za-z])(?:[0-9]{{13,19}}|(?<![0-9][\x20-])(?:{groups})(?![\x20-][0-9]))(?![0-9A-Za-z])"


def _phone_pattern() -> str:
    """With a country code, an area code in brackets, as three, three and four digits, or as five pairs."""
    groups = r"[0-9]{2,4}(?:[\x20-][0-9]{2,4}){1,4}"
    area = r"\([0-9]{2,4}\)[\x20-]?"
    plain = rf"(?<![0-9][\x20-])(?:[0-9]{{3}}-[0-9]{{3}}-[0-9]{{4}}|[0-9]{{3}}\x20[0-9]{{3}}\x20[0-9]{{4}}|[0-9]{{2}}(?:\x20[0-9]{{2}}){{4}})(?![\x20-][0-9])"
    return rf"(?<![0-9A-Za-z/.+-])(?:\+[0-9]{{1,3}}[\x20-]?(?:{area})?{groups}|{area}{groups}|{plain})(?![0-9A-Za-z/-])"


# How the kinds are written. No pattern looks back or ahead further than its longest value.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9_%+'-])[A-Za-z0-9_%+'-][A-Za-z0-9_%+'.-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[0-9A-Z]{4}){2,7}(?:\x20?[0-9A-Z]{1,3})?(?![A-Za-z0-9])",
    "date": _date_pattern(),
    "ipv4": r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "card": _card_pattern(),
    "phone": _phone_pattern(),
}
SINGLE = {k: re.compile(p) for k, p in PATTERNS.items()}
FINDER = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()))
MAYBE = re.compile(r"[0-9@]")  # every pattern needs one of these


# --- the permutation ----------------------------------------------------------------------------


def _round(key: bytes, tweak: bytes, i: int, value: int) -> int:
    block = tweak + bytes([i]) + value.to_bytes(-(-max(1, value.bit_length()) // 8), "big")
    return int.from_bytes(hashlib.blake2b(block, key=key, digest_size=24).digest(), "big")


def feistel(value: int, size: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """A keyed permutation of range(size): alternating rounds on a factor pair, walked into the range."""
    if size < 2:
        return value
    a = max(2, int(size**0.5))
    b = -(-size // a)
    while True:
        left, right = divmod(value, b)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if i % 2:
                right = (right + sign * _round(key, tweak, i, left)) % b
            else:
                left = (left + sign * _round(key, tweak, i, right)) % a
        value = left * b + right
        if value < size:
            return value


def permute_digits(digits: str, key: bytes, kind: str, back: bool = False) -> str:
    n = len(digits)
    return str(feistel(int(digits), 10**n, key, f"{kind}{n}".encode(), back)).zfill(n) if n else ""


def _fill(layout: str, symbols: str, wanted) -> str:
    """The layout with its symbols replaced one by one, separators kept."""
    rest = iter(symbols)
    return "".join(next(rest) if wanted(c) else c for c in layout)


# --- kinds: each takes a matched string and gives its pseudonym, or None if it is not valid ------


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _card(text: str, key: bytes, back: bool) -> str | None:
    digits = "".join(filter(str.isdigit, text))
    if luhn_digit(digits[:-1]) != digits[-1]:
        return None
    payload = permute_digits(digits[:-1], key, "card", back)
    return _fill(text, payload + luhn_digit(payload), str.isdigit)


def _mod97(country: str, account: str) -> int:
    return int("".join(str(int(c, 36)) for c in account + country + "00")) % 97


def _iban(text: str, key: bytes, back: bool) -> str | None:
    plain = text.replace(" ", "")
    country, check, account = plain[:2], plain[2:4], plain[4:]
    if not 15 <= len(plain) <= 34 or f"{98 - _mod97(country, account):02d}" != check:
        return None
    own = permute_digits("".join(filter(str.isdigit, account)), key, "iban" + country, back)
    account = _fill(account, own, str.isdigit)
    return _fill(text, f"{country}{98 - _mod97(country, account):02d}{account}", str.isalnum)


def _date(text: str, key: bytes, back: bool) -> str | None:
    parts = re.split(r"[-/.]", text)
    separator = text[len(parts[0])]
    year_first = len(parts[0]) == 4
    y, m, d = (int(p) for p in (parts if year_first else parts[::-1]))
    swapped = not year_first and m > 12 >= d  # month before day
    if swapped:
        m, d = d, m
    if not (1900 <= y <= 2099 and 1 <= m <= 12 and 1 <= d <= calendar.monthrange(y, m)[1]):
        return None
    widths = [len(p) for p in parts]
    day, tweak = date(y, m, d).toordinal() - FIRST_DAY, f"date{separator}{widths}{year_first}{swapped}".encode()
    while True:
        day = feistel(day, LAST_DAY - FIRST_DAY + 1, key, tweak, back)
        new = date.fromordinal(day + FIRST_DAY)
        values = [new.year, new.month, new.day]
        if not year_first:
            values = [new.month, new.day, new.year] if swapped else [new.day, new.month, new.year]
        written = separator.join(str(v).zfill(w) for v, w in zip(values, widths))
        # Only dates that are written and read in the same way are in the permuted set.
        if [len(p) for p in written.split(separator)] == widths and _reading(written, year_first) == (new, swapped):
            return written


def _reading(text: str, year_first: bool) -> tuple[date, bool]:
    parts = [int(p) for p in re.split(r"[-/.]", text)]
    y, m, d = parts if year_first else parts[::-1]
    swapped = not year_first and m > 12 >= d
    return date(y, *((d, m) if swapped else (m, d))), swapped


def _ipv4(text: str, key: bytes, back: bool) -> str | None:
    """Every part keeps its number of digits."""
    parts = text.split(".")
    if any(int(p) > 255 or str(int(p)) != p for p in parts):
        return None
    ranges = [((0, 10), (10, 90), (100, 156))[len(p) - 1] for p in parts]  # first value, number of values
    value = size = 0
    for p, (first, n) in zip(parts, ranges):
        value, size = value * n + int(p) - first, max(size, 1) * n
    value = feistel(value, size, key, f"ipv4{[len(p) for p in parts]}".encode(), back)
    out = []
    for first, n in reversed(ranges):
        value, v = divmod(value, n)
        out.append(str(first + v))
    return ".".join(reversed(out))


def _ssn_valid(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _ssn(text: str, key: bytes, back: bool) -> str | None:
    digits = text.replace("-", "")
    if not _ssn_valid(digits):
        return None
    digits = permute_digits(digits, key, "ssn", back)
    while not _ssn_valid(digits):
        digits = permute_digits(digits, key, "ssn", back)
    return _fill(text, digits, str.isdigit)


def _phone(text: str, key: bytes, back: bool) -> str | None:
    """The country code stays; the national number, 7 to 14 digits, is permuted."""
    code = re.match(r"\+[0-9]{1,3}(?=[\x20(-])", text)
    head = code.group() if code else ""
    digits = "".join(filter(str.isdigit, text[len(head) :]))
    if not 7 <= len(digits) <= 14:
        return None
    return head + _fill(text[len(head) :], permute_digits(digits, key, "phone" + head, back), str.isdigit)


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _email(text: str, key: bytes, back: bool) -> str | None:
    local, _, domain = text.rpartition("@")
    name, dot, last = domain.rpartition(".")
    body = local + "@" + name
    for is_kind, base, letters in ((lambda c: c.isdigit(), 10, "0123456789"), (lambda c: c.islower(), 26, LETTERS), (lambda c: c.isupper(), 26, LETTERS.upper())):
        own = [letters.index(c) for c in body if is_kind(c)]
        if not own:
            continue
        value = 0
        for v in own:
            value = value * base + v
        # The other symbols of the address are its format.
        layout = "".join("d" if c.isdigit() else "l" if c.islower() else "u" if c.isupper() else c for c in body)
        value = feistel(value, base ** len(own), key, f"email{base}{letters[0]}{layout}.{last}".encode(), back)
        symbols = []
        for _ in own:
            value, v = divmod(value, base)
            symbols.append(letters[v])
        body = _fill(body, "".join(reversed(symbols)), is_kind)
    return body + dot + last


KINDS = {"email": _email, "iban": _iban, "date": _date, "ipv4": _ipv4, "ssn": _ssn, "card": _card, "phone": _phone}


@dataclass
class Pseudonyms:
    key: bytes
    back: bool = False

    def __post_init__(self):
        self.one = lru_cache(100_000)(lambda kind, value: KINDS[kind](value, self.key, self.back))

    def spans(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, pseudonym) of every valid value, left to right, not overlapping."""
        found, at = [], 0
        if MAYBE.search(text) is None:
            return found
        while m := FINDER.search(text, at):
            kind, new = m.lastgroup, self.one(m.lastgroup, m.group())
            if new is None:
                # Not valid as this kind; another kind may start at the same place.
                for other in KINDS:
                    n = SINGLE[other].match(text, m.start())
                    if n and other != kind and (new := self.one(other, n.group())) is not None:
                        kind, m = other, n
                        break
            if new is None:
                at = _after(text, m)
            else:
                found.append((m.start(), m.end(), kind, new))
                at = m.end()
        return found

    def rewrite(self, text: str) -> tuple[str, list[tuple[int, int, str]]]:
        spans, out, at = self.spans(text), [], 0
        for start, end, _, new in spans:
            out += [text[at:start], new]
            at = end
        return "".join([*out, text[at:]]), [(s, e, k) for s, e, k, _ in spans]


def _after(text: str, m: re.Match) -> int:
    """Past the first symbol run of a rejected match, so that a value inside it is still seen."""
    at = m.start() + 1
    while at < m.end() and text[at].isalnum():
        at += 1
    return at


def pseudonymise(docs: DataFrame, key: bytes = EXAMPLE_KEY, doc_id: str = "doc_id", text: str = "text", back: bool = False) -> DataFrame:
    """Every document with its values replaced: doc_id, text, spans and the number of each kind.

    ``spans`` are kind:start:end of the replaced values in the original text, code points, end
    exclusive, comma-joined; pseudonyms are as long as the values. NULL text stays NULL, an empty text
    empty. Repeated rows are rewritten each; other columns are ignored; an empty table gives no row.
    ``back`` undoes the replacement, given the key.
    """
    kind = dict(docs.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key, back)
        for batch in batches:
            rows = [names.rewrite(t) for t in batch.column("text").to_pylist()]
            counts = [pa.array([sum(x[2] == k for x in s) for _, s in rows], pa.int32()) for k in KINDS]
            spans = pa.array([",".join(f"{k}:{a}:{b}" for a, b, k in s) for _, s in rows], pa.string())
            columns = [batch.column("doc_id"), pa.array([t for t, _ in rows], pa.string()), spans, batch.column("absent"), *counts]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "spans", "absent", *(f"n_{k}" for k in KINDS)])

    text_batches(docs.sparkSession)
    own = docs.select(F.col(doc_id).alias("doc_id"), blank(text).alias("text"), F.col(text).isNull().alias("absent"))
    counts = ", ".join(f"n_{k} int" for k in KINDS)
    done = own.mapInArrow(run, f"doc_id {kind}, text string, spans string, absent boolean, {counts}")
    return done.withColumn("text", F.when(~F.col("absent"), F.col("text"))).drop("absent")
