r"""PII: format-preserving Feistel pseudonyms for validated numbers and dates, and for e-mail addresses.

A value is found by its format, validated, and replaced by a keyed permutation
of the values of the same format: equal values get equal pseudonyms in every
document, different values different ones, and whoever has the key can undo it.
The permutation is a ten-round balanced Feistel network over the value's domain
(alternating between the two halves of a mixed-radix number, rounds keyed by
BLAKE2); where a domain is no product of two equal halves, cycle walking stays
inside it. Names of over 64 letters and digits are permuted 64 at a time, each
part under a tweak that hangs on the part before.

What is found, in this order where matches overlap:
* e-mail addresses: letters and digits of the local part are permuted, each
  character staying a letter or a digit; the domain stays;
* IBANs with right check digits: the account part is permuted, the check digits
  are computed anew;
* card numbers of 13 to 19 digits, plain or in groups, with a right Luhn digit:
  the payload is permuted and its Luhn digit computed anew (a number with a
  wrong Luhn digit is no card and stays);
* social security numbers ddd-dd-dddd with a valid area, group and serial;
* IPv4 addresses with four octets up to 255;
* telephone numbers: +country or (area) forms, and ddd-dddd: the country code stays;
* calendar dates (year-month-day, day.month.year, day/month/year) from 1900 to
  2099: permuted among the days of those years, so written in any format one day
  gets one pseudonym.

Separators and grouping stay as they are. A match that proves invalid is given to
the kinds after it at the same place (an IBAN also without its last groups), then
the search goes on one character later, so values side by side are all found.

Defined results: a null text stays null and has nothing; an empty text has
nothing; very long texts are searched whole, and a value of any length takes time
in proportion to it; equal rows give equal rows; an empty table gives no rows.
Extra columns are left out, whatever their names.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdanta.llm.cluster import short_batches

#: The key of the registered query; a real run gives its own.
KEY = b"verdanta-demo-key"
ROUNDS = 10
#: Characters that are permuted as one number.
PART = 64
#: Pseudonyms that a task keeps.
KEPT = 50_000
FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
DAYS = datetime.date(2100, 1, 1).toordinal() - FIRST_DAY

FORMATS = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w-])",
    "iban": r"\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b",
    "card": r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "ip": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\w)",
    "date": r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?!\.?[\w/-])",
    "phone": r"(?<![\w+(.-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)?\d{3,4}[.-]\d{4}(?![\w-])"
    r"|(?<![\w+])\+\d{1,3}(?:[ .-]?\d){7,12}(?![\w-])"
    r"|(?<![\w+(.-])(?:\+\d{1,3}[ .-]?)?\d{3}[ .-]\d{3}[ .-]\d{4}(?![\w-])",
}
KINDS = tuple(FORMATS)
PATTERN = re.compile("|".join(f"(?P<{k}>{x})" for k, x in FORMATS.items()))
SINGLE = {k: re.compile(x) for k, x in FORMATS.items()}


def luhn(payload: str) -> int:
    """The check digit of a payload."""
    total = sum(d if i % 2 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(map(int, reversed(payload))))
    return -total % 10


def iban_check(country: str, account: str) -> str:
    number = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{98 - int(number) % 97:02d}"


class Feistel:
    """Keyed permutations of whole-number domains."""

    def __init__(self, key: bytes = KEY) -> None:
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, what: str, i: int, size: int, value: int) -> int:
        data = f"{what}|{i}|{size:x}|{value:x}".encode()
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=min(64, size.bit_length() // 8 + 9)).digest(), "big") % size

    def _once(self, what: str, value: int, side: int, back: bool) -> int:
        a, b = divmod(value, side)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                a, b = (b - self._round(what, i, side, a)) % side, a
            else:
                a, b = b, (a + self._round(what, i, side, b)) % side
        return a * side + b

    def permute(self, what: str, value: int, size: int, back: bool = False) -> int:
        """The place of ``value`` in the permutation of 0 .. size-1 that ``what`` names; ``back`` undoes it."""
        side = math.isqrt(max(size - 1, 0)) + 1
        while True:
            value = self._once(what, value, side, back)
            if value < size:
                return value

    def characters(self, what: str, text: str, back: bool = False) -> str:
        """Letters and digits permuted together, each within its alphabet; other characters stay."""
        own = [c for c in text if c.isascii() and c.isalnum()]
        fresh: list[str] = []
        for a in range(0, len(own), PART):
            fresh += self._part(what, own[a : a + PART], back)
            plain = fresh if back else own
            what = hashlib.blake2b(f"{what}|{''.join(plain[a : a + PART])}".encode(), digest_size=16).hexdigest()
        each = iter(fresh)
        return "".join(next(each) if c.isascii() and c.isalnum() else c for c in text)

    def _part(self, what: str, own: list[str], back: bool) -> list[str]:
        value, size, radix = 0, 1, []
        for c in own:
            r, base = (10, 48) if c.isdigit() else (26, 97) if c.islower() else (26, 65)
            value, size = value * r + ord(c) - base, size * r
            radix.append((r, base))
        form = "".join("d" if r == 10 else "a" if b == 97 else "A" for r, b in radix)
        value = self.permute(f"{what}:{form}", value, size, back)
        out = []
        for r, base in reversed(radix):
            value, c = divmod(value, r)
            out.append(chr(base + c))
        return out[::-1]


class Pseudonyms:
    """Pseudonyms by kind of value, kept while a task runs; with ``back`` the values of pseudonyms."""

    def __init__(self, key: bytes = KEY, back: bool = False) -> None:
        self.feistel, self.back, self.known = Feistel(key), back, {}

    def characters(self, what: str, text: str) -> str:
        return self.feistel.characters(what, text, self.back)

    def permute(self, what: str, value: int, size: int) -> int:
        return self.feistel.permute(what, value, size, self.back)

    def digits(self, what: str, text: str, skip: int = 0) -> str:
        """Digits permuted, without the first ``skip``; separators stay."""
        own = re.sub(r"\D", "", text)[skip:]
        fresh = iter(re.sub(r"\D", "", text)[:skip] + self.characters(what, own))
        return re.sub(r"\d", lambda _: next(fresh), text)

    def make(self, kind: str, text: str) -> str | None:
        """The pseudonym, or None where the value isn't valid."""
        if kind == "email":
            local, _, domain = text.partition("@")
            return f"{self.characters('email', local)}@{domain}"
        if kind == "card":
            own = re.sub(r"\D", "", text)
            if luhn(own[:-1]) != int(own[-1]):
                return None
            fresh = self.characters("card", own[:-1])
            fresh += str(luhn(fresh))
            each = iter(fresh)
            return re.sub(r"\d", lambda _: next(each), text)
        if kind == "iban":
            plain = text.replace(" ", "")
            country, account = plain[:2], plain[4:]
            if not 15 <= len(plain) <= 34 or iban_check(country, account) != plain[2:4]:
                return None
            account = self.characters(f"iban{country}", account)
            each = iter(country + iban_check(country, account) + account)
            return "".join(c if c == " " else next(each) for c in text)
        if kind == "ssn":
            area, group, serial = map(int, text.split("-"))
            if area in (0, 666) or area >= 900 or not group or not serial:
                return None
            place = lambda a: a - 1 - (a > 666)
            value = self.permute("ssn", (place(area) * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999)
            value, serial = divmod(value, 9999)
            area, group = divmod(value, 99)
            return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"
        if kind == "ip":
            octets = [int(x) for x in text.split(".")]
            if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
                return None
            value = self.permute("ip", int.from_bytes(bytes(octets), "big"), 1 << 32)
            return ".".join(map(str, value.to_bytes(4, "big")))
        if kind == "phone":
            country = re.match(r"\+(\d{1,3})(?=[ .(-])", text)
            return self.digits("phone", text, len(country[1]) if country else 1 if text[0] == "+" else 0)
        parts = re.split(r"[./-]", text)
        y, m, d = map(int, parts if len(parts[0]) == 4 else parts[::-1])
        try:
            day = datetime.date(y, m, d).toordinal() - FIRST_DAY
        except ValueError:
            return None
        if not 0 <= day < DAYS:
            return None
        new = datetime.date.fromordinal(self.permute("date", day, DAYS) + FIRST_DAY)
        sep = text[4] if len(parts[0]) == 4 else re.search(r"[./-]", text)[0]
        own = [f"{new.year}", f"{new.month:0{len(parts[1])}d}", f"{new.day:0{len(parts[2] if len(parts[0]) == 4 else parts[0])}d}"]
        return sep.join(own if len(parts[0]) == 4 else own[::-1])

    def __call__(self, kind: str, text: str) -> str | None:
        key = (kind, text)
        if key not in self.known:
            if len(self.known) > KEPT:
                self.known.clear()
            self.known[key] = self.make(kind, text)
        return self.known[key]

    def _other(self, text: str, m: re.Match) -> tuple[int, str, str] | None:
        """(end, kind, pseudonym) of another valid value where ``m`` found an invalid one."""
        if m.lastgroup == "iban":
            for cut in reversed([x.start() for x in re.finditer(" ", m[0])]):
                new = self("iban", m[0][:cut])
                if new is not None:
                    return m.start() + cut, "iban", new
        for kind in KINDS[KINDS.index(m.lastgroup) + 1 :]:
            x = SINGLE[kind].match(text, m.start())
            new = self(kind, x[0]) if x else None
            if new is not None:
                return x.end(), kind, new
        return None

    def replace(self, text: str) -> tuple[str, list[tuple[int, int, str]]]:
        """The pseudonymous text and the spans (start, end, kind) replaced in the original."""
        out, spans, done, at = [], [], 0, 0
        while m := PATTERN.search(text, at):
            new = self(m.lastgroup, m[0])
            found = (m.end(), m.lastgroup, new) if new is not None else self._other(text, m)
            if found is None:
                at = m.start() + 1
                continue
            out += [text[done : m.start()], found[2]]
            spans.append((m.start(), found[0], found[1]))
            done = at = found[0]
        return ("".join(out) + text[done:] if spans else text), spans


def pseudonymise(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", key: bytes = KEY) -> DataFrame:
    """Per row: doc_id, text (pseudonymous), n_values, kinds (distinct, ascending), spans in the original text."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key)
        for batch in batches:
            texts, found = [], []
            for t, maybe in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                t, s = names.replace(t) if maybe else (t, [])
                texts.append(t)
                found.append([{"start": a, "end": b, "kind": k} for a, b, k in s])
            kinds = pa.array([",".join(sorted({x["kind"] for x in s})) for s in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([len(s) for s in found], pa.int64()), kinds, pa.array(found, pa.list_(span))], names=["doc_id", "text", "n_values", "kinds", "spans"])

    short_batches(docs.sparkSession)
    whole = F.col(text).cast("string")
    maybe = F.coalesce(whole.rlike(r"@|\d[-./ )]?\d"), F.lit(False))  # a value has an @ or two digits
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole.alias("text"), maybe.alias("maybe"))
    return rows.mapInArrow(run, "doc_id long, text string, n_values long, kinds string, spans array<struct<start: long, end: long, kind: string>>")
