"""Personal data in texts (operator 9).

Regular expressions propose spans, validators (address parts, Luhn, digit counts, mod 97) confirm them, and context words near a
span adjust its score. The four base kinds need no context: what their validator confirms is always a span. The kinds that the
method adds (iban, ssn, national_id, secret) become spans where their score reaches ``MIN_SCORE``.

Defined results: a null or empty text has no spans; offsets are code points, end exclusive; spans of different kinds may overlap;
repeated rows give equal results row by row; an empty table gives no rows; other columns are neither read nor changed. Every proposal runs in time linear in the text: a pattern that could restart inside a
run of its own characters is anchored to the start of that run.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from meterloom.llm.common import struct_column

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "national_id", "secret")
MIN_SCORE = 0.5
WINDOW = 40  # characters on either side in which context words count

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_NATIONAL = re.compile(r"(?<![0-9A-Za-z])[0-9]{8}[ -]?[A-Z](?![0-9A-Za-z])")
_SECRET = re.compile(r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36})(?![A-Za-z0-9])")
_HINT = re.compile(r"[0-9+@]")

#: Words whose presence near a span raises or lowers its score.
CONTEXT = {
    "iban": (("iban", "account", "konto", "compte", "cuenta", "bank", "transfer"), ("example", "format")),
    "ssn": (("ssn", "social security", "taxpayer"), ("order", "part", "serial", "invoice")),
    "national_id": (("dni", "nif", "national id", "identity", "identidad"), ("order", "part", "serial", "invoice")),
    "secret": (("token", "secret", "password", "api key", "api_key", "apikey", "credential", "bearer"), ("checksum", "sha1", "sha256", "md5", "commit", "digest", "etag")),
}
#: Score of a confirmed span before its context is read.
START = {"iban": 0.6, "ssn": 0.3, "national_id": 0.4, "secret": 0.3}
NIF_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d *= 1 + k % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str):
    last = 0
    for m in _DOMAIN.finditer(text):
        # the local part is the run of its characters before the sign, from where the match before ended
        sign = m.start()
        start = sign
        while start > last and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        if start < sign:
            yield start, m.end()
            last = m.end()


def _ips(text: str):
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (p.lstrip("0") or "0" for p in m[0].split("."))):
            yield m.span()


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _cards(text: str):
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield m.span()


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            yield m.span()


def _score(kind: str, text: str, start: int, end: int) -> float:
    near = text[max(0, start - WINDOW) : end + WINDOW].lower()
    raising, lowering = CONTEXT[kind]
    return START[kind] + 0.4 * any(w in near for w in raising) - 0.3 * any(w in near for w in lowering)


def _added(text: str):
    for kind, pattern, sound in (
        ("iban", _IBAN, lambda s: 15 <= len(c := s.replace(" ", "")) <= 34 and mod97(c)),
        ("ssn", _SSN, lambda s: True),
        ("national_id", _NATIONAL, lambda s: NIF_LETTERS[int(s[:8]) % 23] == s[-1]),
        ("secret", _SECRET, lambda s: len(set(s)) >= 8 and any(c.isdigit() for c in s)),
    ):
        for m in pattern.finditer(text):
            if sound(m[0]) and _score(kind, text, *m.span()) >= MIN_SCORE:
                yield kind, *m.span()


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every span, by start, then kind as listed."""
    if not _HINT.search(text):
        return []
    found = [(s, e, "email") for s, e in _emails(text)] if "@" in text else []
    found += [(s, e, "ip") for s, e in _ips(text)]
    found += [(s, e, "card") for s, e in _cards(text)]
    found += [(s, e, "phone") for s, e in _phones(text)] if "+" in text else []
    found += [(s, e, kind) for kind, s, e in _added(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its kind in brackets; where spans overlap, the one that starts first stands."""
    out, last = [], 0
    for start, end, kind in spans:
        if start >= last:
            out += [text[last:start], f"[{kind}]"]
            last = end
    return "".join([*out, text[last:]])


def summary(text: str) -> tuple:
    spans = find(text)
    base = [x for x in spans if x[2] in KINDS[:4]]
    said = lambda xs: ",".join(f"{kind}:{s}:{e}" for s, e, kind in xs)
    counts = [sum(x[2] == kind for x in base) for kind in KINDS[:4]]
    return (*counts, hashlib.sha256(said(base).encode()).hexdigest(), said(spans))


SCHEMA = StructType([*(StructField(f"n_{k}", LongType()) for k in KINDS[:4]), StructField("base_sha256", StringType()), StructField("spans", StringType())])
SPANS = StructType([StructField("redacted", StringType()), StructField("spans", StringType())])


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id with counts, digest and spans, one row per row of ``docs``."""
    return docs.select("doc_id", struct_column(summary, SCHEMA)(F.col("text")).alias("p")).select("doc_id", "p.*")


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind."""
    run = struct_column(lambda x: (redact(x, s := find(x)), str(len(s))), SPANS)
    return docs.withColumn(text, F.when(F.col(f"`{text}`").isNotNull(), run(F.col(f"`{text}`"))["redacted"]))
