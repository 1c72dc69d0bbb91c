"""Personal data: patterns propose spans, checksums confirm them, nearby words move the score.

Kinds of the base: e-mail, IP address, payment card (Luhn), phone. Further kinds that the method adds: bank accounts (IBAN,
mod 97) and social security numbers, which need a supporting word nearby. Every span carries a score: a prior of its kind,
raised by a passed checksum and by context words within ``WINDOW`` characters, lowered where the neighbours look like a plain
number or code. Base spans are kept whatever their score; added kinds need ``MIN_SCORE``.

All searches are linear in the text: no pattern can rescan a run of characters from each of its positions. No shuffle.

Defined cases: a null text counts as empty and has no spans; equal spans of two kinds are both kept, ordered by start and
then by kind; offsets are code points, end exclusive; other columns are passed by, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import chunks, need

#: Kinds in their order, the patterns, and the words that support a kind.
KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
BASE = KINDS[:4]
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
DIGIT = re.compile(r"[0-9]")
CONTEXT = {
    "email": ["email", "e-mail", "mail", "contact", "write"],
    "ip": ["ip", "host", "server", "address"],
    "card": ["card", "visa", "credit", "payment", "pay"],
    "phone": ["phone", "tel", "call", "mobile", "fax"],
    "iban": ["iban", "account", "bank", "konto", "cuenta", "compte"],
    "ssn": ["ssn", "social", "security"],
}
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.4, "phone": 0.6, "iban": 0.3, "ssn": 0.3}
WINDOW, MIN_SCORE = 40, 0.6

SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
                                 T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))


def luhn(digits: str) -> bool:
    """The check digit of payment cards."""
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def mod97(account: str) -> bool:
    """The check digits of an IBAN: rotated by four and read as a number, it leaves 1 modulo 97."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: around each @ the whole run of local characters that no earlier match took."""
    at, end = text.find("@"), 0
    while at >= 0:
        if at >= end and (domain := DOMAIN.match(text, at + 1)):
            start = at
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                end = domain.end()
                yield start, end
        at = text.find("@", at + 1)


def base_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """The spans of the four base kinds."""
    for start, end in _emails(text):
        yield "email", start, end
    if not DIGIT.search(text):
        return
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split(".")):
            yield "ip", *m.span()
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield "card", *m.span()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                yield "phone", *m.span()


def added_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """Proposals of the added kinds that pass their checks."""
    if not DIGIT.search(text):
        return
    for m in IBAN.finditer(text):
        if 15 <= len(a := m[0].replace(" ", "")) <= 34 and mod97(a):
            yield "iban", *m.span()
    for m in SSN.finditer(text):
        a, b, c = m[0].split("-")
        if a not in ("000", "666") and a < "900" and b != "00" and c != "0000":
            yield "ssn", *m.span()


def score(text: str, kind: str, start: int, end: int) -> float:
    """Prior, checksum and context in one number from 0 to 1."""
    near = re.split(r"[^a-z-]+", (text[max(0, start - WINDOW) : start] + " " + text[end : end + WINDOW]).lower())
    value = PRIOR[kind] + (0.4 if kind in ("card", "iban") else 0.0) + (0.35 if any(w in near for w in CONTEXT[kind]) else 0.0)
    if start and (text[start - 1].isalnum() or text[start - 1] in "#/="):
        value -= 0.2
    return round(min(1.0, max(0.0, value)), 4)


def find(text: str) -> list[tuple[str, int, int, float]]:
    """All accepted spans, by start and then kind."""
    found = [(k, s, e, score(text, k, s, e)) for k, s, e in base_spans(text)]
    found += [(k, s, e, p) for k, s, e in added_spans(text) if (p := score(text, k, s, e)) >= MIN_SCORE]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def joined(spans) -> str:
    """The digest form of spans: kind:start:end, comma-joined."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e, *_ in spans)


def pii_table(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, ``found`` (kind, start, end, score), counts of the base kinds and the digests."""
    docs = need(docs, id_column, text_column)
    counts = [f"n_{k}" for k in BASE]
    schema = T.StructType([docs.schema[id_column], *[T.StructField(c, T.LongType()) for c in counts],
                           T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("found", SPAN)])
    arrow_span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in chunks(batches, text_column):
            found = [find(x) for x in text.to_pylist()]
            base = [[s for s in x if s[0] in BASE] for x in found]
            columns = [pa.array([sum(s[0] == k for s in x) for x in base], pa.int64()) for k in BASE]
            columns.append(pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in base], pa.string()))
            columns.append(pa.array([joined(x) for x in found], pa.string()))
            columns.append(pa.array([[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in x] for x in found], arrow_span))
            yield pa.RecordBatch.from_arrays([batch.column(id_column), *columns], schema.names)

    return docs.mapInArrow(run, schema)


def masked(text: str) -> str:
    """The text with each span replaced by its kind; overlapping spans are replaced together, under the first one's kind."""
    out, end = [], 0
    for kind, start, stop, _ in find(text):
        if start >= end:
            out += [text[end:start], f"<{kind.upper()}>"]
        end = max(end, stop)
    return "".join(out) + text[end:] if out else text


def mask(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """All documents and columns, with personal data masked; a null text stays null."""
    need(docs, text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in chunks(batches, text_column):
            at = batch.schema.get_field_index(text_column)
            null = batch.column(at).is_null().to_pylist()
            new = pa.array([None if n else masked(x) for x, n in zip(text.to_pylist(), null, strict=True)], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), new)

    return docs.mapInArrow(run, docs.schema)
