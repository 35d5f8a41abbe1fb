"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelake.llm.common import giving_back, texts_in_chunks, with_fields

#: Kinds in the order that breaks ties of spans with the same start; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban")
BASE_KINDS = KINDS[:4]
#: Score of a confirmed span without context, what a context word adds, and what a word of contrary meaning takes off.
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9}
NEAR, BOOST, CUT = 40, 0.1, 0.2
#: Words near a span that speak for each kind, and words that speak against any.
CONTEXT = {
    "email": ("mail", "e-mail", "email", "contact", "contacto", "kontakt", "courriel", "correo"),
    "ip": ("ip", "host", "server", "address", "adresse", "client", "login"),
    "card": ("card", "credit", "visa", "mastercard", "karte", "carte", "tarjeta", "payment"),
    "phone": ("phone", "call", "tel", "telephone", "mobile", "fax", "telefon", "teléfono", "téléphone"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta", "transfer"),
}
CONTRARY = ("version", "example", "sample", "isbn", "serial", "order")
#: Spans of other than the base kinds with a lower score are found, but not redacted.
SURE = 0.5
#: Characters of texts that are redacted and handed on together.
TOGETHER = 400_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can't start inside a run of digits, since the start of the run would match too: no rescans of long runs.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_WORDS = re.compile(r"\w[\w-]*")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(text: str) -> bool:
    """The check of an IBAN without blanks."""
    value = 0
    for c in text[4:] + text[:4]:
        value = (value * (10 if c.isdigit() else 100) + int(c, 36)) % 97
    return value == 1


def emails(text: str):
    """Each match holds one '@': what may stand before it is taken back to the end of the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def ips(text: str):
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (p.lstrip("0") or "0" for p in m[0].split("."))):
            yield m.span()


def cards(text: str):
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str):
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


def ibans(text: str):
    """The longest prefix, cut at blanks, that passes mod 97."""
    for m in _IBAN.finditer(text):
        tried = m[0]
        while tried:
            compact = tried.replace(" ", "")
            if 15 <= len(compact) <= 34 and mod97(compact):
                yield m.start(), m.start() + len(tried)
                break
            tried = tried.rpartition(" ")[0]


FINDERS = dict(zip(KINDS, (emails, ips, cards, phones, ibans), strict=True))


def score(text: str, kind: str, start: int, end: int) -> float:
    near = {w.lower() for w in _WORDS.findall(text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR])}
    up = BOOST * (not near.isdisjoint(CONTEXT[kind]))
    down = CUT * (not near.isdisjoint(CONTRARY))
    return round(min(1.0, max(0.0, BASE_SCORE[kind] + up - down)), 6)


def spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) in code points, by start and then kind as listed."""
    found = [(start, KINDS.index(kind), end) for kind, f in FINDERS.items() for start, end in f(text)]
    return [(KINDS[k], start, end, score(text, KINDS[k], start, end)) for start, k, end in sorted(found)]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def find(docs: DataFrame) -> DataFrame:
    """The documents with ``pii``: an array of (kind, start, end, score), offsets in code points.

    Empty for null and empty texts. Spans of different kinds may overlap. A column named pii is replaced; repeated rows
    come back as often as they are there; an empty table gives an empty result.
    """
    docs = docs.drop("pii")
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            found = [[{"kind": k, "start": s, "end": e, "score": p} for k, s, e, p in spans(t.as_py() or "")] for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _SPANS)], names=[*batch.schema.names, "pii"])

    return docs.mapInArrow(run, with_fields(docs.schema, "pii array<struct<kind:string,start:int,end:int,score:double>>"))


def redact(docs: DataFrame, least: float = SURE) -> DataFrame:
    """The documents with each span replaced by its kind in brackets, of other than the base kinds those of at least that score; n_chars, if there, follows the text.

    Of overlapping spans the first by start, then kind, is taken, and a later one only replaces what is left of it. A
    null text stays null. All rows stay, with their columns.
    """
    at = docs.columns.index("text")

    def clean(text):
        out, done = [], 0
        for kind, start, end, p in spans(text):
            if (kind in BASE_KINDS or p >= least) and end > done:
                out += [text[done:start] if start > done else "", f"[{kind.upper()}]" if start >= done else ""]
                done = end
        return "".join([*out, text[done:]]) if out else text

    def run(batches):
        for batch in giving_back(batches):
            for first, texts in texts_in_chunks(batch, at, TOGETHER):
                part = batch.slice(first, len(texts))
                texts = pa.array([clean(x) for x in texts], pa.string(), mask=part.column(at).is_null().to_numpy(zero_copy_only=False))
                yield part.set_column(at, batch.schema.field(at), texts)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))) if "n_chars" in docs.columns else out


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores) of every document; null texts count as empty."""
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string"

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(8)]
            for row, t in enumerate(batch.column(1)):
                found = spans(t.as_py() or "")
                named = [f"{k}:{s}:{e}" for k, s, e, _ in found]
                base = ",".join(x for x, f in zip(named, found, strict=True) if f[0] in KINDS[:4])
                counts = [sum(f[0] == k for f in found) for k in KINDS[:4]]
                values = [batch.column(0)[row].as_py(), *counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(named), ",".join(f"{f[3]:g}" for f in found)]
                for x, v in zip(out, values, strict=True):
                    x.append(v)
            yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in out[:5]], *[pa.array(x, pa.string()) for x in out[5:]]], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scores"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
