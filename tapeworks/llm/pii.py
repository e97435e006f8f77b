"""Personal data: patterns propose spans, checks confirm them, words nearby move the score.

Base kinds (email, ip, card, phone) are always reported once their check passes; the added kinds (iban, short_card, ssn) also need
a score of ``THRESHOLD``: a passed checksum gives most of it, nearby context words raise or lower it.  Positions are code points, end exclusive.
Every scan is linear in the text, however long its runs of letters or digits are.

Null and empty texts have no spans; ties can't occur inside a kind (spans don't overlap there), spans of different kinds may overlap;
repeated rows give repeated results; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, pick

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "short_card", "ssn")
THRESHOLD = 0.6
CONTEXT_CHARS = 48
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can't begin inside a run of digits: it would have begun at the start of the run, or fails there for the same reason.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
#: words that make a kind likelier, and words that make it less likely
CONTEXT = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "address", "server", "login"), "card": ("card", "visa", "payment", "credit"),
    "phone": ("call", "phone", "tel", "mobile"), "iban": ("iban", "account", "bank", "transfer", "konto"),
    "short_card": ("card", "visa", "amex", "payment", "credit"), "ssn": ("ssn", "social", "security"),
}
AGAINST = ("example", "version", "order", "invoice", "isbn", "serial", "test")
#: a passed checksum says much, a bare pattern little
BASE_SCORE = {"email": 0.8, "ip": 0.7, "card": 0.9, "phone": 0.7, "iban": 0.9, "short_card": 0.5, "ssn": 0.4}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = ord(d) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    rest = 0
    for c in moved:
        rest = (rest * 100 + ord(c) - 55 if c.isalpha() else rest * 10 + ord(c) - 48) % 97
    return rest == 1


def _emails(text: str):
    at, done, free = text.find("@"), 0, 0
    while at >= 0:
        floor = max(done, free)  # a local part holds no @ and nothing of the previous match
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        free = at + 1
        at = text.find("@", max(at + 1, done))


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", *x) for x in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = set(re.findall(r"[a-z]+", (text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS]).lower()))
    up = any(w in near for w in CONTEXT[kind])
    down = any(w in near for w in AGAINST)
    return round(min(1.0, max(0.0, BASE_SCORE[kind] + 0.25 * up - 0.25 * down)), 2)


def added_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    for m in _IBAN.finditer(text):
        code = m[0].replace(" ", "")
        if 15 <= len(code) <= 34 and mod97(code):
            out.append(("iban", *m.span()))
    for m in _CARD.finditer(text):
        if 13 <= len(d := _digits(m[0])) <= 15 and d[0] in "3456" and luhn(d):
            out.append(("short_card", *m.span()))
    out += [("ssn", *m.span()) for m in _SSN.finditer(text) if m[0][:3] not in ("000", "666") and m[0][0] != "9"]
    return out


def personal_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """All spans (kind, start, end, score): base kinds as they are, added kinds from ``THRESHOLD`` on; by kind, then start."""
    if not text:
        return []
    base = [(k, s, e, _score(text, k, s, e)) for k, s, e in base_spans(text)]
    added = [x for x in ((k, s, e, _score(text, k, s, e)) for k, s, e in added_spans(text)) if x[3] >= THRESHOLD]
    rank = {k: i for i, k in enumerate((*BASE_KINDS, *ADDED_KINDS))}
    return sorted(base + added, key=lambda x: (rank[x[0]], x[1]))


def find_personal(docs: DataFrame) -> DataFrame:
    """doc_id and its spans, an array of (kind, start, end, score)."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def spans(batch: pa.RecordBatch) -> pa.Table:
        rows = [[dict(zip(("kind", "start", "end", "score"), x)) for x in personal_spans(t)] for t in batch.column("text").to_pylist()]
        return pa.table([batch.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "spans"])

    return map_arrow(pick(docs, doc_id="long", text="string"), spans, "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>")


def mask_personal(docs: DataFrame) -> DataFrame:
    """doc_id and the text in which every span is replaced by its kind in angle brackets; of overlapping spans the first is replaced."""

    def masked(text: str | None) -> str | None:
        out, last = [], 0
        for kind, start, end, _ in sorted(personal_spans(text), key=lambda x: (x[1], -x[2])):
            if start >= last:
                out += [text[last:start], f"<{kind}>"]
                last = end
        return text if not out else "".join(out) + text[last:]

    def run(batch: pa.RecordBatch) -> pa.Table:
        return pa.table([batch.column("doc_id"), pa.array([masked(t) for t in batch.column("text").to_pylist()], pa.string())], names=["doc_id", "text"])

    return map_arrow(pick(docs, doc_id="long", text="string"), run, "doc_id long, text string")


def span_digest(found: DataFrame) -> DataFrame:
    """Counts per base kind, the hash of the base spans and all spans as text."""

    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select("doc_id", *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS),
                        F.sha2(joined(of(*BASE_KINDS)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def span_hash(spans: list[tuple]) -> str:
    """The same hash for one text, for tests and small checks."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e, *_ in spans if k in BASE_KINDS).encode()).hexdigest()
