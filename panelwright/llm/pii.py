"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Base kinds are always reported: email, ip (parts at most 255), card (16 to 19 digits, Luhn) and
phone (+, 8 to 15 digits), each leftmost and non-overlapping within its kind; a match that fails
its validator is dropped and not retried. Two kinds are added where the evidence is enough: iban
(mod-97) and ssn (only with a context word near by). All scans are linear in the text, whatever it holds.

Defined results: a null or empty text has no spans and empty strings; offsets are code points, end
exclusive; repeated rows are scanned each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import string

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.common import slices, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
#: Score of a confirmed span, what a context word adds, and what an added kind needs.
PRIOR = {"email": 0.9, "ip": 0.5, "card": 0.8, "phone": 0.6, "iban": 0.85, "ssn": 0.3}
CONTEXT_GAIN, NEEDED, WINDOW = 0.4, 0.5, 48
CONTEXT = {
    "email": ("mail", "contact", "write", "address"),
    "ip": ("ip", "host", "server", "login", "address"),
    "card": ("card", "credit", "visa", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
}
LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DOTTED = re.compile(r"[0-9][0-9.]*+")
IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9]([\x20().0-9-]++)")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
WORD = re.compile(r"[^\W\d_]+")
DIGITS = frozenset(string.digits)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def ips(text: str):
    for run in DOTTED.finditer(text):
        if text.count(".", run.start(), run.end()) >= 3:
            # A component is passed over whole when it leads nowhere, so long digit runs cost no more than their length.
            at, stop = run.start(), run.end()
            while at < stop:
                if m := IP.match(text, at, stop):
                    if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".") if p.lstrip("0")):
                        yield m.span()
                    at = m.end()
                else:
                    while at < stop and text[at] != ".":
                        at += 1
                while at < stop and text[at] == ".":
                    at += 1


def cards(text: str):
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(d) <= 19 and luhn(d):
                yield m.span()


def phones(text: str):
    at = text.find("+")
    while at >= 0:
        end = at + 1
        if m := PHONE.match(text, at):
            end = m.end()
            while text[end - 1] not in DIGITS:
                end -= 1
            if end >= at + 4:  # one character at least stands between the first digit and the last
                n = sum(c in DIGITS for c in text[at:end])
                if 8 <= n <= 15:
                    yield at, end
            else:
                end = at + 1
        at = text.find("+", end)


def ibans(text: str):
    for m in IBAN.finditer(text):
        groups = m[0].split(" ")
        while groups:
            code = "".join(groups)
            if 15 <= len(code) <= 34 and mod97(code):
                yield m.start(), m.start() + len(" ".join(groups))
                break
            groups.pop()


def ssns(text: str):
    return (m.span() for m in SSN.finditer(text))


FINDERS = {"email": emails, "ip": ips, "card": cards, "phone": phones, "iban": ibans, "ssn": ssns}


def score(kind: str, text: str, start: int, end: int) -> float:
    near = f"{text[max(0, start - WINDOW) : start]} {text[end : end + WINDOW]}".lower()
    return min(1.0, PRIOR[kind] + CONTEXT_GAIN * (not set(CONTEXT[kind]).isdisjoint(WORD.findall(near))))


def find(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind, then start."""
    out = []
    for kind in KINDS if text else ():
        for start, end in FINDERS[kind](text):
            s = score(kind, text, start, end)
            if kind in BASE or s >= NEEDED:
                out.append((kind, start, end, s))
    return out


def mask(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans are replaced together."""
    out, done = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def pii_spans(docs: DataFrame) -> DataFrame:
    """doc_id and spans (array of kind, start, end, score) of every row."""
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for b in slices(batches):
            spans = [[dict(zip(("kind", "start", "end", "score"), s)) for s in find(t)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, pa.list_(kind))], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long, score: double>>")


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data masked in text and n_chars brought up to date; null texts stay null."""

    def run(batches):
        for b in slices(batches):
            text = pa.array([t and mask(t, s) if (s := find(t)) else t for t in b.column("text").to_pylist()], pa.string())
            yield b.set_column(b.schema.get_field_index("text"), pa.field("text", pa.string()), text)

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, the number of all spans, and their scores in the order of ``spans``."""

    def run(batches):
        for b in slices(batches):
            found = [find(t) for t in b.column("text").to_pylist()]
            line = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e, _ in spans)
            counts = [pa.array([sum(s[0] == k for s in f) for f in found], pa.int64()) for k in BASE]
            sha = pa.array([hashlib.sha256(line([s for s in f if s[0] in BASE]).encode()).hexdigest() for f in found], pa.string())
            more = [pa.array([line(f) for f in found], pa.string()), pa.array(map(len, found), pa.int64()), pa.array([",".join(f"{s[3]:.2f}" for s in f) for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, sha, *more], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_spans", "scores"])

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, scores string")


QUERIES = {"op9_pii": op9_pii}
ORACLES: dict[str, str] = {}
