"""Personal data: patterns propose spans, checksum validators confirm them, nearby context words adjust a score.

Base kinds (email, ip, card, phone) are the leftmost non-overlapping matches of their pattern that pass the kind's test. Further
kinds are added on top: ``iban`` (mod-97), ``ssn`` and ``account``, the last two only where context words lift them over the threshold.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.llm.common import map_texts, small_batches, worker_state

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "account")
BASE = KINDS[:4]
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
DOTTED_RUN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}(?= ?[A-Z0-9])")
#: Characters of an account number by country (fixed values of the public registry).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN_LENGTH = {country: n for n, own in IBAN_LENGTHS.items() for country in own.split()}
IBAN_REST = {n: re.compile(rf"(?: ?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in IBAN_LENGTHS}
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
ACCOUNT = re.compile(r"(?<![0-9A-Za-z.+-])[0-9]{8,12}(?![0-9A-Za-z.-])")
#: Score of a confirmed match alone, and the words that raise it when they stand within WINDOW code points (fixed values).
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.85, "ssn": 0.35, "account": 0.2}
CONTEXT = {
    "email": ("mail", "email", "contact", "write"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "credit", "payment", "debit"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "transfer"),
    "ssn": ("ssn", "social", "security"),
    "account": ("account", "acct", "iban", "bank", "passport", "member"),
}
AGAINST = ("version", "example", "sample", "isbn", "build", "release")
WINDOW, BONUS, MALUS, THRESHOLD = 40, 0.3, 0.3, 0.5
WORDS = re.compile(r"[a-z]+")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    """Every second digit from the right doubled, less 9 above 9; the sum divides by 10."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Four leading characters moved to the end, letters as 10 to 35; the remainder by 97 is 1."""
    s = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in s)) % 97 == 1


def emails(text: str):
    """Each at-sign is looked at alone, so that long runs without one cost nothing: what stands left of it in LOCAL, then the domain."""
    at, low = text.find("@"), 0
    while at >= 0:
        left = text[low:at]
        start = low + len(left.rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        low = m.end() if m else at + 1
        at = text.find("@", low)


def ips(text: str):
    """Dotted runs of numbers, four at a time from the left: what the pattern finds leftmost, without its retries inside long digit runs."""
    for run in DOTTED_RUN.finditer(text):
        if run.group().count(".") < 3:
            continue
        at = run.start()
        while m := DOTTED.match(text, at, run.end()):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
                yield m.span()
            at = m.end() + 1


def cards(text: str):
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(d) <= 19 and luhn(d):
                yield m.span()


def phones(text: str):
    """Each plus sign is looked at alone: the pattern's class has none, so matches can't run over one."""
    at = text.find("+")
    while at >= 0:
        m = PHONE.match(text, at)
        if m and 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield m.span()
        at = text.find("+", m.end() if m else at + 1)


def ibans(text: str):
    """A country's code and two check digits, then as many letters and digits as its numbers have, single blanks between them."""
    for m in IBAN.finditer(text):
        n = IBAN_LENGTH.get(m[1])
        rest = IBAN_REST[n].match(text, m.end()) if n else None
        if rest and mod97(text[m.start() : rest.end()].replace(" ", "")):
            yield m.start(), rest.end()


def scored(text: str, kind: str, start: int, end: int) -> Span:
    near = set(WORDS.findall(text[max(0, start - WINDOW) : start].lower())) | set(WORDS.findall(text[end : end + WINDOW].lower()))
    score = PRIOR[kind] + BONUS * bool(near.intersection(CONTEXT[kind])) - MALUS * bool(near.intersection(AGAINST))
    return Span(kind, start, end, round(min(1.0, max(0.0, score)), 3))


def find_spans(text: str | None) -> list[Span]:
    """All spans by start, then kind in the order of KINDS. Base kinds stay whatever their score; others need THRESHOLD."""
    if not text:
        return []
    out = []
    for kind, found in (("email", emails), ("ip", ips), ("card", cards), ("phone", phones)):
        out += [scored(text, kind, a, b) for a, b in found(text)]
    more = [scored(text, "iban", a, b) for a, b in ibans(text)]
    more += [scored(text, "ssn", *m.span()) for m in SSN.finditer(text)]
    more += [scored(text, "account", *m.span()) for m in ACCOUNT.finditer(text)]
    if more:
        taken = bytearray(len(text))
        for s in out:
            taken[s.start : s.end] = b"\1" * (s.end - s.start)
        for s in more:
            if s.score >= THRESHOLD and not any(taken[s.start : s.end]):
                out.append(s)
                taken[s.start : s.end] = b"\1" * (s.end - s.start)
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind)))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: counts of the base kinds, ``base_sha256``, ``spans`` and ``scores`` (as ``spans``, in order).

    Null and empty texts have no spans; repeated rows stay; an empty table gives an empty table; other columns are not read.
    """
    kind = dict(df.dtypes)[id_col]

    def make():
        def run(keys, texts):
            rows = []
            for (k,), t in zip(keys, texts, strict=True):
                spans = find_spans(t)
                base = [s for s in spans if s.kind in BASE]
                n = [sum(s.kind == b for s in base) for b in BASE]
                rows.append((k, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), ",".join(f"{s.score:g}" for s in spans)))
            return rows

        return run

    return map_texts(df, [F.col(id_col)], F.col(text_col), make, f"`{id_col}` {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, scores string")


def redact_text(text: str | None) -> str | None:
    """Spans replaced by their kind in brackets; of overlapping spans the union is replaced by the first one's kind."""
    spans = find_spans(text)
    if not spans:
        return text
    out, at = [], 0
    for s in spans:
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = max(at, s.end)
    return "".join(out) + text[at:]


def redact(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``df`` with personal data in ``text_col`` replaced; ``length_col`` follows. Nulls stay null; all rows and other columns stay."""
    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        worker_state(None)
        return texts.map(redact_text, na_action="ignore")

    small_batches(df.sparkSession)

    out = df.withColumn(text_col, clean(F.col(text_col)))
    return out.withColumn(length_col, F.length(text_col).cast(dict(df.dtypes)[length_col])) if length_col and length_col in df.columns else out
