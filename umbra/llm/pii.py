"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Offsets count code points, ends are exclusive.  Per kind, matches are leftmost and do not
overlap; a match that its validator refuses is dropped without a second try.  Spans of the base
kinds and those with a checksum stay whatever their score.  The others (numbers and dates that
could be anything) begin below ``ACCEPT`` and stay only if the words around them lift them to
it; where they overlap a confirmed span, that one stays.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, insort
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass

#: The base kinds, in the order in which spans are listed; the kinds that this method adds follow:
#: one with a checksum, and those that context decides.
BASE_KINDS = ("email", "ip", "card", "phone")
CHECKED_KINDS = (*BASE_KINDS, "iban")
CONTEXT_KINDS = ("ssn", "local_phone", "birth_date", "document_id")
KINDS = (*CHECKED_KINDS, *CONTEXT_KINDS)

# The patterns of the base kinds.  An address is found from its "@" and a number
# from its first digit, so that no text takes more than linear time; the matches are the same.
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{1,4}){3,8}(?![A-Za-z0-9])")

_NOT_IN_WORD = r"(?<![A-Za-z0-9])(?<![A-Za-z0-9][.,/-])"
_NO_WORD_BEHIND = r"(?![A-Za-z0-9])(?![.,/-][A-Za-z0-9])"
_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
#: What context decides: proposals, each with what must hold of its digits.
PROPOSED = {
    "ssn": (re.compile(rf"{_NOT_IN_WORD}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{_NO_WORD_BEHIND}"), lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"),
    "local_phone": (re.compile(rf"{_NOT_IN_WORD}(?:\([0-9]{{2,5}}\)\x20?|[0-9]{{2,5}}[\x20./-])[0-9]{{3,4}}[\x20.-]?[0-9]{{3,5}}{_NO_WORD_BEHIND}"), lambda d: 7 <= len(d) <= 12),
    "birth_date": (re.compile(rf"{_NOT_IN_WORD}(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}[./][0-9]{{1,2}}[./][0-9]{{4}}|[0-9]{{1,2}}\x20(?:{_MONTHS})\x20[0-9]{{4}}|(?:{_MONTHS})\x20[0-9]{{1,2}},\x20[0-9]{{4}}){_NO_WORD_BEHIND}"), lambda d: any(1900 <= int(y) <= 2100 for y in (d[:4], d[-4:]))),
    "document_id": (re.compile(rf"{_NOT_IN_WORD}[A-Z]{{1,2}}[0-9]{{6,8}}{_NO_WORD_BEHIND}"), lambda d: len(set(d)) > 1),
}

#: Confidence of a span by itself, and what the spans that context decides must reach.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.95, "ssn": 0.4, "local_phone": 0.2, "birth_date": 0.15, "document_id": 0.2}
ACCEPT = 0.5
#: Words within ``NEAR`` characters that speak for or against a kind.
NEAR = 48
FOR = {
    "email": {"email", "mail", "contact", "write", "reply"},
    "ip": {"ip", "address", "host", "server", "login", "client", "from"},
    "card": {"card", "credit", "debit", "visa", "mastercard", "amex", "payment", "cvv"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "fax", "cell", "whatsapp"},
    "iban": {"iban", "account", "bank", "bic", "swift", "transfer"},
    "ssn": {"ssn", "social", "security"},
    "local_phone": {"phone", "tel", "telephone", "call", "mobile", "fax", "cell", "whatsapp"},
    "birth_date": {"born", "birthday", "birth", "dob"},
    "document_id": {"passport", "licence", "identity"},
}
AGAINST = {
    "email": {"noreply", "example"},
    "ip": {"version", "release", "build", "section", "chapter"},
    "card": {"isbn", "order", "tracking", "serial", "id"},
    "phone": {"isbn", "version", "offset"},
    "iban": {"serial"},
    "ssn": {"isbn", "order", "serial", "part"},
    "local_phone": {"isbn", "version", "order", "serial", "part"},
    "birth_date": {"published", "released", "updated", "version"},
    "document_id": {"isbn", "order", "serial", "part", "version"},
}
WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        if start < at and (m := EMAIL_DOMAIN.match(text, at)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in IBAN.finditer(text):
        end = m.end()
        while end > m.start():  # a following upper-case word may have been taken along
            code = text[m.start() : end].replace(" ", "")
            if 15 <= len(code) <= 34 and mod97(code):
                yield m.start(), end
                break
            end = text.rfind(" ", m.start(), end)


def spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The spans of each kind: those that are confirmed, and those that context accepts."""
    found = confirmed(text)
    if not any(d in text for d in "0123456789"):
        return found
    taken = sorted(x for v in found.values() for x in v)
    for kind in CONTEXT_KINDS:
        pattern, holds = PROPOSED[kind]
        for m in pattern.finditer(text):
            digits = "".join(c for c in m[0] if "0" <= c <= "9")
            if holds(digits) and not _overlaps(taken, *m.span()) and score(text, kind, *m.span()) >= ACCEPT:
                found[kind].append(m.span())
                insort(taken, m.span())
    return found


def _overlaps(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether a span of those in order, which may overlap one another, meets this one."""
    k = bisect_left(taken, (end, 0))
    return any(e > start for _, e in taken[max(0, k - len(CHECKED_KINDS)) : k])


def confirmed(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the base kinds, and of those with a checksum."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = list(_emails(text))
    if not any(d in text for d in "0123456789"):
        return found
    found["ip"] = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found["card"].append(m.span())
    if "+" in text:
        found["phone"] = [m.span() for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    found["iban"] = list(_ibans(text))
    return found


def score(text: str, kind: str, start: int, end: int) -> float:
    """The kind's prior, raised half the way to 1 (thrice, if context is what decides) by a word nearby that speaks for it, halved by one against it."""
    near = {w.lower() for w in WORD.findall(text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR])}
    value = PRIOR[kind]
    if near & FOR[kind]:
        value = 1 - (1 - value) / (8 if kind in CONTEXT_KINDS else 2)
    if near & AGAINST[kind]:
        value /= 2
    return round(value, 4)


SPAN = "struct<kind:string,start:int,end:int,score:double>"


def detect(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, text and ``pii``, an array of spans by kind as listed, then start.

    Null text has no spans and stays null; every row gives one row, repeated rows included.
    """
    schema = docs.select(*keep, "text").schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields) + f", pii array<{SPAN}>"

    def rows(chunks: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for chunk in chunks:
            yield chunk | {"pii": [[{"kind": k, "start": s, "end": e, "score": score(t, k, s, e)} for k, v in spans(t).items() for s, e in v] if t else [] for t in chunk["text"]]}

    return arrow_pass(docs.select(*keep, "text"), rows, ddl)


def digest(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: counts of the base kinds, the digest of their spans, all spans, their scores, the mean score (null without spans).

    Null text has no spans; a null doc_id is kept; repeated rows give a row each; of proposals
    that tie for a place the kind listed first stays; a text of any length is read whole, in time
    that grows with its length; an empty table gives no rows; other columns, whatever their
    names, are ignored.
    """

    def rows(chunks: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for chunk in chunks:
            out: dict[str, list] = {"doc_id": chunk["doc_id"]} | {f"n_{k}": [] for k in BASE_KINDS} | {"base_sha256": [], "spans": [], "scores": [], "score": []}
            for text in chunk["text"]:
                found = spans(text or "")
                listed = {k: [f"{k}:{s}:{e}" for s, e in v] for k, v in found.items()}
                for k in BASE_KINDS:
                    out[f"n_{k}"].append(len(found[k]))
                out["base_sha256"].append(hashlib.sha256(",".join(x for k in BASE_KINDS for x in listed[k]).encode()).hexdigest())
                out["spans"].append(",".join(x for v in listed.values() for x in v))
                scores = [score(text, k, s, e) for k, v in found.items() for s, e in v]
                out["scores"].append(",".join(map(str, scores)))
                out["score"].append(sum(scores) / len(scores) if scores else None)
            yield out

    return arrow_pass(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string, score double")


def mask_text(text: str, least: float) -> str:
    """``text`` with every span that scores ``least`` or more replaced by its kind in brackets; overlapping spans give way to the earliest, then longest."""
    out, at = [], 0
    for start, end, kind in sorted(((s, e, k) for k, v in spans(text).items() for s, e in v if score(text, k, s, e) >= least), key=lambda x: (x[0], -x[1])):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """All columns of ``docs``, the text masked; ``n_chars``, where there is such a column, counts the new text.

    Every row gives one row, repeated rows and those without an id included; null and empty texts
    stay as they are, and an empty table empty; texts of any length are masked whole.
    """
    schema = docs.schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)

    def rows(chunks: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for chunk in chunks:
            yield chunk | {"text": [t and mask_text(t, least) for t in chunk["text"]]}

    masked = arrow_pass(docs, rows, ddl)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(schema["n_chars"].dataType))
    return masked.select(*docs.columns)
