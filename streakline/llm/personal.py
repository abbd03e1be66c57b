"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

The base kinds (email, ip, card, phone) are leftmost matches that do not
overlap within a kind; a match that fails its check is dropped and not tried
again. More spans come from account numbers that pass the mod-97 check (iban)
and from national numbers of a fixed layout that only context can confirm
(ssn). Patterns are written so that no text takes more than linear time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

#: Words that speak for a kind when they stand near a span, and such that speak against any.
_CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "server", "host"),
    "card": ("card", "visa", "credit", "payment", "karte", "tarjeta", "carte"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
    "ssn": ("ssn", "social", "security"),
}
_AGAINST = ("example", "version", "serial", "order", "isbn", "sku")
_NEAR = 40
_SCORE = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4}
#: Added kinds count from this score on; base kinds always.
LEAST = 0.5


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def mod97(account: str) -> bool:
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _is_account(text: str, start: int, end: int) -> bool:
    """Whether an account number ends here: at the end of a word, with a fitting check sum."""
    if text[end - 1] == " " or text[end : end + 1].isalnum():
        return False
    account = text[start:end].replace(" ", "")
    return 15 <= len(account) <= 34 and mod97(account)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the address pattern, found from each @: the run of local characters before it begins the leftmost match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def _candidates(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans that pass their checks."""
    for a, b in _emails(text):
        yield "email", a, b
    if not any(d in text for d in "0123456789"):
        return
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _digits(m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield "card", *m.span()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                yield "phone", *m.span()
    for m in _IBAN.finditer(text):
        end = next((e for e in range(m.end(), m.start() + 14, -1) if _is_account(text, m.start(), e)), None)
        if end:
            yield "iban", m.start(), end
    for m in _SSN.finditer(text):
        if m.group()[:3] not in ("000", "666") and m.group()[0] != "9":
            yield "ssn", *m.span()


def _score(text: str, kind: str, start: int, end: int) -> float:
    """The kind's own score, higher for words of its context nearby, lower for words against it."""
    around = f"{text[max(0, start - _NEAR) : start]} {text[end : end + _NEAR]}".lower()
    words = set(re.findall(r"[a-z]+", around))
    score = _SCORE[kind]
    if any(w.startswith(c) for w in words for c in _CONTEXT[kind]):
        score += 0.2
    if words & set(_AGAINST):
        score -= 0.2
    return round(min(1.0, max(0.0, score)), 2)


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then kind as in ``KINDS``; places are code points, the end exclusive.

    A null or empty text has none. Spans of different kinds may overlap.
    """
    if not text:
        return []
    found = [(k, a, b, _score(text, k, a, b)) for k, a, b in _candidates(text)]
    return sorted((s for s in found if s[0] in BASE or s[3] >= LEAST), key=lambda s: (s[1], KINDS.index(s[0])))


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``spans``, an array of (kind, start, end, score); it replaces a column of that name."""

    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("kind", "start", "end", "score"), s)) for s in find_spans(t)] for t in texts], dtype=object)

    found = F.pandas_udf(spans, "array<struct<kind:string,start:int,end:int,score:double>>")
    return docs.withColumn("spans", found(F.col(f"`{text}`")))


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets; of overlapping spans the first counts."""

    def mask(texts: pd.Series) -> pd.Series:
        def one(value: str | None) -> str | None:
            parts, done = [], 0
            for kind, start, end, _ in find_spans(value):
                if start >= done:
                    parts += [value[done:start], f"<{kind}>"]
                    done = end
            return value if value is None else "".join([*parts, value[done:]])

        return pd.Series([one(t) for t in texts], dtype=object)

    return docs.withColumn(text, F.pandas_udf(mask, "string")(F.col(f"`{text}`")))


def personal_data(docs: DataFrame) -> DataFrame:
    """Digest: counts of the base kinds, a checksum of their spans, and all spans of every document.

    ``base_sha256`` is that of the empty string where nothing is found.
    """
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))

    def joined(items):
        return F.concat_ws(",", F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    def count(kind: str):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return with_spans(docs.select("doc_id", "text")).select(
        "doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans")
    )
