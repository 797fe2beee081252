"""Personal data that patterns alone find, custom phrases and risk words.

Findings are (ord, category, s, e, text, confidence, reason); the searches run over Arrow batches of whole texts."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import lexicons as L
from vellum.functions.matching import ddl, scan

FIELDS = {"ord": "int", "category": "string", "s": "int", "e": "int", "text": "string", "confidence": "double", "reason": "string"}
FOUND = ddl(FIELDS)
Finding = tuple[int, str, int, int, str, float, str]

Terms = Sequence[tuple[str, str]]


def own_domain(email: str) -> bool:
    domain = email.rsplit("@", 1)[-1].lower()
    return any(domain == d or domain.endswith("." + d) for d in L.OWN_DOMAINS)


def valid_number(number: str) -> bool:
    """Modulus-11 check of a ten-digit number; other characters are dropped first."""
    d = [int(c) for c in number if c in "0123456789"]
    return len(d) == 10 and (11 - sum(x * (10 - i) for i, x in enumerate(d[:9])) % 11) % 11 == d[9]


#: The plain categories: order, pattern, test of a match, confidence, reason.
PLAIN = {
    "nhs_number": (0, re.compile(L.NUMBER), valid_number, 0.95, "NHS number (check digit valid)"),
    "phone_number": (1, re.compile(L.PHONE), lambda m: True, 0.90, "UK phone number"),
    "postcode": (2, re.compile(L.POSTCODE), lambda m: True, 0.75, "UK postcode"),
    "email": (3, re.compile(L.EMAIL), lambda m: not own_domain(m), 0.85, "Email address"),
}


def find_plain(text: str, category: str) -> Iterator[Finding]:
    order, pattern, good, confidence, reason = PLAIN[category]
    if category == "email" and "@" not in text:
        return
    for m in pattern.finditer(text):
        if good(m[0]):
            yield order, category, m.start(), m.end(), m[0], confidence, reason


def any_term(terms: Terms) -> re.Pattern:
    """Matches wherever one of the terms does, and perhaps elsewhere: case counts for nothing here."""
    return re.compile("|".join(p.removeprefix("(?i)") for p, _ in terms), re.IGNORECASE)


def find_terms(text: str, terms: Terms, gate: re.Pattern, category: str, first: int) -> Iterator[Finding]:
    """Matches of labelled terms, one term after the other; texts without any are not looked at term by term."""
    if gate.search(text):
        for i, (p, label) in enumerate(terms):
            for m in re.finditer(p, text):
                yield first + i, category, m.start(), m.end(), m[0], 0.75, label


ANY_SAFEGUARDING, ANY_SEXUAL_HEALTH = any_term(L.SAFEGUARDING), any_term(L.SEXUAL_HEALTH)


def find_patterns(text: str) -> Iterator[Finding]:
    """All pattern findings of a text, by category, then pattern, then place."""
    for category in PLAIN:
        yield from find_plain(text, category)
    yield from find_terms(text, L.SAFEGUARDING, ANY_SAFEGUARDING, "safeguarding", 10)
    yield from find_terms(text, L.SEXUAL_HEALTH, ANY_SEXUAL_HEALTH, "sexual_health", 30)


def find_custom(text: str, phrases: Sequence[tuple[str, bool]]) -> Iterator[Finding]:
    """Findings of (phrase, case sensitive) pairs, in their order."""
    for i, (phrase, cased) in enumerate(phrases):
        for m in re.finditer(rf"\b{re.escape(phrase)}\b", text, 0 if cased else re.IGNORECASE):
            yield 100 + i, "custom_word", m.start(), m.end(), m[0], 1.0, f"Custom word: {phrase}"


def plain(text: Column) -> dict[str, Column]:
    """Matches of each plain category."""
    return {c: scan(text, lambda t, c=c: find_plain(t, c), FIELDS) for c in PLAIN}


def labelled(text: Column, terms: Terms, category: str, first: int) -> Column:
    gate = any_term(terms)
    return scan(text, lambda t: find_terms(t, terms, gate, category, first), FIELDS)


def detect_patterns(text: Column) -> Column:
    return scan(text, find_patterns, FIELDS)


def custom_words(text: Column, phrases: Sequence[tuple[str, bool]]) -> Column:
    return scan(text, lambda t: find_custom(t, phrases), FIELDS)


def phrase_pattern(phrase: str) -> str:
    return r"\b\Q" + phrase.replace("\\E", "\\E\\\\E\\Q") + r"\E\b"


def risk_flags(text: Column, risk_words: dict[str, Sequence[str]]) -> Column:
    """array<struct<phrase, category>> of the risk words in a text, in dictionary order."""
    flags = [
        F.when(text.rlike("(?iU)" + phrase_pattern(w)), F.struct(F.lit(w).alias("phrase"), F.lit(c).alias("category"))) for c, ws in risk_words.items() for w in ws
    ]
    return F.array_compact(F.array(*flags)) if flags else F.array().cast("array<struct<phrase:string,category:string>>")


def explode_matches(df: DataFrame, found: Column, *keep: str) -> DataFrame:
    return df.select(*keep, F.explode(found).alias("m")).select(*keep, "m.*")
