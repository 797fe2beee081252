"""Names in eight layouts, then a greedy pass that keeps the first of overlapping ones.

Each layout gives (prio, s, e, text, confidence, reason); the layouts are ordered by priority, within one by place, and a
match is kept only if it overlaps none that was kept before it. The search runs over Arrow batches of whole texts."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

from pyspark.sql import Column

from vellum.functions import lexicons as L
from vellum.functions.matching import ddl, scan

FIELDS = {"prio": "int", "s": "int", "e": "int", "text": "string", "confidence": "double", "reason": "string"}
FOUND = ddl(FIELDS)
Match = tuple[int, int, int, str, float, str]

NOT_NAMES, EPONYM_FOLLOWERS = frozenset(L.NOT_NAMES), frozenset(L.EPONYM_FOLLOWERS)
SURNAME_COMMA, TITLECASE_COMMA, TITLE_NAME = re.compile(L.SURNAME_COMMA), re.compile(L.TITLECASE_COMMA), re.compile(L.TITLE_NAME)
FULL_NAME, ALL_CAPS = re.compile(L.FULL_NAME), re.compile(L.ALL_CAPS)
DEAR, RELATION, BRACKET = (re.compile(f"{before}({inner}){after}") for before, inner, after in (L.DEAR, L.RELATION, L.BRACKET))


def valid_word(word: str) -> bool:
    w = word.lower().rstrip(".,;:")
    return len(w) >= 2 and w not in NOT_NAMES and not w.isdecimal()


def _surname_comma(text: str, lex: L.NameLexicon) -> Iterator[Match]:
    for m in SURNAME_COMMA.finditer(text):
        if valid_word(m[1]) and valid_word(m[2]):
            sure = m[2].lower() in lex.forenames or m[1].lower() in lex.surnames
            yield 1, m.start(), m.end(), m[0], 0.90 if sure else 0.72, "Surname-first record format (SURNAME, Forename)"


def _titlecase_comma(text: str, lex: L.NameLexicon) -> Iterator[Match]:
    for m in TITLECASE_COMMA.finditer(text):
        if m[1].lower() in lex.surnames and valid_word(m[1]) and valid_word(m[2]):
            yield 2, m.start(), m.end(), m[0], 0.72, "Surname-first format (known UK surname)"


def _titled(text: str, lex: L.NameLexicon) -> Iterator[Match]:
    for m in TITLE_NAME.finditer(text):
        if valid_word(m[2]):
            yield 3, m.start(), m.end(), " ".join(g for g in m.groups() if g), 0.90, f"Name with title ({m[1]})"


def _salutation(text: str, lex: L.NameLexicon) -> Iterator[Match]:
    for m in DEAR.finditer(text):
        if valid_word(m[1].split()[0]):
            yield 4, m.start(1), m.end(1), m[1].strip(), 0.85, "Name in salutation (Dear...)"


def _relation(text: str, lex: L.NameLexicon) -> Iterator[Match]:
    for m in RELATION.finditer(text):
        if valid_word(m[1].split()[0]):
            yield 5, m.start(1), m.end(1), m[1].strip(), 0.80, "Name in relational context"


def _bracket(text: str, lex: L.NameLexicon) -> Iterator[Match]:
    for m in BRACKET.finditer(text):
        if all(map(valid_word, m[1].split())):
            yield 6, m.start(1), m.end(1), m[1].strip(), 0.92, "Name with relational bracket (e.g. Husband, Carer)"


def _pairs(pattern: re.Pattern, text: str, lex: L.NameLexicon) -> Iterator[re.Match]:
    for m in pattern.finditer(text):
        a, b = m[1].lower(), m[2].lower()
        known = a in lex.surnames or b in lex.surnames or a in lex.forenames or b in lex.forenames
        if known and b not in EPONYM_FOLLOWERS and valid_word(a) and valid_word(b):
            yield m


def _full_name(text: str, lex: L.NameLexicon) -> Iterator[Match]:
    for m in _pairs(FULL_NAME, text, lex):
        yield 7, m.start(), m.end(), m[0], 0.65, "Full name (capitalised words, known name)"


def _all_caps(text: str, lex: L.NameLexicon) -> Iterator[Match]:
    for m in _pairs(ALL_CAPS, text, lex):
        yield 8, m.start(), m.end(), m[0], 0.70, "ALL-CAPS full name (known UK name)"


#: The layouts by operator id, in order of priority.
LAYOUTS = {
    "n1": _surname_comma, "n2": _titlecase_comma, "n3": _titled, "n4": _salutation, "n5": _relation, "n6": _bracket, "n7": _full_name, "n8": _all_caps,
}


def keep_first(found: Iterable[Match]) -> list[Match]:
    """The matches that overlap none accepted before them, in the given order; accepted ones stay sorted for the search."""
    kept, starts, ends = [], [], []
    for m in found:
        at = bisect_left(starts, m[2])
        if at == 0 or ends[at - 1] <= m[1]:
            kept.append(m)
            starts.insert(at, m[1])
            ends.insert(at, m[2])
    return kept


def find_names(text: str, lex: L.NameLexicon) -> list[Match]:
    """All names of a text by place."""
    return sorted(keep_first(m for layout in LAYOUTS.values() for m in layout(text, lex)), key=lambda m: m[1])


def layouts(text: Column, lex: L.NameLexicon) -> dict[str, Column]:
    """The matches of every layout, by its operator id, before any suppression."""
    return {k: scan(text, lambda t, layout=layout: layout(t, lex), FIELDS) for k, layout in LAYOUTS.items()}


def suppress(found: Column) -> Column:
    return scan(found, lambda rows: keep_first(tuple(r[n] for n in FIELDS) for r in rows), FIELDS)


def detect_names(text: Column, lex: L.NameLexicon = L.DEFAULT_LEXICON) -> Column:
    """All names of a text by place."""
    return scan(text, lambda t: find_names(t, lex), FIELDS)
