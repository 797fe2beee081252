"""Whose data a finding is: the subject's, a member of staff's, or a third party's, and what to do with it."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import dropwhile

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions import lexicons as L
from vellum.functions.matching import normalize, scan, strip_punctuation, words

#: Words that don't count in addresses.
STOPWORDS = "the a an and of in at on to".split()


@dataclass(frozen=True)
class Subject:
    full_name: str = ""
    first_name: str = ""
    last_name: str = ""
    nhs_number: str = ""
    date_of_birth: str = ""
    address: str = ""
    phone: str = ""
    email: str = ""
    aliases: Sequence[str] = field(default_factory=tuple)


def _norm(text: str) -> str:
    return text.strip().lower()


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def address_match(cleaned: Column, address: str) -> Column:
    """Most of the finding's words are in the address, and house numbers don't differ."""
    home = _norm(address)
    own = F.array_distinct(F.array_except(words(cleaned), _strings(STOPWORDS)))
    number = r"(?U)(\b\d+[a-z]?\b)"
    mine = F.regexp_extract_all(F.lit(home), F.lit(number), 1)
    theirs = F.regexp_extract_all(cleaned, F.lit(number), 1)
    conflict = (F.size(mine) > 0) & (F.size(theirs) > 0) & ~F.arrays_overlap(mine, theirs)
    shared = F.size(F.array_intersect(own, _strings(sorted(set(home.split())))))
    return ~conflict & (F.size(own) > 0) & (shared >= F.greatest(F.lit(1.0), F.size(own) * 0.7))


def is_subject(entity: Column, s: Subject) -> Column:
    """Any of nine rules says that the finding is the subject's own."""
    cleaned = normalize(strip_punctuation(entity))
    parts = words(cleaned)
    out = F.lit(False)
    if s.full_name:
        out = out | (cleaned == _norm(s.full_name)) | cleaned.contains(_norm(s.full_name))
    if s.first_name:
        out = out | ((F.size(parts) == 1) & (parts[0] == _norm(s.first_name)))
    if s.last_name:
        more = F.array_contains(parts, _norm(s.first_name)) if s.first_name else F.lit(False)
        out = out | (F.array_contains(parts, _norm(s.last_name)) & ((F.size(parts) == 1) | more))
    for alias in s.aliases:
        if alias:
            out = out | (cleaned == _norm(alias))
    digits = lambda c, drop: F.regexp_replace(c, drop, "")
    if s.nhs_number:
        out = out | (digits(entity, r"(?U)[\s\-]") == digits(F.lit(s.nhs_number), r"(?U)[\s\-]"))
    if s.date_of_birth:
        out = out | (cleaned == _norm(s.date_of_birth))
    if s.phone:
        out = out | (digits(entity, r"(?U)[\s\-()]") == digits(F.lit(s.phone), r"(?U)[\s\-()]"))
    if s.email:
        out = out | (cleaned == _norm(s.email))
    if s.address:
        out = out | address_match(cleaned, s.address)
    return F.coalesce(out, F.lit(False))


def name_variants(entity: Column) -> Column:
    """The name, and for `Surname, Forename` also `Forename Surname`; the first comma counts."""
    at = F.instr(entity, ",")
    turned = F.concat(F.trim(F.substring(entity, at + 1, F.char_length(entity))), F.lit(" "), F.trim(F.substring(entity, F.lit(1), at - 1)))
    return F.when(at > 0, F.array(entity, turned)).otherwise(F.array(entity))


def is_staff(name: Column, staff: Sequence[str]) -> Column:
    """Equal to a staff name, or sharing any word that isn't a title with one."""
    norm = normalize(name)
    names = sorted({_norm(x) for x in staff})
    tokens = sorted({t for n in names for t in n.split()})
    telling = sorted(set(tokens) - set(L.STAFF_TITLES))
    if not names:
        return F.lit(False)
    out = norm.isin(names) | norm.isin(tokens)
    return out | F.arrays_overlap(words(norm), _strings(telling)) if telling else out


def without_title(name: Column) -> Column:
    """The normalised name without its first word where that is a title."""
    w = words(normalize(name))
    lead = F.rtrim(F.get(w, F.lit(0)), F.lit(".")).isin(L.TITLES)
    return F.array_join(F.when(lead, F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0)))).otherwise(w), " ")


STAFF_FIELD = re.compile("{}({}){}".format(*L.STAFF_FIELD))


def staff_named(text: str) -> Iterator[tuple[str]]:
    """Names in staff-labelled fields, with and without their titles, each once."""
    raw = [m[1].strip().lower() for m in STAFF_FIELD.finditer(text)]
    bare = (" ".join(dropwhile(lambda w: w.rstrip(".") in L.TITLES, name.split())) for name in raw)
    yield from ((n,) for n in dict.fromkeys([*raw, *bare]) if n)


def page_staff(text: Column) -> Column:
    """Names in staff-labelled fields of a page, with and without their titles."""
    return F.transform(scan(text, staff_named, {"name": "string"}), lambda m: m["name"])


def in_staff_label(text: Column, s: Column, back: int = 90) -> Column:
    """A staff label stands within the characters before the place."""
    a = F.greatest(s - back, F.lit(0))
    return F.substring(text, a + 1, s - a).rlike("(?U)" + L.STAFF_LABEL)


def decide(subject: Column, staff: Column, confidence: Column, auto: float) -> Column:
    return (
        F.when(subject, F.lit("excluded_subject")).when(staff, F.lit("excluded_staff")).when(confidence >= auto, F.lit("auto_redact")).otherwise(F.lit("flagged"))
    )
