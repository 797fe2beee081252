"""Dates of documents: from the file name, else the first valid one of four layouts in the first characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions import lexicons as L

#: Where letter dates stand; part of the rule.
HEAD = 2000
YEARS = (1990, 2040)


def filename_date(name: Column) -> Column:
    return F.regexp_extract(name, r"^(\d{4}-\d{2}-\d{2})[_\s]", 1).try_cast("date")


def _iso(day: Column, month: Column, year: Column) -> Column:
    named = F.try_element_at(F.create_map(*[F.lit(x) for kv in L.MONTHS.items() for x in kv]), F.lower(month))
    number = F.coalesce(named.cast("string"), month)
    return F.concat_ws("-", year, F.lpad(number, 2, "0"), F.lpad(day, 2, "0")).try_cast("date")


def document_date(text: Column) -> Column:
    """Layouts in their order; within one, matches by place; a match that is no date falls through to the next."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, HEAD)
    return F.coalesce(*[_first_of(head, "(?U)" + p, *((2, 1) if i == 2 else (1, 2))) for i, p in enumerate(L.DATES)])


def _first_of(head: Column, pattern: str, day: int, month: int) -> Column:
    """The first match of one layout that is a date of the accepted years."""
    g = lambda m, n: F.regexp_extract(m, pattern, n)
    dates = F.transform(F.regexp_extract_all(head, F.lit(pattern), 0), lambda m: _iso(g(m, day), g(m, month), g(m, 3)))
    return F.get(F.filter(dates, lambda x: x.isNotNull() & F.year(x).between(*YEARS)), F.lit(0))
