"""Regular-expression matches with offsets.

Spark has no function that finds all matches with their places. `scan` hands whole texts in Arrow batches to a Python
search: one pass for any number of patterns, linear in the matches. `find_all` is a column expression for single patterns
with few matches: a text is cut at its matches with two marks, and a fold over the pieces keeps the running offset, odd
pieces being matches. Offsets are code points, ends exclusive."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN, CLOSE = "\u0001", "\u0002"
MATCH = "array<struct<s:int,e:int,text:string>>"
ARROW = {"int": pa.int32(), "double": pa.float64(), "string": pa.string()}


def ddl(fields: dict[str, str]) -> str:
    return "array<struct<" + ",".join(f"{n}:{t}" for n, t in fields.items()) + ">>"


def scan(source: Column, find: Callable[..., Iterable[tuple]], fields: dict[str, str]) -> Column:
    """What a Python search finds in each value, tuples as array<struct<fields>>; nulls give an empty array."""
    kind = pa.list_(pa.struct([pa.field(n, ARROW[t]) for n, t in fields.items()]))

    def run(values: pa.Array) -> pa.Array:
        rows, ends = [], [0]
        for v in values:
            if v.is_valid:
                rows.extend(find(v.as_py()))
            ends.append(len(rows))
        columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
        found = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind.value_type, strict=True)], fields=list(kind.value_type))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)

    return F.arrow_udf(run, returnType=ddl(fields))(source)


def clean(text: Column) -> Column:
    """The text without the marks; one other control character stands for each, so offsets hold."""
    return F.translate(F.coalesce(text, F.lit("")), OPEN + CLOSE, "\u0003\u0003")


def _cut(text: Column, pattern: str, replacement: str) -> Column:
    parts = F.split(F.regexp_replace(clean(text), "(?U)" + pattern, replacement), f"[{OPEN}{CLOSE}]", -1)
    first = F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"), F.array().cast(MATCH).alias("found"))

    def step(a: Column, x: Column) -> Column:
        end = a["at"] + F.char_length(x)
        found = F.when(a["hit"], F.array_append(a["found"], F.struct(a["at"].alias("s"), end.alias("e"), x.alias("text")))).otherwise(a["found"])
        return F.struct(end.alias("at"), (~a["hit"]).alias("hit"), found.alias("found"))

    # texts without a match are never cut
    return F.when(clean(text).rlike("(?U)" + pattern), F.aggregate(parts, first, step)["found"]).otherwise(F.array().cast(MATCH))


def find_all(text: Column, pattern: str) -> Column:
    """All matches of the pattern, as array<struct<s, e, text>>."""
    return _cut(text, pattern, f"{OPEN}$0{CLOSE}")


def group(text: Column, pattern: str, n: int) -> Column:
    return F.regexp_extract(text, "(?U)" + pattern, n)


def strip(text: Column) -> Column:
    """Without Unicode blanks at either end."""
    return F.regexp_replace(text, r"(?U)(^\s+)|(\s+$)", "")


def normalize(text: Column) -> Column:
    return F.lower(strip(text))


def strip_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, r"""(?U)^[\s.,;:'"-]+|[\s.,;:'"-]+$""", "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def snippet(text: Column, s: Column, e: Column, around: int = 70) -> Column:
    """The match with its surroundings, blanks collapsed, marked where cut."""
    a = F.greatest(s - around, F.lit(0))
    b = F.least(e + around, F.char_length(text))
    body = F.trim(F.regexp_replace(F.substring(text, a + 1, b - a), r"(?U)\s+", " "))
    return F.concat(F.when(a > 0, F.lit("…")).otherwise(F.lit("")), body, F.when(b < F.char_length(text), F.lit("…")).otherwise(F.lit("")))


def valid_check_digit(number: Column) -> Column:
    """Modulus-11 check of a ten-digit number; other characters are dropped first."""
    d = F.regexp_replace(number, r"[^0-9]", "")
    digit = lambda i: F.substring(d, i, F.lit(1)).cast("int")
    total = sum((digit(F.lit(i + 1)) * (10 - i) for i in range(9)), F.lit(0))
    left = 11 - total % 11
    want = F.when(left == 11, 0).otherwise(left)
    return F.when(F.char_length(d) == 10, (want != 10) & (want == digit(F.lit(10)))).otherwise(F.lit(False))
