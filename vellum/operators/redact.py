"""Redaction of page text, bundle parts and line layout, as folds over arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "[REDACTED]"


def blank_out(text: Column, spans: Column, mark: str = MARK) -> Column:
    """The text with each [s, e) of array<struct<s, e>> replaced; overlapping spans are merged."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].cast("int").alias("s"), x["e"].cast("int").alias("e"))))

    def step(a: Column, x: Column) -> Column:
        fresh = x["s"] >= a["at"]
        before = F.substring(text, a["at"] + 1, F.greatest(x["s"] - a["at"], F.lit(0)))
        out = F.when(fresh, F.concat(a["out"], F.array(before, F.lit(mark)))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], x["e"]).alias("at"), out.alias("out"))

    folded = F.aggregate(ordered, start, step)
    return F.concat(F.array_join(folded["out"], ""), F.substring(text, folded["at"] + 1, F.char_length(text)))


def outcomes(pages: DataFrame, candidates: DataFrame) -> DataFrame:
    """candidates with outcome: box, search or failed, null where none is asked for; pages([case_id, ]source_file, page_num, text).

    Only approved and automatic ones are placed. All four coordinates must be positive and the box not empty; else the
    text is searched on its page; a page that is gone, a blank text and a text that isn't found fail."""
    keys = [c for c in ("case_id", "source_file", "page_num") if c in pages.columns]
    page = pages.select(*[F.col(c).alias(f"__{c}") for c in keys], F.lit(True).alias("__here"), F.col("text").alias("__t"))
    same = F.lit(True)
    for c in keys:
        same = same & (F.col(c) == F.col(f"__{c}"))
    rows = candidates.join(page, same, "left")
    return rows.withColumn("outcome", outcome_on(F.col("__here"), F.col("__t"))).drop("__here", "__t", *[f"__{c}" for c in keys])


def outcome_on(here: Column, page_text: Column) -> Column:
    """The outcome of a candidate beside its page's text; here is null where the page is gone."""
    box = (F.col("x0") > 0) & (F.col("y0") > 0) & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))
    found = (F.trim("text") != "") & F.contains(F.lower(page_text), F.lower("text"))
    outcome = F.when(here.isNull(), "failed").when(box, "box").when(found, "search").otherwise("failed")
    return F.when(F.col("status").isin("auto_redact", "approved"), outcome)


def apply_redactions(pages: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidates that are to be redacted, with their outcome."""
    return outcomes(pages, candidates.filter(F.col("status").isin("auto_redact", "approved")))


def split_parts(files: Column, most_bytes: int, most_parts: int = 5) -> Column:
    """Part number, from 0, of each file of array<struct<file, size>> in order: greedy, never more than most_parts.

    The cap grows by a quarter until the parts fit; a file above the cap has a part to itself."""
    bind = lambda x, f: F.transform(F.array(x), f)[0]  # noqa: E731  x is worked out once, not wherever f names it
    total = F.aggregate(files, F.lit(0).cast("long"), lambda a, x: a + x["size"])
    none = F.struct(F.lit(-1).alias("part"), F.lit(0).cast("long").alias("size"))

    def after(a: Column, x: Column, cap: Column) -> Column:
        """The part that takes a file, and the part's size with it."""
        new = (a["part"] < 0) | ((a["size"] > 0) & (a["size"] + x["size"] > cap))
        return F.struct((a["part"] + new.cast("int")).alias("part"), (F.when(new, F.lit(0)).otherwise(a["size"]) + x["size"]).cast("long").alias("size"))

    def n_parts(cap: Column) -> Column:
        return F.aggregate(files, none, lambda a, x: after(a, x, cap))["part"] + 1

    def larger(a: Column) -> Column:
        fits = a["fits"] | (n_parts(a["cap"]) <= most_parts)
        return bind(fits, lambda f: F.struct(F.when(f, a["cap"]).otherwise(F.floor(a["cap"] * 1.25).cast("long")).alias("cap"), f.alias("fits")))

    def fitting(first: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.lit(24)), F.struct(first.alias("cap"), F.lit(False).alias("fits")), lambda a, _: larger(a))["cap"]

    def greedy(cap: Column) -> Column:
        start = F.struct(none.alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda a, x: bind(after(a["at"], x, cap), lambda at: F.struct(at.alias("at"), F.array_append(a["out"], at["part"]).alias("out")))
        return F.aggregate(files, start, step)["out"]

    def dealt(total: Column) -> Column:
        first = F.greatest(F.lit(most_bytes).cast("long"), F.ceil(total / most_parts)).cast("long")
        return F.when(total <= most_bytes, F.transform(files, lambda _: F.lit(0))).otherwise(bind(fitting(first), greedy))

    return bind(total, dealt)


def wrap(text: Column, width: int) -> Column:
    """Lines of at most width characters, broken between words; a longer word has a line of its own."""
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")

    def step(a: Column, w: Column) -> Column:
        fits = F.char_length(a["line"]) + 1 + F.char_length(w) <= width
        empty = a["line"] == ""
        line = F.when(empty, w).when(fits, F.concat_ws(" ", a["line"], w)).otherwise(w)
        out = F.when(empty | fits, a["out"]).otherwise(F.array_append(a["out"], a["line"]))
        return F.struct(line.alias("line"), out.alias("out"))

    got = F.aggregate(words, F.struct(F.lit("").alias("line"), F.array().cast("array<string>").alias("out")), step)
    return F.when(got["line"] == "", got["out"]).otherwise(F.array_append(got["out"], got["line"]))
