"""Names learned from decisions: words of approved names that no list holds, kept as suggestions until accepted or dismissed.

state(name, n, last_seen, examples): one row a suggested name; accepted(name) and dismissed(name): what was decided on them.
Every finalised case adds to the state. No task gathers all findings of a name: counts combine before the shuffle, and of
a name's texts only the first few are kept there too.

Defined cases: null and empty texts hold no names; a word is counted as often as it occurs; words of fewer than three
letters, listed names and words that are no names don't count; dismissed names are counted on but never suggested.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions import lexicons as L

EXAMPLES = 3
STATE = "name string, n long, last_seen timestamp, examples array<string>"


def name_words(text: Column) -> Column:
    """The words of a name, as often as they occur: three letters or more, without quotes and hyphens at their ends."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z'\-]{3,}"), F.lit(0))
    bare = F.transform(found, lambda w: F.regexp_replace(F.lower(w), r"^['\-]+|['\-]+$", ""))
    return F.filter(bare, lambda w: F.char_length(w) >= 3)


def unknown(words: DataFrame, known: Iterable[str] | DataFrame) -> DataFrame:
    """words(name, ...) that are neither known nor among the words that are no names; known: a collection, or a table(name)."""
    words = words.filter(~F.col("name").isin(sorted(L.NOT_NAMES)))
    if isinstance(known, DataFrame):
        return words.join(known.select(F.lower(F.trim("name")).alias("name")).distinct(), "name", "left_anti")
    return words.filter(~F.col("name").isin(sorted(known)))


def learn(findings: DataFrame, known: Iterable[str] | DataFrame) -> DataFrame:
    """The state that findings(text, category, status, at, ...) add: at orders them and says when they were decided.

    Ties of `at` go by the text, so that the examples don't depend on the tasks."""
    approved = findings.filter((F.col("status") == "approved") & (F.col("category") == "person_name"))
    each = unknown(approved.select(F.explode(name_words(F.col("text"))).alias("name"), "text", "at"), known)
    texts = each.groupBy("name", "text").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))
    nth = F.row_number().over(W.partitionBy("name").orderBy(F.col("first"), "text"))  # cut to the first few before the shuffle
    few = texts.select("name", "text", "first").withColumn("nth", nth).filter(F.col("nth") <= EXAMPLES)
    shown = few.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda x: x["text"]).alias("examples"))
    total = each.groupBy("name").agg(F.count("*").alias("n"), F.max("at").alias("last_seen"))
    return total.join(shown, "name").select("name", "n", "last_seen", "examples")


def add(state: DataFrame, more: DataFrame) -> DataFrame:
    """Two states as one, the first one's examples first."""
    a, b = state.select("name", F.struct("n", "last_seen", "examples").alias("a")), more.select("name", F.struct("n", "last_seen", "examples").alias("b"))
    none = F.array().cast("array<string>")
    both = F.concat(F.coalesce("a.examples", none), F.coalesce("b.examples", none))
    n = F.coalesce("a.n", F.lit(0)) + F.coalesce("b.n", F.lit(0))
    return a.join(b, "name", "full_outer").select("name", n.alias("n"), F.greatest("a.last_seen", "b.last_seen").alias("last_seen"), F.slice(F.array_distinct(both), 1, EXAMPLES).alias("examples"))


def suggestions(state: DataFrame, accepted: DataFrame, dismissed: DataFrame, least: int = 2) -> DataFrame:
    """The state's names that occurred so often and that no one has decided on, the most frequent first."""
    decided = accepted.select("name").unionByName(dismissed.select("name")).select(F.lower(F.trim("name")).alias("name"))
    return state.filter(F.col("n") >= least).join(decided.distinct(), "name", "left_anti").orderBy(F.col("n").desc(), "name")


def accept(state: DataFrame, accepted: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state without the names, accepted with them); blank names are ignored."""
    return _without(state, names), _with(accepted, names)


def dismiss(state: DataFrame, dismissed: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state without the names, dismissed with them): they never come back as suggestions."""
    return _without(state, names), _with(dismissed, names)


def _clean(names: DataFrame) -> DataFrame:
    return names.select(F.lower(F.trim("name")).alias("name")).filter("name <> ''").distinct()


def _without(state: DataFrame, names: DataFrame) -> DataFrame:
    return state.join(_clean(names), "name", "left_anti")


def _with(decided: DataFrame, names: DataFrame) -> DataFrame:
    return _clean(decided.select("name").unionByName(names.select("name")))
