"""A case's record: its files and pages, their order, dates and deletions; the lists of words and staff that reviewers keep.

files(case_id, seq, source_file, pages[, dated]): seq is the order of upload. Word lists are tables with a key column that is
unique whatever its case; the first entry stays. Defined cases: undated files come last, in their order of upload; a request
for a file or page that isn't there changes nothing; null keys are no entries; removing what isn't there changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions import lexicons as L
from vellum.functions.matching import normalize, words

#: What undated files are sorted as.
UNDATED = "9999-99-99"
STAFF_ROWS = 100_000


def in_file_order(files: DataFrame) -> DataFrame:
    """files with place, from 1, in their case: by date, undated last, then by upload."""
    dated = F.coalesce(F.nullif(F.col("dated").cast("string"), F.lit("")), F.lit(UNDATED))
    return files.withColumn("place", F.row_number().over(W.partitionBy("case_id").orderBy(dated, "seq")))


def set_dates(files: DataFrame, requests: DataFrame) -> DataFrame:
    """files with the last date that requests(case_id, source_file, at, dated) give them; a null one removes the date."""
    last = requests.groupBy("case_id", "source_file").agg(F.max_by(F.struct(F.col("dated").cast("string").alias("dated")), "at").alias("__d"))
    out = files.join(last, ["case_id", "source_file"], "left")
    return out.withColumn("dated", F.when(F.col("__d").isNotNull(), F.col("__d")["dated"]).otherwise(F.col("dated").cast("string"))).drop("__d")


def main_file(files: DataFrame, chosen: DataFrame) -> DataFrame:
    """(case_id, main_file): what chosen(case_id, source_file) names if the case has it, else its first file in order."""
    named = files.join(chosen.select("case_id", "source_file").distinct(), ["case_id", "source_file"], "left_semi").groupBy("case_id").agg(F.min("source_file").alias("__named"))
    dated = F.coalesce(F.nullif(F.col("dated").cast("string"), F.lit("")), F.lit(UNDATED))
    first = files.groupBy("case_id").agg(F.min_by("source_file", F.struct(dated, "seq")).alias("__first"))
    return first.join(named, "case_id", "left").select("case_id", F.coalesce("__named", "__first").alias("main_file"))


def bundle_pages(files: DataFrame) -> DataFrame:
    """files in order with the page of the whole bundle that each begins on, from 1."""
    before = W.partitionBy("case_id").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    return in_file_order(files).withColumn("first_page", 1 + F.coalesce(F.sum("pages").over(before), F.lit(0)))


def delete_pages(files: DataFrame, findings: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, findings) without the pages of requests(case_id, source_file, page_num), later pages moving up.

    Requests name pages as they were, from 0; findings on them go."""
    there = files.select("case_id", "source_file", F.col("pages").alias("__n"))
    asked = requests.select("case_id", "source_file", "page_num").distinct().join(there, ["case_id", "source_file"]).filter((F.col("page_num") >= 0) & (F.col("page_num") < F.col("__n")))
    gone = asked.groupBy("case_id", "source_file").agg(F.array_sort(F.collect_set("page_num")).alias("__gone"))  # pages of one file
    left = files.join(gone, ["case_id", "source_file"], "left")
    left = left.withColumn("pages", F.col("pages") - F.coalesce(F.size("__gone"), F.lit(0))).drop("__gone").select(*files.columns)
    out = findings.join(gone, ["case_id", "source_file"], "left")
    none = F.col("__gone").isNull()
    out = out.filter(none | ~F.array_contains("__gone", F.col("page_num")))
    moved = F.col("page_num") - F.size(F.filter("__gone", lambda p: p < F.col("page_num")))
    return left, out.withColumn("page_num", F.when(none, F.col("page_num")).otherwise(moved)).select(*findings.columns)


# ---- lists -----------------------------------------------------------------------------------------------------------


def add_entries(entries: DataFrame, more: DataFrame, key: str, order: str) -> DataFrame:
    """entries with those of more whose key, in any case, isn't there; of several new ones the first by order."""
    new = more.filter(F.col(key).isNotNull()).join(entries.select(F.lower(key).alias("__k")), F.lower(key) == F.col("__k"), "left_anti")
    first = new.groupBy(F.lower(key).alias("__k")).agg(F.min_by(F.struct(*entries.columns), F.col(order)).alias("e")).select("e.*")
    return entries.unionByName(first)


def remove_entries(entries: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return entries.join(keys.select(F.lower(key).alias("__k")).distinct(), F.lower(key) == F.col("__k"), "left_anti")


def telling(name: Column) -> Column:
    """The words of a normalised name that aren't titles."""
    return F.filter(words(name), lambda w: ~w.isin(list(L.STAFF_TITLES)))


def staff_named(names: DataFrame, staff: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows of names(columns..., name) that staff(name) holds: equal to a name or a word of one, or sharing a word that isn't a title.

    Names and staff meet by words, so that a list of any length costs one join; a short one is broadcast."""
    norm = normalize(F.col("name"))
    whole = lambda x: F.struct(F.lit("whole").alias("kind"), x.alias("k"))
    word = lambda x: F.struct(F.lit("word").alias("kind"), x.alias("k"))
    keys = staff.filter(norm != "").select(F.explode(F.concat(F.array(whole(norm)), F.transform(words(norm), whole), F.transform(telling(norm), word))).alias("key")).distinct()
    keys = F.broadcast(keys) if keys.limit(STAFF_ROWS + 1).count() <= STAFF_ROWS else keys
    asked = names.select(*columns, "name", F.explode(F.concat(F.array(whole(norm)), F.transform(telling(norm), word))).alias("key"))
    return asked.join(keys, "key", "left_semi").select(*columns, "name").distinct()
