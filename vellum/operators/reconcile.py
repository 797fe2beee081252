"""Two versions of a findings table as one: re-detection, re-parsing and batch decisions.

findings(case_id, id, seq, source_file, page_num, x0, y0, text, category, status, ...): seq orders a case's findings. A
finding's place is its case, file, page, corner to a tenth of a point, and text in any case. Versions meet as one table dealt
once by case, ordered by that place; decisions meet findings by case, text and category, the last one by seq counting. Every
row of the outcome says what became of it, and rows that are new get ids made from their place, so that a repeated run gives
the same.

Defined cases: null places, texts and categories are equal to each other; rows that repeat a place keep their number and
are matched one by one; columns that only one version has are null for the other's rows; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions.matching import normalize

MANUAL = "manual"
#: Statuses that no one has decided.
UNDECIDED = ("flagged", "auto_redact")


def tenths(x: Column) -> Column:
    """A coordinate to a tenth, as a whole number of tenths."""
    return F.round(F.bround(x, 1) * 10).cast("long")


def _place(*more: str) -> list[Column]:
    """The case, which the rows are spread by, comes first."""
    return [F.col("case_id"), F.col("source_file"), F.col("page_num"), tenths(F.col("x0")), tenths(F.col("y0")), F.lower("text"), *[F.col(c) for c in more]]


def stacked(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both versions as one table, dealt by case: is_new, then the columns of both, null where a version has none."""
    both = old.withColumn("is_new", F.lit(False)).unionByName(new.withColumn("is_new", F.lit(True)), allowMissingColumns=True)
    return both.repartition("case_id")


def remembered(findings: DataFrame) -> DataFrame:
    """(case_id, what, category, decided): the last decision on each text and category of a case."""
    made = findings.filter(~F.col("status").isin(*UNDECIDED))
    return made.groupBy("case_id", normalize(F.col("text")).alias("what"), "category").agg(F.max_by("status", "seq").alias("decided"))


def recall(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """findings with the statuses that decisions, from remembered(), hold for their texts and categories."""
    d = decisions.select(F.col("case_id").alias("__c"), F.col("what").alias("__w"), F.col("category").alias("__k"), "decided")
    same = F.col("case_id").eqNullSafe(F.col("__c")) & normalize(F.col("text")).eqNullSafe(F.col("__w")) & F.col("category").eqNullSafe(F.col("__k"))
    out = findings.join(d, same, "left").withColumn("status", F.coalesce("decided", "status"))
    return out.drop("__c", "__w", "__k", "decided")


def fresh_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 16)


def redetect(old: DataFrame, new: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """The findings after detecting anew, with `change`: kept (in both versions), added, manual (stays) or gone.

    new findings take the status that was decided last for their text and category (decisions: remembered() of old), and
    the id of an old finding at their place with their category; old ones that weren't found again are gone, but for
    manual ones. What is then valid are all rows that aren't gone: new ones by seq, then manual ones by theirs."""
    if decisions is None:
        return redetect_stacked(stacked(old, new))
    return redetect_stacked(stacked(old, recall(new, decisions)), recalled=True)


def redetect_stacked(both: DataFrame, recalled: bool = False) -> DataFrame:
    """redetect() of both versions in one table (is_new, id, ...): rows that are dealt by case are not shuffled again.

    recalled: the new ones have the statuses that were decided before."""
    is_new, keys = F.col("is_new"), _place("category")
    if not recalled:
        made = ~is_new & ~F.col("status").isin(*UNDECIDED)
        same = W.partitionBy("case_id", normalize(F.col("text")), "category")
        decided = F.max_by(F.when(made, F.col("status")), F.when(made, F.col("seq"))).over(same)
        both = both.withColumn("status", F.when(is_new, F.coalesce(decided, "status")).otherwise(F.col("status")))
    both = both.withColumn("__n", F.row_number().over(W.partitionBy(*keys, "is_new").orderBy("seq")))
    place = W.partitionBy(*keys, "__n")
    both = both.withColumns({"__was": F.max(~is_new).over(place), "__now": F.max(is_new).over(place), "__id": F.max(F.when(~is_new, F.col("id"))).over(place)})
    by_hand = F.when(F.col("category") == MANUAL, "manual").otherwise("gone")
    change = F.when(~is_new, by_hand).when(F.col("__was"), "kept").otherwise("added")
    made = F.when(F.col("__was"), F.col("__id")).otherwise(fresh_id(*keys, F.col("__n")))
    out = both.filter(is_new | ~F.col("__now"))
    return out.withColumns({"id": F.when(is_new, made).otherwise(F.col("id")), "change": change}).drop("is_new", "__n", "__was", "__now", "__id")


def count_valid(both: DataFrame) -> DataFrame:
    """(case_id, category, n): how many findings of each case and category redetect() leaves valid, of both versions in one table.

    All new ones are valid, and of manual ones as many at each place as the version with more of them has there. So only
    manual findings need their place: others are dealt by case without it, and old ones that aren't manual not at all."""
    is_new, manual = F.col("is_new"), F.col("category").eqNullSafe(F.lit(MANUAL))
    place = {f"__{i}": F.when(manual, key) for i, key in enumerate(_place()[1:])}
    dealt = both.filter(is_new | manual).select("case_id", "category", "is_new", *[key.alias(name) for name, key in place.items()]).repartition("case_id")
    at = dealt.groupBy("case_id", "category", *place).agg(F.count_if(is_new).alias("__new"), F.count_if(~is_new).alias("__old"))
    return at.groupBy("case_id", "category").agg(F.sum(F.greatest("__new", "__old")).alias("n"))


def reparse(old: DataFrame, new: DataFrame) -> DataFrame:
    """The old findings as they are, and with `change` added the new ones at places that had none, one of each place.

    The first by seq counts; here a place's category doesn't matter."""
    return reparse_stacked(stacked(old, new))


def reparse_stacked(both: DataFrame) -> DataFrame:
    """reparse() of both versions in one table (is_new, id, ...): rows that are dealt by case are not shuffled again."""
    is_new, keys = F.col("is_new"), _place()
    nth = F.row_number().over(W.partitionBy(*keys).orderBy("is_new", F.col("seq").asc_nulls_last()))  # old ones first
    out = both.withColumn("__n", nth).filter(~is_new | (F.col("__n") == 1))
    added = fresh_id(*keys, F.lit(1))
    return out.withColumns({"id": F.when(is_new, added).otherwise(F.col("id")), "change": F.when(is_new, "added").otherwise("kept")}).drop("is_new", "__n")


def decide_by_id(findings: DataFrame, updates: DataFrame) -> DataFrame:
    """findings with the status and exemption that updates(case_id, id, at, status, exemption) give them.

    A null in an update leaves the value; each value's last update by `at` counts."""
    last = updates.groupBy("case_id", "id").agg(
        F.max_by("status", F.when(F.col("status").isNotNull(), F.col("at"))).alias("__s"), F.max_by("exemption", F.when(F.col("exemption").isNotNull(), F.col("at"))).alias("__e")
    )
    out = findings.join(last, ["case_id", "id"], "left")
    return out.withColumns({"status": F.coalesce("__s", "status"), "exemption": F.coalesce("__e", "exemption")}).select(*findings.columns)


def decide_by_text(findings: DataFrame, updates: DataFrame) -> DataFrame:
    """findings with the status of the last of updates(case_id, text, at, status) on their text, whatever their category."""
    last = updates.groupBy(F.col("case_id").alias("__c"), normalize(F.col("text")).alias("__w")).agg(F.max_by("status", "at").alias("__s"))
    out = findings.join(last, (F.col("case_id") == F.col("__c")) & (normalize(F.col("text")) == F.col("__w")), "left")
    return out.withColumn("status", F.coalesce("__s", "status")).select(*findings.columns)
