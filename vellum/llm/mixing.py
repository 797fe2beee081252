"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Size is counted in words. The sources' targets share the total size by weight; none goes above `most` times its source's
size, and what they can't take is shared again by weight until none is above (water filling, solved in one sorted pass
over one row a source). A source whose target is r times its size takes every document floor(r) times for certain. What
is left, R words, is sampled with probabilities in proportion to size: p = min(1, c * size), with c such that the
expected words are R; documents with p = 1 are certain. With its own random number u, a document ranks by
(u / (1 - u)) / (p / (1 - p)), random odds over inclusion odds, and documents are taken in that order while their words
fit. The sample's size is fixed in words. Because whole documents seldom meet it, more passes in the same order give what
is left to documents that still fit, until none does; each takes one document at least. At last the shortest one that is
left is taken too if that brings the sum nearer to R than it is.

c comes from one sorted pass over the distinct sizes of a source. Prefix sums run over buckets of the rank, first
between buckets, then within each, so a source that holds most rows is spread over many tasks. u is a digest of the
doc_id, so reruns agree. Defined cases: null texts have size 0 and are taken for nothing; the null source comes last by
code point; rows that repeat a doc_id are drawn one by one in a fixed order, equal ranks by doc_id and size; a very long
text is certain or waits for room like any other; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.llm.common import BROADCAST_ROWS, drop, stash

WEIGHTS = (5, 2, 1)
MOST = 3
BUCKETS = 1024
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from rows of (source, size)."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(order, F.lit(len(weights))) + 1).cast("int"))
    every = W.partitionBy()
    per = per.withColumn("w", weight.cast("double")).withColumn("cap", (F.col("source_size") * most).cast("double"))
    per = per.withColumns({"total": F.sum("source_size").over(every).cast("double"), "all_w": F.sum("w").over(every)})
    before = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    none = F.lit(0.0)
    per = per.withColumns({"cap_before": F.coalesce(F.sum("cap").over(before), none), "w_before": F.coalesce(F.sum("w").over(before), none)})
    level = (F.col("total") - F.col("cap_before")) / (F.col("all_w") - F.col("w_before"))
    per = per.withColumn("full", F.col("cap") / F.col("w") < level)
    per = per.withColumns({"cap_full": F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), none), "w_full": F.coalesce(F.sum(F.when(F.col("full"), F.col("w"))).over(every), none)})
    shared = (F.col("total") - F.col("cap_full")) * F.col("w") / F.nullif(F.col("all_w") - F.col("w_full"), F.lit(0.0))
    return per.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", shared)).alias("target"))


def random_unit(doc_id: str = "doc_id"):
    """A number strictly between 0 and 1 from a digest of the id: 48 bits."""
    digest = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def slopes(rows: DataFrame, quota: DataFrame) -> DataFrame:
    """(k, c): the factor that makes min(1, c * size) expect left_words words, by source.

    If documents longer than t are certain, c = (left_words - their words) / the other documents' sum of squares; t is
    the largest size at which that gives no more than 1."""
    per = rows.filter("size > 0").groupBy("k", "size").agg(F.count("*").alias("n")).join(quota.select("k", "left_words"), "k")
    longer = W.partitionBy("k").orderBy(F.col("size").desc()).rowsBetween(W.unboundedPreceding, -1)
    others = W.partitionBy("k").orderBy(F.col("size")).rowsBetween(W.unboundedPreceding, 0)
    words, squares = (F.col("size") * F.col("n")).cast("double"), F.col("size").cast("double") * F.col("size") * F.col("n")
    per = per.withColumns({"above": F.coalesce(F.sum(words).over(longer), F.lit(0.0)), "squares": F.sum(squares).over(others)})
    per = per.withColumn("c", (F.col("left_words") - F.col("above")) / F.col("squares"))
    return per.filter((F.col("c") >= 0) & (F.col("c") * F.col("size") <= 1)).groupBy("k").agg(F.max_by("c", "size").alias("c"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) for every row of docs(doc_id, text, source); carry adds columns."""
    thin = docs.select("doc_id", "source", size_of().alias("size"), *carry)
    thin = stash(thin.withColumn("u", random_unit()), "sizes")
    quota = targets(thin, weights, most)
    key = lambda c: F.coalesce(F.concat(F.lit("s"), F.col(c)), F.lit("n"))  # noqa: E731  the null source joins as a key of its own
    quota = given = stash(quota.select(key("source").alias("k"), "source_size", "target"), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    quota = quota.withColumn("sure", F.floor(ratio).cast("long"))
    quota = quota.withColumn("left_words", F.col("target") - F.col("sure") * F.col("source_size"))
    rows = thin.withColumn("k", key("source"))
    quota = quota.join(slopes(rows, quota), "k", "left").withColumn("mean", F.col("left_words") / F.nullif(F.col("source_size"), F.lit(0)))
    # one row a source: broadcast only if counted to be few
    quota = stash(quota, "quotas")
    rows = rows.join(F.broadcast(quota) if quota.count() <= BROADCAST_ROWS else quota, "k")
    p = F.least(F.lit(1.0), F.col("c") * F.col("size"))
    odds = lambda x: x / (1 - x)
    rank = F.when(p >= 1, F.lit(0.0)).when(p > 0, odds(F.col("u")) / odds(p))
    # where all probabilities are equal, this is u again: an even spread
    even = F.col("rank") * odds(F.col("mean"))
    rows = rows.withColumn("rank", rank).withColumn("bucket", F.least(F.floor(F.coalesce(even / (1 + even), F.col("u")) * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
    rows = rows.drop("c", "mean").withColumns({"picked": F.lit(0), "room": F.col("left_words")})
    inside = W.partitionBy("k", "bucket").orderBy(F.col("rank"), F.col("doc_id"), F.col("size")).rowsBetween(W.unboundedPreceding, 0)
    waits = (F.col("picked") == 0) & F.col("rank").isNotNull()
    open_ = waits & (F.col("size") <= F.col("room"))
    few, made = quota.count() <= BROADCAST_ROWS, [thin, given, quota]  # what the first pass still reads
    while True:
        rows = rows.withColumn("ask", F.when(open_, F.col("size")).otherwise(F.lit(0)))
        sums = rows.groupBy("k", "bucket").agg(F.sum("ask").alias("asked"))
        up_to = W.partitionBy("k").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
        sums = sums.select("k", "bucket", F.coalesce(F.sum("asked").over(up_to), F.lit(0)).alias("earlier"))
        rows = rows.join(sums, ["k", "bucket"])
        fits = open_ & (F.col("earlier") + F.sum("ask").over(inside) <= F.col("room"))
        rows = rows.withColumn("picked", F.when(fits, 1).otherwise(F.col("picked"))).drop("ask", "earlier")
        got = rows.groupBy("k", "bucket").agg(F.sum(F.when(F.col("picked") == 1, F.col("size")).otherwise(0)).alias("g"))
        got = got.groupBy("k").agg(F.sum("g").alias("got"))
        got = got.select("k", "got", F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1))).alias("bucket"))
        rows = stash(rows.join(got, ["k", "bucket"]).withColumn("room", F.col("left_words") - F.col("got")).drop("got"), "drawn")
        drop(*made)
        made = [rows]
        if rows.filter(open_).isEmpty():
            break
    nearer = rows.filter(waits & (F.col("size") / 2 < F.col("room"))).groupBy("k").agg(F.min(F.struct("size", "rank", "doc_id")).alias("last"))
    rows = rows.join(F.broadcast(nearer) if few else nearer, "k", "left")
    is_last = waits & F.struct("size", "rank", "doc_id").eqNullSafe(F.col("last"))
    first = W.partitionBy("k", "bucket").orderBy(F.when(is_last, 0).otherwise(1), F.col("rank"), F.col("doc_id"), F.col("size"))
    rows = rows.withColumn("picked", F.when(is_last & (F.row_number().over(first) == 1), 1).otherwise(F.col("picked")))
    copies = F.col("sure") + F.col("picked")
    return rows.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *carry)
