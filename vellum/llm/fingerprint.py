"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A text is the weighted set of its words, the weight being the word's count. For sample k every word has a Gamma(2, 1)
rate r, a Gamma(2, 1) cost c and a uniform offset b, all taken from one hash of (word, k). At weight w the word stands at
level t = floor(ln w / r + b) and competes with ln c - r (t - b + 1); the smallest wins. Two texts draw the same (word,
level) with probability sum(min weights) / sum(max weights), the generalised Jaccard similarity. The winning value
itself names the word and level, so a sample is a plain minimum, combined within a task before anything else.

The gamma variables are read from quantile tables: r from 256 equally likely values, ln c from 1024 quantiles with
straight lines between them and its square-root law in the lowest. Words are counted where the text is: rows are
shuffled once, by bucket of doc_id, and both aggregations reuse that partitioning. A fingerprint is `samples` hashes of
16 bits as hex; the likeness of two is their share of equal positions.

Defined cases: a null or blank text has no words, its fingerprint is all `ffff`, and it is like another such only (1,
else 0); null ids sort after all others; rows that repeat a doc_id follow one another by text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SAMPLES = 64
GROUP = 4
#: Numbers that travel with a document's words: tail, id, length and the digest in five parts of 13 hex digits.
FACTS = 8
RATES, COSTS = 256, 1024
BLANK = r"[\x20\x09-\x0D]+"
DOCS_PER_BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 500, 16, 20_000


def gamma2_quantile(u: np.ndarray) -> np.ndarray:
    """Inverse distribution function of Gamma(2, 1), 1 - (1 + x) exp(-x), by bisection."""
    low, high = np.zeros_like(u), np.full_like(u, 60.0)
    for _ in range(80):
        mid = (low + high) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < u
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


def _tables() -> tuple[Column, Column]:
    rates = gamma2_quantile((np.arange(RATES) + 0.5) / RATES)
    u = np.arange(COSTS + 1) / COSTS
    u[0], u[-1] = 0.5 / COSTS, 1 - 0.1 / COSTS
    return F.lit(rates), F.lit(np.log(gamma2_quantile(u)))  # array literals


def draw(terms: DataFrame, samples: int) -> DataFrame:
    """(bucket, rn, a0.., f, g): facts and fingerprints of both texts of every document from terms(bucket, rn, h, w1, w2, v).

    h hashes a word, w1 and w2 are the logarithms of its counts in the two texts, null where it isn't in one; rows without
    both hold fact number h of the document in v. Samples
    are drawn in groups of GROUP, so that the generated code of one aggregation stays small enough to be compiled, and
    in steps, so that no shared part is computed twice."""
    rates, costs = _tables()
    n = range(GROUP)
    parts_of = max(samples // GROUP, FACTS)
    rows = terms.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts_of - 1))))
    keys = ["bucket", "rn", "part", "w1", "w2", "v"]
    # fact i travels with part i: one plain maximum beside the minima
    rows = rows.withColumn("v", F.when(F.col("w1").isNull() & F.col("w2").isNull() & (F.col("h") == F.col("part")), F.col("v")))
    rows = rows.select(*keys, *[F.xxhash64("h", F.col("part") * GROUP + k).alias(f"z{k}") for k in n])

    def parts(k: int) -> list[Column]:
        z = F.col(f"z{k}")
        return [
            F.get(rates, z.bitwiseAND(RATES - 1).cast("int")).alias(f"r{k}"),
            (F.shiftrightunsigned(z, 8).bitwiseAND((1 << 20) - 1) / float(1 << 20)).alias(f"b{k}"),
            F.shiftrightunsigned(z, 28).bitwiseAND(COSTS - 1).cast("int").alias(f"i{k}"),
            ((F.shiftrightunsigned(z, 38).bitwiseAND((1 << 26) - 1) + 0.5) / float(1 << 26)).alias(f"f{k}"),
        ]

    rows = rows.select(*keys, *[c for k in n for c in parts(k)])

    def cost(k: int) -> Column:
        i, f = F.col(f"i{k}"), F.col(f"f{k}")
        left = F.get(costs, i)
        return F.when(i == 0, F.log(f * (2.0 / COSTS)) * 0.5).otherwise(left + f * (F.get(costs, i + 1) - left)).alias(f"c{k}")

    rows = rows.select(*keys, *[F.col(f"{x}{k}") for k in n for x in "rb"], *[cost(k) for k in n])
    value = lambda k, w: F.col(f"c{k}") - F.col(f"r{k}") * (F.floor(F.col(w) / F.col(f"r{k}") + F.col(f"b{k}")) - F.col(f"b{k}") + 1.0)
    least = rows.groupBy("bucket", "rn", "part").agg(*[F.min(value(k, w)).alias(f"{w}_{k}") for w in ("w1", "w2") for k in n], F.max("v").alias("v"))
    code = lambda w: F.concat(*[_code(F.col(f"{w}_{k}")) for k in n])
    facts = [F.max(F.when(F.col("part") == i, F.col("v"))).alias(f"a{i}") for i in range(FACTS)]
    whole = least.groupBy("bucket", "rn").agg(*facts, F.array_sort(F.collect_list(F.when(F.col("part") < samples // GROUP, F.struct("part", code("w1").alias("f"), code("w2").alias("g"))))).alias("p"))
    return whole.select("bucket", "rn", *[f"a{i}" for i in range(FACTS)], F.array_join(F.col("p.f"), "").alias("f"), F.array_join(F.col("p.g"), "").alias("g"))


def _code(value: Column) -> Column:
    """16 bits of a winning value as hex; ffff where nothing competed."""
    bits = F.pmod(F.xxhash64(value), F.lit(0xFFFF))
    return F.when(value.isNull(), F.lit("ffff")).otherwise(F.lower(F.lpad(F.hex(bits), 4, "0")))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal positions of two fingerprints; null where one is null."""
    same = F.lit(0)
    for k in range(samples):
        same = same + (F.substring(a, 4 * k + 1, 4) == F.substring(b, 4 * k + 1, 4)).cast("int")
    return same / F.lit(float(samples))


def words_of(text: Column) -> Column:
    return F.split(text, BLANK)


def id_bounds(docs: DataFrame, key: str) -> list[int]:
    """Ascending ids that cut the table into buckets of about equal size; at most MOST_BUCKETS of them."""
    n = docs.count()
    parts = min(MOST_BUCKETS, max(LEAST_BUCKETS, n // DOCS_PER_BUCKET))
    shares = [i / parts for i in range(parts)]
    got = docs.agg(F.percentile_approx(key, shares, 20 * parts).alias("q"), F.min(key).alias("least")).first()
    return sorted({got["least"], *got["q"]}) if got["q"] else []


def with_bucket(rows: DataFrame, key: str, bounds: list[int], name: str) -> DataFrame:
    """Adds the number of bounds that are at most the id, by binary search; null ids go to the last bucket.

    Plain expressions only: a lambda's variables would keep Spark from seeing that two branches ask for one shuffle."""
    if not bounds:
        return rows.withColumn(name, F.lit(0))
    table, step = _ids(bounds), 1 << (len(bounds).bit_length() - 1)
    rows = rows.withColumn(name, F.lit(0))
    while step:
        rows = rows.withColumn(name, F.when(F.get(table, F.col(name) + (step - 1)) <= F.col(key), F.col(name) + step).otherwise(F.col(name)))
        step //= 2
    return rows.withColumn(name, F.when(F.col(key).isNull(), len(bounds)).otherwise(F.col(name)))


def _ids(bounds: list[int]) -> Column:
    return F.lit(np.array(bounds, dtype=np.int64))  # an array literal


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(bucket, rn, tail, id, text, after): each document with the text of the next by ascending id, the last with the first's.

    A bucket begins with the document whose id is its bound; that row is also sent to the bucket before, behind its
    rows, and the first of all to the last bucket. So no window spans more than one bucket. Those extra rows have tail > 0."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    bounds = id_bounds(rows, "id")
    last, least = len(bounds), bounds[0] if bounds else None
    rows = with_bucket(rows, "id", bounds, "own")
    place = lambda b, t: F.struct(b.cast("int").alias("bucket"), F.lit(t).alias("tail"))
    if bounds:
        opens = (F.col("own") > 1) & (F.get(_ids(bounds), F.col("own") - 1) == F.col("id"))
        places = F.array(place(F.col("own"), 0), F.when(opens, place(F.col("own") - 1, 1)), F.when(F.col("id") == least, place(F.lit(last), 2)))
    else:
        places = F.array(place(F.col("own"), 0), place(F.lit(0), 2))
    rows = rows.withColumn("place", F.explode(places)).filter("place is not null").select("place.*", "id", "text")
    order = W.partitionBy("bucket").orderBy("tail", F.col("id").asc_nulls_last(), "text")
    return rows.withColumns({"rn": F.row_number().over(order), "after": F.lead("text").over(order)})


def edited(text: Column, after: Column) -> Column:
    """The text with its last floor(n / 2) code points replaced by the first as many, or all, of the next one."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(after, F.lit(1), half))


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row of docs(doc_id, text)."""
    if samples % GROUP:
        raise ValueError(f"samples must be a multiple of {GROUP}")
    rows = with_next(docs).withColumn("new", F.when(F.col("tail") == 0, edited(F.col("text"), F.coalesce("after", "text"))))
    digest = F.sha2(F.encode("new", "UTF-8"), 256)
    numbers = [F.col("tail"), F.col("id"), F.char_length("text"), *[F.conv(F.substring(digest, 13 * i + 1, 13), 16, 10) for i in range(5)]]
    facts = F.array(*[F.coalesce(n.cast("string"), F.lit("")) for n in numbers])
    split = rows.select("bucket", "rn", words_of(F.col("text")).alias("a"), F.coalesce(words_of(F.col("new")), F.array().cast("array<string>")).alias("b"), facts.alias("facts"))
    words = split.select("bucket", "rn", (F.size("a") + FACTS).alias("n"), F.posexplode(F.concat("facts", "a", "b")).alias("at", "word")).filter("word <> ''")
    fact = F.col("at") < FACTS
    terms = words.select(
        "bucket", "rn", F.when(fact, F.col("at").cast("long")).otherwise(F.xxhash64("word")).alias("h"), F.when(fact, F.col("word").cast("long")).alias("v"),
        (~fact & (F.col("at") < F.col("n"))).cast("int").alias("first"), (F.col("at") >= F.col("n")).cast("int").alias("second"),
    )
    terms = terms.groupBy("bucket", "rn", "h").agg(F.sum("first").alias("n1"), F.sum("second").alias("n2"), F.max("v").alias("v"))
    log_of = lambda c: F.when(F.col(c) > 0, F.log(F.col(c).cast("double")))
    drawn = draw(terms.select("bucket", "rn", "h", "v", log_of("n1").alias("w1"), log_of("n2").alias("w2")), samples)
    after = F.lead("f").over(W.partitionBy("bucket").orderBy("rn"))
    drawn = drawn.withColumn("next", F.coalesce(after, F.col("f"))).filter("a0 = 0")
    hex_ = F.concat(*[F.lower(F.lpad(F.hex(f"a{3 + i}"), 13 if i < 4 else 12, "0")) for i in range(5)])
    return drawn.select(
        F.col("a1").alias("doc_id"), F.col("a2").alias("n_chars"), hex_.alias("edited_sha256"), F.col("f").alias("fingerprint"), F.col("g").alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("g"), samples).alias("near_edited"), likeness(F.col("f"), F.col("next"), samples).alias("near_next"),
    )
