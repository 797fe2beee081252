"""Places on a page: which spans a match overlaps, its box, its rectangles by line.

A range join: matches and spans are cut into bins of character offsets, joined by page and bin, and compared there. A pair
that shares several bins is counted in the first one only. Work is linear in the matches, the spans and the pairs that
overlap, and a page with very many of both is spread over its bins.

hits(keys..., s, e, ...), spans(keys..., s, e, x0, y0, x1, y1, block_no, line_no, ...): offsets are code points, ends
exclusive. Defined cases: a match without spans has a box of zeros and no rectangles; an empty span counts where it lies
strictly inside a match; rows that are equal in all columns count once; null offsets overlap nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a bin; most matches lie in one.
BIN = 256
BOX = ("x0", "y0", "x1", "y1")


def _bins(s: Column, e: Column, size: int) -> Column:
    first = F.floor(s / size)
    return F.sequence(first, F.greatest(first, F.floor((e - 1) / size)))


def overlaps(hits: DataFrame, spans: DataFrame, keys: Sequence[str], columns: Sequence[str], size: int = BIN, how: str = "left") -> DataFrame:
    """hits with `columns` of every span they overlap, as struct `span`; left: also once without, for each bin that has none."""
    left = hits.withColumn("__bin", F.explode_outer(_bins(F.col("s"), F.col("e"), size)))
    inside = F.struct("s", "e", *[c for c in columns if c not in ("s", "e")])
    right = spans.select(*[F.col(k).alias(f"__{k}") for k in keys], inside.alias("span"), F.explode(_bins(F.col("s"), F.col("e"), size)).alias("__b"))
    on = (F.col("__bin") == F.col("__b")) & (F.col("span")["s"] < F.col("e")) & (F.col("span")["e"] > F.col("s"))
    on = on & (F.col("__bin") == F.floor(F.greatest(F.col("s"), F.col("span")["s"]) / size))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(right, on, how).drop("__bin", "__b", *[f"__{k}" for k in keys])


def boxes(hits: DataFrame, spans: DataFrame, keys: Sequence[str], size: int = BIN) -> DataFrame:
    """hits with x0, y0, x1, y1 of all spans they overlap together."""
    met = overlaps(hits, spans, keys, BOX, size)
    made = [F.coalesce(f(F.col("span")[c]), F.lit(0.0)).alias(c) for c, f in zip(BOX, (F.min, F.min, F.max, F.max), strict=True)]
    return met.groupBy(*hits.columns).agg(*made)


def rectangles(hits: DataFrame, spans: DataFrame, keys: Sequence[str], size: int = BIN) -> DataFrame:
    """hits with block_no, line_no and the box of the part that lies on that line, a row a line.

    Within a span a character takes an equal share of its width."""
    met = overlaps(hits, spans, keys, [*BOX, "block_no", "line_no"], size, "inner")
    sp = F.col("span")
    width = (sp["x1"] - sp["x0"]) / F.greatest(sp["e"] - sp["s"], F.lit(1))
    begin = sp["x0"] + width * (F.greatest(F.col("s"), sp["s"]) - sp["s"])
    end = sp["x0"] + width * (F.least(F.col("e"), sp["e"]) - sp["s"])
    made = [F.min(begin).alias("x0"), F.min(sp["y0"]).alias("y0"), F.max(end).alias("x1"), F.max(sp["y1"]).alias("y1")]
    return met.groupBy(*hits.columns, sp["block_no"].alias("block_no"), sp["line_no"].alias("line_no")).agg(*made)
