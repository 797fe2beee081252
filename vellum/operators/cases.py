"""Case analytics over cases and findings: clock, summaries, dashboard, turnaround, certificate counts.

cases(id, received, completed, due, status, archived, clock_paused, paused_at, paused_days, ...): dates as DATE, completed
null while open. findings(case_id, seq, text, category, status, source_file, exemption, ...). Every function is one
aggregation with partial results before its shuffle; only `urgency` sorts, and takes the first few."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions import lexicons as L

REDACTED = ("auto_redact", "approved")
REVIEWED = tuple(s for s in L.STATUSES if s != "flagged")
NO_DATE_DAYS, URGENT_DAYS, SOON_DAYS, URGENT_ROWS = 99, 7, 3, 5


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def with_clock(cases: DataFrame, today: Column) -> DataFrame:
    """cases with live_paused_days (0 unless paused), effective_due and days_remaining (99 without a due date)."""
    live = F.when(F.col("clock_paused"), F.greatest(F.lit(0), F.coalesce(F.datediff(today, "paused_at"), F.lit(0)))).otherwise(F.lit(0))
    rows = cases.withColumn("live_paused_days", live)
    rows = rows.withColumn("effective_due", F.date_add("due", F.coalesce("paused_days", F.lit(0)) + F.col("live_paused_days")))
    return rows.withColumn("days_remaining", F.coalesce(F.datediff("effective_due", today), F.lit(NO_DATE_DAYS)).cast("long"))


def case_summary(cases: DataFrame, findings: DataFrame, today: Column) -> DataFrame:
    """Per case the findings by state, the files that have any, and the days left."""
    by = lambda s: _count(F.col("status") == s).alias({"auto_redact": "auto"}.get(s, s))
    # a row a case and file first, so that files are counted without holding their names
    each = findings.groupBy("case_id", "source_file").agg(
        F.count("*").alias("total"), by("auto_redact"), by("flagged"), by("approved"), _count(F.col("status").isin(*REVIEWED)).alias("reviewed")
    )
    sums = [F.sum(c).alias(c) for c in each.columns if c not in ("case_id", "source_file")]
    counts = each.groupBy("case_id").agg(*sums, F.count("source_file").alias("files"))
    names = [c for c in counts.columns if c != "case_id"]
    rows = with_clock(cases, today).select("id", "days_remaining").join(counts, F.col("id") == F.col("case_id"), "left")
    return rows.select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in names], "days_remaining")


def dashboard(cases: DataFrame, today: Column) -> DataFrame:
    live, status = ~F.col("archived"), F.col("status")
    return with_clock(cases, today).agg(
        _count(live).alias("active"), _count(live & (status == "reviewing")).alias("reviewing"), _count(live & (status == "complete")).alias("complete"),
        _count(live & (status != "complete") & (F.col("days_remaining") < 0)).alias("overdue"), _count(F.col("archived")).alias("archived"),
    )


def urgency(cases: DataFrame, today: Column) -> DataFrame:
    """The five most urgent of the active, running cases due within a week, with how many are late, due in three days, and later."""
    rows = with_clock(cases, today).filter(~F.col("archived") & (F.col("status") != "complete") & ~F.col("clock_paused") & (F.col("days_remaining") <= URGENT_DAYS))
    rows = rows.select("id", F.col("days_remaining").alias("days"))
    days = F.col("days")
    strip = rows.agg(_count(days < 0).alias("late"), _count(days.between(0, SOON_DAYS)).alias("soon"), _count(days > SOON_DAYS).alias("week"))
    # the counts are one row
    return rows.orderBy("days", "id").limit(URGENT_ROWS).join(F.broadcast(strip))


def completion_split(findings: DataFrame) -> DataFrame:
    among = lambda *s: _count(F.col("status").isin(*s))
    return findings.groupBy("case_id").agg(among(*REDACTED).alias("redacted"), among("rejected", "flagged").alias("kept"), among("excluded_subject", "excluded_staff").alias("excluded"))


def turnaround(cases: DataFrame, findings: DataFrame, today: Column) -> DataFrame:
    """A row for each complete case: days taken, whether on time, redactions."""
    done = with_clock(cases, today).filter("status = 'complete'")
    counts = findings.filter(F.col("status").isin(*REDACTED)).groupBy("case_id").agg(F.count("*").alias("n"))
    on_time = F.col("completed") <= F.col("effective_due")
    return done.join(counts, F.col("id") == F.col("case_id"), "left").select(
        "id", "received", "completed", F.datediff("completed", "received").cast("long").alias("days"), on_time.alias("on_time"), F.coalesce("n", F.lit(0)).alias("redactions")
    )


def turnaround_totals(cases: DataFrame, today: Column) -> DataFrame:
    done, days = F.col("status") == "complete", F.datediff("completed", "received")
    in_time = F.col("completed") <= F.col("effective_due")
    pct = F.bround(100.0 * _count(in_time) / F.nullif(F.count("completed"), F.lit(0)), 0)
    return with_clock(cases, today).agg(
        F.count("*").alias("total"), _count(done).alias("completed"), _count(~done).alias("open"), _count(~done & (F.col("days_remaining") < 0)).alias("overdue_open"),
        _count(done & in_time).alias("on_time"), pct.cast("double").alias("on_time_pct"), F.bround(F.avg(days.cast("double")), 1).alias("avg_days"),
        F.max(days).cast("long").alias("max_days"), F.sum("paused_days").cast("long").alias("paused_used"),
    )


def monthly(cases: DataFrame) -> DataFrame:
    """Cases received and completed by month: one pass, each case counted under up to two months."""
    month = lambda c: F.date_format(c, "yyyy-MM")
    received = F.struct(month("received").alias("month"), F.lit(1).alias("r"), F.lit(0).alias("c"))
    completed = F.when(F.col("status") == "complete", F.struct(month("completed").alias("month"), F.lit(0).alias("r"), F.lit(1).alias("c")))
    rows = cases.select(F.inline(F.filter(F.array(received, completed), lambda x: x.isNotNull())))
    return rows.filter("month is not null").groupBy("month").agg(F.sum("r").cast("long").alias("received"), F.sum("c").cast("long").alias("completed"))


def certificate_categories(findings: DataFrame) -> DataFrame:
    """Redactions by category of each case, the most first, ties in order of appearance."""
    counts = findings.filter(F.col("status").isin(*REDACTED)).groupBy("case_id", "category").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))
    place = F.row_number().over(W.partitionBy("case_id").orderBy(F.desc("n"), "first_seq"))
    return counts.select("case_id", "category", "n", place.alias("place"))


def certificate_exemptions(findings: DataFrame) -> DataFrame:
    """Redactions by exemption label of each case; none means third party, an unknown code is its own label."""
    labels = F.create_map(*[F.lit(x) for k, v in {"": L.EXEMPTIONS["third_party"], **L.EXEMPTIONS}.items() for x in (k, v)])
    label = F.coalesce(F.try_element_at(labels, F.col("exemption")), F.col("exemption"))
    return findings.filter(F.col("status").isin(*REDACTED)).groupBy("case_id", label.alias("exemption")).agg(F.count("*").alias("n"))


def by_name(findings: DataFrame) -> DataFrame:
    """Findings of equal text, case and outer blanks apart, by category: how many, in how many files, and in which states."""
    each = findings.groupBy("category", F.lower(F.trim("text")).alias("name"), "source_file")
    counts = each.agg(F.count("*").alias("n"), *[_count(F.col("status") == s).alias(f"n_{s}") for s in L.STATUSES])
    sums = [F.sum(c).alias(c) for c in ("n", *[f"n_{s}" for s in L.STATUSES])]
    return counts.groupBy("category", "name").agg(*sums, F.count("source_file").alias("files"))


def occurrences(findings: DataFrame, most: int = 30) -> DataFrame:
    """The first findings of each name in by_name(), by case, file, page and seq, as places from 1; more: how many follow."""
    rows = findings.withColumn("name", F.lower(F.trim("text")))
    order = W.partitionBy("category", "name").orderBy("case_id", "source_file", "page_num", "seq")
    first = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    total = rows.groupBy(F.col("category").alias("__c"), F.col("name").alias("__n")).agg(F.count("*").alias("__all"))
    same = F.col("category").eqNullSafe(F.col("__c")) & F.col("name").eqNullSafe(F.col("__n"))
    out = first.join(total, same).withColumn("more", F.greatest(F.col("__all") - most, F.lit(0)))
    return out.select("category", "name", "place", "case_id", "source_file", "page_num", "seq", "status", "more")


def review_progress(findings: DataFrame) -> DataFrame:
    """Per case the share reviewed in per cent, halves up, and how many wait."""
    pct = F.floor(100.0 * _count(F.col("status").isin(*REVIEWED)) / F.count("*") + 0.5)
    return findings.groupBy("case_id").agg(pct.cast("long").alias("pct"), _count(F.col("status") == "flagged").alias("flagged"))
