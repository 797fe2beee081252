"""Stores: case documents as JSON, audit events as JSON lines by month, configuration and word lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

AUDIT = "ts string, action string, user_id string, username string, target string, detail string, ip string"
CASE = (
    "id string, created_at string, last_modified string, status string, due_date string, workflow_status string, request_date string, "
    "completed_at string, allocated_to string, archived boolean, clock_paused boolean, paused_at string, total_paused_days int, "
    "pdf_files array<string>, document_dates map<string,string>, pause_log array<struct<paused_at:string,resumed_at:string,reason:string,days:int>>"
)

# Settings of a practice and their defaults; all are text.
CONFIG = {
    "practice_name": "My Surgery",
    "practice_address": "",
    "sar_officer_name": "",
    "sar_officer_role": "Data Protection Lead",
    "sar_officer_email": "",
    "sar_officer_gmc": "",
    "footer_text": "",
    "backup_dir": "",
    "idle_timeout_minutes": "30",
    "require_second_signoff": "0",
    "retention_days": "180",
}


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Audit events; lines that aren't JSON are dropped."""
    return spark.read.schema(AUDIT).option("mode", "DROPMALFORMED").json(path).filter(F.col("action").isNotNull())


def append_audit(events: DataFrame, path: str) -> None:
    events.withColumn("yyyymm", F.date_format(F.col("ts").cast("timestamp"), "yyyyMM")).write.partitionBy("yyyymm").mode("append").json(path)


def read_cases(docs: DataFrame) -> DataFrame:
    """(id, doc) rows to cases: absent fields take their defaults, file paths lose their folders, a due date is computed."""
    c = docs.select(F.from_json("doc", CASE).alias("c")).select("c.*")
    base = F.transform(F.coalesce("pdf_files", F.array().cast("array<string>")), lambda p: F.element_at(F.split(F.replace(p, F.lit("\\"), F.lit("/")), "/"), -1))
    start = F.coalesce(F.nullif("request_date", F.lit("")), F.col("created_at"))
    due = F.coalesce(F.nullif("due_date", F.lit("")), F.date_add(F.substring(start, 1, 10).try_cast("date"), 30).cast("string"))
    return c.withColumns({"pdf_files": base, "due_date": due, "archived": F.coalesce("archived", F.lit(False)), "total_paused_days": F.coalesce("total_paused_days", F.lit(0))})


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """All rows, those of new in place of old ones with their key."""
    return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(new)


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    n = F.row_number().over(W.partitionBy(key).orderBy(F.col(order).desc()))
    return rows.withColumn("__n", n).filter("__n = 1").drop("__n")


def config(saved: dict[str, object]) -> dict[str, str]:
    """The defaults with saved values of known settings, as stripped text."""
    return CONFIG | {k: str(v).strip() for k, v in saved.items() if k in CONFIG}


def _list_file(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def read_staff(spark: SparkSession, path: str) -> DataFrame:
    """(name, role) of a staff list; entries without a name are left out."""
    return _list_file(spark, path, "name string, role string").filter(F.trim("name") != "").withColumn("role", F.coalesce("role", F.lit("")))


def read_custom_words(spark: SparkSession, path: str) -> DataFrame:
    """(phrase, case_sensitive) of the phrases that are always redacted."""
    return _list_file(spark, path, "phrase string, case_sensitive boolean").filter("phrase <> ''").withColumn("case_sensitive", F.coalesce("case_sensitive", F.lit(False)))


def read_risk_words(spark: SparkSession, path: str) -> DataFrame:
    """(category, phrase) of an object that lists phrases by category."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, array<string>>").alias("m"))
    rows = whole.select(F.explode("m").alias("category", "phrases")).select("category", F.explode("phrases").alias("phrase"))
    return rows.filter("phrase <> ''")


def read_surnames(spark: SparkSession, path: str) -> DataFrame:
    """(name) of a list of further surnames, in lower case, each once."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("name"))
    return whole.select(F.lower(F.trim("name")).alias("name")).filter("name <> ''").distinct()


def importable(ids: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """ids(id) with outcome: imported, invalid or conflict."""
    here = existing.select(F.col("id").alias("__have")).distinct()
    rows = ids.join(here, F.col("id") == F.col("__have"), "left")
    good = F.col("id").rlike("^[A-Za-z0-9][A-Za-z0-9_-]{0,63}$")
    outcome = F.when(~F.coalesce(good, F.lit(False)), "invalid").when(F.col("__have").isNotNull() & F.lit(not force), "conflict").otherwise("imported")
    return rows.withColumn("outcome", outcome).drop("__have")


def expired(cases: DataFrame, days: int, now: str) -> DataFrame:
    """Complete cases whose completion, else last change, is at least so many days ago; unreadable dates never expire."""
    if days <= 0:
        return cases.limit(0)
    read = lambda c: F.try_to_timestamp(F.nullif(c, F.lit("")))
    when = F.when(F.coalesce(F.col("completed_at"), F.lit("")) != "", read("completed_at")).otherwise(read("last_modified"))
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(when)) / 86_400_000_000
    return cases.filter((F.col("status") == "complete") & (age >= days))
