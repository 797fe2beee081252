"""Queries of audit events and of what streams keep: presence, visits, throttled logins, due jobs, the case store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.plans import views as V
from vellum.plans.casework import CASE, QUERIES, D, bound, query
from vellum.plans.dialect import Spark as SparkSql
from vellum.sources import folders
from vellum.sources.shared import new_folder
from vellum.streaming import audit, upserts, visits

AUDIT = V.audit(D)


def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("events")
    return spark.sql(f"WITH {V.audit(SparkSql())} SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, action, username, target, ip FROM v_audit")


@query("str03_presence", f"""WITH {AUDIT} SELECT e.event_id, coalesce(string_agg(DISTINCT o.username, ',' ORDER BY o.username), '') AS others
FROM v_audit e LEFT JOIN v_audit o ON o.target = e.target AND o.username <> e.username AND epoch_us(e.ts) - epoch_us(o.ts) BETWEEN 0 AND 90000000
WHERE e.target IS NOT NULL GROUP BY e.event_id""")
def str03_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.presence(audited(spark, sf_dir)).select("event_id", F.concat_ws(",", "others").alias("others"))


@query("str03_visits", f"""WITH {AUDIT}, e AS (SELECT target, username, epoch_us(ts) AS us FROM v_audit WHERE target IS NOT NULL AND target <> ''),
g AS (SELECT *, CASE WHEN us - lag(us) OVER w <= 3600000000 THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY target, username ORDER BY us)),
v AS (SELECT *, sum(fresh) OVER (PARTITION BY target, username ORDER BY us, fresh DESC ROWS UNBOUNDED PRECEDING) AS visit FROM g)
SELECT target, username, 'began' AS change, min(us) AS us FROM v GROUP BY target, username, visit UNION ALL SELECT target, username, 'ended', max(us) + 3600000000 FROM v GROUP BY target, username, visit""")
def str03_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each viewer began and ended to look at each target, an hour without a sign being an end."""
    told = visits.changes(audited(spark, sf_dir).filter("target <> ''"), ["target", "username"], 3600)
    return told.select("target", "username", "change", F.unix_micros("at").alias("us"))


@query("str04_audit_tail", f"WITH {AUDIT} SELECT event_id, ts, username FROM v_audit WHERE action = 'error' AND contains(lower(username), 'ser5') AND contains(target, '7')")
def str04_audit_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.tail(audited(spark, sf_dir), "error", "SER5", "7").select("event_id", "ts", "username")


@query("str06_due_check", f"""WITH {AUDIT}, l AS (SELECT username AS job, max(epoch_us(ts)) AS last_us FROM v_audit WHERE action = 'error' GROUP BY 1)
SELECT job, last_us, epoch_us(TIMESTAMP '2024-01-25 12:00:00') - last_us >= 86400000000 AS due FROM l""")
def str06_due_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which jobs, a user's errors standing for the runs of one, are due a day after their last run."""
    due = visits.due(audited(spark, sf_dir).filter("action = 'error'"), "username", F.lit("2024-01-25 12:00:00").cast("timestamp"))
    return due.select(F.col("username").alias("job"), F.unix_micros("last_run").alias("last_us"), "due")


@query("str01_login_throttle", f"""WITH RECURSIVE {AUDIT}, a AS (SELECT event_id, ip, lower(username) AS username, action = 'click' AS ok, epoch_us(ts) / 1e6::DOUBLE / 400 AS t,
  row_number() OVER (PARTITION BY ip, lower(username) ORDER BY ts, event_id) AS n FROM v_audit WHERE action IN ('error', 'click')),
s AS (SELECT ip, username, CAST(0 AS BIGINT) AS n, []::DOUBLE[] AS failures, CAST(0 AS BIGINT) AS wait, CAST(NULL AS BIGINT) AS event_id FROM (SELECT DISTINCT ip, username FROM a) x
UNION ALL SELECT ip, username, n, CASE WHEN len(recent) >= 5 THEN recent WHEN ok THEN [] ELSE list_append(recent, t) END,
  CASE WHEN len(recent) >= 5 THEN CAST(floor(300 - (t - list_min(recent))) AS BIGINT) + 1 ELSE 0 END, event_id
  FROM (SELECT a.*, list_filter(s.failures, lambda x: a.t - x < 300) AS recent FROM s JOIN a ON a.ip = s.ip AND a.username = s.username AND a.n = s.n + 1) y)
SELECT event_id, ip, username, wait FROM s WHERE n > 0""")
def str01_login_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts with the seconds that each has to wait; the clock runs 400 times slower, so that failures come close together."""
    events = audited(spark, sf_dir).filter("action IN ('error', 'click')")
    slow = F.timestamp_seconds(F.unix_micros("ts") / F.lit(1e6) / 400)
    exact = events.withColumn("ts", slow).withColumn("ok", F.col("action") == "click")
    return audit.throttled(exact)


@query("snk06_upsert_latest", f"""WITH {CASE}, r AS (SELECT subject, id, status, ROW_NUMBER() OVER (PARTITION BY subject ORDER BY received DESC, id DESC) AS n FROM v_case) SELECT subject, id, status FROM r WHERE n = 1""")
def snk06_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest case of each subject, merged into a store in two batches, of which the first is replayed."""
    cases = bound(spark, sf_dir, V.case, select="subject, id, status, date_format(received, 'yyyy-MM-dd') || lpad(CAST(id AS STRING), 19, '0') AS stamp, id % 2 AS half FROM v_case")
    store = upserts.Store(new_folder(spark, "store"), "subject long, id long, status string, stamp string", key="subject", order="stamp", parts=16)
    halves = [cases.filter(F.col("half") == i).drop("half") for i in (0, 1)]
    for batch_id in (0, 1, 0):
        store.merge(halves[batch_id], batch_id)
    return store.read(spark).drop("stamp")


def agg18_folder_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and bytes of the tables' own folder, rolled up; the check engine's views can't tell them."""
    return folders.folder_sizes(folders.file_sizes(spark, sf_dir))


QUERIES["agg18_folder_sizes"] = agg18_folder_sizes
