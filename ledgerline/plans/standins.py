"""The driver tables as an event log: applications, messages, classifications and corrections, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.schemas import lookup

NOW = "2024-01-31 00:00:00"
GHOST_DAYS = 14

_TYPES = {"signup": "application_received", "view": "assessment", "click": "interview", "purchase": "offer", "error": "rejection"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now():
    return F.lit(NOW).cast("timestamp")


def log(spark: SparkSession, sf_dir: str, by: str = "day") -> dict[str, DataFrame]:
    """events, messages, classifications, overrides and applications derived from the events table."""
    n, kind = F.col("event_id"), F.col("event_type")
    raw = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    typed = F.when(n % 10 == 0, "unknown").when(n % 10 == 1, "recruiter_outreach").when((kind == "error") & (n % 10 == 2), "withdrawn").otherwise(lookup(_TYPES, kind))
    app, msg = F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("at", "yyyy-MM-dd") if by == "day" else (n % 7).cast("string")), F.concat(F.lit("m"), n.cast("string"))
    events = raw.select(n.alias("event_id"), app.alias("application_id"), msg.alias("message_id"), typed.alias("event_type"), F.col("at").alias("occurred_at"))
    messages = raw.select(msg.alias("message_id"), F.concat(F.lit("t"), (n % 97).cast("string")).alias("thread_id"), F.col("at").alias("received_at"), F.concat(F.lit("s"), (n % 7).cast("string")).alias("subject"), F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@example.org")).alias("from_email"))
    score = (n * 37 % 101) / F.lit(100.0)
    classifications = raw.filter(n % 13 != 0).select(msg.alias("message_id"), score.alias("confidence"), (score < 0.6).alias("needs_review"))
    corrected = n % 34 != 0
    overrides = raw.filter(n % 17 == 0).select(
        msg.alias("message_id"),
        F.when(corrected, F.when(n % 3 == 0, "rejection").when(n % 3 == 1, "offer").otherwise("unknown")).alias("event_type"),
        F.when(corrected, F.when(n % 5 == 0, "").otherwise(F.concat(F.lit("Corrected "), (n % 5).cast("string")))).alias("company"),
        F.when(corrected & (n % 4 == 0), F.concat(F.lit("Role "), (n % 6).cast("string"))).alias("role"),
        (F.col("at") + F.expr("INTERVAL 1 DAY")).alias("corrected_at"),
        F.lit(None).cast("string").alias("note"),
    )
    applications = raw.select(app.alias("application_id"), F.concat(F.lit("Company "), (F.col("user_id") % 40).cast("string")).alias("company"), F.concat(F.lit("company "), (F.col("user_id") % 40).cast("string")).alias("company_key")).distinct()
    none = F.lit(None).cast("string")
    applications = applications.select("*", none.alias("role"), none.alias("location"), none.alias("ats"))
    return {"events": events, "messages": messages, "classifications": classifications, "overrides": overrides, "applications": applications}


#: The same tables for DuckDB, as the first parts of a WITH clause.
SQL = f"""WITH ev AS (
  SELECT event_id, concat(user_id, '-', strftime(ts, '%Y-%m-%d')) AS application_id, concat('m', event_id) AS message_id, user_id, ts AS occurred_at,
    CASE WHEN event_id % 10 = 0 THEN 'unknown' WHEN event_id % 10 = 1 THEN 'recruiter_outreach' WHEN event_type = 'error' AND event_id % 10 = 2 THEN 'withdrawn'
      WHEN event_type = 'signup' THEN 'application_received' WHEN event_type = 'view' THEN 'assessment' WHEN event_type = 'click' THEN 'interview'
      WHEN event_type = 'purchase' THEN 'offer' WHEN event_type = 'error' THEN 'rejection' END AS event_type
  FROM events),
msg AS (SELECT message_id, concat('t', event_id % 97) AS thread_id, occurred_at AS received_at, concat('s', event_id % 7) AS subject FROM ev),
cls AS (SELECT message_id, (event_id * 37 % 101) / 100.0::DOUBLE AS confidence, (event_id * 37 % 101) / 100.0::DOUBLE < 0.6 AS needs_review FROM ev WHERE event_id % 13 <> 0),
ovr AS (SELECT message_id,
    CASE WHEN event_id % 34 <> 0 THEN CASE event_id % 3 WHEN 0 THEN 'rejection' WHEN 1 THEN 'offer' ELSE 'unknown' END END AS event_type,
    CASE WHEN event_id % 34 <> 0 THEN CASE WHEN event_id % 5 = 0 THEN '' ELSE concat('Corrected ', event_id % 5) END END AS company, CASE WHEN event_id % 34 <> 0 AND event_id % 4 = 0 THEN concat('Role ', event_id % 6) END AS role,
    occurred_at + INTERVAL 1 DAY AS corrected_at
  FROM ev WHERE event_id % 17 = 0),
app AS (SELECT DISTINCT application_id, concat('Company ', user_id % 40) AS company, concat('company ', user_id % 40) AS company_key FROM ev),
eff AS (SELECT e.event_id, e.application_id, e.message_id, coalesce(o.event_type, e.event_type) AS event_type, e.occurred_at,
    coalesce(c.confidence, 0.0) AS confidence, coalesce(c.needs_review, true) AND o.message_id IS NULL AS needs_review,
    o.event_type IS NOT NULL OR o.company IS NOT NULL AS is_overridden, m.subject, m.thread_id, o.company AS o_company, o.role AS o_role, o.corrected_at,
    epoch_us(e.occurred_at)::HUGEINT * 10000000000 + e.event_id AS place,
    CASE coalesce(o.event_type, e.event_type) WHEN 'withdrawn' THEN 0 WHEN 'rejection' THEN 1 WHEN 'offer' THEN 2 WHEN 'interview' THEN 3 WHEN 'assessment' THEN 4 WHEN 'application_received' THEN 5 WHEN 'recruiter_outreach' THEN 6 ELSE 7 END AS rank
  FROM ev e JOIN msg m USING (message_id) LEFT JOIN cls c USING (message_id) LEFT JOIN ovr o USING (message_id)),
fold AS (SELECT application_id, min(occurred_at) AS applied_at, max(occurred_at) AS last_event_at, arg_max(event_type, place) AS last_event_type, count(*) AS event_count,
    min(occurred_at) FILTER (event_type <> 'application_received') AS responded_at,
    arg_max(event_type, place) FILTER (event_type IN ('rejection', 'offer', 'withdrawn')) AS last_terminal, min(rank) AS best_rank,
    bool_or(needs_review AND NOT is_overridden) AS needs_review, string_agg(DISTINCT thread_id, ',' ORDER BY thread_id) AS threads,
    arg_max(o_company, epoch_us(corrected_at)::HUGEINT * 10000000000 + event_id) FILTER (o_company <> '') AS company_correction,
    arg_max(o_role, epoch_us(corrected_at)::HUGEINT * 10000000000 + event_id) FILTER (o_role <> '') AS role_correction
  FROM eff GROUP BY application_id),
model AS (SELECT f.application_id, coalesce(f.company_correction, a.company) AS company, f.role_correction AS role, a.company_key, f.applied_at, f.last_event_at, f.last_event_type, f.event_count, f.needs_review, f.threads, f.last_terminal, f.best_rank,
    CASE WHEN f.last_terminal = 'rejection' THEN 'rejected' WHEN f.last_terminal IS NOT NULL THEN f.last_terminal
      WHEN epoch_us(TIMESTAMP '{NOW}') - epoch_us(f.last_event_at) > {GHOST_DAYS} * 86400000000 THEN 'ghosted'
      WHEN f.best_rank = 3 THEN 'interviewing' WHEN f.best_rank = 4 THEN 'assessment' ELSE 'applied' END AS status,
    CAST(floor((epoch_us(f.responded_at) - epoch_us(f.applied_at)) / 86400000000) AS BIGINT) AS days_to_first_response,
    CAST(floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(f.last_event_at)) / 86400000000) AS BIGINT) AS days_since_last_event
  FROM fold f JOIN app a USING (application_id))
"""
SQL_BY_SEVENTH = SQL.replace("strftime(ts, '%Y-%m-%d')", "event_id % 7")
