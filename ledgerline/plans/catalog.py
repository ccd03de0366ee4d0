"""Registered queries over the driver tables, and their SQL for an independent engine."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import sender, text
from ledgerline.operators import evaluate as evaluation
from ledgerline.operators import events as ev
from ledgerline.operators import overrides as ov
from ledgerline.operators import reports, rules
from ledgerline.operators.candidates import CandidateIndex
from ledgerline.operators.components import new_path, written
from ledgerline.operators.concepts import encoded
from ledgerline.operators.linking import link
from ledgerline.operators.rules import Rule, classify, confidence, fired, ranks_of, winner
from ledgerline.plans import mails
from ledgerline.plans.standins import GHOST_DAYS, NOW, SQL, SQL_BY_SEVENTH, log, now, table
from ledgerline.schemas import EVENT_TYPES
from ledgerline.sources import mailbox
from ledgerline.sources.keyed import KeyedTable
from ledgerline.streaming.incremental import stored, sync, sync_mailbox
from ledgerline.streaming.linked import LinkStream, linkable
from ledgerline.streaming.readmodel import TOLD, ReadModel, follow
from ledgerline.streaming.silence import SilenceStream

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, by: str = "day"):
    """Register a function of (spark, sf_dir); sql follows the tables of standins.SQL where it begins with SELECT, with
    applications by user and day, or by user and a seventh of the events (by="seventh")."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = (SQL if by == "day" else SQL_BY_SEVENTH) + sql if sql.lstrip().startswith(("SELECT", ",")) else sql.lstrip().removeprefix("plain ")
        return f

    return register


def micros(name: str, to: str | None = None):
    return F.unix_micros(name).alias(to or name)


def _model(spark, sf_dir) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    t = log(spark, sf_dir)
    eff = ev.effective_events(t["events"], t["messages"], t["classifications"], t["overrides"])
    return t, eff, ev.read_model(t["applications"], eff, now(), GHOST_DAYS)


def _folded(spark, sf_dir, by: str = "day") -> DataFrame:
    t = log(spark, sf_dir, by)
    return ev.folded(ev.effective_events(t["events"], t["messages"], t["classifications"], t["overrides"]), now(), GHOST_DAYS)


_EXPORT = "application_id, company, role, NULL::VARCHAR AS location, NULL::VARCHAR AS ats, status, epoch_us(applied_at) AS applied_at, epoch_us(last_event_at) AS last_event_at, last_event_type, event_count, days_to_first_response, days_since_last_event, needs_review"


@query("app_status", "SELECT application_id, status FROM model")
def app_status(spark, sf_dir):
    return _folded(spark, sf_dir).select("application_id", "status")


@query("app_read_model", f"SELECT {_EXPORT}, company_key, threads FROM model")
def app_read_model(spark, sf_dir):
    model = _model(spark, sf_dir)[2]
    return model.select(*[micros(c) if c.endswith("_at") else c for c in ev.EXPORT_COLUMNS], "company_key", F.concat_ws(",", "source_thread_ids").alias("threads"))


@query("read_model_incremental", f"SELECT {_EXPORT}, company_key, threads FROM model")
def read_model_incremental(spark, sf_dir):
    """The same read model from four batches of events, the second of which comes twice, and two of corrections."""
    t, folder = log(spark, sf_dir), new_path(spark, "read-model")
    flagged = t["classifications"].withColumnRenamed("needs_review", "flagged")
    told = t["events"].join(t["messages"].select("message_id", "thread_id", "subject", "from_email"), "message_id").join(flagged, "message_id", "left")
    told = written(told.select(*[x.split()[0] for x in TOLD.split(", ")]), "told")
    model, turn = ReadModel(spark, folder, buckets=8), F.pmod(F.xxhash64("event_id"), F.lit(4))
    early = F.pmod(F.xxhash64("message_id"), F.lit(3)) == 0
    model.correct(t["overrides"].filter(early), 0)  # some before their events
    for n in (0, 1, 2, 3, 1):  # a batch is all that has come since the last
        told.filter(turn == n).write.mode("append").parquet(f"{folder}/inbox")
        follow(model, f"{folder}/inbox")
    model.correct(t["overrides"].filter(~early), 1)
    rows = model.applications(t["applications"], now(), GHOST_DAYS)
    return rows.select(*[micros(c) if c.endswith("_at") else c for c in ev.EXPORT_COLUMNS], "company_key", F.concat_ws(",", "source_thread_ids").alias("threads"))


@query(
    "keyed_store",
    """SELECT application_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY application_id ORDER BY event_id % 3 DESC, occurred_at DESC, event_id DESC) AS turn FROM ev)
    WHERE turn = 1 AND application_id NOT IN (SELECT application_id FROM ev WHERE event_type = 'withdrawn' AND application_id IS NOT NULL)""",
)
def keyed_store(spark, sf_dir):
    """Upserts by application in three changes, the second of them made twice, then a delete; older versions are vacuumed."""
    e = log(spark, sf_dir)["events"]
    store = KeyedTable(spark, new_path(spark, "keyed"), "application_id string, event_id long, event_type string, occurred_at timestamp", ["application_id"], buckets=8)
    for n in (0, 1, 1, 2):
        store.upsert(e.filter(F.col("event_id") % 3 == n), F.col("occurred_at"), F.col("event_id"), name="events", number=n)
    store.delete(e.filter("event_type = 'withdrawn'").select("application_id"))
    store.vacuum()
    return store.read().select("application_id", "event_id", "event_type")


@query("effective_events", "SELECT event_id, application_id, event_type, epoch_us(occurred_at) AS occurred_at, confidence, needs_review, is_overridden, subject FROM eff")
def effective_events(spark, sf_dir):
    eff = _model(spark, sf_dir)[1]
    return eff.select("event_id", "application_id", "event_type", micros("occurred_at"), "confidence", "needs_review", "is_overridden", "subject")


@query("days_to_first_response", "SELECT application_id, days_to_first_response FROM model", by="seventh")
def days_to_first_response(spark, sf_dir):
    return _folded(spark, sf_dir, "seventh").select("application_id", "days_to_first_response")


@query("days_since_last_event", "SELECT application_id, days_since_last_event FROM model")
def days_since_last_event(spark, sf_dir):
    return _folded(spark, sf_dir).select("application_id", "days_since_last_event")


@query("ghosted_apps", "SELECT application_id, epoch_us(last_event_at) AS last_event_at FROM model WHERE status = 'ghosted'")
def ghosted_apps(spark, sf_dir):
    return _folded(spark, sf_dir).filter("status = 'ghosted'").select("application_id", micros("last_event_at"))


@query("silence_timers", "SELECT application_id, epoch_us(last_event_at) AS last_event_at FROM model WHERE status = 'ghosted'")
def silence_timers(spark, sf_dir):
    """The ghosted applications as timers tell them, from three batches of effective events and a tick of the clock."""
    t, folder = log(spark, sf_dir), new_path(spark, "silence")
    eff = written(ev.effective_events(t["events"], t["messages"], t["classifications"], t["overrides"]).select("application_id", "event_id", "event_type", "occurred_at"), "effective")
    stream = SilenceStream(spark, folder, GHOST_DAYS, buckets=8)
    for n in range(3):  # a batch is all that has come since the last, in as many files as it was written by tasks
        eff.filter(F.least(F.lit(2), F.floor((F.dayofmonth("occurred_at") - 1) / 10)) == n).write.mode("append").parquet(f"{folder}/inbox")
        stream.follow(f"{folder}/inbox")
    eff.limit(1).select(F.lit(None).cast("string").alias("application_id"), F.lit(-1).cast("long").alias("event_id"), F.lit("unknown").alias("event_type"), (now() + F.expr("INTERVAL 1 MILLISECOND")).alias("occurred_at")).write.mode("append").parquet(f"{folder}/inbox")
    stream.follow(f"{folder}/inbox")
    return stream.ghosted().select("application_id", micros("last_event_at"))


@query("latest_terminal", "SELECT application_id, last_terminal FROM model WHERE last_terminal IS NOT NULL")
def latest_terminal(spark, sf_dir):
    return _folded(spark, sf_dir).filter("last_terminal IS NOT NULL").select("application_id", "last_terminal")


@query("furthest_stage", "SELECT application_id, best_rank FROM model")
def furthest_stage(spark, sf_dir):
    return _folded(spark, sf_dir).select("application_id", "best_rank")


@query("latest_correction", "SELECT application_id, company_correction, role_correction FROM fold WHERE company_correction IS NOT NULL OR role_correction IS NOT NULL")
def latest_correction(spark, sf_dir):
    return _folded(spark, sf_dir).filter("company_correction IS NOT NULL OR role_correction IS NOT NULL").select("application_id", "company_correction", "role_correction")


@query("needs_review_any", "SELECT application_id, needs_review FROM model")
def needs_review_any(spark, sf_dir):
    return _folded(spark, sf_dir).select("application_id", "needs_review")


@query("thread_sets", "SELECT application_id, threads FROM model")
def thread_sets(spark, sf_dir):
    return _folded(spark, sf_dir).select("application_id", F.concat_ws(",", "source_thread_ids").alias("threads"))


@query("list_by_status", "SELECT application_id, company, event_count FROM model WHERE status = 'interviewing' AND needs_review")
def list_by_status(spark, sf_dir):
    return ev.list_applications(_model(spark, sf_dir)[2], status="interviewing", needs_review=True).select("application_id", "company", "event_count")


@query("company_needle", "SELECT application_id, company FROM model WHERE contains(regexp_replace(lower(company_key), '[^a-z0-9]+', '', 'g'), 'company1') OR contains(regexp_replace(lower(company), '[^a-z0-9]+', '', 'g'), 'company1')")
def company_needle(spark, sf_dir):
    return ev.list_applications(_model(spark, sf_dir)[2], company="Company 1").select("application_id", "company")


@query("review_queue", "SELECT m.message_id, m.thread_id, c.confidence, e.application_id AS suggested_application_id FROM msg m JOIN cls c USING (message_id) LEFT JOIN ovr o USING (message_id) LEFT JOIN ev e USING (message_id) WHERE c.needs_review AND o.message_id IS NULL")
def review_queue(spark, sf_dir):
    t = log(spark, sf_dir)
    return ov.review_queue(t["messages"], t["classifications"], t["overrides"], t["events"]).select("message_id", "thread_id", "confidence", "suggested_application_id")


@query("orphan_removal", "SELECT application_id FROM app WHERE application_id IN (SELECT application_id FROM ev WHERE event_id % 3 = 0 AND application_id IS NOT NULL)")
def orphan_removal(spark, sf_dir):
    t = log(spark, sf_dir)
    return ov.without_orphans(t["applications"], t["events"].filter("event_id % 3 = 0")).select("application_id")


@query("clear_unreviewed", "SELECT message_id, confidence FROM cls WHERE message_id IN (SELECT message_id FROM ovr)")
def clear_unreviewed(spark, sf_dir):
    t = log(spark, sf_dir)
    return ov.clear_classifications(t["classifications"], t["overrides"]).select("message_id", "confidence")


@query("dedupe_messages", "SELECT thread_id, min(message_id) FILTER (first = 1) AS message_id FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY received_at, message_id) AS first FROM msg) WHERE thread_id NOT IN (SELECT thread_id FROM msg WHERE received_at < TIMESTAMP '2024-01-01 02:00:00') GROUP BY thread_id")
def dedupe_messages(spark, sf_dir):
    m = log(spark, sf_dir)["messages"]
    held = m.filter("received_at < timestamp'2024-01-01 02:00:00'").select("thread_id").distinct()
    return ov.insert_new(held, m, "thread_id", F.col("received_at"), F.col("message_id")).select("thread_id", "message_id")


@query("upsert_latest", "SELECT application_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY application_id ORDER BY part DESC, occurred_at DESC, event_id DESC) AS turn FROM (SELECT *, event_id % 2 AS part FROM ev) ) WHERE turn = 1")
def upsert_latest(spark, sf_dir):
    e = log(spark, sf_dir)["events"]
    order = (F.col("occurred_at"), F.col("event_id"))
    held = ov.latest_by(e.filter("event_id % 2 = 0"), ["application_id"], *order)
    return ov.upsert(held, e.filter("event_id % 2 = 1"), ["application_id"], *order).select("application_id", "event_id", "event_type")


_CANDIDATES = """SELECT p.probe_id, c.application_id, epoch_us(l.last_event_at) AS last_event_at FROM (SELECT min(event_id) AS probe_id, concat('company ', user_id % 40) AS company_key, concat('t', event_id % 97) AS thread_id FROM ev GROUP BY 2, 3) p
    JOIN (SELECT DISTINCT a.application_id, a.company_key, m.thread_id FROM app a JOIN ev e USING (application_id) JOIN msg m USING (message_id)) c ON c.company_key = p.company_key OR c.thread_id = p.thread_id
    JOIN (SELECT application_id, max(occurred_at) AS last_event_at FROM ev GROUP BY 1) l ON l.application_id = c.application_id GROUP BY ALL"""


@query("candidate_search", _CANDIDATES)
def candidate_search(spark, sf_dir):
    """Every distinct company key and thread asks once, under its first event's id: messages of equal ones have equal candidates."""
    t = log(spark, sf_dir)
    return ov.candidates(t["applications"], t["events"], t["messages"], _probes(spark, sf_dir)).select("probe_id", "application_id", micros("last_event_at"))


def _probes(spark, sf_dir) -> DataFrame:
    keys = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("company "), (F.col("user_id") % 40).cast("string")).alias("company_key"), F.concat(F.lit("t"), (F.col("event_id") % 97).cast("string")).alias("thread_id"))
    return keys.groupBy("company_key", "thread_id").agg(F.min("event_id").alias("probe_id"))


@query("candidate_index", _CANDIDATES)
def candidate_index(spark, sf_dir):
    """The same candidates from an index that three batches of events have built, the second of which came twice."""
    t, index = log(spark, sf_dir), CandidateIndex(spark, new_path(spark, "candidates"), buckets=8)
    for n in (0, 1, 1, 2):
        some = t["events"].filter(F.pmod("event_id", F.lit(3)) == n)
        index.add(t["applications"].join(some.select("application_id"), "application_id", "left_semi"), some, t["messages"], n)
    return index.search(_probes(spark, sf_dir)).select("probe_id", "application_id", micros("last_event_at"))


@query("application_threads", "SELECT DISTINCT application_id, thread_id FROM ev JOIN msg USING (message_id)")
def application_threads(spark, sf_dir):
    t = log(spark, sf_dir)
    return ov.application_threads(t["events"], t["messages"])


_STATUS_DIM = "(VALUES (0,'applied'),(1,'assessment'),(2,'interviewing'),(3,'offer'),(4,'rejected'),(5,'withdrawn'),(6,'ghosted')) d(rank, status)"


@query("status_counts_zero_fill", f"SELECT d.rank, d.status, count(m.application_id) AS n FROM {_STATUS_DIM} LEFT JOIN model m USING (status) GROUP BY 1, 2")
def status_counts_zero_fill(spark, sf_dir):
    return reports.status_counts(_model(spark, sf_dir)[2])


@query(
    "weekly_counts",
    """plain WITH c AS (SELECT date_trunc('week', o_orderdate) + INTERVAL 6 DAY AS period, count(*) AS n FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1),
    s AS (SELECT unnest(generate_series(min(period), max(period), INTERVAL 7 DAY)) AS period FROM c)
    SELECT strftime(s.period, '%Y-%m-%d') AS period, coalesce(c.n, 0) AS n FROM s LEFT JOIN c ON c.period = s.period""",
)
def weekly_counts(spark, sf_dir):
    return reports.calendar_counts(table(spark, sf_dir, "orders"), "o_orderdate", "W").select(F.date_format("period", "yyyy-MM-dd").alias("period"), "n")


@query(
    "top_n_crosstab",
    """SELECT t.place::INTEGER AS place, t.company, t.total, m.status, count(*) AS n FROM (SELECT company, count(*) AS total, row_number() OVER (ORDER BY count(*) DESC, min(application_id)) AS place FROM model GROUP BY company QUALIFY place <= 10) t
    JOIN model m USING (company) GROUP BY ALL""",
)
def top_n_crosstab(spark, sf_dir):
    return reports.top_companies(_model(spark, sf_dir)[2], 10)


@query("latency_histogram", "SELECT CAST(least(days_to_first_response // 7, 7) AS INTEGER) AS bin, CAST(least(days_to_first_response // 7, 7) AS INTEGER) * 7 AS low, count(*) AS n FROM model WHERE days_to_first_response IS NOT NULL GROUP BY ALL", by="seventh")
def latency_histogram(spark, sf_dir):
    return reports.latency_histogram(_folded(spark, sf_dir, "seventh"))


@query("latency_median", "SELECT median(days_to_first_response) AS median_days, count(days_to_first_response) AS n FROM model", by="seventh")
def latency_median(spark, sf_dir):
    return reports.latency_median(_folded(spark, sf_dir, "seventh"))


@query("summary_tiles", "SELECT count(*) AS total, count(days_to_first_response) AS responded, median(days_to_first_response) AS median_days, count(*) FILTER (status = 'interviewing') AS interviewing, count(*) FILTER (status = 'offer') AS offers, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (needs_review) AS needs_review, count(days_to_first_response)::DOUBLE / count(*) AS response_rate FROM model", by="seventh")
def summary_tiles(spark, sf_dir):
    return reports.summary(_folded(spark, sf_dir, "seventh"))


_STEPS = """, st AS (SELECT *, CASE event_type WHEN 'recruiter_outreach' THEN 0 WHEN 'application_received' THEN 1 WHEN 'assessment' THEN 2 WHEN 'interview' THEN 3 WHEN 'offer' THEN 4 WHEN 'rejection' THEN 5 WHEN 'withdrawn' THEN 6 END AS stage FROM eff WHERE event_type <> 'unknown'),
 run AS (SELECT *, coalesce(max(stage) OVER (PARTITION BY application_id ORDER BY occurred_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS before FROM st),
 kept AS (SELECT *, lead(stage) OVER (PARTITION BY application_id ORDER BY occurred_at, event_id) AS nxt FROM run WHERE stage > before AND before < 4),
 steps AS (SELECT k.stage AS s, coalesce(k.nxt, CASE WHEN k.stage < 4 AND m.status = 'ghosted' THEN 7 END) AS t, k.nxt IS NULL AS ghost FROM kept k JOIN model m USING (application_id)),
 names AS (SELECT * FROM (VALUES (0,'Outreach'),(1,'Applied'),(2,'Assessment'),(3,'Interview'),(4,'Offer'),(5,'Rejected'),(6,'Withdrawn'),(7,'Ghosted')) v(i, name))
"""
_STEPS_FROM = "FROM steps JOIN names a ON a.i = s JOIN names b ON b.i = t"


@query("stage_flows")
def stage_flows(spark, sf_dir):
    _, eff, model = _model(spark, sf_dir)
    return reports.stage_flows(eff, model)


@query("stage_ghost_links")
def stage_ghost_links(spark, sf_dir):
    _, eff, model = _model(spark, sf_dir)
    return reports.stage_steps(eff, model).filter("ghost").select("source", "n")


ORACLES["stage_flows"] = SQL + _STEPS + f"SELECT a.name AS source, b.name AS target, count(*) AS n {_STEPS_FROM} GROUP BY 1, 2"
ORACLES["stage_ghost_links"] = SQL + _STEPS + f"SELECT a.name AS source, count(*) AS n {_STEPS_FROM} WHERE ghost GROUP BY 1"


@query("stats_by_status", "SELECT status, count(*) AS n FROM model GROUP BY status")
def stats_by_status(spark, sf_dir):
    return reports.stats_by_status(_folded(spark, sf_dir))


@query(
    "eval_metrics",
    """plain WITH p AS (SELECT CASE WHEN toxic = 1 THEN 'rejection' ELSE 'application_received' END AS label_type, CASE WHEN d.n_chars % 3 = 0 THEN 'rejection' ELSE 'application_received' END AS event_type,
      d.source AS label_key, CASE WHEN d.doc_id % 5 = 0 THEN 'other' ELSE d.source END AS key, CASE WHEN d.doc_id % 3 <> 0 THEN d.lang END AS label_role, CASE WHEN d.doc_id % 7 = 0 THEN NULL WHEN d.doc_id % 11 = 0 THEN 'other' ELSE d.lang END AS role,
      (d.doc_id % 4) / 4.0::DOUBLE AS confidence, d.n_chars::DOUBLE AS latency FROM labels l JOIN documents d USING (doc_id))
    SELECT count(*) AS n, avg((confidence > 0)::INT) AS schema_compliance, avg((label_type = event_type)::INT) AS event_type_accuracy, avg((label_type = event_type)::INT) AS confusable_pair_accuracy, avg((label_key = key)::INT) AS company_accuracy, avg(coalesce(label_role = role, false)::INT) FILTER (label_role IS NOT NULL) AS role_accuracy, median(latency) AS median_latency FROM p""",
)
def eval_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").drop("text"), "doc_id")
    kind = lambda c: F.when(c, "rejection").otherwise("application_received")
    pairs = rows.select(kind(F.col("toxic") == 1).alias("label_type"), kind(F.col("n_chars") % 3 == 0).alias("event_type"), F.col("source").alias("label_company_key"), F.when(F.col("doc_id") % 5 == 0, "other").otherwise(F.col("source")).alias("company_key"), F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("label_role_key"), F.when(F.col("doc_id") % 7 != 0, F.when(F.col("doc_id") % 11 == 0, "other").otherwise(F.col("lang"))).alias("role_key"), ((F.col("doc_id") % 4) / 4.0).alias("confidence"), F.col("n_chars").cast("double").alias("latency"))
    return evaluation.evaluate(pairs)


@query("normalize_text", "plain SELECT doc_id, sha256(trim(regexp_replace(replace(lower(translate(text, '‘’“”–— ​', '''''\"\"-- ')), 'ß', 'ss'), '[\\s\\x0B\\x1C-\\x1F\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g'))) AS digest FROM documents")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.normalize_text(F.col("text")), 256).alias("digest"))


@query("extract_hosts", "plain SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '(?:@|//)([A-Za-z0-9.-]+)', 1), lambda x: regexp_replace(lower(x), '[.]+$', '')), ',') AS hosts FROM documents")
def extract_hosts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(sender.hosts(F.col("text")), ",").alias("hosts"))


_HOSTS = {"odd": ["mail1.example.com", "mail3.example.com"], "mail": ["example.com", "mail2.example.com"], "other": ["example.org"]}


@query(
    "vendor_suffix_match",
    """plain WITH h AS (SELECT doc_id, unnest(regexp_extract_all(text, '@([A-Za-z0-9.-]+[A-Za-z0-9])', 1)) AS host FROM documents),
    d AS (SELECT * FROM (VALUES ('odd','mail1.example.com'),('odd','mail3.example.com'),('mail','example.com'),('mail','mail2.example.com'),('other','example.org')) v(vendor, domain)),
    m AS (SELECT h.doc_id, lower(h.host) AS host, d.vendor, row_number() OVER (PARTITION BY h.doc_id, lower(h.host) ORDER BY length(d.domain) DESC NULLS LAST, d.domain) AS turn FROM (SELECT DISTINCT doc_id, lower(host) AS host FROM h) h LEFT JOIN d ON h.host = d.domain OR ends_with(h.host, '.' || d.domain))
    SELECT doc_id, host, vendor FROM m WHERE turn = 1""",
)
def vendor_suffix_match(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit("@([A-Za-z0-9.-]+[A-Za-z0-9])"), F.lit(1)), F.lower))).alias("host"))
    return found.select("doc_id", "host", sender.vendor_of_host(F.col("host"), _HOSTS).alias("vendor"))


_NAME = "concat(CASE WHEN c_custkey % 4 = 0 THEN 'The ' ELSE '' END, c_name, ' & ', c_mktsegment, CASE c_custkey % 5 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' GmbH' WHEN 2 THEN ' Co. Ltd' WHEN 3 THEN ' Company LLC' ELSE '' END)"


@query("company_key", f"plain WITH n AS (SELECT c_custkey, regexp_replace(trim(regexp_replace(replace(lower({_NAME}), '&', ' and '), '[^0-9a-z]+', ' ', 'g')), '^the ', '') AS x FROM customer) SELECT c_custkey, regexp_replace(x, '( ({'|'.join(text.LEGAL_SUFFIXES)}))+$', '') AS company_key FROM n")
def company_key(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.company_key(F.expr(_NAME)).alias("company_key"))


_TITLE = "concat(CASE p_partkey % 4 WHEN 0 THEN 'Sr. ' WHEN 1 THEN 'Junior ' WHEN 2 THEN 'The ' ELSE '' END, p_type, CASE p_partkey % 3 WHEN 0 THEN ' SWE II' WHEN 1 THEN ' eng (REQ-12345)' ELSE ' ML mgr #77' END)"


def _title_tokens_sql(table_sql: str) -> str:
    """Tokens of _TITLE without requisition ids, abbreviations written out and seniority dropped."""
    expand = "x"
    for k, v in text.ROLE_WORDS.items():
        expand = f"regexp_replace({expand}, '\\b{k}\\b', '{v}', 'g')"
    drop = "|".join(text.SENIORITY)
    bare = f"regexp_replace(regexp_replace({_TITLE}, '\\(REQ-12345\\)', ' ', 'g'), '#77', ' ', 'g')"
    return f"""t AS (SELECT p_partkey, trim(regexp_replace(lower({bare}), '[^0-9a-z]+', ' ', 'g')) AS x FROM {table_sql}),
    e AS (SELECT p_partkey, {expand} AS x FROM t),
    r AS (SELECT p_partkey, regexp_replace(array_to_string(list_filter(string_split(x, ' '), lambda w: w NOT IN ('{drop.replace("|", "','")}')), ' '), '^the ', '') AS x FROM e)"""


@query("role_tokens", f"plain WITH {_title_tokens_sql('part')} SELECT p_partkey, x AS role_key FROM r")
def role_tokens(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.role_key(F.expr(_TITLE)).alias("role_key"))


def _pairs(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    other = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_type").alias("other"))
    return p.join(other, "p_partkey")


_WORDS = "list_distinct(list_filter(string_split(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> ''))"
_PAIRS = f"plain WITH p AS (SELECT a.p_partkey, {_WORDS.format('a.p_type')} AS x, {_WORDS.format('b.p_type')} AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)"


@query("dice_similarity", f"{_PAIRS} SELECT p_partkey, 2.0::DOUBLE * len(list_intersect(x, y)) / (len(x) + len(y)) AS dice FROM p")
def dice_similarity(spark, sf_dir):
    return _pairs(spark, sf_dir).select("p_partkey", text.dice(text.link_tokens(F.col("p_type")), text.link_tokens(F.col("other"))).alias("dice"))


@query("jaccard_similarity", f"{_PAIRS} SELECT p_partkey, len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) AS jaccard FROM p")
def jaccard_similarity(spark, sf_dir):
    return _pairs(spark, sf_dir).select("p_partkey", text.jaccard(F.array_distinct(text.tokens(F.col("p_type"))), F.array_distinct(text.tokens(F.col("other")))).alias("jaccard"))


#: A generic rule table, as what the domain's rules hear doesn't occur in the driver tables.
GENERIC_RULES = [
    Rule("g.subject.the", "application_received", "subject", "(^| )the ", True),
    Rule("g.body.licence", "offer", "body", "licen[cs]e"),
    Rule("g.body.address", "rejection", "body", "[a-z0-9.]+@[a-z0-9.]+"),
    Rule("g.body.de", "interview", "body", " de "),
    Rule("g.subject.der", "assessment", "subject", "(^| )der ", True),
    Rule("g.body.and", "application_received", "body", " and "),
]
_FIRST, _REST = "split_part(text, chr(10), 1)", "CASE WHEN contains(text, chr(10)) THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END"


def _scored(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", text.normalize_text(F.split_part("text", F.lit("\n"), F.lit(1))).alias("subject"), text.normalize_text(F.when(F.contains("text", F.lit("\n")), F.substr("text", F.instr("text", "\n") + 1)).otherwise("")).alias("body"))
    return docs.withColumn("ids", fired(F.col("subject"), F.col("body"), GENERIC_RULES)).withColumn("ranks", ranks_of(F.col("ids"), GENERIC_RULES))


def _scored_sql() -> str:
    clean = "trim(regexp_replace(replace(lower(translate({0}, '‘’“”–— ​', '''''\"\"-- ')), 'ß', 'ss'), '\\s+', ' ', 'g'))"
    hit = ", ".join(f"CASE WHEN regexp_matches({r.scope}, '{r.pattern}') THEN '{r.rule_id}' END" for r in GENERIC_RULES)
    rank = "CASE " + " ".join(f"WHEN x = '{r.rule_id}' THEN {EVENT_TYPES.index(r.event_type)}" for r in GENERIC_RULES) + " END"
    return f"""plain WITH d AS (SELECT doc_id, {clean.format(_FIRST)} AS subject, {clean.format(_REST)} AS body FROM documents),
    i AS (SELECT doc_id, list_filter([{hit}], lambda x: x IS NOT NULL) AS ids FROM d),
    s AS (SELECT doc_id, ids, list_sort(list_distinct(list_transform(ids, lambda x: {rank}))) AS ranks FROM i),
    w AS (SELECT *, CASE WHEN len(ranks) = 0 THEN 'unknown' ELSE ['{"','".join(EVENT_TYPES)}'][ranks[1] + 1] END AS event_type FROM s) """


@query("rule_scores", _scored_sql() + "SELECT doc_id, array_to_string(ids, ',') AS rule_ids FROM w")
def rule_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", F.array_join("ids", ",").alias("rule_ids"))


@query("precedence_winner", _scored_sql() + "SELECT doc_id, event_type FROM w")
def precedence_winner(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", winner(F.col("ranks")).alias("event_type"))


_HAS = lambda scope, high: "len(list_filter(ids, lambda x: CASE " + " ".join(f"WHEN event_type = '{t}' THEN x IN ('', {', '.join(repr(r.rule_id) for r in GENERIC_RULES if r.event_type == t and r.scope == scope and (r.high_precision or not high)) or repr('')})" for t in EVENT_TYPES) + " END)) > 0"


@query("confidence_score", _scored_sql() + f"SELECT doc_id, CASE WHEN event_type = 'unknown' THEN 0.0 ELSE greatest(0, least(100, CASE WHEN {_HAS('subject', True)} THEN 40 ELSE 0 END + CASE WHEN {_HAS('body', False)} THEN 20 ELSE 0 END - CASE WHEN len(list_filter(ranks, lambda r: list_contains(ranks, r + 1))) > 0 THEN 20 ELSE 0 END)) / 100.0::DOUBLE END AS confidence FROM w")
def confidence_score(spark, sf_dir):
    rows = _scored(spark, sf_dir).withColumn("event_type", winner(F.col("ranks")))
    return rows.select("doc_id", confidence(F.col("event_type"), F.col("ids"), F.col("ranks"), F.lit(None).cast("string"), F.lit(False), GENERIC_RULES).alias("confidence"))


@query("extraction_chain", mails.extraction_sql())
def extraction_chain(spark, sf_dir):
    """Company, role and location of a mail around the words of each document that has enough of them; SQL knows what was put where."""
    rows, none = mails.extraction_texts(table(spark, sf_dir, "documents")), F.lit(None).cast("string")
    heard = encoded(F.array(text.normalize_text(F.col("subject")), text.normalize_text(F.col("body"))))
    rows = rows.withColumn("heard", heard)
    company = rules.extract_company(F.col("subject"), F.col("body"), none, none, none, F.col("heard")[0], F.col("heard")[1])
    return rows.select("doc_id", company["value"].alias("company"), rules.extract_role(F.col("subject"), F.col("body"), none)["value"].alias("role"), rules.extract_location(F.col("subject"), F.col("body"))["value"].alias("location"))


@query("application_ids", "plain SELECT c_custkey, concat('app_', substr(sha256(concat_ws(chr(31), lower(c_name), CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END, concat('m', c_custkey))), 1, 16)) AS application_id FROM customer")
def application_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    role = F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment"))
    return rows.select("c_custkey", ov.application_id(F.lower("c_name"), role, F.concat(F.lit("m"), F.col("c_custkey").cast("string"))).alias("application_id"))


@query("export_projection", f"SELECT {_EXPORT} FROM model")
def export_projection(spark, sf_dir):
    frame = ev.export_frame(_model(spark, sf_dir)[2])
    return frame.withColumns({c: F.unix_micros(c) for c in ("applied_at", "last_event_at")})


@query("event_projection", "SELECT application_id, message_id, event_type, epoch_us(occurred_at) AS occurred_at, confidence, needs_review, subject FROM eff")
def event_projection(spark, sf_dir):
    return ev.event_frame(_model(spark, sf_dir)[1]).withColumn("occurred_at", F.unix_micros("occurred_at"))


_NEWEST = "SELECT event_id, epoch_us(occurred_at) AS occurred_at FROM ev ORDER BY ev.occurred_at DESC, event_id DESC LIMIT 1"


@query("newest_event", _NEWEST)
def newest_event(spark, sf_dir):
    return ev.newest(log(spark, sf_dir)["events"]).select("event_id", micros("occurred_at"))


@query("calendar_daily", """plain WITH c AS (SELECT o_orderdate::DATE AS period, count(*) AS n FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1),
    s AS (SELECT unnest(generate_series(min(period), max(period), INTERVAL 1 DAY))::DATE AS period FROM c)
    SELECT strftime(s.period, '%Y-%m-%d') AS period, coalesce(c.n, 0) AS n FROM s LEFT JOIN c ON c.period = s.period""")
def calendar_daily(spark, sf_dir):
    return reports.calendar_counts(table(spark, sf_dir, "orders"), "o_orderdate", "D").select(F.date_format("period", "yyyy-MM-dd").alias("period"), "n")


@query("calendar_monthly", """plain WITH c AS (SELECT date_trunc('month', o_orderdate) AS period, count(*) AS n FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1),
    s AS (SELECT unnest(generate_series(min(period), max(period), INTERVAL 1 MONTH)) AS period FROM c)
    SELECT strftime(s.period, '%Y-%m-%d') AS period, coalesce(c.n, 0) AS n FROM s LEFT JOIN c ON c.period = s.period""")
def calendar_monthly(spark, sf_dir):
    return reports.calendar_counts(table(spark, sf_dir, "orders"), "o_orderdate", "MS").select(F.date_format("period", "yyyy-MM-dd").alias("period"), "n")


@query("short_dates", "plain SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS shown FROM orders")
def short_dates(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", ev.short_date(F.col("o_orderdate")).alias("shown"))


# Mail of known meaning, made of the customer table: what is expected is written down beside each text, not computed.


@query("classify_mail", mails.expected_sql())
def classify_mail(spark, sf_dir):
    found = classify(mails.messages(table(spark, sf_dir, "customer")))
    return found.select("message_id", "event_type", "company", "company_key", "role", "location", "ats", "confidence", "needs_review")


@query("rule_table", mails.rules_sql())
def rule_table(spark, sf_dir):
    """All rules over a text for each document; SQL knows by the number of words between whether the one asked for fires."""
    texts = mails.rule_texts(table(spark, sf_dir, "documents")).withColumn("heard", encoded(F.array("subject", "body")))
    return texts.select("doc_id", "rule_id", F.array_contains(fired(F.col("heard")[0], F.col("heard")[1]), F.col("rule_id")).alias("fires"))


@query("vendor_detection", mails.vendors_sql())
def vendor_detection(spark, sf_dir):
    mail = mails.vendor_mails(table(spark, sf_dir, "customer"))
    found = sender.detect_vendor(F.col("from_email"), F.col("headers"))
    return mail.select("c_custkey", found["vendor"].alias("ats"), F.array_join(found["evidence"], ",").alias("evidence"), sender.sender_domain_label(F.col("from_email")).alias("label"))


def _link_input(spark, sf_dir):
    raw = table(spark, sf_dir, "events").withColumn("n", F.col("event_id"))
    message = F.concat(F.lit("m"), F.col("n").cast("string"))
    messages = raw.select(message.alias("message_id"), F.concat_ws("-", F.col("user_id").cast("string"), (F.col("n") % 11).cast("string")).alias("thread_id"), F.col("ts").cast("timestamp").alias("received_at"))
    key, none = F.concat(F.lit("company "), (F.col("user_id") % 40).cast("string")), F.lit(None).cast("string")
    classes = raw.select(message.alias("message_id"), F.when(F.col("n") % 10 == 0, "unknown").otherwise("interview").alias("event_type"), key.alias("company"), F.when(F.col("n") % 29 != 0, key).alias("company_key"), none.alias("role"), none.alias("location"), none.alias("ats"))
    return messages, classes


_CORRECTED = """, seen AS (
    SELECT e.message_id, concat(e.user_id, '-', e.event_id % 11) AS thread_id, e.occurred_at, coalesce(o.event_type, CASE WHEN e.event_id % 10 = 0 THEN 'unknown' ELSE 'interview' END) AS type,
        CASE WHEN (e.event_id % 10 = 0 OR e.event_id % 29 = 0) AND o.company <> '' THEN lower(o.company) WHEN e.event_id % 29 <> 0 THEN concat('company ', e.user_id % 40) END AS key
    FROM ev e LEFT JOIN ovr o USING (message_id)),"""
_AS_IT_CAME = """, seen AS (
    SELECT message_id, concat(user_id, '-', event_id % 11) AS thread_id, occurred_at, CASE WHEN event_id % 10 = 0 THEN 'unknown' ELSE 'interview' END AS type, CASE WHEN event_id % 29 <> 0 THEN concat('company ', user_id % 40) END AS key
    FROM ev),"""
_LINKED = """
linkable AS (SELECT * FROM seen WHERE type <> 'unknown' AND key IS NOT NULL),
homes AS (SELECT thread_id, arg_min(key, (occurred_at, message_id)) AS home FROM linkable GROUP BY 1),
apps AS (SELECT home, arg_min(message_id, (occurred_at, message_id)) AS seed FROM linkable JOIN homes USING (thread_id) GROUP BY 1)
SELECT s.message_id, 'app_' || substr(sha256(a.home || chr(31) || chr(31) || a.seed), 1, 16) AS application_id, coalesce(s.message_id = a.seed, false) AS created
FROM seen s LEFT JOIN (SELECT message_id, home FROM linkable JOIN homes USING (thread_id)) h USING (message_id) LEFT JOIN apps a USING (home)"""


@query("relink_after_override", _CORRECTED + _LINKED)
def relink_after_override(spark, sf_dir):
    """Links with corrections folded in. Without roles, all threads that a company opens share one application, which SQL can say."""
    messages, classes = _link_input(spark, sf_dir)
    return link(messages, classes, NOW, overrides=log(spark, sf_dir)["overrides"].withColumn("role", F.lit(None).cast("string"))).select("message_id", "application_id", "created")


@query(
    "mailbox_sync",
    """plain SELECT conv_id || '-' || turn AS message_id, conv_id::VARCHAR AS thread_id, (1704067200 + conv_id * 3600 + turn * 60) * 1000000 AS received_at, role || '@example.org' AS from_email,
    upper(role[1:1]) || role[2:] AS from_name, 'Turn ' || turn AS subject, md5(regexp_replace(text, '\\s+', '', 'g')) AS body FROM conversations WHERE (conv_id * 1000 + turn) % 23 <> 0""",
)
def mailbox_sync(spark, sf_dir):
    """Conversations as the payloads of a mailbox, synced twice by the cursor: what came before the cursor was set, and behind it what is new or told again."""
    folder, number = new_path(spark, "mailbox"), F.col("conv_id") * 1000 + F.col("turn")
    header = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    sender = F.concat(F.initcap("role"), F.lit(" <"), F.col("role"), F.lit("@example.org>"))
    part = F.struct(F.lit("text/plain").alias("mimeType"), F.struct(F.translate(F.base64(F.encode("text", "utf-8")), "+/", "-_").alias("data")).alias("body"))
    mail = F.struct(F.lit("multipart/mixed").alias("mimeType"), F.array(header("From", sender), header("Subject", F.concat(F.lit("Turn "), F.col("turn").cast("string")))).alias("headers"), F.array(part).alias("parts"))
    label = F.when(number % 23 == 0, "SPAM").otherwise("INBOX")
    at = (F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60) * 1000
    entry = lambda history: F.to_json(F.struct(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("conv_id").cast("string").alias("threadId"), history.cast("string").alias("historyId"), at.cast("string").alias("internalDate"), F.array(label).alias("labelIds"), mail.alias("payload")))
    talk = table(spark, sf_dir, "conversations")
    for some, history in (("(conv_id * 7 + turn) % 3 < 2", number + 1), ("(conv_id * 7 + turn) % 3 > 0", number + 1_000_000_000_000)):
        mailbox.write_mailbox(talk.filter(some).select(entry(history).alias("value")), f"{folder}/box", page=1000)
        sync_mailbox(spark, f"{folder}/store", "2024-01-01", path=f"{folder}/box")
    body = F.md5(F.regexp_replace("body_text", "\\s+", ""))
    return stored(spark, f"{folder}/store").select("message_id", "thread_id", F.unix_micros("received_at").alias("received_at"), "from_email", "from_name", "subject", body.alias("body"))


@query("linked_stream", _AS_IT_CAME + _LINKED)
def linked_stream(spark, sf_dir):
    """Links by the stream with state, from four batches in the order of time, but one message in fifty comes in the last."""
    messages, classes = _link_input(spark, sf_dir)
    folder = new_path(spark, "linked-stream")
    rows = written(linkable(messages, classes), "linkable")
    turn = F.when(F.pmod(F.xxhash64("message_id"), F.lit(50)) == 0, 3).otherwise(F.least(F.lit(3), F.floor((F.dayofmonth(F.timestamp_micros("at")) - 1) / 8)))
    stream = LinkStream(spark, folder, pd.Timestamp(NOW), buckets=8)
    for n in range(4):  # a batch is all that has come since the last
        rows.filter(turn == n).write.mode("append").parquet(f"{folder}/inbox")
        stream.follow(f"{folder}/inbox")
    return messages.select("message_id").join(stream.links.read(), "message_id", "left").select("message_id", "application_id", F.coalesce("created", F.lit(False)).alias("created"))


# Beyond SQL: rows only; the tests compare these with plain Python.


@query("html_text")
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.html_to_text(F.col("html")).alias("text"))


@query("role_sequence_ratio")
def role_sequence_ratio(spark, sf_dir):
    return _pairs(spark, sf_dir).select("p_partkey", text.role_similarity(F.col("p_type"), F.col("other")).alias("similarity"))


@query("link_fold")
def link_fold(spark, sf_dir):
    raw = table(spark, sf_dir, "events").withColumn("n", F.col("event_id"))
    word = F.element_at(F.array(*map(F.lit, ("software engineer", "data analyst", "designer", "product manager"))), (F.col("n") % 4 + 1).cast("int"))
    role = F.when(F.col("n") % 3 != 0, word)
    message = F.concat(F.lit("m"), F.col("n").cast("string"))
    messages = raw.select(message.alias("message_id"), F.concat_ws("-", F.col("user_id").cast("string"), (F.col("n") % 11).cast("string")).alias("thread_id"), F.col("ts").cast("timestamp").alias("received_at"))
    key = F.concat(F.lit("company "), (F.col("user_id") % 40).cast("string"))
    none = F.lit(None).cast("string")
    classes = raw.select(message.alias("message_id"), F.when(F.col("n") % 10 == 0, "unknown").otherwise("interview").alias("event_type"), key.alias("company"), F.when(F.col("n") % 29 != 0, key).alias("company_key"), role.alias("role"), none.alias("location"), none.alias("ats"))
    return link(messages, classes, NOW).select("message_id", "application_id", "created")


@query("incremental_sync")
def incremental_sync(spark, sf_dir):
    folder = new_path(spark, "sync")
    talk = table(spark, sf_dir, "conversations").withColumn("id", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60)
    none, labels = F.lit(None).cast("string"), F.array(F.lit("INBOX"))
    mail = talk.select(F.col("id").alias("message_id"), F.col("conv_id").cast("string").alias("thread_id"), at.alias("received_at"), F.concat("role", F.lit("@example.org")).alias("from_email"), none.alias("from_name"), none.alias("to_email"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("subject"), F.col("text").alias("body_text"), F.lit("").alias("snippet"), labels.alias("labels"))
    mail.filter("hash(message_id) % 2 = 0").write.mode("append").json(f"{folder}/inbox")
    sync(spark, f"{folder}/inbox", f"{folder}/store", multi_line=False)
    mail.write.mode("append").json(f"{folder}/inbox")  # overlaps what has been read
    sync(spark, f"{folder}/inbox", f"{folder}/store", multi_line=False)
    return stored(spark, f"{folder}/store").select("message_id", "thread_id", F.unix_micros("received_at").alias("received_at"), "batch")
