"""Schemas, enums, ranks and frozen column lists. All timestamps are UTC instants."""

from pyspark.sql import Column
from pyspark.sql import functions as F

MESSAGE = "message_id string, thread_id string, received_at timestamp, from_email string, from_name string, to_email string, subject string, body_text string, snippet string, labels array<string>, headers map<string,string>"
CLASSIFICATION = "message_id string, event_type string, company string, company_key string, role string, location string, ats string, confidence double, needs_review boolean, evidence array<string>, classifier_name string, classifier_version string"
EVENT = "event_id long, application_id string, message_id string, event_type string, occurred_at timestamp"
OVERRIDE = "message_id string, event_type string, company string, role string, corrected_at timestamp, note string"
APPLICATION = "application_id string, company string, company_key string, role string, location string, ats string"
SYNC_STATE = "source string, cursor string"

#: Event types by precedence, the most telling first.
EVENT_TYPES = ["withdrawn", "rejection", "offer", "interview", "assessment", "application_received", "recruiter_outreach", "unknown"]
TERMINAL_TYPES = ["rejection", "offer", "withdrawn"]
#: Application statuses in pipeline order.
STATUSES = ["applied", "assessment", "interviewing", "offer", "rejected", "withdrawn", "ghosted"]
STATUS_OF = {"withdrawn": "withdrawn", "rejection": "rejected", "offer": "offer", "interview": "interviewing", "assessment": "assessment", "application_received": "applied", "recruiter_outreach": "applied", "unknown": "applied"}
#: Funnel stages in order, terminal ones last.
STAGES = ["Outreach", "Applied", "Assessment", "Interview", "Offer", "Rejected", "Withdrawn", "Ghosted"]
TERMINAL_RANK = STAGES.index("Offer")
STAGE_OF = {"recruiter_outreach": "Outreach", "application_received": "Applied", "assessment": "Assessment", "interview": "Interview", "offer": "Offer", "rejection": "Rejected", "withdrawn": "Withdrawn"}
#: Frozen column orders of exports.
EXPORT_COLUMNS = ["application_id", "company", "role", "location", "ats", "status", "applied_at", "last_event_at", "last_event_type", "event_count", "days_to_first_response", "days_since_last_event", "needs_review"]
EVENT_COLUMNS = ["application_id", "message_id", "event_type", "occurred_at", "confidence", "needs_review", "subject"]


def lookup(table: dict, key: Column) -> Column:
    """table[key] as nested conditions (small fixed tables only); null for other keys."""
    found = F.lit(None)
    for k, v in table.items():
        found = F.when(key == k, v).otherwise(found)
    return found


def precedence(event_type: Column) -> Column:
    return lookup({x: i for i, x in enumerate(EVENT_TYPES)}, event_type).cast("int")


def require_columns(df, names) -> None:
    missing = [x for x in names if x not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def checked_enum(column: Column, allowed: list[str], what: str) -> Column:
    """column, failing the query on a value outside allowed."""
    bad = F.raise_error(F.concat(F.lit(f"unknown {what}: "), column.cast("string")))
    return F.when(column.isNull() | column.isin(allowed), column).otherwise(bad.cast("string"))


def empty(spark, schema: str):
    return spark.createDataFrame([], schema)
