"""Effective events (corrections applied at read time) and the read model folded from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.schemas import EVENT_COLUMNS, EVENT_TYPES, EXPORT_COLUMNS, STATUS_OF, TERMINAL_TYPES, lookup, precedence

DAY_US = 86_400_000_000


def whole_days(later: Column, earlier: Column) -> Column:
    """Floor of the 24-hour periods between two instants (negative ones floor too)."""
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / DAY_US).cast("long")


def effective_events(events: DataFrame, messages: DataFrame, classifications: DataFrame, overrides: DataFrame) -> DataFrame:
    """Events with their message's fields, their classification's confidence and any correction.

    An event without classification has confidence 0 and needs review; an override row without a correction is
    an acceptance: the event isn't overridden, and its review flag is cleared.
    """
    m = messages.select("message_id", "thread_id", "subject", "from_email")
    c = classifications.select("message_id", "confidence", F.col("needs_review").alias("flagged"))
    o = overrides.select("message_id", F.col("event_type").alias("o_type"), F.col("company").alias("o_company"), F.col("role").alias("o_role"), "corrected_at", F.lit(True).alias("reviewed"))
    rows = events.join(m, "message_id").join(c, "message_id", "left").join(o, "message_id", "left")
    corrected = F.col("o_type").isNotNull() | F.col("o_company").isNotNull() | F.col("o_role").isNotNull()
    return rows.select(
        "event_id",
        "application_id",
        "message_id",
        F.coalesce("o_type", "event_type").alias("event_type"),
        "occurred_at",
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        (F.coalesce("flagged", F.lit(True)) & F.col("reviewed").isNull()).alias("needs_review"),
        corrected.alias("is_overridden"),
        "subject",
        "from_email",
        "thread_id",
        "o_company",
        "o_role",
        "corrected_at",
    )


def newest(events: DataFrame) -> DataFrame:
    """The latest event of all, by time and then number; no row for none."""
    return events.orderBy(F.desc("occurred_at"), F.desc("event_id")).limit(1)


def short_date(at: Column) -> Column:
    """A timestamp as listings show it, in UTC (the session's zone)."""
    return F.date_format(at, "yyyy-MM-dd HH:mm")


def status_of(last_terminal: Column, best_rank: Column, last_at: Column, now: Column, ghost_days: int) -> Column:
    """The latest terminal event decides; else silence of more than ghost_days; else the furthest stage."""
    furthest = lookup(STATUS_OF, F.element_at(F.array(*[F.lit(x) for x in EVENT_TYPES]), best_rank + 1))
    quiet = F.unix_micros(now) - F.unix_micros(last_at) > ghost_days * DAY_US
    return F.when(last_terminal.isNotNull(), lookup(STATUS_OF, last_terminal)).when(last_at.isNull(), F.lit("applied")).when(quiet, F.lit("ghosted")).otherwise(furthest)


def folded(effective: DataFrame, now: Column, ghost_days: int = 30) -> DataFrame:
    """One row for each application_id of effective: everything the read model derives from its events, in one aggregation."""
    place = F.struct("occurred_at", "event_id")
    kind, at = F.col("event_type"), F.col("occurred_at")
    latest = lambda c: F.max_by(F.when(F.col(c) != "", F.col(c)), F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct("corrected_at", "event_id")))
    rows = effective.filter(F.col("application_id").isNotNull()).groupBy("application_id").agg(
        F.min(at).alias("applied_at"),
        F.max(at).alias("last_event_at"),
        F.max_by(kind, place).alias("last_event_type"),
        F.count(F.lit(1)).alias("event_count"),
        F.min(F.when(kind != "application_received", at)).alias("responded_at"),
        F.max_by(kind, F.when(kind.isin(TERMINAL_TYPES), place)).alias("last_terminal"),
        F.min(precedence(kind)).alias("best_rank"),
        F.bool_or(F.col("needs_review") & ~F.col("is_overridden")).alias("needs_review"),
        F.array_sort(F.collect_set("thread_id")).alias("source_thread_ids"),
        latest("o_company").alias("company_correction"),
        latest("o_role").alias("role_correction"),
    )
    return rows.select(
        "application_id",
        status_of(F.col("last_terminal"), F.col("best_rank"), F.col("last_event_at"), now, ghost_days).alias("status"),
        "applied_at",
        "last_event_at",
        "last_event_type",
        "event_count",
        whole_days(F.col("responded_at"), F.col("applied_at")).alias("days_to_first_response"),
        whole_days(now, F.col("last_event_at")).alias("days_since_last_event"),
        "needs_review",
        "source_thread_ids",
        "company_correction",
        "role_correction",
        "last_terminal",
        "best_rank",
    )


#: What an application's events add up to, in parts that can be merged: least, greatest by place, sums, sets.
PARTIAL = (
    "application_id string, applied_at timestamp, last struct<at: timestamp, id: bigint, kind: string>, event_count bigint, responded_at timestamp, terminal struct<at: timestamp, id: bigint, kind: string>, "
    "best_rank int, needs_review boolean, threads array<string>, company struct<at: timestamp, id: bigint, value: string>, role struct<at: timestamp, id: bigint, value: string>"
)


def partials(effective: DataFrame) -> DataFrame:
    """One row of PARTIAL for each application of effective events."""
    kind, at = F.col("event_type"), F.col("occurred_at")
    place = F.struct(at.alias("at"), F.col("event_id").alias("id"), kind.alias("kind"))
    said = lambda c: F.max(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct(F.col("corrected_at").alias("at"), F.col("event_id").alias("id"), F.col(c).alias("value"))))
    return effective.filter(F.col("application_id").isNotNull()).groupBy("application_id").agg(
        F.min(at).alias("applied_at"),
        F.max(place).alias("last"),
        F.count(F.lit(1)).alias("event_count"),
        F.min(F.when(kind != "application_received", at)).alias("responded_at"),
        F.max(F.when(kind.isin(TERMINAL_TYPES), place)).alias("terminal"),
        F.min(precedence(kind)).alias("best_rank"),
        F.bool_or(F.col("needs_review") & ~F.col("is_overridden")).alias("needs_review"),
        F.collect_set("thread_id").alias("threads"),
        said("o_company").alias("company"),
        said("o_role").alias("role"),
    )


def merged(parts: DataFrame) -> DataFrame:
    """One row of PARTIAL for each application from any number of them."""
    least, greatest = ("applied_at", "responded_at", "best_rank"), ("last", "terminal", "company", "role")
    return parts.groupBy("application_id").agg(
        *[F.min(c).alias(c) for c in least],
        *[F.max(c).alias(c) for c in greatest],
        F.sum("event_count").alias("event_count"),
        F.bool_or("needs_review").alias("needs_review"),
        F.array_distinct(F.flatten(F.collect_list("threads"))).alias("threads"),
    )


def derived(parts: DataFrame, now: Column, ghost_days: int = 30) -> DataFrame:
    """What folded gives of all events, from the merged parts of each application."""
    return parts.select(
        "application_id",
        status_of(F.col("terminal.kind"), F.col("best_rank"), F.col("last.at"), now, ghost_days).alias("status"),
        "applied_at",
        F.col("last.at").alias("last_event_at"),
        F.col("last.kind").alias("last_event_type"),
        "event_count",
        whole_days(F.col("responded_at"), F.col("applied_at")).alias("days_to_first_response"),
        whole_days(now, F.col("last.at")).alias("days_since_last_event"),
        "needs_review",
        F.array_sort("threads").alias("source_thread_ids"),
        F.col("company.value").alias("company_correction"),
        F.col("role.value").alias("role_correction"),
        F.col("terminal.kind").alias("last_terminal"),
        "best_rank",
    )


def with_applications(rows: DataFrame, applications: DataFrame) -> DataFrame:
    """Derived rows with the fields of their applications; corrections of company and role win."""
    found = rows.join(applications, "application_id")
    return found.withColumns({"company": F.coalesce("company_correction", "company"), "role": F.coalesce("role_correction", "role")}).drop("company_correction", "role_correction", "last_terminal", "best_rank")


def read_model(applications: DataFrame, effective: DataFrame, now: Column, ghost_days: int = 30) -> DataFrame:
    """Applications with derived fields; corrections of company and role win; applications without events are hidden."""
    return with_applications(folded(effective, now, ghost_days), applications)


def company_matches(key: Column, needle: str) -> Column:
    """Whether a company contains needle, both reduced to lower-case letters and digits; an empty needle matches all."""
    reduced = "".join(x for x in needle.casefold() if x.isascii() and x.isalnum())
    return F.contains(F.regexp_replace(F.lower(F.coalesce(key, F.lit(""))), "[^a-z0-9]+", ""), F.lit(reduced))


def list_applications(model: DataFrame, status: str | None = None, company: str | None = None, needs_review: bool | None = None) -> DataFrame:
    if status is not None:
        model = model.filter(F.col("status") == status)
    if company is not None:
        model = model.filter(company_matches(F.col("company_key"), company) | company_matches(F.col("company"), company))
    if needs_review is not None:
        model = model.filter(F.col("needs_review") == needs_review)
    return model.orderBy("application_id")


def export_frame(model: DataFrame) -> DataFrame:
    return model.select(*EXPORT_COLUMNS)


def event_frame(effective: DataFrame) -> DataFrame:
    return effective.select(*EVENT_COLUMNS)
