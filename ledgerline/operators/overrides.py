"""Corrections, acceptance, the review queue, and the table rewrites that upserts and deletes become."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.components import written


def latest_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The row of each key that comes last in order (which must be total for a defined result)."""
    w = Window.partitionBy(*keys).orderBy(*[x.desc_nulls_last() for x in order])
    return df.withColumn("_turn", F.row_number().over(w)).filter("_turn = 1").drop("_turn")


def insert_new(existing: DataFrame, incoming: DataFrame, key: str, *order: Column) -> DataFrame:
    """Rows of incoming to append: the first of each key that existing lacks."""
    w = Window.partitionBy(key).orderBy(*order)
    first = incoming.withColumn("_turn", F.row_number().over(w)).filter("_turn = 1").drop("_turn")
    return first.join(existing.select(key), key, "left_anti")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """existing with the rows of incoming put in their keys' place; the last of incoming by order counts."""
    rest = existing.join(incoming.select(*keys).distinct(), keys, "left_anti")
    return rest.unionByName(latest_by(incoming, keys, *order))


def accept(overrides: DataFrame, message_ids: DataFrame, at: Column) -> DataFrame:
    """overrides with a row of no corrections for each accepted message that has none."""
    new = message_ids.select("message_id").distinct().join(overrides.select("message_id"), "message_id", "left_anti")
    none = {c: F.lit(None).cast(t) for c, t in overrides.dtypes if c not in ("message_id", "corrected_at")}
    return overrides.unionByName(new.withColumns(none | {"corrected_at": at}))


def clear_classifications(classifications: DataFrame, overrides: DataFrame, only_unreviewed: bool = True) -> DataFrame:
    """What is left of classifications: those that a person has reviewed, or none."""
    return classifications.join(overrides.select("message_id").distinct(), "message_id", "left_semi") if only_unreviewed else classifications.limit(0)


def without_orphans(applications: DataFrame, events: DataFrame) -> DataFrame:
    return applications.join(events.select("application_id"), "application_id", "left_semi")


def review_queue(messages: DataFrame, classifications: DataFrame, overrides: DataFrame, events: DataFrame, limit: int | None = None) -> DataFrame:
    """Flagged messages that nobody has reviewed, oldest first, with the application their event is linked to."""
    flagged = classifications.filter("needs_review").join(overrides.select("message_id"), "message_id", "left_anti")
    linked = events.select("message_id", F.col("application_id").alias("suggested_application_id"))
    rows = messages.join(flagged, "message_id").join(linked, "message_id", "left").orderBy("received_at", "message_id")
    return rows if limit is None else rows.limit(limit)


#: Most probes' tokens that are broadcast; more are joined by a shuffle.
ASKED_BROADCAST = 200_000


def asked_of(probes: DataFrame) -> DataFrame:
    """(probe_id, kind, token, asked_keys, asked_threads): what probes(probe_id, company_key, thread_id) ask for, a row for each token."""
    grouped = probes.groupBy("probe_id").agg(F.collect_set("company_key").alias("asked_keys"), F.collect_set("thread_id").alias("asked_threads"))
    return written(grouped.select("*", F.explode(_tokens("asked_keys", "asked_threads")).alias("t")).select("probe_id", "t.*", "asked_keys", "asked_threads"), "asked")


def _tokens(keys: str, threads: str) -> Column:
    named = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("token"))
    return F.concat(F.transform(keys, named("key")), F.transform(threads, named("thread")))


def small(asked: DataFrame) -> DataFrame:
    """asked, broadcast if it is small."""
    return F.broadcast(asked) if asked.limit(ASKED_BROADCAST + 1).count() <= ASKED_BROADCAST else asked


def pairs_of(apps: DataFrame, asked: DataFrame) -> DataFrame:
    """(probe_id, application_id, last_event_at) of apps(application_id, last_event_at, keys, threads) that have a token of asked (see asked_of).

    Of the tokens that a pair has in common only the first tells it, so no pair comes twice and pairs, of which there may be hundreds for an
    application, need no shuffle to be made distinct.
    """
    first = lambda mine, theirs: (F.size(mine) == 1) | (F.size(theirs) == 1) | (F.col("token") == F.get(F.array_intersect(mine, theirs), 0))
    by_key = (F.col("kind") == "key") & first("keys", "asked_keys")
    by_thread = (F.col("kind") == "thread") & ~F.arrays_overlap("keys", "asked_keys") & first("threads", "asked_threads")
    rows = apps.select("*", F.explode(_tokens("keys", "threads")).alias("t")).select("application_id", "last_event_at", "keys", "threads", "t.*")
    return rows.join(small(asked), ["kind", "token"]).filter(by_key | by_thread).select("probe_id", "application_id", "last_event_at")


def candidates(applications: DataFrame, events: DataFrame, messages: DataFrame, probes: DataFrame) -> DataFrame:
    """(probe_id, application_id, last_event_at): applications that share the company key or a thread of
    probes(probe_id, company_key, thread_id). The disjunction is one equi-join by token."""
    linked = events.filter("application_id IS NOT NULL").join(messages.select("message_id", "thread_id"), "message_id", "left")
    active = linked.groupBy("application_id").agg(F.max("occurred_at").alias("last_event_at"), F.collect_set("thread_id").alias("threads"))
    keys = applications.groupBy("application_id").agg(F.collect_set("company_key").alias("keys"))
    apps = active.join(keys, "application_id", "left").withColumn("keys", F.coalesce("keys", F.array().cast("array<string>")))
    return pairs_of(apps, asked_of(probes))


def application_threads(events: DataFrame, messages: DataFrame) -> DataFrame:
    return events.filter("application_id IS NOT NULL").join(messages.select("message_id", "thread_id"), "message_id").select("application_id", "thread_id").distinct()


def application_id(company_key: Column, role: Column, seed: Column) -> Column:
    """app_ and 16 hex digits of the SHA-256 of the key, the role or nothing, and the first message's id."""
    joined = F.concat_ws("\x1f", company_key, F.coalesce(role, F.lit("")), seed)
    return F.concat(F.lit("app_"), F.substring(F.sha2(joined, 256), 1, 16))
