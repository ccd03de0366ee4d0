"""Incremental sync as a stream: new message files are classified and linked, and tables grow by what is new.

Messages are kept append-only as Parquet, one folder for each micro-batch, so a batch that runs again after a failure replaces its own
folder and nothing else. The tables of classifications, links and events are views over all messages: a full recompute
gives the same result whatever the batches were, and a correction needs no rewrite.
"""

from __future__ import annotations

import re
import time

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerline.operators.components import written
from ledgerline.operators.linking import events_of, link
from ledgerline.operators.overrides import insert_new, latest_by
from ledgerline.operators.rules import classify
from ledgerline.schemas import EVENT_TYPES, MESSAGE, OVERRIDE, SYNC_STATE, empty
from ledgerline.sources.mail import LOOKBACK_DAYS, parse_payloads, without_excluded
from ledgerline.sources.mailbox import register


def _batches(spark: SparkSession, store: str) -> DataFrame:
    """The messages of all batches as they were written, with their batch's number."""
    try:
        return spark.read.schema(f"{MESSAGE}, batch long").option("recursiveFileLookup", "false").parquet(f"{store}/messages")
    except Exception as error:  # nothing synced yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], f"{MESSAGE}, batch long")


def stored(spark: SparkSession, store: str) -> DataFrame:
    """All messages synced so far, each id once; a batch writes no id that it or an earlier one has written."""
    return _batches(spark, store)


def _append(spark: SparkSession, store: str, batch: DataFrame, n: int) -> tuple[int, int]:
    """Write the messages of batch n that no earlier batch has, in a folder of its own; how many came and how many were new, as the write itself saw them."""
    known = _batches(spark, store).filter(F.col("batch") < n).select("message_id")  # one narrow column of the history, no window over it
    came, new = Observation(), Observation()
    rows = without_excluded(batch).filter("message_id IS NOT NULL").observe(came, F.count(F.lit(1)).alias("n"))
    fresh = insert_new(known, rows, "message_id", F.col("received_at"), F.col("thread_id")).observe(new, F.count(F.lit(1)).alias("n"))
    fresh.write.mode("overwrite").parquet(f"{store}/messages/batch={n}")
    return came.get["n"], new.get["n"]


def sync(spark: SparkSession, inbox: str, store: str, max_files: int | None = None, multi_line: bool = True, checkpoint: str = "checkpoint", first_batch: int = 0) -> StreamingQuery:
    """Read the JSON files (of one object each, or with multi_line off of one a line) of inbox that no earlier sync has read, and append their new messages to store; returns when done.

    Offsets advance only after a batch is written (the checkpoint in store), so nothing is lost or read twice.
    """
    reader = spark.readStream.schema(MESSAGE).option("multiLine", multi_line)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)

    def write(batch: DataFrame, n: int) -> None:
        _append(spark, store, batch, n + first_batch)

    query = reader.json(inbox).writeStream.foreachBatch(write).option("checkpointLocation", f"{store}/{checkpoint}").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def sync_mailbox(spark: SparkSession, store: str, now, lookback_days: int = LOOKBACK_DAYS, checkpoint: str = "mailbox", source: str = "mailbox", **options: str) -> dict:
    """Append to store the new messages of a mailbox (sources/mailbox.py, by its options) behind the store's cursor; returns when done.

    The counters of the sync: fetched and stored messages, as the writes counted them, and the cursor, which is kept in store after the messages are. A store that
    has a cursor but no checkpoint goes on from the cursor; a first sync, and one whose cursor has expired, reads from lookback_days before now.
    """
    register(spark)
    since = (pd.Timestamp(now) - pd.Timedelta(days=lookback_days)).value // 1000
    reader = spark.readStream.format("mailbox").option("since", str(since)).options(**options)
    cursor = get_cursor(spark, store, source)
    if cursor is not None:
        reader = reader.option("cursor", cursor)
    counts = {"fetched": 0, "stored": 0}

    def write(batch: DataFrame, n: int) -> None:
        came, new = _append(spark, store, parse_payloads(batch.select(F.col("payload").alias("value"))), n)
        counts["fetched"] += came
        counts["stored"] += new

    query = reader.load().writeStream.foreachBatch(write).option("checkpointLocation", f"{store}/{checkpoint}").trigger(availableNow=True).start()
    query.awaitTermination()
    read = [int(x) for p in query.recentProgress for x in re.findall("-?[0-9]+", str(p["sources"][0]["endOffset"]))]
    after = str(read[-1]) if read and read[-1] >= 0 else cursor
    if after != cursor:
        set_cursor(spark, store, source, after)
    return counts | {"cursor": after}


def dry_run(spark: SparkSession, inbox: str, store: str) -> DataFrame:
    """(event_type, n): what a sync would add, without writing."""
    rows = spark.read.schema(MESSAGE).option("multiLine", True).json(inbox)
    fresh = without_excluded(rows).join(stored(spark, store).select("message_id"), "message_id", "left_anti").dropDuplicates(["message_id"])
    return classify(fresh).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def overrides_of(spark: SparkSession, store: str) -> DataFrame:
    """The corrections in store, the latest of each message; no rows before the first."""
    try:
        rows = spark.read.schema(OVERRIDE).parquet(f"{store}/overrides")
    except Exception as error:  # no correction yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        rows = empty(spark, OVERRIDE)
    return latest_by(rows, ["message_id"], F.col("corrected_at"))


def set_override(spark: SparkSession, store: str, message_id: str, at, event_type: str | None = None, company: str | None = None, role: str | None = None, note: str | None = None) -> None:
    """Append a correction (of no field: an acceptance). Status and links follow when they are next computed."""
    if event_type is not None and event_type not in EVENT_TYPES:
        raise ValueError(f"unknown event type: {event_type}")
    spark.createDataFrame([(message_id, event_type, company, role, at, note)], OVERRIDE).write.mode("append").parquet(f"{store}/overrides")


#: Layouts of a store in order: a change to it adds a step (version, function of (spark, store)) that brings an older one up.
STEPS: list = [(1, lambda spark, store: None)]


def store_version(spark: SparkSession, store: str) -> int:
    """The layout that a store has; 0 before the first migration."""
    try:
        return spark.read.schema("version int").parquet(f"{store}/versions").agg(F.max("version")).first()[0] or 0
    except Exception as error:  # no version yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return 0


def migrate(spark: SparkSession, store: str, steps: list | None = None) -> int:
    """Bring store to the newest layout, step by step; a step that fails leaves the version where it was. The version it has then."""
    steps, at = sorted(steps or STEPS, key=lambda x: x[0]), store_version(spark, store)
    if len({v for v, _ in steps}) < len(steps):
        raise ValueError("two steps have one version")
    for version, step in steps:
        if version > at:
            step(spark, store)
            spark.createDataFrame([(version,)], "version int").write.mode("append").parquet(f"{store}/versions")
            at = version
    return at


def rescan(spark: SparkSession, inbox: str, store: str, run: str, multi_line: bool = True) -> StreamingQuery:
    """Read every file of inbox again, under a checkpoint of its own named run; messages that the store has are not added twice."""
    return sync(spark, inbox, store, multi_line=multi_line, checkpoint=f"checkpoint-{run}", first_batch=1 + (_batches(spark, store).agg(F.max("batch")).first()[0] or 0))


def messages_by(spark: SparkSession, store: str, **keys) -> DataFrame:
    """Stored messages whose columns equal keys, oldest first."""
    rows = stored(spark, store)
    for column, value in keys.items():
        rows = rows.filter(F.col(column) == F.lit(value))
    return rows.orderBy("received_at", "message_id")


def get_cursor(spark: SparkSession, store: str, source: str) -> str | None:
    """The cursor last kept for source; null if there is none or it was cleared."""
    try:
        rows = spark.read.schema(f"{SYNC_STATE}, turn long").parquet(f"{store}/cursors")
    except Exception as error:  # no cursor yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None
    found = latest_by(rows.filter(F.col("source") == source), ["source"], F.col("turn")).first()
    return None if found is None else found.cursor


def set_cursor(spark: SparkSession, store: str, source: str, cursor: str | None) -> None:
    """Keep source's cursor; None clears it. Written after a batch is, so a failure reads again and never skips."""
    spark.createDataFrame([(source, cursor, time.time_ns())], f"{SYNC_STATE}, turn long").write.mode("append").parquet(f"{store}/cursors")


def tables(spark: SparkSession, store: str, now, reapply: bool = False) -> dict[str, DataFrame]:
    """messages, classifications, links and events over everything synced, corrections folded into the links; each is computed once
    and kept in the shared folder."""
    messages = written(stored(spark, store), "messages")
    classifications = written(classify(messages), "classifications")
    links = written(link(messages, classifications, now, overrides=overrides_of(spark, store), reapply=reapply), "links")
    return {"messages": messages, "classifications": classifications, "links": links, "events": events_of(messages, classifications, links)}


def report(t: dict[str, DataFrame]) -> DataFrame:
    """The counters of a sync in one row."""
    kept = t["classifications"].join(t["links"].select("message_id", "application_id", "created"), "message_id")
    flagged = F.count_distinct(F.when(F.col("needs_review"), F.col("application_id")))
    return kept.agg(F.count(F.lit(1)).alias("messages"), flagged.alias("flagged_applications"), F.count_if(F.col("event_type") == "unknown").alias("unknown"), F.count_if("needs_review").alias("needs_review"), F.count_if(F.col("application_id").isNotNull()).alias("linked"), F.count_if("created").alias("applications_created"))
