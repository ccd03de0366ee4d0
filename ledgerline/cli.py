"""Thin command line over a store folder: sync, list, stats, review, accept, correct, reclassify, export, dashboard."""

from __future__ import annotations

import argparse
import sys
from datetime import datetime, timedelta, timezone

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import events as ev
from ledgerline.operators import overrides as ov
from ledgerline.operators import reports
from ledgerline.operators.linking import applications_of
from ledgerline.schemas import EVENT_TYPES, STATUSES
from ledgerline.sources import sinks
from ledgerline.streaming import incremental


def since(value: str, now: datetime) -> datetime:
    """A number of days before now, or an ISO date or time (UTC unless it says otherwise)."""
    if value.isdigit():
        return now - timedelta(days=int(value))
    found = datetime.fromisoformat(value)
    return found if found.tzinfo else found.replace(tzinfo=timezone.utc)


def frames(spark: SparkSession, store: str, now: datetime):
    """The store's tables, their effective events, and the read model."""
    t = incremental.tables(spark, store, now.replace(tzinfo=None))
    latest = incremental.overrides_of(spark, store)
    effective = ev.effective_events(t["events"], t["messages"], t["classifications"], latest)
    return t, latest, effective, ev.read_model(applications_of(t["links"]), effective, F.lit(now))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="ledgerline", description=__doc__)
    parser.add_argument("--store", required=True)
    parser.add_argument("--now", default=None, help="ISO time; the clock's if left out")
    verbs = parser.add_subparsers(dest="verb", required=True)
    syncing = verbs.add_parser("sync")
    syncing.add_argument("inbox", help="folder of message files, or of a mailbox")
    syncing.add_argument("--mailbox", action="store_true", help="read a mailbox behind the store's cursor")
    verbs.add_parser("accept").add_argument("message_id")
    verbs.add_parser("reclassify", help="count what links by the rules as they are now, corrections put on top again")
    listing = verbs.add_parser("list")
    listing.add_argument("--status", choices=STATUSES)
    listing.add_argument("--company")
    listing.add_argument("--since", help="days, or an ISO date: only applications with an event from then on")
    verbs.add_parser("stats")
    verbs.add_parser("review").add_argument("--limit", type=int, default=20)
    correcting = verbs.add_parser("correct")
    correcting.add_argument("message_id")
    correcting.add_argument("--type", choices=EVENT_TYPES)
    correcting.add_argument("--company")
    correcting.add_argument("--role")
    correcting.add_argument("--note")
    for verb in ("export", "dashboard"):
        verbs.add_parser(verb).add_argument("path")
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    now = since(args.now, datetime.now(timezone.utc)) if args.now else datetime.now(timezone.utc)
    if args.verb == "sync":
        if args.mailbox:
            print("\t".join(f"{k}={v}" for k, v in incremental.sync_mailbox(spark, args.store, now, path=args.inbox).items()))
        else:
            incremental.sync(spark, args.inbox, args.store)
        incremental.report(incremental.tables(spark, args.store, now.replace(tzinfo=None))).show(truncate=False)
        return 0
    if args.verb == "reclassify":
        incremental.report(incremental.tables(spark, args.store, now.replace(tzinfo=None), reapply=True)).show(truncate=False)
        return 0
    if args.verb == "accept":
        incremental.set_override(spark, args.store, args.message_id, now)
        return 0
    if args.verb == "correct":
        incremental.set_override(spark, args.store, args.message_id, now, args.type, args.company, args.role, args.note)
        return 0
    t, overrides, effective, model = frames(spark, args.store, now)
    if args.verb == "list":
        found = ev.list_applications(model, status=args.status, company=args.company)
        if args.since:
            found = found.filter(F.col("last_event_at") >= F.lit(since(args.since, now)))
        frame = ev.export_frame(found.orderBy("application_id"))
        print("\t".join(frame.columns))
        for row in frame.toLocalIterator():  # every application, a partition at a time
            print("\t".join("" if x is None else str(x) for x in row))
    elif args.verb == "stats":
        reports.summary(model).show(truncate=False)
        reports.stats_by_status(model).show()
    elif args.verb == "review":
        ov.review_queue(t["messages"], t["classifications"], overrides, t["events"], args.limit).select("message_id", "subject", "event_type", "confidence", "suggested_application_id").show(args.limit, truncate=False)
    elif args.verb == "export":
        apps, events = ev.export_frame(model.orderBy("application_id")), ev.event_frame(effective.orderBy("occurred_at", "event_id"))
        print(sinks.write_xlsx({"Applications": apps, "Events": events}, args.path) if args.path.endswith(".xlsx") else sinks.write_csv(apps, args.path))
    else:
        print(sinks.write_dashboard(args.path, "Applications", reports.summary(model), reports.status_counts(model), reports.calendar_counts(model, "applied_at"), reports.top_companies(model), reports.latency_histogram(model), reports.stage_flows(effective, model)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
