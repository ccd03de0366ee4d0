import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import events as ev
from ledgerline.operators import linking
from ledgerline.plans.standins import GHOST_DAYS, log, now
from ledgerline.sources.keyed import KeyedTable
from ledgerline.streaming.linked import LinkStream, linkable
from ledgerline.streaming.readmodel import TOLD, ReadModel, follow
from tests.test_linking import NOW, busy, by_plain_fold, frames

DATA = "/root/testdata/sf0.001"


def told_of(t):
    flagged = t["classifications"].withColumnRenamed("needs_review", "flagged")
    rows = t["events"].join(t["messages"].select("message_id", "thread_id", "subject", "from_email"), "message_id").join(flagged, "message_id", "left")
    return rows.select(*[x.split()[0] for x in TOLD.split(", ")])


def with_roles(t):
    return t | {"overrides": t["overrides"].withColumn("role", F.when(F.xxhash64("message_id") % 3 == 0, F.concat(F.lit("Role "), F.col("message_id"))))}


def test_the_read_model_of_batches_is_that_of_all_events(spark, tmp_path, monkeypatch):
    t = with_roles(log(spark, DATA))
    told, model = told_of(t), ReadModel(spark, str(tmp_path / "model"), buckets=4)
    parts = told.randomSplit([1.0, 1.0, 1.0], seed=3)
    some = F.pmod(F.xxhash64("message_id"), F.lit(2)) == 0
    model.add(parts[0], 0)
    model.correct(t["overrides"].filter(some), 0)
    real = KeyedTable._commit
    monkeypatch.setattr(KeyedTable, "_commit", lambda self, m: real(self, m) if self.path.endswith("events") else (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        model.add(parts[1], 1)  # dies when the log has the batch and the parts don't
    monkeypatch.undo()
    model.add(parts[1], 1)
    model.add(parts[1], 1)
    model.add(parts[2].union(parts[0].limit(20)), 2)  # brings old events again
    older = t["overrides"].limit(5).withColumns({"corrected_at": F.col("corrected_at") - F.expr("INTERVAL 9 DAY"), "event_type": F.lit("offer")})
    model.correct(t["overrides"].filter(~some).unionByName(older), 1)
    eff = ev.effective_events(t["events"], t["messages"], t["classifications"], t["overrides"])
    want = ev.read_model(t["applications"], eff, now(), GHOST_DAYS)
    got = model.applications(t["applications"], now(), GHOST_DAYS)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert sum(r.event_count for r in got.collect()) == t["events"].count()


def test_following_a_folder_reads_each_file_once(spark, tmp_path):
    t, model = log(spark, DATA), ReadModel(spark, str(tmp_path / "model"), buckets=2)
    told = told_of(t).filter("application_id < '2'")
    told.coalesce(1).write.parquet(str(tmp_path / "inbox"))
    follow(model, str(tmp_path / "inbox"))
    follow(model, str(tmp_path / "inbox"))
    assert model.parts.read().agg(F.sum("event_count")).first()[0] == told.count() and len(model.parts.versions()) == 1


def test_linking_batches_gives_the_links_of_a_full_recompute(spark, tmp_path):
    """Ten batches in which a quarter of the messages come late, with a restart after the sixth."""
    rng = random.Random(21)
    found = busy(rng, 200)
    m, c = frames(spark, found)
    rows = linkable(m, c).toPandas().sort_values(["at", "message_id"]).reset_index(drop=True)
    batch = [min(9, i * 10 // len(rows)) if rng.random() < 0.75 else rng.randrange(10) for i in range(len(rows))]
    stream = LinkStream(spark, str(tmp_path / "links"), NOW, buckets=2)
    for n in range(10):
        part = rows[[b == n for b in batch]]
        spark.createDataFrame(part.astype(object).where(pd.notna(part), None).to_dict("records"), "message_id string, thread_id string, at long, company string, company_key string, role string, words array<string>, location string, ats string").coalesce(1).write.mode("append").parquet(str(tmp_path / "inbox"))
        if n in (5, 9):
            LinkStream(spark, str(tmp_path / "links"), NOW, buckets=2).follow(str(tmp_path / "inbox"), most=1)
    want = by_plain_fold(spark, found, c)
    apps = stream.apps.read()
    got = {r[0]: tuple(r)[1:] for r in stream.links.read().join(apps, "application_id").select("message_id", "application_id", "created", "company", "company_key", "role", "location", "ats").collect()}
    assert got == {k: v for k, v in want.items() if v[0] is not None}
    assert apps.count() == len({v[0] for v in got.values()})  # applications that no link names are gone
    full = linking.link(m, c, NOW, segment=25)
    assert {r.message_id: r.application_id for r in full.collect() if r.application_id} == {k: v[0] for k, v in got.items()}


def test_timers_tell_who_is_silent_at_several_clocks(spark, tmp_path):
    from datetime import datetime

    from ledgerline.streaming.silence import SilenceStream

    d = lambda day, hour=0: datetime(2024, 1, day, hour)
    events = [("a", 1, "interview", d(1)), ("b", 2, "application_received", d(2)), ("b", 3, "rejection", d(3)), ("c", 4, "interview", d(4)), ("a", 5, "assessment", d(14)), ("c", 6, "offer", d(16)), ("d", 7, "unknown", d(16, 5))]
    clocks = [d(5), d(11, 1), d(12), d(15), d(20), d(26, 5), d(28)]
    stream = SilenceStream(spark, str(tmp_path / "silence"), ghost_days=7, buckets=2)
    done = 0
    for clock in clocks:
        now_heard = [e for e in events[done:] if e[3] <= clock]
        done += len(now_heard)
        # the tick comes a millisecond behind the clock, as a timer fires once the watermark has passed it
        tick = (None, -1, "unknown", clock.replace(microsecond=1000))
        for part in ([now_heard] if now_heard else []) + [[tick]]:
            spark.createDataFrame(part, "application_id string, event_id long, event_type string, occurred_at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "inbox"))
            stream.follow(str(tmp_path / "inbox"))
        last, terminal = {}, set()
        for app, _, kind, at in events[:done]:
            last[app] = max(at, last.get(app, at))
            terminal |= {app} if kind in ("rejection", "offer", "withdrawn") else set()
        want = {(a, at) for a, at in last.items() if a not in terminal and (clock - at).total_seconds() > 7 * 86400}
        assert {tuple(r) for r in stream.ghosted().collect()} == want, clock


def test_many_silent_applications_are_few_groups_of_state(spark, tmp_path):
    """A group costs milliseconds a batch, so applications share one; all are told by its one timer, whatever their own times."""
    from ledgerline.streaming.silence import SilenceStream

    at = F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 60)
    events = spark.range(400).select(F.concat(F.lit("a"), "id").alias("application_id"), F.col("id").alias("event_id"), F.lit("interview").alias("event_type"), at.alias("occurred_at"))
    tick = lambda day: spark.sql(f"SELECT string(null) AS application_id, bigint(-1) AS event_id, 'unknown' AS event_type, timestamp'2024-01-{day}' AS occurred_at")
    stream = SilenceStream(spark, str(tmp_path / "silence"), ghost_days=7, buckets=2, shards=4)
    for part, silent in ((events, 0), (tick("08 03:00:00"), 180), (tick("20 00:00:00"), 400)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "inbox"))
        query = stream.follow(str(tmp_path / "inbox"))
        assert stream.ghosted().count() == silent
        assert all(x.stateOperators[0].numRowsTotal <= 3 * 5 for x in query.recentProgress)


def test_many_threads_are_few_groups_of_state(spark, tmp_path):
    """A group, and each read and write of its state, costs milliseconds a batch: threads share groups and entries share packs."""
    m = spark.range(600).select(F.concat(F.lit("m"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("message_id"), F.concat(F.lit("t"), F.col("id") % 300).alias("thread_id"), F.timestamp_seconds(F.col("id") + 1704067200).alias("received_at"))
    company = F.concat(F.lit("c"), F.substring("message_id", 5, 1))
    none = F.lit(None).cast("string")
    c = m.select("message_id", F.lit("interview").alias("event_type"), company.alias("company"), company.alias("company_key"), none.alias("role"), none.alias("location"), none.alias("ats"))
    linkable(m, c).coalesce(1).write.parquet(str(tmp_path / "inbox"))
    stream = LinkStream(spark, str(tmp_path / "links"), NOW, buckets=2, shards=4)
    query = stream.follow(str(tmp_path / "inbox"))
    assert stream.links.read().count() == 600 and stream.apps.read().count() == 300  # none is in the window
    assert all(x.numRowsTotal <= 4 * 10 for p in query.recentProgress for x in p.stateOperators)
