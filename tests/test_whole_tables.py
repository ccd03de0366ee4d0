"""Registered queries that take every row of their tables."""

import datetime

from pyspark.sql import functions as F

from ledgerline.plans.catalog import QUERIES

DATA = "/root/testdata/sf0.001"


def test_weekly_and_status_counts_take_every_row(spark):
    orders = spark.read.parquet(f"{DATA}/orders.parquet").count()
    assert sum(r.n for r in QUERIES["weekly_counts"](spark, DATA).collect()) == orders
    counts = QUERIES["status_counts_zero_fill"](spark, DATA).collect()
    assert len(counts) == 7 and sum(r.n for r in counts) == QUERIES["app_status"](spark, DATA).count()


def test_weekly_counts_fill_gaps(spark, tmp_path):
    days = [(1, datetime.date(2024, 1, 3)), (2, datetime.date(2024, 1, 23)), (3, None)]
    df = spark.createDataFrame(days, "o_orderkey long, day date").select("o_orderkey", F.col("day").cast("timestamp_ntz").alias("o_orderdate"))
    df.write.parquet(str(tmp_path / "orders.parquet"))
    got = [(r.period, r.n) for r in QUERIES["weekly_counts"](spark, str(tmp_path)).collect()]
    assert got == [("2024-01-07", 1), ("2024-01-14", 0), ("2024-01-21", 0), ("2024-01-28", 1)]


def test_every_key_and_thread_is_searched(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "user_id").collect()
    first = {}
    for r in sorted(events):
        first.setdefault((r.user_id % 40, r.event_id % 97), r.event_id)
    found = {r.probe_id for r in QUERIES["candidate_search"](spark, DATA).select("probe_id").distinct().collect()}
    assert found == set(first.values())
