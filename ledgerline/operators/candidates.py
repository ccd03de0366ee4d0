"""The candidate search from a persisted index: which applications have a company key or a thread, extended batch by batch.

A posting says that an application has a token, a company key or a thread. A token that many applications have would make one bucket and
one join partition large, so its postings are dealt to shards by application, and a search asks each shard. What changes with every event, when an application was
last active, is kept apart, by application.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.components import written
from ledgerline.operators.overrides import asked_of, pairs_of, small
from ledgerline.sources.keyed import KeyedTable

SHARDS = 8
POSTING = "kind string, token string, shard int, application_id string"


class CandidateIndex:
    def __init__(self, spark: SparkSession, path: str, shards: int = SHARDS, buckets: int = 16) -> None:
        self.spark, self.shards = spark, shards
        self.postings = KeyedTable(spark, f"{path}/postings", POSTING, ["kind", "token", "shard", "application_id"], buckets, by=["kind", "token", "shard"])
        self.active = KeyedTable(spark, f"{path}/active", "application_id string, last_event_at timestamp", ["application_id"], buckets)

    def add(self, applications: DataFrame, events: DataFrame, messages: DataFrame, number: int) -> None:
        """Index a batch: its applications' keys, the threads of its events, and when they were active. A batch may be added again."""
        shard = F.pmod(F.xxhash64("application_id"), F.lit(self.shards)).cast("int").alias("shard")
        linked = events.filter("application_id IS NOT NULL")
        keys = applications.filter("company_key IS NOT NULL").select(F.lit("key").alias("kind"), F.col("company_key").alias("token"), shard, "application_id")
        threads = linked.join(messages.select("message_id", "thread_id"), "message_id").filter("thread_id IS NOT NULL").select(F.lit("thread").alias("kind"), F.col("thread_id").alias("token"), shard, "application_id")
        self.postings.insert_new(keys.unionByName(threads).distinct(), name="batch", number=number)
        last = linked.groupBy("application_id").agg(F.max("occurred_at").alias("last_event_at"))
        self.active.change(last, lambda held: held.unionByName(last).groupBy("application_id").agg(F.max("last_event_at").alias("last_event_at")), "batch", number)

    def search(self, probes: DataFrame) -> DataFrame:
        """(probe_id, application_id, last_event_at): applications with events that share the company key or the thread of probes(probe_id, company_key, thread_id)."""
        asked = asked_of(probes)
        tokens = asked.select("kind", "token").distinct()
        sharded = tokens.select("*", F.explode(F.sequence(F.lit(0), F.lit(self.shards - 1))).alias("shard"))
        found = self.postings.read_buckets(sharded).join(small(written(tokens, "tokens")), ["kind", "token"], "left_semi")
        # what is found is put together by application, before it is told to each probe that asks
        of = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.col("token")))
        apps = found.groupBy("application_id").agg(of("key").alias("keys"), of("thread").alias("threads"))
        return pairs_of(apps.join(self.active.read(), "application_id"), asked)
