from pyspark.sql import functions as F

from ledgerline.operators import overrides as ov
from ledgerline.operators.candidates import CandidateIndex
from ledgerline.plans.standins import log

DATA = "/root/testdata/sf0.001"


def test_the_index_gives_what_the_joins_give(spark, tmp_path):
    t, index = log(spark, DATA), CandidateIndex(spark, str(tmp_path / "index"), shards=3, buckets=4)
    one = F.pmod(F.xxhash64("event_id"), F.lit(2)) == 0
    probes = spark.createDataFrame([(1, "company 1", "t5"), (2, None, "t7"), (3, "company 2", None), (4, "nobody", "none"), (5, None, None)], "probe_id long, company_key string, thread_id string")
    for n, some in enumerate((t["events"].filter(one), t["events"].filter(~one))):
        apps = t["applications"].join(some.select("application_id"), "application_id", "left_semi")
        index.add(apps, some, t["messages"], n)
        index.add(apps, some, t["messages"], n)
        seen = t["events"].filter(one) if n == 0 else t["events"]
        known = t["applications"].join(seen.select("application_id"), "application_id", "left_semi")
        want = ov.candidates(known, seen, t["messages"], probes)
        assert sorted(map(tuple, index.search(probes).collect())) == sorted(map(tuple, want.collect())) != []


def test_a_hot_token_lies_in_several_shards(spark, tmp_path):
    index = CandidateIndex(spark, str(tmp_path / "index"), shards=8, buckets=4)
    apps = spark.range(400).select(F.concat(F.lit("a"), "id").alias("application_id"), F.lit("all").alias("company_key"))
    events = apps.select("application_id", F.lit("m").alias("message_id"), F.lit("2024-01-01").cast("timestamp").alias("occurred_at"))
    index.add(apps, events, spark.createDataFrame([("m", "t")], "message_id string, thread_id string"), 0)
    shards = index.postings.read().filter("kind = 'key'").groupBy("shard").count().collect()
    assert len(shards) == 8 and max(r["count"] for r in shards) < 100


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_are_told_once_without_making_them_distinct(spark, tmp_path):
    """Probes of several rows, applications of several keys and threads: each pair once, and nothing is aggregated behind the join with probes."""
    app, stamp = "application_id string", F.lit("2024-01-01").cast("timestamp").alias("occurred_at")
    apps = spark.createDataFrame([("a", "k1"), ("a", "k2"), ("b", "k2"), ("c", None)], f"{app}, company_key string")
    linked = [("a", "m1"), ("a", "m2"), ("b", "m2"), ("c", "m3"), ("c", "m4"), ("d", "m4"), ("e", "gone")]
    events = spark.createDataFrame(linked, f"{app}, message_id string").select("*", stamp)
    messages = spark.createDataFrame([("m1", "t1"), ("m2", "t2"), ("m3", "t3"), ("m4", "t4"), ("m5", None)], "message_id string, thread_id string")
    probes = spark.createDataFrame([(1, "k1", "t1"), (1, "k2", "t2"), (2, None, "t2"), (2, None, "t1"), (3, "k2", "t4"), (4, None, None)], "probe_id long, company_key string, thread_id string")
    want = sorted([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (3, "b"), (3, "c"), (3, "d")])
    index = CandidateIndex(spark, str(tmp_path / "index"), shards=3, buckets=4)
    index.add(apps, events, messages, 0)
    for found in (ov.candidates(apps, events, messages, probes), index.search(probes)):
        assert sorted((r.probe_id, r.application_id) for r in found.collect()) == want
        plan = plan_of(found)
        assert "Aggregate" not in plan[: plan.index("Join")] and "Repartition" not in plan
