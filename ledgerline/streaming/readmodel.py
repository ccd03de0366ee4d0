"""The read model kept up to date: what each application's events add up to is merged batch by batch.

Three keyed tables hold the state: the events as they count (by application), the parts of each application, and the latest correction of each message.
A batch of new events touches the buckets of its applications only; its parts are merged into theirs, without reading events. A correction changes events that have been
counted, and a least or greatest value can't be taken back: the applications of corrected messages are added up again from their own events, no others.

Every change carries its batch's number, and the parts are changed last: a batch that dies in between is done again without counting anything twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerline.operators import events as ev
from ledgerline.operators.overrides import latest_by
from ledgerline.schemas import EVENT, OVERRIDE
from ledgerline.sources.keyed import KeyedTable

#: An event with what is told of its message.
TOLD = f"{EVENT}, thread_id string, subject string, from_email string, confidence double, flagged boolean"


class ReadModel:
    """State under path; messages and classifications tell of a batch's events what effective_events needs."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16) -> None:
        self.spark, self.path = spark, path
        self.events = KeyedTable(spark, f"{path}/events", f"{TOLD}, batch long", ["application_id", "event_id"], buckets, by=["application_id"])
        self.parts = KeyedTable(spark, f"{path}/parts", ev.PARTIAL, ["application_id"], buckets)
        self.overrides = KeyedTable(spark, f"{path}/overrides", OVERRIDE, ["message_id"], buckets)

    def _effective(self, told: DataFrame, overrides: DataFrame) -> DataFrame:
        messages = told.select("message_id", "thread_id", "subject", "from_email")
        classifications = told.filter("flagged IS NOT NULL").select("message_id", "confidence", F.col("flagged").alias("needs_review"))
        return ev.effective_events(told.select(*[x.split()[0] for x in EVENT.split(", ")]), messages.dropDuplicates(["message_id"]), classifications.dropDuplicates(["message_id"]), overrides)

    def add(self, told: DataFrame, number: int) -> None:
        """Count a batch of linked events (by TOLD), each once: events that the log has from another batch are left out."""
        told = told.filter("application_id IS NOT NULL")
        self.events.insert_new(told.withColumn("batch", F.lit(number).cast("long")), F.col("occurred_at"), name="events", number=number)
        if self.parts.seen("events") < number:
            fresh = self.events.read_buckets(told).filter(F.col("batch") == number)
            new = ev.partials(self._effective(fresh, self.overrides.read()))
            self.parts.change(new, lambda held: ev.merged(held.unionByName(new)), "events", number)

    def _recount(self, told: DataFrame, name: str, number: int) -> None:
        new = ev.partials(self._effective(told, self.overrides.read()))
        self.parts.upsert(new, name=name, number=number)

    def correct(self, overrides: DataFrame, number: int) -> None:
        """Take a batch of corrections; the applications of their messages are added up again."""
        asked = overrides.select("message_id").distinct()
        touched = self.events.read().join(asked, "message_id", "left_semi").select("application_id").distinct()
        latest = latest_by(overrides.unionByName(self.overrides.read_buckets(asked).join(asked, "message_id", "left_semi")), ["message_id"], F.col("corrected_at"))
        self.overrides.upsert(latest, name="overrides", number=number)
        self._recount(self.events.read_buckets(touched).join(touched, "application_id", "left_semi"), "overrides", number)

    def applications(self, applications: DataFrame, now: Column, ghost_days: int = 30) -> DataFrame:
        """The read model, as events.read_model gives it of everything."""
        return ev.with_applications(ev.derived(self.parts.read(), now, ghost_days), applications)


def follow(model: ReadModel, folder: str, most: int | None = None) -> StreamingQuery:
    """Count the event files (Parquet, by TOLD) that folder has and no earlier call has read, at most so many a batch; returns when done."""
    reader = model.spark.readStream.schema(TOLD)
    if most is not None:
        reader = reader.option("maxFilesPerTrigger", most)

    def write(batch: DataFrame, n: int) -> None:
        batch.persist()
        try:
            model.add(batch, n)
        finally:
            batch.unpersist()

    query = reader.parquet(folder).writeStream.foreachBatch(write).option("checkpointLocation", f"{model.path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return query
