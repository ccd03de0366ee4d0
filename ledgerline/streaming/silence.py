"""Silence as a stream: an application that hears nothing for so many days after an event that isn't terminal turns ghosted, by a timer of event time.

Each event sets anew when its application is due. When the watermark passes that time the application is told ghosted; an event after that tells that it was heard of. A
tick, an event without an application, moves the clock on where no mail does. Events that come late, but not behind the watermark, count in their place.

A call of a stateful processor costs milliseconds, however few rows it has, so applications are dealt to shards: a shard holds its applications' state as one value and
one timer, that of the application that is due first, and tells all that are due when it fires.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ledgerline.operators.events import DAY_US
from ledgerline.schemas import TERMINAL_TYPES
from ledgerline.sources.keyed import KeyedTable
from ledgerline.streaming.linked import ROCKS

ROW = "application_id string, event_id long, event_type string, occurred_at timestamp"
TOLD = "application_id string, ghosted boolean, last_event_at timestamp"


#: Applications are dealt to so many shards; a batch reads and writes the state of those that it touches.
SHARDS = 256


class Silence(StatefulProcessor):
    """The applications of a shard: {application_id: (last, terminal, ghosted)}."""

    def __init__(self, ghost_days: int) -> None:
        self.days = ghost_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "applications binary")

    def _due(self, last: int) -> int:
        """The first millisecond at which the silence is longer than so many days."""
        return (last + self.days * DAY_US) // 1000 + 1

    def _held(self) -> dict[str, tuple[int, bool, bool]]:
        return pickle.loads(bytes(self.state.get()[0])) if self.state.exists() else {}

    def _hold(self, apps: dict[str, tuple[int, bool, bool]]) -> None:
        """Keep the state, and a timer for the application that is due first."""
        self.state.update((pickle.dumps(apps, pickle.HIGHEST_PROTOCOL),))
        first = min((last for last, terminal, ghosted in apps.values() if not terminal and not ghosted), default=None)
        due, timers = None if first is None else self._due(first), list(self.handle.listTimers())
        for timer in timers:
            if timer != due:
                self.handle.deleteTimer(timer)
        if due is not None and due not in timers:
            self.handle.registerTimer(due)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        apps, heard = self._held(), {}
        came: dict[str, tuple[int, bool]] = {}
        for part in rows:
            for app, kind, at in zip(part["application_id"].tolist(), part["event_type"].tolist(), part["at"].tolist()):
                last, terminal = came.get(app, (at, False))
                came[app] = (max(last, at), terminal or kind in TERMINAL_TYPES)
        came.pop("", None)  # a tick
        for app, (at, ended) in came.items():
            before, terminal, ghosted = apps.get(app, (at, False, False))
            last, terminal = max(before, at), terminal or ended
            if ghosted and (terminal or last != before):
                ghosted, heard[app] = False, last
            apps[app] = (last, terminal, ghosted)
        if came:
            self._hold(apps)
        yield _told(heard, False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        apps, clock = self._held(), timerValues.getCurrentWatermarkInMs()
        silent = {app: last for app, (last, terminal, ghosted) in apps.items() if not terminal and not ghosted and self._due(last) < clock}
        self._hold(apps | {app: (last, False, True) for app, last in silent.items()})
        yield _told(silent, True)

    def close(self) -> None:
        pass


def _told(apps: dict[str, int], ghosted: bool) -> pd.DataFrame:
    return pd.DataFrame({"application_id": pd.Series(list(apps), dtype=object), "ghosted": pd.Series([ghosted] * len(apps), dtype=bool), "last_event_at": pd.to_datetime(pd.Series(list(apps.values()), dtype="int64"), unit="us")})


class SilenceStream:
    """Who is ghosted, under path, from Parquet files of effective events (ROW) and ticks."""

    def __init__(self, spark: SparkSession, path: str, ghost_days: int = 30, late: str = "0 seconds", buckets: int = 16, shards: int = SHARDS) -> None:
        self.path, self.days, self.late, self.shards = path, ghost_days, late, shards
        self.spark = spark.newSession()
        for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
            self.spark.conf.set(name, spark.conf.get(name))
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
        self.told = KeyedTable(spark, f"{path}/told", TOLD, ["application_id"], buckets)

    def _write(self, batch: DataFrame, n: int) -> None:
        # of one batch an application may be heard of and turn ghosted again: the later last event, then the ghosting, is how it ends
        self.told.upsert(batch, F.col("last_event_at"), F.col("ghosted"), name="told", number=n)

    def follow(self, folder: str, most: int | None = None) -> StreamingQuery:
        reader = self.spark.readStream.schema(ROW)
        if most is not None:
            reader = reader.option("maxFilesPerTrigger", most)
        rows = reader.parquet(folder).withWatermark("occurred_at", self.late).filter("application_id IS NOT NULL OR event_id = -1")
        rows = rows.select(F.coalesce("application_id", F.lit("")).alias("application_id"), "event_type", F.unix_micros("occurred_at").alias("at"), "occurred_at")
        rows = rows.withColumn("shard", F.pmod(F.xxhash64("application_id"), F.lit(self.shards)).cast("int"))
        told = rows.groupBy("shard").transformWithStateInPandas(statefulProcessor=Silence(self.days), outputStructType=TOLD, outputMode="Append", timeMode="EventTime")
        query = told.writeStream.foreachBatch(self._write).outputMode("append").option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        return query

    def ghosted(self) -> DataFrame:
        """(application_id, last_event_at) of applications that are silent."""
        return self.told.read().filter("ghosted").select("application_id", "last_event_at")
