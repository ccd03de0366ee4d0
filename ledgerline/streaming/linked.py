"""Linking as a stream with state: a batch steps on from where the companies that it touches stood.

Two stateful steps follow each other. The first keeps each thread's first linkable message, which tells the company that the thread belongs to, and
sends the thread's messages there; if an earlier message turns up later, it takes them back from the company that had them. The second keeps for each company its
ledger (operators/linking.py) and its messages. Messages behind all that it has seen step the ledger on. One that comes late, or is taken back, has the
company folded again from its messages, and only links that differ are told. State lives in RocksDB under the checkpoint; a batch reads and writes
that of its own companies and shards of threads. A call of a stateful processor and each of its reads and writes cost milliseconds, so threads share shards, and
state is kept in packs of many entries: messages, links and threads are appended, what changes (first messages of threads, applications) is written anew.

Links and applications are kept in keyed tables, changed under the batch's number: after any failure the stream goes on from its checkpoint and the result is
that of a full recompute over all messages. The input must hold each message once (as streaming/incremental.py stores them).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from datetime import datetime
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ledgerline.functions.text import link_tokens
from ledgerline.operators.linking import WINDOW_DAYS, App, Ledger, _records, floor_of
from ledgerline.sources.keyed import KeyedTable

ROW = "message_id string, thread_id string, at long, company string, company_key string, role string, words array<string>, location string, ats string"
_ROUTED = f"home string, back boolean, {ROW}"
_APP = "company string, company_key string, role string, location string, ats string"
_TOLD = f"kind string, message_id string, created boolean, application_id string, {_APP}"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Threads are dealt to so many shards.
SHARDS = 256
#: Most entries of a pack of state, and most rows of a frame.
PACK = 10_000


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


_ROW = _names(ROW)
_AT, _ID, _THREAD, _KEY = (_ROW.index(x) for x in ("at", "message_id", "thread_id", "company_key"))


def _frames(rows: list[tuple], schema: str) -> Iterator[pd.DataFrame]:
    """rows as frames of schema, a frame without rows for none."""
    names = _names(schema)
    for at in range(0, max(len(rows), 1), PACK):
        columns = list(zip(*rows[at : at + PACK])) or [()] * len(names)
        yield pd.DataFrame({x: pd.Series(list(c), dtype=object) for x, c in zip(names, columns)})


def _place(row: tuple) -> tuple[bool, int, str]:
    return (row[_AT] is None, row[_AT] or 0, row[_ID])


def _arrived(parts: Iterator[pd.DataFrame]) -> list[tuple]:
    """(*ROW, back) of each row that came; back is false where the frame doesn't tell."""
    return [(*(r[x] for x in _ROW), bool(r.get("back"))) for part in parts for r in _records(part)]


def _append(state: Any, entries: list[tuple]) -> None:
    if entries:
        state.appendList([(pickle.dumps(entries[at : at + PACK], pickle.HIGHEST_PROTOCOL),) for at in range(0, len(entries), PACK)])


def _entries(state: Any) -> Iterator[tuple]:
    for (pack,) in state.get() if state.exists() else ():
        yield from pickle.loads(bytes(pack))


def _value(state: Any) -> dict:
    return pickle.loads(bytes(state.get()[0])) if state.exists() else {}


def _update(state: Any, value: dict) -> None:
    state.update((pickle.dumps(value, pickle.HIGHEST_PROTOCOL),))


class ThreadHomes(StatefulProcessor):
    """Sends each message of a shard's threads to the company of its thread's first message."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "threads binary")  # {thread: (place of its first message, home)}
        self.members = handle.getListState("members", "pack binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [r[:-1] for r in sorted(_arrived(rows), key=_place)]
        held, moved = _value(self.first), {}
        firsts: dict[str | None, tuple] = {}
        for r in new:
            firsts.setdefault(r[_THREAD], (_place(r), r[_KEY]))
        for thread, first in firsts.items():
            before = held.get(thread)
            if before is None or first[0] < before[0]:
                if before is not None and before[1] != first[1]:
                    moved[thread] = before[1]
                held[thread] = first
        out = []
        if moved:
            old = [r for r in _entries(self.members) if r[_THREAD] in moved]
            out = [(moved[r[_THREAD]], True, *r) for r in old] + [(held[r[_THREAD]][1], False, *r) for r in old]
        _update(self.first, held)
        _append(self.members, new)
        yield from _frames(out + [(held[r[_THREAD]][1], False, *r) for r in new], _ROUTED)

    def close(self) -> None:
        pass


class CompanyLinks(StatefulProcessor):
    """Links a company's messages; tells links that are new or changed, and applications as they are now."""

    def __init__(self, floor: int) -> None:
        self.floor = floor

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.end = handle.getValueState("end", "timeless boolean, at long, message_id string")
        self.log = handle.getListState("log", "pack binary")  # (row, application_id, created)
        self.apps = handle.getValueState("apps", "applications binary")
        self.threads = handle.getListState("threads", "pack binary")  # (thread, application_id)

    def _ledger(self) -> Ledger:
        ledger = Ledger(self.floor)
        for app in _value(self.apps).values():
            ledger.admit(App(*app))
        ledger.threads.update(_entries(self.threads))
        return ledger

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        arrived = _arrived(rows)
        new, back = sorted((r[:-1] for r in arrived if not r[-1]), key=_place), {r[_ID] for r in arrived if r[-1]}
        before: dict[str, tuple[str, bool]] = {}
        gone: set[str] = set()
        if not back and (not self.end.exists() or _place(new[0]) > tuple(self.end.get())):
            ledger = self._ledger()
        else:  # from the beginning
            held = []
            for row, i, created in _entries(self.log):
                before[row[_ID]] = (i, created)
                gone.add(i)
                if row[_ID] not in back:
                    held.append(row)
            new = sorted(held + new, key=_place)
            for state in (self.log, self.apps, self.threads):
                state.clear()
            ledger = Ledger(self.floor)
        told, touched, entries, threads, known = [], {}, [], [], set(ledger.threads)
        nothing = (None,) * len(_names(_APP))
        for fields, app, created in ledger.run(dict(zip(_ROW, r)) for r in new):
            row = tuple(fields[x] for x in _ROW)
            touched[app.application_id] = app
            entries.append((row, app.application_id, created))
            if before.get(row[_ID]) != (app.application_id, created):
                told.append(("link", row[_ID], created, app.application_id, *nothing))
            if row[_THREAD] not in known:
                known.add(row[_THREAD])
                threads.append((row[_THREAD], app.application_id))
        _append(self.log, entries)
        _append(self.threads, threads)
        if touched:
            _update(self.apps, {i: (a.application_id, a.company, a.company_key, a.role, a.words, a.location, a.ats, a.last) for i, a in ledger.apps.items()})
        told += [("app", None, None, i, *(getattr(a, x) for x in _names(_APP))) for i, a in touched.items()]
        told += [("gone", None, None, i, *nothing) for i in gone - touched.keys()]
        if new:
            self.end.update(_place(new[-1]))
        else:
            self.end.clear()
        yield from _frames(told, _TOLD)

    def close(self) -> None:
        pass


def linkable(messages: DataFrame, classifications: DataFrame) -> DataFrame:
    """The messages that can be linked, by ROW."""
    rows = messages.select("message_id", "thread_id", F.unix_micros("received_at").alias("at")).join(classifications.filter("event_type <> 'unknown' AND company_key IS NOT NULL"), "message_id")
    return rows.withColumn("words", link_tokens(F.col("role"))).select(*_names(ROW))


class LinkStream:
    """Links and applications under path, fed by Parquet files of linkable messages; now bounds the window, as for link."""

    def __init__(self, spark: SparkSession, path: str, now: datetime, window_days: int = WINDOW_DAYS, buckets: int = 16, shards: int = SHARDS) -> None:
        self.shards, self.path, self.floor = shards, path, floor_of(pd.Timestamp(now).to_pydatetime(), window_days)
        self.spark = spark.newSession()  # state in RocksDB, without a change to the caller's session
        for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
            self.spark.conf.set(name, spark.conf.get(name))
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
        self.links = KeyedTable(spark, f"{path}/links", "message_id string, application_id string, created boolean", ["message_id"], buckets)
        self.apps = KeyedTable(spark, f"{path}/applications", f"application_id string, {_APP}", ["application_id"], buckets)

    def _write(self, batch: DataFrame, n: int) -> None:
        batch.persist()
        try:
            self.links.upsert(_of(self.links, batch.filter("kind = 'link'")), name="links", number=n)
            apps = batch.filter("kind <> 'link'").groupBy("application_id").agg(F.max_by(F.struct("kind", *_names(_APP)), F.col("kind") == "app").alias("a")).select("application_id", "a.*")
            kept = _of(self.apps, apps.filter("kind = 'app'"))
            self.apps.change(apps, lambda held: held.join(apps.select("application_id"), "application_id", "left_anti").unionByName(kept), name="links", number=n)
        finally:
            batch.unpersist()

    def follow(self, folder: str, most: int | None = None) -> StreamingQuery:
        """Link what folder has and no earlier call has read, at most so many files a batch; returns when done."""
        reader = self.spark.readStream.schema(ROW)
        if most is not None:
            reader = reader.option("maxFilesPerTrigger", most)
        rows = reader.parquet(folder).withColumn("shard", F.pmod(F.xxhash64("thread_id"), F.lit(self.shards)).cast("int"))
        homes = rows.groupBy("shard").transformWithStateInPandas(statefulProcessor=ThreadHomes(), outputStructType=_ROUTED, outputMode="Append", timeMode="None")
        told = homes.groupBy("home").transformWithStateInPandas(statefulProcessor=CompanyLinks(self.floor), outputStructType=_TOLD, outputMode="Append", timeMode="None")
        query = told.writeStream.foreachBatch(self._write).outputMode("append").option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        return query


def _of(table: KeyedTable, rows: DataFrame) -> DataFrame:
    return rows.select(*table.columns)
