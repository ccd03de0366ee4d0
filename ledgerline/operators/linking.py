"""Linking messages to applications: an ordered fold, run separately for each company.

Rules, for each message from the oldest on: unknown type or no company key, no link; an application on the same
thread, the latest active; else one of the same company within the window whose role is similar (the best,
then the latest); else one of the same company where either role is missing (the latest); else a new application.
A match fills in missing fields of its application, which can change later matches.

A thread's first linkable message finds or makes an application of its own company, and every later one follows it there by
the thread, whatever company it names. So a thread belongs to the company of its first linkable message, no rule
reaches across companies, and each company is folded by itself; threads of several companies don't tie these together.

A company of many messages is folded in segments of time. What a segment hands on is a Ledger: the applications that later messages can
still reach (active within the window, or with a thread that goes on) and those threads. So no task holds more than a segment's
messages and that summary, whatever a company's size, and a task that is lost repeats one segment. The same Ledger is the
state of the linking stream (streaming/linked.py).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import company_key, link_tokens, strip_accents
from ledgerline.operators.components import in_order, written
from ledgerline.schemas import EVENT_TYPES, checked_enum

WINDOW_DAYS = 180
#: Least Dice similarity of two roles' words, as a fraction.
SIMILAR = 0.75
#: Messages of one company that one task folds at a time.
SEGMENT = 100_000

LINK = "message_id string, application_id string, created boolean, company string, company_key string, role string, location string, ats string"
ROW = ["message_id", "thread_id", "at", "company", "company_key", "role", "words", "location", "ats"]
_APP = "application_id string, company string, company_key string, role string, words array<string>, location string, ats string, last long"
#: What a task of the segmented fold gives: links, applications as they are after the segment, and threads that go on.
_PIECE = f"home string, kind string, segment long, message_id string, thread_id string, created boolean, near boolean, {_APP}"


def new_id(company_key: str, role: str | None, seed: str) -> str:
    return "app_" + hashlib.sha256("\x1f".join([company_key, role or "", seed]).encode()).hexdigest()[:16]


def floor_of(now: datetime, window_days: int = WINDOW_DAYS) -> int:
    """The microsecond from which on an application counts as active within the window that ends at now (UTC unless it says otherwise)."""
    start = (now if now.tzinfo else now.replace(tzinfo=timezone.utc)) - timedelta(days=window_days)
    return (start - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


@dataclass
class App:
    application_id: str
    company: str | None
    company_key: str
    role: str | None
    words: frozenset[str]
    location: str | None
    ats: str | None
    last: int | None  # microseconds of the latest message

    @property
    def place(self) -> tuple[int, str]:
        return (-(1 << 63) if self.last is None else self.last, self.application_id)


@dataclass
class Ledger:
    """The applications of one company and its threads, as messages come in order; floor bounds the window.

    Applications within the window are found by the words of their roles: of those with one set of words only the latest active can be
    chosen, and a set that is similar enough to another shares one of its rarer words, so few sets are compared.
    """

    floor: int
    apps: dict[str, App] = field(default_factory=dict)
    threads: dict[str | None, str] = field(default_factory=dict)
    latest: App | None = None
    unnamed: dict[str, App] = field(default_factory=dict)
    by_words: dict[frozenset[str], App] = field(default_factory=dict)
    by_word: dict[str, set[frozenset[str]]] = field(default_factory=dict)

    def admit(self, app: App) -> None:
        """Add an application, or take note that it was active or got a role."""
        self.apps[app.application_id] = app
        if app.last is None or app.last < self.floor:
            return
        if self.latest is None or app.place >= self.latest.place:
            self.latest = app
        if app.role is None:
            self.unnamed[app.application_id] = app
            return
        self.unnamed.pop(app.application_id, None)
        other = self.by_words.get(app.words)
        if other is None or app.place >= other.place:
            self.by_words[app.words] = app
        if other is None:
            for word in app.words:
                self.by_word.setdefault(word, set()).add(app.words)

    def similar(self, words: frozenset[str]) -> App | None:
        """The best application whose role has a Dice similarity of SIMILAR; of equally good ones the latest active."""
        # sets of a and b words that share s of them reach it only if 2 s >= SIMILAR (a + b), and s <= b: so s >= least, and any
        # a - least + 1 words of one set hold one that both have
        least = -int(-(SIMILAR * len(words) / (2 - SIMILAR)) // 1)
        rare = sorted(words, key=lambda w: (len(self.by_word.get(w, ())), w))[: len(words) - least + 1]
        found = {other for w in rare for other in self.by_word.get(w, ())}
        scored = [(2.0 * len(words & other) / (len(words) + len(other)), self.by_words[other]) for other in found]
        return max(((s, a.place, a) for s, a in scored if s >= SIMILAR), key=lambda x: x[:2], default=(None, None, None))[2]

    def step(self, row: dict[str, Any]) -> tuple[App, bool]:
        """Link one message; its application and whether that is new."""
        words = frozenset(row["words"] or ()) if row["role"] is not None else frozenset()
        app = self.apps.get(self.threads.get(row["thread_id"], ""))
        if app is None:
            app = self.similar(words) if words else None
            if app is None:
                app = self.latest if row["role"] is None else max(self.unnamed.values(), key=lambda a: a.place, default=None)
        created = app is None
        if created:
            app = App(new_id(row["company_key"], row["role"], row["message_id"]), row["company"], row["company_key"], row["role"], words, row["location"], row["ats"], row["at"])
        else:
            if app.role is None and row["role"] is not None:
                app.role, app.words = row["role"], words
            app.location = row["location"] if app.location is None else app.location
            app.ats = row["ats"] if app.ats is None else app.ats
            if row["at"] is not None:
                app.last = row["at"] if app.last is None else max(app.last, row["at"])
        self.admit(app)
        self.threads[row["thread_id"]] = app.application_id
        return app, created

    def run(self, rows: Iterable[dict[str, Any]]) -> Iterator[tuple[dict[str, Any], App, bool]]:
        for row in rows:
            yield row, *self.step(row)


def corrected(classifications: DataFrame, overrides: DataFrame, reapply: bool = False) -> DataFrame:
    """What linking goes by: classifications with the corrections of overrides, one row at most for each message.

    A type of unknown unlinks. A message that links by its own classification keeps its application, so its company and role stay;
    one that doesn't links by the corrected type, company and role. With reapply, as after new rules, corrections always count.
    """
    o = overrides.select("message_id", checked_enum(F.col("event_type"), EVENT_TYPES, "event type").alias("o_type"), F.nullif("company", F.lit("")).alias("o_company"), F.nullif("role", F.lit("")).alias("o_role"))
    rows = classifications.join(o, "message_id", "left")
    own = F.coalesce((F.col("event_type") != "unknown") & F.col("company_key").isNotNull(), F.lit(False))
    use = F.lit(reapply) | ~own
    key = company_key(strip_accents(F.col("o_company")))
    fields = {
        "company_key": F.when(use & F.col("o_company").isNotNull(), key).otherwise(F.col("company_key")),
        "company": F.when(use, F.coalesce("o_company", "company")).otherwise(F.col("company")),
        "role": F.when(use, F.coalesce("o_role", "role")).otherwise(F.col("role")),
        "event_type": F.coalesce("o_type", "event_type"),
    }
    return rows.withColumns(fields).drop("o_type", "o_company", "o_role")


def _records(frame: pd.DataFrame) -> list[dict[str, Any]]:
    """Rows as dictionaries, with None for what is missing and whole numbers for times."""
    out = {}
    for c in frame.columns:
        values = [v.tolist() if isinstance(v, np.ndarray) else v for v in frame[c].tolist()]
        out[c] = [None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else v for v in values]
    if "at" in out:
        out["at"] = [None if v is None else int(v) for v in out["at"]]
    return [dict(zip(out, x)) for x in zip(*out.values())]


def _whole(keyed: DataFrame, floor: int) -> DataFrame:
    """Links of companies that one task may fold at once."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = _records(group.sort_values(["at", "message_id"], na_position="last"))
        found = list(Ledger(floor).run(rows))
        return pd.DataFrame([(r["message_id"], a.application_id, new, a.company, a.company_key, a.role, a.location, a.ats) for r, a, new in found], columns=[x.split()[0] for x in LINK.split(", ")])

    return keyed.groupBy("home").applyInPandas(run, LINK)


def fold_segment(home: str, number: int, rows: list[dict[str, Any]], state: list[dict[str, Any]], floor: int) -> list[dict[str, Any]]:
    """The pieces that a segment gives: a link for each of rows, and what the next segment needs of applications and threads."""
    ledger = Ledger(floor)
    for s in state:
        if s["kind"] == "app":
            ledger.admit(App(s["application_id"], s["company"], s["company_key"], s["role"], frozenset(s["words"] or ()), s["location"], s["ats"], None if s["last"] is None else int(s["last"])))
        else:
            ledger.threads[s["thread_id"]] = s["application_id"]
    out, touched = [], {}
    for row, app, created in ledger.run(rows):
        out.append({"kind": "link", "message_id": row["message_id"], "application_id": app.application_id, "created": created})
        touched[app.application_id] = app
        if row["final"]:
            del ledger.threads[row["thread_id"]]
    on = set(ledger.threads.values())
    for app in ledger.apps.values():
        near = app.application_id in on or (app.last is not None and app.last >= floor)
        if near or app.application_id in touched:
            out.append({"kind": "app", "near": near} | {k: getattr(app, k) for k in ("application_id", "company", "company_key", "role", "location", "ats", "last")} | {"words": sorted(app.words)})
    out += [{"kind": "thread", "thread_id": t, "application_id": a} for t, a in ledger.threads.items()]
    return [{"home": home, "segment": number} | x for x in out]


def _segmented(keyed: DataFrame, starts: DataFrame, floor: int, segment: int) -> DataFrame:
    """Links of large companies, a segment of each at a time; keyed has the rows' places in the order of (home, at, message_id)."""
    rows = written(keyed.join(starts, "home").withColumn("segment", F.floor((F.col("place") - F.col("start")) / segment)).drop("place", "start"), "segments")
    names = [x.split()[0] for x in _PIECE.split(", ")]

    def run(key, now: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        if now.empty:  # the company had its last segment
            return pd.DataFrame(columns=names)
        found = fold_segment(key[0], int(now["segment"].iloc[0]), _records(now.sort_values(["at", "message_id"], na_position="last")), _records(before), floor)
        return pd.DataFrame({x: pd.Series([piece.get(x) for piece in found], dtype=object) for x in names})

    pieces, state = [], rows.sparkSession.createDataFrame([], _PIECE)
    for number in range((rows.agg(F.max("segment")).first()[0] or 0) + 1):
        some = rows.filter(F.col("segment") == number)
        done = written(some.groupBy("home").cogroup(state.groupBy("home")).applyInPandas(run, _PIECE), "segment")
        pieces.append(done)
        state = done.filter("kind = 'thread' OR (kind = 'app' AND near)")
    found = pieces[0]
    for x in pieces[1:]:
        found = found.unionByName(x)
    fields = ("company", "company_key", "role", "location", "ats")
    final = found.filter("kind = 'app'").groupBy("application_id").agg(F.max_by(F.struct(*fields), "segment").alias("app"))
    return found.filter("kind = 'link'").select("message_id", "application_id", "created").join(final, "application_id").select("message_id", "application_id", "created", *[f"app.{x}" for x in fields])


def link(messages: DataFrame, classifications: DataFrame, now, window_days: int = WINDOW_DAYS, overrides: DataFrame | None = None, reapply: bool = False, segment: int = SEGMENT) -> DataFrame:
    """(message_id, application_id, created, and the application's fields) for each message; now bounds the window. Companies of more
    than segment messages are folded in segments. A message without a time comes last, and its application is in no window."""
    found = classifications if overrides is None else corrected(classifications, overrides, reapply)
    rows = messages.select("message_id", "thread_id", F.unix_micros("received_at").alias("at")).join(found.select("message_id", "event_type", "company", "company_key", "role", "location", "ats"), "message_id")
    rows = rows.withColumn("words", link_tokens(F.col("role")))
    linkable = rows.filter("event_type <> 'unknown' AND company_key IS NOT NULL")
    place = F.struct(F.col("at").isNull(), "at", "message_id")
    homes = linkable.groupBy(F.col("thread_id").alias("thread")).agg(F.min_by("company_key", place).alias("home"), F.max(place).alias("end"))
    keyed = linkable.join(homes, F.col("thread_id").eqNullSafe(F.col("thread"))).select("home", *ROW, F.equal_null(place, F.col("end")).alias("final"))
    keyed = written(keyed, "linkable")
    sizes = keyed.groupBy("home").count()
    large = written(sizes.filter(F.col("count") > segment).select("home"), "large-companies")
    floor = floor_of(pd.Timestamp(now).to_pydatetime(), window_days)
    if large.isEmpty():
        linked = _whole(keyed, floor)
    else:
        placed = written(in_order(keyed.join(large, "home", "left_semi"), "home", F.col("at").asc_nulls_last(), "message_id"), "placed")
        starts = placed.groupBy("home").agg(F.min("place").alias("start"))
        linked = _whole(keyed.join(large, "home", "left_anti"), floor).unionByName(_segmented(placed, starts, floor, segment))
    rest = rows.filter("NOT coalesce(event_type <> 'unknown' AND company_key IS NOT NULL, false)")
    none = [F.lit(None).cast("string").alias(c) for c in ("company", "company_key", "role", "location", "ats")]
    return linked.unionByName(rest.select("message_id", F.lit(None).cast("string").alias("application_id"), F.lit(False).alias("created"), *none))


def applications_of(links: DataFrame) -> DataFrame:
    """One row for each application that links name."""
    return links.filter("application_id IS NOT NULL").groupBy("application_id").agg(*[F.first(c).alias(c) for c in ("company", "company_key", "role", "location", "ats")])


def events_of(messages: DataFrame, classifications: DataFrame, links: DataFrame) -> DataFrame:
    """The append-only event log: an event for each message, numbered by a hash of its id."""
    rows = messages.select("message_id", F.col("received_at").alias("occurred_at")).join(classifications.select("message_id", "event_type"), "message_id").join(links.select("message_id", "application_id"), "message_id")
    return rows.select(F.xxhash64("message_id").alias("event_id"), "application_id", "message_id", "event_type", "occurred_at")
