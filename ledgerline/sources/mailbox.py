"""A mailbox as a Spark source: spark.read.format("mailbox") and spark.readStream.format("mailbox").

A mailbox is a list of entries, each a message payload with a history number that grows; a message may have several. Behind the source stands a Mailbox, which
says what pages of entries there are and fetches one; tasks fetch pages. The one given here reads a folder of pages (write_mailbox makes such a folder); another, such as one
that calls a mail service, is named by the option transport ("module:Class").

The offset of a stream is a cursor: all entries up to a history number have been read. A new stream begins at the option cursor, or without one with a query by
date (option since, in microseconds). The same query answers for a cursor that the mailbox no longer reaches back to; it gives again what was read
before, which storing each message once makes good. A page is fetched again after an error that passes, with growing pauses.

Options: path; transport; cursor; since; labels ("all" keeps what is never read otherwise); tries. Batch reads skip pages by filters on history_id and received_at.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import Any, Protocol

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ledgerline.operators.components import in_order
from ledgerline.operators.responses import LIMITED
from ledgerline.sources.mail import EXCLUDED_LABELS

ENTRY = "history_id long, message_id string, thread_id string, received_at timestamp, labels array<string>, payload string"
_ARROW = pa.schema([("history_id", pa.int64()), ("message_id", pa.string()), ("thread_id", pa.string()), ("received_at", pa.timestamp("us", tz="UTC")), ("labels", pa.list_(pa.string())), ("payload", pa.string())])
#: Entries of a page, and how often a page is tried.
PAGE, TRIES = 100, 4
#: A stream's offset before a query by date.
BY_DATE = -1


@dataclass
class Page(InputPartition):
    """Entries that are fetched at once: their least and greatest history numbers and times (microseconds)."""

    name: str
    low: int
    high: int
    oldest: int
    newest: int


class Mailbox(Protocol):
    def pages(self) -> list[Page]: ...

    def reaches(self, cursor: int) -> bool:
        """Whether all entries behind cursor are still there."""

    def fetch(self, page: Page) -> list[str]:
        """The payloads of a page."""


class FolderMailbox:
    """Pages as files of JSON lines, low-high-oldest-newest.jsonl; a file named floor-N says that entries before N are gone."""

    def __init__(self, options: dict[str, str]) -> None:
        path = options["path"]
        self.fs, self.root = fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")

    def _names(self) -> list[str]:
        return [x.base_name for x in self.fs.get_file_info(fs.FileSelector(self.root, allow_not_found=True))]

    def pages(self) -> list[Page]:
        found = [x.removesuffix(".jsonl").split("-") for x in self._names() if x.endswith(".jsonl")]
        return sorted((Page(f"{'-'.join(x)}.jsonl", *map(int, x)) for x in found), key=lambda p: (p.low, p.name))

    def reaches(self, cursor: int) -> bool:
        return cursor + 1 >= max((int(x.split("-")[1]) for x in self._names() if x.startswith("floor-")), default=0)

    def fetch(self, page: Page) -> list[str]:
        with self.fs.open_input_stream(f"{self.root}/{page.name}") as file:
            return [x for x in file.read().decode().split("\n") if x]


class TransportError(Exception):
    """What a mail service answered instead of a page: its status and reason."""

    def __init__(self, status: int, reason: str | None = None) -> None:
        super().__init__(f"{status} {reason or ''}".strip())
        self.status, self.reason = status, reason

    @property
    def passes(self) -> bool:
        return self.status == 429 or self.status >= 500 or (self.status == 403 and self.reason in LIMITED)


def patiently(call: Callable[[], Any], tries: int, pause: float = 0.5) -> Any:
    """call(), tried again after errors that pass: those of the network, and answers that say so."""
    for n in range(tries):
        try:
            return call()
        except (TransportError, ConnectionError, TimeoutError) as error:
            if n + 1 == tries or not getattr(error, "passes", True):
                raise
            time.sleep(pause * 2**n)


def transport(options: dict[str, str]) -> Mailbox:
    if "transport" not in options:
        return FolderMailbox(options)
    module, _, name = options["transport"].partition(":")
    return getattr(importlib.import_module(module), name)(options)


class _Pages:
    """What the reader and the stream reader share."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options = dict(options)
        self.since = int(self.options["since"]) if "since" in self.options else None
        self.tries = int(self.options.get("tries", TRIES))
        self.excluded = set() if self.options.get("labels") == "all" else set(EXCLUDED_LABELS)

    def entries(self, page: Page, after: int, upto: int | None, since: int | None) -> Iterator[pa.RecordBatch]:
        rows = []
        for raw in patiently(lambda: transport(self.options).fetch(page), self.tries):
            x = json.loads(raw)
            number, at, labels = int(x["historyId"]), int(x["internalDate"]) * 1000, x.get("labelIds") or []
            if number > after and (upto is None or number <= upto) and (since is None or at >= since) and not self.excluded & set(labels):
                rows.append({"history_id": number, "message_id": x["id"], "thread_id": x["threadId"], "received_at": at, "labels": labels, "payload": raw})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


def _micros(value: Any) -> int:
    if isinstance(value, datetime):
        return int((value if value.tzinfo else value.astimezone(timezone.utc)).timestamp() * 1_000_000)
    return int(value)


class MailboxReader(_Pages, DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.filters: list[tuple[str, type, int]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Pages are skipped by these; Spark still applies them to the rows."""
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute in (("history_id",), ("received_at",)):
                self.filters.append((f.attribute[0], type(f), _micros(f.value)))
            yield f

    def _may_hold(self, page: Page) -> bool:
        for name, kind, value in self.filters:
            low, high = (page.low, page.high) if name == "history_id" else (page.oldest, page.newest)
            if (kind in (GreaterThan, GreaterThanOrEqual) and high < value) or (kind in (LessThan, LessThanOrEqual) and low > value):
                return False
        return True

    def partitions(self) -> list[Page]:
        box, cursor = transport(self.options), int(self.options.get("cursor", BY_DATE))
        if cursor != BY_DATE and box.reaches(cursor):
            return [p for p in patiently(box.pages, self.tries) if p.high > cursor and self._may_hold(p)]
        self.options.pop("cursor", None)
        return [p for p in patiently(box.pages, self.tries) if (self.since is None or p.newest >= self.since) and self._may_hold(p)]

    def read(self, partition: Page | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's way to ask for nothing
            return iter(())
        if "cursor" in self.options:
            return self.entries(partition, int(self.options["cursor"]), None, None)
        return self.entries(partition, BY_DATE, None, self.since)


@dataclass
class Span(InputPartition):
    page: Page
    after: int
    upto: int
    since: int | None


class MailboxStreamReader(_Pages, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802
        return {"history": int(self.options.get("cursor", BY_DATE))}

    def latestOffset(self) -> dict:  # noqa: N802
        """The mailbox's greatest history number; a stream never goes back behind where it began."""
        return {"history": max([p.high for p in patiently(transport(self.options).pages, self.tries)] + [self.initialOffset()["history"]])}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        box, after, upto = transport(self.options), start["history"], end["history"]
        by_date = after == BY_DATE or not box.reaches(after)
        since = self.since if by_date else None
        after = BY_DATE if by_date else after
        return [Span(p, after, upto, since) for p in patiently(box.pages, self.tries) if p.high > after and p.low <= upto and (since is None or p.newest >= since)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return self.entries(partition.page, partition.after, partition.upto, partition.since)

    def commit(self, end: dict) -> None:
        pass


class MailboxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mailbox"

    def schema(self) -> str:
        return ENTRY

    def reader(self, schema: Any) -> MailboxReader:
        return MailboxReader(self.options)

    def streamReader(self, schema: Any) -> MailboxStreamReader:  # noqa: N802
        return MailboxStreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Make format("mailbox") known to a session, and let the session push filters to sources in Python (it refuses readers that take them otherwise)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MailboxSource)


def write_mailbox(payloads: DataFrame, path: str, column: str = "value", page: int = PAGE) -> int:
    """Add payloads (JSON with historyId and internalDate) to the folder of a mailbox, as pages in the order of history; how many pages."""
    fields = F.from_json(column, "historyId string, internalDate string")
    rows = payloads.select(F.col(column).alias("value"), fields["historyId"].cast("long").alias("number"), (fields["internalDate"].cast("long") * 1000).alias("at"))
    rows = in_order(rows, "number", "value")

    def write(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place")
        system, root = fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")
        system.create_dir(root, recursive=True)
        name = f"{part['number'].min()}-{part['number'].max()}-{part['at'].min()}-{part['at'].max()}.jsonl"
        with system.open_output_stream(f"{root}/.{name}") as file:
            file.write(("\n".join(part["value"]) + "\n").encode())
        system.move(f"{root}/.{name}", f"{root}/{name}")  # a page is seen whole
        return pd.DataFrame({"page": [name]})

    return rows.groupBy(F.floor(F.col("place") / page).alias("page")).applyInPandas(write, "page string").count()
