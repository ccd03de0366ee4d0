"""Mail payloads to messages, label filter, readers of message files and golden expectations."""

from __future__ import annotations

import base64
import email.header
import json
from datetime import timedelta
from email.utils import parseaddr

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.text import collapse_whitespace, prose
from ledgerline.schemas import MESSAGE

#: Labels of mail that is never read.
EXCLUDED_LABELS = ["CHAT", "DRAFT", "SPAM", "TRASH"]
#: Parts of a message nested deeper aren't read, as in the surveyed behaviour.
MAX_DEPTH = 20

_HEADERS = "array<struct<name string, value string>>"
_ENVELOPE = f"id string, threadId string, internalDate string, historyId string, labelIds array<string>, snippet string, payload struct<headers: {_HEADERS.replace('name string, value string', 'name: string, value: string')}>"


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages from JSON files of one object each."""
    return spark.read.schema(MESSAGE).json(path, multiLine=True)


def read_expectations(spark: SparkSession, path: str) -> DataFrame:
    """Golden rows from JSON lines; blank lines and comments are skipped."""
    lines = spark.read.text(path).filter(~F.col("value").rlike("^\\s*(#.*)?$"))
    fields = F.from_json("value", "fixture string, event_type string, company string, role string, ats string, note string")
    return lines.select(fields.alias("x")).select("x.*")


def without_excluded(messages: DataFrame, column: str = "labels") -> DataFrame:
    return messages.filter(~F.arrays_overlap(F.coalesce(F.col(column), F.array().cast("array<string>")), F.lit(EXCLUDED_LABELS)))


def history_maximum(ids: Column) -> Column:
    """The greatest of digit strings as a number; others are ignored."""
    return F.max(F.when(ids.rlike("^[0-9]+$"), ids.cast("bigint")))


#: Days that a fetch without a cursor looks back, and messages of one sync.
LOOKBACK_DAYS = 400
BATCH_MESSAGES = 500


def fetch(messages: DataFrame, since=None, limit: int | None = None) -> tuple[DataFrame, bool]:
    """Messages after since, the newest first, at most limit of them; and whether there were more."""
    rows = without_excluded(messages)
    if since is not None:
        rows = rows.filter(F.col("received_at") >= F.lit(since))
    rows = rows.orderBy(F.desc("received_at"), "message_id")
    if limit is None:
        return rows, False
    return rows.limit(limit), rows.limit(limit + 1).count() > limit


def fetch_from(mailbox: DataFrame, cursor: str | None, now, since=None, limit: int | None = BATCH_MESSAGES, lookback_days: int = LOOKBACK_DAYS) -> tuple[DataFrame, bool, str | None]:
    """(messages, whether there were more, the next cursor) of a mailbox with the column history_id, a string of digits.

    With a cursor the messages behind it, each once, in history order. Without one, or where the mailbox no longer reaches back to
    it (its oldest entry is more than one behind the cursor), a dated query from since, or lookback_days before now, the newest first. The next cursor is read
    before the messages are, so what arrives meanwhile is read again and not skipped; it stays where it was if nothing is there. Where the limit
    cuts either of them, what is read is the oldest by history and the next cursor the last entry read, so the following call goes on there and nothing is lost;
    messages without a history number can't be returned to and come with the first such part, beyond the limit.
    """
    entry = F.when(F.col("history_id").rlike("^[0-9]+$"), F.col("history_id").cast("bigint"))
    low, high = mailbox.agg(F.min(entry), history_maximum(F.col("history_id"))).first()
    after = cursor if high is None else str(high)
    known = cursor is not None and cursor.isdigit() and low is not None and int(low) <= int(cursor) + 1
    rows = without_excluded(mailbox).withColumn("_entry", entry)
    if known:
        rows = rows.filter(F.col("_entry") > int(cursor))
    else:
        rows = rows.filter(F.col("received_at") >= F.lit(since if since is not None else now - timedelta(days=lookback_days)))
    first = Window.partitionBy("message_id").orderBy(F.col("_entry").asc_nulls_last())
    rows = rows.withColumn("_turn", F.row_number().over(first)).filter("_turn = 1").drop("_turn")
    numbered = rows.filter("_entry IS NOT NULL").orderBy("_entry", "message_id")
    more = limit is not None and numbered.limit(limit + 1).count() > limit
    if more:
        cut = numbered.limit(limit)
        after = str(cut.agg(F.max("_entry")).first()[0])
        rows = cut.unionByName(rows.filter("_entry IS NULL"))
    order = [F.desc("received_at"), F.col("message_id")] if not known and not more else [F.col("_entry").asc_nulls_last(), F.col("message_id")]
    return rows.orderBy(*order).drop("_entry", "history_id"), more, after


@F.pandas_udf(T.StringType())
def decode_header(values: pd.Series) -> pd.Series:
    """Encoded words of a header, decoded; what can't be decoded stays."""

    def plain(x):
        if x is None:
            return None
        try:
            return str(email.header.make_header(email.header.decode_header(x)))
        except (LookupError, UnicodeError, ValueError):
            return x

    return values.map(plain)


@F.pandas_udf(T.StructType([T.StructField("name", T.StringType()), T.StructField("address", T.StringType())]))
def split_address(values: pd.Series) -> pd.DataFrame:
    """Display name (null for none) and lower-case address of a header value."""
    pairs = [parseaddr(x or "") for x in values]
    return pd.DataFrame({"name": [n or None for n, _ in pairs], "address": [a.lower() for _, a in pairs]})


def header_map(headers: Column) -> Column:
    """Map of lower-case names to values; of repeated headers the first counts."""
    named = F.transform(F.coalesce(headers, F.array().cast(_HEADERS)), lambda h: F.struct(F.lower(h["name"]).alias("k"), h["value"].alias("v")))
    first = F.filter(named, lambda h, i: h["k"].isNotNull() & (F.array_position(F.transform(named, lambda x: x["k"]), h["k"]) == i + 1))
    return F.map_from_entries(first)


def _charset(part: dict) -> str:
    for h in part.get("headers") or []:
        if str(h.get("name", "")).lower() == "content-type":
            for bit in str(h.get("value", "")).split(";")[1:]:
                key, _, value = bit.strip().partition("=")
                if key.lower() == "charset":
                    return value.strip("\"' ")
    return "utf-8"


def _decoded(part: dict) -> str | None:
    data = (part.get("body") or {}).get("data")
    if not data:
        return None
    raw = base64.urlsafe_b64decode(data + "=" * (-len(data) % 4))
    try:
        return raw.decode(_charset(part), "replace")
    except LookupError:
        return raw.decode("utf-8", "replace")


def body_of(payload: dict) -> str:
    """The first plain part's text, else the first HTML part's prose; attachments and parts nested too deep are skipped."""
    found: dict[str, str] = {}

    def walk(part: dict, depth: int) -> None:
        if depth > MAX_DEPTH or part.get("filename"):
            return
        kind = part.get("mimeType", "")
        if kind in ("text/plain", "text/html") and kind not in found and (text := _decoded(part)) is not None:
            found[kind] = text
        for sub in part.get("parts") or []:
            walk(sub, depth + 1)

    walk(payload, 0)
    return found["text/plain"] if "text/plain" in found else prose(found.get("text/html", ""))


@F.pandas_udf(T.StringType())
def body_text(payloads: pd.Series) -> pd.Series:
    return payloads.map(lambda x: body_of((json.loads(x) or {}).get("payload") or {}) if x else "")


def parse_payloads(payloads: DataFrame, column: str = "value") -> DataFrame:
    """Messages from JSON payloads of the mail API; id, threadId and internalDate are required."""
    rows = payloads.select(F.col(column).alias("_raw"), F.from_json(column, _ENVELOPE).alias("p"))
    need = lambda c: F.coalesce(F.col(f"p.{c}"), F.raise_error(F.lit(f"payload without {c}")).cast("string"))
    headers = header_map(F.col("p.payload.headers"))
    rows = rows.withColumn("headers", headers)
    sender = split_address(decode_header(F.try_element_at("headers", F.lit("from"))))
    return rows.select(
        need("id").alias("message_id"),
        need("threadId").alias("thread_id"),
        F.timestamp_millis(need("internalDate").cast("bigint")).alias("received_at"),
        sender["address"].alias("from_email"),
        sender["name"].alias("from_name"),
        F.nullif(split_address(decode_header(F.try_element_at("headers", F.lit("to"))))["address"], F.lit("")).alias("to_email"),
        F.coalesce(decode_header(F.try_element_at("headers", F.lit("subject"))), F.lit("")).alias("subject"),
        collapse_whitespace(body_text("_raw")).alias("body_text"),
        F.coalesce("p.snippet", F.lit("")).alias("snippet"),
        F.coalesce("p.labelIds", F.array().cast("array<string>")).alias("labels"),
        "headers",
    )
