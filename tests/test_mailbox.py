import base64
import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerline.sources import mailbox
from ledgerline.streaming import incremental

NOW = datetime(2026, 3, 1)


def payload(i, history, days=1, labels=("INBOX",)):
    at = int((NOW - timedelta(days=days)).timestamp() * 1000)
    text = base64.urlsafe_b64encode(f"Hello {i}".encode()).decode().rstrip("=")
    return json.dumps({"id": f"m{i}", "threadId": f"t{i}", "historyId": str(history), "internalDate": str(at), "labelIds": list(labels), "payload": {"mimeType": "text/plain", "headers": [{"name": "From", "value": f"A <a{i}@x.example>"}, {"name": "Subject", "value": f"S{i}"}], "body": {"data": text}}})


def fill(spark, path, *entries, page=3):
    return mailbox.write_mailbox(spark.createDataFrame([(x,) for x in entries], "value string"), str(path), page=page)


def ids(df):
    return sorted(r.message_id for r in df.collect())


def test_batch_reads_pages_that_filters_leave(spark, tmp_path):
    mailbox.register(spark)
    assert fill(spark, tmp_path / "box", *[payload(i, i * 10, days=30 - i) for i in range(1, 11)], payload(99, 55, labels=["SPAM"])) == 4
    box = spark.read.format("mailbox").option("path", str(tmp_path / "box")).load()
    assert ids(box) == sorted(f"m{i}" for i in range(1, 11))
    assert ids(box.filter("history_id > 80")) == ["m10", "m9"]
    late = F.lit(NOW - timedelta(days=22))
    assert ids(box.filter(F.col("received_at") >= late)) == ["m10", "m8", "m9"]
    reader = mailbox.MailboxReader({"path": str(tmp_path / "box")})
    assert len(reader.partitions()) == 4
    list(reader.pushFilters([mailbox.GreaterThan(("history_id",), 80)]))
    assert len(reader.partitions()) == 2  # the others aren't fetched
    assert ids(spark.read.format("mailbox").option("path", str(tmp_path / "box")).option("labels", "all").option("cursor", "50").load()) == ["m10", "m6", "m7", "m8", "m9", "m99"]
    assert spark.read.format("mailbox").option("path", str(tmp_path / "none")).load().count() == 0


def test_sync_follows_the_cursor(spark, tmp_path):
    box, store = tmp_path / "box", str(tmp_path / "store")
    fill(spark, box, payload(1, 10, days=900), *[payload(i, i * 10) for i in range(2, 8)], payload(3, 75))
    go = lambda **more: incremental.sync_mailbox(spark, store, NOW, path=str(box), **more)
    assert go() == {"fetched": 7, "stored": 6, "cursor": "75"}  # the lookback leaves m1 out, m3 has two entries
    assert incremental.get_cursor(spark, store, "mailbox") == "75"
    assert go() == {"fetched": 0, "stored": 0, "cursor": "75"}
    fill(spark, box, payload(8, 80), payload(2, 90), payload(9, 95, labels=["TRASH"]))
    assert go() == {"fetched": 2, "stored": 1, "cursor": "95"}
    found = {r.message_id: r for r in incremental.stored(spark, store).collect()}
    assert sorted(found) == [f"m{i}" for i in range(2, 9)]
    assert (found["m8"].subject, found["m8"].body_text, found["m8"].from_email) == ("S8", "Hello 8", "a8@x.example")


def test_an_expired_cursor_falls_back_to_dates_and_loses_nothing(spark, tmp_path):
    box, store = tmp_path / "box", str(tmp_path / "store")
    fill(spark, box, *[payload(i, i * 10) for i in range(1, 4)])
    go = lambda **more: incremental.sync_mailbox(spark, store, NOW, path=str(box), **more)
    assert go()["cursor"] == "30"
    fill(spark, box, *[payload(i, i * 10, days=0) for i in range(4, 7)])
    (box / "floor-50").touch()  # entries before 50 can't be asked for by cursor
    assert go() == {"fetched": 6, "stored": 3, "cursor": "60"}
    assert ids(incremental.stored(spark, store)) == [f"m{i}" for i in range(1, 7)]
    # gaps in the numbers alone don't expire a cursor
    fill(spark, box, payload(7, 9000))
    assert go() == {"fetched": 1, "stored": 1, "cursor": "9000"}


class Flaky(mailbox.FolderMailbox):
    """Refuses each page twice."""

    def fetch(self, page):
        mark = f"{self.root}/../tries-{page.low}"
        n = len(open(mark).read()) if os.path.exists(mark) else 0
        with open(mark, "a") as f:
            f.write("x")
        if n < 2:
            raise mailbox.TransportError(429)
        return super().fetch(page)


def test_a_refused_page_is_tried_again(spark, tmp_path):
    mailbox.register(spark)
    fill(spark, tmp_path / "box", *[payload(i, i) for i in range(1, 6)], page=2)
    reader = spark.read.format("mailbox").option("path", str(tmp_path / "box")).option("transport", "tests.test_mailbox:Flaky")
    assert ids(reader.load()) == [f"m{i}" for i in range(1, 6)]


@pytest.mark.parametrize("error,tries", [(mailbox.TransportError(500), 3), (mailbox.TransportError(403, "rateLimitExceeded"), 3), (mailbox.TransportError(403), 1), (mailbox.TransportError(404), 1), (ConnectionError(), 3), (ValueError(), 1)])
def test_only_errors_that_pass_are_tried_again(error, tries):
    seen = []

    def call():
        seen.append(1)
        raise error

    with pytest.raises(type(error)):
        mailbox.patiently(call, 3, pause=0)
    assert len(seen) == tries
