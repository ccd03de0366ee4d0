import base64
import json
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerline.plans import catalog
from ledgerline.sources import mail, sinks
from ledgerline.streaming import incremental
from tests.mails import rows

SMALL = "/root/testdata/sf0.001"


def encoded(text):
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def payload(**more):
    headers = [{"name": "From", "value": "=?utf-8?q?J=C3=BCrgen?= <J@Acme.COM>"}, {"name": "Subject", "value": "Hi"}, {"name": "SUBJECT", "value": "later"}]
    body = {"mimeType": "multipart/mixed", "headers": headers, "parts": [{"mimeType": "text/html", "body": {"data": encoded("<p>rich</p>")}}, {"mimeType": "text/plain", "filename": "a.txt", "body": {"data": encoded("file")}}, {"mimeType": "multipart/alternative", "parts": [{"mimeType": "text/plain", "body": {"data": encoded("plain\r\ntext")}}]}]}
    return {"id": "m", "threadId": "t", "internalDate": "1767225600123", "labelIds": ["INBOX"], "snippet": "s", "payload": body} | more


def test_payload_to_message(spark):
    found = mail.parse_payloads(spark.createDataFrame([(json.dumps(payload()),)], "value string")).first()
    assert (found.from_email, found.from_name, found.subject, found.body_text, found.received_at.microsecond) == ("j@acme.com", "Jürgen", "Hi", "plain\ntext", 123000)
    assert found.headers["subject"] == "Hi" and found.to_email is None


def test_html_only_payload(spark):
    body = {"mimeType": "text/html", "headers": [{"name": "Content-Type", "value": "text/html; charset=latin-1"}], "body": {"data": base64.urlsafe_b64encode("<p>Grüße</p>".encode("latin-1")).decode()}}
    assert mail.parse_payloads(spark.createDataFrame([(json.dumps(payload(payload=body)),)], "value string")).first().body_text == "Grüße"


def test_history_maximum_ignores_other_strings(spark):
    rows = spark.createDataFrame([("9",), ("10",), ("x",), (None,)], "h string")
    assert rows.agg(mail.history_maximum(F.col("h")).alias("m")).first().m == 10


def test_golden_reader_skips_comments(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('# note\n\n{"fixture": "a", "event_type": "offer"}\n')
    assert [r.fixture for r in mail.read_expectations(spark, str(tmp_path / "e.jsonl")).collect()] == ["a"]


def write_mails(folder, found):
    folder.mkdir(exist_ok=True)
    for r in found:
        (folder / f"{r['message_id']}.json").write_text(json.dumps({k: v.isoformat() if isinstance(v, datetime) else v for k, v in r.items() if k not in ("event_type", "company", "role", "ats")}))


def test_sync_is_idempotent_and_equals_a_batch(spark, tmp_path):
    now = datetime(2026, 8, 18, 12)
    inbox, store = tmp_path / "in", str(tmp_path / "store")
    write_mails(inbox, rows()[:5])
    assert incremental.dry_run(spark, str(inbox), store).count() > 0
    incremental.sync(spark, str(inbox), store)
    incremental.sync(spark, str(inbox), store)
    write_mails(inbox, rows()[5:] + [rows()[0] | {"message_id": "spam", "labels": ["SPAM"]}])
    (inbox / "again.json").write_text((inbox / "a1.json").read_text())
    incremental.sync(spark, str(inbox), store)
    assert sorted(r.message_id for r in incremental.stored(spark, store).collect()) == [r["message_id"] for r in rows()]
    one = str(tmp_path / "one")
    incremental.sync(spark, str(inbox), one)
    events = lambda s: sorted(map(tuple, incremental.tables(spark, s, now)["events"].collect()), key=repr)
    assert events(store) == events(one)
    counters = incremental.report(incremental.tables(spark, store, now)).first()
    assert (counters.messages, counters.unknown, counters.applications_created) == (8, 1, 5)  # a1, a2 and a8 are one


def test_csv_and_workbook(spark, tmp_path):
    frame = spark.createDataFrame([("a,b", 'say "x"', None, datetime(2026, 1, 2, 3, 4, 5), True)], "a string, b string, c int, d timestamp, e boolean")
    text = open(sinks.write_csv(frame, str(tmp_path / "x" / "f.csv"))).read()
    assert text == 'a,b,c,d,e\n"a,b","say ""x""",,2026-01-02T03:04:05Z,True\n'
    with zipfile.ZipFile(sinks.write_xlsx({"Applications": frame, "Events": frame.limit(0)}, str(tmp_path / "f.xlsx"))) as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
        assert 'state="frozen"' in sheet and "autoFilter" in sheet and "a,b" in sheet and z.testzip() is None


def test_dashboard_is_deterministic(spark, tmp_path):
    from ledgerline.operators import reports

    _, eff, model = catalog._model(spark, SMALL)
    parts = [reports.summary(model), reports.status_counts(model), reports.calendar_counts(model, "applied_at"), reports.top_companies(model, 5), reports.latency_histogram(model), reports.stage_flows(eff, model)]
    one, two = (open(sinks.write_dashboard(str(tmp_path / f"{k}.html"), "T <1>", *parts)).read() for k in "ab")
    assert one == two and "T &lt;1&gt;" in one and one.count("<svg") == 5


def test_fetch_from_a_cursor(spark):
    from datetime import datetime, timedelta

    now = datetime(2026, 3, 1)
    rows = [(f"m{i}", now - timedelta(days=d), ["SPAM"] if i == 5 else ["INBOX"], h) for i, d, h in [(1, 900, "10"), (2, 30, "11"), (3, 20, "12"), (3, 20, "13"), (4, 10, "14"), (5, 9, "15"), (6, 8, "x")]]
    box = spark.createDataFrame(rows, "message_id string, received_at timestamp, labels array<string>, history_id string")
    ids = lambda found: [r.message_id for r in found[0].collect()]
    first = mail.fetch_from(box, None, now)
    assert (ids(first), first[1:]) == (["m6", "m4", "m3", "m2"], (False, "15"))  # the lookback leaves m1 out
    delta = mail.fetch_from(box, "11", now)
    assert (ids(delta), delta[1:]) == (["m3", "m4"], (False, "15"))
    cut = mail.fetch_from(box, "9", now, limit=2)
    assert (ids(cut), cut[1:]) == (["m1", "m2"], (True, "11"))
    expired = mail.fetch_from(box, "3", now, since=now - timedelta(days=10))
    assert (ids(expired), expired[1:]) == (["m6", "m4"], (False, "15"))
    # a dated query that the limit cuts goes on by the cursor: nothing is lost, whatever the limit
    for limit in (1, 2, 3):
        seen, cursor, more = [], None, True
        while more:
            part, more, cursor = mail.fetch_from(box, cursor, now, limit=limit)
            seen += [r.message_id for r in part.collect()]
        assert sorted(set(seen)) == ["m2", "m3", "m4", "m6"] and cursor == "15", (limit, seen)
    assert mail.fetch_from(box.limit(0), "7", now)[2] == "7" and mail.fetch_from(box, "junk", now, limit=1)[1]


def test_store_versions_rescans_and_lookups(spark, tmp_path):
    from ledgerline.streaming import incremental

    store, done = str(tmp_path / "store"), []
    steps = [(2, lambda *_: done.append(2)), (1, lambda *_: done.append(1)), (3, lambda *_: 1 / 0)]
    assert incremental.store_version(spark, store) == 0
    with pytest.raises(ZeroDivisionError):
        incremental.migrate(spark, store, steps)
    assert done == [1, 2] and incremental.store_version(spark, store) == 2 and incremental.migrate(spark, store, steps[:2]) == 2 and done == [1, 2]
    write_mails(tmp_path / "in", rows())
    incremental.sync(spark, str(tmp_path / "in"), store)
    n = incremental.stored(spark, store).count()
    incremental.rescan(spark, str(tmp_path / "in"), store, "again")
    assert incremental.stored(spark, store).count() == n == len(rows())
    assert [r.message_id for r in incremental.messages_by(spark, store, thread_id="t1").collect()] == ["a1", "a2"]


def test_reports_name_missing_columns(spark):
    from ledgerline.operators import reports

    with pytest.raises(ValueError, match="status"):
        reports.status_counts(spark.range(1))
