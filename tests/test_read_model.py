import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import events as ev
from ledgerline.operators import overrides as ov
from ledgerline.operators import reports
from ledgerline.schemas import EVENT, EVENT_TYPES, OVERRIDE, STAGE_OF, STAGES, TERMINAL_RANK

NOW = datetime(2026, 8, 18, 12, tzinfo=timezone.utc)
TERMINAL = {"rejection": "rejected", "offer": "offer", "withdrawn": "withdrawn"}


def effective(spark, rows, overrides=()):
    """rows: (event_id, application, type, days before NOW)."""
    e = spark.createDataFrame([(i, a, f"m{i}", t, NOW - timedelta(days=d)) for i, a, t, d in rows], EVENT)
    m = spark.createDataFrame([(f"m{i}", f"t{i % 3}", "s", "x@y.z") for i, *_ in rows], "message_id string, thread_id string, subject string, from_email string")
    c = spark.createDataFrame([(f"m{i}", 0.9, False) for i, *_ in rows if i % 5], "message_id string, confidence double, needs_review boolean")
    return ev.effective_events(e, m, c, spark.createDataFrame(list(overrides), OVERRIDE))


def expected(rows):
    rows = sorted(rows, key=lambda r: (-r[3], r[0]))
    ends = [t for _, _, t, _ in rows if t in TERMINAL]
    last = rows[-1][3]
    if ends:
        status = TERMINAL[ends[-1]]
    elif last > 30:
        status = "ghosted"
    else:
        status = {3: "interviewing", 4: "assessment"}.get(min(EVENT_TYPES.index(t) for _, _, t, _ in rows), "applied")
    answers = [d for _, _, t, d in rows if t != "application_received"]
    return status, int(rows[0][3] - answers[0]) if answers else None, int(last), len(rows), rows[-1][2]


def test_read_model_equals_a_plain_fold(spark):
    rng = random.Random(3)
    rows = [(i, f"a{rng.randrange(60)}", rng.choice(EVENT_TYPES), rng.choice([0, 1, 5.5, 29.9, 30, 30.1, 90])) for i in range(1, 240)]
    got = {r.application_id: (r.status, r.days_to_first_response, r.days_since_last_event, r.event_count, r.last_event_type) for r in ev.folded(effective(spark, rows), F.lit(NOW)).collect()}
    assert got == {a: expected([r for r in rows if r[1] == a]) for a in {r[1] for r in rows}}


def test_overrides_win_and_acceptance_only_clears_review(spark):
    at = NOW - timedelta(days=1)
    found = {r.event_id: r for r in effective(spark, [(1, "a", "interview", 3), (5, "a", "interview", 2), (10, "a", "offer", 1)], [("m1", "rejection", "", None, at, None), ("m5", None, None, None, at, None)]).collect()}
    assert (found[1].event_type, found[1].is_overridden) == ("rejection", True)
    assert (found[5].is_overridden, found[5].needs_review) == (False, False)
    assert (found[10].confidence, found[10].needs_review) == (0.0, True)


def test_whole_days_floor_and_dont_count_midnights(spark):
    row = spark.sql("select timestamp'2026-01-02 00:00:30' a, timestamp'2026-01-01 23:59:30' b").select(ev.whole_days(F.col("a"), F.col("b")).alias("x"), ev.whole_days(F.col("b"), F.col("a")).alias("y")).first()
    assert (row.x, row.y) == (0, -1)


def kept_by_folding(types):
    kept = []
    for t in types:
        if t in STAGE_OF and (not kept or (kept[-1] < TERMINAL_RANK and STAGES.index(STAGE_OF[t]) > kept[-1])):
            kept.append(STAGES.index(STAGE_OF[t]))
    return kept


def test_stages_equal_a_plain_fold(spark):
    rng = random.Random(7)
    lists = {f"a{k}": [rng.choice(EVENT_TYPES) for _ in range(rng.randrange(1, 9))] for k in range(80)}
    rows = [(100 * k + i, a, t, 50 - i) for k, (a, ts) in enumerate(lists.items()) for i, t in enumerate(ts)]
    got = {}
    for r in reports.kept_stages(effective(spark, rows)).orderBy("application_id", "occurred_at", "event_id").collect():
        got.setdefault(r.application_id, []).append(r.rank)
    assert got == {a: k for a, ts in lists.items() if (k := kept_by_folding(ts))}


def test_status_counts_fill_zeros_and_calendar_fills_gaps(spark):
    model = spark.createDataFrame([("a", "offer")], "application_id string, status string")
    assert [r.n for r in reports.status_counts(model).collect()] == [0, 0, 0, 1, 0, 0, 0]
    days = spark.createDataFrame([(datetime(2026, 1, 5),), (datetime(2026, 1, 25),), (None,)], "d timestamp")
    weeks = [(r.period.date().isoformat(), r.n) for r in reports.calendar_counts(days, "d").collect()]
    assert weeks == [("2026-01-11", 1), ("2026-01-18", 0), ("2026-01-25", 1)]
    with pytest.raises(ValueError):
        reports.calendar_counts(days, "d", "nonsense")


def test_empty_model_has_a_summary(spark):
    model = spark.createDataFrame([], "status string, days_to_first_response long, needs_review boolean")
    row = reports.summary(model).first()
    assert (row.total, row.response_rate, row.median_days) == (0, 0.0, None)


def test_table_rewrites(spark):
    held = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, at int")
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1)], "k int, v string, at int")
    assert sorted((r.k, r.v) for r in ov.upsert(held, new, ["k"], F.col("at")).collect()) == [(1, "a"), (2, "d"), (3, "e")]
    assert [(r.k, r.v) for r in ov.insert_new(held, new, "k", F.col("at")).collect()] == [(3, "e")]


def test_acceptance_appends_once(spark):
    held = spark.createDataFrame([("m1", "offer", None, None, NOW, None)], OVERRIDE)
    ids = spark.createDataFrame([("m1",), ("m2",), ("m2",)], "message_id string")
    rows = {r.message_id: r.event_type for r in ov.accept(held, ids, F.lit(NOW)).collect()}
    assert rows == {"m1": "offer", "m2": None}


def test_company_needle(spark):
    names = spark.createDataFrame([("acme robotics",), ("zeta",), (None,)], "k string")
    hit = lambda n: [r.k for r in names.filter(ev.company_matches(F.col("k"), n)).collect()]
    assert hit("Acme-Rob") == ["acme robotics"] and len(hit("!!")) == 3
