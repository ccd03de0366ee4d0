import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import linking
from ledgerline.operators.components import connected_components, shared_dir
from tests.plainfold import fold

NOW = datetime(2026, 8, 18, 12)


def test_components_match_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, i) for i in range(5001, 5100)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up if any(x in e and e[0] != e[1] for e in edges)}


def history(rng, n):
    roles = [None, "software engineer", "data analyst", "senior software engineer"]
    return [{"message_id": f"m{i}", "thread_id": f"t{rng.randrange(8)}", "event_type": rng.choice(["interview", "unknown", "offer"]), "received_at": NOW - timedelta(days=rng.randrange(400), minutes=i), "company": "X", "company_key": rng.choice([None, "a", "b", "c", "d"]), "role": rng.choice(roles), "location": None, "ats": rng.choice([None, "lever"])} for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_folding_by_component_equals_one_fold(spark, seed):
    rows = history(random.Random(seed), 40)
    m = spark.createDataFrame([(r["message_id"], r["thread_id"], r["received_at"]) for r in rows], "message_id string, thread_id string, received_at timestamp")
    c = spark.createDataFrame([tuple(r[k] for k in ("message_id", "event_type", "company", "company_key", "role", "location", "ats")) for r in rows], "message_id string, event_type string, company string, company_key string, role string, location string, ats string")
    got = {r.message_id: r.application_id for r in linking.link(m, c, NOW).collect()}
    words = {r.message_id: r.words for r in c.select("message_id", linking.link_tokens(F.col("role")).alias("words")).collect()}
    ordered = sorted(({**r, "words": words[r["message_id"]]} for r in rows), key=lambda r: (r["received_at"], r["message_id"]))
    assert got == {x["message_id"]: x["application_id"] for x in fold(ordered, NOW)}


def message(i, days, **more):
    return {"message_id": f"m{i}", "thread_id": f"t{i}", "event_type": "interview", "received_at": NOW - timedelta(days=days), "company": "X", "company_key": "x", "role": None, "words": [], "location": None, "ats": None} | more


def linked(*rows):
    return [x["application_id"] for x in fold(list(rows), NOW)]


def test_window_is_inclusive():
    a, b = linked(message(0, 180), message(1, 1))
    assert a == b
    a, b = linked(message(0, 180.001), message(1, 1))
    assert a != b


def test_thread_wins_over_company_but_not_without_a_key():
    a, b, c = linked(message(0, 9), message(1, 8, thread_id="t0", company_key="other"), message(2, 7, thread_id="t0", company_key=None))
    assert a == b and c is None


def test_different_roles_part_and_a_missing_role_joins():
    a, b, c = linked(message(0, 9, role="cook", words=["cook"]), message(1, 8, role="pilot", words=["pilot"]), message(2, 7))
    assert a != b and c == b


def test_enrichment_fills_a_role_that_later_matches_use():
    a, b, c = linked(message(0, 9), message(1, 8, role="cook", words=["cook"]), message(2, 7, role="pilot", words=["pilot"]))
    assert a == b != c


def corrected_links(spark, rows, overrides, reapply=False):
    m = spark.createDataFrame([(r["message_id"], r["thread_id"], r["received_at"]) for r in rows], "message_id string, thread_id string, received_at timestamp")
    c = spark.createDataFrame([tuple(r[k] for k in ("message_id", "event_type", "company", "company_key", "role", "location", "ats")) for r in rows], "message_id string, event_type string, company string, company_key string, role string, location string, ats string")
    o = spark.createDataFrame(overrides, "message_id string, event_type string, company string, role string")
    return {r.message_id: r for r in linking.link(m, c, NOW, overrides=o, reapply=reapply).collect()}


def test_corrections_link_and_unlink(spark):
    rows = [message(0, 9, thread_id="a"), message(1, 8, thread_id="b", event_type="unknown", company=None, company_key=None), message(2, 7, thread_id="c"), message(3, 6, thread_id="d", event_type="unknown")]
    none = corrected_links(spark, rows, [])
    assert none["m0"].application_id == none["m2"].application_id and none["m1"].application_id is none["m3"].application_id is None
    # a company rescues a message, a type alone links by the classifier's company, unknown unlinks, and an acceptance changes nothing
    got = corrected_links(spark, rows, [("m1", "offer", "The Zürich Works, Inc.", "Cook"), ("m3", "interview", None, None), ("m2", "unknown", None, None), ("m0", None, None, None)])
    assert (got["m1"].company_key, got["m1"].role, got["m1"].created) == ("zurich works", "Cook", True)
    assert got["m3"].application_id == got["m0"].application_id == none["m0"].application_id and got["m2"].application_id is None


def test_a_correction_of_a_linked_message_keeps_its_application_until_rules_are_reapplied(spark):
    rows = [message(0, 9, thread_id="a"), message(1, 8, thread_id="b")]
    wanted = [("m1", "offer", "Other", None)]
    kept, again = corrected_links(spark, rows, wanted), corrected_links(spark, rows, wanted, reapply=True)
    assert kept["m0"].application_id == kept["m1"].application_id and again["m0"].application_id != again["m1"].application_id
    assert again["m1"].company_key == "other"


def test_threads_of_several_companies_do_not_tie_them_together(spark):
    """A thread belongs to the company of its first linkable message; the group that is folded stays one company's."""
    rows = [message(i, 50 - i, thread_id=f"t{i // 2}", company_key=f"k{(i + 1) // 2}") for i in range(20)]
    got = corrected_links(spark, rows, [])
    ordered = sorted(rows, key=lambda r: (r["received_at"], r["message_id"]))
    assert {i: r.application_id for i, r in got.items()} == {x["message_id"]: x["application_id"] for x in fold(ordered, NOW)}


def busy(rng, n, companies=3):
    """Messages with and without roles, ties in time, threads that go on for long and threads of several companies."""
    words = "senior software data platform engineer analyst cook pilot manager lead remote".split()
    roles = [None, None, "Senior", *{" ".join(rng.sample(words, rng.randrange(1, 5))) for _ in range(12)}]
    return [{"message_id": f"m{i}", "thread_id": None if rng.random() < 0.02 else f"t{rng.randrange(n // 3)}", "event_type": rng.choice(["interview", "offer", "unknown"]), "received_at": NOW - timedelta(hours=rng.randrange(24 * 300)), "company": "X", "company_key": rng.choice([None, *(f"k{c}" for c in range(companies))]), "role": rng.choice(roles), "location": rng.choice([None, "Here"]), "ats": rng.choice([None, "lever"])} for i in range(n)]


def frames(spark, rows):
    m = spark.createDataFrame([(r["message_id"], r["thread_id"], r["received_at"]) for r in rows], "message_id string, thread_id string, received_at timestamp")
    c = spark.createDataFrame([tuple(r[k] for k in ("message_id", "event_type", "company", "company_key", "role", "location", "ats")) for r in rows], "message_id string, event_type string, company string, company_key string, role string, location string, ats string")
    return m, c


def by_plain_fold(spark, rows, c):
    words = {r.message_id: r.words for r in c.select("message_id", linking.link_tokens(F.col("role")).alias("words")).collect()}
    ordered = sorted(({**r, "words": words[r["message_id"]]} for r in rows), key=lambda r: (r["received_at"], r["message_id"]))
    return {x["message_id"]: tuple(x[k] for k in ("application_id", "created", "company", "company_key", "role", "location", "ats")) for x in fold(ordered, NOW)}


@pytest.mark.parametrize("seed,segment", [(11, 7), (12, 40), (13, 10**6), (14, 1)])
def test_segments_equal_the_plain_fold(spark, seed, segment):
    rows = busy(random.Random(seed), 30 if segment == 1 else 240)
    m, c = frames(spark, rows)
    got = {r[0]: tuple(r)[1:] for r in linking.link(m, c, NOW, segment=segment).collect()}
    assert got == by_plain_fold(spark, rows, c)


def test_a_segment_hands_on_only_what_can_be_reached():
    rows = [{"message_id": f"m{i}", "thread_id": f"t{i}", "at": i, "company": "X", "company_key": "x", "role": f"role{i}", "words": [f"role{i}"], "location": None, "ats": None, "final": i % 10 > 0} for i in range(1000)]
    pieces = linking.fold_segment("x", 0, rows, [], floor=900)
    on = [p for p in pieces if p["kind"] == "thread" or (p["kind"] == "app" and p["near"])]
    assert sum(p["kind"] == "thread" for p in on) == 100 and sum(p["kind"] == "app" for p in on) == 100 + 90  # live threads' and recent ones


def test_a_large_company_takes_time_in_proportion():
    """20,000 applications whose roles share a word: the plain fold would compare each with all."""
    rows = [{"message_id": f"m{i}", "thread_id": f"t{i}", "at": i, "company": "X", "company_key": "x", "role": "r", "words": ["engineer", f"a{i}", f"b{i}"], "location": None, "ats": None} for i in range(20_000)]
    began = time.perf_counter()
    assert sum(new for *_, new in linking.Ledger(0).run(rows)) == 20_000
    assert time.perf_counter() - began < 10


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        conf, master = Conf(), "spark://host:7077"

        @property
        def sparkContext(self):  # noqa: N802
            return self

        @property
        def _jsc(self):
            return self

        def sc(self):
            return self

        def getCheckpointDir(self):  # noqa: N802
            return self

        def isDefined(self):  # noqa: N802
            return False

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_dir(Cluster())
