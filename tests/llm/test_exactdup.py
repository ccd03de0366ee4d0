import hashlib
import random
import re

import pytest

from ledgerline.llm import exactdup
from tests.llm.helpers import LONG, awkward, empty


def plain(rows):
    """(doc_id, keep_id, group_size, sha256) of each row and how many rows stay, with a dictionary of whole contents."""
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out = []
    for content, members in groups.items():
        keep = min(members)[3]
        out += [(m[3], keep, len(members), hashlib.sha256(content.encode()).hexdigest()) for m in members]
    return sorted(out, key=repr), len(groups)


def check(docs, **more):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = exactdup.exact_groups(docs, **more).collect()
    want, kept = plain(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == want
    assert sum(r.kept for r in got) == kept
    by_text = {r.text_sha256 for r in got if r.kept}
    assert len(by_text) == kept  # one row of each group
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_awkward_rows(spark):
    check(awkward(spark))
    check(awkward(spark), range_bytes=100)
    assert exactdup.exact_groups(empty(spark)).count() == 0


@pytest.mark.parametrize("range_bytes", [200, 1000, 5000, 1 << 30])
def test_hot_contents_over_many_ranges(spark, range_bytes):
    rng = random.Random(range_bytes)
    rows = [(i, "hot text" + " " * rng.randrange(3)) for i in range(400)]  # a third and more of all rows: several ranges hold nothing else
    rows += [(i, f"same start of all these texts {rng.randrange(60)}") for i in range(400, 800)]
    rows += [(None, "hot\ntext"), (None, "hot\ntext"), (5, "hot text"), (5, "hot text"), (900, LONG), (901, LONG + " "), (902, None), (903, " \x0b\r"), (904, "a\x1fb"), (905, "ab")]
    rng.shuffle(rows)
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), range_bytes=range_bytes)


def test_ranges_split_a_hot_content(spark):
    docs = spark.createDataFrame([(i, "the one text") for i in range(3000)], "doc_id long, text string").repartition(4)
    ranges = exactdup._sorted_ranges(docs, "doc_id", "text", 20_000).groupBy("range").count().collect()
    assert len(ranges) > 8 and max(r["count"] for r in ranges) < 600
    assert sum(r["count"] for r in ranges) == 3000


def test_rows_of_equal_ids_and_nulls(spark):
    docs = spark.createDataFrame([(None, "x y")] * 50 + [(3, "xy")] * 50, "doc_id long, text string").repartition(3)
    check(docs, range_bytes=500)
    got = exactdup.exact_groups(docs, range_bytes=500).collect()
    assert sum(r.kept for r in got) == 1 and {r.keep_id for r in got} == {None}  # the longer original stays, whatever its id


def test_no_python_on_the_way(spark):
    plan = exactdup.exact_groups(awkward(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
