import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import fillmiddle
from tests.llm.helpers import awkward, empty

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]", re.S)


def plain(doc_id, text):
    """The contract, with a list of all units."""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aZ é\n<>PSM😀1K"), max_size=60), st.integers(0, 10**6))
def test_cuts_equal_those_in_a_list_of_units(text, doc_id):
    assert tuple(fillmiddle.transform(doc_id, text, 1, 90, 20)) == plain(doc_id, text)


@pytest.mark.parametrize("stretch", [1, 2, 3, 7])
def test_stretches_join_runs(monkeypatch, stretch):
    monkeypatch.setattr(fillmiddle, "STRETCH", stretch)
    text = "abc  déf\n\nGHI!?x" * 5
    runs = fillmiddle.encode(text)
    units = UNIT.findall(text)
    assert runs.units[-1] == len(units)
    assert [fillmiddle.offset(runs, i) for i in range(len(units) + 1)] == [len("".join(units[:i])) for i in range(len(units) + 1)]
    assert len(runs.starts) - 1 == len(re.findall("[A-Za-z]+|[^A-Za-z]+", text))


def test_awkward_rows(spark):
    docs = awkward(spark).union(awkward(spark).limit(1).selectExpr("77L", "'has <S> inside'", "lang", "source", "n_chars", "component_id", "fp", "s", "block"))
    got = fillmiddle.fill_in_middle(docs)
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows, key=repr) == sorted([(i, *plain(i, x)) for i, x in texts], key=repr)
    back = got.select(fillmiddle.restored(got["output"], got["form"]).alias("x")).collect()
    assert sorted(r.x for r in back) == sorted(x for _, x in texts)
    assert fillmiddle.fill_in_middle(empty(spark)).count() == 0


def test_parameters_reach_the_transformation(spark):
    docs = spark.createDataFrame([(i, f"text number {i} goes here") for i in range(200)], "doc_id long, text string")
    assert {r.form for r in fillmiddle.fill_in_middle(docs, rate=0).collect()} == {"plain"}
    assert {r.form for r in fillmiddle.fill_in_middle(docs, rate=100, suffix_first=100).collect()} == {"spm"}
    a, b = (fillmiddle.fill_in_middle(docs, seed=s).collect() for s in (1, 2))
    assert a != b and a == fillmiddle.fill_in_middle(docs).collect()


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id: plain(r.doc_id, r.text or "") for r in docs.collect()}
    for r in fillmiddle.op11_fill_in_middle(spark, "/root/testdata/sf0.01").collect():
        n, form, p, m, output = want.pop(r.doc_id)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256) == (n, form, p, m, hashlib.sha256(output.encode()).hexdigest())
    assert not want
