import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from ledgerline.llm import mixing
from tests.llm.helpers import awkward, empty

DATA = "/root/testdata/sf0.01"


def fill(sizes, weights, share=1.5, most=2):
    """The targets by the contract's words, with fractions and one source after the other."""
    sizes = [Fraction(z) for z in sizes]
    total, full = Fraction(share) * sum(sizes), set()
    while len(full) < len(sizes):
        rest = total - sum(most * sizes[i] for i in full)
        open_ = {i: rest * weights[i % len(weights)] / sum(weights[k % len(weights)] for k in range(len(sizes)) if k not in full) for i in range(len(sizes)) if i not in full}
        above = {i for i, t in open_.items() if t > most * sizes[i]}
        if not above:
            return [float(open_.get(i, most * z)) for i, z in enumerate(sizes)]
        full |= above
    return [float(most * z) for z in sizes]


@pytest.mark.parametrize("sizes", [[10, 10, 10], [5, 900, 30, 30, 1, 0, 77], [0, 0], [3], list(range(1, 40))])
def test_targets_fill_up(spark, sizes):
    rows = [(None if i == len(sizes) - 1 else f"s{i:03}", z) for i, z in enumerate(sizes)]
    df = spark.createDataFrame(rows, "_mix_source string, _mix_size long")
    for share in (1.5, 3):
        got = [r.target for r in mixing.targets(df, [3, 1, 2], share, 2).orderBy("source_id").collect()]
        assert got == pytest.approx(fill(sizes, [3, 1, 2], share))


def test_quotas_add_up_and_shards_are_even():
    quotas = np.array([100, 0, 37, 512])
    dealt = lambda: np.array([x for _, x in mixing.split_quotas(quotas, list(range(14)), 1)])
    assert (dealt().sum(axis=0) == quotas).all() and np.ptp(dealt().sum(axis=1)) <= 4 and (dealt() >= 0).all()
    assert (dealt() == dealt()).all()


def test_ten_thousand_shards_take_disjoint_runs(spark):
    quotas = {0: 25_000, 1: 3, 2: 0, 3: 9_000, 4: 700}
    df = spark.createDataFrame(list(quotas.items()), "source_id long, quota long")
    runs = mixing.shard_runs(df, 10_000, 7).collect()
    assert len(runs) <= sum(quotas.values()) and all(r.quota > 0 for r in runs)
    for source, n in quotas.items():
        mine = sorted((r.start, r.quota, r.shard) for r in runs if r.source_id == source)
        assert [x[0] for x in mine] == [sum(q for _, q, _ in mine[:i]) for i in range(len(mine))] if len(mine) < 50 else True
        assert sum(q for _, q, _ in mine) == n and [x[2] for x in mine] == sorted(x[2] for x in mine)
        ends = [x[0] + x[1] for x in mine]
        assert all(e == x[0] for e, x in zip(ends, mine[1:]))
    per = Counter()
    for r in runs:
        per[r.shard] += r.quota
    assert max(per.values()) <= 5 and sum(per.values()) == 34_703


@pytest.mark.parametrize("few", [True, False])
def test_small_blocks_runs_and_joins_give_a_whole_mix(spark, monkeypatch, few):
    """Blocks of 50 words, runs of 8 blocks and a tree of two steps, with and without broadcasts."""
    for name, value in (("BLOCKS", 4), ("BLOCK_WORDS", 50), ("RUN", 8), ("FAN", 4), ("BROADCAST_ROWS", 200_000 if few else 0)):
        monkeypatch.setattr(mixing, name, value)
    docs = spark.createDataFrame([(i, " ".join(["w"] * (i % 17)), "hot" if i % 3 else f"s{i % 5}") for i in range(1500)], "doc_id long, text string, source string")
    rows = mixing.plan(docs, [3, 1, 2], shards=16).collect()
    sizes, taken = {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.taken <= 2 * r.size and sum(c.words for c in r.copies) == r.taken
    names = sorted(sizes)
    assert len(rows) == 1500 and [taken[n] for n in names] == pytest.approx(fill([sizes[n] for n in names], [3, 1, 2]), abs=1)
    assert {c.shard for r in rows for c in r.copies} == set(range(16))


def test_mix_meets_its_targets(spark):
    rows = mixing.op5_mixing(spark, DATA).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    sums, sizes = {}, {}
    for r in rows:
        doc = docs[r.doc_id]
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", doc.text)) and 0 <= r.taken <= 2 * r.size
        sums[doc.source] = sums.get(doc.source, 0) + r.taken
        sizes[doc.source] = sizes.get(doc.source, 0) + r.size
    names = sorted(sizes)
    want = fill([sizes[n] for n in names], [3, 1, 2])
    assert {(r.source_size, round(r.target, 6)) for r in rows} == {(sizes[n], round(t, 6)) for n, t in zip(names, want)}
    assert all(abs(sums[n] - t) <= 1 for n, t in zip(names, want))
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.op5_mixing(spark, DATA).collect()))


def test_copies_are_what_is_taken(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    taken = {r.doc_id: r.taken for r in mixing.op5_mixing(spark, DATA).collect()}
    whole = {r.doc_id: r.text for r in docs.collect()}
    got = {}
    for r in mixing.mix(docs, [3, 1, 2]).collect():
        assert whole[r.doc_id].startswith(r.text)
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
    assert got == {k: v for k, v in taken.items() if v}


def test_shards_are_disjoint_runs(spark):
    rows = mixing.plan(spark.read.parquet(f"{DATA}/documents.parquet"), [3, 1, 2], shards=5).collect()
    counts = np.zeros(5)
    for r in rows:
        assert len(r.copies) <= 3 and sum(c.words for c in r.copies) == r.taken
        for c in r.copies:
            counts[c.shard] += 1
    assert counts.min() > 0.6 * counts.max()


def test_awkward_rows(spark):
    rows = mixing.plan(awkward(spark), [3, 1, 2]).collect()
    assert len(rows) == 11 and all(r.taken <= 2 * r.size for r in rows) and sum(r.taken for r in rows) > 0
    assert mixing.mix(awkward(spark), [3, 1, 2]).columns == awkward(spark).columns
    assert mixing.plan(empty(spark), [3, 1, 2]).count() == 0 and mixing.mix(empty(spark), [3]).count() == 0
