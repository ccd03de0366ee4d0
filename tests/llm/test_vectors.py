import math

import numpy as np
import pytest

from ledgerline.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, n long, id long"


def plain(rows, threshold=0.95):
    """(n_links, component) by vec_id, comparing all pairs."""
    sound = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            sound.setdefault(i, np.array(v, np.float32).astype(float))
    ids = sorted(sound)
    links, label = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}
    pairs = []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sound[a], sound[b]
            if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                pairs.append((a, b))
                links[a] += 1
                links[b] += 1
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return {i: (links[i], label[i], i is not None and label[i] == i) for i, _ in rows}


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows], SCHEMA)
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df, **options).collect()}


def near_rows(rng, n, dim, spread):
    centres = rng.normal(size=(5, dim))
    return [(i, (centres[rng.integers(5)] + spread * rng.normal(size=dim)).tolist()) for i in range(n)]


@pytest.mark.parametrize("spread, interval, leaf, chunk", [(0.2, 32768, 128, 1024), (0.12, 7, 4, 3)])
def test_links_equal_all_pairs(spark, monkeypatch, spread, interval, leaf, chunk):
    for name, value in (("LEAF", leaf), ("INTERVAL_BYTES", interval * 8 * 8), ("CHUNK", chunk), ("FAN", 3)):
        monkeypatch.setattr(vectors, name, value)
    rng = np.random.default_rng(1)
    rows = near_rows(rng, 250, 8, spread)
    rows += [(1000 + i, rows[i][1]) for i in range(20)] + [(2000 + i, (3 * np.array(rows[0][1])).tolist()) for i in range(5)]
    want = plain(rows)
    assert any(n for n, *_ in want.values()) and found(spark, rows) == want


def test_wide_vectors_are_cut_by_bytes(spark, monkeypatch):
    """Vectors of 1,024 dimensions: an interval is bounded in bytes, so it holds few of them."""
    rng = np.random.default_rng(6)
    rows = near_rows(rng, 120, 1024, 0.2)
    monkeypatch.setattr(vectors, "INTERVAL_BYTES", 5 * 8 * 1024)
    df = spark.createDataFrame([(v, i, 1) for i, v in rows], "vec array<double>, node long, n long")
    intervals, count = vectors._intervals(df, 1024, vectors.principal_axes(df, 1024), math.sqrt(0.1))
    assert count == 24 and max(len(r.nodes) // 8 for r in intervals.select("nodes").collect()) <= 5
    assert found(spark, rows) == plain(rows)


def test_driver_table_equals_all_pairs(spark):
    data = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.op7_vectors(spark, "/root/testdata/sf0.01").collect()} == plain(data)


def test_awkward_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [math.nan, 1.0]), (7, [math.inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [2.0, 0.0])]
    got = found(spark, rows)
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[10] == (2, 1, False)
    assert all(got[i] == (0, i, True) for i in range(3, 10)) and got[None] == (0, None, False)
    assert found(spark, []) == {} and found(spark, [(5, [0.0])]) == {5: (0, 5, True)}


def test_rows_of_one_id_and_different_vectors_stay_apart(spark):
    df = spark.createDataFrame([(5, [1.0, 0.0]), (5, [0.0, 1.0]), (6, [1.0, 0.01]), (7, [0.01, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in vectors.near_vectors(df).collect())
    assert got == [(5, 1, 5), (5, 1, 5), (6, 1, 5), (7, 1, 5)]
    df = spark.createDataFrame([(5, [1.0, 0.0]), (5, [0.0, 1.0]), (4, [1.0, 0.01]), (7, [0.01, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in vectors.near_vectors(df).collect())
    assert got == [(4, 1, 4), (5, 1, 4), (5, 1, 5), (7, 1, 5)]


def test_far_intervals_are_skipped(spark):
    """Clusters far apart: intervals pair with their neighbours only, not with all."""
    rng = np.random.default_rng(3)
    centres = np.linalg.qr(rng.normal(size=(16, 16)))[0]
    rows = [(i, (centres[i % 16] + 0.01 * rng.normal(size=16)).tolist()) for i in range(1600)]
    df = spark.createDataFrame(rows, "vec_id long, vec array<double>").selectExpr("vec", "vec_id node", "1L n")
    axes, eps = vectors.principal_axes(df, 16), math.sqrt(0.1)
    intervals, count = vectors._intervals(df, 16, axes, eps)
    pairs = vectors._near_intervals(intervals, count, eps).collect()
    assert count == 16 and len(pairs) < 60 and {(r.l, r.r) for r in pairs} >= {(i, i) for i in range(16)}
