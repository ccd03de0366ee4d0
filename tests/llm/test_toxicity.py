import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import toxicity
from tests.llm.helpers import awkward, empty

DATA = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    part = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(4))
    model = toxicity.fit(docs, labels.filter(part != 0))
    assert len(model.thresholds) == 3 and model.thresholds == sorted(model.thresholds)
    # toxic documents of quality 0 had their words replaced by junk: nothing in them tells that they were toxic
    told = labels.filter((part == 0) & ~((F.col("toxic") == 1) & (F.col("quality") == 0)))
    found = toxicity.severity(docs, model).join(told.select("doc_id", F.col("toxic").alias("label")), "doc_id").collect()
    hit = [r.toxic for r in found if r.label == 1]
    miss = [r.toxic for r in found if r.label == 0]
    assert np.mean(hit) > 0.95 and np.mean(miss) < 0.01
    assert np.mean([r.expected_severity for r in found if r.label == 1]) > 10 * np.mean([r.expected_severity for r in found if r.label == 0])


def test_ordinal_fit_recovers_an_order():
    rng = np.random.default_rng(0)
    rows, grades = [], []
    for _ in range(600):
        shown = sorted(rng.choice(6, rng.integers(0, 4), replace=False).tolist())
        rows.append(shown)
        grades.append(min(2, sum(x < 3 for x in shown)))
    w, cuts = toxicity.fit_ordinal(rows, np.array(grades), 6, 3)
    assert w[:3].min() > 2 * w[3:].max() and cuts[0] < cuts[1]


def test_probabilities_of_grades():
    model = toxicity.Model({"bad": 3.0}, [1.0, 2.0])
    below = model.at_most(3.0)
    assert (np.diff(np.r_[0, below, 1]) > 0).all() and abs(model.expected(3.0) - sum(1 - below)) < 1e-12


def test_held_out_ordinal_error(spark):
    """Documents that took no part are graded by a model of their own kind (fitted to them alone) and predicted by the one under test."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    part = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2))
    told = labels.filter(~((F.col("toxic") == 1) & (F.col("quality") == 0)))
    model, other = toxicity.fit(docs, told.filter(part != 0)), toxicity.fit(docs, told.filter(part == 0))
    rows = docs.join(told.filter(part == 0), "doc_id").select("text", "toxic").collect()
    scorers = [toxicity.Scorer(m) for m in (model, other)]
    toxic = np.array([r.toxic == 1 for r in rows])
    mine, theirs = (np.array([m.expected(s.logit(r.text)) for r in rows]) for m, s in zip((model, other), scorers))
    error, flat = np.abs(mine - theirs)[toxic].mean(), np.abs(np.median(theirs[toxic]) - theirs)[toxic].mean()
    print("held-out mean absolute error of toxic documents' severity", round(error, 3), "always the median", round(flat, 3), "all documents", round(np.abs(mine - theirs).mean(), 4))
    assert error < 0.6 * flat and np.abs(mine - theirs).mean() < 0.05


def test_grades_come_from_models_that_have_not_seen_the_document(monkeypatch):
    rng, seen = np.random.default_rng(2), []
    shown = [sorted(rng.choice(12, rng.integers(0, 6), replace=False).tolist()) for _ in range(300)]
    toxic = np.array([sum(x < 6 for x in s) > 1 for s in shown])
    real = toxicity.fit_ordinal
    monkeypatch.setattr(toxicity, "fit_ordinal", lambda rows, *a, **b: seen.append({tuple(r) for r in rows}) or real(rows, *a, **b))
    grades = toxicity.cross_graded(shown, toxic, 12)
    assert len(seen) == 2 and not seen[0] & seen[1] and seen[0] | seen[1] == {tuple(s) for s in shown}
    assert set(grades[~toxic]) == {0} and set(grades[toxic]) == {1, 2, 3}


def test_severity_equals_plain_python(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    assert model.weights
    docs = docs.select("doc_id", "text").unionByName(awkward(spark).select((F.col("doc_id") + 10**6).alias("doc_id"), "text").filter("doc_id is not null").distinct())
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.severity(docs, model).collect():
        words = set("".join(c if c.isalpha() else " " for c in (texts[r.doc_id] or "").lower()).split())
        shown = {f for w in words for f in [w, *(w[:n] + "-" for n in (4, 5, 6) if len(w) >= n)] if f in model.weights}
        below = [1 / (1 + math.exp(sum(model.weights[f] for f in shown) - cut)) for cut in model.thresholds]
        each = [b - a for a, b in zip([0.0, *below], [*below, 1.0])]
        assert r.expected_severity == pytest.approx(sum(1 - x for x in below), abs=1e-9) and r.p_toxic == pytest.approx(1 - below[0], abs=1e-9)
        assert r.toxic == (r.p_toxic >= model.flag) == (r.grade > 0) and (not r.toxic or each[r.grade] == pytest.approx(max(each[1:])))


def test_awkward_rows_and_missing_labels(spark):
    none = spark.createDataFrame([(5, None), (None, 1), (999, 1)], "doc_id long, toxic int")
    rows = toxicity.severity(awkward(spark), toxicity.fit(awkward(spark), none)).collect()
    assert len(rows) == 11 and not any(r.toxic for r in rows)
    assert toxicity.severity(empty(spark), toxicity.fit(empty(spark), none)).count() == 0
