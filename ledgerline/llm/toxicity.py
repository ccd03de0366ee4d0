"""Toxicity by cumulative-link ordinal regression over sparse text features.

Features are the presence of a word and of its leading letters (so that inflected forms share one). A bounded sample of
labelled documents selects those that lean to toxic documents, by the likelihood ratio of their document
frequencies, and trains P(grade <= k) = logistic(threshold_k - w.x): one weight vector for all grades, ordered thresholds, proximal
gradient steps. Every document's severity is the expected grade.

Labels say toxic or not. Where they have no grades, these come from cross-fitting: the sample's documents are split into two halves
(documents that show the same features fall into the same one), a model of two grades is fitted to each half, and the toxic documents of the
other half are graded 1 to 3 by the terciles of its logits. So no document's grade comes from a model that has seen it. The model of four grades is
then fitted to all of them. Labels with grades are taken as they are. A document is flagged from the probability of a toxic grade that
CLEAN_FLAGGED of the sample's clean documents reach under the model of the other half.

Cases: null and empty texts show no feature and get the severity of an empty text; labels that are null, or whose document
is unknown, are ignored, and of contrary labels the higher counts; without labels of both kinds nothing is
flagged; repeated rows are scored one by one. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import text_slices

#: Most labelled documents that the model is fitted on, most features, fewest toxic documents that show a feature.
SAMPLE = 20_000
FEATURES = 4_000
SHOWN = 3
PREFIXES = (4, 5, 6)
#: A feature leans to toxic documents if it is so many times as frequent there, with so large a likelihood ratio.
LEAN, RATIO = 4.0, 10.0
#: Share of clean labelled documents that may be flagged, which gives the probability of any toxic grade from which a document is, and the
#: bounds of that probability.
CLEAN_FLAGGED = 0.005
FLAG_FROM, FLAG_TO = 0.05, 0.5
MEMO_WORDS = 300_000

_WORD = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}-" for n in PREFIXES if len(word) >= n)]


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def half_of(shown: list[int]) -> int:
    """The half of the sample that documents with these features belong to."""
    return zlib.crc32(np.array(shown, "<i4").tobytes()) & 1


class Model(NamedTuple):
    weights: dict[str, float]
    thresholds: list[float]
    flag: float = FLAG_TO

    def at_most(self, logit: float) -> np.ndarray:
        """P(grade <= k) for each threshold."""
        return 1 / (1 + np.exp(np.clip(logit - np.array(self.thresholds), -700, 700)))

    def expected(self, logit: float) -> float:
        return float(sum(1 - self.at_most(logit)))


class Scorer:
    """Logits of texts under a model; what words show is remembered for at most MEMO_WORDS words."""

    def __init__(self, model: Model):
        self.weights, self.memo = model.weights, {}

    def _shown(self, word: str) -> tuple[str, ...]:
        found = self.memo.get(word)
        if found is None:
            found = tuple(f for f in features_of(word) if f in self.weights)
            if len(self.memo) < MEMO_WORDS:
                self.memo[word] = found
        return found

    def shown(self, text: str | None) -> set[str]:
        return {f for w in words_of(text) for f in self._shown(w)}

    def logit(self, text: str | None) -> float:
        return sum(self.weights[f] for f in sorted(self.shown(text)))


def fit_ordinal(rows: list[list[int]], grades: np.ndarray, n_features: int, n_grades: int, steps: int = 400, l1: float = 2e-5, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights (not negative, as features are chosen to lean one way) and ascending thresholds."""
    sizes = np.array([len(x) for x in rows])
    col = np.fromiter((j for x in rows for j in x), np.int64, sizes.sum())
    row, n = np.repeat(np.arange(len(rows)), sizes), len(rows)
    w = np.zeros(n_features)
    share = np.clip(np.array([(grades <= k).mean() for k in range(n_grades - 1)]), 1e-4, 1 - 1e-4)
    cuts = np.log(share / (1 - share))
    gaps = np.r_[cuts[0], np.log(np.maximum(np.diff(cuts), 1e-3))]
    mw, vw, mg, vg = np.zeros_like(w), np.zeros_like(w), np.zeros_like(gaps), np.zeros_like(gaps)
    rate = 0.1
    for t in range(1, steps + 1):
        cuts = np.cumsum(np.r_[gaps[0], np.exp(gaps[1:])])
        logit = np.bincount(row, w[col], n)
        below = 1 / (1 + np.exp(-np.clip(cuts[None, :] - logit[:, None], -60, 60)))
        full = np.c_[np.zeros(n), below, np.ones(n)]
        slope = np.c_[np.zeros(n), below * (1 - below), np.zeros(n)]
        high, low = np.take_along_axis(slope, grades[:, None] + 1, 1)[:, 0], np.take_along_axis(slope, grades[:, None], 1)[:, 0]
        p = np.maximum(np.take_along_axis(full, grades[:, None] + 1, 1)[:, 0] - np.take_along_axis(full, grades[:, None], 1)[:, 0], 1e-12)
        gw = np.bincount(col, ((high - low) / p)[row], n_features) / n + l2 * w
        up = np.array([(high / p)[grades == k].sum() for k in range(n_grades - 1)])
        down = np.array([(low / p)[grades == k + 1].sum() for k in range(n_grades - 1)])
        by_cut = (down - up) / n
        tail = np.cumsum(by_cut[::-1])[::-1]
        gg = np.r_[tail[0], tail[1:] * np.exp(gaps[1:])]
        for x, g, m, v in ((w, gw, mw, vw), (gaps, gg, mg, vg)):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w[:] = np.maximum(w - rate * l1, 0)
    return w, np.cumsum(np.r_[gaps[0], np.exp(gaps[1:])])


def cross_graded(shown: list[list[int]], toxic: np.ndarray, n_features: int) -> np.ndarray:
    """0 for documents that aren't toxic, and 1 to 3 by the terciles of the logits that the other half's model gives the toxic ones;
    grades that nobody has are closed up. All toxic documents have grade 1 if a half lacks a kind."""
    half = np.array([half_of(x) for x in shown])
    logits = np.zeros(len(shown))
    for h in (0, 1):
        learn = np.flatnonzero(half == h)
        if len(set(toxic[learn].tolist())) < 2:
            return toxic.astype(np.int64)
        weights, _ = fit_ordinal([shown[i] for i in learn], toxic[learn].astype(np.int64), n_features, 2)
        for i in np.flatnonzero(half != h):
            logits[i] = weights[shown[i]].sum()
    low, high = np.quantile(logits[toxic], [1 / 3, 2 / 3])
    return np.unique(np.where(toxic, 1 + (logits > low) + (logits > high), 0), return_inverse=True)[1]


def flag_from(shown: list[list[int]], grades: np.ndarray, n_features: int) -> float:
    """The probability of a toxic grade that CLEAN_FLAGGED of the clean documents reach under the other half's model."""
    half, p = np.array([half_of(x) for x in shown]), np.zeros(len(shown))
    for h in (0, 1):
        learn, held = np.flatnonzero(half == h), np.flatnonzero(half != h)
        if len(set((grades[learn] > 0).tolist())) < 2:
            return FLAG_TO
        kinds, own = np.unique(grades[learn], return_inverse=True)
        weights, cuts = fit_ordinal([shown[i] for i in learn], own, n_features, len(kinds))
        logits = np.array([weights[shown[i]].sum() for i in held])
        p[held] = 1 - 1 / (1 + np.exp(np.clip(logits - cuts[0], -700, 700)))
    return float(np.clip(np.quantile(p[grades == 0], 1 - CLEAN_FLAGGED, method="higher"), FLAG_FROM, FLAG_TO))


def sample_labels(labels: DataFrame, sample: int) -> DataFrame:
    """(doc_id, grade): at most sample labelled documents, chosen by a hash of their ids."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("grade")).filter("doc_id IS NOT NULL AND grade >= 0")
    return rows.groupBy("doc_id").agg(F.max("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def select_features(texts: DataFrame, toxic: int, clean: int, most: int) -> list[str]:
    """The features of texts(text, grade) that lean most to toxic documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for part in text_slices(batches):
            for text, grade in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                counts[grade > 0].update({f for w in words_of(text) for f in features_of(w)})
        keys = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in counts)], names=["feature", "clean", "toxic"])

    counts = texts.select("text", "grade").mapInArrow(run, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("a"), F.sum("toxic").alias("b")).filter(F.col("b") >= SHOWN)
    rate = F.lit(toxic / (toxic + clean))
    term = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    both = F.col("a") + F.col("b")
    ratio = 2 * (term(F.col("b"), both * rate) + term(F.col("a"), both * (1 - rate)))
    leaning = counts.withColumn("ratio", ratio).filter((F.col("b") * clean > LEAN * F.col("a") * toxic) & (F.col("ratio") >= RATIO))
    return [x.feature for x in leaning.orderBy(F.desc("ratio"), "feature").limit(most).collect()]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_features: int = FEATURES, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model fitted on at most sample labelled documents of docs."""
    from ledgerline.llm.common import materialize

    chosen = F.broadcast(sample_labels(labels, sample))  # at most sample rows of two numbers
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(chosen, "doc_id").select("text", "grade")
    texts = materialize(texts, "toxicity-sample")
    sizes = {bool(x.toxic): x["count"] for x in texts.groupBy((F.col("grade") > 0).alias("toxic")).count().collect()}
    toxic, clean = sizes.get(True, 0), sizes.get(False, 0)
    if not toxic or not clean:
        return Model({}, [30.0])
    names = select_features(texts, toxic, clean, most_features)
    place = {f: i for i, f in enumerate(names)}
    sent = docs.sparkSession.sparkContext.broadcast(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(sent.value, []))
        for part in text_slices(batches):
            shown = [sorted(sent.value[f] for f in scorer.shown(x)) for x in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(shown, pa.list_(pa.int32())), part.column(1)], names=["shown", "grade"])

    rows = sorted((tuple(x.shown), x.grade) for x in texts.mapInArrow(run, "shown array<int>, grade int").collect())
    shown, grades = [list(x) for x, _ in rows], np.array([g for _, g in rows])
    grades = np.unique(grades, return_inverse=True)[1] if grades.max() > 1 else cross_graded(shown, grades > 0, len(names))
    weights, thresholds = fit_ordinal(shown, grades, len(names), int(grades.max()) + 1)
    flag = flag_from(shown, grades, len(names))
    return Model({f: float(w) for f, w in zip(names, weights) if w > 0}, [float(x) for x in thresholds], flag)


def severity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, expected_severity, p_toxic, grade, toxic): toxic is whether p_toxic is at least the model's flag; grade is the likeliest
    toxic grade of those documents, and 0 for others."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*sent.value)
        scorer = Scorer(model)
        for part in text_slices(batches):
            below = np.array([model.at_most(scorer.logit(x)) for x in part.column(1).to_pylist()])
            each = np.diff(np.c_[np.zeros(len(below)), below, np.ones(len(below))], axis=1)
            p = 1 - below[:, 0]
            toxic = p >= model.flag
            columns = [(1 - below).sum(axis=1), p, np.where(toxic, 1 + each[:, 1:].argmax(axis=1), 0).astype(np.int32), toxic]
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, columns)], names=["doc_id", "expected_severity", "p_toxic", "grade", "toxic"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, expected_severity double, p_toxic double, grade int, toxic boolean")


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return severity(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
