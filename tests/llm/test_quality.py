import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import quality
from tests.llm.helpers import awkward, empty

DATA = "/root/testdata/sf0.1"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@pytest.mark.parametrize("short", [1 << 20, 3])
def test_counts_equal_plain_python(spark, monkeypatch, short):
    monkeypatch.setattr(quality, "SHORT", short)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").unionByName(awkward(spark).select("doc_id", "text", "lang", "source", "n_chars").filter("doc_id is not null").withColumn("doc_id", F.col("doc_id") + 10**6).distinct())
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.statistics(docs).collect():
        assert tuple(r[c] for c in COUNTS) == plain(text[r.doc_id]), r.doc_id


@pytest.mark.parametrize("n, k, p", [(10, 0, 0.1), (200, 3, 0.02), (5000, 40, 0.01), (7, 7, 0.5), (30, 12, 0.3)])
def test_binomial_tail(spark, n, k, p):
    got = spark.range(1).select(quality.log_binomial_tail(F.lit(n), F.lit(k), p).alias("x")).first().x
    assert got == pytest.approx(math.log(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))), rel=1e-9, abs=1e-9)


def test_windows_whose_hashes_agree_in_part_are_told_apart(spark, monkeypatch):
    """With the hash cut to a few values, windows interleave under one key; the wider form must take over."""
    real = F.xxhash64
    monkeypatch.setattr(quality.F, "xxhash64", lambda *c: real(*c).bitwiseAND(F.lit(0xF00000000000007)))
    texts = [" ".join(f"w{(i * i) % 23}" for i in range(n)) for n in (40, 90, 200)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    hashed = docs.select("doc_id", quality._let(F.split("text", " "), lambda w: quality._repeat_words(w, F.size(w))).alias("n"), quality._let(F.split("text", " "), lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: quality.F.xxhash64(w[i], w[i + 1], w[i + 2]))).alias("h"))
    for r in hashed.collect():
        seen = Counter(r.h)
        assert r.n == len({i + k for i, h in enumerate(r.h) if seen[h] > 1 for k in range(3)})


def slow_tail(n, k, p):
    return math.log(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def slow_paths(rows, alpha, delta):
    """{stratum: [(rule, cutoff)]} of rows (stratum, quality, held, statistics)."""
    strata = {}
    for r in rows:
        strata.setdefault(r[0], []).append(r)
    n = {k: sum(q for _, q, held, _ in v if held) for k, v in strata.items() if any(r[2] for r in v)}
    able = lambda n, paths: n * math.log(1 - alpha) <= math.log(delta / paths)
    few = [k for k in n if not able(n[k], len(n))]
    paths = len(n) - len(few) + 1 if few else len(n)
    if few and not able(sum(n[k] for k in few), paths):
        few, paths = list(n), 1
    groups = [([k], strata[k]) for k in n if k not in few] + ([(few, [r for k in few for r in strata[k]])] if few else [])
    out = {}
    for names, members in groups:
        tuning, held = [r for r in members if not r[2]], [r for r in members if r[2] and r[1]]
        good, found = sum(q for _, q, _, _ in tuning), []
        for i, (rule, grid) in enumerate(quality.RULES.items()):
            best = None
            for cut in grid:
                bad, lost = (sum(s[rule] > cut and q == v for _, q, _, s in tuning) for v in (0, 1))
                if bad and lost <= alpha * good and (best is None or bad > best[0]):
                    best = (bad, lost, cut)
            if best:
                found.append((best[1], -best[0], i, rule, best[2]))
        path = []
        for *_, rule, cut in sorted(found):
            lost = sum(any(s[r] > c for r, c in [*path, (rule, cut)]) for *_, s in held)
            if slow_tail(len(held), lost, alpha) > math.log(delta / paths):
                break
            path.append((rule, cut))
        out |= {k: path for k in names}
    return out


@pytest.mark.parametrize("folder, alpha", [("sf0.1", None), ("sf0.01", None), ("sf0.1", 0.01), ("sf0.001", None)])
def test_verdicts_equal_plain_python(spark, folder, alpha):
    docs, labels = (spark.read.parquet(f"/root/testdata/{folder}/{t}.parquet") for t in ("documents", "labels"))
    stats = quality.materialize(quality.statistics(docs), "test-stats")
    marks = {(r.doc_id, r.quality) for r in labels.collect() if r.quality in (0, 1)}
    half = {r.doc_id: r.held for r in docs.select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1).alias("held")).collect()}
    every = {r.doc_id: r for r in stats.collect()}
    fails = lambda r: r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
    rows = [(every[i].stratum, q, half[i], every[i]) for i, q in marks if i in every and not fails(every[i])]
    options = {} if alpha is None else {"alpha": alpha}
    paths = slow_paths(rows, alpha or quality.ALPHA, quality.DELTA)
    kept = {r.doc_id: r.kept for r in quality.verdicts(docs, labels, **options).collect()}
    assert kept == {i: not fails(r) and not any(r[rule] > cut for rule, cut in paths.get(r.stratum, [])) for i, r in every.items()}
    assert sorted(r.doc_id for r in quality.keep_good(docs, labels, **options).collect()) == sorted(i for i, k in kept.items() if k)
    if folder == "sf0.1":
        assert all(paths[x] for x in ("en", "de", "es", "fr"))


def test_a_stratum_of_300_good_labels_has_rules_and_the_bound_holds(spark):
    """On labels that took no part: documents whose parity of a second hash is odd have theirs taken away."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    some = labels.withColumn("part", F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(3)))
    rows = quality.verdicts(docs, some.filter("part > 0")).join(some.filter("part = 0"), "doc_id").join(docs.select("doc_id", "lang"), "doc_id").filter("not base_failed")
    kept = {(r.lang, r.quality): r.kept for r in rows.groupBy("lang", "quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()}
    assert all(v >= 1 - quality.ALPHA if q else v < 0.1 for (_, q), v in kept.items()) and len(kept) == 8


def test_rows_are_judged_one_by_one(spark):
    good = " ".join(f"word{i}" for i in range(80))
    docs = spark.createDataFrame([(1, good, "en", 5.0), (1, "short", "en", 6.0), (None, "short", "en", 7.0), (None, good, None, 8.0)], "doc_id long, text string, lang string, n_words double")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert sorted((r.doc_id or 0, r.n_words) for r in quality.keep_good(docs, labels).collect()) == [(0, 8.0), (1, 5.0)]


def test_awkward_rows(spark):
    labels = spark.createDataFrame([(7, 1), (7, None), (None, 0), (999, 1)], "doc_id long, quality int")
    rows = quality.verdicts(awkward(spark), labels).collect()
    assert len(rows) == 11 and all(r.base_failed for r in rows if (r.doc_id or 0) in (1, 2, 3, 4, 5, 6, 9))
    assert quality.verdicts(empty(spark), labels.limit(0)).count() == 0
    assert quality.keep_good(awkward(spark), labels).columns == awkward(spark).columns


def test_strata_with_few_labels_are_pooled(spark):
    good, bad = ([" ".join(f"{w}{i}" for i in range(60)) for w in ws] for ws in ("abcdefgh", "ABCDEFGH"))
    rows = [(i, t, lang, q) for i, (t, lang, q) in enumerate([(t, lang, q) for lang in ("x", "y") for q, ts in ((1, good * 10), (0, bad * 3)) for t in ts] + [(good[0], "z", 1)] * 800 + [(bad[0], "z", 0)] * 9 + [(bad[0], "u", None)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    docs = docs.withColumn("text", F.when(F.col("quality").isNull() | (F.col("quality") == 0), F.concat("text", F.repeat(F.lit(" |!"), F.lit(40)))).otherwise(F.col("text")))
    rejected = lambda alpha: {(r.lang, r.quality) for r in quality.verdicts(docs, docs.select("doc_id", "quality"), alpha=alpha).filter("not kept and not base_failed").join(docs.select("doc_id", "lang", "quality"), "doc_id").collect()}
    # z certifies alone; x and y (80 good each, about half of them held out) do together at 0.06, with z's at 0.02, and nothing does at 0.001
    assert rejected(0.06) == rejected(0.02) == {("x", 0), ("y", 0), ("z", 0)} and rejected(0.001) == set()
