import math
import random
import re
from collections import Counter

import pytest

from ledgerline.llm import lexical
from tests.llm.helpers import awkward, empty

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate({ord(a): a.lower() for a in lexical.UPPER}))


def plain(docs, items, k):
    """Every document's score for every item, with no index."""
    held = [(i, Counter(terms(x))) for i, x in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for i, c in held:
            m = 25 + (75 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item_id, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def check(docs, items, k=10, **more):
    got = lexical.rank(docs, items, k, **more)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect()), key=repr) == plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], k)


def made(spark, n, seed):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(400)] + ["É", "e", "K"]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([1, 5, 20, 200])))) for i in range(n)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 12])))) for i in range(25)]
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block,group_terms,k", [(1, 10**6, 10), (4, 10**6, 3), (16, 20, 10), (128, 10**6, 1)])
def test_equals_scoring_every_document(spark, block, group_terms, k):
    docs, items = made(spark, 400, block)
    check(docs, items, k, block=block, group_terms=group_terms)


def test_blocks_beyond_the_broadcast_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BROADCAST_PAIRS", 0)
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", 50)
    monkeypatch.setattr(lexical, "ROWS", 2)
    docs, items = made(spark, 150, 9)
    check(docs, items, 4)


def test_most_blocks_are_never_scored(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"common filler text {i}") for i in range(2000)] + [(5000, "rare needle"), (5001, "needle needle")], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(1, "needle common")], "item_id long, text string")
    seen = []
    real = lexical._scores
    monkeypatch.setattr(lexical, "_scores", lambda blocks, pairs, *a: seen.append(pairs.count()) or real(blocks, pairs, *a))
    check(docs, items, 2, block=20)
    assert sum(seen) <= 4  # of 101 blocks


def test_awkward_rows(spark):
    items = spark.createDataFrame([(1, "one THREE café"), (1, "word1 word2"), (2, None), (3, ""), (4, "zzz"), (None, "one"), (5, "one " * 500)], "item_id long, text string").withColumn("block", lexical.F.lit("x"))
    check(awkward(spark), items)
    check(awkward(spark), items, block=1)
    assert lexical.rank(empty(spark), items).count() == 0
    assert lexical.rank(awkward(spark), items.limit(0)).count() == 0
    assert lexical.rank(awkward(spark), items.filter("item_id = 4")).count() == 0


def test_ties_go_by_id(spark):
    docs = spark.createDataFrame([(i, "same words here") for i in range(60, 0, -1)] + [(None, "same words here"), (100, "other")], "doc_id long, text string").repartition(5)
    items = spark.createDataFrame([(1, "words")], "item_id long, text string")
    check(docs, items, 10, block=3)
    check(docs, items, 100, block=3)
