import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerline.llm import simhash
from tests.llm.helpers import awkward, by_id, empty


def slow_fingerprint(text, k):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    parts = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps, distance):
    """Smallest index reachable over fingerprints within distance."""
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i, x in enumerate(fps):
            for j, y in enumerate(fps):
                if (x ^ y).bit_count() <= distance and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_fingerprints_and_awkward_rows(spark):
    docs = awkward(spark)
    found = simhash.fingerprints(docs).collect()
    want = sorted((r.doc_id or -1, slow_fingerprint(r.text, 3)) for r in docs.collect())
    assert sorted((r.doc_id or -1, r.fp % 2**64) for r in found) == want
    comp = by_id(simhash.near_duplicates(docs), "component_id")
    assert comp[1] == comp[2] == comp[3] == (1,) and comp[5] == comp[6] == (5,) and comp[4] == (4,)
    assert simhash.near_duplicates(empty(spark)).count() == 0


def links_of(spark, fps, distance, segments):
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    return [(r.a % 2**64, r.b % 2**64) for r in simhash.near_links(df, distance, segments).collect()]


def test_links_join_what_brute_force_joins(spark, monkeypatch):
    rng = random.Random(1)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for x in list(fps):
        for _ in range(3):
            for b in rng.sample(range(64), rng.randrange(1, 7)):
                x ^= 1 << b
            fps.append(x)
    fps = list(dict.fromkeys(fps))
    for distance in (3, 5):
        links = links_of(spark, fps, distance, 2)
        assert all((a ^ b).bit_count() <= distance for a, b in links)
        at, up = {x: i for i, x in enumerate(fps)}, list(range(len(fps)))

        def root(i):
            while up[i] != i:
                i = up[i]
            return i

        for a, b in links:
            a, b = root(at[a]), root(at[b])
            up[max(a, b)] = min(a, b)
        assert [root(i) for i in range(len(fps))] == slow_components(fps, distance)


def test_hot_keys_are_dealt_out_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    monkeypatch.setattr(simhash, "HOT_SAMPLE", 2)
    rng = random.Random(2)
    high = rng.getrandbits(32) << 32  # one half in common
    fps = list({high | rng.getrandbits(7) << rng.randrange(20) for _ in range(150)})
    links = links_of(spark, fps, 3, 2)
    up = {x: x for x in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    label = slow_components(fps, 3)
    groups = {}
    for x, k in zip(fps, label):
        groups.setdefault(k, set()).add(root(x))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_one_of_each_group_stays(spark):
    docs = spark.createDataFrame([(3, "a b c d e f g"), (1, "a b c d e f g"), (2, "something else entirely this is"), (None, "a b c d e f g"), (2, "something else entirely this is")], "doc_id long, text string")
    assert sorted((r.doc_id or 0 for r in simhash.keep_one_each(docs).collect())) == [1, 2]


def slow_similar(texts, size, similarity):
    """Smallest index reachable over links of an exact Jaccard similarity of the sets of shingles."""
    words = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set() for w in words]
    label, changed = list(range(len(sets))), True
    linked = [(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets[:i]) if len(x & y) >= similarity * len(x | y)]
    while changed:
        changed = False
        for i, j in linked:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    return label


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.randrange(10**9)}"
    return words


def near_copies(rng):
    """Chains of edited copies with similarities on both sides of 0.8, and documents that share a long passage only."""
    texts = []
    for _ in range(25):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 400))]
        texts.append(" ".join(words))
        for _ in range(4):
            words = edited(rng, words, max(1, round(len(words) * rng.choice([0.01, 0.015, 0.02, 0.025, 0.03, 0.04]))))
            texts.append(" ".join(words))
    passage = [f"p{i}" for i in range(70)]
    return texts + [" ".join(passage + [f"q{rng.randrange(10**6)}" for _ in range(30)]) for _ in range(12)]


def test_near_copies_of_the_contract_go_and_others_stay(spark, monkeypatch):
    texts = near_copies(random.Random(5))
    want = slow_similar(texts, 5, 0.8)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (4096, 8, 2):
        monkeypatch.setattr(simhash, "BLOCK", block)
        monkeypatch.setattr(simhash, "HOT_SAMPLE", min(64, block // 2))
        assert sorted(r.doc_id for r in simhash.keep_one_each(docs).collect()) == sorted(set(want))


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    one, two = (" ".join(f"{x}{i}" for i in range(80)) for x in "ab")
    docs = spark.createDataFrame([(1, one), (2, one), (2, two), (3, two + " end"), (3, "other " * 9)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in simhash.keep_one_each(docs).collect()) == sorted([(1, one), (2, two), (3, "other " * 9)])


def test_keeps_empty_tables_and_awkward_rows(spark):
    assert simhash.keep_one_each(empty(spark)).columns == empty(spark).columns and simhash.keep_one_each(empty(spark)).count() == 0
    assert sorted(r.doc_id or 0 for r in simhash.keep_one_each(awkward(spark)).collect()) == [0, 1, 4, 5, 7, 8, 9]


@pytest.mark.parametrize("distance, segments", [(3, 2), (5, 2), (4, 3)])
def test_parts_of_the_rest_agree_for_close_fingerprints(spark, distance, segments):
    rng = random.Random(8)
    for segment in range(segments):
        low, high = 64 * segment // segments, 64 * (segment + 1) // segments
        outside = [b for b in range(64) if not low <= b < high]
        fps = [rng.getrandbits(64) for _ in range(40)]
        near = [x ^ sum(1 << b for b in rng.sample(outside, distance)) for x in fps]
        both = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps + near], "fp long").select("fp", simhash._parts_of_rest(segment, distance, segments).alias("parts"))
        of = {r.fp % 2**64: r.parts for r in both.collect()}
        assert all(len(of[x]) == distance + 1 and min(of[x]) > 0 and set(of[x]) & set(of[y]) for x, y in zip(fps, near))
        assert all(len(set(of[x])) == distance + 1 for x in fps)


def test_a_hot_key_grows_in_proportion(spark, monkeypatch):
    """Rows of a forced hot key: no more than a few for each member, and no large group in one task."""
    monkeypatch.setattr(simhash, "BLOCK", 64)
    monkeypatch.setattr(simhash, "HOT_SAMPLE", 4)
    rng = random.Random(9)
    high = rng.getrandbits(32) << 32
    for n in (1000, 4000):
        df = spark.createDataFrame([(int(np.uint64(high | x).astype(np.int64)),) for x in rng.sample(range(1 << 32), n)], "fp long")
        for distance in (3, 5):
            probes = simhash._probes(df, distance, 2)
            dealt = simhash._dealt(probes, distance, 2)
            assert dealt.count() <= (distance + 3) * probes.count()
            assert dealt.groupBy("key", "part", "i", "j").count().agg({"count": "max"}).first()[0] <= 300


def test_groups_are_whole_and_few_wait():
    keys = [0] * 3 + [1] * 5 + [2] + [3] * 4 + [4, 5, 6, 7]
    table = [pa.array(np.array(keys)), pa.array(np.arange(len(keys)))]
    for size in (1, 2, 3, 20):
        batches = pa.Table.from_arrays(table, names=["k", "x"]).to_batches(max_chunksize=size)
        got = list(simhash.whole_groups(iter(batches), 1))
        assert np.concatenate(got)[:, 1].tolist() == list(range(len(keys)))
        ends = [(set(a[:, 0]), set(b[:, 0])) for a, b in zip(got, got[1:])]
        assert all(not a & b for a, b in ends) and max(map(len, got)) <= max(5, size + 5)


@pytest.mark.parametrize("n", [30, 200, 3000])
def test_fine_sketches_let_pairs_of_the_contract_through_and_few_others(n):
    rng, passed = random.Random(n), {0.81: 0, 0.6: 0}
    for share, k in [(s, k) for s in passed for k in range(200)]:
        common = [f"c{k}-{i}" for i in range(round(n * share))]
        texts = [" ".join(common + [f"{x}{k}-{i}" for i in range((n - len(common)) // 2)]) for x in "ab"]
        fine = [np.frombuffer(simhash.sketch(x, 1)[3], np.uint8) for x in texts]
        passed[share] += bool(simhash.may_be_similar(fine[0][None], fine[1], 0.8)[0])
    assert passed[0.81] == 200 and passed[0.6] < (60 if n < 100 else 5)


def test_candidates_are_those_that_agree_in_a_segment_of_the_wide_fingerprint(spark, monkeypatch):
    """With fingerprints that have no segment in common there are no candidates, however alike the texts are; with those of the texts all are met."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(edited(rng, words, 1)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for dense in (4, 0):  # pairs all at once, or few first and the rest in the second round
        monkeypatch.setattr(simhash, "DENSE", dense)
        assert simhash.keep_one_each(docs).count() == 1
    sketches = simhash.sketches

    def apart(*args):
        own = (F.monotonically_increasing_id() % 65536).cast("int")
        word = F.conv(F.repeat(F.lpad(F.hex(own), 4, "0"), 4), 16, -10).cast("long")
        return sketches(*args).withColumn("wide", F.array_repeat(word, simhash.WIDE // 64))

    monkeypatch.setattr(simhash, "sketches", apart)
    kept = simhash.keep_one_each(docs.coalesce(1)).count()
    assert kept == len(texts)


def test_similarity_at_the_bound_is_met_at_any_size():
    """Sets of an exact similarity of 0.8: fingerprints stay within the radius and agree in a segment, as calculated."""
    rng, missed = np.random.default_rng(12), 0
    for n, m in [(8, 1), (80, 10), (320, 40), (1600, 200)] * 25:
        x = rng.integers(0, 1 << 63, n + 2 * m, dtype=np.uint64)
        a, b = simhash.majority(x[: n + m]), simhash.majority(np.r_[x[:n], x[n + m :]])
        assert np.bitwise_count(a ^ b).sum() <= simhash.RADIUS and np.bitwise_count(a[: simhash.SHORT] ^ b[: simhash.SHORT]).sum() <= simhash.SHORT_RADIUS
        missed += not (a.view(np.uint16) == b.view(np.uint16)).any()
    assert missed == 0


def test_close_pairs_are_those_of_brute_force():
    rng = np.random.default_rng(13)
    place = np.sort(rng.integers(0, 12, 80))
    bits = rng.integers(0, 1 << 63, (80, 2), dtype=np.uint64)
    i, j = simhash._close(place, bits, 62)
    want = {(x, y) for y in range(80) for x in range(y) if place[x] == place[y] and int(np.bitwise_count(bits[x] ^ bits[y]).sum()) <= 62}
    assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want) > 0


def joined_rows(spark, run):
    """Rows that the joins of the queries that run makes give out by node, as Spark counts them."""
    store = spark._jsparkSession.sharedState().statusStore()
    listed = lambda: [store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())]
    before, total = set(listed()), 0
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    for k in set(listed()) - before:
        values = {int(x._1()): x._2() for x in (lambda s: [s.apply(i) for i in range(s.size())])(store.executionMetrics(k).toSeq())}
        nodes = store.planGraph(k).allNodes()
        for node in map(nodes.apply, range(nodes.size())):
            metrics = [node.metrics().apply(i) for i in range(node.metrics().size())]
            if "Join" in node.name() and "[node" in node.desc():
                total += sum(int(values[m.accumulatorId()].replace(",", "")) for m in metrics if m.name() == "number of output rows" and m.accumulatorId() in values)
    return total


@pytest.mark.parametrize("n", [40, 160])
def test_the_second_round_joins_once_a_node(spark, n):
    """Members of many keys: what is joined by node grows with the nodes and not with their keys, and all pairs of differing roots that may be similar are told, no others."""
    keys = 128
    nodes = spark.createDataFrame([(i, [1 << i % 8, 0], bytes([1 + i % 2]) * simhash.BINS) for i in range(n)], "node long, wide array<long>, fine binary")
    roots = nodes.select("node", F.when(F.col("node") % 20 == 0, F.col("node")).otherwise(F.lit(1)).alias("root"))
    groups = nodes.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(keys - 1).cast("long"))).alias("key"), "node")
    found = []
    assert 0 < joined_rows(spark, lambda: found.extend(simhash._second_round(groups, nodes, roots, 0.8).distinct().collect())) <= 4 * n
    root = {r.node: r.root for r in roots.collect()}
    assert {(r.a, r.b) for r in found} == {(a, b) for b in range(n) for a in range(b) if root[a] != root[b] and (a - b) % 2 == 0}  # sketches of the others have nothing in common


def rows_made(spark, run):
    """The most rows that a join or a Python step of the queries that run makes gave out, by name, all queries added up."""
    store = spark._jsparkSession.sharedState().statusStore()
    listed = lambda: [store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())]
    before, made = set(listed()), {}
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    for k in set(listed()) - before:
        values = {int(x._1()): x._2() for x in (lambda s: [s.apply(i) for i in range(s.size())])(store.executionMetrics(k).toSeq())}
        nodes = store.planGraph(k).allNodes()
        for node in map(nodes.apply, range(nodes.size())):
            if "Join" in node.name() or "Arrow" in node.name():
                name = re.sub(r"#\d+L?|^\w+ |, Build\w+", "", node.desc())[:60]
                for m in map(node.metrics().apply, range(node.metrics().size())):
                    if m.name() == "number of output rows" and m.accumulatorId() in values:
                        made[name] = made.get(name, 0) + int(values[m.accumulatorId()].replace(",", ""))
    return {k: v for k, v in made.items() if "run(place" not in k}  # the first round's: so many a member and key


def about_as_similar_as_the_bound(n, seed=14):
    """Texts with edits of their own, most pairs of which are a little less similar than 0.8, and some more."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    return [" ".join(edited(rng, words, rng.choice([3, 8, 8, 8, 8, 8, 9, 9]))) for _ in range(n)]


@pytest.mark.parametrize("n", [150, 450])
def test_texts_about_as_similar_as_the_bound_make_no_row_a_pair(spark, n):
    """Neither joins nor Python steps give out rows for pairs that are no links: so many a text at most, and not the square of their number."""
    docs = spark.createDataFrame(list(enumerate(about_as_similar_as_the_bound(n))), "doc_id long, text string").localCheckpoint()
    made = rows_made(spark, lambda: simhash.keep_one_each(docs).count())
    assert max(made.values()) <= 100 * n, made


@pytest.mark.parametrize("block, hashes", [(4096, 1 << 20), (64, 1 << 14), (8, 1 << 11)])
def test_groups_that_meet_with_their_sets_are_those_of_brute_force(spark, monkeypatch, block, hashes):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "HASHES", hashes)
    monkeypatch.setattr(simhash, "JOINS", 1)  # most is left to the second round
    texts = about_as_similar_as_the_bound(120) + ["", "one two", "one two three four five"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r.doc_id for r in simhash.keep_one_each(docs).collect())
    assert kept == sorted(set(slow_similar(texts, 5, 0.8))) and len(kept) > 3


@pytest.mark.parametrize("block", [4096, 16])
def test_the_second_round_tells_nodes_and_joined_roots(spark, monkeypatch, block):
    """Without pairs: the nodes that have a partner of another root, and as few pairs of roots as join what all pairs join."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    n = 60
    nodes = spark.createDataFrame([(i, [1 << i % 8, 0], bytes([1 + i % 2 if i < 50 else i]) * simhash.BINS) for i in range(n)], "node long, wide array<long>, fine binary")
    roots = nodes.select("node", (F.col("node") - F.col("node") % 4 % 2).alias("root"))
    groups = nodes.select(F.explode(F.array(F.lit(7).cast("long"), F.lit(9).cast("long"))).alias("key"), "node")
    told = simhash._second_round(groups, nodes, roots, 0.8, pairs=False).distinct().collect()
    root = {r.node: r.root for r in roots.collect()}
    assert {(r.a, r.b) for r in told if r.kind == simhash.MEMBER} == {(i, root[i]) for i in range(50)}
    label = {x: x for x in root.values()}
    for r in told:
        if r.kind == simhash.JOIN:
            label = {x: label[r.a] if y == label[r.b] else y for x, y in label.items()}
    want = {x: x for x in root.values()}
    for a in range(50):
        for b in range(a):
            if (a - b) % 2 == 0:
                want = {x: want[root[a]] if y == want[root[b]] else y for x, y in want.items()}
    alike = lambda of: {frozenset(x for x in of if of[x] == y) for y in set(of.values())}
    assert alike(label) == alike(want)
