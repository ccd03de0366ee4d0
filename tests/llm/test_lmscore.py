import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from ledgerline.llm import lmscore
from tests.llm.helpers import awkward, empty

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def ways(text, pieces, byte_logs):
    """Sum of probabilities over all segmentations, by recursion over the first piece."""
    if not text:
        return 1.0
    total = sum(math.exp(pieces[text[:n]]) * ways(text[n:], pieces, byte_logs) for n in range(1, len(text) + 1) if text[:n] in pieces)
    if text[0] not in pieces:
        total += math.exp(sum(byte_logs[b] for b in text[0].encode())) * ways(text[1:], pieces, byte_logs)
    return total


def test_lattice_sums_all_segmentations():
    pieces = {x: math.log(p) for x, p in {"▁": 0.1, "a": 0.2, "b": 0.1, "ab": 0.15, "▁a": 0.05, "ba": 0.1, "▁ab": 0.02}.items()}
    lattice = lmscore.Lattice(pieces, [math.log(1e-3)] * 256)
    for word in ("a", "ab", "abab", "bé", "", "aéb"):
        assert lattice.log10(word) == pytest.approx(math.log10(ways("▁" + word, pieces, lattice.byte_logs)))


def every(text, pieces, byte_logs):
    """All segmentations of a text: (probability, pieces, bytes)."""
    if not text:
        yield 1.0, [], []
        return
    for n in range(1, len(text) + 1):
        if text[:n] in pieces:
            for p, used, spelt in every(text[n:], pieces, byte_logs):
                yield math.exp(pieces[text[:n]]) * p, [text[:n], *used], spelt
    if text[0] not in pieces:
        raw = list(text[0].encode())
        for p, used, spelt in every(text[1:], pieces, byte_logs):
            yield math.exp(sum(byte_logs[b] for b in raw)) * p, used, [*raw, *spelt]


@pytest.mark.parametrize("chars", [40, 0])
def test_expected_counts_weight_every_segmentation(monkeypatch, chars):
    monkeypatch.setattr(lmscore, "ARRAY_CHARS", chars)
    pieces = {x: math.log(p) for x, p in {"▁": 0.1, "a": 0.2, "b": 0.1, "ab": 0.15, "▁a": 0.05, "ba": 0.1, "▁ab": 0.02, "aba": 0.03}.items()}
    lattice = lmscore.Lattice(pieces, [math.log(1e-3)] * 256)
    words, times = ["a", "ab", "abab", "bé", "ééa", "baba", "ab", "x"], np.array([3, 1, 2, 5, 1, 7, 2, 4])
    want, spelt = Counter(), Counter()
    for word, n in zip(words, times):
        ways = list(every("▁" + word, pieces, lattice.byte_logs))
        total = sum(p for p, *_ in ways)
        assert lattice.log10s([word])[0] == pytest.approx(math.log10(total)) == pytest.approx(lattice.log10(word))
        for p, used, raw in ways:
            for x in used:
                want[x] += n * p / total
            for x in raw:
                spelt[x] += n * p / total
    counts, of_bytes = lattice.expect(words, times)
    assert dict(zip(pieces, counts)) == pytest.approx({x: want[x] for x in pieces}) and dict(enumerate(of_bytes)) == pytest.approx({b: spelt[b] for b in range(256)})


def plain(rows):
    """(doc_id, text) scored without Spark, one word after the other."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    split = [(i, lmscore.words_of(t)) for i, t in rows]
    train = Counter(w.decode() for i, ws in split if not held(i) for w in ws)
    docs = sum(not held(i) for i, _ in split)
    n, v = sum(train.values()) + docs, len(train) + (docs > 0)
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    usable = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
    ranks = {x: r for r, x in enumerate(sorted({sp.get_score(i) for i in usable}, reverse=True))}
    guess = {sp.id_to_piece(i): 1 / (ranks[sp.get_score(i)] + 2) for i in usable}
    least, mean = min(guess.values()), sum(guess.values()) / len(guess)
    total = sum(guess.values()) + 256 * least + mean
    logs, of_bytes, end = {k: math.log(x / total) for k, x in guess.items()}, [math.log(least / total)] * 256, 0.0
    for _ in range(lmscore.ROUNDS):
        lattice = lmscore.Lattice(logs, of_bytes)
        counts, spelt = np.zeros(len(logs) + 1), np.zeros(256)
        for w, c in train.items():
            lattice._expect_one(w, c, counts, spelt)
        total = counts.sum() + spelt.sum() + docs + len(logs) + 257
        logs = {k: math.log((x + 1) / total) for k, x in zip(logs, counts)}
        of_bytes, end = [math.log((x + 1) / total) for x in spelt], math.log10((docs + 1) / total)
    lattice = lmscore.Lattice(logs, of_bytes)
    base = lambda c: math.log10((c + 1) / (n + 1 * (v + 1)))
    out = []
    for i, ws in split:
        known = sum(train[w.decode()] > 0 for w in ws) + (docs > 0)
        score = sum(lattice.log10(w.decode()) for w in ws) + end
        out.append((i, held(i), len(ws) + 1, known, n, sum(base(train[w.decode()]) for w in ws) + base(docs), score))
    return out


@pytest.mark.parametrize("frequent", [1 << 17, 40, 0])
def test_scores_equal_plain_python(spark, monkeypatch, frequent):
    monkeypatch.setattr(lmscore, "frequent_words", lambda words, most=frequent, f=lmscore.frequent_words: f(words, most))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(40).unionByName(awkward(spark).select("doc_id", "text"))
    docs = docs.persist()
    want = sorted(plain([(r.doc_id, r.text) for r in docs.collect()]), key=repr)
    got = sorted(map(tuple, lmscore.scores(docs, MODEL).collect()), key=repr)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    for a, b in zip(got, want):
        assert a[5] == pytest.approx(b[5]) and a[6] == pytest.approx(b[6])


def test_no_documents(spark):
    assert lmscore.scores(empty(spark), MODEL).count() == 0
