import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ledgerline.llm import encoding, packing, tokenfiles
from tests.llm.helpers import awkward, empty

TEXTS = ["", " ", "a", "  a  b", "a\n b", "x ~ y ~z ~~", " lead", "trail ", "a b c", "tab\there  there", "é ΣαΣ", "a \x1c b", "<|endoftext|> x", "it's  we'll \n\n x", "1 22 333", "한국어 中文 \U0001f600"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("memo", [300, 1 << 24])
def test_stretches_encode_as_whole_texts(spark, name, memo):
    texts = TEXTS + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    mine = encoding.Encoder(encoding.read_tokenizer(public_tokenizers.path(name)), memo)
    assert mine.layout != "whole"
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    whole.encode_special_tokens = True
    got = [x for at in range(0, len(texts), 50) for x in mine.encode(pa.array(texts[at : at + 50]))]
    assert [x.tolist() for x in got] == [x.ids for x in whole.encode_batch(texts, add_special_tokens=False)]


def whole_ids(docs, name, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return {(r.doc_id, r.text): t.encode(r.text or "", add_special_tokens=False).ids + [end] for r in docs.collect()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_files_round_trip(spark, tmp_path):
    docs = awkward(spark)
    manifest = tokenfiles.write_files(docs, public_tokenizers.path("word_bpe_49k.json"), 2, f"file://{tmp_path}/t", length=64, batch=3)
    got = sorted(tokenfiles.read_files(spark, manifest).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0)) and len(ids) == 11
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    want = whole_ids(docs, "word_bpe_49k.json", 2)
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted([(k[0] or 0, len(v), crc(v)) for k, v in want.items()] + [(4, len(want[4, "one"]), crc(want[4, "one"]))])
    shard = tokenfiles.ShardReader(next(x.path for x in manifest if x.tokens > 64))
    ids, mask = shard.sequence(0)
    assert len(ids) == len(mask) == mask.true_count == 64 and ids.base is not None  # views of the mapped file
    before = pa.total_allocated_bytes()
    held = [shard.sequence(0) for _ in range(50)]
    assert pa.total_allocated_bytes() == before and len(held) == 50
    total = sum(x.tokens for x in manifest if x.path.endswith(shard.name[-12:]))
    assert sum(shard.sequence(i)[1].true_count for i in range(-(-total // 64))) == total


def test_no_documents(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert tokenfiles.read_files(spark, tokenfiles.write_files(empty(spark), path, 2, f"file://{tmp_path}/t")).count() == 0
    assert packing.pack(empty(spark), path, 1).count() == 0


def test_packing_places_every_id_once(spark):
    docs = awkward(spark).unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id + 100 doc_id", "text", "lang", "source", "n_chars", "1L component_id", "'' fp", "'' s", "1 block"))
    want = whole_ids(docs, "byte_bpe_50k.json", 1)
    rows = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 1).collect()
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
        assert r.length <= r.doc_tokens
    for (doc, _), ids in want.items():
        assert all(c == crc(ids[s : s + n]) for s, n, c in pieces[doc])
        assert sorted(x for s, n, _ in pieces[doc] for x in range(s, s + n)) == sorted(list(range(len(ids))) * (2 if doc == 4 else 1))
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 2048
    assert len(sequences) <= sum(r.length for r in rows) / 2048 + 1


def test_closest_fill_against_brute_force():
    import random
    from itertools import product

    rng = random.Random(4)
    for _ in range(200):
        counts = [(n, rng.randrange(1, 4)) for n in sorted(rng.sample(range(1, 40), 4), reverse=True)]
        space = rng.randrange(0, 90)
        best = max(s for take in product(*(range(c + 1) for _, c in counts)) if (s := sum(t * n for t, (n, _) in zip(take, counts))) <= space)
        used = packing.closest_fill(counts, space)
        assert sum(n * k for n, k in used.items()) == best and all(k <= dict(counts)[n] for n, k in used.items())


def test_strings_of_special_tokens_are_ordinary_text():
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        enc = encoding.Encoder(encoding.read_tokenizer(public_tokenizers.path(name)))
        special = Tokenizer.from_file(public_tokenizers.path(name)).token_to_id("<|endoftext|>")
        (ids,) = enc.encode(pa.array(["a <|endoftext|> b"]))
        assert special is not None and special not in ids.tolist() and len(ids) > 4


def test_index_is_written_in_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfiles, "INDEX_BATCH", 3)
    writer = tokenfiles.ShardWriter(f"file://{tmp_path}/s", np.dtype("<u2"), 8, 2)
    for i in range(8):
        writer.add(i, np.arange(i + 1, dtype="<u2"))
    writer.close()
    batches = list(tokenfiles.ShardReader(f"file://{tmp_path}/s").index())
    assert [b.num_rows for b in batches] == [3, 3, 2] and [x for b in batches for x in b.column(0).to_pylist()] == list(range(8))


@pytest.mark.parametrize("length", [1400, 1100, 700])
def test_copies_of_one_length_are_cut_and_pad_little(length):
    import random

    rng, packer = random.Random(3), packing.Packer(0)
    for i in range(3000):
        n = length if i % 3 == 0 else rng.randrange(1, 2048)
        ids = np.arange(n, dtype="<u4")
        packer.add((i, 0, n, encoding.crc32_of(ids), n, ids))
    packer.cut_to_fit(packer.finish(keep_open=True))
    sums, pieces = {}, {}
    for doc, start, n, crc, tokens, ids, sequence, offset in packer.rows:
        assert offset == sums.get(sequence, 0) and n == len(ids) and crc == encoding.crc32_of(ids) and ids[0] == start
        sums[sequence] = offset + n
        pieces.setdefault(doc, []).append((start, n, tokens))
    for parts in pieces.values():
        parts.sort()
        assert [s for s, *_ in parts] == [sum(n for _, n, _ in parts[:i]) for i in range(len(parts))] and sum(n for _, n, _ in parts) == parts[0][2]
    assert len(pieces) == 3000 and sorted(sums.values())[1] == 2048 and max(sums.values()) == 2048
