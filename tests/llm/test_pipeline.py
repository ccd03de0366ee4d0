import re

import corpus_pipeline
import pytest

from ledgerline.llm import quality, secrets
from ledgerline.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    out, docs = {}, spark.read.parquet(f"{DATA}/documents.parquet")
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = corpus_pipeline.materialize(stage(spark, docs, DATA), f"test-{name}")
    return out


def test_all_but_the_last_keep_the_columns(steps):
    for name in list(steps)[:-1]:
        assert steps[name].columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_decisions_take_effect(spark, steps):
    ids = lambda name: sorted(r.doc_id for r in steps[name].select("doc_id").collect())
    verdicts = {r.doc_id: r.kept for r in quality.op8_quality(spark, DATA).collect()}
    assert ids("quality_rules") == sorted(i for i, kept in verdicts.items() if kept)
    texts = [r.text for r in steps["simhash_near_dedup"].collect()]
    assert len(set(texts)) == len(texts) and set(ids("simhash_near_dedup")) <= set(ids("quality_rules"))
    assert {r.text for r in steps["quality_rules"].collect()} >= set(texts)
    assert ids("secret_scans") == ids("simhash_near_dedup")
    assert not any(secrets.scan(r.text) for r in steps["secret_scans"].collect())
    words = lambda name: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in steps[name].collect())
    assert words("mixing_sources") == pytest.approx(1.5 * words("secret_scans"), rel=0.01)


def test_packing_holds_every_token_of_the_mix(spark, steps):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sum(len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in steps["mixing_sources"].collect())
    assert sum(r.length for r in steps["packing_sequences"].collect()) == want


def test_run_gives_the_last_stage(spark, steps):
    rows = lambda df: sorted(tuple(r[c] for c in ("doc_id", "start", "length", "ids_crc32")) for r in df.collect())
    assert rows(corpus_pipeline.run(spark, DATA)) == rows(steps["packing_sequences"])


def test_queries_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)


def test_awkward_rows_go_through_every_stage(spark, tmp_path):
    """Nulls, equal ids of other texts, repeated rows, a very long text and clashing columns; then an empty table."""
    good = [" ".join(f"{x}{i}" for i in range(90)) for x in ("a", "b", "c")]
    long = " ".join(f"w{i % 6007}x{i % 31}" for i in range(60_000))
    rows = [(1, good[0], "en", "s"), (1, good[1], "en", "s"), (None, good[2], None, None), (None, good[2], None, None), (2, None, "en", "s"), (3, "", "en", None), (4, long, "de", "t"), (5, good[0] + " end", "en", "t"), (5, good[0] + " end", "en", "t")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, s string, block int, root long, node long, key long, n_words int, _mix string"
    docs = spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "x", 1, 2, 3, 4, 5, "y") for r in rows], schema)
    spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = {}
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            frame = corpus_pipeline.materialize(stage(spark, frame, str(tmp_path)), f"awkward-{name}")
            if name != "packing_sequences":
                assert frame.columns == docs.columns
            kept.setdefault(name, []).append(frame)
    texts = lambda name: sorted(((r.doc_id or 0), r.text) for r in kept[name][0].collect())
    assert texts("quality_rules") == sorted((r[0] or 0, r[1]) for r in rows if r[1])
    assert texts("simhash_near_dedup") == sorted([(0, good[2]), (1, good[0]), (1, good[1]), (4, long)]) == texts("secret_scans")
    assert kept["mixing_sources"][0].count() > 0 and all(x[1].count() == 0 for x in kept.values())
