"""Corpus pipeline: documents to packed sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's documents. Quality rules drop what they reject, SimHash near-dedup keeps one document of each group,
secret scans put a placeholder for each secret, the mix repeats and drops documents towards the target
weights, and packing gives the pieces of the sequences.

Cases, for every stage: rows are judged one by one, so rows of one id and rows with a null id stay or go by their own texts; null and
empty texts fail the base quality rule; a null language is a stratum and a null source a source of its own; an empty table gives an empty
one with the same columns; extra columns ride along up to the mix, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import mixing, packing, quality, secrets, simhash
from ledgerline.llm.common import materialize

#: Weights of the sources in code-point order, repeating.
WEIGHTS = [3, 1, 2]
#: The end-of-text id of the tokenizer that packing uses.
END_ID = 50256


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that pass the base rule and their stratum's certified rules, where they are; without labels the base rule alone decides."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by five-word shingles at a similarity of 0.8 the row of the smallest id, once; a null id comes last."""
    return simhash.keep_one_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, with each secret's span replaced by its kind; n_chars follows the new text."""
    return secrets.redact(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes; of a document taken in part its leading words."""
    return mixing.mix(docs, WEIGHTS)


def packing_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a sequence; copies of a document are packed one by one."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("secret_scans", secret_scans),
    ("mixing_sources", mixing_sources),
    ("packing_sequences", packing_sequences),
]

#: Tokens and trained thresholds are beyond SQL; tests/llm compares run() with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
