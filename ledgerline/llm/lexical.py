"""Ranked lexical search with block-max pruning over a forward index.

The index holds documents in blocks, ranges of rows as they lie in the table: for each term of a block its postings (which of the block's
documents, how often). For the terms that items ask for, each block gives its maxima: the greatest share of a score that one occurrence of the
term in an item can earn there, and how many documents hold it. A block's bound for an item is the sum of those maxima, each times the term's weight, so no document of
the block scores more. An item's blocks are scored from the greatest bound on, some more each round; the item is done once the best bound left is
below its k-th best score. Blocks whose bound equals that score are still scored, as ties go by id. All arithmetic is in 64-bit integers, so
bounds and scores are exact and the result is that of scoring every document.

Items are taken in groups of a bounded number of terms, so their weights may be broadcast whatever the number of items; each group searches the whole
index. Blocks to score are broadcast up to a checked number and shuffled beyond.

Cases: texts that are null or hold no term rank nowhere and count in no statistic; an item without a term that the documents hold has no rows;
items of one id are ranked one by one; rows that agree in score and id are ranked in table order; a null id comes after all others. Empty tables give
an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import materialize, text_slices

#: Documents of a block, and the postings beyond which it ends early.
BLOCK, BLOCK_POSTINGS = 128, 1 << 17
#: Blocks that an item's first round scores, and by what each further round has more.
FIRST, MORE = 2, 8
#: Most terms of a group of items; the weights of a group are broadcast.
GROUP_TERMS = 1 << 20
#: Most pairs of block and item that are broadcast.
BROADCAST_PAIRS = 1 << 20
#: Rows of a product of weights and shares that are added up at a time.
ROWS = 4096

TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
TERM_CLASS = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A block: its documents' ids and lengths (64 bits), its terms (each with a line end behind), and by term where its postings start
#: (32 bits, one more at the end), their documents (16 bits) and occurrences (32 bits); many numbers are columns of bytes, which nothing on the way unpacks.
INDEX = "block long, n long, total long, doc_ids array<long>, lengths binary, terms binary, starts binary, docs binary, tfs binary"


def _block(number: int, ids: list, lengths: list, vocabulary: dict, terms: list, docs: list, tfs: list) -> pa.RecordBatch:
    terms = np.array(terms, np.int32)
    order = np.argsort(terms, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=len(vocabulary)))])
    numbers = [np.array(lengths, np.int64), b"".join(x + b"\n" for x in vocabulary), starts.astype(np.int32), np.array(docs, np.uint16)[order], np.array(tfs, np.uint32)[order]]
    values = [pa.array([x], pa.int64()) for x in (number, len(ids), sum(lengths))] + [pa.array([ids], pa.list_(pa.int64()))]
    values += [pa.array([x if isinstance(x, bytes) else x.tobytes()], pa.binary()) for x in numbers]
    return pa.RecordBatch.from_arrays(values, names=[x.split()[0] for x in INDEX.split(", ")])


class Block:
    """A row of the index, unpacked."""

    def __init__(self, part: pa.RecordBatch, row: int) -> None:
        raw = lambda name: part.column(name)[row].as_buffer()
        self.number = part.column("block")[row].as_py()
        self.lengths = np.frombuffer(raw("lengths"), np.int64)
        self.starts = np.frombuffer(raw("starts"), np.int32).astype(np.int64)
        self.docs = np.frombuffer(raw("docs"), np.uint16)
        self.tfs = np.frombuffer(raw("tfs"), np.uint32).astype(np.int64)
        names = raw("terms")
        ends = np.flatnonzero(np.frombuffer(names, np.uint8) == 10).astype(np.int32) + np.int32(1)
        self.terms = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate([[np.int32(0)], ends]).astype(np.int32)), names])

    def find(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Which of words (as the block has them) the block holds, and their places among its terms."""
        at = pc.fill_null(pc.index_in(words, value_set=self.terms), -1).to_numpy(zero_copy_only=False)
        here = np.flatnonzero(at >= 0)
        return here, at[here]

    def postings(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The postings of terms one after the other, and how many each has."""
        many = self.starts[terms + 1] - self.starts[terms]
        return np.repeat(self.starts[terms] - (np.cumsum(many) - many), many) + np.arange(many.sum()), many

    def shares(self, at: np.ndarray, n: int, total: int) -> np.ndarray:
        """What one occurrence of its term in an item earns each posting, before the term's weight."""
        m = 25 + (75 * self.lengths * n) // total
        return (1_000_000_000 * self.tfs[at]) // (1000 * self.tfs[at] + 8 * m[self.docs[at]])


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Blocks of the documents with a term, by INDEX; block is at most 65,536."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        ids, lengths, vocabulary, terms, at, tfs = [], [], {}, [], [], []
        for part in text_slices(batches, 64):
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
                found = Counter(TERM.findall((text.as_py() or "").encode("utf-8", "surrogatepass").lower()))
                if not found:
                    continue
                terms += [vocabulary.setdefault(x, len(vocabulary)) for x in found]
                at += [len(ids)] * len(found)
                tfs += found.values()
                ids.append(doc_id)
                lengths.append(sum(found.values()))
                if len(ids) == block or len(terms) >= BLOCK_POSTINGS:
                    yield _block(number, ids, lengths, vocabulary, terms, at, tfs)
                    number += 1
                    ids, lengths, vocabulary, terms, at, tfs = [], [], {}, [], [], []
        if ids:
            yield _block(number, ids, lengths, vocabulary, terms, at, tfs)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, INDEX)


def _sent(words: list[str]) -> pa.Array:
    return pa.array([f"{x}\n".encode() for x in words], pa.binary())


def maxima(blocks: DataFrame, words: list[str], n: int, total: int) -> DataFrame:
    """(block, term, holders, top) for those of words that a block has: documents of the block that hold the term, and the greatest share among them."""
    sent = blocks.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = _sent(sent.value)
        names = pa.array(sent.value, pa.string())
        for part in batches:
            for row in range(part.num_rows):
                block = Block(part, row)
                here, terms = block.find(asked)
                if not len(here):
                    continue
                at, many = block.postings(terms)
                tops = np.maximum.reduceat(block.shares(at, n, total), np.cumsum(many) - many)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(here), block.number)), names.take(pa.array(here)), pa.array(many), pa.array(tops)], names=["block", "term", "holders", "top"])

    return blocks.select("block", "lengths", "terms", "starts", "docs", "tfs").mapInArrow(run, "block long, term string, holders long, top long")


def terms_of(text: Column) -> Column:
    """The terms of a text, repeats included."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM_CLASS), F.lit(0))


def _weights(asked: DataFrame, tops: DataFrame, n: int) -> DataFrame:
    """(item, term, weight) of asked(item, term, times): the weight of a term times its occurrences in the item, where it isn't zero."""
    held = tops.groupBy("term").agg(F.sum("holders").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2 * n + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    return asked.join(held, "term").select("item", "term", (weight * F.col("times")).alias("weight")).filter("weight > 0")


def _scores(blocks: DataFrame, pairs: DataFrame, weights: list, n: int, total: int, k: int) -> DataFrame:
    """(item, doc_id, score, block, at): the k best documents of each pair of item and block."""
    vocabulary = sorted({t for _, t, _ in weights})
    number = {t: i for i, t in enumerate(vocabulary)}
    by_item: dict[int, tuple[list, list]] = {}
    for item, term, weight in weights:
        for values, x in zip(by_item.setdefault(item, ([], [])), (number[term], weight)):
            values.append(x)
    sent = blocks.sparkSession.sparkContext.broadcast((vocabulary, {i: (np.array(t), np.array(w, np.int64)) for i, (t, w) in by_item.items()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, asked = sent.value
        words = _sent(words)
        line = np.empty(len(words), np.int64)
        for part in batches:
            for row in range(part.num_rows):
                block, ids = Block(part, row), part.column("doc_ids")[row].values
                here, terms = block.find(words)
                line[:] = -1
                line[here] = np.arange(len(here))
                at, many = block.postings(terms)
                shares = np.zeros((len(here), len(block.lengths)), np.int64)
                shares[np.repeat(np.arange(len(here)), many), block.docs[at]] = block.shares(at, n, total)
                key = np.array([np.iinfo(np.int64).max if x is None else x for x in ids.to_pylist()], np.int64)
                out = []
                for item in part.column("items")[row].values.to_pylist():
                    wanted, weight = asked[item]
                    lines, held = line[wanted], line[wanted] >= 0
                    lines, weight = lines[held], weight[held]
                    score = np.zeros(len(block.lengths), np.int64)
                    for s in range(0, len(lines), ROWS):
                        score += (weight[s : s + ROWS, None] * shares[lines[s : s + ROWS]]).sum(0)
                    best = np.lexsort([key, -score])[:k]
                    best = best[score[best] > 0]
                    out.append((np.full(len(best), item), best, score[best]))
                items, best, score = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), ids.take(pa.array(best)), pa.array(score), pa.array(np.full(len(best), block.number)), pa.array(best.astype(np.int64))], names=["item", "doc_id", "score", "block", "at"])

    todo = pairs.groupBy("block").agg(F.collect_list("item").alias("items"))  # as many as the group has items, at most
    todo = F.broadcast(todo) if pairs.count() <= BROADCAST_PAIRS else todo.hint("merge")
    return blocks.join(todo, "block").mapInArrow(run, "item long, doc_id long, score long, block long, at long")


def _search(blocks: DataFrame, asked: DataFrame, n: int, total: int, k: int) -> DataFrame:
    """(item, rank, doc_id, score) for a group of items; asked has their terms."""
    words = [r.term for r in asked.select("term").distinct().collect()]  # GROUP_TERMS at most
    tops = materialize(maxima(blocks, words, n, total), "block-maxima")
    weights = materialize(_weights(asked, tops, n), "weights")
    rows = [tuple(x) for x in weights.collect()]  # GROUP_TERMS at most
    if not rows:
        return weights.select("item", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    bounds = tops.join(F.broadcast(weights), "term").groupBy("item", "block").agg(F.sum(F.col("top") * F.col("weight")).alias("bound"))
    bounds = materialize(bounds, "bounds")
    turn = Window.partitionBy("item").orderBy(F.desc("bound"), "block")
    place = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "block", "at")
    best, state, many = None, None, FIRST
    while True:
        left = bounds
        if state is not None:
            after = (F.col("bound") < F.col("last.bound")) | ((F.col("bound") == F.col("last.bound")) & (F.col("block") > F.col("last.block")))
            left = bounds.join(F.broadcast(state), "item").filter(after & (F.col("bound") >= F.col("least"))).select("item", "block", "bound")
        pairs = materialize(left.withColumn("turn", F.row_number().over(turn)).filter(F.col("turn") <= many).drop("turn"), "pairs")
        if pairs.isEmpty():
            break
        found = _scores(blocks, pairs, rows, n, total, k)
        found = found if best is None else best.drop("rank").unionByName(found)
        best = materialize(found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k), "best")
        kth = best.filter(F.col("rank") == k).select("item", F.col("score").alias("least"))
        last = pairs.groupBy("item").agg(F.max_by(F.struct("bound", "block"), F.struct(-F.col("bound"), "block")).alias("last"))
        # an item without pairs is done: its state goes, and with it its blocks
        state = materialize(last.join(kth, "item", "left").select("item", "last", F.coalesce("least", F.lit(0)).alias("least")), "state")
        many *= MORE
    return best.select("item", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block: int = BLOCK, group_terms: int = GROUP_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each row of items."""
    blocks = materialize(index(docs, id_col, text_col, block), "forward-index")
    n, total = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    rows = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("item"))
    rows = materialize(rows, "items")
    terms = rows.select("item", F.explode(terms_of(F.col("text"))).alias("term")).groupBy("item", "term").agg(F.count(F.lit(1)).alias("times"))
    terms = materialize(terms, "items-terms")
    sizes = terms.groupBy("item").count()
    groups = F.floor((F.sum("count").over(Window.orderBy("item")) - F.col("count")) / group_terms)
    grouped = materialize(terms.join(sizes.select("item", groups.alias("group")), "item"), "grouped-terms") if n else terms.limit(0)
    found = None
    for number in sorted(x[0] for x in grouped.select("group").distinct().collect()) if n else []:
        some = _search(blocks, grouped.filter(F.col("group") == number), n, total, k)
        found = some if found is None else found.unionByName(some)
    if found is None:
        return rows.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    return found.join(rows.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op13_lexical(spark, sf_dir: str) -> DataFrame:
    return rank(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
  tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
  len AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY ALL),
  tot AS (SELECT count(*) AS n, sum(n)::BIGINT AS l FROM len),
  w AS (SELECT term, floor(1000 * ln((2 * tot.n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, tot GROUP BY term, tot.n),
  m AS (SELECT doc_id, 25 + (75 * len.n * tot.n) // tot.l AS m FROM len, tot),
  q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
  s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY ALL),
  r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10"""
