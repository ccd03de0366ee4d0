"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source's documents fall into blocks by a keyed hash, and a keyed permutation orders its blocks. A
target of t words over a source of z takes every block t // z times, and of one more pass the leading blocks
whose words reach the rest; the block where the rest ends gives leading documents, and the last of those leading words, so
the taken words meet the target exactly. The numbers of blocks to draw from each source are split down
a binary tree over the output shards: each node deals its blocks to its two halves by a multivariate hypergeometric draw,
so that each shard's quotas add up to the blocks there are. Shards then take disjoint runs of each source's
permuted blocks and order their documents by a keyed hash. All draws come from seeds, so reruns agree.

Blocks and shards grow in number with the input, not in size. Sources, blocks and the tree's nodes are rows of distributed tables: the
tree is split FAN nodes at a time, a group of rows for each node with one row for each source that has blocks left in it, so
its rows are never more than the blocks that are drawn. The driver holds a few numbers only.

Cases: a null text has no words; the null source is a source of its own; sources of no words and an empty table get
target 0; rows with equal ids are different rows, and where the last words of a target fall on equal ones each takes as
many; a null id is an id like any other. Extra columns ride along in ``mix``, in which rows of no words have no copy.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import BLANKS, WORD, materialize, numbered, word_count

#: Fewest blocks of a source; a larger source has blocks of about BLOCK_WORDS words. Shards hold about SHARD_WORDS words.
BLOCKS = 512
BLOCK_WORDS = 4_000_000
SHARD_WORDS = 8_000_000
#: Most rows of a table of sources or blocks that is broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Fewest output shards, and most tasks that write them (a task writes several in turn where there are more).
SHARDS = 16
TASKS = 20_000
#: Nodes that one step of the tree splits a node into, and blocks of a source that are added up in one group.
FAN = 256
RUN = 4096
SEED = 20240131


def split_quotas(quotas: np.ndarray, bounds: list[int], seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """(k, quotas of the node of shards bounds[k] to bounds[k + 1]), in order, dealt down a binary tree; they add up to quotas."""

    def deal(left: np.ndarray, low: int, high: int) -> Iterator[tuple[int, np.ndarray]]:
        if high - low == 1:
            yield low, left
            return
        mid = (low + high) // 2
        some = np.flatnonzero(left)
        part = np.zeros_like(left)
        if len(some):
            draws = int(left.sum()) * (bounds[mid] - bounds[low]) // (bounds[high] - bounds[low])
            rng = np.random.default_rng([seed, bounds[low], bounds[high]])
            part[some] = rng.multivariate_hypergeometric(left[some], draws, method="marginals")
        yield from deal(part, low, mid)
        yield from deal(left - part, mid, high)

    return deal(np.asarray(quotas, dtype=np.int64), 0, len(bounds) - 1)


def few(df: DataFrame) -> DataFrame:
    """df, broadcast where it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def with_places(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """docs with _mix_source, _mix_size (words), _mix_rank (keyed place in the source) and _mix_draw (what its block is told by)."""
    size = word_count(F.col(text_col).cast("string"))
    rows = docs.withColumns({"_mix_source": F.col(source_col).cast("string"), "_mix_size": size, "_mix_id": F.col(id_col).cast("long")})
    hashed = lambda k: F.xxhash64(F.lit(seed + k), F.coalesce("_mix_id", F.lit(-1)), "_mix_size")
    return rows.withColumns({"_mix_rank": hashed(0), "_mix_draw": hashed(1)}).drop("_mix_id")


def targets(rows: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """(s, size, source_id, target, passes, rest, blocks) for each source of rows(_mix_source, _mix_size).

    share of all sizes by weight; what a source has above most times its size goes to the others by weight, until none is above.
    """
    sizes = rows.groupBy(F.col("_mix_source").alias("s")).agg(F.sum("_mix_size").alias("size"))
    found = numbered(sizes, F.col("s").asc_nulls_last()).withColumnRenamed("place", "source_id")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("source_id", F.lit(len(weights))) + 1).cast("int"))
    found = materialize(found.withColumn("weight", weight), "mixing-sources")
    total, limit = share * (found.agg(F.sum("size")).first()[0] or 0), most * F.col("size")
    target, full = F.lit(0.0), F.lit(False)
    count = -1
    while True:
        closed, n, open_weight = found.agg(F.sum(F.when(full, F.col("size")).otherwise(0)), F.count_if(full), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if n == count or not open_weight:
            break
        count, rest = n, total - most * closed
        level = F.lit(float(rest)) * F.col("weight") / F.lit(float(open_weight))
        target, full = F.when(full, limit).otherwise(level), full | (level > limit)
        found = materialize(found.select("s", "size", "source_id", "weight", target.alias("target"), full.alias("full")), "mixing-targets")
        target, full = F.col("target"), F.col("full")
    found = found.withColumn("target", F.least(F.when(full, limit).otherwise(target), limit))
    passes = F.when(F.col("size") > 0, F.least(F.floor(F.col("target") / F.col("size")), F.lit(int(most)))).otherwise(0).cast("int")
    found = found.withColumn("passes", passes).withColumn("rest", F.greatest(F.lit(0), F.floor("target") - F.col("passes") * F.col("size")).cast("long"))
    blocks = F.greatest(F.lit(BLOCKS), F.ceil(F.col("size") / BLOCK_WORDS)).cast("int")
    return materialize(found.select("s", "size", F.col("source_id").cast("long").alias("source_id"), "target", "passes", "rest", blocks.alias("blocks")), "mixing-wanted")


def with_block(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows with what holds for their source (_mix_target and the like) and _mix_block."""
    own = few(sources.select(*[F.col(c).alias(f"_mix_{c}") for c in sources.columns]))
    return rows.join(own, F.col("_mix_source").eqNullSafe(F.col("_mix_s"))).drop("_mix_s").withColumn("_mix_block", F.pmod("_mix_draw", F.col("_mix_blocks")).cast("int"))


def _turns(blocks: DataFrame) -> DataFrame:
    """blocks(source_id, block, words) with turn (place in the source's permuted blocks) and before (words of those ahead).

    Blocks are added up in runs of about RUN by the leading part of their keyed hash, and the runs of a source in turn.
    """
    key = F.xxhash64(F.lit(SEED + 2), "source_id", "block")
    runs = F.ceil(F.col("blocks") / RUN)
    rows = blocks.withColumn("key", F.shiftrightunsigned(key, 1)).withColumn("run", F.least(F.floor(F.col("key") / (2.0**63) * runs), runs - 1).cast("int"))
    rows = materialize(rows, "mixing-keyed")
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    add = lambda c, w: F.coalesce(F.sum(c).over(ahead(w)), F.lit(0))
    of_runs = Window.partitionBy("source_id").orderBy("run")
    sums = rows.groupBy("source_id", "run").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("w"))
    sums = sums.select("source_id", "run", add("n", of_runs).alias("n"), add("w", of_runs).alias("w"))
    inside = Window.partitionBy("source_id", "run").orderBy("key", "block")
    placed = rows.withColumns({"turn": F.row_number().over(inside) - 1, "before": add("words", inside)}).join(sums, ["source_id", "run"])
    return placed.withColumns({"turn": F.col("turn") + F.col("n"), "before": F.col("before") + F.col("w")}).drop("n", "w", "key", "run")


def shard_runs(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source_id, shard, start, quota): the runs of each source's draws that the shards take; quotas: (source_id, quota)."""
    schema = "low long, high long, source_id long, quota long, start long"

    def split(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        low, high = map(int, key)
        rows = rows.sort_values("source_id")
        ids, at, out = rows["source_id"].to_numpy(), rows["start"].to_numpy().copy(), []
        parts = min(FAN, high - low)
        bounds = [low + (high - low) * k // parts for k in range(parts + 1)]
        for k, dealt in split_quotas(rows["quota"].to_numpy(), bounds, seed):
            some = np.flatnonzero(dealt)
            out.append(pd.DataFrame({"low": bounds[k], "high": bounds[k + 1], "source_id": ids[some], "quota": dealt[some], "start": at[some]}))
            at += dealt
        return pd.concat(out, ignore_index=True)

    nodes = quotas.filter("quota > 0").select(F.lit(0).cast("long").alias("low"), F.lit(shards).cast("long").alias("high"), "source_id", "quota", F.lit(0).cast("long").alias("start"))
    widest = shards
    while widest > 1:
        nodes = materialize(nodes.groupBy("low", "high").applyInPandas(split, schema), "mixing-nodes")
        widest = -(-widest // FAN)
    return nodes.select("source_id", F.col("low").alias("shard"), "start", "quota")


def _last_lines(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """(source_id, cut, each): of each source whose rest ends inside a block the rank where it ends, and the words that each row of
    that rank gives. A block's rows are added up in one group, as blocks don't grow."""
    ends = few(placed.filter("partial").select(F.col("source_id").alias("_mix_source_id"), F.col("block").alias("_mix_block"), (F.col("rest") - F.col("before")).alias("room")))
    lines = rows.join(ends, ["_mix_source_id", "_mix_block"])
    ranks = lines.groupBy(F.col("_mix_source_id").alias("source_id"), "room", F.col("_mix_rank").alias("rank")).agg(F.sum("_mix_size").alias("words"), F.count(F.lit(1)).alias("n"))
    inside = Window.partitionBy("source_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("room") - F.coalesce(F.sum("words").over(inside), F.lit(0))
    return ranks.withColumn("left", left).filter("left >= 0 AND left < words").select("source_id", F.col("rank").alias("cut"), F.floor(F.col("left") / F.col("n")).alias("each"))


def draw(rows: DataFrame, weights: list[float], share: float, most: float, shards: int | None, seed: int) -> tuple[DataFrame, DataFrame, int]:
    """(blocks, sources, shards): the draw over rows(_mix_source, _mix_size, _mix_rank, _mix_draw).

    blocks(source_id, block, shards, drawn, partial) tells the shard of each pass over a block; sources(s, source_id, source_size, target, passes,
    blocks, cut, each) has what holds for a source, where a partial block's rows below rank cut are taken whole, and those at it as far as each.
    """
    sources = targets(rows, weights, share, most)
    total = sources.agg(F.sum("size")).first()[0] or 0
    shards = shards or max(SHARDS, math.ceil(share * total / SHARD_WORDS))
    rows = with_block(rows, sources.select("s", "source_id", "blocks"))
    sums = rows.groupBy(F.col("_mix_source_id").alias("source_id"), F.col("_mix_block").alias("block")).agg(F.sum("_mix_size").alias("words"))
    own = few(sources.select("source_id", "blocks", "passes", "rest"))
    placed = _turns(materialize(sums, "mixing-blocks").join(own, "source_id")).withColumn("drawn", F.col("before") < F.col("rest"))
    placed = materialize(placed.withColumn("partial", F.col("drawn") & (F.col("before") + F.col("words") > F.col("rest"))), "mixing-turns")
    counts = placed.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), (F.sum("passes") + F.count_if("drawn")).alias("quota"))
    counts = materialize(counts, "mixing-counts")

    # a block's k-th draw has number k * n + turn among its source's draws, and the shard whose run holds that number
    runs = shard_runs(counts.select("source_id", "quota"), shards, seed)
    numbers = runs.select("source_id", "shard", F.explode(F.sequence("start", F.col("start") + F.col("quota") - 1)).alias("number"))
    times = F.col("passes") + F.col("drawn").cast("int")
    passes = placed.filter(times > 0).join(few(counts.select("source_id", "n")), "source_id").select("source_id", "block", "n", "turn", F.explode(F.sequence(F.lit(0), times - 1)).alias("k"))
    dealt = passes.select("source_id", "block", "k", (F.col("k") * F.col("n") + F.col("turn")).alias("number")).join(numbers, ["source_id", "number"])
    dealt = dealt.groupBy("source_id", "block").agg(F.array_sort(F.collect_list(F.struct("k", "shard"))).alias("draws"))  # at most most + 1 of a block
    blocks = placed.select("source_id", "block", "drawn", "partial").join(dealt, ["source_id", "block"], "left")
    blocks = blocks.select("source_id", "block", "drawn", "partial", F.coalesce(F.col("draws")["shard"], F.array().cast("array<long>")).alias("shards"))
    wanted = sources.select("s", "source_id", F.col("size").alias("source_size"), "target", "passes", "blocks").join(_last_lines(rows, placed), "source_id", "left")
    return materialize(blocks, "mixing-dealt"), materialize(wanted, "mixing-cuts"), shards


def with_copies(rows: DataFrame, blocks: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """rows with _mix_source_size, _mix_target, _mix_taken and _mix_copies, an array of (shard, place, words)."""
    c = lambda name: F.col(f"_mix_{name}")
    blocks = few(blocks.select(*[F.col(x).alias(f"_mix_{x}") for x in blocks.columns]))
    keyed = with_block(rows, sources).join(blocks, ["_mix_source_id", "_mix_block"])
    last = F.when(~c("drawn"), F.lit(0)).when(~c("partial") | (c("rank") < c("cut")), c("size")).when(c("rank") == c("cut"), F.least(c("size"), c("each"))).otherwise(F.lit(0)).cast("long")
    keyed = keyed.withColumn("_mix_last", last)
    words = lambda k: F.when(k < c("passes"), c("size")).otherwise(c("last"))
    copy = lambda s, k: F.struct(s.alias("shard"), F.xxhash64(F.lit(seed + 3), c("rank"), k).alias("place"), words(k).alias("words"))
    copies = F.filter(F.transform(c("shards"), copy), lambda x: x["words"] > 0)
    return keyed.withColumns({"_mix_taken": (c("size") * c("passes") + c("last")).cast("long"), "_mix_copies": copies})


def plan(docs: DataFrame, weights: list[float], share: float = 1.5, most: float = 2.0, shards: int | None = None, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, copies) for each row; copies are (shard, place, words).

    weights repeat over the sources in code-point order, null last; shards follow the input's words unless given.
    """
    rows = with_places(docs.select(id_col, text_col, source_col), seed, id_col, text_col, source_col)
    rows = materialize(rows.select(F.col(id_col).cast("long").alias("doc_id"), "_mix_source", "_mix_size", "_mix_rank", "_mix_draw"), "mixing-sizes")
    blocks, sources, _ = draw(rows, weights, share, most, shards, seed)
    found = with_copies(rows, blocks, sources, seed)
    return found.select("doc_id", F.col("_mix_source").alias("source"), F.col("_mix_size").alias("size"), F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"), F.col("_mix_taken").alias("taken"), F.col("_mix_copies").alias("copies"))


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return plan(docs, [3, 1, 2]).select("doc_id", "size", "source_size", "target", "taken", F.concat_ws(",", F.transform("copies", lambda c: c["shard"].cast("string"))).alias("shards"))


def mix(docs: DataFrame, weights: list[float], share: float = 1.5, most: float = 2.0, shards: int | None = None, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs as the mix takes them: a row for each copy, in its shard's order, with the columns of docs.

    A document of which only leading words are taken is cut after them.
    """
    rows = with_places(docs.select(id_col, text_col, source_col), seed, id_col, text_col, source_col)
    rows = materialize(rows.select("_mix_source", "_mix_size", "_mix_rank", "_mix_draw"), "mixing-sizes")
    blocks, sources, shards = draw(rows, weights, share, most, shards, seed)
    taken = with_copies(with_places(docs, seed, id_col, text_col, source_col), blocks, sources, seed)
    copies = taken.select(*docs.columns, "_mix_size", F.explode("_mix_copies").alias("_mix_copy"))
    n = F.col("_mix_copy.words")
    lead = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(f"[{BLANKS}]*{WORD}"), F.lit(0)), F.lit(1), n.cast("int")), "")
    copies = copies.withColumn(text_col, F.when(n < F.col("_mix_size"), lead).otherwise(F.col(text_col)))
    tasks = min(shards, TASKS)
    dealt = copies.repartitionById(tasks, F.pmod("_mix_copy.shard", F.lit(tasks)).cast("int"))
    return dealt.sortWithinPartitions("_mix_copy.shard", "_mix_copy.place").select(*docs.columns)
