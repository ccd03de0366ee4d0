"""Exact dedup by a content sort, in DataFrame functions alone.

A sampled set of splitters cuts the order of all normalised contents into ranges of about equal bytes; a row finds its range by binary search
among them. Each range is sorted (on disk where it outgrows memory), which places equal contents side by side, and every row is compared with
the row before it, whole text with whole text. Only contents at the borders of ranges may go on in the next range: there the last and the first
text of neighbours are compared, and what goes on is added up over the chain of such borders.

A splitter must not be as long as a text: rows are ordered by their leading bytes, then by the SHA-256 of the whole content, then by a number
drawn for the row. The last part lets splitters fall inside a content: copies that hold a third of all rows spread over a third of all
ranges. Everything that the driver sees is the splitters and two totals; what is broadcast is a row or two for each range.

Cases: null counts as empty, and all texts of blanks alone are equal; of rows that agree in text and id one stays; a null id comes
after all others; an empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.text import let
from ledgerline.llm.common import materialize

#: Leading bytes of a content in the order.
LEAD = 16
#: Bytes of text that a range is meant to hold, and the most ranges (they grow beyond).
RANGE_BYTES = 24 << 20
MOST_RANGES = 1 << 16
#: Keys drawn to place the splitters: so many for each range, and so many at most.
RANGE_SAMPLE, SAMPLE = 64, 200_000


def normalised(text: Column) -> Column:
    """text without blanks; null counts as empty."""
    return reduce(lambda x, blank: F.replace(x, F.lit(blank), F.lit("")), " \t\n\x0b\x0c\r", F.coalesce(text.cast("string"), F.lit("")))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.length(F.col(text_col)), F.lit(0)).cast("long").alias("chars"), normalised(F.col(text_col)).alias("content"))
    rows = rows.withColumn("digest", F.sha2("content", 256))
    lead = F.rpad(F.hex(F.substring(F.col("content").cast("binary"), 1, LEAD)), 2 * LEAD, "0")
    drawn = F.lpad(F.hex(F.xxhash64(F.monotonically_increasing_id())), 16, "0")
    return rows.withColumn("lead", lead).withColumn("key", F.concat("lead", "digest", drawn))


def _splitters(docs: DataFrame, id_col: str, text_col: str, ranges: int, size: int) -> list[str]:
    """The greatest drawn key of each range but the last, ranges being equal in bytes. A row is drawn with a chance in proportion to its bytes, and counts
    as many as such a draw stands for (or its own, if it is larger), so a few long texts don't bend the ranges."""
    each = size / min(SAMPLE, RANGE_SAMPLE * ranges)
    weight = lambda text: F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(64)
    sample = _keyed(docs.filter(F.rand(7) * each < weight(F.col(text_col))), id_col, text_col)
    sized = sample.select("key", F.greatest(F.octet_length("content") + 64, F.lit(each)).alias("size"))
    upto, total = F.sum("size").over(Window.orderBy("key")), F.sum("size").over(Window.partitionBy())
    cut = sized.select("key", F.floor(upto * ranges / (total + 1)).alias("range")).groupBy("range").agg(F.max("key").alias("key"))
    return sorted(r.key for r in cut.collect())[:-1]


def _range_of(key: Column, splitters: list[str]) -> Column:
    """How many splitters lie below key."""
    if not splitters:
        return F.lit(0)
    table = F.split(F.lit(",".join(splitters)), ",")  # folded into one constant
    steps = F.lit([1 << i for i in reversed(range(len(splitters).bit_length()))])
    below = lambda k: F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(splitters)) & (F.get(table, at + step - 1) < k), at + step).otherwise(at))
    return let(key, below)


def _sorted_ranges(docs: DataFrame, id_col: str, text_col: str, range_bytes: int) -> DataFrame:
    """Each row's range, its run of equal contents there, what the run keeps; the content itself only at the two ends of a range."""
    n, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col(text_col)).cast("long")), F.lit(0))).first()
    size += 64 * n
    ranges = max(1, min(MOST_RANGES, -(-size // range_bytes)))
    splitters = _splitters(docs, id_col, text_col, ranges, size) if ranges > 1 else []
    ranged = _keyed(docs, id_col, text_col).withColumn("range", _range_of(F.col("key"), splitters)).drop("key").repartitionById(ranges, F.col("range"))
    order = [F.col("chars").desc(), F.col("doc_id").asc_nulls_last()]
    side = Window.partitionBy("range").orderBy("lead", "digest", "content", *order)
    rows = ranged.withColumns(
        {
            "place": F.row_number().over(side),
            "new": ~F.coalesce(F.col("content") == F.lag("content").over(side), F.lit(False)),
            "last": F.lead("digest").over(side).isNull(),
        }
    )
    rows = rows.withColumn("edge", F.when((F.col("place") == 1) | F.col("last"), F.col("content"))).drop("content", "lead")
    rows = rows.withColumn("run", F.sum(F.col("new").cast("int")).over(Window.partitionBy("range").orderBy("place")))
    run = Window.partitionBy("range", "run")
    return rows.withColumns({"keep_id": F.first("doc_id").over(run.orderBy("place")), "keep_chars": F.first("chars").over(run.orderBy("place")), "size": F.count(F.lit(1)).over(run)})


def _chains(rows: DataFrame) -> DataFrame:
    """(range, run, keep_id, group_size, keep_range, keep_run) of runs that go on over a border: at most two rows for each range."""
    edges = materialize(rows.filter("edge IS NOT NULL").select("range", "run", "place", "last", "keep_id", "keep_chars", "size", "edge"), "borders")
    neighbours = edges.filter("place = 1").select("range").withColumn("before", F.lag("range").over(Window.orderBy("range")))
    ends = edges.filter("last").select(F.col("range").alias("before"), F.col("edge").alias("end"))
    starts = edges.filter("place = 1").select("range", F.col("edge").alias("start"))
    same = neighbours.join(starts, "range").join(ends, "before").select("range", (F.col("start") == F.col("end")).alias("goes_on"))
    nodes = edges.select("range", "run", "keep_id", "keep_chars", "size").distinct().join(same, "range", "left")
    begins = (F.col("run") > 1) | ~F.coalesce("goes_on", F.lit(False))
    chained = nodes.withColumn("chain", F.sum(begins.cast("int")).over(Window.orderBy("range", "run")))
    best = F.min(F.struct(-F.col("keep_chars"), F.col("keep_id").isNull(), "keep_id", "range", "run"))
    of = Window.partitionBy("chain")
    found = chained.withColumns({"best": best.over(of), "group_size": F.sum("size").over(of), "nodes": F.count(F.lit(1)).over(of)}).filter("nodes > 1")
    return found.select("range", "run", "group_size", F.col("best.keep_id").alias("chain_id"), F.col("best.range").alias("keep_range"), F.col("best.run").alias("keep_run"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row for each row of docs; of equal texts the one with the most characters stays, then the smallest id."""
    rows = materialize(_sorted_ranges(docs, id_col, text_col, range_bytes), "content-sorted")
    chains = materialize(_chains(rows), "chains")
    found = rows.drop("edge").join(F.broadcast(chains), ["range", "run"], "left")
    over = F.col("keep_range").isNotNull()
    return found.select(
        "doc_id",
        F.when(over, F.col("chain_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", "size").alias("group_size"),
        (F.col("new") & (~over | ((F.col("range") == F.col("keep_range")) & (F.col("run") == F.col("keep_run"))))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def op12_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
  g AS (SELECT doc_id, t, row_number() OVER w AS turn, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d WINDOW w AS (PARTITION BY t ORDER BY chars DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, turn = 1 AS kept, sha256(t) AS text_sha256 FROM g"""
