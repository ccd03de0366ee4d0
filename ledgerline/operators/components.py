"""Shared folder, tables written there, and connected components with all state in such tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or where that is unset and Spark runs in one process one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    master = spark.sparkContext.master
    if master.split("[")[0] != "local":
        raise RuntimeError(f"spark.checkpoint.dir is unset: with master {master} it has to name a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="ledgerline-")
    spark.sparkContext.setCheckpointDir(folder)
    return f"file://{folder}"


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder; what is written there is deleted when the application ends."""
    path = f"{shared_dir(spark)}/ledgerline/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


#: Narrow rows of one file, where their number is known.
FILE_ROWS = 500_000


def written(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """df, written as Parquet to the shared folder and read back: cuts lineage, survives lost executors. Where it is known that df has no more
    than so many (narrow) rows, they go to as many files as they fill and not to one for each partition of a shuffle."""
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_order(df: DataFrame, *order) -> DataFrame:
    """df with place, its rows' numbers from 0 in order, without gathering them in one task: a sort over ranges, whose sizes the driver adds up."""
    rows = written(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    starts, at = [], 0
    for part, n in sorted(tuple(x) for x in rows.groupBy(F.shiftright("_at", 33)).count().collect()):  # as many as the sort has partitions
        starts.append((part, at))
        at += n
    starts = df.sparkSession.createDataFrame(starts, "_part long, _start long")
    found = rows.join(F.broadcast(starts), F.shiftright("_at", 33) == F.col("_part"))
    return found.withColumn("place", F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_start")


def _pairs_to_roots(edges: DataFrame, most: int) -> DataFrame:
    """(node, root): each node points to the smallest node among itself and its neighbours, then all
    pointers are followed to their ends by doubling. There are most of them at most."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).union(edges.select("b", "a"))
    hops = both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("root"))
    hops = written(hops, "cc-hops", most)
    while True:
        end = hops.select(F.col("node").alias("root"), F.col("root").alias("next"))
        further = written(hops.join(end, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "cc-jump", most)
        moved = further.filter("moved").limit(1).count()
        hops = further.select("node", "root")
        if not moved:
            return hops


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node in edges(a, b), root being the smallest node of its component.

    Each round contracts every node into a local minimum, at least halving the nodes of a component,
    so the rounds are logarithmic in the longest component; all state stays in distributed tables.
    Null ends and loops are ignored.
    """
    edges = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    result, nodes = None, 0
    while True:
        n = edges.count()
        nodes = nodes or 2 * n
        roots = _pairs_to_roots(edges, 2 * n)
        if result is None:
            result = roots
        else:
            onward = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
            result = written(result.join(onward, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "cc-roots", nodes)
        left, right = roots.toDF("a", "ra"), roots.toDF("b", "rb")
        edges = edges.join(left, "a").join(right, "b").filter("ra <> rb")
        edges = written(edges.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "cc-edges", n)
        if edges.isEmpty():
            return result
