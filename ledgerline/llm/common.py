"""Materialised steps, connected components, row numbers and text helpers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.components import connected_components, new_path
from ledgerline.operators.components import written

__all__ = ["BLANKS", "WORD", "connected_components", "materialize", "new_path", "numbered", "text_slices", "word_count"]

#: Words are runs of anything but space and the controls from tab to carriage return.
BLANKS = "\\x20\\x09-\\x0D"
WORD = f"[^{BLANKS}]+"
#: Most rows of a batch that goes to a Python worker while a step is materialised: texts may be long, and both sides hold a batch.
ARROW_ROWS = 2048


def materialize(df: DataFrame, label: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read back, with small batches between the JVM and Python."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, str(min(ARROW_ROWS, int(before)) if int(before) > 0 else ARROW_ROWS))
    try:
        return written(df, label)
    finally:
        conf.set(key, before)


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """df with place, its rows' numbers from 0 in order, without gathering them in one task."""
    rows = materialize(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()), "ordered")
    parts = sorted(rows.groupBy(F.shiftright("_place", 33).alias("part")).count().collect())  # as many as the sort had partitions
    starts, at = [], 0
    for x in parts:
        starts.append((x["part"], at))
        at += x["count"]
    starts = df.sparkSession.createDataFrame(starts, "_part long, _start long")
    found = rows.join(F.broadcast(starts), F.shiftright("_place", 33) == F.col("_part"))
    return found.withColumn("place", F.col("_start") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))).drop("_place", "_part", "_start")


def text_slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small slices of Arrow batches, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
