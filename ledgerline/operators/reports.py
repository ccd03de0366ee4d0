"""Reporting aggregates over the read model and the event frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.schemas import STAGE_OF, STAGES, STATUSES, TERMINAL_RANK, lookup, require_columns


def _dimension(spark, values: list[str], name: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(values)), f"rank int, {name} string")


def status_counts(model: DataFrame) -> DataFrame:
    """(rank, status, n) for every status, zero included, in pipeline order."""
    require_columns(model, ["status"])
    counts = model.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    every = _dimension(model.sparkSession, STATUSES, "status")
    return every.join(counts, "status", "left").select("rank", "status", F.coalesce("n", F.lit(0)).cast("long").alias("n")).orderBy("rank")


#: Calendar steps: label of the period a date is in, and the distance of labels.
PERIODS = {
    "D": ("date_trunc('day', {0})", "INTERVAL 1 DAY"),
    "W": ("date_trunc('week', {0}) + INTERVAL 6 DAYS", "INTERVAL 7 DAYS"),
    "MS": ("date_trunc('month', {0})", "INTERVAL 1 MONTH"),
}


def calendar_counts(df: DataFrame, column: str, freq: str = "W") -> DataFrame:
    """(period, n) from the first to the last period, gaps filled with zero; weeks end on, and are named by, Sunday."""
    if freq not in PERIODS:
        raise ValueError(f"unknown frequency: {freq}")
    label, step = PERIODS[freq]
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.expr(label.format(column)).alias("period")).agg(F.count(F.lit(1)).alias("n"))
    span = counts.agg(F.min("period").alias("a"), F.max("period").alias("b")).filter("a IS NOT NULL")
    every = span.select(F.explode(F.expr(f"sequence(a, b, {step})")).alias("period"))
    return every.join(counts, "period", "left").select("period", F.coalesce("n", F.lit(0)).alias("n")).orderBy("period")


def top_companies(model: DataFrame, top_n: int = 20) -> DataFrame:
    """The companies of most applications (the earliest application_id first among equals) by status, zeros omitted."""
    require_columns(model, ["company", "status"])
    # one aggregation of the model, whose shuffle both uses share
    cells = model.groupBy("company", "status").agg(F.count(F.lit(1)).alias("n"), F.min("application_id").alias("first"))
    totals = cells.groupBy("company").agg(F.sum("n").alias("total"), F.min("first").alias("first")).orderBy(F.desc("total"), "first").limit(top_n)
    w = Window.orderBy(F.desc("total"), "first")  # at most top_n rows
    ranked = totals.withColumn("place", F.row_number().over(w)).select("company", "total", "place")
    return cells.join(F.broadcast(ranked), "company").select("place", "company", "total", "status", "n")


def latency_histogram(model: DataFrame, width: int = 7, bins: int = 8) -> DataFrame:
    """(bin, low, n): days to first response in bins of width days, the last one open."""
    known = model.filter("days_to_first_response IS NOT NULL")
    at = F.least(F.floor(F.col("days_to_first_response") / width), F.lit(bins - 1)).cast("int")
    return known.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n")).select("bin", (F.col("bin") * width).alias("low"), "n")


def latency_median(model: DataFrame) -> DataFrame:
    return model.agg(F.median("days_to_first_response").alias("median_days"), F.count("days_to_first_response").alias("n"))


def summary(model: DataFrame) -> DataFrame:
    """The dashboard's tiles in one row; an empty model gives zeros and a null median."""
    count = lambda c: F.count_if(c).alias
    responded = F.col("days_to_first_response").isNotNull()
    rows = model.agg(
        F.count(F.lit(1)).alias("total"),
        count(responded)("responded"),
        F.median("days_to_first_response").alias("median_days"),
        count(F.col("status") == "interviewing")("interviewing"),
        count(F.col("status") == "offer")("offers"),
        count(F.col("status") == "rejected")("rejected"),
        count(F.col("needs_review"))("needs_review"),
    )
    return rows.withColumn("response_rate", F.coalesce(F.try_divide("responded", "total"), F.lit(0.0)).cast("double"))


def stats_by_status(model: DataFrame) -> DataFrame:
    require_columns(model, ["status"])
    return model.groupBy("status").agg(F.count(F.lit(1)).alias("n")).orderBy("status")


def kept_stages(effective: DataFrame) -> DataFrame:
    """(application_id, occurred_at, event_id, rank): the events that move an application forward in the funnel.

    The fold "keep a stage above the last kept one, until a terminal one" is a running maximum: an event is kept if its
    rank is above all ranks before it, and none of those is terminal.
    """
    stage = lookup(STAGE_OF, F.col("event_type"))
    rank = lookup({s: i for i, s in enumerate(STAGES)}, stage).cast("int")
    rows = effective.filter("application_id IS NOT NULL").withColumn("rank", rank).filter("rank IS NOT NULL")
    w = Window.partitionBy("application_id").orderBy("occurred_at", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.max("rank").over(w), F.lit(-1)))
    return rows.filter((F.col("rank") > F.col("before")) & (F.col("before") < TERMINAL_RANK)).select("application_id", "occurred_at", "event_id", "rank")


def stage_steps(effective: DataFrame, model: DataFrame) -> DataFrame:
    """(source, target, ghost, n): steps between kept stages, and from the last one to Ghosted where the application is."""
    w = Window.partitionBy("application_id").orderBy("occurred_at", "event_id")
    rows = kept_stages(effective).withColumn("next", F.lead("rank").over(w))
    ghosts = model.filter("status = 'ghosted'").select("application_id", F.lit(STAGES.index("Ghosted")).alias("ghost_rank"))
    rows = rows.join(ghosts, "application_id", "left")
    ends = F.col("next").isNull() & F.col("ghost_rank").isNotNull() & (F.col("rank") < TERMINAL_RANK)
    target = F.when(F.col("next").isNotNull(), F.col("next")).when(ends, F.col("ghost_rank"))
    rows = rows.select(F.col("rank").alias("s"), target.alias("t"), F.col("next").isNull().alias("ghost")).filter("t IS NOT NULL")
    names = F.array(*[F.lit(x) for x in STAGES])
    flows = rows.groupBy("s", "t", "ghost").agg(F.count(F.lit(1)).alias("n")).orderBy("s", "t")
    return flows.select(F.element_at(names, F.col("s") + 1).alias("source"), F.element_at(names, F.col("t") + 1).alias("target"), "ghost", "n")


def stage_flows(effective: DataFrame, model: DataFrame) -> DataFrame:
    return stage_steps(effective, model).select("source", "target", "n")
