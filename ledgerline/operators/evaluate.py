"""Evaluation of predictions against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The pair of types that is easily confused.
CONFUSABLE = ["application_received", "rejection"]


def ratio(hit: Column, among: Column) -> Column:
    """Share of hits; 0 for an empty population."""
    n = F.count_if(among)
    return F.coalesce(F.try_divide(F.count_if(among & hit), n), F.lit(0.0)).cast("double")


def evaluate(pairs: DataFrame) -> DataFrame:
    """One row of metrics over pairs(label_type, label_company_key, label_role_key, event_type, company_key, role_key, confidence, latency)."""
    every = F.lit(True)
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    return pairs.agg(
        F.count(F.lit(1)).alias("n"),
        ratio(F.col("confidence") > 0, every).alias("schema_compliance"),
        ratio(same("label_type", "event_type"), every).alias("event_type_accuracy"),
        ratio(same("label_type", "event_type"), F.col("label_type").isin(CONFUSABLE)).alias("confusable_pair_accuracy"),
        ratio(same("label_company_key", "company_key"), F.col("label_company_key").isNotNull()).alias("company_accuracy"),
        ratio(same("label_role_key", "role_key"), F.col("label_role_key").isNotNull()).alias("role_accuracy"),
        F.median("latency").alias("median_latency"),
    )
