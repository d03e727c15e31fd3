"""Readers of the driver tables, and the one-row-per-key view of redelivered tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """``{path}/{name}.parquet``; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{path}/{name}.parquet")


def latest(df: DataFrame, key: str, *columns: str, at: str = "loaded_at") -> DataFrame:
    """One row per ``key``: the columns as of the latest ``at``; null keys are dropped.

    A partial aggregation, so copies of a hot key collapse before the shuffle. Rows with equal ``at`` are told apart by
    nothing else, as redelivered rows have equal content.
    """
    rest = [c for c in columns if c != key]
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max_by(F.struct(*rest), F.coalesce(F.col(at).cast("timestamp"), F.lit(0).cast("timestamp"))).alias("_r"))
        .select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])
    )
