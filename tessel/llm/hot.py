"""Joins with keys that may hold a third of all rows: the rows of such a key lie in blocks, and whatever is joined with it meets every block, in a task each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.session import cut

#: Only keys with more than one part in so many of the rows are split, so fewer than this many are broadcast.
PARTS = 1 << 16


def large_keys(rows: DataFrame, key: str, block: int) -> DataFrame:
    """(key, _blocks) of the keys with more than ``block`` rows and more than one part in ``PARTS`` of all: to be broadcast."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("_n"))
    large = sizes.where(F.col("_n") > max(block, rows.count() // PARTS))
    return F.broadcast(cut(large.select(key, F.ceil(F.col("_n") / block).cast("int").alias("_blocks"))))


def in_blocks(rows: DataFrame, key: str, by: str, large: DataFrame) -> DataFrame:
    """Adds ``_block``: every row lies in one block of its key, by the hash of ``by``."""
    known = rows.join(large.withColumnRenamed(large.columns[0], key), key, "left")
    return known.withColumn("_block", F.coalesce(F.pmod(F.xxhash64(by), "_blocks"), F.lit(0)).cast("int")).drop("_blocks")


def to_blocks(rows: DataFrame, key: str, large: DataFrame) -> DataFrame:
    """Adds ``_block``: every row once for each block of its key."""
    known = rows.join(large.withColumnRenamed(large.columns[0], key), key, "left")
    return known.withColumn("_block", F.explode(F.sequence(F.lit(0), F.coalesce("_blocks", F.lit(1)) - 1))).drop("_blocks")
