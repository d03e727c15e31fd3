"""Top N rows of every group by descending score bands.

The score range is cut into bands at quantiles of the whole table, each upper band half as large as the next. Going down
from the top band, a group is filled once its bands so far hold N different items; every band below its boundary
band is then anti-joined away, and only what is left (the rows above and in the boundary band) is ranked exactly.

The counts are pre-aggregated before they are shuffled: per group and band a 64-bit mask of item hashes, whose number of
bits is at most the number of different items, so redelivered copies never fill a group and no needed row is lost. The
walk over a group's bands is one fold, and the anti-join runs on the map side: the boundary bands of all groups with more than one part in ``PARTS``
of the rows are broadcast, which are fewer than ``PARTS`` whatever the number of groups. So a group with a third of all rows, or with any share that
could make a task large, loses its low bands before the shuffle, beside however many small groups. Rows of the smaller groups are ranked as they are:
they are spread by group and item, each task keeps the first N of a group, and only those meet by group.

Defined cases: rows whose score is null, NaN or one of ``unscored``, or whose group or item is null, take no part; ties
are settled by all of ``order``; copies of an item in a group count once, its row being any of equal content, else the
first in order; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Groups with more than one part in so many of the rows have their boundary band broadcast, so fewer than this many: a fixed bound, about 2 MB.
PARTS = 1 << 16
#: Upper quantiles that separate the bands.
CUTS = [0.0, 0.5, 0.75, 0.875, 0.9375, 0.96875, 0.984375, 0.9921875]


def scored(df: DataFrame, score: str, unscored: tuple[float, ...] = (-1.0,)) -> DataFrame:
    keep = F.col(score).isNotNull() & ~F.isnan(score)
    for value in unscored:
        keep &= F.col(score) != F.lit(value)
    return df.where(keep)


def boundary_bands(rows: DataFrame, group: list[str], item: str, n: int, more: float) -> DataFrame:
    """(_group, _least): hash of every group with more than ``more`` rows and the lowest ``_band`` that it still needs."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(item), F.lit(64)).cast("int"))
    masks = rows.groupBy(*group, "_band").agg(F.bit_count(F.bit_or(bit)).alias("_items"), F.count("*").alias("_rows"))
    down = F.struct((-F.col("_band")).alias("down"), F.col("_items").alias("items"))
    per_group = masks.groupBy(*group).agg(F.array_sort(F.collect_list(down)).alias("_bands"), F.sum("_rows").alias("_rows")).where(F.col("_rows") > more)
    # from the top band down: the band at which the sum first reaches n, else 0

    def step(acc: Column, x: Column) -> Column:
        total = (acc["sum"] + x["items"]).cast("int")
        least = F.when(total >= n, -x["down"]).otherwise(0).cast("int")
        return F.when(acc["sum"] >= n, acc).otherwise(F.struct(total.alias("sum"), least.alias("least")))

    walked = F.aggregate("_bands", F.struct(F.lit(0).alias("sum"), F.lit(0).alias("least")), step)
    return per_group.groupBy(F.xxhash64(*group).alias("_group")).agg(F.min(walked["least"]).alias("_least"))


def candidates(df: DataFrame, group: list[str], item: str, score: str, n: int) -> DataFrame:
    """The rows that may be among the first ``n`` items of their group: those of large groups above or in their boundary band, all rows of small groups."""
    seen = df.agg(F.percentile_approx(score, F.array(*[F.lit(c) for c in CUTS[1:]]), 1000).alias("cuts"), F.count("*").alias("rows")).first()
    band = F.lit(0)
    for value in sorted(set(seen["cuts"] or [])):
        band = band + (F.col(score) >= F.lit(value)).cast("int")
    banded = df.withColumn("_band", band)
    least = boundary_bands(banded.select(*group, item, "_band"), group, item, n, seen["rows"] / PARTS)
    left = banded.withColumn("_group", F.xxhash64(*group)).join(F.broadcast(least), "_group", "left")
    return left.where("_least is null or _band >= _least").drop("_group", "_band", "_least")


def top_n(df: DataFrame, group: list[str], item: str, score: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` items of every group by ``score`` descending, then ``order``; adds ``rank`` from 1 in place of any column of that name.

    ``df`` holds scored rows only (see :func:`scored`). Its other columns are kept; names with a leading underscore of this module (_band, _group, _least,
    _copy) must not be among those of group, item, score and order, and are dropped elsewhere.
    """
    df = df.drop("_band", "_group", "_least", "_copy").where(" and ".join(f"`{c}` is not null" for c in (*group, item)))
    by = [F.col(score).desc(), *order]
    left = candidates(df, group, item, score, n)
    once = left.withColumn("_copy", F.row_number().over(Window.partitionBy(*group, item).orderBy(*by))).where("_copy = 1").drop("_copy")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*by))).where(F.col("rank") <= n)
