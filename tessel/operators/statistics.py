"""Grouped statistics, threshold sweeps and bootstrap over long tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exact_mean(value: Column, scale: int = 10_000) -> Column:
    """Mean of decimals with a fixed number of places: integers are summed, so the order of rows does not matter."""
    units = F.round(value * scale).cast("bigint")
    return F.sum(units).cast("double") / F.nullif(F.count(units), F.lit(0)) / scale


def grouped_metrics(df: DataFrame, group: str | None, metrics: list[str]) -> DataFrame:
    """(group, metric, mean, max, min, n) per group, or over all rows; the sentinel -1, null and NaN do not apply, and a metric without values is -1."""
    key = F.lit("ALL") if group is None else F.coalesce(F.col(group).cast("string"), F.lit("None"))
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    rows = df.select(key.alias("grp"), F.explode(pairs).alias("p")).select("grp", "p.*")
    v = F.when((F.col("value") != -1) & ~F.isnan("value"), F.col("value"))
    of = lambda x: F.coalesce(x, F.lit(-1.0))
    return rows.groupBy("grp", "metric").agg(of(exact_mean(v, 1_000_000)).alias("mean"), of(F.max(v)).alias("max"), of(F.min(v)).alias("min"), F.count(v).alias("n"))


def bucket(score: Column, bounds: list[float]) -> Column:
    """The lower bound of the half-open bucket that holds the score; null outside."""
    out = F.lit(None).cast("double")
    for low, high in zip(bounds, bounds[1:], strict=False):
        out = F.when((score >= low) & (score < high), F.lit(float(low))).otherwise(out)
    return out


def threshold_sweep(df: DataFrame, score: str, label: str, thresholds: list[float]) -> DataFrame:
    """(threshold, n, right, tp, fp, fn): the label is predicted where the score reaches the threshold. Each row is counted in one interval first,
    and the thresholds are summed over the few intervals, not over rows times thresholds."""
    from pyspark.sql import Window

    ordered = sorted(thresholds)
    level = F.lit(0)
    for t in ordered:
        level = level + (F.col(score) >= t).cast("int")
    counts = df.where(F.col(score).isNotNull() & ~F.isnan(score)).groupBy(level.alias("level")).agg(
        F.sum(F.col(label).cast("bigint")).alias("pos"), F.sum((~F.col(label)).cast("bigint")).alias("neg")
    )
    steps = df.sparkSession.createDataFrame([(i + 1, float(t)) for i, t in enumerate(ordered)] + [(0, None)], "level int, threshold double")
    filled = steps.join(counts, "level", "left").na.fill(0, ["pos", "neg"])
    above = Window.partitionBy(F.lit(1)).orderBy(F.col("level").desc()).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(F.lit(1))
    sums = filled.select(
        "threshold", F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"), F.sum("pos").over(every).alias("p"), F.sum("neg").over(every).alias("q"),
    ).where("threshold is not null")
    return sums.select("threshold", (F.col("p") + F.col("q")).alias("n"), (F.col("tp") + F.col("q") - F.col("fp")).alias("right"), "tp", "fp", (F.col("p") - F.col("tp")).alias("fn"))


#: Sums of resamples are made in integer units of this part, so they do not depend on the order of rows.
UNIT = 1_000_000


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def occurrences(ratio: float) -> np.ndarray:
    """Poisson numbers of occurrences by a 16-bit draw."""
    below, term = [], math.exp(-ratio)
    for k in range(1, 40):
        below.append((below[-1] if below else 0.0) + term)
        term *= ratio / k
    return np.searchsorted(np.array(below), (np.arange(1 << 16) + 0.5) / (1 << 16), "right").astype("f8")


def bootstrap_sums(df: DataFrame, key: str, values: dict[str, Column], samples: int = 10_000, ratio: float = 0.5, seed: int = 7) -> DataFrame:
    """(i, n, one column a value): size and sums, in millionths, of every resample of ``ratio`` times the rows with replacement; rows with a null value take no part.

    Each row draws its number of occurrences per resample from a Poisson distribution by a hash of (seed, resample, key), four resamples a hash. So resamples need no
    shuffle of rows: sums are made per task as matrix products and only they are shuffled. The result does not depend on the partitioning.
    """
    names, table = list(values), occurrences(ratio)
    words = -(-samples // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        streams = _mixed((np.arange(1, words + 1, dtype="u8") + np.uint64(seed * 1_000_003)) * np.uint64(0x9E3779B97F4A7C15))
        total = np.zeros((1 + len(names), words * 4), "i8")
        for batch in batches:
            keys = batch.column(0).to_numpy().view("u8")
            rows = np.stack([np.ones(len(keys)), *(batch.column(k + 1).to_numpy().astype("f8") for k in range(len(names)))])
            for lo in range(0, len(keys), 64):
                draws = _mixed(keys[lo : lo + 64, None] ^ streams[None, :]).view("u2")
                total += (rows[:, lo : lo + 64] @ table[draws]).astype("i8")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(samples), pa.int32()), *(pa.array(t[:samples]) for t in total)], names=["i", "n", *names])

    units = {name: F.round(v.cast("double") * UNIT).cast("bigint") for name, v in values.items()}
    rows = df.select(F.xxhash64(key).alias("h"), *[u.alias(name) for name, u in units.items()]).na.drop()
    schema = ", ".join(["i int", "n bigint", *(f"{name} bigint" for name in names)])
    return rows.mapInArrow(run, schema).groupBy("i").agg(*[F.sum(c).alias(c) for c in ("n", *names)]).where("n > 0")


def compared(scores: DataFrame) -> DataFrame:
    """One row of resamples (i, a, b): shares that a wins, b wins and of ties, p of the better one, and mean, median and the 95 % and 90 % intervals of b - a
    by sorted index."""
    win = lambda c: F.avg(c.cast("double"))
    inner = scores.agg(F.array_sort(F.collect_list(F.col("b") - F.col("a"))).alias("d"), win(F.col("a") > F.col("b")).alias("a_wins"), win(F.col("b") > F.col("a")).alias("b_wins"))
    n = F.size("d")
    at = lambda q: F.element_at("d", F.floor(n * F.lit(q)).cast("int") + 1)
    mean = F.aggregate("d", F.lit(0.0), lambda s, x: s + x) / n
    median = (F.element_at("d", F.floor((n - 1) / 2).cast("int") + 1) + F.element_at("d", F.floor(n / 2).cast("int") + 1)) / 2
    return inner.where(n > 0).select(
        "a_wins", "b_wins", (1 - F.col("a_wins") - F.col("b_wins")).alias("ties"), (1 - F.greatest("a_wins", "b_wins")).alias("p"), mean.alias("mean"), median.alias("median"),
        at(0.025).alias("low"), at(0.975).alias("high"), at(0.05).alias("low90"), at(0.95).alias("high90"),
    )


def paired_bootstrap(df: DataFrame, key: str, a: str, b: str, samples: int = 10_000, ratio: float = 0.5, gold: str | None = None, seed: int = 7) -> DataFrame:
    """:func:`compared` of two systems over resamples: by the means of their scores, or with ``gold`` by their Pearson correlation with it."""
    if gold is None:
        sums = bootstrap_sums(df, key, {"a": F.col(a), "b": F.col(b)}, samples, ratio, seed)
        return compared(sums.select("i", *[(F.col(c) / F.col("n") / UNIT).alias(c) for c in "ab"]))
    g, x, y = (F.col(c).cast("double") for c in (gold, a, b))
    sums = bootstrap_sums(df, key, {"g": g, "x": x, "y": y, "gg": g * g, "xx": x * x, "yy": y * y, "gx": g * x, "gy": g * y}, samples, ratio, seed)
    m = {c: F.col(c) / F.col("n") / UNIT for c in ("g", "x", "y", "gg", "xx", "yy", "gx", "gy")}
    r = lambda c: (m[f"g{c}"] - m["g"] * m[c]) / F.sqrt(F.nullif((m["gg"] - m["g"] * m["g"]) * (m[c * 2] - m[c] * m[c]), F.lit(0.0)))
    return compared(sums.select("i", r("x").alias("a"), r("y").alias("b")).where("a is not null and b is not null"))


def positions(df: DataFrame, order: str, name: str = "pos") -> DataFrame:
    """``df`` with the dense 0-based position of every row by a unique key: rows are range-partitioned and numbered within their partition, and only the
    partitions' sizes are collected."""
    from tessel.session import cut

    ranged = cut(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id()))
    part, inner = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r["p"], r["n"]) for r in ranged.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    before, total = {}, 0
    for p, n in sizes:
        before[p], total = total, total + n
    offsets = F.create_map(*[F.lit(x).cast("bigint") for pair in before.items() for x in pair]) if before else F.create_map()
    start = F.element_at(offsets, part.cast("bigint")) if before else F.lit(0)
    return ranged.withColumn(name, inner + start).drop("_at")
