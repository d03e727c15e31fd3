"""Builders of records: evidence order, packed contexts, negatives, and seeded draws."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions import text as T
from tessel.session import cut


def draw(seed: int, *key: Column | str) -> Column:
    """A number in [0, 1) that depends on the seed and the key only: 28 bits of an MD5 digest, so that any SQL engine can draw the same."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in key]).cast("binary"))
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("bigint") / (1 << 28)


def spans_to_sentences(text: Column, spans: Column, labels: Column) -> Column:
    """Stripped, closed sentences of the labelled spans; labels out of range and empty sentences are passed over."""

    def one(i: Column) -> Column:
        span = F.get(spans, i)
        return T.close_sentence(T.strip(F.substring(text, F.get(span, F.lit(0)) + 1, F.get(span, F.lit(1)) - F.get(span, F.lit(0)))))

    return F.filter(F.transform(F.filter(labels, lambda i: (i >= 0) & (i < F.size(spans))), one), lambda s: s != "")


def pack_budget(df: DataFrame, group: list[str], order: list[Column], cost: Column, budget: int) -> DataFrame:
    """The first rows of every group whose running cost stays below the budget; a row that does not fit ends its group (costs are positive)."""
    total = F.sum(cost).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("total", total).where(F.col("total") < budget)


def top_up(groups: DataFrame, have: DataFrame, excluded: DataFrame, pool: DataFrame, group: str, item: str, n: int, seed: int = 7, width: int = 8) -> DataFrame:
    """(group, item, origin): all items that every group of ``groups`` has, none of them excluded, and where they are fewer than ``n`` items of the pool up to n.

    The pool is cut into hash buckets of about ``width`` items, as many as it takes; a group that lacks items draws a few buckets by its own hash, takes those items that
    it neither has nor excludes in its own hash order, and draws again while it lacks any. So no group meets the whole pool and no bucket is hot. A pool of at most 64 n
    items is one bucket; a group ends below n only where the pool itself is exhausted. The state is checkpointed every round.
    """
    pairs = lambda df: df.select(group, item).where(f"{group} is not null and {item} is not null")
    barred = pairs(excluded).distinct()
    own = cut(pairs(have).distinct().join(barred, [group, item], "left_anti"))
    every = groups.select(group).where(F.col(group).isNotNull()).distinct()
    missing = lambda rows, found, k: rows.join(found.groupBy(group).agg(F.count("*").alias("_k")), group, "left").select(group, (k - F.coalesce("_k", F.lit(0))).alias("need")).where("need > 0")
    lacking = cut(missing(every, own, F.lit(n)))
    items = cut(pool.select(item).where(F.col(item).isNotNull()).distinct())
    total = items.count()
    buckets = total // width if total > 64 * n else 1
    items = items.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), item), F.lit(buckets)))
    draws = 2 * -(-n // width) + 1 if buckets > 1 else 1
    out, taken = own.select(group, item, F.lit("own").alias("origin")), own.unionByName(barred)
    for r in range(60):
        if not total or lacking.isEmpty():
            return out
        bucket = F.pmod(F.xxhash64(F.lit(seed), F.lit(r), group, F.col("j")), F.lit(buckets)).alias("bucket")
        drawn = lacking.select(group, "need", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("j")).select(group, "need", bucket).distinct()
        offered = drawn.join(items, "bucket").drop("bucket").join(taken, [group, item], "left_anti")
        order = Window.partitionBy(group).orderBy(F.xxhash64(F.lit(seed), group, item), item)
        found = cut(offered.withColumn("rn", F.row_number().over(order)).where("rn <= need").select(group, item))
        out, taken = out.unionByName(found.select(group, item, F.lit("pool").alias("origin"))), taken.unionByName(found)
        if buckets == 1:
            return out
        lacking = cut(missing(lacking, found, F.col("need")))
    raise RuntimeError("the pool does not fill all groups")


def capped(rows: DataFrame, group: str, order: list[Column], most: int | None) -> DataFrame:
    """The first ``most`` rows of every group, or all; the limit acts before the shuffle."""
    if most is None:
        return rows
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_rn") <= most).drop("_rn")


def step_levels(rows: DataFrame, key: str, at: str, title: str, later: str) -> DataFrame:
    """Adds ``level``: 0 for steps that depend on no other, then one level for each dependent step in order; without independent steps the first dependent one is at 0.
    A title that a group has had already gets its place as a suffix."""
    again = F.row_number().over(Window.partitionBy(key, title).orderBy(at)) > 1
    named = rows.withColumn("_again", again).withColumn(title, F.when(F.col("_again"), F.concat(title, F.lit("("), F.col(at).cast("string"), F.lit(")"))).otherwise(F.col(title))).drop("_again")
    independent = F.max((~F.col(later)).cast("int")).over(Window.partitionBy(key))
    nth = F.sum(F.col(later).cast("int")).over(Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, 0))
    return named.withColumn("level", F.when(F.col(later), independent + nth - 1).otherwise(0).cast("int"))


def consolidate_evidence(rows: DataFrame, key: str, set_no: str, title: str, label: str, at: str) -> DataFrame:
    """(key, set_no, title, labels, single) of evidence sets, a row per sentence (with its place ``at`` in the set).

    Sets of one sentence merge by title with sorted distinct labels, as any of them will do (single, no set_no). In a set of several sentences all are needed: it keeps its
    number and its titles with their labels; if all are of one title, each sentence gets a name of its own, title_vvv0, title_vvv1, in order.
    """
    sizes = rows.groupBy(key, set_no).agg(F.count("*").alias("_n"), F.countDistinct(title).alias("_titles"))
    sized = rows.join(sizes, [key, set_no])
    lone = sized.where("_n = 1").groupBy(key, title).agg(F.array_sort(F.collect_set(label)).alias("labels"))
    several = sized.where("_n > 1").groupBy(key, set_no, title, label, "_titles").agg(F.min(at).alias("_at"))
    number = F.row_number().over(Window.partitionBy(key, set_no).orderBy("_at")) - 1
    apart = several.where("_titles = 1").select(key, set_no, F.concat(title, F.lit("_vvv"), number.cast("string")).alias(title), F.array(label).alias("labels"))
    joint = several.where("_titles > 1").groupBy(key, set_no, title).agg(F.array_sort(F.collect_set(label)).alias("labels"))
    none = F.lit(None).cast(dict(rows.dtypes)[set_no]).alias(set_no)
    every = lone.select(key, none, title, "labels", F.lit(True).alias("single"))
    return every.unionByName(apart.unionByName(joint).select(key, set_no, title, "labels", F.lit(False).alias("single")))


def pack_cut(df: DataFrame, group: list[str], order: list[Column], words: str, most: int) -> DataFrame:
    """Rows of every group in order while they fit ``most``, each costing its words and one; the first that does not fit is cut to what is left, less one, and ends its group.

    Adds ``kept``, the words that stay, and ``cut``, whether they are fewer than the row has.
    """
    before = F.coalesce(F.sum(F.size(words) + 1).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = df.withColumn("_before", before).withColumn("cut", F.col("_before") + F.size(words) > most)
    first = F.max(F.col("cut").cast("int")).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_ended", first).where("_ended is null or _ended = 0")
    left = F.greatest(F.lit(0), F.lit(most) - F.col("_before") - 1).cast("int")
    return rows.withColumn("kept", F.when(F.col("cut"), F.slice(words, F.lit(1), left)).otherwise(F.col(words))).drop("_before", "_ended")


def permutations(df: DataFrame, key: str, items: str, separator: str = ", ") -> DataFrame:
    """(key, value): all orders of a list of two or more texts, joined; made one after the other, so that long lists need no memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, texts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                orders = itertools.permutations([t or "" for t in texts])
                while part := [separator.join(o) for o in itertools.islice(orders, 10_000)]:
                    yield pa.RecordBatch.from_arrays([pa.array([uid] * len(part), pa.int64()), pa.array(part, pa.string())], names=[key, "value"])

    return df.where(F.size(items) > 1).select(F.col(key).cast("bigint"), items).mapInArrow(run, f"{key} bigint, value string")
