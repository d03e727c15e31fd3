"""Inverted-file index over unit vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows the centroids are fitted on, at most: a documented bound; every row is indexed.
SAMPLE = 20_000


def sample_of(rows: DataFrame, seed: int = 7) -> np.ndarray:
    """The vectors of the rows of the least hashes, so the sample does not depend on the partitioning."""
    return np.array([r["vector"] for r in rows.orderBy(F.xxhash64(F.lit(seed), "uid"), "uid").limit(SAMPLE).select("vector").collect()], "f8")


def centroids(x: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means."""
    c = x[:lists].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (near == j).any():
                c[j] = x[near == j].mean(axis=0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def probes_for(x: np.ndarray, c: np.ndarray, k: int, target: float, queries: int = 400) -> int:
    """The fewest lists to probe so that this share of the k nearest neighbours within the sample lies in them, for its first rows as queries."""
    q = x[:queries]
    score = q @ x.T
    score[np.arange(len(q)), np.arange(len(q))] = -np.inf
    near = np.argsort(-score, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    owner = (x @ c.T).argmax(axis=1)
    place = np.argsort(np.argsort(-(q @ c.T), axis=1, kind="stable"), axis=1)  # rank of every list for every query
    depth = np.sort(np.take_along_axis(place, owner[near], axis=1).ravel())
    return int(depth[min(len(depth) - 1, int(np.ceil(target * len(depth))) - 1)]) + 1 if len(depth) else 1


def ivf_search(queries: DataFrame, rows: DataFrame, k: int, target: float = 0.93) -> DataFrame:
    """(uid, other, score, rank): k neighbours of each query within its nearest lists. Lists are joined by their number; the few queries are replicated
    to their probes, the rows are not. There are as many lists as the root of the number of rows (1/16 of the sample at most), and as many are probed as hold the wanted
    share of the neighbours within the sample; every row is indexed."""
    x = sample_of(rows)
    if not len(x):
        return queries.select("uid", F.lit(0).cast("bigint").alias("other"), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
    found = centroids(x, int(min(max(8, rows.count() ** 0.5), max(1, SAMPLE // 16), len(x))))
    probes = probes_for(x, found, k, target)
    c = rows.sparkSession.sparkContext.broadcast(found)

    def nearest(n: int):
        @F.pandas_udf("array<int>")
        def f(v: pd.Series) -> pd.Series:
            x = np.array(v.tolist(), "f8").reshape(len(v), -1)
            return pd.Series(list(np.argsort(-(x @ c.value.T), axis=1, kind="stable")[:, :n].astype("i4")))

        return f

    q = queries.select("uid", F.col("vector").alias("qv"), F.explode(nearest(probes)("vector")).alias("list"))
    r = rows.select(F.col("uid").alias("other"), "vector", nearest(1)("vector")[0].alias("list"))
    dot = F.aggregate(F.zip_with("qv", "vector", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    scored = q.join(r, "list").where("uid <> other").select("uid", "other", F.round(dot, 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("uid").orderBy(F.col("score").desc(), "other"))).where(F.col("rank") <= k)
