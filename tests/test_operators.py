from __future__ import annotations

import argparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.operators import builders, encode, graph, iteration, ivf, lookups, similarity, statistics


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (5, 5), (None, 4)] + [(i, i + 1) for i in range(100, 160)]
    got = dict(graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10} | {i: 100 for i in range(100, 161)}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_grouped_metrics_sentinel(spark):
    df = spark.createDataFrame([("a", 0.5), ("a", -1.0), ("a", None), ("b", -1.0), (None, float("nan"))], "g string, m double")
    got = {r.grp: (r["mean"], r["max"], r.n) for r in statistics.grouped_metrics(df, "g", ["m"]).collect()}
    assert got == {"a": (0.5, 0.5, 1), "b": (-1.0, -1.0, 0), "None": (-1.0, -1.0, 0)}


def test_sweep_and_bootstrap_do_not_depend_on_partitions(spark):
    df = spark.range(500).select("id", (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("s"), (F.col("id") % 3 == 0).alias("l"), F.lit(0.4).alias("b"))
    one, seven = (statistics.paired_bootstrap(df.repartition(n), "id", "s", "b", 50).collect() for n in (1, 7))
    assert one == seven
    sweep = {r.threshold: (r.tp, r.fp, r.fn) for r in statistics.threshold_sweep(df, "s", "l", [0.5, 0.2]).collect()}
    rows = df.collect()
    for t, got in sweep.items():
        assert got == (sum(r.l for r in rows if r.s >= t), sum(not r.l for r in rows if r.s >= t), sum(r.l for r in rows if r.s < t))
    assert statistics.threshold_sweep(df.limit(0), "s", "l", [0.5]).first().n == 0


def test_title_outcomes(spark):
    docs = spark.createDataFrame([("Cat", 0), ("cat", 1), ("Dog", 2), ("A & B", 3), (None, 4)], "title string, idx bigint")
    links = spark.createDataFrame([("cat",), ("CAT",), ("Dog",), ("dog",), ("A &amp; B",), ("zebra",), (None,)], "link string")
    got = {r.link: (r.title, r.status, r.idx) for r in lookups.map_titles(links, docs).collect()}
    assert got == {
        "cat": ("cat", "mok", 1), "CAT": ("Cat", "mc", 0), "Dog": ("Dog", "sok", 2), "dog": ("Dog", "sc", 2), "A &amp; B": ("A & B", "sc", 3),
        "zebra": ("zebra", "nf", -1), None: (None, None, None),
    }


def test_nearest_by_vector_and_ivf_recall(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "uid bigint, vector array<float>")
    queries = rows.where("uid % 20 = 0")
    exact = {(r.uid, r.other) for r in similarity.nearest_by_vector(queries, rows, 5).collect()}
    f = x.astype("f4").astype("f8")
    score = np.round(f @ f.T, 9)
    np.fill_diagonal(score, -9)
    assert exact == {(i, int(j)) for i in range(0, 400, 20) for j in np.argsort(-score[i], kind="stable")[:5]}
    found = {(r.uid, r.other) for r in ivf.ivf_search(queries, rows, 5).collect()}
    assert len(exact & found) / len(exact) >= 0.9
    assert similarity.nearest_by_vector(queries.limit(0), rows, 5).count() == 0


def test_budget_and_top_up(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 1, 9), (1, 2, 1), (2, 0, 20)], "g int, i int, c int")
    kept = builders.pack_budget(df, ["g"], [F.col("i")], F.col("c"), 10).collect()
    assert [(r.g, r.i) for r in kept] == [(1, 0)]
    pool = spark.range(500).select(F.col("id").cast("string").alias("t"))
    have = spark.createDataFrame([(g, str(i)) for g in range(20) for i in range(g % 4)], "g int, t string")
    groups = spark.range(20).select(F.col("id").alias("g"))
    got = builders.top_up(groups, have, have.limit(0), pool, "g", "t", 6)
    counts = got.groupBy("g").count().collect()
    assert len(counts) == 20 and all(r["count"] == 6 for r in counts)
    assert got.groupBy("g", "t").count().where("count > 1").count() == 0
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, builders.top_up(groups, have.repartition(5), have.limit(0), pool.repartition(3), "g", "t", 6).collect()))


def test_batch_encoding(spark):
    """Vectors of unit length that depend on the words only, in whatever batches the texts come; the encoder sees bounded batches."""
    texts = [f"word{i % 7} other {i}" for i in range(700)] + ["", "?!", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string")
    got = {r.id: np.array(r.vector) for r in encode.encode(df, "id", "t", encode.HashingEncoder(32)).collect()}
    again = {r.id: np.array(r.vector) for r in encode.encode(df.repartition(5), "id", "t", encode.HashingEncoder(32), batch=9).collect()}
    assert set(got) == set(range(702)) and all((got[i] == again[i]).all() for i in got)
    assert all(abs(np.linalg.norm(got[i]) - 1) < 1e-6 for i in range(700)) and not got[700].any() and not got[701].any()
    assert got[0] @ got[7] > got[0] @ got[3]  # more words in common
    assert encode.encode(df.limit(0), "id", "t", encode.HashingEncoder()).count() == 0


def test_parameters_of_arguments():
    assert iteration.Steps.of_arguments([]) == iteration.Steps()
    p = iteration.Steps.of_arguments(["--beam_size", "7", "--s2_sp_thresh", "0.25", "--no-stop_lowerev", "--max_hops", "2"])
    assert (p.beam, p.thresh, p.lower, p.hops, p.topk) == (7, 0.25, False, 2, iteration.Steps().topk)
    with pytest.raises((SystemExit, argparse.ArgumentError)):
        iteration.Steps.of_arguments(["--nothing", "1"])
