from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessel.llm import boundary_split as B
from tessel.llm import packing, top_n

TEXTS = st.text(alphabet="ab. !?;,\né́村。‍\U0001f600 ", max_size=400)


@given(TEXTS, st.integers(20, 60), st.integers(1, 9))
@settings(max_examples=150, deadline=None)
def test_pieces_hold_the_text(text, limit, overlap):
    got = B.pieces(text, None, limit, overlap, max(limit // 2, overlap + 1))
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for (a, b), (c, d) in zip(got, got[1:], strict=False):
        assert b - a <= limit and 1 <= b - c <= overlap and d > b and c > a
    assert got[-1][1] - got[-1][0] <= limit


def test_range_maximum_against_brute_force():
    rng = np.random.default_rng(0)
    s = rng.integers(0, 4, 300).astype("u1")
    table = B.RangeMaximum(s, 50, 64)
    for _ in range(500):
        lo = int(rng.integers(50, 340))
        hi = int(min(349, lo + rng.integers(0, 64)))
        window = s[lo - 50 : hi - 49]
        assert table.strongest(lo, hi) == lo + len(window) - 1 - int(window[::-1].argmax())


def test_cuts_prefer_right_spans_to_other_boundaries():
    text = "One two three. " * 4
    spans = [[0, 14], [14, 29], None, [31, 30], [29, 44], [44, 9999]]
    s = B.strengths(text, spans)
    assert [i for i in range(len(s)) if s[i] == B.SPAN] == [14, 29, 44]
    assert B.strengths("ab cd. ef", [[0, 4]])[4] < B.SPAN  # ends inside a word
    assert B.strengths("éx", None).tolist()[1] == B.INSIDE


def test_long_text_over_blocks(monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 4000)
    rng = random.Random(1)
    text = "".join(rng.choice("abc de. ") for _ in range(60_000))
    assert B.pieces(text, None) == (monkeypatch.setattr(B, "BLOCK", 1 << 20) or B.pieces(text, None))


def test_split_dirty_rows(spark):
    df = spark.createDataFrame(
        [(1, "x" * 2500, None, 5, "p"), (1, "x" * 2500, None, 6, "p"), (2, "", [[0, 0]], 5, "p"), (3, None, None, 5, "p"), (None, "y" * 1500, None, 5, "p")],
        "idx bigint, text string, sentence_spans array<array<int>>, loaded_at int, piece string",
    )
    got = B.split_texts(B.oversized(df)).collect()
    assert {r.idx for r in got} == {1} and max(r.end for r in got) == 2500
    assert [(r.idx, r.end) for r in B.split_texts(df.where("idx = 2")).collect()] == [(2, 0)]
    assert B.split_texts(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        B.split_texts(df, 100, 50)


def brute_top(rows, n):
    groups = defaultdict(dict)
    for g, item, s, t in rows:
        if g is not None and item is not None and s is not None and s == s and s != -1:
            groups[g][item] = min(groups[g].get(item, ((9e9,),)), ((-s, t is None, -(t or 0), item),))
    return {(g, v[0][-1]) for g, items in groups.items() for v in sorted(items.values())[:n]}


def test_top_n_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(4000):
        g = 0 if rng.random() < 0.34 else rng.randrange(1, 150)
        rows.append((g, i, rng.choice([None, float("nan"), -1.0, -2.0, 0.0, 0.5, rng.random(), rng.random()]), rng.choice([None, 0.1, 0.2])))
    rows += rng.choices(rows, k=800) + [(None, 1, 0.5, 0.1), (7, None, 0.9, 0.1)]
    df = spark.createDataFrame(rows, "g int, item bigint, s double, t double").withColumns({c: F.lit("x") for c in ("extra", "band", "bucket", "least", "copy", "_least", "mask")})
    run = lambda d: {(r.g, r.item) for r in top_n.top_n(top_n.scored(d, "s"), ["g"], "item", "s", [F.col("t").desc_nulls_last(), F.col("item").asc()], 5).collect()}
    assert run(df) == brute_top(rows, 5) == run(df.repartition(7))
    assert run(df.limit(0)) == set() == run(df.where("s = -1"))
    assert run(df.withColumn("s", F.lit(0.5))) == brute_top([(g, i, 0.5, t) for g, i, _, t in rows], 5)


def test_low_bands_are_dropped_before_the_ranking(spark):
    df = spark.range(20_000).select(F.lit(1).alias("g"), F.col("id").alias("item"), (F.col("id") / 20_000).alias("s"))
    banded = df.withColumn("_band", (F.col("s") >= 0.5).cast("int") + (F.col("s") >= 0.75).cast("int"))
    least = top_n.boundary_bands(banded, ["g"], "item", 5, 0)
    assert [r["_least"] for r in least.collect()] == [2]


@pytest.mark.parametrize("groups", [200_000, 2_000_000])
def test_a_hot_group_loses_its_low_bands_beside_many_groups(spark, groups):
    """However many groups there are: the hot group keeps its top band only, the small ones all their rows, and the ranks are right."""
    hot = spark.range(1_000_000).select(F.lit(-1).cast("bigint").alias("g"), F.col("id").alias("item"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("s"))
    small = spark.range(groups).select(F.col("id").alias("g"), F.col("id").alias("item"), (F.pmod(F.xxhash64("id"), F.lit(997)) / 1000).alias("s"))
    df = hot.unionByName(small)
    left = dict(top_n.candidates(df, ["g"], "item", "s", 5).groupBy(F.col("g") == -1).count().collect())
    assert left[False] == groups and left[True] < 20_000
    best = [r.item for r in top_n.top_n(df, ["g"], "item", "s", [F.col("item").asc()], 5).where("g = -1").orderBy("rank").collect()]
    assert best == [r.item for r in hot.orderBy(F.col("s").desc(), "item").limit(5).collect()]


def brute_place(sizes, capacity):
    """Places by the definition: tries every gap and computes the sum of squares anew."""
    gaps, count = [], defaultdict(int)
    for s in sizes:
        best = None
        for g in sorted({x for x in gaps if x >= s}) + [capacity]:
            trial = defaultdict(int, count)
            if g != capacity:
                trial[g] -= 1
            if g - s:
                trial[g - s] += 1
            total = sum(v * v for v in trial.values())
            if best is None or total < best[0]:
                best = (total, g, trial)
        _, g, count = best
        if g != capacity:
            gaps.remove(g)
        if g - s:
            gaps.append(g - s)
    return sorted(gaps)


@given(st.lists(st.integers(1, 15), max_size=60))
@settings(max_examples=60, deadline=None)
def test_sum_of_squares_choice(sizes):
    where, used = packing.place(np.array(sizes, "i8"), 16)
    assert sorted(16 - used[used < 16]) == brute_place(sizes, 16)
    assert [sum(s for s, w in zip(sizes, where, strict=True) if w == c) for c in range(len(used))] == used.tolist()


def test_pack_invariants(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, 0, 1, 16, 17, 40, rng.randrange(1, 16)])) for i in range(3000)] + [(None, 5)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint").withColumn("task", F.lit(1))
    got = packing.pack(sizes, 16, per_task=200).collect()
    per, docs = defaultdict(int), defaultdict(list)
    for r in got:
        per[r.context_id] += r.n_tokens
        docs[r.doc_id].append((r.piece_no, r.start, r.n_tokens))
    assert all(per[r.context_id] == r.used <= 16 for r in got)
    for i, n in rows:
        if i is not None and n:
            pieces = sorted(docs.pop(i))
            assert [p[0] for p in pieces] == list(range(-(-n // 16))) and [p[1] for p in pieces] == list(range(0, n, 16)) and sum(p[2] for p in pieces) == n
    assert not docs
    assert sum(per.values()) / (16 * len(per)) > 0.98
    assert sorted(map(tuple, got)) == sorted(map(tuple, packing.pack(sizes.repartition(9), 16, per_task=200).collect()))
    assert packing.pack(sizes.limit(0)).count() == 0


def test_items_that_never_fit_together(spark):
    sizes = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit(300).cast("bigint").alias("n_tokens"))
    got = packing.pack(sizes, 512, per_task=100)
    assert got.select("context_id").distinct().count() == 2000


def test_every_cut_of_the_table_is_the_strongest(spark):
    """The pieces of all long paragraphs, cut by looking at every permissible place: at a sentence end wherever the window has one."""
    from tessel.llm.queries import QUERIES

    path = "/root/testdata/sf0.01"
    rows = B.oversized(spark.read.parquet(f"{path}/index_paras.parquet")).collect()
    want, at_sentence, with_sentence = {}, 0, 0
    for r in rows:
        s, start, k, n = B.strengths(r.text, r.sentence_spans), 0, 0, len(r.text)
        strongest = lambda lo, hi, s=s: max(range(lo, hi + 1), key=lambda p: (s[p], p))
        while n - start > 1000:
            end = strongest(start + 500, start + 1000)
            window = s[start + 500 : start + 1001]
            with_sentence += int((window >= B.SENTENCE).any())
            at_sentence += int(s[end] >= B.SENTENCE)
            want[r.idx, k] = (start, end, r.text[start:end])
            start, k = strongest(end - 150, end - 75), k + 1
        want[r.idx, k] = (start, n, r.text[start:])
    got = {(r.idx, r.piece_no): (r.start, r.end, r.piece) for r in QUERIES["p2_pieces"](spark, path).collect()}
    assert got == want and len(rows) > 30 and at_sentence == with_sentence > 30
    for (idx, k), (start, end, piece) in got.items():
        assert 0 < len(piece) <= 1000 and (k == 0) == (start == 0)
        if k:
            assert 1 <= got[idx, k - 1][1] - start <= 150
