"""Field search against sums by hand; its queries are compared with SQL elsewhere."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessel.operators import search as S
from tests.conftest import DATA

FIELDS = {"a": ("a", S.letters, 1.25), "b": ("b", S.standard, 1.0), "b.pairs": ("b", S.pairs, 1.1)}


def terms(field, text):
    words = text.lower().split()
    if field == "b":
        return [w for w in words if w not in S.STOPS]
    return words + [f"{x} {y}" for x, y in zip(words, words[1:], strict=False)] if field == "b.pairs" else words


def brute(docs, queries, k, allowed, barred):
    out = {}
    index = {f: {d: Counter(terms(f, row[0 if f == "a" else 1] or "")) for d, row in docs.items()} for f in FIELDS}
    for q, text in queries.items():
        best = defaultdict(float)
        for f, (_, _, boost) in FIELDS.items():
            held = {d: c for d, c in index[f].items() if c}
            mean = sum(sum(c.values()) for c in held.values()) / len(held)
            for t in set(terms(f, text)):
                df = sum(t in c for c in held.values())
                held_t = {d: c for d, c in held.items() if t in c}
                for d, c in held_t.items():
                    part = boost * math.log(1 + (len(held) - df + 0.5) / (df + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
                    best[f, d] += part
        score = {d: round(max(best[f, d] for f in FIELDS), 6) for d in docs if any((f, d) in best for f in FIELDS)}
        ranked = sorted((-s, d) for d, s in score.items() if (allowed is None or d in allowed) and (q, d) not in barred)[:k]
        out[q] = [(d, -s) for s, d in ranked]
    return out


@pytest.mark.parametrize("slice_, restricted", [(10_000, False), (7, True)])
def test_best_field_and_k_best(spark, monkeypatch, slice_, restricted):
    monkeypatch.setattr(S, "SLICE", slice_)
    rng = random.Random(8)
    vocab = [f"w{chr(97 + i)}" for i in range(12)] + ["the", "of"]
    docs = {i: (" ".join(rng.choices(vocab, k=rng.randrange(1, 4))), rng.choice([None, "", " ".join(rng.choices(vocab, k=rng.randrange(1, 12)))])) for i in range(60)}
    queries = {i: " ".join(rng.choices(vocab, k=4)) for i in range(15)}
    allowed = set(range(0, 60, 2)) if restricted else None
    barred = {(q, d) for q in queries for d in range(0, 60, 6)} if restricted else set()
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in docs.items()], "idx bigint, a string, b string")
    asked = spark.createDataFrame([*queries.items(), (99, None), (98, "zzz")], "uid bigint, q string")
    found = S.search(
        S.field_index(rows, "idx", FIELDS), S.field_terms(asked, "uid", "q", FIELDS), 5, FIELDS, rows.where("idx % 2 = 0").select("idx") if restricted else None,
        spark.createDataFrame(sorted(barred), "uid bigint, idx bigint") if restricted else None,
    )
    got = defaultdict(list)
    for r in found.orderBy("query", "rank").collect():
        got[r.query].append((r.key, r.score))
    want = {q: r for q, r in brute(docs, queries, 5, allowed, barred).items() if r}
    assert set(got) == set(want)
    for q in want:
        assert [d for d, _ in got[q]] == [d for d, _ in want[q]] and all(abs(x - y) < 2e-6 for (_, x), (_, y) in zip(got[q], want[q], strict=True))


def test_nothing_to_search(spark):
    rows = spark.createDataFrame([(1, None, "")], "idx bigint, a string, b string")
    asked = spark.createDataFrame([(1, "x")], "uid bigint, q string")
    index = S.field_index(rows, "idx", FIELDS)
    assert S.search(index, S.field_terms(asked, "uid", "q", FIELDS), 3, FIELDS).count() == 0
    full = S.field_index(rows.withColumn("a", F.lit("x")), "idx", FIELDS)
    assert S.search(full, S.field_terms(asked.limit(0), "uid", "q", FIELDS), 3, FIELDS).count() == 0


def test_terms_are_counted_document_by_document(spark, monkeypatch):
    """No aggregation holds the terms of a part of the table, which at 1 GB filled the heap; the postings are those counted by hand."""
    from pyspark.sql.readwriter import DataFrameWriter

    plans, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **b: (plans.append(self._df._jdf.queryExecution().executedPlan().toString()), write(self, *a, **b))[1])
    monkeypatch.setattr(S, "SLICE", 7)
    docs = {i: ("w" + "x" * (i % 3), " ".join(["the", "ab", "cd", "ab"][: i % 5])) for i in range(40)}
    index = S.field_index(spark.createDataFrame([(i, a, b) for i, (a, b) in docs.items()], "idx bigint, a string, b string"), "idx", FIELDS)
    assert len(plans) == 1 and "MapInArrow" in plans[0] and "Aggregate" not in plans[0]
    want = {f: {i: Counter(terms(f, row[0 if f == "a" else 1])) for i, row in docs.items()} for f in FIELDS}
    postings = spark.read.parquet(index.folder).collect()
    assert len({r.slice for r in postings}) == index.slices == 6
    for j, f in enumerate(FIELDS):
        assert sorted((r.key, r.tf, r.dl) for r in postings if r.f == j) == sorted((i, n, sum(c.values())) for i, c in want[f].items() for n in c.values())
        lengths = [sum(c.values()) for c in want[f].values() if c]
        assert (index.docs[j], index.mean[j]) == (len(lengths), pytest.approx(sum(lengths) / len(lengths)))


def test_many_slices(spark, monkeypatch):
    """Fields passed over below the k-th best score so far leave the same documents, also among ties."""
    monkeypatch.setattr(S, "SLICE", 40)
    rng = random.Random(5)
    vocab = [f"w{chr(97 + i)}" for i in range(26)]
    docs = {i: (" ".join(rng.choices(vocab, k=2)), " ".join(rng.choices(vocab[:9], k=rng.randrange(2, 6)))) for i in range(400)}
    queries = {i: " ".join(rng.choices(vocab, k=3) + rng.choices(vocab[:9], k=3)) for i in range(30)}
    index = S.field_index(spark.createDataFrame([(i, a, b) for i, (a, b) in docs.items()], "idx bigint, a string, b string"), "idx", FIELDS)
    barred = {(q, d) for q in queries for d in range(q, 400, 9)}
    found = S.search(index, S.field_terms(spark.createDataFrame([*queries.items()], "uid bigint, q string"), "uid", "q", FIELDS), 4, FIELDS, barred=spark.createDataFrame(sorted(barred), "uid bigint, idx bigint"))
    got = defaultdict(list)
    for r in found.orderBy("query", "rank").collect():
        got[r.query].append(r.key)
    assert got == {q: [d for d, _ in r] for q, r in brute(docs, queries, 4, None, barred).items()}


def broadcast_searches(df):
    """Searches below a broadcast in a plan, which bring all their rows to the driver."""
    lines, out, inside = df._jdf.queryExecution().executedPlan().toString().splitlines(), [], None
    for line in lines:
        depth = len(line) - len(line.lstrip(" :+-*()0123456789"))
        inside = None if inside is not None and depth <= inside else inside
        if "BroadcastExchange" in line and inside is None:
            inside = depth
        out += [line] if inside is not None and "MapInArrow run(" in line else []
    assert any("MapInArrow run(" in line for line in lines)
    return out


def test_title_rerank_sends_no_hits_to_the_driver(spark):
    from tessel.plans import retrieval

    assert not broadcast_searches(retrieval.l13_rerank_by_title(spark, DATA))


def test_negative_candidates_send_no_hits_to_the_driver(spark):
    from tessel.plans import rest

    assert not broadcast_searches(rest.j22_negative_candidates(spark, DATA))


def test_labels_bar_all_their_documents(spark, monkeypatch):
    """Labels, null ones among them, leave the documents that their pairs with questions leave."""
    monkeypatch.setattr(S, "SLICE", 40)
    rng = random.Random(3)
    vocab = [f"w{chr(97 + i)}" for i in range(9)]
    docs = {i: (" ".join(rng.choices(vocab, k=2)), " ".join(rng.choices(vocab, k=rng.randrange(2, 6)))) for i in range(200)}
    label = {i: rng.choice([None, "", "x", "y", "z", *vocab]) for i in docs if i % 3}
    queries = {i: " ".join(rng.choices(vocab, k=4)) for i in range(20)}
    gone = [(q, x) for q in queries for x in [*rng.choices(["", "x", "y", "elsewhere", *vocab], k=q % 5), None]] * 2
    index = S.field_index(spark.createDataFrame([(i, a, b) for i, (a, b) in docs.items()], "idx bigint, a string, b string"), "idx", FIELDS)
    asked = S.field_terms(spark.createDataFrame([*queries.items()], "uid bigint, q string"), "uid", "q", FIELDS)
    found = S.search(index, asked, 6, FIELDS, spark.createDataFrame([*label.items()], "idx bigint, title string"), spark.createDataFrame(gone, "uid bigint, title string"))
    got = defaultdict(list)
    for r in found.orderBy("query", "rank").collect():
        got[r.query].append(r.key)
    barred = {(q, i) for q, x in gone for i in label if x is not None and label[i] == x}
    assert got == {q: [d for d, _ in r] for q, r in brute(docs, queries, 6, set(label), barred).items()}


def test_search_page_writes_no_pairs_of_questions_and_paragraphs(spark, tmp_path):
    """Where titles repeat, the pairs of questions and paragraphs of gold titles grow with the product of both: they are neither joined nor aggregated, and no hit is barred."""
    from tessel.plans import retrieval

    rows = spark.read.parquet(f"{DATA}/index_paras.parquet").limit(1)
    rows.select(F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(60).cast("bigint"))).alias("n"), "*").select(
        *[{"idx": F.col("n"), "title": F.when(F.col("n") <= 50, "Gold"), "text": F.lit("some words"), "for_hotpot": F.lit(True)}.get(c, F.col(c)).alias(c) for c in rows.columns]
    ).write.parquet(f"{tmp_path}/index_paras.parquet")
    asked = spark.read.parquet(f"{DATA}/iter_queries.parquet").limit(1)
    asked.select(F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(20).cast("bigint"))).alias("n"), "*").select(
        *[{"query_uid": F.col("n"), "question": F.lit("words"), "sp": F.array(F.lit("Gold"), F.lit(None))}.get(c, F.col(c)).alias(c) for c in asked.columns]
    ).write.parquet(f"{tmp_path}/iter_queries.parquet")
    page = retrieval.l12_search_page(spark, str(tmp_path))
    assert "Join" not in page._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.query_uid, r.idx) for r in page.collect()) == [(q, i) for q in range(1, 21) for i in range(53, 58)]
