from __future__ import annotations

import random
import re
import string

import numpy as np
import pytest

from tessel.llm import near_dup as N

SCHEMA = "rr_uid bigint, question string, answers array<string>, band int, cid string, n int"


def brute(rows):
    bags = {}
    for uid, q, answers, *_ in rows:
        if uid is None or not q or not any((a or "").strip() for a in answers or []):
            continue
        w = set(re.findall(r"[^\W_]+", " ".join([q, *[a for a in answers if a]]).lower()))
        if w:
            bags[uid] = w
    return {(a, b) for a in bags for b in bags if a < b and 4 * len(bags[a] & bags[b]) >= 3 * len(bags[a] | bags[b])}


def corpus(seed=5, n=120):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices(string.ascii_lowercase, k=6)) for _ in range(400)]
    rows = []
    for i in range(n):
        q = rng.choices(vocab, k=16) + ["the", "of", "in"]
        rows.append((i, " ".join(q), [rng.choice(vocab)]))
        for j in range(rng.randrange(3)):
            edited = [w for w in q if rng.random() > 0.05]
            rng.shuffle(edited)
            rows.append((1000 + 10 * i + j, " ".join(edited) + "?", rows[-1][2]))
    return rows


def test_pairs_against_brute_force(spark):
    rows = corpus() + [(9000, None, ["x"]), (9001, "", ["x"]), (9002, "a b", None), (9003, "a b", []), (9004, "a b", [None, " "]), (9005, "?!", ["..."]), (None, "a b c", ["d"])]
    rows += [(9100, "same words here", ["x"]), (9101, "here same WORDS", ["x", None]), (9101, "here same WORDS", ["x", None])]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    got = [tuple(r) for r in N.record_pairs(*N.near_duplicates(df)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_empty_table(spark):
    assert N.record_pairs(*N.near_duplicates(spark.createDataFrame([], SCHEMA))).count() == 0


def test_crowded_bands_lose_no_pair(spark, monkeypatch):
    """A text with many small edits fills bands beyond the crowd limit."""
    base = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(base + [f"x{i}", f"y{i}"]), ["a"]) for i in range(150)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    assert {tuple(r) for r in N.record_pairs(*N.near_duplicates(df)).collect()} == brute(rows)


@pytest.mark.parametrize("others", [1275, 4275, 22275])
def test_records_of_one_template(spark, others):
    """225 records share 18 words and differ in three rare words each, which one record elsewhere has too: every two of them have a share of exactly 0.75."""
    rng = random.Random(9)
    template = [f"t{i}" for i in range(18)]
    rare = [[f"r{i}a", f"r{i}b", f"r{i}c"] for i in range(225)]
    rows = [(i, " ".join(template + r), ["t0"]) for i, r in enumerate(rare)]
    rows += [(10_000 + i, " ".join([f"o{rng.randrange(9000)}" for _ in range(18)] + (rare[i] if i < 225 else [])), [f"o{i}"]) for i in range(others)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    got = {tuple(r) for r in N.record_pairs(*N.near_duplicates(df)).collect()}
    assert {(a, b) for a in range(225) for b in range(a + 1, 225)} <= got
    assert all(b < 225 for _, b in got if _ < 225)


@pytest.mark.parametrize("crowd", [4, 40])
def test_split_and_salted_crowds_lose_no_pair(spark, monkeypatch, crowd):
    """Crowds beyond the limit: records of one template above and below the share, and near copies of one record."""
    monkeypatch.setattr(N, "CROWD", crowd)
    template, base = [f"t{i}" for i in range(20)], [f"w{i}" for i in range(24)]
    rows = [(i, " ".join(template[: 18 - 6 * (i % 2)] + [f"r{i}x{j}" for j in range(3 + 6 * (i % 2))]), ["t0"]) for i in range(200)]
    rows += [(1000 + i, " ".join(base + [f"y{i % 60}", f"z{i}"]), ["w0"]) for i in range(150)] + [(100_000 + u, q, a) for u, q, a in corpus(6, 40)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    assert {tuple(r) for r in N.record_pairs(*N.near_duplicates(df)).collect()} == brute(rows)


def test_classes_of_many_copies_are_spread(spark, monkeypatch):
    """A third of all records are copies of one; their class meets another large one block by block."""
    monkeypatch.setattr(N, "CROWD", 9)
    base = [f"w{i}" for i in range(20)]
    rows = [(i, " ".join(base), ["a"]) for i in range(60)] + [(100 + i, " ".join(base[:-1]), ["a"]) for i in range(40)] + [(1000 + u, q, a) for u, q, a in corpus(3, 20)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    got = [tuple(r) for r in N.record_pairs(*N.near_duplicates(df)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_parities_bound_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 60, rng.integers(1, 50))) for _ in range(2))
        bits = N.parities(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        assert np.bitwise_count((bits[0] ^ bits[1]).view("u8")) <= len(np.setxor1d(a, b))


def test_prefixes_meet_above_the_share(spark):
    """Two records above the share have a first word in common, whatever the counts."""
    rows = [(i, " ".join(f"v{(i * k) % 23}" for k in range(1, 14)), ["v0"]) for i in range(60)]
    members = N.record_words(spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)).withColumnRenamed("uid", "cid")
    words = {r.cid: set(r.words) for r in members.collect()}
    hot = members.selectExpr("1L as band", "cid as a", "size(words) as n", "0L as bits")
    keys = {}
    for r in N._split(hot, members, 3, 4).collect():
        keys.setdefault(r.cid, set()).add(r.band)
    for a in words:
        for b in words:
            if 4 * len(words[a] & words[b]) >= 3 * len(words[a] | words[b]):
                assert keys[a] & keys[b]


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    a = rng.integers(1, 2**62, 60)
    common = {int(w): int(rng.integers(0, 3)) for w in a[:40]}
    hasher = N.BagMinHash(common, size=4096)
    x, y = np.unique(a[:45]), np.unique(a[10:])
    s = hasher.signatures(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]))
    weight = lambda words: sum(2 ** common.get(int(w), 3) for w in words)
    expected = weight(np.intersect1d(x, y)) / weight(np.union1d(x, y))
    assert abs((s[0] == s[1]).mean() - expected) < 0.04


def test_signature_depends_on_the_bag_only():
    words = np.arange(1, 30) * 7919
    lone = N.BagMinHash({}).bands(words, np.array([0, len(words)]))
    crowd = N.BagMinHash({}).bands(np.concatenate([np.arange(5) + 10**9, words, words[:2]]), np.array([0, 5, 5 + len(words), 7 + len(words)]))
    assert (lone[0] == crowd[1]).all()


def test_one_very_long_record(spark):
    text = " ".join(f"t{i}" for i in range(60_000))
    df = spark.createDataFrame([(1, text, ["a"], 1, "", 1), (2, text + " more", ["a"], 1, "", 1)], SCHEMA)
    assert [tuple(r) for r in N.record_pairs(*N.near_duplicates(df)).collect()] == [(1, 2)]
