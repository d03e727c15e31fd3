from __future__ import annotations

import random
import re
import string

import numpy as np
import pytest

from tessel.llm import overlap_index as O

SCHEMA = "sample_uid bigint, split string, src string, question string, answers array<string>, uid int, side string, cid int"


def key(a):
    return " ".join(re.sub(r"\b(a|an|the)\b", " ", "".join(c for c in a.lower() if c not in string.punctuation)).split())


def brute(rows):
    kept = []
    for uid, split, _, q, answers in rows:
        side = (split or "").strip().lower()
        keys = {key(a) for a in answers or [] if a} - {""}
        w = set(re.findall(r"[^\W_]+", (q or "").lower()))
        if uid is not None and side in ("train", "dev", "test") and w and keys:
            kept.append((uid, side == "train", w, keys))
    return {(a[0], b[0]) for a in kept for b in kept if a[1] and not b[1] and 4 * len(a[2] & b[2]) >= 3 * len(a[2] | b[2]) and a[3] & b[3]}


def corpus(n=150):
    rng = random.Random(2)
    vocab = ["".join(rng.choices(string.ascii_lowercase, k=5)) for _ in range(60)]
    rows = []
    for i in range(n):
        q = rng.sample(vocab, rng.randrange(1, 24))
        rows.append((i, rng.choice(["train", "Train ", "dev"]), None, " ".join(q), [rng.choice(["yes", "the Yes.", "no"])]))
        edited = [w for w in q if rng.random() > 0.08] + rng.sample(vocab, rng.randrange(3))
        rng.shuffle(edited)
        rows.append((1000 + i, rng.choice(["TEST", "dev", "train", None, "other"]), "x", " ".join(edited).title() + "?", ["Yes", None]))
    return rows


@pytest.mark.parametrize("limits", [(60_000, 20_000), (30, 17)])
def test_pairs_against_brute_force(spark, monkeypatch, limits):
    monkeypatch.setattr(O, "class_overlaps", lambda c, least, f=O.class_overlaps: f(c, least, *limits))
    rows = corpus() + [(5000, "dev", None, None, ["yes"]), (5001, "train", None, "", ["yes"]), (5002, "train", None, "w x", None), (5003, "dev", None, "w x", ["the"]), (None, "dev", "", "w x", ["yes"])]
    long = " ".join(f"l{i}" for i in range(3000))
    rows += [(6000, "train", None, long, ["yes"]), (6001, "dev", None, long + " more", ["YES!"]), (6001, "dev", None, long + " more", ["YES!"]), (6002, "test", None, long[:4000], ["yes"])]
    df = spark.createDataFrame([(*r, 1, "s", 2) for r in rows], SCHEMA)
    got = [(r.train_uid, r.eval_uid) for r in O.overlaps(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_a_question_of_many_records(spark, monkeypatch):
    monkeypatch.setattr(O, "BLOCK", 7)
    rows = [(i, "train", None, "who wrote the opera of the old town", ["yes"]) for i in range(40)] + [(100 + i, "dev", None, "who wrote the opera of the town", ["Yes", "no"]) for i in range(50)]
    got = [(r.train_uid, r.eval_uid) for r in O.overlaps(spark.createDataFrame([(*r, 1, "s", 2) for r in rows], SCHEMA)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows) and len(got) == 2000


def test_empty_and_one_sided(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert O.overlaps(empty).count() == 0
    one = spark.createDataFrame([(1, "train", None, "a b", ["x"], 1, "", 1)], SCHEMA)
    assert O.overlaps(one).count() == 0
    assert O.overlap_report(one, O.overlaps(one)).count() == 0


def test_backward_search_counts_and_locates():
    rng = np.random.default_rng(4)
    docs = [np.sort(rng.choice(12, rng.integers(1, 9), replace=False)) for _ in range(40)]
    flat = np.concatenate(docs)
    index = O.ShardIndex.load(O.ShardIndex.build(np.arange(40) + 100, flat.astype("i8"), np.concatenate([[0], np.cumsum([len(d) for d in docs])])).dump())
    for d in docs[:10]:
        for i in range(len(d)):
            for j in range(i + 1, len(d) + 1):
                lo, hi = np.zeros(1, "i8"), np.full(1, len(index.suffix))
                for c in index.codes(d[i:j].astype("i8"))[::-1]:
                    lo, hi = index.extend(np.array([c]), lo, hi)
                occurrences = sum(any((x[k : k + j - i] == d[i:j]).all() for k in range(len(x) - (j - i) + 1)) for x in docs)
                assert hi[0] - lo[0] == occurrences
                found = np.searchsorted(index.starts, index.suffix[lo[0] : hi[0]], "right") - 1
                assert len(set(found.tolist())) == occurrences


def test_parts_needed_are_enough():
    """No choice of missing and inserted words spoils every part."""
    for size in range(1, 30):
        for runs in range(4):
            k = O.parts_needed(size, runs, 3, 4)
            for other in range(1, 60):
                for shared in range(min(size, other) + 1):
                    if 4 * shared >= 3 * (size + other - shared):
                        assert (size - shared) + min(other - shared, runs) < k
