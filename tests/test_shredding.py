from __future__ import annotations

import json

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessel.operators import shredding as Sh


def test_levels_of_a_known_record():
    kind = pa.list_(pa.list_(pa.string()))
    leaf = Sh.shred(pa.array([[["a", None], []], None, [], [None, ["b"]]], kind), "x")[("x", "[]", "[]")]
    assert leaf.rep.tolist() == [0, 2, 1, 0, 0, 0, 1]
    assert leaf.defn.tolist() == [5, 4, 3, 0, 1, 2, 5]
    assert leaf.ordinal(1)[Sh.instances(leaf, 2)].tolist() == [0, 0, 1]
    assert leaf.take(Sh.instances(leaf, 2)).to_pylist() == ["a", None, "b"]


title = st.one_of(st.none(), st.text(max_size=3))


@given(st.lists(st.one_of(st.none(), st.lists(st.one_of(st.none(), st.lists(title, max_size=3)), max_size=3)), max_size=5))
@settings(max_examples=80, deadline=None)
def test_instances_lead_back_to_their_record(value):
    leaf = Sh.shred(pa.array(value, pa.list_(pa.list_(pa.string()))), "x")[("x", "[]", "[]")]
    at = Sh.instances(leaf, 2)
    got = list(zip(leaf.ordinal(0)[at].tolist(), leaf.ordinal(1)[at].tolist(), leaf.ordinal(2)[at].tolist(), leaf.take(at).to_pylist(), strict=True))
    assert got == [(r, i, j, t) for r, rec in enumerate(value) for i, x in enumerate(rec or []) for j, t in enumerate(x or [])]


def test_order_encodings():
    assert Sh.parse_order(None) == Sh.parse_order("") == []
    assert Sh.parse_order("A (b)") == [["A (b)"]]
    assert Sh.parse_order('"Q" of R') == [['"Q" of R']]
    assert Sh.parse_order('"x"') == [["x"]]
    assert Sh.parse_order('["a", "b"]') == [["a"], ["b"]]
    assert Sh.parse_order('[["a"], [], ["b", null]]') == [["a"], [], ["b", None]]
    assert Sh.parse_order("[broken") == [["[broken"]]


def test_children_with_dirty_rows(spark):
    page = {"id": "1", "paras": [None, {"hyperlinks_cased": None}, {"hyperlinks_cased": {"T": [{"anchor_text": "a"}, None], "E": []}, "x": 1}, {"hyperlinks_cased": 5}]}
    pages = spark.createDataFrame(
        [(1, json.dumps(page), "t", 9), (1, json.dumps(page)[:30], "t", 9), (2, None, None, None), (3, "[]", None, None), (None, "{}", None, None)],
        "doc_id bigint, payload string, title string, rec_id int",
    )
    para = "array<struct<title:string>>"
    samples = spark.createDataFrame(
        [(7, [("a",), (None,)], None, '[["x"],[],["y",""]]', 1), (7, [("a",), (None,)], None, '[["x"],[],["y",""]]', 2), (8, None, [], None, 3), (None, [("z",)], None, "z", 4)],
        f"sample_uid bigint, pos_paras {para}, neg_paras {para}, bridge string, outer_no int",
    )
    got = {tuple(r) for r in Sh.child_rows(samples, pages).collect()}
    assert got == {
        ("pos_paras", 7, 0, 0, "a"), ("pos_paras", 7, 1, 0, None), ("bridge", 7, 0, 0, "x"), ("bridge", 7, 2, 0, "y"),
        ("hyperlinks_cased", 1, 2, 0, "T"), ("hyperlinks_cased", 1, 2, 1, "T"),
    }
    assert Sh.child_rows(samples.limit(0), pages.limit(0)).count() == 0


def test_deeply_nested_unknown_members(spark):
    """A payload whose unknown member is nested 50,000 deep counts like any other; a broken one does not."""
    depth = 50_000
    page = '{"paras": [{"hyperlinks_cased": {"T": [{"anchor_text": "a"}]}}], "x": ' + "[" * depth + "]" * depth + "}"
    pages = spark.createDataFrame([(1, page), (2, page[:-1])], "doc_id bigint, payload string")
    samples = spark.createDataFrame([(7, "[" * depth + "]" * depth)], "sample_uid bigint, bridge string").selectExpr("*", "cast(null as array<struct<title:string>>) as pos_paras", "cast(null as array<struct<title:string>>) as neg_paras")
    assert [tuple(r) for r in Sh.child_rows(samples, pages).collect()] == [("hyperlinks_cased", 1, 0, 0, "T")]
