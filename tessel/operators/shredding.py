"""Columnar shredding of nested records into repetition and definition levels, and flat tables built back from them.

Every leaf of a nested Arrow column becomes three flat sequences: values, repetition levels (at which repeated ancestor
the entry starts anew; 0 is a new record) and definition levels (how many optional or repeated ancestors are present).
Tables of a repeated ancestor come from these sequences alone: an instance begins wherever the repetition level is at
most the ancestor's, it exists if the definition level reaches the ancestor's, and its position at every repeated
level is a running count. Parent and child lead back to each other by these positions.

Defined cases: a null or empty list has no instances; a null element of a list keeps its position; a null leaf gives a
row whose value is null; unknown JSON members are ignored; a member of another type than declared counts as null;
text that is not one complete JSON value gives no record.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Leaf:
    """One leaf path: level sequences, and ``index`` into ``values`` (-1 where no value is there)."""

    path: tuple[str, ...]
    rep: np.ndarray
    defn: np.ndarray
    index: np.ndarray
    values: pa.Array
    #: (repetition level, definition level) of each repeated ancestor, outermost first
    repeated: list[tuple[int, int]] = field(default_factory=list)

    def ordinal(self, level: int) -> np.ndarray:
        """Position of each entry's instance at repetition ``level`` within the instance one level up; level 0: record."""
        if level == 0:
            return np.cumsum(self.rep == 0) - 1
        running = np.cumsum(self.rep == level)
        starts = np.where(self.rep < level, np.arange(len(self.rep)), 0)
        return running - running[np.maximum.accumulate(starts)] if len(running) else running

    def instance(self, level: int) -> np.ndarray:
        """Number of each entry's instance at ``level`` over the whole column, absent ones counted."""
        return np.cumsum(self.rep <= level) - 1

    def take(self, at: np.ndarray) -> pa.Array:
        got = self.index[at]
        return self.values.take(pa.array(got, mask=got < 0, type=pa.int64()))


def _valid(array: pa.Array) -> np.ndarray:
    return array.is_valid().to_numpy(zero_copy_only=False)


def shred(column: pa.Array, path: str) -> dict[tuple[str, ...], Leaf]:
    """Level sequences of every leaf below ``column``; lists add ``[]``, maps ``{}`` to the path."""
    n = len(column)
    leaves: dict[tuple[str, ...], Leaf] = {}

    def walk(array: pa.Array, at: tuple[str, ...], rep, defn, index, level: int, depth: int, repeated) -> None:
        kind = array.type
        present = index >= 0
        present[present] = _valid(array)[index[present]]
        if pa.types.is_struct(kind):
            defn = defn + present
            index = np.where(present, index, -1)
            for i in range(kind.num_fields):
                walk(array.field(i), (*at, kind.field(i).name), rep, defn, index, level, depth + 1, repeated)
        elif pa.types.is_list(kind) or pa.types.is_large_list(kind) or pa.types.is_map(kind):
            offsets = array.offsets.to_numpy()
            safe = np.where(present, index, 0)
            sizes = np.where(present, offsets[safe + 1] - offsets[safe], 0) if len(array) else np.zeros(len(index), "i8")
            out = np.maximum(sizes, 1)
            first = np.cumsum(out) - out
            within = np.arange(int(out.sum())) - np.repeat(first, out)
            filled = np.repeat(sizes > 0, out)
            child_rep = np.where(within == 0, np.repeat(rep, out), level + 1)
            child_def = np.repeat(defn + present, out) + filled
            child_index = np.where(filled, np.repeat(offsets[safe] if len(array) else safe, out) + within, -1)
            below = [*repeated, (level + 1, depth + 2)]
            if pa.types.is_map(kind):
                for name, part in (("key", array.keys), ("value", array.items)):
                    walk(part, (*at, "{}", name), child_rep, child_def, child_index.copy(), level + 1, depth + 2, below)
            else:
                walk(array.values, (*at, "[]"), child_rep, child_def, child_index, level + 1, depth + 2, below)
        else:
            leaves[at] = Leaf(at, rep, defn + present, np.where(present, index, -1), array, repeated)

    walk(column, (path,), np.zeros(n, "i4"), np.zeros(n, "i4"), np.arange(n), 0, 0, [])
    return leaves


def instances(leaf: Leaf, depth: int) -> np.ndarray:
    """Entries of ``leaf`` at which an existing instance of its ``depth``-th repeated ancestor (from 1) begins."""
    level, least = leaf.repeated[depth - 1]
    return np.flatnonzero((leaf.rep <= level) & (leaf.defn >= least))


def coerce(value: object, kind: pa.DataType) -> object:
    """A parsed JSON value as ``kind``; what does not fit is null."""
    if value is None:
        return None
    if pa.types.is_string(kind):
        if isinstance(value, str):
            return value if value.isascii() else value.encode("utf-8", "surrogatepass").decode("utf-8", "replace")
        return str(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None
    if pa.types.is_integer(kind):
        return value if isinstance(value, int) and not isinstance(value, bool) and abs(value) < 2**31 else None
    if pa.types.is_list(kind):
        return [coerce(x, kind.value_type) for x in value] if isinstance(value, list) else None
    if pa.types.is_map(kind):
        if not isinstance(value, dict):
            return None
        return [(coerce(k, kind.key_type), coerce(v, kind.item_type)) for k, v in value.items()]
    if pa.types.is_struct(kind):
        return {f.name: coerce(value.get(f.name), f.type) for f in kind} if isinstance(value, dict) else None
    raise TypeError(kind)


def load_json(text: str) -> object:
    """``json.loads`` without a limit on the depth: what is nested deeper than the parser written in C goes is read by the one written in Python, whose calls take no C stack."""
    try:
        return json.loads(text)
    except RecursionError:
        decoder = json.JSONDecoder()
        decoder.parse_object, decoder.parse_array = json.decoder.JSONObject, json.decoder.JSONArray
        decoder.scan_once = json.scanner.py_make_scanner(decoder)
        before = sys.getrecursionlimit()
        sys.setrecursionlimit(max(before, 3 * len(text) + 1000))
        try:
            return decoder.decode(text)
        finally:
            sys.setrecursionlimit(before)


def parse_json(texts: pa.Array, kind: pa.DataType) -> tuple[pa.Array, np.ndarray]:
    """Parsed records and the numbers of the rows they come from; incomplete or other text gives none."""
    rows, kept = [], []
    for i, text in enumerate(texts.to_pylist()):
        if text is None:
            continue
        try:
            value = load_json(text)
        except ValueError:
            continue
        if isinstance(value, dict):
            rows.append(coerce(value, kind))
            kept.append(i)
    return pa.array(rows, type=kind), np.array(kept, dtype="i8")


def parse_order(text: str | None) -> list[list[str | None]]:
    """Evidence order in its four encodings as a list of lists: null or empty, a title (bare or as a JSON string), a list
    of titles, a list of lists of titles. Text that is no JSON string or list is a bare title."""
    if text is None or text == "":
        return []
    value: object = text
    if text.lstrip()[:1] in ("[", '"'):
        try:
            value = load_json(text)
        except ValueError:
            value = text
    if isinstance(value, str):
        return [[value]]
    if isinstance(value, list):
        inner = [x if isinstance(x, list) else [x] for x in value]
        return [[coerce(t, pa.string()) if isinstance(t, str) else None for t in x] for x in inner]
    return [[text]]


LINK = pa.struct([("anchor_text", pa.string()), ("span", pa.list_(pa.int32()))])
PAGE = pa.struct(
    [
        (
            "paras",
            pa.list_(
                pa.struct(
                    [
                        ("pid", pa.string()),
                        ("text", pa.string()),
                        ("hyperlinks_cased", pa.map_(pa.string(), pa.list_(LINK))),
                        ("sentence_spans", pa.list_(pa.list_(pa.int32()))),
                    ]
                )
            ),
        )
    ]
)
CHILD = pa.schema(
    [("child", pa.string()), ("rec_id", pa.int64()), ("outer_no", pa.int32()), ("inner_no", pa.int32()), ("title", pa.string())]
)


def _batch(child: str, ids: pa.Array, outer: np.ndarray, inner: np.ndarray, title: pa.Array) -> pa.RecordBatch:
    n = len(ids)
    columns = [
        pa.array([child] * n, pa.string()), ids, pa.array(outer, pa.int32()), pa.array(inner, pa.int32()), title,
    ]
    return pa.RecordBatch.from_arrays(columns, schema=CHILD)


def sample_children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rec_id, pos, neg, bridge), the first two lists of titles, as child rows."""
    for batch in batches:
        ids = batch.column("rec_id")
        for child, name in (("pos_paras", "pos"), ("neg_paras", "neg")):
            leaf = shred(batch.column(name), name)[(name, "[]")]
            at = instances(leaf, 1)
            yield _batch(child, ids.take(pa.array(leaf.ordinal(0)[at])), leaf.ordinal(1)[at], np.zeros(len(at)), leaf.take(at))
        order = pa.array([parse_order(t) for t in batch.column("bridge").to_pylist()], pa.list_(pa.list_(pa.string())))
        leaf = shred(order, "bridge")[("bridge", "[]", "[]")]
        at = instances(leaf, 2)
        titles = leaf.take(at)
        named = pa.compute.fill_null(pa.compute.not_equal(titles, ""), False)
        at = at[named.to_numpy(zero_copy_only=False)]
        yield _batch("bridge", ids.take(pa.array(leaf.ordinal(0)[at])), leaf.ordinal(1)[at], leaf.ordinal(2)[at], leaf.take(at))


def page_children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rec_id, payload) as child rows of the links below each paragraph."""
    for batch in batches:
        pages, kept = parse_json(batch.column("payload"), PAGE)
        leaves = shred(pages, "page")
        base = ("page", "paras", "[]", "hyperlinks_cased", "{}")
        key, entry = leaves[(*base, "key")], leaves[(*base, "value", "[]", "anchor_text")]
        at = instances(entry, 3)
        title = key.take(entry.instance(2)[at])
        ids = batch.column("rec_id").take(pa.array(kept[entry.ordinal(0)[at]]))
        yield _batch("hyperlinks_cased", ids, entry.ordinal(1)[at], entry.ordinal(3)[at], title)


def page_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rec_id, payload) as one row per link title of a paragraph, also where its list is empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("para_no", pa.int32()), ("link", pa.string())])
    for batch in batches:
        pages, kept = parse_json(batch.column("payload"), PAGE)
        key = shred(pages, "page")[("page", "paras", "[]", "hyperlinks_cased", "{}", "key")]
        at = instances(key, 2)
        ids = batch.column("rec_id").take(pa.array(kept[key.ordinal(0)[at]]))
        yield pa.RecordBatch.from_arrays([ids, pa.array(key.ordinal(1)[at], pa.int32()), key.take(at)], schema=schema)


SCHEMA = "child string, rec_id bigint, outer_no int, inner_no int, title string"


def child_rows(samples: DataFrame, pages: DataFrame) -> DataFrame:
    """Flat child rows of ``samples`` (paragraph titles and evidence order) and of the links of ``pages``, each once.

    Only the titles of the nested columns are read. Redelivered records give the same rows, which collapse in the
    partial aggregation before the only shuffle; a payload that once arrived broken counts by its whole delivery.
    Records without a key give no row.
    """
    titles = samples.where("sample_uid is not null").select(
        F.col("sample_uid").alias("rec_id"), F.col("pos_paras.title").alias("pos"), F.col("neg_paras.title").alias("neg"), "bridge"
    )
    links = pages.where("doc_id is not null and payload is not null").select(F.col("doc_id").alias("rec_id"), "payload")
    rows = titles.mapInArrow(sample_children, SCHEMA).unionByName(links.mapInArrow(page_children, SCHEMA))
    return rows.distinct()


PARAS = pa.schema(
    [("rec_id", pa.int64()), ("para_no", pa.int32()), ("pid", pa.string()), ("text", pa.string())]
)
SPANS = pa.schema([("rec_id", pa.int64()), ("para_no", pa.int32()), ("sent_no", pa.int32()), ("s", pa.int32()), ("e", pa.int32())])


def page_paras(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rec_id, payload) as one row per paragraph, the parent of links and sentences by (rec_id, para_no)."""
    for batch in batches:
        pages, kept = parse_json(batch.column("payload"), PAGE)
        leaves = shred(pages, "page")
        text, pid = leaves[("page", "paras", "[]", "text")], leaves[("page", "paras", "[]", "pid")]
        at = instances(text, 1)
        ids = batch.column("rec_id").take(pa.array(kept[text.ordinal(0)[at]]))
        yield pa.RecordBatch.from_arrays([ids, pa.array(text.ordinal(1)[at], pa.int32()), pid.take(at), text.take(at)], schema=PARAS)


def page_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rec_id, payload) as one row per sentence span; a span without two ends has null ends."""
    for batch in batches:
        pages, kept = parse_json(batch.column("payload"), PAGE)
        leaf = shred(pages, "page")[("page", "paras", "[]", "sentence_spans", "[]", "[]")]
        at = instances(leaf, 2)
        after = np.minimum(at + 1, len(leaf.rep) - 1)
        more = (at + 1 < len(leaf.rep)) & (leaf.rep[after] == 3)
        end = leaf.index[after]
        ids = batch.column("rec_id").take(pa.array(kept[leaf.ordinal(0)[at]]))
        ends = leaf.values.take(pa.array(end, mask=(end < 0) | ~more, type=pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(leaf.ordinal(1)[at], pa.int32()), pa.array(leaf.ordinal(2)[at], pa.int32()), leaf.take(at), ends], schema=SPANS
        )


def page_tables(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The paragraph and sentence tables of pages, once per (rec_id, para_no) and (rec_id, para_no, sent_no)."""
    source = pages.where("doc_id is not null and payload is not null").select(F.col("doc_id").alias("rec_id"), "payload")
    paras = source.mapInArrow(page_paras, "rec_id bigint, para_no int, pid string, text string").distinct()
    spans = source.mapInArrow(page_spans, "rec_id bigint, para_no int, sent_no int, s int, e int").distinct()
    return paras, spans
