"""Lexical search over several boosted fields: BM25 per field, the best field counts, the k best documents of every question."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions import text as T
from tessel.functions import udf
from tessel.session import read_shared, shared_dir

# The stop words of the search engine's English analyser.
STOPS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
K1, B = 1.2, 0.75
#: Documents of a slice of the postings, terms of questions of a task where there are more than the cluster has cores for, and postings that are sorted at once.
SLICE, BLOCK, CELLS = 10_000, 300_000, 200_000


def letters(x: Column) -> Column:
    """Runs of letters in lower case."""
    return F.regexp_extract_all(F.lower(x), F.lit(r"\p{L}+"), F.lit(0))


def standard(x: Column) -> Column:
    """Runs of letters and digits in lower case without stop words."""
    return F.filter(F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: ~w.isin(*STOPS))


def _with_pairs(tokens: Column) -> Column:
    return T.let(tokens, lambda t: F.concat(t, F.transform(F.slice(t, F.lit(2), F.size(t)), lambda w, i: F.concat(F.get(t, i), F.lit(" "), w))))


def pairs(x: Column) -> Column:
    """Words and every two neighbours of a text in lower case without accents."""
    return _with_pairs(F.regexp_extract_all(x, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def pairs_without_stops(x: Column) -> Column:
    """The same over the words that are no stop words."""
    return _with_pairs(F.filter(F.regexp_extract_all(x, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: ~w.isin(*STOPS)))


#: Analysers that take texts in lower case without accents.
FOLDED = (pairs, pairs_without_stops)


#: Field -> (column, analyser, boost).
FIELDS: dict[str, tuple[str, Callable[[Column], Column], float]] = {
    "title": ("title", letters, 1.25), "title_unescaped": ("title_unescaped", letters, 1.25), "text": ("text", standard, 1.0),
    "title.bigram": ("title", pairs, 1.25), "title_unescaped.bigram": ("title_unescaped", pairs, 1.25), "text.bigram": ("text", pairs_without_stops, 1.0),
}


class Index(NamedTuple):
    """Postings (t, key, f, tf, dl) in the shared folder by slices of documents, with the number of documents and the mean length of every field."""

    folder: str
    slices: int
    docs: tuple[float, ...]
    mean: tuple[float, ...]


_POSTINGS = "slice int, t bigint, key bigint, f int, tf int, dl int"


def field_index(docs: DataFrame, key: str, fields: dict | None = None) -> Index:
    """Terms of every field, as hashes of both, with frequency and field length; null and empty fields have none. Documents are spread by slice first and their terms are
    counted a batch of documents at a time, so that no task holds the terms of more. Written once to the shared folder."""
    fields = fields or FIELDS
    spark = docs.sparkSession
    slices = max(1, -(-docs.count() // SLICE))
    at = F.pmod(F.xxhash64(F.col(key)), F.lit(slices)).cast("int")
    parts = -(-2 * spark.sparkContext.defaultParallelism // slices)  # tasks of a slice, where there are few slices
    rows = _tokens(docs, key, [(name, c, analyse) for name, (c, analyse, _) in fields.items()], (slices * parts, at, F.pmod(F.hash(F.col(key)), F.lit(parts))))
    counted = rows.select(at.alias("slice"), F.col(key).cast("bigint").alias("key"), "x.f", "x.h").mapInArrow(_count, _POSTINGS)
    folder = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    counted.sortWithinPartitions("slice", "t", "key").write.partitionBy("slice").parquet(folder)
    # the frequencies of a field of a document add up to its length, so their shares of it to one document
    sums = spark.read.schema(_POSTINGS).parquet(folder).groupBy("f").agg(F.sum("tf").alias("length"), F.round(F.sum(F.col("tf") / F.col("dl"))).alias("docs"))
    found = {r["f"]: (r["docs"], r["length"] / r["docs"]) for r in sums.collect()}  # a row a field
    return Index(folder, slices, *zip(*(found.get(i, (0.0, 1.0)) for i in range(len(fields))), strict=True))


def field_terms(queries: DataFrame, query: str, text: str, fields: dict | None = None) -> DataFrame:
    """(query, f, h): the distinct terms of every question as each field analyses it, as hashes of field and term."""
    rows = _tokens(queries.where(F.col(text).isNotNull()), query, [(name, text, analyse) for name, (_, analyse, _) in (fields or FIELDS).items()])
    return rows.select(F.col(query).cast("bigint").alias("query"), "x.f", F.array_distinct("x.h").alias("h"))


def _tokens(rows: DataFrame, key: str, fields: list[tuple[str, str, Callable[[Column], Column]]], spread: tuple | None = None) -> DataFrame:
    """(key, x: struct(f, h)): the hashed terms of every field that has any. Accents are dropped before the rows are spread, so that no exchange follows."""
    folded = sorted({c for _, c, analyse in fields if analyse in FOLDED})
    plain = sorted({c for _, c, _ in fields} - {key})
    rows = rows.select(key, *plain, *[udf.fold(F.lower(c)).alias(f"_folded_{c}") for c in folded])
    rows = rows.repartition(*spread) if spread else rows
    parts = [F.struct(F.lit(i).alias("f"), _hashes(name, analyse(F.col(f"_folded_{c}" if analyse in FOLDED else c))).alias("h")) for i, (name, c, analyse) in enumerate(fields)]
    return rows.select(key, F.explode(F.array(*parts)).alias("x")).where("size(x.h) > 0")


def _hashes(field: str, tokens: Column) -> Column:
    return F.transform(tokens, lambda w: F.xxhash64(F.lit(field), w))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of the lists of a column, and the length of every list."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], np.diff(offsets)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        t, dl = _flat(batch.column("h"))
        row = np.repeat(np.arange(len(dl)), dl)
        order = np.lexsort((t, row))
        t, row = t[order], row[order]
        starts = np.flatnonzero(np.concatenate([np.ones(min(len(t), 1), bool), (np.diff(t) != 0) | (np.diff(row) != 0)]))
        row, tf = row[starts], np.diff(np.append(starts, len(t)))
        of = lambda c: batch.column(c).to_numpy()[row]  # noqa: E731, B023
        yield pa.RecordBatch.from_arrays(
            [pa.array(of("slice")), pa.array(t[starts]), pa.array(of("key")), pa.array(of("f")), pa.array(tf.astype("i4")), pa.array(dl[row].astype("i4"))],
            names=["slice", "t", "key", "f", "tf", "dl"],
        )


def search(index: Index, terms: DataFrame, k: int, fields: dict | None = None, allowed: DataFrame | None = None, barred: DataFrame | None = None) -> DataFrame:
    """(query, key, score, rank): the k documents of the highest score for every question, ties to the least key; keys are bigint.

    The score is the highest over the fields of boost times BM25. ``allowed`` (key, or key and label, one a document) restricts the documents, ``barred`` (query, key, or
    query and label where the allowed have labels) excludes some of a question; neither changes the statistics of the index. Labels stand for all their documents, so that
    no pair of a question and a document is written down; they are compared by hash. Only the questions and what they bar are shuffled: each task of them reads the slices of the index in the shared folder one after the other,
    first to count the documents of its terms, then to score, and keeps the k best of every question. A field of a question is passed over in a slice only
    where its terms together cannot reach the k-th best score so far, so the result is exact; memory is that of a slice and the questions of a task.
    """
    boosts = np.array([float(boost) for _, _, boost in (fields or FIELDS).values()])
    spark = terms.sparkSession
    kept, labelled = None, allowed is not None and len(allowed.columns) > 1
    hashed = lambda c: F.when(F.col(c).isNotNull(), F.xxhash64(F.col(c).cast("string")) if labelled else F.col(c).cast("bigint"))
    if allowed is not None:
        kept = f"{shared_dir(spark)}/allowed-{uuid.uuid4().hex}"
        key = F.col(allowed.columns[0])
        rows = allowed.where(key.isNotNull()).select(F.pmod(F.xxhash64(key), F.lit(index.slices)).cast("int").alias("slice"), key.cast("bigint").alias("key"), hashed(allowed.columns[-1]).alias("label"))
        rows.repartition("slice").write.partitionBy("slice").parquet(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(_flat(b.column("h")), b.column("query").to_numpy(), b.column("f").to_numpy()) for b in batches if b.num_rows]
        if parts:
            query, f, t = (np.concatenate(x) for x in zip(*((np.repeat(q, n), np.repeat(f, n), t) for (t, n), q, f in parts), strict=True))
            del parts
            yield _ranked(index, kept, boosts, query, f, t, k)

    n = terms.agg(F.sum(F.size("h"))).first()[0] or 0
    tasks = max(1, min(-(-n // 3_000), max(2 * spark.sparkContext.defaultParallelism, -(-n // BLOCK))))
    if barred is not None:
        out = barred.toDF("query", "out").where("query is not null and out is not null")
        terms = terms.unionByName(out.select(F.col("query").cast("bigint"), F.lit(-1).alias("f"), F.array(hashed("out")).alias("h")))
    return terms.repartition(tasks, "query").mapInArrow(run, "query bigint, key bigint, score double, rank int")


class Slice(NamedTuple):
    """Postings of a slice by term and document: distinct terms, where their postings begin (and the last end), their highest share; documents and shares; the documents' keys in order,
    the label of each (the key itself if none were given) and whether it has one."""

    terms: np.ndarray
    starts: np.ndarray
    most: np.ndarray
    doc: np.ndarray
    share: np.ndarray
    keys: np.ndarray
    label: np.ndarray
    labelled: np.ndarray


def _runs(t: np.ndarray) -> np.ndarray:
    """Where the runs of a sorted array begin, and its length."""
    return np.concatenate([np.flatnonzero(np.concatenate([np.ones(min(len(t), 1), bool), t[1:] != t[:-1]])), [len(t)]])


def documents_of(index: Index, part: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct terms of a slice in order, and the number of their documents."""
    table = read_shared(f"{index.folder}/slice={part}", ["t"])
    t = np.zeros(0, "i8") if table is None else table.column("t").to_numpy()
    t = t if (t[1:] >= t[:-1]).all() else np.sort(t)
    starts = _runs(t)
    return t[starts[:-1]], np.diff(starts)


@lru_cache(maxsize=2)
def slice_of(index: Index, kept: str | None, part: int) -> Slice:
    """A slice of the index, of the documents allowed if a folder of them is given; a worker keeps the last two slices."""
    table = read_shared(f"{index.folder}/slice={part}", ["t", "key", "f", "tf", "dl"])
    if table is not None and kept:
        some = read_shared(f"{kept}/slice={part}", ["key", "label"])
        table = None if some is None else table.filter(pc.is_in(table.column("key"), value_set=some.column("key").combine_chunks()))
    if table is None or not table.num_rows:
        return Slice(*(np.zeros(n, kind) for n, kind in ((0, "i8"), (1, "i8"), (0, "f8"), (0, "i8"), (0, "f8"), (0, "i8"), (0, "i8"), (0, "?"))))
    t, key, f, tf, dl = (table.column(c).to_numpy() for c in ("t", "key", "f", "tf", "dl"))
    coded = table.column("key").combine_chunks().dictionary_encode()
    coded = coded if isinstance(coded, pa.DictionaryArray) else pa.chunked_array([coded]).combine_chunks()
    keys = np.sort(coded.dictionary.to_numpy())
    doc = np.searchsorted(keys, coded.dictionary.to_numpy())[coded.indices.to_numpy()]
    share = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / np.array(index.mean)[f]))
    if not ((t[1:] > t[:-1]) | ((t[1:] == t[:-1]) & (doc[1:] >= doc[:-1]))).all():
        order = np.lexsort((doc, t))
        t, doc, share = t[order], doc[order], share[order]
    starts = _runs(t)
    label, labelled = keys, np.ones(len(keys), bool)
    if kept:
        owner, order = some.column("key").to_numpy(), some.column("key").to_numpy().argsort(kind="stable")
        at = order[np.searchsorted(owner, keys, sorter=order)]
        label, labelled = pc.fill_null(some.column("label"), 0).to_numpy()[at], some.column("label").is_valid().to_numpy()[at]
    return Slice(t[starts[:-1]], starts, np.maximum.reduceat(share, starts[:-1]), doc, share, keys, label, labelled)


def _find(terms: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of values in a sorted array, and whether they are there."""
    at = np.minimum(np.searchsorted(terms, wanted), max(len(terms) - 1, 0))
    return at, terms[at] == wanted if len(terms) else np.zeros(len(wanted), bool)


def _spans(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from every first on, n each."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _ranked(index: Index, kept: str | None, boosts: np.ndarray, query: np.ndarray, f: np.ndarray, t: np.ndarray, k: int) -> pa.RecordBatch:
    """(query, key, score, rank) of the k best documents of the questions whose terms are given; entries with f = -1 exclude the documents of label t."""
    asked, row = np.unique(query, return_inverse=True)
    gone, own = np.flatnonzero(f < 0), np.flatnonzero(f >= 0)
    labels, out = np.unique(t[gone], return_inverse=True)
    barred = np.unique(row[gone] * max(len(labels), 1) + out)  # questions x labels
    out_row, out = np.divmod(barred, max(len(labels), 1))
    row, f, t = row[own], f[own], t[own]
    alphabet, code = np.unique(t, return_inverse=True)
    df = np.zeros(len(alphabet))
    for part in range(index.slices):
        terms, n = documents_of(index, part)
        at, hit = _find(terms, alphabet)
        df[hit] += n[at[hit]]
    w = boosts[f] * np.log(1 + (np.array(index.docs)[f] - df[code] + 0.5) / (df[code] + 0.5))
    group = row * len(boosts) + f
    order = np.argsort(group, kind="stable")
    group, code, w = group[order], code[order], w[order]
    del row, f, t, query, order
    top = (np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0))
    least = np.zeros(len(asked))  # the k-th best score so far of every question
    for part in range(index.slices if len(group) else 0):
        s = slice_of(index, kept, part)
        if not len(s.keys):
            continue
        at, hit = _find(s.terms, alphabet)
        here = np.flatnonzero(hit[code])
        most_out = 0  # documents that a question bars here, at most
        if len(out):
            label, known = _find(labels, s.label)
            known &= s.labelled
            most_out = int(np.bincount(out_row, np.bincount(label[known], minlength=len(labels))[out]).max())
        cell, score = _cells(s, group[here], at[code[here]], w[here], least, len(boosts), k + most_out)
        r, d = np.divmod(cell, len(s.keys))
        if len(out):
            free = ~(_find(barred, r * len(labels) + label[d])[1] & known[d])
            r, d, score = r[free], d[free], score[free]
        good = score >= least[r]
        rows, keys, scores = (np.concatenate(x) for x in zip(top, (r[good], s.keys[d[good]], score[good]), strict=True))
        order = np.lexsort((keys, -scores, rows))
        rank = np.arange(len(order)) - np.searchsorted(rows[order], rows[order])
        order, rank = order[rank < k], rank[rank < k]
        top = rows[order], keys[order], scores[order]
        least[top[0][rank == k - 1]] = top[2][rank == k - 1]
    rank = np.arange(len(top[0])) - np.searchsorted(top[0], top[0]) + 1
    return pa.RecordBatch.from_arrays([pa.array(asked[top[0]]), pa.array(top[1]), pa.array(top[2]), pa.array(rank.astype("i4"))], names=["query", "key", "score", "rank"])


def _cells(s: Slice, group: np.ndarray, term: np.ndarray, w: np.ndarray, least: np.ndarray, fields: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells (question x documents + document) of a slice with their scores: all that may reach the k-th best score so far of their question, ``least``.

    A group is a field of a question; entries are sorted by it. Its postings are passed over where all its terms together stay below ``least`` in any document of the slice.
    """
    width = len(s.keys)
    begins = _runs(group)
    if len(begins) == 1:
        return np.zeros(0, "i8"), np.zeros(0)
    begin, size = begins[:-1], np.diff(begins)
    question = group[begin] // fields
    first, n = s.starts[term], s.starts[term + 1] - s.starts[term]
    total = np.add.reduceat(n, begin)
    bar = least[question] - 1e-6  # scores are rounded to 6 places
    able = np.add.reduceat(w * s.most[term], begin) >= bar
    found = []
    few = total * 16 <= width
    chosen = np.flatnonzero(able & few)
    ends = _runs((np.cumsum(total[chosen]) - 1) // CELLS)
    for lo, hi in zip(ends[:-1], ends[1:], strict=True):  # fields with few postings: sorted by document
        g = chosen[lo:hi]
        e = _spans(begin[g], size[g])
        post = _spans(first[e], n[e])
        cell = np.repeat(g * width, total[g]) + s.doc[post]
        by = np.argsort(cell, kind="stable")
        cell = cell[by]
        starts = _runs(cell)[:-1]
        score, cell = np.add.reduceat((np.repeat(w[e], n[e]) * s.share[post])[by], starts), cell[starts]
        near = score >= bar[cell // width]
        found.append((question[cell[near] // width] * width + cell[near] % width, score[near]))
    sums = np.empty(width)
    entries = [x.tolist() for x in (first, first + n, w)]
    for g in np.flatnonzero(able & ~few).tolist():  # the others: added up over all documents
        sums[:] = 0
        for a, b, v in zip(*(x[begins[g] : begins[g + 1]] for x in entries), strict=True):
            np.add.at(sums, s.doc[a:b], v * s.share[a:b])
        low = bar[g]
        if low <= 0 and width > k:  # until a question has k documents, the k-th best of the field itself
            low = np.partition(sums, width - k)[width - k] - 1e-6
        doc = np.flatnonzero(sums >= max(low, 1e-300))
        found.append((question[g] * width + doc, sums[doc]))
    if not found:
        return np.zeros(0, "i8"), np.zeros(0)
    cell, score = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(cell):
        return cell, score
    by = np.argsort(cell, kind="stable")
    starts = _runs(cell[by])[:-1]
    return cell[by][starts], np.round(np.maximum.reduceat(score[by], starts), 6)
