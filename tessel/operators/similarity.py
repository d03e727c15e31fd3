"""Nearest rows of a stated query set, compared with a whole table in blocks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.session import read_shared, shared_dir

BLOCK, SLICE = 2_000, 20_000


def compare(queries: DataFrame, corpus: DataFrame, columns: tuple[str, ...], run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, of_corpus: tuple[str, ...] = ()) -> DataFrame:
    """``run`` of every block of queries with every slice of the table, both of bounded size.

    The slices are written to the shared folder, where each task of queries reads one after the other: neither side is copied through a shuffle.
    """
    n, rows = queries.count(), corpus.count()
    slices = max(1, -(-rows // SLICE))
    folder = f"{shared_dir(corpus.sparkSession)}/slices-{uuid.uuid4().hex}"
    sliced = corpus.select("uid", *columns, *of_corpus, F.pmod(F.xxhash64("uid"), F.lit(slices)).alias("slice"))
    sliced.repartition(slices, "slice").write.partitionBy("slice").parquet(folder)
    cores = corpus.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(-(-n // 100), max(2 * cores, -(-n // BLOCK))))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                if size + part.num_rows > BLOCK and waiting:
                    yield from found(pa.Table.from_batches(waiting))
                    waiting, size = [], 0
                waiting, size = [*waiting, part], size + part.num_rows
        if size:
            yield from found(pa.Table.from_batches(waiting))

    def found(block: pa.Table) -> Iterator[pa.RecordBatch]:
        for k in range(slices):
            rows = read_shared(f"{folder}/slice={k}", ["uid", *columns, *of_corpus])
            if rows is not None:
                yield from run(block, rows).to_batches()

    return queries.select("uid", *columns).repartition(tasks, "uid").mapInArrow(stream, schema)


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    offsets = lists.offsets.to_numpy().astype("i8")
    return lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def nearest_by_words(queries: DataFrame, corpus: DataFrame, weighted: bool = False, group: str | None = None) -> DataFrame:
    """(uid, nearest, score): for every query (uid, words) the row of the corpus with the highest cosine of its words, the least uid of equals.

    ``words`` are distinct 64-bit hashes; with ``weighted`` a list ``weights`` of doubles stands beside them, else each counts one. Counts of common words live in one matrix of a block and a few hundred rows at a time, so a word that every row
    holds makes no list of pairs; only one candidate per query leaves a task. Queries without a common word with any row have no result.
    With ``group``, a text column of the corpus, the best row of every group is found: (uid, group, nearest, score), and a candidate per query and group leaves a task.
    """

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        schema = pa.schema([("uid", pa.int64()), *([(group, pa.string())] if group else []), ("nearest", pa.int64()), ("score", pa.float64())])
        if not q.num_rows or not c.num_rows:
            return schema.empty_table()
        c = c.sort_by(group) if group else c
        (qw, qo), (cw, co) = _flat(q.column("words")), _flat(c.column("words"))
        quid, cuid, qn, cn = q.column("uid").to_numpy(), c.column("uid").to_numpy(), np.diff(qo), np.diff(co)
        alphabet, code = np.unique(qw, return_inverse=True)
        by_word = np.argsort(code, kind="stable")
        owner = np.repeat(np.arange(len(quid)), qn)[by_word]
        qv, cv = (_flat(t.column("weights"))[0] if weighted else np.ones(len(w)) for t, w in ((q, qw), (c, cw)))
        qs, cs = (np.bincount(np.repeat(np.arange(len(n)), n), weights=v * v, minlength=len(n)) for v, n in ((qv, qn), (cv, cn)))
        qv = qv[by_word]
        first = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(alphabet)))])
        names, start = np.unique(c.column(group).to_numpy(zero_copy_only=False), return_index=True) if group else ([None], np.zeros(1, "i8"))
        ends, parts = [*start[1:], len(cuid)], []
        for name, begin, end in zip(names, start, ends, strict=True):
            best, at = np.zeros(len(quid)), np.full(len(quid), np.iinfo("i8").max)
            for lo in range(int(begin), int(end), 250):
                hi = min(lo + 250, int(end))
                w = cw[co[lo] : co[hi]]
                k = np.minimum(np.searchsorted(alphabet, w), len(alphabet) - 1)
                hit = alphabet[k] == w
                row, v, k = np.repeat(np.arange(hi - lo), cn[lo:hi])[hit], cv[co[lo] : co[hi]][hit], k[hit]
                n = first[k + 1] - first[k]
                pos = np.repeat(first[k] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                cell = owner[pos] * (hi - lo) + np.repeat(row, n)
                same = np.bincount(cell, weights=qv[pos] * np.repeat(v, n), minlength=len(quid) * (hi - lo)).reshape(len(quid), hi - lo)
                score = same / np.sqrt(qs[:, None] * cs[None, lo:hi])
                top = score.max(axis=1)
                least = np.where(score == top[:, None], cuid[None, lo:hi], np.iinfo("i8").max).min(axis=1)
                better = (top > best) | ((top == best) & (top > 0) & (least < at))
                best, at = np.where(better, top, best), np.where(better, least, at)
            hit = best > 0
            parts.append(pa.table([pa.array(quid[hit]), *([pa.array([name] * int(hit.sum()), pa.string())] if group else []), pa.array(at[hit]), pa.array(best[hit])], schema=schema))
        return pa.concat_tables(parts)

    columns = ("words", *(["weights"] if weighted else []))
    kept = (group,) if group else ()
    found = compare(queries, corpus, columns, run, f"uid bigint, {f'{group} string, ' if group else ''}nearest bigint, score double", kept)
    top = found.groupBy("uid", *kept).agg(F.max(F.struct("score", (-F.col("nearest")).alias("n"))).alias("b"))
    return top.select("uid", *kept, (-F.col("b.n")).alias("nearest"), F.col("b.score").alias("score"))


def nearest_by_vector(queries: DataFrame, corpus: DataFrame, k: int, exclude_self: bool = True) -> DataFrame:
    """(uid, other, score): the k rows of the highest inner product with each query (uid, vector), exact, ties to the least uid.

    Blocked matrix products in double precision; k candidates per query and slice leave a task, then a window keeps k. Vectors must have equal lengths.
    """
    from pyspark.sql import Window

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        schema = pa.schema([("uid", pa.int64()), ("other", pa.int64()), ("score", pa.float64())])
        if not q.num_rows or not c.num_rows:
            return schema.empty_table()
        (qv, qo), (cv, _) = _flat(q.column("vector")), _flat(c.column("vector"))
        width = int(qo[1] - qo[0])
        quid, cuid = q.column("uid").to_numpy(), c.column("uid").to_numpy()
        order = np.argsort(cuid, kind="stable")
        cuid, cm = cuid[order], cv.reshape(-1, width).astype("f8")[order]
        score = np.round(qv.reshape(-1, width).astype("f8") @ cm.T, 9)
        if exclude_self:
            score[quid[:, None] == cuid[None, :]] = -np.inf
        top = np.argsort(-score, axis=1, kind="stable")[:, : min(k, len(cuid))]
        values = np.take_along_axis(score, top, axis=1)
        keep = np.isfinite(values)
        return pa.table([pa.array(np.repeat(quid, top.shape[1])[keep.ravel()]), pa.array(cuid[top][keep]), pa.array(values[keep])], schema=schema)

    found = compare(queries, corpus, ("vector",), run, "uid bigint, other bigint, score double")
    w = Window.partitionBy("uid").orderBy(F.col("score").desc(), "other")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest_by_mean(queries: DataFrame, corpus: DataFrame, gate: float) -> DataFrame:
    """(uid, other, score): for every query (uid, first, second) the other row with the highest mean of both inner products, exact, ties to the least uid.

    Where the first product is below the gate both count as zero. All rows are compared, a few hundred at a time; one candidate per query and slice leaves a task.
    """

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        schema = pa.schema([("uid", pa.int64()), ("other", pa.int64()), ("score", pa.float64())])
        if not q.num_rows or not c.num_rows:
            return schema.empty_table()
        quid, cuid = q.column("uid").to_numpy(), c.column("uid").to_numpy()
        order = np.argsort(cuid, kind="stable")
        cuid = cuid[order]
        halves = lambda t: [_flat(t.column(n))[0].reshape(t.num_rows, -1).astype("f8") for n in ("first", "second")]
        (qa, qb), (ca, cb) = halves(q), (m[order] for m in halves(c))
        best, at = np.full(len(quid), -np.inf), np.zeros(len(quid), "i8")
        for lo in range(0, len(cuid), 500):
            near = slice(lo, lo + 500)
            one = np.round(qa @ ca[near].T, 9)
            score = np.where(one >= gate, np.round((one + qb @ cb[near].T) / 2, 9), 0.0)
            score[quid[:, None] == cuid[None, near]] = -np.inf
            k = score.argmax(axis=1)
            top = score[np.arange(len(quid)), k]
            better = top > best
            best, at = np.where(better, top, best), np.where(better, cuid[near][k], at)
        hit = np.isfinite(best)
        return pa.table([pa.array(quid[hit]), pa.array(at[hit]), pa.array(best[hit])], schema=schema)

    found = compare(queries, corpus, ("first", "second"), run, "uid bigint, other bigint, score double")
    top = found.groupBy("uid").agg(F.max(F.struct("score", (-F.col("other")).alias("n"))).alias("b"))
    return top.select("uid", (-F.col("b.n")).alias("other"), F.col("b.score").alias("score"))


def _cosines(q: pa.Table, c: pa.Table, name: str):
    """f(lo, hi): 100 x cosine of every row of q with the rows lo to hi of c, of the (words, weights) structs of a column; zero where a side is empty."""
    side = lambda t: (_flat(t.column(f"{name}_w"))[0], *_flat(t.column(f"{name}_n")))
    (qw, qv, qo), (cw, cv, co) = side(q), side(c)
    qn, cn = np.diff(qo), np.diff(co)
    alphabet, code = np.unique(qw, return_inverse=True)
    by_word = np.argsort(code, kind="stable")
    owner, value = np.repeat(np.arange(len(qn)), qn)[by_word], qv[by_word]
    qs, cs = (np.bincount(np.repeat(np.arange(len(n)), n), weights=v * v, minlength=len(n)) for v, n in ((qv, qn), (cv, cn)))
    first = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(alphabet)))]).astype("i8")

    def cosines(lo: int, hi: int) -> np.ndarray:
        w = cw[co[lo] : co[hi]]
        if not len(alphabet) or not len(w):
            return np.zeros((len(qn), hi - lo))
        k = np.minimum(np.searchsorted(alphabet, w), len(alphabet) - 1)
        hit = alphabet[k] == w
        row, v, k = np.repeat(np.arange(hi - lo), cn[lo:hi])[hit], cv[co[lo] : co[hi]][hit], k[hit]
        n = first[k + 1] - first[k]
        pos = np.repeat(first[k] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        same = np.bincount(owner[pos] * (hi - lo) + np.repeat(row, n), weights=value[pos] * np.repeat(v, n), minlength=len(qn) * (hi - lo)).reshape(len(qn), hi - lo)
        return np.round(100 * same / np.sqrt(np.maximum(qs[:, None] * cs[None, lo:hi], 1)), 6)

    return cosines


def nearest_by_question_and_answer(queries: DataFrame, corpus: DataFrame, question: float, answer: float) -> DataFrame:
    """(uid, nearest, score): for every query the row of the corpus with the highest mean of question and answer similarity (0 to 100), the least uid of equals.

    Both sides have uid and, for q and a, words as hashes (``q_w``) with counts (``q_n``). A question similarity below its threshold counts as zero; where the answer's is below its own, both do.
    """

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        schema = pa.schema([("uid", pa.int64()), ("nearest", pa.int64()), ("score", pa.float64())])
        if not q.num_rows or not c.num_rows:
            return schema.empty_table()
        c = c.sort_by("uid")
        quid, cuid = q.column("uid").to_numpy(), c.column("uid").to_numpy()
        questions, answers = _cosines(q, c, "q"), _cosines(q, c, "a")
        best, at = np.full(len(quid), -1.0), np.zeros(len(quid), "i8")
        for lo in range(0, len(cuid), 250):
            hi = min(lo + 250, len(cuid))
            one, two = questions(lo, hi), answers(lo, hi)
            score = np.where(two >= answer, (np.where(one >= question, one, 0.0) + two) / 2, 0.0)
            k = score.argmax(axis=1)
            top = score[np.arange(len(quid)), k]
            better = top > best
            best, at = np.where(better, top, best), np.where(better, cuid[lo:hi][k], at)
        return pa.table([pa.array(quid), pa.array(at), pa.array(best)], schema=schema)

    found = compare(queries, corpus, ("q_w", "q_n", "a_w", "a_n"), run, "uid bigint, nearest bigint, score double")
    top = found.groupBy("uid").agg(F.max(F.struct("score", (-F.col("nearest")).alias("n"))).alias("b"))
    return top.select("uid", (-F.col("b.n")).alias("nearest"), F.col("b.score").alias("score"))


def inverted_index(paras: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key, tf, dl): terms of lower-case letters and digits, with term frequency and length."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    rows = paras.where(F.col(text).isNotNull()).select(key, tokens.alias("t")).where("size(t) > 0")
    return rows.select(key, F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("term", key, "dl").agg(F.count("*").alias("tf"))
