"""Overlaps between training and evaluation splits by a compressed full-text index of the evaluation shards.

Every question is written as the sequence of its distinct words, rare words first (one order for all records). The
sequences of a shard of evaluation questions form one text, which is indexed as an FM-index: its Burrows-Wheeler transform in a wavelet
matrix of bit vectors with ranks, and the document of every suffix. Training questions stream through it by backward
search, a batch at a time: every word is extended to the left until nothing matches, which gives the maximal matches and,
on the way, the number of occurrences of each of their parts.

Two questions with a word share of at least t differ in a bounded number of words, so these cannot spoil every one of enough disjoint
parts of the training sequence: a part of one word is spoilt only by a missing word, a longer one also by a word that is
inserted into it. Of the partitions that this guarantees (rare words singly, the rest in up to three runs), the one with the fewest
occurrences in the shard is located; the matches of a document are merged, their offsets bound the words that can
still be shared, and what is left is verified by the exact share of words. So no pair at or above the threshold is lost, whatever
the order of the words, and no occurrence list of a frequent phrase is read.

Equal word sequences are one class on either side. Shards have a bounded size and are written to the shared folder; every task of the training
stream reads them there one after the other, so that neither the index nor the stream is copied through a shuffle, and each slice of it meets each
shard once, as a stated query stream against blocks of an index. Only words in more than 1/1000 of the classes are broadcast (at
most 1000 mean lengths), the order among rarer ones is by hash.

Defined cases: records without a split (or with another one than train, dev, test), question, word or answer are in no pair; case and outer
blanks of the split are ignored; answers that consist of ignored parts only are no answers; redelivered rows count once.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm import hot
from tessel.llm.near_dup import common_words, rare_first, words
from tessel.session import cut, read_shared, shared_dir

#: Evaluation classes of a shard, and training classes that are searched in a shard at a time.
SHARD, SLICE = 60_000, 20_000
#: Records of a task while the cluster has cores for more tasks; beyond that tasks hold a slice.
TASK = 6_000
#: Evaluation records of one question that lie together.
BLOCK = 10_000
COMMON = 1000
#: Words of a run at most: longer matches are no rarer in practice, and tables of a question's parts stay linear in its length.
SPAN = 64
RUNS = 3


class WaveletMatrix:
    """Symbols 0..2^levels-1 with rank over whole arrays of positions."""

    def __init__(self, levels: int, bits: np.ndarray, ranks: np.ndarray, zeros: np.ndarray, begin: np.ndarray):
        self.levels, self.bits, self.ranks, self.zeros, self.begin = levels, bits, ranks, zeros, begin

    @classmethod
    def of(cls, symbols: np.ndarray, sigma: int) -> WaveletMatrix:
        levels, n = max(1, int(sigma - 1).bit_length()), len(symbols)
        size = n // 64 + 1
        bits, ranks, zeros = np.zeros((levels, size), "u8"), np.zeros((levels, size), "u4"), np.zeros(levels, "i8")
        now = symbols
        for k in range(levels):
            bit = (now >> (levels - 1 - k) & 1).astype(bool)
            packed = np.zeros(size * 8, "u1")
            packed[: (n + 7) // 8] = np.packbits(bit, bitorder="little")
            bits[k] = packed.view("<u8")
            ones = np.bitwise_count(bits[k]).astype("u4")
            ranks[k] = np.cumsum(ones) - ones
            zeros[k] = n - int(bit.sum())
            now = np.concatenate([now[~bit], now[bit]])
        at = np.zeros(1 << levels, "i8")
        found, first = np.unique(now, return_index=True)
        at[found] = first
        return cls(levels, bits, ranks, zeros, at)

    def rank(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position; 0 for symbols that do not occur is not promised."""
        at = position
        for k in range(self.levels):
            word = at >> 6
            low = (np.uint64(1) << (at & 63).astype("u8")) - np.uint64(1)
            ones = self.ranks[k][word] + np.bitwise_count(self.bits[k][word] & low)
            bit = (symbol >> (self.levels - 1 - k)) & 1
            at = np.where(bit == 1, self.zeros[k] + ones, at - ones)
        return at - self.begin[symbol]


def suffix_array(text: np.ndarray, sigma: int) -> np.ndarray:
    """By prefix doubling; separators (0) are told apart by position, so sequences never compare beyond their end."""
    n = len(text)
    ends = np.flatnonzero(text == 0)
    rank = text.astype("i8") + len(ends)
    rank[ends] = np.arange(len(ends))
    step = 1
    order = np.argsort(rank, kind="stable")
    while True:
        second = np.zeros(n, "i8")
        second[: n - step] = rank[step:] + 1
        key = rank * (n + len(ends) + sigma + 2) + second if step > 1 else rank * (sigma + len(ends) + 2) + second
        order = np.argsort(key, kind="stable")
        changed = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(n, "i8")
        rank[order] = changed
        if changed[-1] == n - 1:
            return order
        step *= 2


class ShardIndex:
    """FM-index of word sequences: backward search, document and offset of suffixes, and the sequences for verification."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.parts = parts
        self.alphabet, self.documents, self.starts, self.text = (parts[k] for k in ("alphabet", "documents", "starts", "text"))
        self.before, self.suffix = parts["before"], parts["suffix"]
        self.bwt = WaveletMatrix(int(parts["levels"]), parts["bits"], parts["ranks"], parts["zeros"], parts["begin"])

    @classmethod
    def build(cls, ids: np.ndarray, flat: np.ndarray, offsets: np.ndarray) -> ShardIndex:
        """``flat[offsets[i]:offsets[i+1]]``: the ordered word keys of document ``ids[i]``."""
        alphabet, codes = np.unique(flat, return_inverse=True)
        sizes = np.diff(offsets)
        text = np.zeros(len(flat) + len(ids), "i4")
        starts = offsets[:-1] + np.arange(len(ids))
        text[np.arange(len(flat)) + np.repeat(np.arange(len(ids)), sizes)] = codes + 1
        sigma = len(alphabet) + 1
        suffix = suffix_array(text, sigma)
        matrix = WaveletMatrix.of(text[suffix - 1], sigma)
        before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))]).astype("i8")
        return cls(
            {
                "alphabet": alphabet, "documents": ids, "starts": starts.astype("i4"), "text": text, "before": before, "suffix": suffix.astype("i4"),
                "levels": np.array(matrix.levels), "bits": matrix.bits, "ranks": matrix.ranks, "zeros": matrix.zeros, "begin": matrix.begin,
            }
        )

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, **self.parts)
        return out.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> ShardIndex:
        with np.load(io.BytesIO(blob)) as parts:
            return cls({k: parts[k] for k in parts.files})

    def codes(self, keys: np.ndarray) -> np.ndarray:
        """Symbols of word keys, 0 for words that the shard does not hold."""
        at = np.minimum(np.searchsorted(self.alphabet, keys), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == keys, at + 1, 0)

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search over arrays of suffix intervals; symbol 0 matches nothing."""
        ranks = self.bwt.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi])) + np.tile(self.before[symbol], 2)
        lo, hi = ranks[: len(lo)], ranks[len(lo) :]
        return lo, np.where(symbol == 0, lo, hi)


@cache
def parts_needed(size: int, runs: int, num: int, den: int) -> int:
    """How many disjoint parts, ``runs`` of them longer than a word, a question of ``size`` words needs so that any question
    with a word share of at least num/den has one of them unspoilt."""
    worst = 0
    for other in range(-(-size * num // den), size * den // num + 1):
        shared = -(-(size + other) * num // (num + den))
        if shared <= min(size, other):
            worst = max(worst, size - shared + min(other - shared, runs))
    return worst + 1


def search(index: ShardIndex, flat: np.ndarray, offsets: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, document, shared, united) of all pairs of one batch of queries and the shard at or above the share."""
    codes, out = index.codes(flat), []
    sizes = np.diff(offsets)
    by_size = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(by_size):  # questions of similar length, as many as their tables allow
        to = at + max(1, min(2000, 130_000 // (int(sizes[by_size[at]]) + 1)))
        to = at + max(1, int(np.searchsorted(sizes[by_size[at:to]], 2 * sizes[by_size[at]] + 8, "right")))
        out.append(_search(index, codes, offsets, by_size[at:to], num, den))
        at = to
    empty = np.zeros(0, "i8")
    return tuple(np.concatenate([empty, *[x[i] for x in out]]) for i in range(4))


def _search(index: ShardIndex, codes: np.ndarray, offsets: np.ndarray, q: np.ndarray, num: int, den: int):
    size = offsets[q + 1] - offsets[q]
    rows, width = len(q), int(size.max())
    table = np.zeros((rows, width), "i8")
    within = np.arange(width)[None, :] < size[:, None]
    table[within] = codes[np.concatenate([np.arange(offsets[i], offsets[i + 1]) for i in q])]
    row, part, lo, hi = _seeds(index, table, size, num, den)
    count = hi - lo
    keep = count > 0
    row, part, lo, count = row[keep], part[keep], lo[keep], count[keep]
    out, at, edges = [], 0, np.cumsum(count)
    while at < len(row):  # blocks of occurrences
        to = max(at + 1, int(np.searchsorted(edges, (edges[at - 1] if at else 0) + 400_000, "right")))
        out.append(_verify(index, table, size, row[at:to], part[at:to], lo[at:to], count[at:to], num, den))
        at = to
    if not out:
        return (np.zeros(0, "i8"),) * 4
    row, document, shared, united = (np.concatenate(x) for x in zip(*out, strict=True))
    _, first = np.unique(row * len(index.documents) + document, return_index=True)  # matches of a pair merge
    return q[row[first]], index.documents[document[first]], shared[first], united[first]


def _seeds(index: ShardIndex, table: np.ndarray, size: np.ndarray, num: int, den: int):
    """The parts to locate: row, start, suffix interval. Finds the maximal matches (of ``SPAN`` words at most) to the left of every end."""
    rows, width = table.shape
    span = min(width, SPAN)
    lows = np.zeros((rows, width + 1, span + 1), "i4")
    counts = np.zeros((rows, width + 1, span + 1), "i4")  # [row, start, length]; 0 also where a part of it has no match
    row, end = np.nonzero(np.arange(width)[None, :] < size[:, None])
    end = end + 1
    start, lo, hi = end.copy(), np.zeros(len(row), "i8"), np.full(len(row), len(index.suffix))
    while len(row):
        start = start - 1
        lo, hi = index.extend(table[row, start], lo, hi)
        lows[row, start, end - start], counts[row, start, end - start] = lo, hi - lo
        more = (hi > lo) & (start > 0) & (end - start < span)
        row, start, end, lo, hi = row[more], start[more], end[more], lo[more], hi[more]
    every, place = np.arange(rows), np.arange(width + 1)[None, :]
    singles = np.concatenate([np.zeros((rows, 1), "i8"), np.cumsum(counts[:, :width, 1], axis=1, dtype="i8")], axis=1)
    best, choice = np.full(rows, np.iinfo("i8").max), np.zeros((rows, 2 + 2 * RUNS), "i4")  # number of singles, of runs, their starts, their ends
    needed = {(n, r): parts_needed(int(n), r, num, den) for n in np.unique(size) for r in range(RUNS + 1)}
    far = np.int64(1 << 40)
    for runs in range(RUNS + 1):
        single = np.array([needed[int(n), runs] - runs for n in size])
        fits = single + runs <= size
        single = np.clip(single, 0, size)
        # cheapest[e]: the runs so far lie between `single` and e
        cheapest, steps = np.where(place >= single[:, None], np.int64(0), far), []
        for _ in range(runs):
            ending, begin = np.full((rows, width + 1), far), np.zeros((rows, width + 1), "i4")
            for n in range(1, span + 1):
                cost = cheapest[:, : width + 1 - n] + counts[:, : width + 1 - n, n]
                better = cost < ending[:, n:]
                ending[:, n:][better], begin[:, n:][better] = cost[better], np.broadcast_to(place[:, : width + 1 - n], cost.shape)[better]
            ending[place > size[:, None]] = far
            cheapest = np.minimum.accumulate(ending, axis=1)
            least = np.concatenate([np.ones((rows, 1), bool), ending[:, 1:] < cheapest[:, :-1]], axis=1)
            steps.append((begin, np.maximum.accumulate(np.where(least, place, 0), axis=1)))
        cost = singles[every, single] + cheapest[every, size]
        at, edges = size.astype("i8"), np.zeros((rows, 2 * RUNS), "i4")
        for k in range(runs - 1, -1, -1):
            begin, ends = steps[k]
            edges[:, RUNS + k] = end = ends[every, at]
            edges[:, k] = at = begin[every, end]
        better = fits & (cost < best)
        best = np.where(better, cost, best)
        choice[better, 0], choice[better, 1] = single[better], runs
        choice[better, 2:] = edges[better]
    row, start, end = [], [], []
    for k in range(int(choice[:, 0].max())):
        r = np.flatnonzero(choice[:, 0] > k)
        row.append(r), start.append(np.full(len(r), k)), end.append(np.full(len(r), k + 1))
    for k in range(RUNS):
        r = np.flatnonzero(choice[:, 1] > k)
        row.append(r), start.append(choice[r, 2 + k].astype("i8")), end.append(choice[r, 2 + RUNS + k].astype("i8"))
    row, start, end = (np.concatenate(x) for x in (row, start, end))
    lo = lows[row, start, end - start].astype("i8")
    return row, start, lo, lo + counts[row, start, end - start]


def _verify(index, table, size, row, part, lo, count, num: int, den: int):
    """Documents of the suffix intervals, bounded by the offsets of their matches, and the exact share of words."""
    row, part = np.repeat(row, count), np.repeat(part, count)
    first = np.cumsum(count) - count
    at = index.suffix[np.repeat(lo - first, count) + np.arange(int(count.sum()))].astype("i8")
    document = np.searchsorted(index.starts, at, "right") - 1
    ends = np.append(index.starts[1:], len(index.text)) - 1
    other, offset = ends[document] - index.starts[document], at - index.starts[document]
    most = np.minimum(part, offset) + np.minimum(size[row] - part, other - offset)
    keep = most * den >= (size[row] + other - most) * num
    row, document, other = row[keep], document[keep], other[keep]
    pair = np.unique(row * len(index.documents) + document)
    row, document = pair // len(index.documents), pair % len(index.documents)
    other = ends[document] - index.starts[document]
    tokens = index.text[np.repeat(index.starts[document] - (np.cumsum(other) - other), other) + np.arange(int(other.sum()))]
    sigma = len(index.alphabet) + 1
    keys = np.sort((np.arange(len(table))[:, None] * sigma + table)[table > 0])
    probe = np.repeat(row, other) * sigma + tokens
    hit = keys[np.minimum(np.searchsorted(keys, probe), len(keys) - 1)] == probe if len(keys) else np.zeros(len(probe), bool)
    shared = np.bincount(np.repeat(np.arange(len(row)), other), weights=hit, minlength=len(row)).astype("i8")
    united = size[row] + other - shared
    keep = shared * den >= united * num
    return row[keep], document[keep], shared[keep], united[keep]


def answer_key(answer: Column) -> Column:
    """An answer without case, punctuation, the words a, an, the and surplus blanks."""
    bare = F.regexp_replace(F.lower(answer), r"[\p{P}\p{S}]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "), r"(?U)\s+", " "))


def samples(df: DataFrame) -> DataFrame:
    """(uid, side, split, src, words, keys, cid): one row per record that can be in a pair; side is train or eval."""
    split = F.lower(F.trim("split"))
    rows = df.where(F.col("sample_uid").isNotNull() & split.isin("train", "dev", "test") & (F.length("question") > 0) & F.col("answers").isNotNull())
    keys = F.array_distinct(F.filter(F.transform("answers", answer_key), lambda a: F.length(a) > 0))
    rows = rows.select(
        F.col("sample_uid").alias("uid"), F.when(split == "train", "train").otherwise("eval").alias("side"), split.alias("split"),
        F.coalesce("src", F.lit("hotpotqa")).alias("src"), F.transform(words("question"), lambda w: F.xxhash64(w)).alias("words"), keys.alias("keys"),
    ).where((F.size("words") > 0) & (F.size("keys") > 0))
    once = rows.groupBy("uid").agg(F.max(F.struct("side", "split", "src", "words", "keys")).alias("r")).select("uid", "r.*")
    return once.withColumn("words", F.array_sort("words")).withColumn("cid", F.xxhash64("words"))


def class_overlaps(classes: DataFrame, least: tuple[int, int] = (3, 4), shard: int = SHARD, slice_: int = SLICE) -> DataFrame:
    """(train_cid, eval_cid, shared, united): pairs of classes (side, cid, words) of the two sides at or above the share."""
    num, den = least
    spark = classes.sparkSession
    sizes = {r["side"]: r["count"] for r in classes.groupBy("side").count().collect()}
    ranked = spark.sparkContext.broadcast(common_words(classes, sum(sizes.values()), COMMON))
    shards = max(1, -(-sizes.get("eval", 0) // shard))

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        flat, offsets = rare_first(rows.column("words"), ranked.value)
        index = ShardIndex.build(rows.column("cid").to_numpy(), flat, offsets)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "index": pa.array([index.dump()], pa.binary())})

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every shard once for each slice of a task's training classes; the index is read where it is written."""
        waiting, rows = [], 0
        for batch in batches:
            waiting, rows = [*waiting, batch], rows + batch.num_rows
            if rows >= slice_:
                yield from found(pa.Table.from_batches(waiting))
                waiting, rows = [], 0
        if rows:
            yield from found(pa.Table.from_batches(waiting))

    def found(train: pa.Table) -> Iterator[pa.RecordBatch]:
        flat, offsets = rare_first(train.column("words"), ranked.value)
        cids = train.column("cid").to_numpy()
        for k in range(shards):
            for index in shard_at(folder, k):
                q, *rest = search(index, flat, offsets, num, den)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cids[q], *rest)], names=["train_cid", "eval_cid", "shared", "united"])

    of = lambda side: classes.where(F.col("side") == side).select("cid", "words")
    built = of("eval").withColumn("shard", F.pmod(F.xxhash64("cid"), F.lit(shards))).groupBy("shard").applyInArrow(build, "shard bigint, index binary")
    folder = f"{shared_dir(spark)}/overlap-{uuid.uuid4().hex}"
    built.write.partitionBy("shard").parquet(folder)
    return of("train").mapInArrow(stream, "train_cid bigint, eval_cid bigint, shared bigint, united bigint")


@lru_cache(maxsize=2)
def shard_at(folder: str, shard: int) -> list[ShardIndex]:
    """The index of a shard in the shared folder, none if no class fell into it; a worker keeps the last two."""
    rows = read_shared(f"{folder}/shard={shard}", ["index"])
    return [] if rows is None else [ShardIndex.load(blob.as_py()) for blob in rows.column("index")]


def overlaps(df: DataFrame, least: tuple[int, int] = (3, 4)) -> DataFrame:
    """(train_uid, eval_uid, shared, united, split, src): all overlapping records with an answer in common."""
    records = cut(samples(df))
    n, cores = records.count(), df.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(-(-n // TASK), max(2 * cores, -(-n // SLICE))))
    classes = records.repartition(tasks, "cid").groupBy("side", "cid").agg(F.min("words").alias("words"))
    pairs = class_overlaps(classes, least)
    of = lambda side: records.where(F.col("side") == side).select("uid", "cid", "split", "src", F.explode("keys").alias("key"))
    train = of("train").select(F.col("uid").alias("train_uid"), F.col("cid").alias("train_cid"), "key")
    held = of("eval").select(F.col("uid").alias("eval_uid"), F.col("cid").alias("eval_cid"), "split", "src", "key")
    large = hot.large_keys(held.select("eval_cid"), "eval_cid", BLOCK)
    joined = hot.to_blocks(pairs.join(train, "train_cid"), "eval_cid", large).join(hot.in_blocks(held, "eval_cid", "eval_uid", large), ["eval_cid", "key", "_block"])
    return joined.select("train_uid", "eval_uid", "shared", "united", "split", "src").distinct()


def overlap_report(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per evaluation split and source: records, records with an overlap, pairs, and exact ones (equal words)."""
    total = samples(df).where("side = 'eval'").groupBy("split", "src").agg(F.count("*").alias("records"))
    found = pairs.groupBy("split", "src").agg(
        F.countDistinct("eval_uid").alias("overlapping"), F.count("*").alias("pairs"), F.sum((F.col("shared") == F.col("united")).cast("bigint")).alias("exact_pairs"),
    )
    return total.join(found, ["split", "src"], "left").na.fill(0, ["overlapping", "pairs", "exact_pairs"])
