"""Near-duplicate records by BagMinHash signatures of word bags, banded and verified exactly.

A record is the bag of its words with a discretised weight per word, 2^level. Each word runs one Poisson process per weight interval (0,1], (1,2],
(2,4], (4,8], with the interval's width as its rate; a weight takes part in the intervals below it, so the hierarchy never draws points it would
discard. A point has a time and one of the signature's components; the earliest point of a component over all words of a record is its signature
there, and two records agree in a component with the probability of their weighted Jaccard similarity. Bands of components are joined, and every
candidate is verified by the exact share of words.

The wanted share counts every distinct word once, so near-duplicates are sought with weight 1 for each word: the signature then estimates the very
share that is asked for, whatever else the collection holds. (Weights by rarity would be more selective, but records that share frequent words and
differ in rare ones, as those made from one template do, would have a low weighted similarity at any share.) With 36 bands of 5 components a pair
of share s is missed with a chance of (1 - s^5)^36: below 0.006 % at 0.75, the lowest share that counts, and less above.

What bands bring together by chance is dropped where it lies, without loss: each row carries the parities of its words over 64 cells, and as many
cells as differ, as many words differ at least. A band that very many records share is split by the rarest words of its records: two records above the
share have one of their first n - ceil(n * share) + 1 words in rare-first order in common, so records that only share a frequent phrasing do not
meet. What still meets in great numbers is joined in salted blocks.

Records with equal words are one class first, so copies are neither banded nor verified twice. Words broadcast for the order within crowded bands
are those in more than 1/512 of their records, fewer than 512 mean record lengths.

Defined cases: null or empty questions, and answers that are null, empty or hold only null or empty strings, are in no pair; records
without any word are in no pair; repeated words count once for the share; redelivered rows count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm import hot
from tessel.session import cut

BANDS, ROWS = 36, 5
WIDTHS = (1.0, 1.0, 2.0, 4.0)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Words whose arrivals a worker keeps: memory only.
KEPT = 50_000
#: Rows of a band that are paired where they lie; longer runs are split further. Every pair is found either way.
CROWD = 4096
#: Words in more than this part of the records are ordered by their counts, rarer ones by hash.
COMMON = 512


def words(*texts: Column | str) -> Column:
    """The distinct words of texts and lists of texts, sorted."""
    joined = F.lower(F.concat_ws(" ", *texts))
    return F.array_sort(F.array_distinct(F.regexp_extract_all(joined, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class BagMinHash:
    """Signatures of bags; ``levels`` maps word hashes to the levels of their weights, ``rest`` is the level of all other words."""

    def __init__(self, levels: dict[int, int], size: int = BANDS * ROWS, rest: int = len(WIDTHS) - 1):
        self.size, self.rest = size, rest
        self.common = np.array(sorted(levels), "i8")
        self.levels = np.array([levels[w] for w in sorted(levels)], "i8")
        self.horizon = size * (np.log(size) + 4) / (20 * sum(WIDTHS[: rest + 1]))  # enough for most records of twenty words
        self.known, self.first = np.zeros(0, "i8"), np.zeros((0, size), "f4")

    def level(self, unique: np.ndarray) -> np.ndarray:
        out = np.full(len(unique), self.rest)
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, unique), len(self.common) - 1)
            hit = self.common[at] == unique
            out[hit] = self.levels[at[hit]]
        return out

    def arrivals(self, unique: np.ndarray, horizon: float) -> np.ndarray:
        """Earliest time up to ``horizon`` of every word and component, infinite where there is none."""
        first = np.full(len(unique) * self.size, np.inf, "f4")
        level = self.level(unique)
        for k, width in enumerate(WIDTHS):
            mine = np.flatnonzero(level >= k)
            mean = width * horizon
            draws = int(mean + 7 * np.sqrt(mean) + 12)
            for part in np.array_split(mine, max(1, len(mine) * draws // 2_000_000)):
                if not len(part):
                    continue
                seed = mix(unique[part].astype("u8") ^ mix(np.full(1, k + 1, "u8")))
                bits = mix(seed[:, None] + np.arange(1, draws + 1, dtype="u8")[None, :] * GOLDEN)
                gaps = -np.log(((bits >> np.uint64(11)).astype("f8") + 0.5) / 2**53) / width
                times = np.cumsum(gaps, axis=1)
                within = times <= horizon
                component = (mix(bits) % np.uint64(self.size)).astype("i8") + part[:, None] * self.size
                np.minimum.at(first, component[within], times[within].astype("f4"))
        return first.reshape(len(unique), self.size)

    def rows_of(self, unique: np.ndarray) -> np.ndarray:
        """Rows of the kept table for the words, which are added where they miss."""
        missing = np.setdiff1d(unique, self.known, assume_unique=True)
        if len(self.known) + len(missing) > KEPT:
            self.known, self.first, missing = np.zeros(0, "i8"), np.zeros((0, self.size), "f4"), unique
        if len(missing):
            known = np.concatenate([self.known, missing])
            order = np.argsort(known)
            self.first = np.concatenate([self.first, self.arrivals(missing, self.horizon)])[order]
            self.known = known[order]
        return np.searchsorted(self.known, unique)

    def signatures(self, flat: np.ndarray, offsets: np.ndarray, horizon: float | None = None) -> np.ndarray:
        """(records, size) arrival times of the bags flat[offsets[i]:offsets[i+1]], none of them empty."""
        out = np.empty((len(offsets) - 1, self.size), "f4")
        at = 0
        while at < len(out):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + 20_000, "right")) - 1)
            bag = flat[offsets[at] : offsets[to]]
            starts = offsets[at:to] - offsets[at]
            unique, inverse = np.unique(bag, return_inverse=True)
            if to == at + 1:  # one record, however long
                out[at] = np.stack([self.arrivals(x, horizon or self.horizon).min(0) for x in np.array_split(unique, len(unique) // 1000 + 1)]).min(0)
            else:
                table, rows = (self.arrivals(unique, horizon), inverse) if horizon else (None, self.rows_of(unique)[inverse])
                out[at:to] = np.minimum.reduceat((self.first if table is None else table)[rows], starts, axis=0)
            at = to
        open_ = np.flatnonzero(np.isinf(out).any(axis=1))
        if len(open_):  # bags with too few points up to the horizon: once more, further
            sizes = np.diff(offsets)[open_]
            ends = np.cumsum(sizes)
            bags = flat[np.repeat(offsets[open_] - (ends - sizes), sizes) + np.arange(int(ends[-1]))]
            out[open_] = self.signatures(bags, np.concatenate([[0], ends]), 4 * (horizon or self.horizon))
        return out

    def bands(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(records, BANDS) hashes of the bands, each with the band's number in it."""
        bits = self.signatures(flat, offsets).view("u4").astype("u8").reshape(len(offsets) - 1, -1, ROWS)
        hashed = np.broadcast_to(np.arange(1, bits.shape[1] + 1, dtype="u8") * GOLDEN, bits.shape[:2]).copy()
        for r in range(ROWS):
            hashed = mix(hashed ^ bits[:, :, r] * GOLDEN + np.uint64(r))
        return hashed.view("i8")


def parities(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64 bits a bag: whether an odd number of its words falls into each cell. Where two bags differ in d bits, they differ in at least d words."""
    cells = np.uint64(1) << (mix(flat.view("u8")) & np.uint64(63))
    return np.bitwise_xor.reduceat(cells, offsets[:-1]).view("i8") if len(offsets) > 1 else np.zeros(0, "i8")


def rare_first(lists: pa.Array, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Order keys of the words, sorted within each record, and the records' offsets: words without a count by hash, then the others by their counts' powers of two."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    offsets, flat = lists.offsets.to_numpy().astype("i8"), lists.values.to_numpy()
    flat, offsets = flat[offsets[0] : offsets[-1]], offsets - offsets[0]
    level = np.zeros(len(flat), "i8")
    if counts:
        hashes = np.array(sorted(counts), "i8")
        levels = np.array([int(counts[h]).bit_length() for h in hashes.tolist()], "i8")
        at = np.minimum(np.searchsorted(hashes, flat), len(hashes) - 1)
        level = np.where(hashes[at] == flat, levels[at], 0)
    keys = (level << 57) | (flat.view("u8") >> np.uint64(7)).astype("i8")
    record = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    return keys[np.lexsort((keys, record))], offsets


def common_words(classes: DataFrame, total: int, part: int = COMMON) -> dict[int, int]:
    """Word hash -> number of classes, of the words in more than 1/part of all ``total`` classes: at most part times their mean length."""
    return {r["w"]: r["count"] for r in classes.select(F.explode("words").alias("w")).groupBy("w").count().where(F.col("count") * part > total).collect()}


def record_words(df: DataFrame, key: str = "rr_uid", question: str = "question", answers: str = "answers") -> DataFrame:
    """(uid, words) of the records with question and answers, words as sorted 64-bit hashes; one row per key."""
    given = F.exists(answers, lambda a: F.length(F.trim(a)) > 0)
    rows = df.where(F.col(key).isNotNull() & (F.length(question) > 0) & given)
    hashed = F.array_sort(F.transform(words(question, answers), lambda w: F.xxhash64(w)))
    rows = rows.select(F.col(key).alias("uid"), hashed.alias("words")).where(F.size("words") > 0)
    return rows.groupBy("uid").agg(F.min("words").alias("words"))


def _meet(num: int, den: int):
    """Over rows (band, cid, n, bits) sorted by band: the pairs of every run of equal bands whose sizes and parities allow the share, or, of a run
    longer than ``CROWD``, its rows with b null."""

    def fit(nx, ny, x, y):
        small = np.minimum(nx, ny) * den >= np.maximum(nx, ny) * num
        return small & (np.bitwise_count(x ^ y).astype("i8") * (den + num) <= (nx + ny) * (den - num))

    def emit(band: np.ndarray, cid: np.ndarray, n: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
        wide, bits = n.astype("i8"), bits.view("u8")
        start = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1]]))
        size = np.diff(np.append(start, len(band)))
        out = []
        each = np.repeat(size, size)
        for k in range(1, int(size[size <= 64].max(initial=0))):  # every row with the k-th after it in its run
            left = np.flatnonzero((each[: len(band) - k] > k) & (each[: len(band) - k] <= 64))
            left = left[band[left] == band[left + k]]
            if len(left):
                hit = left[fit(wide[left], wide[left + k], bits[left], bits[left + k])]
                out.append((hit, hit + k))
        for at, m in zip(start[(size > 64) & (size <= CROWD)].tolist(), size[(size > 64) & (size <= CROWD)].tolist(), strict=True):
            for lo in range(at, at + m, 512):  # rows of a block with all rows from it on
                rows, rest = slice(lo, min(lo + 512, at + m)), slice(lo, at + m)
                x, y = np.nonzero(fit(wide[rows, None], wide[None, rest], bits[rows, None], bits[None, rest]))
                out.append((x[x < y] + lo, y[x < y] + lo))
        left, right = (np.concatenate([np.zeros(0, "i8"), *c]) for c in zip(*out, strict=True)) if out else (np.zeros(0, "i8"),) * 2
        differ = cid[left] != cid[right]
        x, y = cid[left[differ]], cid[right[differ]]
        crowd = each > CROWD
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([band[left[differ]], band[crowd]])), pa.array(np.concatenate([np.minimum(x, y), cid[crowd]])),
                pa.concat_arrays([pa.array(np.maximum(x, y), pa.int64()), pa.nulls(int(crowd.sum()), pa.int64())]),
                pa.array(np.concatenate([n[left[differ]], n[crowd]]), pa.int32()), pa.array(np.concatenate([bits[left[differ]], bits[crowd]]).view("i8")),
            ],
            names=["band", "a", "b", "n", "bits"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = [batch.column(c).to_numpy() for c in ("band", "cid", "n", "bits")]
            rows = rows if rest is None else [np.concatenate(x) for x in zip(rest, rows, strict=True)]
            last = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
            if last == 0 and len(rows[0]) > 4 * CROWD:  # a crowd over many batches: its rows go on as they come, the last few wait
                last = len(rows[0]) - CROWD - 1
            if last:
                yield from emit(*(r[:last] for r in rows))
            rest = [r[last:] for r in rows]
        if rest is not None and len(rest[0]):
            yield from emit(*rest)

    return run


def _met(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(band, a, b, n, bits) of :func:`_meet` over rows (band, cid, n, bits)."""
    ordered = rows.select("band", "cid", "n", "bits").repartition("band").sortWithinPartitions("band")
    return cut(ordered.mapInArrow(_meet(num, den), "band bigint, a bigint, b bigint, n int, bits bigint"))


def _split(hot: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """(band, cid, n, bits): crowded rows under keys of their band and each of their first words in rare-first order, one of which two records above the share have in common."""
    members = cut(hot.select(F.col("a").alias("cid")).distinct().join(classes, "cid").select("cid", "words"))
    counts = classes.sparkSession.sparkContext.broadcast(common_words(members, members.count()))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, offsets = rare_first(batch.column(1), counts.value)
            n = np.diff(offsets)
            taken = n + (-n * num // den) + 1  # n - ceil(n * share) + 1
            ends = np.cumsum(taken)
            flat = keys[np.repeat(offsets[:-1] - (ends - taken), taken) + np.arange(int(taken.sum()))]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["cid", "first"])

    first = members.mapInArrow(prefixes, "cid bigint, first array<bigint>")
    each = hot.select("band", F.col("a").alias("cid"), "n", "bits").join(first, "cid")
    return each.select("band", "cid", "n", "bits", F.explode("first").alias("w")).select(F.xxhash64("band", "w").alias("band"), "cid", "n", "bits")


def _salted(hot: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of crowded rows: every row of a band lies in one of its blocks of about ``CROWD`` rows and meets all blocks."""
    sizes = hot.groupBy("band").agg(F.ceil(F.count("*") / CROWD).cast("int").alias("blocks"))
    rows = hot.select("band", "a", "n", "bits").join(sizes, "band")
    left = rows.select("band", "a", "n", "bits", F.pmod(F.xxhash64("a"), "blocks").cast("int").alias("block"))
    right = rows.select("band", F.col("a").alias("b"), F.col("n").alias("m"), F.col("bits").alias("other"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    fits = (F.col("a") < F.col("b")) & (F.least("n", "m") * den >= F.greatest("n", "m") * num)
    fits &= F.bit_count(F.col("bits").bitwiseXOR(F.col("other"))) * (den + num) <= (F.col("n") + F.col("m")) * (den - num)
    return left.join(right, ["band", "block"]).where(fits).select("a", "b")


def class_pairs(classes: DataFrame, least: tuple[int, int] = (3, 4)) -> DataFrame:
    """(a, b, shared, united), a < b: pairs of (cid, words) whose shared words are at least least[0]/least[1] of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = BagMinHash({}, rest=0)
        for batch in batches:
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy().astype("i8")
            flat, offsets = lists.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]
            got = hasher.bands(flat, offsets)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, got.size + 1, got.shape[1]), pa.int32()), pa.array(got.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets), pa.int32()), pa.array(parities(flat, offsets)), bands], names=["cid", "n", "bits", "bands"])

    num, den = least
    banded = classes.select("cid", "words").mapInArrow(run, "cid bigint, n int, bits bigint, bands array<bigint>").select("cid", "n", "bits", F.explode("bands").alias("band"))
    met = _met(banded, num, den)
    found, hot = met.where("b is not null").select("a", "b"), met.where("b is null")
    if not hot.isEmpty():
        met = _met(_split(hot, classes, num, den), num, den)
        found = found.unionByName(met.where("b is not null").select("a", "b")).unionByName(_salted(met.where("b is null"), num, den))
    candidates = found.distinct()
    of_a = classes.select(F.col("cid").alias("a"), F.col("words").alias("words_a"))
    of_b = classes.select(F.col("cid").alias("b"), F.col("words").alias("words_b"))
    both = candidates.join(of_a, "a").join(of_b, "b").select(
        "a", "b", F.size(F.array_intersect("words_a", "words_b")).alias("shared"), (F.size("words_a") + F.size("words_b")).alias("sum")
    )
    return both.select("a", "b", "shared", (F.col("sum") - F.col("shared")).alias("united")).where(F.col("shared") * den >= F.col("united") * num)


def near_duplicates(df: DataFrame, least: tuple[int, int] = (3, 4)) -> tuple[DataFrame, DataFrame]:
    """Members (uid, cid) and class pairs (a, b, shared, united) of the records of :func:`record_words`."""
    records = cut(record_words(df).withColumn("cid", F.xxhash64("words")))
    classes = records.groupBy("cid").agg(F.min("words").alias("words"))
    return records.select("uid", "cid"), class_pairs(classes, least)


def record_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(uid_a, uid_b), uid_a < uid_b: all pairs of records of one class or of two paired classes; classes of very many records are spread over blocks."""
    large = hot.large_keys(members, "cid", CROWD)
    x, y = members.toDF("x", "cid"), hot.in_blocks(members.toDF("y", "cid"), "cid", "y", large)
    same = hot.to_blocks(x, "cid", large).join(y, ["cid", "_block"]).where("x < y").select("x", "y")
    left = pairs.select("a", "b").join(x.withColumnRenamed("cid", "a"), "a").select("x", "b")
    cross = hot.to_blocks(left, "b", large).join(y.withColumnRenamed("cid", "b"), ["b", "_block"])
    either = same.unionByName(cross.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")))
    return either.select(F.col("x").alias("uid_a"), F.col("y").alias("uid_b"))
