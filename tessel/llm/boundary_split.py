"""Splitting of oversized texts at natural boundaries with a sparse range-maximum table.

Every cut position of a text has a strength: the end of a line, the end of a sentence span that is right, the end of a
sentence by its punctuation, the end of a clause, a blank, the edge of a character, the inside of one. A sparse table holds
the strongest position of every power-of-two window, ties rightward, so the strongest cut of any permissible window
takes two look-ups. After a cut the next piece starts at the strongest position of the overlap window before it.

Lengths are Unicode code points. Texts are whole and of any length: the table is built over blocks.

Defined cases: null texts give no piece; texts within the limit (empty ones too) give one piece; spans that are null, reversed,
overlapping, out of the text or that end inside a word are not right and are passed over one by one; a text without
any boundary is cut at the limit, at a character's edge if there is one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINE, SPAN, SENTENCE, CLAUSE, BLANK, EDGE, INSIDE = 6, 5, 4, 3, 2, 1, 0
STOPS = ".!?…。！？｡։؟।"
CLOSERS = "\"'”’»)]）」』】"
_SENTENCE = regex.compile(rf"[{STOPS}]+[{regex.escape(CLOSERS)}]*(?=\s)|[。！？｡]+[{regex.escape(CLOSERS)}]*")
_CLAUSE = regex.compile(r"[;:,–—](?=\s)|[、，；：]")
_EDGE = regex.compile(r"\X")
BLOCK = 1 << 16


def strengths(text: str, spans: list[list[int]] | None) -> np.ndarray:
    """Strength of a cut after the first p characters, for p from 0 to the length."""
    n = len(text)
    s = np.zeros(n + 1, "u1")
    if text.isascii():
        s[:] = EDGE
    else:
        s[[m.end() for m in _EDGE.finditer(text)]] = EDGE
    s[[m.start() for m in regex.finditer(r"(?<=\S)\s", text)]] = BLANK
    s[[m.end() for m in regex.finditer(r"\s+", text)]] = BLANK
    s[[m.end() for m in _CLAUSE.finditer(text)]] = CLAUSE
    s[[m.end() for m in _SENTENCE.finditer(text)]] = SENTENCE
    last = 0
    for span in spans or []:
        if not span or len(span) != 2 or None in span:
            continue
        a, b = span
        if last <= a < b <= n:
            last = b
            if b < n and (text[b].isspace() or text[b - 1].isspace() or text[b - 1] in STOPS):
                body = text[a:b].rstrip()
                if body and (body[-1] in STOPS or body[-1] in CLOSERS):
                    s[b] = SPAN
    s[[m.end() for m in regex.finditer(r"(?:\r\n|[\n\r  ])+", text)]] = LINE
    return s


class RangeMaximum:
    """Sparse table over a block of strengths: the strongest position of a window, ties rightward."""

    def __init__(self, s: np.ndarray, start: int, widest: int):
        key = (s.astype("i8") << 40) + np.arange(start, start + len(s))
        self.start, self.levels = start, [key]
        while 2 ** len(self.levels) <= min(widest, len(s)):
            below, half = self.levels[-1], 2 ** (len(self.levels) - 1)
            self.levels.append(np.maximum(below[:-half], below[half:]))

    def strongest(self, lo: int, hi: int) -> int:
        """Of the positions lo to hi, both included."""
        lo, hi = lo - self.start, hi - self.start
        k = (hi - lo + 1).bit_length() - 1
        return int(max(self.levels[k][lo], self.levels[k][hi - 2**k + 1])) & ((1 << 40) - 1)


def pieces(text: str, spans: list[list[int]] | None, limit: int = 1000, overlap: int = 150, least: int = 500) -> list[tuple[int, int]]:
    """[start, end) of the pieces of one text, in order."""
    n = len(text)
    if n <= limit:
        return [(0, n)]
    s, start, out, table, until = strengths(text, spans), 0, [], None, -1
    while n - start > limit:
        if table is None or start + limit > until:
            until = min(n, start + max(BLOCK, 4 * limit))
            table = RangeMaximum(s[start : until + 1], start, limit)
        end = table.strongest(start + least, start + limit)
        out.append((start, end))
        start = table.strongest(end - overlap, end - (overlap + 1) // 2)
    return [*out, (start, n)]


OUT = pa.schema([("idx", pa.int64()), ("piece_no", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("piece", pa.string())])


def split_texts(df: DataFrame, limit: int = 1000, overlap: int = 150) -> DataFrame:
    """(idx, piece_no, start, end, piece) of the texts (idx, text, sentence_spans), in pieces of at most ``limit`` characters,
    each after the first repeating 1 to ``overlap`` of the last characters of the one before. 0 < 2 * overlap < limit."""
    if not 0 < 2 * overlap < limit:
        raise ValueError("the overlap must be less than half the limit")
    least = max(limit // 2, overlap + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            idx, no, start, end, piece = [], [], [], [], []
            size = 0
            for i, text, spans in zip(*(batch.column(c).to_pylist() for c in ("idx", "text", "sentence_spans")), strict=True):
                for k, (a, b) in enumerate(pieces(text, spans, limit, overlap, least)):
                    idx.append(i), no.append(k), start.append(a), end.append(b), piece.append(text[a:b])
                    size += b - a
                if size > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((idx, no, start, end, piece), OUT, strict=True)], schema=OUT)
                    idx, no, start, end, piece, size = [], [], [], [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((idx, no, start, end, piece), OUT, strict=True)], schema=OUT)

    rows = df.where("text is not null").select("idx", "text", "sentence_spans")
    return rows.mapInArrow(run, "idx bigint, piece_no int, start int, end int, piece string")


def oversized(df: DataFrame, limit: int = 1000) -> DataFrame:
    """Rows of a redelivered table whose text has more than ``limit`` characters, one per idx."""
    rows = df.where(F.col("idx").isNotNull() & (F.length("text") > limit)).select("idx", "text", "sentence_spans", "loaded_at")
    return rows.groupBy("idx").agg(F.max_by(F.struct("text", "sentence_spans"), "loaded_at").alias("r")).select("idx", "r.text", "r.sentence_spans")
