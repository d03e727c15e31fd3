"""Byte-level BPE as a bounded-lookahead streaming transducer, and the incremental decoder.

A sequence of tokens is the encoding of its bytes exactly if every neighbouring pair is stable, that is if no merge across
the border comes before the merges that consume the two tokens at its sides; the merge list decides this once a pair. So the
last token of every prefix of a piece is found byte by byte: the one token that ends there and is stable after the last token of
the prefix before it. Every later token begins at one of the last ``lookahead`` positions (the longest token's length,
from the merge list), so whatever all of these agree on will not change: it is emitted as soon as they do, and the state
stays within a window of positions however long the piece is.

Pieces (runs of letters, of digits, of other characters, of blanks) are cut by the vocabulary's published pattern before
the bytes are encoded. Encodings of short pieces are kept in a table of bounded size.

Defined cases: null and empty texts have an empty list; special tokens' strings are ordinary text; unpaired surrogates cannot
occur in Spark strings; any text decodes to itself.
"""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterable, Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

#: Where the vocabulary files lie; a parameter of every function, never copied.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.json"
#: Fixed value: the published piece pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEPT, SHORT, WINDOW = 200_000, 64, 1 << 20


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: visible Latin-1 characters for themselves, the others, in
    order, for the code points from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Kept(dict):
    """Piece -> its ids as 32-bit integers; short ones are kept, at most ``KEPT``."""

    def __init__(self, coder: Transducer):
        self.coder = coder

    def __missing__(self, piece: str) -> bytes:
        got = np.fromiter(self.coder.stream(piece.encode("utf-8")), "i4").tobytes()
        if len(piece) <= SHORT:
            if len(self) >= KEPT:
                self.clear()
            self[piece] = got
        return got


class Transducer:
    """The merge list as tables; :meth:`encode` streams bytes to ids."""

    def __init__(self, path: str):
        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        letters = byte_letters()
        self.ids = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if all(c in letters for c in t)}
        self.bytes = {i: b for b, i in self.ids.items()}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b = (self.ids[bytes(letters[c] for c in x)] for x in (left, right))
            joined = self.ids[self.bytes[a] + self.bytes[b]]
            self.merge.setdefault((a, b), (rank, joined))
            self.parts.setdefault(joined, (rank, a, b))
        #: reachable tokens by their reversed bytes as a trie: node -> byte -> node, and the token that ends at a node
        self.step: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        single = {i for b, i in self.ids.items() if len(b) == 1}
        for i in [*single, *self.parts]:
            node = 0
            for byte in reversed(self.bytes[i]):
                if byte not in self.step[node]:
                    self.step[node][byte] = len(self.step)
                    self.step.append({})
                    self.ends.append(-1)
                node = self.step[node][byte]
            self.ends[node] = i
        self.size = {i: len(b) for i, b in self.bytes.items()}
        self.lookahead = max(self.size[i] for i in [*single, *self.parts])
        self.stable_pairs: dict[int, bool] = {}
        self.kept = Kept(self)
        self.find = regex.compile(PATTERN).findall

    def border(self, token: int, side: int) -> list[tuple[int, float]]:
        """The parts of a token at its right (2) or left (1) edge, each with the rank at which a merge consumes it."""
        out, until = [], float("inf")
        while True:
            out.append((token, until))
            if token not in self.parts:
                return out
            until, token = self.parts[token][0], self.parts[token][side]

    def stable(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are side by side. At one rank the merge further left comes first."""
        key = left << 20 | right
        known = self.stable_pairs.get(key)
        if known is None:
            if len(self.stable_pairs) > 4 * KEPT:
                self.stable_pairs.clear()
            known, rights = True, self.border(right, 1)
            for a, until_a in self.border(left, 2):
                for b, until_b in rights:
                    found = self.merge.get((a, b))
                    if found and found[0] < until_a and found[0] <= until_b:
                        known = False
                        break
                if not known:
                    break
            self.stable_pairs[key] = known
        return known

    def stream(self, data: Iterable[int]) -> Iterator[int]:
        """Ids of one piece of bytes, each as soon as no continuation can change it."""
        window: dict[int, int] = {0: -1}  # position -> last token of the prefix that ends there
        recent = bytearray()
        base = at = 0  # the ids emitted so far end at base; window[base] is the last of them
        for byte in data:
            recent.append(byte)
            at += 1
            node, length = 0, 0
            step, ends = self.step, self.ends
            while length < len(recent):
                node = step[node].get(recent[-1 - length], -1)
                if node < 0:
                    break
                length += 1
                token, before = ends[node], at - length
                if token >= 0 and before in window and (window[before] < 0 or self.stable(window[before], token)):
                    window[at] = token
                    break
            if len(window) > 4 * self.lookahead:
                roots = [p for p in window if p > at - self.lookahead]
                paths = [self.path(window, p, base) for p in roots]
                common = 0
                while all(len(x) > common for x in paths) and len({x[common] for x in paths}) == 1:
                    common += 1
                if common:
                    done = paths[0][:common]
                    for p in done:
                        yield window[p]
                    base = done[-1]
                    window = {p: t for p, t in window.items() if p >= base}
                recent = recent[-(self.lookahead + 1) :]
        for p in self.path(window, at, base):
            yield window[p]

    def path(self, window: dict[int, int], at: int, base: int) -> list[int]:
        """Ends of the tokens from ``base`` to the prefix that ends at ``at``."""
        out = []
        while at > base:
            out.append(at)
            at -= self.size[window[at]]
        return out[::-1]

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text, a window of it at a time; as the end of a window may change the last two, they are cut anew."""
        at, width = 0, WINDOW
        while len(text) - at > width:
            done = self.find(text, at, at + width)[:-2]
            if done:
                yield done
                at += sum(map(len, done))
            width = WINDOW if done else 2 * width
        yield self.find(text, at)

    def packed(self, text: str | None) -> bytes:
        """The ids of a text as 32-bit integers."""
        return b"".join([b"".join(map(self.kept.__getitem__, part)) for part in self.pieces(text or "")])

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), "i4").tolist()

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as it becomes complete: a byte-to-text state machine keeps at most three bytes between ids."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            yield machine.decode(self.bytes[i])
        yield machine.decode(b"", final=True)


@cache
def transducer(path: str) -> Transducer:
    """One per Python worker."""
    return Transducer(path)


def ship(df: DataFrame, vocabulary: str) -> str:
    """Sends the vocabulary file to the executors, which need not have its folder; its name there."""
    df.sparkSession.sparkContext.addFile(vocabulary)
    return Path(vocabulary).name


def shipped(name: str) -> Transducer:
    return transducer(SparkFiles.get(name))


def encode_documents(df: DataFrame, vocabulary: str = f"{TOKENIZERS}/{BYTE_BPE}") -> DataFrame:
    """(doc_id, ids) of every row of (doc_id, text): one id list a row, empty for null and empty texts."""
    name = ship(df, vocabulary)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shipped(name)
        for batch in batches:
            ids = [coder.packed(text.as_py()) for text in batch.column("text")]
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])])
            flat = np.frombuffer(b"".join(ids), "i4")
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], schema=schema)

    return df.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def decode_documents(df: DataFrame, vocabulary: str = f"{TOKENIZERS}/{BYTE_BPE}") -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""
    name = ship(df, vocabulary)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shipped(name)
        for batch in batches:
            texts = ["".join(coder.decode(x or [])) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], schema=schema)

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def token_counts(df: DataFrame, vocabulary: str = f"{TOKENIZERS}/{BYTE_BPE}") -> DataFrame:
    """(doc_id, n_tokens) of every row of (doc_id, text)."""
    name = ship(df, vocabulary)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shipped(name)
        for batch in batches:
            sizes = [len(coder.packed(text.as_py())) // 4 for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64())], schema=schema)

    return df.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint")
