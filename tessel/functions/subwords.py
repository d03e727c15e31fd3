"""Whole words of a marked text with the offsets of their subwords by a public tokenizer."""

from __future__ import annotations

from functools import cache
from pathlib import Path

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Where a tokenizer file lies; a parameter, never copied.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
# What stands for itself, the sentence marker among it, and what separates words.
MARKER = "[unused1]"
SPECIAL = ("[SEP]", "[unused0]", "[unused1]")
BLANKS = " \t\r\n "
KEPT = 200_000
RESULT = "struct<words: array<string>, first: array<int>, owner: array<int>, tokens: array<string>, starts: array<int>>"


@cache
def _coder(name: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(SparkFiles.get(name)), {}


def subword_parts(text: str, cut) -> dict[str, list]:
    """words; the first subword of each; the word of each subword; the subwords; and the subwords at which sentences start."""
    for blank in BLANKS[1:]:
        text = text.replace(blank, " ")
    words = [w for w in text.split(" ") if w]
    first, owner, tokens, starts = [], [], [], []
    for i, word in enumerate(words):
        first.append(len(tokens))
        if word == MARKER:
            starts.append(len(tokens))
        parts = [word] if word in SPECIAL else cut(word)
        owner += [i] * len(parts)
        tokens += parts
    return {"words": words, "first": first, "owner": owner, "tokens": tokens, "starts": starts}


def subwords(spark: SparkSession, x: Column | str, path: str = TOKENIZER) -> Column:
    """:func:`subword_parts` of a text; null for null. The tokenizer file is sent to the executors."""
    spark.sparkContext.addFile(path)
    name = Path(path).name

    def run(s: pd.Series) -> pd.DataFrame:
        coder, kept = _coder(name)

        def cut(word: str) -> list[str]:
            if word not in kept:
                if len(kept) >= KEPT:
                    kept.clear()
                kept[word] = coder.encode(word, add_special_tokens=False).tokens
            return kept[word]

        empty = dict.fromkeys(("words", "first", "owner", "tokens", "starts"))
        return pd.DataFrame([empty if t is None else subword_parts(t, cut) for t in s], columns=list(empty))

    return F.pandas_udf(run, RESULT)(x)
