"""Joins on titles, normalised questions and nested keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions import text as T


def title_key(title: Column) -> Column:
    return T.unescape(F.lower(title))


def title_index(docs: DataFrame) -> DataFrame:
    """(key, title, idx, n, first_idx, first_title): every title with the candidates of its case-insensitive key."""
    keyed = docs.select(title_key(F.col("title")).alias("key"), "title", "idx")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("idx", "title")).alias("first"))
    return keyed.join(sizes, "key").select("key", "title", "idx", "n", F.col("first.idx").alias("first_idx"), F.col("first.title").alias("first_title"))


def map_titles(links: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows of ``links`` (with ``link``) plus title, status and idx (-1 where nothing matches).

    One candidate: sok if the case is the same, else sc; several: mok for the first exact one, else mc and the first; none: nf. Each distinct link is
    looked up once, so repeated links of a hot title do not multiply.
    """
    distinct = links.select("link").where("link is not null").distinct().withColumn("key", title_key(F.col("link")))
    docs = docs.where("title is not null")
    candidates = docs.select(title_key(F.col("title")).alias("key"), "title", "idx")
    per_key = candidates.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("idx", "title")).alias("first"))
    exact = docs.groupBy("title").agg(F.min("idx").alias("exact_idx"))
    found = distinct.join(per_key, "key", "left").join(exact.withColumnRenamed("title", "link"), "link", "left")
    same = F.col("exact_idx").isNotNull()
    status = F.when(F.col("n").isNull(), "nf").when(F.col("n") == 1, F.when(same, "sok").otherwise("sc")).otherwise(F.when(same, "mok").otherwise("mc"))
    mapped = found.select(
        "link", F.when(F.col("n").isNull() | same, F.col("link")).otherwise(F.col("first.title")).alias("title"), status.alias("status"),
        F.when(F.col("n").isNull(), -1).when(same, F.col("exact_idx")).otherwise(F.col("first.idx")).alias("idx"),
    )
    return links.join(mapped, "link", "left")


def question_key(question: Column) -> Column:
    """A question without surrounding blanks and final marks."""
    return F.regexp_replace(T.strip(question), r"[?!:. ]+$", "")


def first_hit(left: DataFrame, right: DataFrame, key: str, question: str, value: str) -> DataFrame:
    """(key, value, how): the value of the least right row with the same question, else with the same normalised one in lower case."""
    exact = right.groupBy(F.col(question).alias("_q")).agg(F.min(value).alias("_exact"))
    loose = right.groupBy(F.lower(question_key(F.col(question))).alias("_k")).agg(F.min(value).alias("_loose"))
    keyed = left.select(key, F.col(question).alias("_q"), F.lower(question_key(F.col(question))).alias("_k"))
    both = keyed.join(exact, "_q", "left").join(loose, "_k", "left")
    how = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_loose").isNotNull(), "loose").otherwise("none")
    return both.select(key, F.coalesce("_exact", "_loose").alias(value), how.alias("how"))
