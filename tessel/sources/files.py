"""File sources and sinks. Schemas are always given; a corrupt line is kept apart, never guessed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions import qa
from tessel.functions import text as T


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, plain, gz or bz2 by extension; lines that do not parse have all columns null but ``_corrupt``."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def read_json_document(spark: SparkSession, path: str, value: str) -> DataFrame:
    """One document per file, an object of named entries, as (name, value)."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string, {value}>")).alias("name", "value"))


def read_lines(spark: SparkSession, path: str, strip: bool = True) -> DataFrame:
    """(path, line) of text files."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    return rows.select("path", (T.strip("value") if strip else F.col("value")).alias("line"))


def read_qa(spark: SparkSession, path: str, lower: bool = False, many: bool = True) -> DataFrame:
    """(path, question, answers, corrupt) of question lines with exactly one tab; other lines have null columns and are flagged."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value", F.split("value", "\t").alias("p"))
    answer: Column = F.lower(F.col("p")[1]) if lower else F.col("p")[1]
    good = F.size("p") == 2
    given = qa.answers(answer) if many else F.array(T.strip(answer))
    return rows.select("path", F.when(good, T.strip(F.col("p")[0])).alias("question"), F.when(good, given).alias("answers"), F.when(~good, F.col("value")).alias("corrupt"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(question, answer): every line a question with an empty answer."""
    return spark.read.text(path).select(T.strip("value").alias("question"), F.lit("").alias("answer"))


def write_qa(df: DataFrame, path: str, question: str = "question", answer: str = "answer") -> None:
    """Question lines; line ends and tabs within the columns become blanks so each row stays one line."""
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\t\r\n]", " ")
    df.select(F.concat(bare(question), F.lit("\t"), bare(answer)).alias("value")).write.mode("overwrite").text(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False, compression: str = "none") -> None:
    df.write.mode("append" if append else "overwrite").option("compression", compression).option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, header: bool = True, sep: str = ",") -> None:
    """Nested columns are written as JSON."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", header).option("sep", sep).option("quoteAll", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True, sep: str = ",") -> DataFrame:
    return spark.read.schema(schema).option("header", header).option("sep", sep).option("escape", '"').option("multiLine", True).csv(path)


def write_json_document(df: DataFrame, path: str, name: str, indent: bool = False, append: bool = False) -> None:
    """One JSON object of the entries of a small report, by ``name``; with ``append`` another file beside those that are there. The entries are one value, so the table must be one that
    a report may be: it is refused beyond 100,000 rows."""
    if df.limit(100_001).count() > 100_000:
        raise ValueError("a JSON document holds a small report; write a large table as JSON lines")
    rest = F.struct(*[F.col(c) for c in df.columns if c != name])
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(name).cast("string").alias("k"), rest.alias("v")))))
    options = {"pretty": "true"} if indent else {}
    df.agg(F.to_json(entries, options).alias("value")).coalesce(1).write.mode("append" if append else "overwrite").text(path)


def write_vectors(df: DataFrame, path: str, key: str, vector: str) -> None:
    """Vectors beside their keys as Parquet lists of floats: the table form of pickled arrays."""
    df.select(F.col(key), F.col(vector).cast("array<float>").alias(vector)).write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_objects(df: DataFrame, path: str) -> None:
    """Rows of any nested type, as they are: the table form of a pickle."""
    df.write.mode("overwrite").parquet(path)


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
