"""Sources and sinks (S): tables are written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.catalog import query
from tessel.functions import sql as S
from tessel.operators.builders import draw
from tessel.plans.records import _LINES, lines
from tessel.session import shared_dir
from tessel.sources import files
from tessel.sources.tables import latest, table


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("select distinct query_uid, question, answer, sample_type from iter_queries")
def s01_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines written and read under a schema."""
    rows = table(spark, path, "iter_queries").select("query_uid", "question", "answer", "sample_type").distinct()
    files.write_jsonl(rows, to := place(spark, "s01"))
    return files.read_jsonl(spark, to, "query_uid bigint, question string, answer array<string>, sample_type string").drop("_corrupt")


@query("select ds_name as name, ds_type, prefer from dataset_catalogue")
def s02_json_document(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of named entries, exploded."""
    entries = F.map_from_entries(F.collect_list(F.struct("ds_name", F.struct("ds_type", "prefer"))))
    doc = table(spark, path, "dataset_catalogue").agg(F.to_json(entries).alias("value"))
    doc.write.text(to := place(spark, "s02"))
    return files.read_json_document(spark, to, "struct<ds_type: string, prefer: string>").select("name", "value.ds_type", "value.prefer")


@query("select distinct rr_uid, _id from rr_samples where _id is not null")
def s04_jsonl_append(spark: SparkSession, path: str) -> DataFrame:
    """Two appended halves are one table."""
    rows = table(spark, path, "rr_samples").select("rr_uid", "_id").where("_id is not null").distinct()
    to = place(spark, "s04")
    files.write_jsonl(rows.where("rr_uid % 2 = 0"), to)
    files.write_jsonl(rows.where("rr_uid % 2 <> 0"), to, append=True)
    return files.read_jsonl(spark, to, "rr_uid bigint, _id string").drop("_corrupt")


@query("select c_custkey, c_name, c_mktsegment from customer")
def s07_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = table(spark, path, "customer").select("c_custkey", "c_name", "c_mktsegment")
    files.write_csv(rows, to := place(spark, "s07"))
    return files.read_csv(spark, to, "c_custkey bigint, c_name string, c_mktsegment string")


@query(f"select line, count(*) as n from (select {S.strip('l')} as line from (select unnest(string_split(replace(text, chr(13), ''), chr(10))) as l from documents where text is not null and doc_kind = 'table')) group by line")
def s08_lines(spark: SparkSession, path: str) -> DataFrame:
    rows = table(spark, path, "documents").where("text is not null and doc_kind = 'table'").select(F.replace("text", F.lit("\r"), F.lit("")).alias("value"))
    rows.write.text(to := place(spark, "s08"))
    return files.read_lines(spark, to).groupBy("line").agg(F.count("*").alias("n"))


_FLAT = "regexp_replace({0}, '[\\t\\r\\n]', ' ', 'g')"


@query(rf"with {_LINES} select {S.strip(_FLAT.format('q'))} as question, case when starts_with({S.strip(_FLAT.format('a'))}, '#!#') then array_to_string(list_transform(string_split(regexp_replace({S.strip(_FLAT.format('a'))}, '^[#!]+|[#!]+$', '', 'g'), '#!#'), lambda x: {S.strip('x')}), '|') else {S.strip(_FLAT.format('a'))} end as answer, count(*) as n from lines group by 1, 2")
def s09_qa_lines(spark: SparkSession, path: str) -> DataFrame:
    """Question lines written and read, several answers joined by bars."""
    files.write_qa(lines(spark, path).select(F.col("q").alias("question"), F.col("a").alias("answer")), to := place(spark, "s09"))
    good = files.read_qa(spark, to).where("corrupt is null")
    return good.groupBy("question", F.array_join("answers", "|").alias("answer")).agg(F.count("*").alias("n"))


@query(rf"with {_LINES} select {S.strip(_FLAT.format('q'))} as question, '' as answer from lines")
def s10_question_lines(spark: SparkSession, path: str) -> DataFrame:
    lines(spark, path).select(F.regexp_replace("q", r"[\t\r\n]", " ").alias("value")).write.text(to := place(spark, "s10"))
    return files.read_questions(spark, to)


@query(rf"with {_LINES} select count(*) as good, 2 as corrupt from lines")
def s12_corrupt_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines without exactly one tab are kept apart."""
    to = place(spark, "s12")
    files.write_qa(lines(spark, path).select(F.col("q").alias("question"), F.col("a").alias("answer")), to)
    spark.createDataFrame([("no tab",), ("a\tb\tc",)], "value string").write.mode("append").text(to)
    good = F.col("corrupt").isNull()
    return files.read_qa(spark, to, many=False).agg(F.sum(good.cast("bigint")).alias("good"), F.sum((~good).cast("int")).alias("corrupt"))


@query("select source as dataset, count(*) as n from documents where doc_kind = 'uqa' and source is not null and len(string_split(text, chr(9))) = 2 group by source")
def s13_union_of_datasets(spark: SparkSession, path: str) -> DataFrame:
    """A folder per dataset read as one table with the dataset as a partition column."""
    rows = table(spark, path, "documents").where("doc_kind = 'uqa' and source is not null and size(split(text, '\t')) = 2")
    rows.select("source", F.regexp_replace("text", r"[\r\n]", " ").alias("value")).write.partitionBy("source").text(to := place(spark, "s13"))
    return spark.read.text(to).groupBy(F.col("source").alias("dataset")).agg(F.count("*").alias("n"))


@query("select distinct doc_id, payload from wiki_docs where payload is not null and json_valid(payload)", name="s15_compressed_jsonl")
def s15_compressed_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """bz2 and gz JSON lines."""
    rows = table(spark, path, "wiki_docs").where("payload is not null").select("doc_id", "payload").distinct()
    valid = rows.where(F.try_parse_json("payload").isNotNull())
    to = place(spark, "s15")
    files.write_jsonl(valid.where("doc_id % 2 = 0"), f"{to}/a", compression="bzip2")
    files.write_jsonl(valid.where("doc_id % 2 <> 0"), f"{to}/b", compression="gzip")
    return files.read_jsonl(spark, f"{to}/*", "doc_id bigint, payload string").drop("_corrupt")


@query("with p as (select idx, any_value(doc_id) as doc_id, any_value(para_idx) as para_idx, any_value(para_id) as para_id from index_paras group by idx) select cast(row_number() over (order by doc_id, para_idx, idx) - 1 as bigint) as dense, para_id = doc_id || '_' || para_idx as same, idx from p")
def s18_dense_index(spark: SparkSession, path: str) -> DataFrame:
    """Dense numbers from 0 in the order of document and position: rows are range-partitioned, counted per partition, and numbered within it."""
    from pyspark.sql import Window

    p = latest(table(spark, path, "index_paras"), "idx", "doc_id", "para_idx", "para_id")
    ranged = p.repartitionByRange("doc_id", "para_idx", "idx").withColumn("part", F.spark_partition_id())
    from tessel.session import cut

    ranged = cut(ranged)
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("part").orderBy("doc_id", "para_idx", "idx"))
    same = F.col("para_id") == F.concat_ws("_", "doc_id", "para_idx")
    return ranged.join(F.broadcast(before.select("part", "base")), "part").select((F.col("base") + within - 1).alias("dense"), same.alias("same"), "idx")


@query(f"select idx, to_json(sentence_spans) as spans, text from (select idx, any_value(replace(text, chr(9), ' ')) as text, any_value(sentence_spans) as sentence_spans from index_paras where text is not null and sentence_spans is not null and length(trim(text)) > 0 group by idx) where not contains(text, chr(10)) and not contains(text, chr(13))")
def s19_tsv_with_json(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs as tab-separated lines with JSON columns."""
    rows = latest(table(spark, path, "index_paras").where("text is not null and sentence_spans is not null and length(trim(text)) > 0"), "idx", "text", "sentence_spans")
    rows = rows.where(~F.col("text").rlike("[\r\n]")).select("idx", F.col("sentence_spans").alias("spans"), F.replace("text", F.lit("\t"), F.lit(" ")).alias("text"))
    files.write_csv(rows, to := place(spark, "s19"), sep="\t")
    return files.read_csv(spark, to, "idx bigint, spans string, text string", sep="\t")


@query(f"select doc_id, lang from documents order by {S.draw(7, 'doc_id')}, doc_id limit 100")
def s24_shuffled_sample(spark: SparkSession, path: str) -> DataFrame:
    """A sample of a hundred documents in an order given by a seeded draw of the key."""
    return table(spark, path, "documents").select("doc_id", "lang").orderBy(draw(7, "doc_id"), "doc_id").limit(100)


@query("select ds_name as name, ds_type, prefer from dataset_catalogue union all select r_name, 'region', cast(r_regionkey as varchar) from region")
def s03_json_report(spark: SparkSession, path: str) -> DataFrame:
    """Two small reports as JSON objects, indented, the second appended, read again as entries."""
    to = place(spark, "s03")
    files.write_json_document(table(spark, path, "dataset_catalogue").select(F.col("ds_name").alias("name"), "ds_type", "prefer"), to, "name", indent=True)
    regions = table(spark, path, "region").select(F.col("r_name").alias("name"), F.lit("region").alias("ds_type"), F.col("r_regionkey").cast("string").alias("prefer"))
    files.write_json_document(regions, to, "name", indent=True, append=True)
    return files.read_json_document(spark, to, "struct<ds_type: string, prefer: string>").select("name", "value.ds_type", "value.prefer")


@query("select vec_id, embedding, label from embeddings")
def s05_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Vectors written and read beside their keys."""
    rows = table(spark, path, "embeddings")
    files.write_vectors(rows, to := place(spark, "s05"), "vec_id", "embedding")
    return files.read_vectors(spark, to).join(rows.select("vec_id", "label"), "vec_id")


@query("select distinct on (sample_uid) sample_uid, list_transform(pos_paras, lambda p: p.title) as titles, list_transform(pos_paras, lambda p: p.sentence_labels) as labels from mdr_samples order by sample_uid, loaded_at desc")
def s06_nested_objects(spark: SparkSession, path: str) -> DataFrame:
    """Nested records written and read as they are."""
    files.write_objects(latest(table(spark, path, "mdr_samples"), "sample_uid", "pos_paras"), to := place(spark, "s06"))
    return files.read_objects(spark, to).select("sample_uid", F.col("pos_paras.title").alias("titles"), F.col("pos_paras.sentence_labels").alias("labels"))


@query("select distinct idx, title, text from index_paras where text is not null")
def s22_paragraph_dump(spark: SparkSession, path: str) -> DataFrame:
    """A dump of paragraphs as JSON lines, read under a schema."""
    rows = table(spark, path, "index_paras").where("text is not null").select("idx", "title", "text").distinct()
    files.write_jsonl(rows, to := place(spark, "s22"))
    return files.read_jsonl(spark, to, "idx bigint, title string, text string").drop("_corrupt")
