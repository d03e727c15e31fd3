"""The pN_ queries over the driver tables, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm import boundary_split, lookalike, near_dup, overlap_index, packing, tokenizer, top_n
from tessel.operators.graph import components
from tessel.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of records across the splits with a word share of at least 0.75 and an answer in common."""
    found = overlap_index.overlaps(table(spark, path, "mdr_samples"))
    return found.select(F.least("train_uid", "eval_uid").alias("uid_a"), F.greatest("train_uid", "eval_uid").alias("uid_b")).distinct()


def p1_report(spark: SparkSession, path: str) -> DataFrame:
    """Numbers of overlaps per evaluation split and source."""
    samples = table(spark, path, "mdr_samples")
    return overlap_index.overlap_report(samples, overlap_index.overlaps(samples))


def p2_pieces(spark: SparkSession, path: str) -> DataFrame:
    """Pieces of the paragraphs with more than 1,000 characters."""
    return boundary_split.split_texts(boundary_split.oversized(table(spark, path, "index_paras")))


def p2_found(spark: SparkSession, path: str) -> DataFrame:
    return p2_pieces(spark, path).where("piece_no = 0").select("idx")


def p3_found(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of records whose words of question and answers have a share of at least 0.75."""
    return near_dup.record_pairs(*near_dup.near_duplicates(table(spark, path, "rr_samples")))


def p3_groups(spark: SparkSession, path: str) -> DataFrame:
    """(uid, group_id, links): every comparable record with its group, named by the least class, and the number of classes
    it is paired with; a record like no other is a group of its own."""
    members, pairs = near_dup.near_duplicates(table(spark, path, "rr_samples"))
    from tessel.session import cut

    pairs = cut(pairs.select("a", "b"))
    groups = components(pairs).toDF("cid", "group_id")
    links = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("cid")).agg(F.count("*").alias("links"))
    joined = members.join(groups, "cid", "left").join(links, "cid", "left")
    return joined.select("uid", F.coalesce("group_id", "cid").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))


def p5_ranked(spark: SparkSession, path: str) -> DataFrame:
    """The five best sentences of each query and hop with their rank."""
    rows = table(spark, path, "evidence_sents").select("query_uid", "hop", "sent_uid", "s2_score", "score", "idx", "s_idx")
    order = [F.col("score").desc_nulls_last(), F.col("idx").asc(), F.col("s_idx").asc(), F.col("sent_uid").asc()]
    return top_n.top_n(top_n.scored(rows, "s2_score"), ["query_uid", "hop"], "sent_uid", "s2_score", order, 5)


def p5_found(spark: SparkSession, path: str) -> DataFrame:
    return p5_ranked(spark, path).select("query_uid", "hop", "sent_uid")


def p6_ids(spark: SparkSession, path: str) -> DataFrame:
    return tokenizer.encode_documents(table(spark, path, "documents"))


def p6_decoded(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, n_tokens, same): whether the ids decode to the text, null counting as empty."""
    documents = table(spark, path, "documents").select("doc_id", "text")
    ids = tokenizer.encode_documents(documents)
    back = tokenizer.decode_documents(ids).withColumnRenamed("text", "decoded")
    both = documents.join(back, "doc_id").join(ids.select("doc_id", F.size("ids").alias("n_tokens")), "doc_id")
    return both.select("doc_id", "n_tokens", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same"))


def p7_contexts(spark: SparkSession, path: str) -> DataFrame:
    """Documents assigned to contexts of 512 tokens."""
    return packing.pack(tokenizer.token_counts(table(spark, path, "documents")))


def p7_fill(spark: SparkSession, path: str) -> DataFrame:
    return packing.context_fill(p7_contexts(spark, path))


def p8_found(spark: SparkSession, path: str) -> DataFrame:
    return lookalike.lookalike_pairs(table(spark, path, "documents"))


def p8_text(spark: SparkSession, path: str) -> DataFrame:
    """The consistent form of every document."""
    return lookalike.consistent_text(table(spark, path, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p1_found, p1_report, p2_found, p2_pieces, p3_found, p3_groups, p5_found, p5_ranked, p6_ids, p6_decoded, p7_contexts, p7_fill, p8_found, p8_text,
    )
}

_WORDS = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+'))"
_KEYS = r"""list_distinct(list_filter(list_transform(answers, lambda a: trim(regexp_replace(regexp_replace(regexp_replace(lower(a),
 '[\p{P}\p{S}]', '', 'g'), '(^|\s)((a|an|the)(\s+|$))+', '\1', 'g'), '\s+', ' ', 'g'))), lambda a: a <> ''))"""
_SHARE = "4 * len(list_intersect({0}.w, {1}.w)) >= 3 * (len({0}.w) + len({1}.w) - len(list_intersect({0}.w, {1}.w)))"

ORACLES = {
    "p1_found": f"""
with r as (select distinct sample_uid as u, lower(trim(split)) = 'train' as t, {_WORDS.format("question")} as w, {_KEYS} as k
  from mdr_samples where lower(trim(split)) in ('train', 'dev', 'test') and question <> '' and answers is not null)
select distinct least(a.u, b.u) as uid_a, greatest(a.u, b.u) as uid_b from r a join r b on a.t and not b.t
where {_SHARE.format("a", "b")} and len(list_intersect(a.k, b.k)) > 0""",
    "p1_report": f"""
with r as (select sample_uid as u, any_value(lower(trim(split))) as split, any_value(coalesce(src, 'hotpotqa')) as src, any_value({_WORDS.format("question")}) as w, any_value({_KEYS}) as k
  from mdr_samples where lower(trim(split)) in ('train', 'dev', 'test') and question <> '' and answers is not null group by sample_uid), c as (select * from r where len(w) > 0 and len(k) > 0),
p as (select distinct a.u as t, b.u as u, b.split, b.src, len(list_intersect(a.w, b.w)) = len(a.w) and len(a.w) = len(b.w) as same from c a join c b on a.split = 'train' and b.split <> 'train'
  where {_SHARE.format("a", "b")} and len(list_intersect(a.k, b.k)) > 0),
n as (select split, src, count(*) as records from c where split <> 'train' group by all), f as (select split, src, count(distinct u) as overlapping, count(*) as pairs, count(*) filter (same) as exact_pairs from p group by all)
select split, src, records, coalesce(overlapping, 0) as overlapping, coalesce(pairs, 0) as pairs, coalesce(exact_pairs, 0) as exact_pairs from n left join f using (split, src)""",
    "p2_found": "select distinct idx from index_paras where length(text) > 1000",
    "p3_found": f"""
with r as (select rr_uid as u, any_value({_WORDS.format("question || ' ' || array_to_string(answers, ' ')")}) as w from rr_samples
  where question <> '' and len(list_filter(answers, lambda a: trim(a) <> '')) > 0 group by rr_uid)
select a.u as uid_a, b.u as uid_b from r a join r b on a.u < b.u
and 4 * least(len(a.w), len(b.w)) >= 3 * greatest(len(a.w), len(b.w)) where {_SHARE.format("a", "b")}""",
    "p5_found": """
select query_uid, hop, sent_uid from (select *, row_number() over (partition by query_uid, hop
  order by s2_score desc, score desc nulls last, idx, s_idx, sent_uid) as rn
  from (select distinct query_uid, hop, sent_uid, s2_score, score, idx, s_idx from evidence_sents
    where s2_score is not null and not isnan(s2_score) and s2_score <> -1 and query_uid is not null and hop is not null)) where rn <= 5""",
    "p5_ranked": """
select query_uid, hop, sent_uid, s2_score, score, idx, s_idx, cast(rn as integer) as rank from (select *, row_number() over (partition by query_uid, hop
  order by s2_score desc, score desc nulls last, idx, s_idx, sent_uid) as rn
  from (select distinct query_uid, hop, sent_uid, s2_score, score, idx, s_idx from evidence_sents
    where s2_score is not null and not isnan(s2_score) and s2_score <> -1 and query_uid is not null and hop is not null)) where rn <= 5""",
}
