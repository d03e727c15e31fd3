"""Composite builders (G), seeded state (I), the remaining text functions and set operations over the driver tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.catalog import query
from tessel.functions import metrics as M
from tessel.functions import qa, udf
from tessel.functions import sql as S
from tessel.functions import text as T
from tessel.operators import builders as B
from tessel.operators.shredding import parse_order
from tessel.plans.records import _BARE, _RR, ranking
from tessel.session import cut
from tessel.sources.tables import latest, table

_M = "m as (select distinct on (sample_uid) sample_uid, coalesce(src, 'hotpotqa') as src, question, answers, pos_paras, neg_paras from mdr_samples order by sample_uid, loaded_at desc)"
_POS = "pos as (select sample_uid, unnest(pos_paras) as p, generate_subscripts(pos_paras, 1) - 1 as i from m where pos_paras is not null)"


def samples(spark: SparkSession, path: str) -> DataFrame:
    rows = latest(table(spark, path, "mdr_samples"), "sample_uid", "src", "sample_type", "question", "answers", "bridge", "pos_paras", "neg_paras")
    return rows.withColumn("src", F.coalesce("src", F.lit("hotpotqa")))


def positives(spark: SparkSession, path: str) -> DataFrame:
    """(sample_uid, i, p): one row per positive paragraph."""
    return samples(spark, path).select("sample_uid", F.posexplode("pos_paras").alias("i", "p"))


@query(f"""with m as (select distinct on (sample_uid) sample_uid, bridge from mdr_samples order by sample_uid, loaded_at desc), typed as (select sample_uid, bridge, case when bridge is null or bridge = '' then 'NONE' when json_valid(bridge) then json_type(bridge) else 'BARE' end as t from m),
steps as (select sample_uid, cast(s.key as integer) as o, s.value as v, json_type(s.value) as vt from (select * from typed where t = 'ARRAY') x, json_each(x.bridge) s),
inner_ as (select sample_uid, o, cast(e.key as integer) as k, e.value ->> '$' as title from (select * from steps where vt = 'ARRAY') y, json_each(y.v) e union all select sample_uid, o, 0, v ->> '$' from steps where vt = 'VARCHAR'),
l as (select s.sample_uid, s.o, coalesce(list(k.title order by k.k) filter (k.k is not null), []) as titles from steps s left join inner_ k using (sample_uid, o) group by all),
a as (select sample_uid, list(titles order by o) as bridge from l group by sample_uid),
x as (select t.sample_uid, case when t = 'NONE' then [] when t = 'VARCHAR' then [[t.bridge ->> '$']] when t = 'ARRAY' then coalesce(a.bridge, []) else [[t.bridge]] end as bridge from typed t left join a using (sample_uid))
select sample_uid, bridge, cast(len(flatten(bridge)) as integer) as num_hops from x""")
def d11_evidence_order(spark: SparkSession, path: str) -> DataFrame:
    """Evidence order in its four encodings as lists of lists with the number of hops."""
    order = F.pandas_udf(lambda s: s.map(parse_order), "array<array<string>>")
    rows = samples(spark, path).select("sample_uid", order(F.coalesce("bridge", F.lit(""))).alias("bridge"))
    return rows.select("sample_uid", "bridge", F.size(F.flatten("bridge")).alias("num_hops"))


@query(f"with {_M}, {_POS} select sample_uid, cast(i as integer) as para_no, cast(p.sentence_labels[1] as integer) as first_label, coalesce(len(p.sentence_labels), 0) as labels from pos")
def j29_positives_by_position(spark: SparkSession, path: str) -> DataFrame:
    """Positive paragraphs with their first sentence label."""
    labels = F.col("p.sentence_labels")
    return positives(spark, path).select("sample_uid", F.col("i").alias("para_no"), F.get(labels, F.lit(0)).alias("first_label"), F.coalesce(F.when(labels.isNotNull(), F.size(labels)), F.lit(0)).cast("bigint").alias("labels"))


_SENTS = f"""sents as (select sample_uid, i, k, {S.strip("substr(t, sp[1] + 1, sp[2] - sp[1])")} as s from
 (select sample_uid, i, k, t, spans[l + 1] as sp from (select sample_uid, i, p.text as t, p.sentence_spans as spans, unnest(p.sentence_labels) as l, generate_subscripts(p.sentence_labels, 1) as k from pos) where l >= 0 and l < len(spans)))"""


@query(f"with {_M}, {_POS}, {_SENTS} select sample_uid, string_agg({S.close('s')}, ' ' order by i, k) as rationale, count(*) as sentences from sents where s <> '' group by sample_uid")
def g05_rationale(spark: SparkSession, path: str) -> DataFrame:
    """Gold sentences of all positive paragraphs in order."""
    of = lambda p: B.spans_to_sentences(p["text"], p["sentence_spans"], p["sentence_labels"])
    clean = F.filter("pos_paras", lambda p: p["sentence_labels"].isNotNull() & p["sentence_spans"].isNotNull() & p["text"].isNotNull())
    rows = samples(spark, path).select("sample_uid", F.flatten(F.transform(clean, of)).alias("s")).where("size(s) > 0")
    return rows.select("sample_uid", F.array_join("s", " ").alias("rationale"), F.size("s").cast("bigint").alias("sentences"))


@query(f"with {_M}, {_POS} select sample_uid, cast(i as integer) as para_no, rtrim({S.unescape(S.strip('p.title'))} || ':') || ' ' || {S.close(S.strip('left(p.text, 600)'))} as encoded from pos where p.text is not null and {S.strip('p.text')} <> ''")
def t41_encode_paragraph(spark: SparkSession, path: str) -> DataFrame:
    """Title and the first 600 characters, closed."""
    rows = positives(spark, path).where(T.strip("p.text") != "")
    encoded = F.concat(T.unescape(T.strip("p.title")), F.lit(": "), T.close_sentence(T.strip(F.substring("p.text", 1, 600))))
    return rows.select("sample_uid", F.col("i").alias("para_no"), encoded.alias("encoded"))


@query(f"with {_M}, {_POS}, {_SENTS} select sample_uid, cast(i as integer) as para_no, list('[unused1] ' || {S.close('s')} order by k) as parts from sents where s <> '' group by sample_uid, i")
def t42_encode_sentences(spark: SparkSession, path: str) -> DataFrame:
    """Marked gold sentences per paragraph."""
    rows = positives(spark, path).where("p.sentence_labels is not null and p.sentence_spans is not null and p.text is not null")
    sents = B.spans_to_sentences(F.col("p.text"), F.col("p.sentence_spans"), F.col("p.sentence_labels"))
    rows = rows.select("sample_uid", F.col("i").alias("para_no"), sents.alias("s")).where("size(s) > 0")
    return rows.select("sample_uid", "para_no", F.transform("s", lambda s: F.concat(F.lit("[unused1] "), s)).alias("parts"))


@query(f"""with {_M}, p as (select sample_uid, 0 as kind, unnest(list_transform(pos_paras, lambda p: p.text)) as text, generate_subscripts(pos_paras, 1) - 1 as i from m where question <> '' union all
 select sample_uid, 1, unnest(list_transform(neg_paras, lambda p: p.text)), generate_subscripts(neg_paras, 1) - 1 from m where question <> ''), c as (select *, len({S.words("text")}) + 2 as cost from p where text <> '' and (kind = 0 or {S.draw(7, "sample_uid", "i")} < 0.5)),
t as (select *, sum(cost) over (partition by sample_uid order by kind, i rows unbounded preceding) as total from c)
select sample_uid, string_agg(text, ' ' order by kind, i) as context, cast(max(total) as bigint) as cost, cast(sum(kind) as bigint) as negatives from t where total < 200 group by sample_uid""")
def g01_packed_context(spark: SparkSession, path: str) -> DataFrame:
    """Question, positives and a seeded half of the negatives within a budget of words; positives come first."""
    rows = samples(spark, path).where("question <> ''")
    pos = rows.select("sample_uid", F.posexplode("pos_paras").alias("i", "p")).select("sample_uid", F.lit(0).alias("kind"), "i", F.col("p.text").alias("text"))
    neg = rows.select("sample_uid", F.posexplode("neg_paras").alias("i", "p")).select("sample_uid", F.lit(1).alias("kind"), "i", F.col("p.text").alias("text"))
    neg = neg.where(B.draw(7, "sample_uid", "i") < 0.5)
    paras = pos.unionByName(neg).where("text <> ''").withColumn("cost", F.size(T.words("text")) + 2)
    kept = B.pack_budget(paras, ["sample_uid"], [F.col("kind"), F.col("i")], F.col("cost"), 200)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("kind", "i", "text"))), lambda x: x["text"])
    packed = kept.groupBy("sample_uid").agg(F.array_join(parts, " ").alias("context"), F.max("total").alias("cost"), F.sum("kind").alias("negatives"))
    return packed


@query(f"""with {_M}, n as (select sample_uid, question, pos_paras, unnest(neg_paras) as p, generate_subscripts(neg_paras, 1) - 1 as i from m where question <> '' and len(neg_paras) > 0),
k as (select *, row_number() over (partition by sample_uid order by i) - 1 as j from n where p.text is not null and not coalesce(list_contains(list_transform(pos_paras, lambda x: x.title), p.title), false)),
r as (select *, row_number() over (partition by sample_uid order by {S.draw(7, "sample_uid", "j")}, p.text) as rn from k),
c as (select sample_uid, string_agg(p.text, ' ' order by rn) as context from r where rn <= 4 group by sample_uid),
x as (select m.sample_uid, question, coalesce(context, '') as context from m left join c using (sample_uid) where question <> '' and len(neg_paras) > 0)
select sample_uid, regexp_replace(regexp_replace({_BARE("question")}, '[.!?]$', '') || '?', '\\?\\?$', '?') || ' \\n' || case when context <> '' then ' ' || {_BARE("context")} else '' end || ' ' || chr(9) || '<No Answer>' as line from x""")
def g02_unanswerable(spark: SparkSession, path: str) -> DataFrame:
    """Records without their gold: negatives only, answer '<No Answer>'."""
    rows = samples(spark, path).where("question <> '' and size(neg_paras) > 0")
    gold = F.col("pos_paras.title")
    negs = F.filter("neg_paras", lambda p: ~F.coalesce(F.array_contains(gold, p["title"]), F.lit(False)) & p["text"].isNotNull())
    order = F.array_sort(F.transform(negs, lambda p, i: F.struct(B.draw(7, "sample_uid", i).alias("d"), p["text"].alias("t"))))
    context = F.array_join(F.transform(F.slice(order, 1, 4), lambda x: x["t"]), " ")
    return rows.select("sample_uid", qa.example(F.col("question"), context, F.lit("<No Answer>")).alias("line"))


@query(f"""with {_M}, {_POS}, {_SENTS}, b as (select sample_uid, i, p.text as t, p.sentence_spans as spans, p.sentence_labels as labels from pos where p.sentence_labels is not null and p.sentence_spans is not null and p.text is not null),
y as (select sample_uid, i, string_agg({S.close('s')}, ' ' order by k) as positive from sents where s <> '' group by all),
o as (select sample_uid, i, k, {S.strip("substr(t, sp[1] + 1, sp[2] - sp[1])")} as s from (select sample_uid, i, t, labels, unnest(spans) as sp, generate_subscripts(spans, 1) - 1 as k from b) where not list_contains(labels, k)),
n as (select sample_uid, i, string_agg({S.close('s')}, ' ' order by k) as negative from o where s <> '' group by all)
select sample_uid, cast(i as integer) as para_no, coalesce(positive, '') as positive, coalesce(negative, '') as negative from b left join y using (sample_uid, i) left join n using (sample_uid, i)""")
def g03_ranking_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Positive text (gold sentences) and negative text (the rest) of every positive paragraph."""
    rows = positives(spark, path).where("p.sentence_labels is not null and p.sentence_spans is not null and p.text is not null")
    every = F.when(F.size("p.sentence_spans") > 0, F.sequence(F.lit(0), F.size("p.sentence_spans") - 1)).otherwise(F.array().cast("array<int>"))
    other = F.array_except(every, F.col("p.sentence_labels"))
    sents = lambda labels: F.array_join(B.spans_to_sentences(F.col("p.text"), F.col("p.sentence_spans"), labels), " ")
    return rows.select("sample_uid", F.col("i").alias("para_no"), sents(F.col("p.sentence_labels")).alias("positive"), sents(other).alias("negative"))


@query(f"with {_RR} select rr_uid, list_distinct(list_transform(list_concat(coalesce(list_transform(pos_paras, lambda p: p.text), []), coalesce(list_transform(neg_paras, lambda p: p.text), [])), lambda t: length(t))) is not null as ok, coalesce(len(pos_paras), 0) as pos, coalesce(len(neg_paras), 0) as neg from rr")
def g06_harmonised(spark: SparkSession, path: str) -> DataFrame:
    """Missing paragraph lists as empty ones."""
    n = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("bigint")
    return ranking(spark, path).select("rr_uid", F.lit(True).alias("ok"), n("pos_paras").alias("pos"), n("neg_paras").alias("neg"))


@query("select l_orderkey, l_linenumber, datediff('year', l_shipdate, date '2000-03-01') as years, datediff('month', l_shipdate, date '2000-03-01') as months, datediff('day', cast(l_shipdate as date), date '2000-03-01') as days from lineitem")
def g11_date_differences(spark: SparkSession, path: str) -> DataFrame:
    """Differences of calendar years, of months, and of days to a fixed date."""
    d = F.to_date("l_shipdate")
    years, months = 2000 - F.year(d), 12 * (2000 - F.year(d)) + 3 - F.month(d)
    days = F.date_diff(F.lit("2000-03-01").cast("date"), d)
    return table(spark, path, "lineitem").select("l_orderkey", "l_linenumber", years.cast("bigint").alias("years"), months.cast("bigint").alias("months"), days.cast("bigint").alias("days"))


@query("""with s as (select distinct sent_uid, idx, sentence from evidence_sents where length(sentence) > 0), p as (select idx, any_value(text) as text from index_paras where text is not null group by idx)
select sent_uid, substr(text, greatest(1, instr(text, sentence) - 100), least(600, length(sentence) + 200)) as window_text from s join p using (idx) where instr(text, sentence) > 0""")
def g12_text_window(spark: SparkSession, path: str) -> DataFrame:
    """The sentence with a hundred characters around it, 600 at most."""
    sents = table(spark, path, "evidence_sents").where("length(sentence) > 0").select("sent_uid", "idx", "sentence").distinct()
    paras = latest(table(spark, path, "index_paras").where("text is not null"), "idx", "text")
    at = F.instr("text", F.col("sentence"))
    window = F.substring(F.col("text"), F.greatest(F.lit(1), at - 100), F.least(F.lit(600), F.length("sentence") + 200))
    return sents.join(paras, "idx").where(at > 0).select("sent_uid", window.alias("window_text"))


@query("select title, list_sort(list_distinct(flatten(list(l)))) as labels from (select p.title as title, coalesce(p.sentence_labels, []) as l from (select unnest(pos_paras) as p from mdr_samples)) where title is not null group by title")
def g17_aggregate_evidence(spark: SparkSession, path: str) -> DataFrame:
    """Sorted sentence labels per title."""
    each = table(spark, path, "mdr_samples").select(F.explode("pos_paras").alias("p")).select("p.title", F.explode_outer("p.sentence_labels").alias("l")).where("title is not null")
    return each.groupBy("title").agg(F.array_sort(F.collect_set("l")).alias("labels"))


@query("with r as (select o_custkey, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_orderkey) - 1 as i from orders) select a.o_custkey, a.o_orderkey as left_key, b.o_orderkey as right_key from r a left join r b on b.o_custkey = a.o_custkey and b.i = a.i + 1 where a.i % 2 = 0")
def g19_pairs_of_rows(spark: SparkSession, path: str) -> DataFrame:
    """Even and odd rows side by side."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = table(spark, path, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("i"), F.lead("o_orderkey").over(w).alias("right_key"))
    return rows.where("i % 2 = 1").select("o_custkey", F.col("o_orderkey").alias("left_key"), "right_key")


@query("select d.doc_id, coalesce(l.label, -1) as label from documents d left join (select lang, cast(row_number() over (order by n desc, lang) - 1 as integer) as label from (select lang, count(*) as n from documents where lang is not null and doc_kind = 'lang' group by lang)) l using (lang)")
def g22_label_encoding(spark: SparkSession, path: str) -> DataFrame:
    """Labels by frequency in the training part; labels unseen there are -1."""
    docs = table(spark, path, "documents")
    counts = docs.where("lang is not null and doc_kind = 'lang'").groupBy("lang").agg(F.count("*").alias("n"))
    labels = counts.select("lang", (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), "lang")) - 1).alias("label"))
    return docs.select("doc_id", "lang").join(labels, "lang", "left").select("doc_id", F.coalesce("label", F.lit(-1)).alias("label"))


@query("select doc_kind, string_split(text, ' | ')[1] as name, string_split(text, ' | ')[2] as year from documents where doc_kind = 'table' and text is not null")
def g21_split_table_string(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split("text", r" \| ")
    return table(spark, path, "documents").where("doc_kind = 'table' and text is not null").select("doc_kind", F.get(parts, F.lit(0)).alias("name"), F.get(parts, F.lit(1)).alias("year"))


@query(None)
def j12_top_up_negatives(spark: SparkSession, path: str) -> DataFrame:
    """Negatives of every record: the documents linked from the paragraphs of its gold documents, paragraph by paragraph until ten are found (hl), then others of the index up
    to ten (rd); gold documents are none."""
    from tessel.operators import lookups
    from tessel.plans.joins import firsts, links

    first = firsts(spark, path)
    docs = first.select("idx", F.col("doc_id").cast("bigint").alias("doc_id"), "title")
    every = samples(spark, path)
    gold = every.select("sample_uid", F.explode("pos_paras.title").alias("link"))
    gold = cut(lookups.map_titles(gold, first).where("idx <> -1").select("sample_uid", "idx").distinct())
    hops = lookups.map_titles(links(spark, path), first).where("idx <> -1").select("doc_id", "para_no", F.col("idx").alias("other")).distinct()
    linked = gold.join(docs.select("idx", "doc_id"), "idx").join(hops, "doc_id").select("sample_uid", "doc_id", "para_no", F.col("other").alias("idx")).join(gold, ["sample_uid", "idx"], "left_anti")
    linked = linked.groupBy("sample_uid", "doc_id", "idx").agg(F.min("para_no").alias("para_no"))
    new = linked.groupBy("sample_uid", "doc_id", "para_no").agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy("sample_uid", "doc_id").orderBy("para_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    read = new.select("sample_uid", "doc_id", "para_no", before.alias("before")).where("before < 10")
    own = linked.join(read, ["sample_uid", "doc_id", "para_no"]).select("sample_uid", "idx")
    found = B.top_up(every, own, gold, docs, "sample_uid", "idx", 10)
    return found.join(docs.select("idx", T.unescape("title").alias("title")), "idx").select("sample_uid", "idx", "title", F.when(F.col("origin") == "own", "hl").otherwise("rd").alias("src"))


@query(f"with {_M} select case when coalesce(len(neg_paras), 0) >= 10 then 'ok' when coalesce(len(neg_paras), 0) > 0 then 'sf' else 'nf' end as status, count(*) as n from m group by 1")
def j13_negative_status(spark: SparkSession, path: str) -> DataFrame:
    """Records by the number of own negatives: ok, sf (fewer than ten) or nf (none)."""
    n = F.coalesce(F.when(F.col("neg_paras").isNotNull(), F.size("neg_paras")), F.lit(0))
    return samples(spark, path).groupBy(F.when(n >= 10, "ok").when(n > 0, "sf").otherwise("nf").alias("status")).agg(F.count("*").alias("n"))


@query("""with e as (select sample_uid, cast(i as integer) as i, p.title as t from (select sample_uid, unnest(pos_paras) as p, generate_subscripts(pos_paras, 1) as i from (select distinct on (sample_uid) sample_uid, pos_paras from mdr_samples order by sample_uid, loaded_at desc))),
s as (select sample_uid, t, min(i) as i from e group by all) select sample_uid, t as title, cast(dense_rank() over (partition by sample_uid order by i) - 1 as integer) as level from s""")
def w13_dependency_levels(spark: SparkSession, path: str) -> DataFrame:
    """Level of every distinct title in order of first use."""
    first = positives(spark, path).groupBy("sample_uid", F.col("p.title").alias("title")).agg(F.min("i").alias("i"))
    return first.select("sample_uid", "title", (F.dense_rank().over(Window.partitionBy("sample_uid").orderBy("i")) - 1).alias("level"))


@query("""with q as (select query_uid, list(distinct title) filter (s2_score > 0.4) as a, list(distinct title) filter (s1para_score > 0.4) as b from evidence_sents where s2_score is not null and not isnan(s2_score) and title is not null group by query_uid)
select query_uid, round(len(list_intersect(a, b)) * 1.0 / len(a), 6) as recall from q where len(a) > 0""")
def w17_recall(spark: SparkSession, path: str) -> DataFrame:
    """Share of the titles of one ranking that the other has."""
    rows = table(spark, path, "evidence_sents").where("s2_score is not null and not isnan(s2_score) and title is not null")
    pick = lambda c: F.collect_set(F.when(F.col(c) > 0.4, F.col("title")))
    sets = rows.groupBy("query_uid").agg(pick("s2_score").alias("a"), pick("s1para_score").alias("b")).where("size(a) > 0")
    return sets.select("query_uid", F.round(F.size(F.array_intersect("a", "b")) / F.size("a"), 6).alias("recall"))


@query(None)
def w14_soft_unique(spark: SparkSession, path: str) -> DataFrame:
    """Normalised answers of a record that stay when the one of the highest self-BLEU goes until their mean is 50 or two are left. Lists are short, so each is folded in its row."""
    rows = ranking(spark, path).where("size(answers) > 0")
    normal = F.transform("answers", lambda a: M.squad(F.coalesce(a, F.lit(""))))
    return rows.select("rr_uid", udf.soft_uniques(normal).alias("kept"))


@query(f"with t as (select doc_id, source, sum(n_chars) over (partition by source order by {S.draw(7, 'doc_id')}, doc_id rows unbounded preceding) as total from documents where source is not null and n_chars > 0) select source, doc_id, cast(total as bigint) as total from t where total < 5000")
def w16_random_sample(spark: SparkSession, path: str) -> DataFrame:
    """Documents of each source in a seeded order under a budget of characters."""
    docs = table(spark, path, "documents").where("source is not null and n_chars > 0").select("doc_id", "source", "n_chars")
    return B.pack_budget(docs, ["source"], [B.draw(7, "doc_id"), F.col("doc_id")], F.col("n_chars"), 5000).select("source", "doc_id", "total")


@query(f"with r as (select doc_id, source, row_number() over (partition by source order by {S.draw(7, 'doc_id')}, doc_id) as turn from documents where source is not null), l as (select min(n) as least from (select count(*) as n from documents where source is not null group by source)) select doc_id, source, cast(turn as integer) as turn from r, l where turn <= least")
def i05_round_robin_epoch(spark: SparkSession, path: str) -> DataFrame:
    """An epoch of all sources in turn, each shuffled by a seeded draw, as long as the smallest."""
    docs = table(spark, path, "documents").where("source is not null").select("doc_id", "source")
    rows = docs.withColumn("turn", F.row_number().over(Window.partitionBy("source").orderBy(B.draw(7, "doc_id"), "doc_id")))
    least = docs.groupBy("source").agg(F.count("*").alias("n")).agg(F.min("n").alias("least"))
    return rows.join(F.broadcast(least)).where("turn <= least").select("doc_id", "source", "turn")


@query(f"select o_orderkey, {S.draw(7, 'o_orderkey // 2')} as slot, o_orderkey % 2 as side from orders")
def i06_pairs_shuffled(spark: SparkSession, path: str) -> DataFrame:
    """A seeded order of pairs that keeps the two rows of a pair together."""
    rows = table(spark, path, "orders").select("o_orderkey", F.floor(F.col("o_orderkey") / 2).alias("pair"))
    return rows.select("o_orderkey", B.draw(7, "pair").alias("slot"), (F.col("o_orderkey") % 2).alias("side"))


@query("with w as (select doc_id, string_split(text, ' ') as w from documents where text is not null) select doc_id, array_to_string(list_concat(w[1:2], ['<mask>'], w[5:]), ' ') as masked, array_to_string(w[3:4], ' ') as removed from w where len(w) > 4")
def i12_mask_span(spark: SparkSession, path: str) -> DataFrame:
    """The third and fourth word replaced by one mask."""
    rows = table(spark, path, "documents").where("text is not null").select("doc_id", F.split("text", " ").alias("w")).where("size(w) > 4")
    masked = F.concat(F.slice("w", 1, 2), F.array(F.lit("<mask>")), F.slice(F.col("w"), F.lit(5), F.size("w")))
    return rows.select("doc_id", F.array_join(masked, " ").alias("masked"), F.array_join(F.slice("w", 3, 2), " ").alias("removed"))


@query(None)
def t03_nfd(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, "documents").select("doc_id", udf.nfd("text").alias("value"))


@query(None)
def t13_common_substring(spark: SparkSession, path: str) -> DataFrame:
    """Longest common substring of a sentence and its title."""
    rows = table(spark, path, "evidence_sents").where("sentence is not null and title is not null").select("sent_uid", "title", "sentence").distinct()
    return rows.select("sent_uid", udf.common_substring("title", "sentence").alias("s")).select("sent_uid", "s.*")


@query(None)
def t14_common_subsequence(spark: SparkSession, path: str) -> DataFrame:
    rows = table(spark, path, "evidence_sents").where("sentence is not null and title is not null").select("sent_uid", "title", "sentence").distinct()
    return rows.select("sent_uid", udf.common_subsequence(T.words("title"), T.words("sentence")).alias("n"))


@query(None)
def t17_stems(spark: SparkSession, path: str) -> DataFrame:
    """Stems of the tokens of every question by both stemmers."""
    rows = ranking(spark, path).where("question is not null").select("rr_uid", T.simple_tokens("question").alias("t"))
    return rows.select("rr_uid", udf.stems("t").alias("stems"), udf.stems("t", "snowball").alias("snowball"))


@query(f"with {_RR}, w as (select rr_uid, answers[1] as t from rr where answers[1] is not null), {S.numbers('w')} select rr_uid, v as number from w join num using (t)")
def t25_words_to_numbers(spark: SparkSession, path: str) -> DataFrame:
    return ranking(spark, path).where("answers[0] is not null").select("rr_uid", udf.to_number(F.col("answers")[0]).alias("number"))


@query(None)
def t37_original_text(spark: SparkSession, path: str) -> DataFrame:
    """Normalised titles projected back to the sentence they occur in."""
    rows = table(spark, path, "evidence_sents").where("sentence is not null and title is not null").select("sent_uid", "title", "sentence").distinct()
    return rows.select("sent_uid", udf.original_span(M.squad(F.col("title")), "sentence").alias("span"))


@query(r"""with r as (select sent_uid, any_value(sentence) as s, any_value(title) as t from evidence_sents where sentence is not null and title is not null group by sent_uid)
select sent_uid, len(list_intersect(a, b)) as overlap from (select sent_uid, list_filter(list_distinct(string_split(lower(s), ' ')), lambda w: w not in """ + S.STOPS + r""") as a, list_filter(list_distinct(string_split(lower(t), ' ')), lambda w: w not in """ + S.STOPS + r""") as b from r)""")
def t15_word_overlap(spark: SparkSession, path: str) -> DataFrame:
    """Number of words that sentence and title share, stop words aside."""
    rows = latest(table(spark, path, "evidence_sents").where("sentence is not null and title is not null"), "sent_uid", "sentence", "title")
    bag = lambda c: F.filter(F.split(F.lower(c), " "), lambda w: ~w.isin(*T.STOP_WORDS))
    return rows.select("sent_uid", F.size(F.array_intersect(bag("sentence"), bag("title"))).cast("bigint").alias("overlap"))


@query(f"""with {_RR}, x as (select rr_uid, {S.strip("coalesce(context, '')")} as c, {S.strip("coalesce(answers[1], '')")} as a from rr),
y as (select rr_uid, {S.close('c', '.!?:;')} as c, {S.close('a', '.!?:;')} as a from x) select rr_uid, trim(case when a <> '' and c <> '' then 'Further Explanation: ' || a || ' ' || c else a || ' ' || c end) as context from y""")
def t44_combined_context(spark: SparkSession, path: str) -> DataFrame:
    """A rationale (the answer stands in) before the retrieved context."""
    close = lambda c: T.close_sentence(T.strip(F.coalesce(c, F.lit(""))), T.SENTENCE_END)
    rows = ranking(spark, path).select("rr_uid", close(F.col("context")).alias("c"), close(F.get("answers", F.lit(0))).alias("a"))
    both = F.concat(F.lit("Further Explanation: "), "a", F.lit(" "), "c")
    return rows.select("rr_uid", F.trim(F.when((F.col("a") != "") & (F.col("c") != ""), both).otherwise(F.concat("a", F.lit(" "), "c"))).alias("context"))


@query("""with m as (select distinct sample_uid, question from mdr_samples where question <> ''), q as (select distinct query_uid, question from iter_queries where question <> '')
select question, count(*) as n, 'either' as side from (select question from m union select question from q) group by question""")
def d06_union_distinct(spark: SparkSession, path: str) -> DataFrame:
    of = lambda n: table(spark, path, n).where("question <> ''").select("question")
    return of("mdr_samples").unionByName(of("iter_queries")).distinct().select("question", F.lit(1).cast("bigint").alias("n"), F.lit("either").alias("side"))


@query("""with s as (select distinct on (sample_uid) sample_uid, pos_paras from mdr_samples order by sample_uid, loaded_at desc), e as (select sample_uid, unnest(list_transform(pos_paras, lambda p: p.title)) as t, generate_subscripts(pos_paras, 1) as i from s),
f as (select t, min((sample_uid, i)) as first from e group by t) select distinct e.sample_uid from e join f on f.t = e.t and f.first = (e.sample_uid, e.i)""")
def d12_new_facts(spark: SparkSession, path: str) -> DataFrame:
    """Records, in order of key, that bring a title not seen before: the first occurrence of each title decides, so no fold is needed."""
    each = positives(spark, path).select("sample_uid", F.col("p.title").alias("t"), "i").where("t is not null")
    return each.groupBy("t").agg(F.min(F.struct("sample_uid", "i")).alias("f")).select("f.sample_uid").distinct()


@query("select distinct sample_uid, f.title as fact from (select sample_uid, unnest(pos_paras) as f from mdr_samples) where len(f.sentence_labels) > 0")
def d13_distinct_facts(spark: SparkSession, path: str) -> DataFrame:
    each = table(spark, path, "mdr_samples").select("sample_uid", F.explode("pos_paras").alias("f")).where("size(f.sentence_labels) > 0")
    return each.select("sample_uid", F.col("f.title").alias("fact")).distinct()


@query(r"""with r as (select distinct on (rr_uid) rr_uid, mc_options, answers from rr_samples where mc_options is not null and answers[1] <> '' order by rr_uid, loaded_at desc),
o as (select rr_uid, answers[1] as a, unnest(l) as o, generate_subscripts(l, 1) as i from (select rr_uid, answers, list_filter(list_transform(string_split(regexp_replace(mc_options, '\([A-H]\) ', chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') as l from r)),
s as (select rr_uid, i, o, len(list_intersect(string_split(lower(o), ' '), string_split(lower(a), ' '))) as n from o) select rr_uid, arg_max(o, (n, -i)) as choice from s group by rr_uid""")
def m09_best_option(spark: SparkSession, path: str) -> DataFrame:
    """The option with most words of the answer, the first of equal ones."""
    rows = latest(table(spark, path, "rr_samples").where("mc_options is not null and answers[0] <> ''"), "rr_uid", "mc_options", "answers")
    words = F.split(F.lower(F.col("answers")[0]), " ")
    scored = F.transform(qa.options(F.col("mc_options")), lambda o, i: F.struct(F.size(F.array_intersect(F.split(F.lower(o), " "), words)).alias("n"), (-i).alias("i"), o.alias("o")))
    return rows.select("rr_uid", F.array_max(scored)["o"].alias("choice")).where("choice is not null")


@query("with c as (select l_returnflag as train, l_linestatus as test, count(*) as n, avg(l_tax) as m from lineitem group by 1, 2) select test, " + ", ".join(f"round(max(m) filter (train = '{t}'), 8) as \"{t}\"" for t in "ANR") + " from c group by test")
def a12_crosstab_train_by_eval(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, "lineitem").groupBy(F.col("l_linestatus").alias("test")).pivot("l_returnflag", list("ANR")).agg(F.round(F.avg("l_tax"), 8))


@query("select l_linestatus as ds, 1 as src, count(*) as n from lineitem group by 1 union all select l_linestatus, 2, count(*) from lineitem where l_quantity > 25 group by 1")
def a13_interleaved(spark: SparkSession, path: str) -> DataFrame:
    """Two reports row by row."""
    one = lambda rows, k: rows.groupBy(F.col("l_linestatus").alias("ds")).agg(F.count("*").alias("n")).select("ds", F.lit(k).alias("src"), "n")
    rows = table(spark, path, "lineitem")
    return one(rows, 1).unionByName(one(rows.where("l_quantity > 25"), 2)).orderBy("ds", "src")


@query("select c_mktsegment as ds, round(avg(o_totalprice), 2) as every, round(avg(o_totalprice) filter (o_totalprice < 100000), 2) as low, round(avg(o_totalprice) filter (o_totalprice >= 100000), 2) as high from orders join customer on o_custkey = c_custkey group by 1")
def a15_scores_by_bucket(spark: SparkSession, path: str) -> DataFrame:
    joined = table(spark, path, "orders").join(table(spark, path, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    mean = lambda c: F.round(F.avg(F.when(c, F.col("o_totalprice"))), 2)
    low = F.col("o_totalprice") < 100000
    return joined.groupBy(F.col("c_mktsegment").alias("ds")).agg(mean(F.lit(True)).alias("every"), mean(low).alias("low"), mean(~low).alias("high"))


@query("with r as (select c_mktsegment as ds, o_orderpriority as sys, avg(o_totalprice) as m from orders join customer on o_custkey = c_custkey group by all), k as (select *, rank() over (partition by ds order by m desc) as rk from r) select sys, round(avg(rk), 6) as mean_rank from k group by sys")
def a30_average_ranks(spark: SparkSession, path: str) -> DataFrame:
    """Mean rank of every system over datasets."""
    joined = table(spark, path, "orders").join(table(spark, path, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    means = joined.groupBy(F.col("c_mktsegment").alias("ds"), F.col("o_orderpriority").alias("sys")).agg(F.avg("o_totalprice").alias("m"))
    ranked = means.withColumn("rk", F.rank().over(Window.partitionBy("ds").orderBy(F.desc("m"))))
    return ranked.groupBy("sys").agg(F.round(F.avg("rk"), 6).alias("mean_rank"))
