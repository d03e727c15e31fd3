"""Whole evaluations, joins of contexts, iteration and the remaining composites."""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.catalog import query
from tessel.functions import metrics as M
from tessel.functions import qa, udf
from tessel.functions import sql as S
from tessel.functions import text as T
from tessel.operators import builders as B
from tessel.operators import similarity as SIM
from tessel.operators import statistics as ST
from tessel.operators.iteration import iterate
from tessel.plans.aggregates import _EV, _SIM, evidence, nearest_train, questions
from tessel.plans.builders import _M, _POS, positives, samples
from tessel.plans.joins import _DOCS, firsts, links, paras
from tessel.plans.metrics import _EM, _F1, _PRED, m06_token_f1, m18_exact_match, m19_evidence_sets, predictions
from tessel.plans.metrics import _RR as _GOLD
from tessel.plans.records import _RR, parsed, ranking
from tessel.plans.records import _WITH as _PARSE_WITH
from tessel.plans.retrieval import _TOP
from tessel.session import cut
from tessel.sources.tables import latest, table


@query("with r as (select doc_id, row_number() over (order by doc_id) - 1 as pos from documents) select doc_id, pos from r where pos in (select s_suppkey from supplier)")
def proj09_rows_by_position(spark: SparkSession, path: str) -> DataFrame:
    """Rows at listed positions (a table of numbers) in the order of the key."""
    numbered = ST.positions(table(spark, path, "documents").select("doc_id"), "doc_id")
    return numbered.join(table(spark, path, "supplier").select(F.col("s_suppkey").alias("pos")).distinct(), "pos").select("doc_id", "pos")


@query("select a.c_custkey, b.c_name as new_key from customer a join customer b on a.c_custkey = b.c_custkey")
def proj10_add_key(spark: SparkSession, path: str) -> DataFrame:
    """A column of another table by the row's key, never by physical order."""
    rows = table(spark, path, "customer")
    return rows.select("c_custkey").join(rows.select("c_custkey", F.col("c_name").alias("new_key")), "c_custkey")


@query("select r_regionkey, 'fixed' as const from region")
def proj11_add_constant(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, "region").select("r_regionkey", F.lit("fixed").alias("const"))


@query(f"with {_M} select sample_uid, case lower(a) when 'yes' then true when 'no' then false end as label from (select sample_uid, unnest(answers) as a from m) where lower(a) in ('yes', 'no')")
def proj16_labels(spark: SparkSession, path: str) -> DataFrame:
    """Verdict answers as booleans, one row each."""
    rows = samples(spark, path).select("sample_uid", F.explode("answers").alias("a")).select("sample_uid", F.lower("a").alias("a"))
    return rows.where(F.col("a").isin("yes", "no")).select("sample_uid", (F.col("a") == "yes").alias("label"))


@query("select 1 as id, 'where is rome in italy?' as question")
def proj18_prior_answers(spark: SparkSession, path: str) -> DataFrame:
    """#k replaced by the k-th prior answer."""
    rows = spark.createDataFrame([(1, "where is #1 in #2?", ["rome", "italy"])], "id int, q string, prior array<string>")
    steps = F.transform("prior", lambda a, i: F.struct((i + 1).cast("string").alias("k"), a.alias("a")))
    filled = F.aggregate(steps, F.col("q"), lambda acc, s: F.replace(acc, F.concat(F.lit("#"), s["k"]), s["a"]))
    return rows.select("id", filled.alias("question"))


@query("select rr_uid, array_to_string(answers, ' ') as joined from (select distinct on (rr_uid) rr_uid, answers from rr_samples where answers is not null order by rr_uid, loaded_at desc)")
def proj19_joined_list(spark: SparkSession, path: str) -> DataFrame:
    return latest(table(spark, path, "rr_samples").where("answers is not null"), "rr_uid", "answers").select("rr_uid", F.array_join("answers", " ").alias("joined"))


@query(f"""with {_RR}, recursive_orders as (with recursive o(rr_uid, answers, used, value) as (
 select rr_uid, list_transform(answers, lambda a: coalesce(a, '')), cast([] as bigint[]), '' from rr where len(answers) > 1
 union all select rr_uid, answers, list_append(used, i), case when len(used) = 0 then answers[i] else value || ', ' || answers[i] end from (select *, unnest(range(1, len(answers) + 1)) as i from o where len(used) < len(answers)) where not list_contains(used, i))
 select * from o) select rr_uid, value as answer from recursive_orders where len(used) = len(answers)""")
def proj28_answer_orders(spark: SparkSession, path: str) -> DataFrame:
    """All orders of answers with two spans or more."""
    return B.permutations(ranking(spark, path), "rr_uid", "answers").withColumnRenamed("value", "answer")


@query(r"""with h as (select distinct sent_uid, title || ' ' || sentence as t, '<a href="' || replace(title, '"', '%22') || '">' || title || '</a> ' || sentence as html from evidence_sents where title is not null and sentence is not null),
x as (select sent_uid, regexp_replace(html, '<[^>]*>', '', 'g') as text, unnest(regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1)) as url, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) as anchor from h)
select sent_uid, replace(url, '%22', '"') as link, cast(instr(text, anchor) - 1 as integer) as s, cast(instr(text, anchor) - 1 + length(anchor) as integer) as e from x""")
def proj37_link_spans(spark: SparkSession, path: str) -> DataFrame:
    """Anchors of HTML links with the span of each in the text without tags; texts are built from sentences and titles."""
    rows = table(spark, path, "evidence_sents").where("title is not null and sentence is not null").select("sent_uid", "title", "sentence").distinct()
    html = F.concat(F.lit('<a href="'), F.replace("title", F.lit('"'), F.lit("%22")), F.lit('">'), "title", F.lit("</a> "), "sentence")
    found = F.arrays_zip(F.regexp_extract_all(html, F.lit('<a href="([^"]*)">[^<]*</a>'), F.lit(1)).alias("url"), F.regexp_extract_all(html, F.lit('<a href="[^"]*">([^<]*)</a>'), F.lit(1)).alias("anchor"))
    each = rows.select("sent_uid", T.remove_tags(html).alias("text"), F.explode(found).alias("x"))
    return each.select("sent_uid", F.replace("x.url", F.lit("%22"), F.lit('"')).alias("link"), (F.instr("text", F.col("x.anchor")) - 1).alias("s"), (F.instr("text", F.col("x.anchor")) - 1 + F.length("x.anchor")).alias("e"))


@query(f"with {_DOCS}, s as (select query_uid, idx, list(distinct trim(lower(sentence))) as l from evidence_sents where sentence is not null group by query_uid, idx) select query_uid, idx from s join docs using (idx) where text is not null and list_bool_and(list_transform(l, lambda x: contains(lower(text), x)))")
def j06_contains_all(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs that contain all evidence sentences of a query: a relational division by the paragraph's key."""
    sents = table(spark, path, "evidence_sents").where("sentence is not null").groupBy("query_uid", "idx").agg(F.collect_set(F.trim(F.lower("sentence"))).alias("l"))
    text = paras(spark, path).where("text is not null").select("idx", F.lower("text").alias("t"))
    return sents.join(text, "idx").where(F.forall("l", lambda x: F.contains("t", x))).select("query_uid", "idx")


_QK = f"regexp_replace({S.strip('question')}, '[?!:. ]+$', '')"


@query(f"""with {_RR}, l as (select rr_uid, {_QK} as k from rr where question <> ''), n as (select {_QK} as k, count(*) as c from (select distinct sample_uid, question, neg_paras from mdr_samples where question <> '' and neg_paras is not null) x, (select unnest(x.neg_paras)) y group by 1)
select rr_uid, coalesce(c, 0) as negatives from l left join n using (k)""")
def j15_merge_negatives(spark: SparkSession, path: str) -> DataFrame:
    """Number of negatives that join a ranking record by its normalised question."""
    from tessel.operators.lookups import question_key

    key = question_key(F.col("question")).alias("k")
    negs = latest(table(spark, path, "mdr_samples").where("question <> ''"), "sample_uid", "question", "neg_paras").where("neg_paras is not null")
    counts = negs.select(key, F.size("neg_paras").alias("c")).groupBy("k").agg(F.sum("c").alias("c"))
    return ranking(spark, path).where("question <> ''").select("rr_uid", key).join(counts, "k", "left").select("rr_uid", F.coalesce("c", F.lit(0)).alias("negatives"))


@query(None)
def j21_hop_order(spark: SparkSession, path: str) -> DataFrame:
    """Order of two-paragraph evidence: the paragraph that holds the answer is last, else the linked one, else the one whose title is nearer to the other's text."""
    two = samples(spark, path).where("size(pos_paras) = 2").select("sample_uid", F.col("pos_paras")[0].alias("a"), F.col("pos_paras")[1].alias("b"), F.lower(F.coalesce(F.get("answers", F.lit(0)), F.lit(""))).alias("ans"))
    holds = lambda p: (F.col("ans") != "") & F.coalesce(F.contains(F.lower(F.col(f"{p}.text")), "ans"), F.lit(False))
    known = links(spark, path).join(firsts(spark, path).select(F.col("doc_id").cast("bigint").alias("doc_id"), "title"), "doc_id").select(F.col("title").alias("src"), F.col("link").alias("dst")).distinct()
    pair = lambda x, y, name: known.select(F.col("src").alias(f"{x}t"), F.col("dst").alias(f"{y}t"), F.lit(True).alias(name))
    rows = two.select("sample_uid", F.col("a.title").alias("at"), F.col("b.title").alias("bt"), holds("a").alias("ha"), holds("b").alias("hb"), udf.common_subsequence(T.words("a.title"), T.words("b.text")).alias("ab"), udf.common_subsequence(T.words("b.title"), T.words("a.text")).alias("ba"))
    rows = rows.join(pair("a", "b", "lab"), ["at", "bt"], "left").join(pair("b", "a", "lba"), ["at", "bt"], "left")
    forward = (
        F.when(F.col("hb") & ~F.col("ha"), True).when(F.col("ha") & ~F.col("hb"), False).when(F.col("lab").isNotNull() & F.col("lba").isNull(), True)
        .when(F.col("lba").isNotNull() & F.col("lab").isNull(), False).otherwise(F.coalesce("ba", F.lit(0)) >= F.coalesce("ab", F.lit(0)))
    )
    return rows.select("sample_uid", F.when(forward, F.array("at", "bt")).otherwise(F.array("bt", "at")).alias("titles"))


@query(f"with {_GOLD}, {_PRED}, x as (select rr_uid, string_split({S.SQUAD.format('answers[1]')}, ' ') as g, string_split({S.SQUAD.format('p')}, ' ') as p from pred) select rr_uid, len(list_intersect(g, p)) > 0.5 * len(list_distinct(g)) as dropped from x")
def j24_answer_overlap_filter(spark: SparkSession, path: str) -> DataFrame:
    """Whether a text shares more than half of an answer's words."""
    g, p = (F.split(M.squad(c), " ") for c in (F.get("answers", F.lit(0)), F.col("p")))
    return predictions(spark, path).select("rr_uid", (F.size(F.array_intersect(g, p)) > 0.5 * F.size(F.array_distinct(g))).alias("dropped"))


@query(f"""with {_RR}, l as (select {_QK} as k, max(rr_uid) as rr_uid from rr where question <> '' group by 1) select rr_uid, count(query_uid) as contexts from l left join (select distinct query_uid, {_QK} as k from iter_queries where question is not null) q using (k) group by rr_uid""")
def j27_join_contexts(spark: SparkSession, path: str) -> DataFrame:
    from tessel.operators.lookups import question_key

    key = question_key(F.col("question")).alias("k")
    left = ranking(spark, path).where("question <> ''").select("rr_uid", key).groupBy("k").agg(F.max("rr_uid").alias("rr_uid"))
    right = table(spark, path, "iter_queries").where("question is not null").select("query_uid", key).distinct()
    return left.join(right, "k", "left").groupBy("rr_uid").agg(F.count("query_uid").alias("contexts"))


@query("select distinct query_uid, hop, t.title from (select query_uid, hop, unnest(list(distinct idx)) as idx from evidence_sents group by query_uid, hop) e join (select idx, any_value(title) as title from index_paras group by idx) t using (idx) where t.title is not null")
def j28_ids_to_titles(spark: SparkSession, path: str) -> DataFrame:
    """Paragraph ids of each hop as titles."""
    e = table(spark, path, "evidence_sents").select("query_uid", "hop", "idx").distinct()
    return e.join(paras(spark, path).where("title is not null").select("idx", "title"), "idx").select("query_uid", "hop", "title").distinct()


@query(f"with {_SIM} select tsrc as train, src as test, round(max(sim), 6) as best from near group by all")
def a07_reversed_nesting(spark: SparkSession, path: str) -> DataFrame:
    return nearest_train(spark, path).groupBy(F.col("tsrc").alias("train"), F.col("src").alias("test")).agg(F.round(F.max("sim"), 6).alias("best"))


@query(f"""with {_SIM}, {_GOLD} select src, run, count(*) as n, round(avg(case when run = 1 then sim else 100 - sim end), 4) as mean from near, (values (1), (2)) r(run) group by src, run""")
def a10_summary_per_run(spark: SparkSession, path: str) -> DataFrame:
    """The summary for every run of scores."""
    runs = nearest_train(spark, path).withColumn("run", F.explode(F.array(F.lit(1), F.lit(2))))
    score = F.when(F.col("run") == 1, F.col("sim")).otherwise(100 - F.col("sim"))
    return runs.groupBy("src", "run").agg(F.count("*").alias("n"), F.round(F.avg(score), 4).alias("mean"))


@query("select l_linestatus as ds, round(avg(l_discount), 8) as unfiltered, round(avg(l_discount) filter (l_quantity > 10), 8) as filtered from lineitem group by 1")
def a17_filtered_beside_unfiltered(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, "lineitem").groupBy(F.col("l_linestatus").alias("ds")).agg(F.round(F.avg("l_discount"), 8).alias("unfiltered"), F.round(F.avg(F.when(F.col("l_quantity") > 10, F.col("l_discount"))), 8).alias("filtered"))


@query(rf"""with {_SIM}, a as (select distinct sample_uid as uid, answers[1] as ans from mdr_samples where answers[1] <> '')
select bucket, count(*) as n, count(*) filter (not seen) as unseen from (select case when sim < 60 then 0 when sim < 90 then 60 else 90 end as bucket, ans in (select distinct answers[1] from mdr_samples where lower(trim(split)) = 'train' and answers[1] <> '') as seen from near join a using (uid)) group by bucket""")
def a19_no_answer_overlap(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation records per similarity bucket, and those whose first answer no training record has."""
    first = F.get("answers", F.lit(0))
    ans = table(spark, path, "mdr_samples").where(first != "").select(F.col("sample_uid").alias("uid"), first.alias("ans"), "split")
    train = ans.where(F.lower(F.trim("split")) == "train").select("ans", F.lit(True).alias("seen")).distinct()
    rows = nearest_train(spark, path).join(ans.select("uid", "ans").distinct(), "uid").join(train, "ans", "left")
    return rows.groupBy(ST.bucket(F.col("sim"), [0, 60, 90, 101]).cast("int").alias("bucket")).agg(F.count("*").alias("n"), F.sum(F.col("seen").isNull().cast("bigint")).alias("unseen"))


@query("""with r as (select distinct on (rr_uid) coalesce(src, 'none') as src, coalesce(len(pos_paras), 0) as p, mc_options is not null as mc, context is not null as c from rr_samples order by rr_uid, loaded_at desc)
select coalesce(src, 'TOTAL') as src, count(*) as n, round(avg(p), 6) as mean_pos, bool_or(mc) as any_options, bool_or(c) as any_context from r group by rollup (src)""")
def a24_final_stats(spark: SparkSession, path: str) -> DataFrame:
    p = F.coalesce(F.when(F.col("pos_paras").isNotNull(), F.size("pos_paras")), F.lit(0))
    rows = ranking(spark, path).select(F.coalesce("src", F.lit("none")).alias("src"), p.alias("p"), F.col("mc_options").isNotNull().alias("mc"), F.col("context").isNotNull().alias("c"))
    stats = rows.rollup("src").agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean_pos"), F.bool_or("mc").alias("any_options"), F.bool_or("c").alias("any_context"))
    return stats.withColumn("src", F.coalesce("src", F.lit("TOTAL")))


@query(f"select lang, round(sum(len({S.words('text')})) * 1.0 / sum(length(text)), 6) as ratio from documents where text <> '' and lang is not null group by lang")
def a27_length_ratio(spark: SparkSession, path: str) -> DataFrame:
    """Words per character, over all documents."""
    rows = table(spark, path, "documents").where("text <> '' and lang is not null")
    return rows.groupBy("lang").agg(F.round(F.sum(F.size(T.words("text"))) / F.sum(F.length("text")), 6).alias("ratio"))


@query(None)
def a29_pairwise_tests(spark: SparkSession, path: str) -> DataFrame:
    """Bootstrap tests of each pair of three score columns: 10,000 resamples, drawn once for all pairs."""
    names = ("score", "s1para_score", "s2_score")
    rows = evidence(spark, path, *names).where("s2_score <> -1 and not isnan(s2_score) and score is not null and s1para_score is not null")
    sums = cut(ST.bootstrap_sums(rows, "sent_uid", {c: F.col(c) for c in names}))
    mean = lambda c: F.col(c) / F.col("n") / ST.UNIT
    tests = [ST.compared(sums.select("i", mean(a).alias("a"), mean(b).alias("b"))).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "*") for a, b in itertools.combinations(names, 2)]
    return functools.reduce(DataFrame.unionByName, tests)


_T = [i / 10 for i in range(1, 10)]


@query(f"""with {_EV}, r as (select query_uid, idx, max(s1para_score) as s, bool_or(s2_score > 0.5) as l from ev where s1para_score is not null and s2_score is not null and not isnan(s2_score) group by query_uid, idx), t as (select unnest({_T}) as threshold)
select cast(threshold as double) as threshold, count(*) as n, count(*) filter ((s >= threshold) = l) as right, count(*) filter (s >= threshold and l) as tp, count(*) filter (s >= threshold and not l) as fp, count(*) filter (s < threshold and l) as fn from r, t group by threshold""")
def a32_paragraph_sweep(spark: SparkSession, path: str) -> DataFrame:
    """Threshold sweep by paragraph."""
    rows = table(spark, path, "evidence_sents").where("s1para_score is not null and s2_score is not null and not isnan(s2_score)")
    per = rows.groupBy("query_uid", "idx").agg(F.max("s1para_score").alias("s"), F.bool_or(F.col("s2_score") > 0.5).alias("label"))
    return ST.threshold_sweep(per, "s", "label", _T)


@query(f"with {_EV}, r as (select s2ev_score as s, s2_score > 0.5 as l from ev where s2ev_score is not null and s2_score is not null and not isnan(s2_score) and not isnan(s2ev_score)), t as (select unnest({_T}) as threshold), x as (select threshold, count(*) filter ((s >= threshold) = l) * 1.0 / count(*) as acc from r, t group by threshold) select cast(arg_max(threshold, (acc, -threshold)) as double) as threshold, round(max(acc), 6) as accuracy from x")
def a33_best_threshold(spark: SparkSession, path: str) -> DataFrame:
    """The threshold of the highest accuracy, the lowest of equal ones."""
    rows = evidence(spark, path, "s2ev_score", "s2_score").where("s2_score is not null and not isnan(s2_score)").withColumn("label", F.col("s2_score") > 0.5)
    acc = ST.threshold_sweep(rows, "s2ev_score", "label", _T).withColumn("acc", F.col("right") / F.col("n"))
    return acc.agg(F.max(F.struct("acc", (-F.col("threshold")).alias("t"))).alias("b")).select((-F.col("b.t")).alias("threshold"), F.round("b.acc", 6).alias("accuracy"))


@query(f"with {_SIM} select uid, src, sim, case when sim < 60 then '0' when sim < 90 then '60' else '90' end as bucket, cast(rn as integer) as rank from (select *, row_number() over (partition by src order by sim desc, uid) as rn from near) where rn <= 10")
def w09_most_similar_per_source(spark: SparkSession, path: str) -> DataFrame:
    rows = nearest_train(spark, path).withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.col("sim").desc(), "uid"))).where("rank <= 10")
    return rows.select("uid", "src", "sim", ST.bucket(F.col("sim"), [0, 60, 90, 101]).cast("int").cast("string").alias("bucket"), "rank")


@query(f"with {_EV}, h as (select query_uid, hop, idx, max(s2_score) as s from ev where s2_score is not null and not isnan(s2_score) group by all), p as (select a.query_uid, a.idx as first, b.idx as second, round(a.s + b.s, 6) as score from h a join h b on a.query_uid = b.query_uid and a.hop = 0 and b.hop = 1) select query_uid, first, second, score, cast(rn as integer) as rank from (select *, row_number() over (partition by query_uid order by score desc, first, second) as rn from p) where rn <= 3")
def w05_best_paths(spark: SparkSession, path: str) -> DataFrame:
    """Three best paths over two hops: only the three best paragraphs of a hop can be on them, so the rest is cut before the hops are joined."""
    rows = table(spark, path, "evidence_sents").where("s2_score is not null and not isnan(s2_score)")
    hops = rows.groupBy("query_uid", "hop", "idx").agg(F.max("s2_score").alias("s"))
    near = hops.withColumn("rn", F.rank().over(Window.partitionBy("query_uid", "hop").orderBy(F.col("s").desc()))).where("rn <= 3")
    a, b = near.where("hop = 0").select("query_uid", F.col("idx").alias("first"), F.col("s").alias("x")), near.where("hop = 1").select("query_uid", F.col("idx").alias("second"), F.col("s").alias("y"))
    paths = a.join(b, "query_uid").select("query_uid", "first", "second", F.round(F.col("x") + F.col("y"), 6).alias("score"))
    return paths.withColumn("rank", F.row_number().over(Window.partitionBy("query_uid").orderBy(F.col("score").desc(), "first", "second"))).where("rank <= 3")


@query("select c_name as name, 'customer' as origin from customer union all select s_name, 'supplier' from supplier")
def d08_union_all(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, "customer").select(F.col("c_name").alias("name"), F.lit("customer").alias("origin")).unionByName(table(spark, path, "supplier").select(F.col("s_name").alias("name"), F.lit("supplier").alias("origin")))


@query(None)
def t16_shortest_overlap(spark: SparkSession, path: str) -> DataFrame:
    """Sentences of a query and hop whose common subsequence with their title is shortest, ties kept."""
    rows = table(spark, path, "evidence_sents").where("sentence is not null and title is not null").select("sent_uid", "query_uid", "hop", udf.common_subsequence(T.words("title"), T.words("sentence")).alias("n")).distinct()
    return rows.withColumn("rk", F.rank().over(Window.partitionBy("query_uid", "hop").orderBy("n"))).where("rk = 1").select("query_uid", "hop", "sent_uid", "n")


@query("select idx, replace(text, title, 'WHAT') as question from (select idx, any_value(text) as text, any_value(title) as title from index_paras where text is not null and title <> '' group by idx) where contains(text, title)")
def t19_cloze_identity(spark: SparkSession, path: str) -> DataFrame:
    """The title within its paragraph replaced by a question word."""
    rows = latest(table(spark, path, "index_paras").where("text is not null and title <> ''"), "idx", "text", "title")
    return rows.where(F.contains("text", "title")).select("idx", F.replace("text", F.col("title"), F.lit("WHAT")).alias("question"))


@query(f"""with w as (select doc_id, {S.words("text")} as w from documents where text is not null),
s as (select doc_id, list_transform(list_sort(list_transform(w, lambda x, i: {{'k': i - 1 + 2 * {S.draw(7, "doc_id", "i - 1")}, 'i': i, 'x': x}})), lambda t: t.x) as w from w),
d as (select doc_id, list_filter(w, lambda x, i: {S.draw(8, "doc_id", "i - 1")} >= 0.2) as w from s)
select doc_id, list_transform(w, lambda x, i: case when {S.draw(9, "doc_id", "i - 1")} < 0.1 then '<mask>' else x end) as words from d""")
def t22_word_noise(spark: SparkSession, path: str) -> DataFrame:
    """Seeded noise: words moved by their position plus a draw below two, a fifth of them dropped, a tenth of the rest masked."""
    rows = table(spark, path, "documents").where("text is not null").select("doc_id", T.words("text").alias("w"))
    keyed = F.transform("w", lambda x, i: F.struct((i + 2 * B.draw(7, F.col("doc_id"), i)).alias("k"), i.alias("i"), x.alias("x")))
    moved = rows.select("doc_id", F.transform(F.array_sort(keyed), lambda t: t["x"]).alias("w"))
    kept = moved.select("doc_id", F.filter("w", lambda x, i: B.draw(8, F.col("doc_id"), i) >= 0.2).alias("w"))
    return kept.select("doc_id", F.transform("w", lambda x, i: F.when(B.draw(9, F.col("doc_id"), i) < 0.1, F.lit("<mask>")).otherwise(x)).alias("words"))


@query(None)
def t26_normalised_numbers(spark: SparkSession, path: str) -> DataFrame:
    """Questions with their numbers in plain and in place notation."""
    rows = ranking(spark, path).where("question is not null")
    return rows.select("rr_uid", udf.with_normal_numbers("question").alias("numbers"), udf.with_normal_numbers("question", True).alias("places"))


@query(None)
def t30_penn_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Tokens of sixteen classes with their spans; quotes, dashes and ellipses in one form."""
    return table(spark, path, "documents").where("text is not null").select("doc_id", udf.penn("text").alias("t")).select("doc_id", F.col("t.token").alias("tokens"), F.col("t.s").alias("starts"))


@query(r"select doc_id, regexp_extract_all(nfc_normalize(strip_accents(lower(text))), '[\p{L}\p{N}\p{M}]+|[^\s\p{Z}\p{C}\p{L}\p{N}]') as tokens from documents where text is not null")
def t31_basic_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Lower case without accents, punctuation as single tokens."""
    rows = table(spark, path, "documents").where("text is not null")
    return rows.select("doc_id", F.regexp_extract_all(udf.fold(F.lower("text")), F.lit(r"[\p{L}\p{N}\p{M}]+|[^\s\p{Z}\p{C}\p{L}\p{N}]"), F.lit(0)).alias("tokens"))


@query(f"with {_M}, {_POS} select sample_uid, cast(i as integer) as para_no, list_sort(list_distinct(regexp_extract_all(p.text, '[0-9]{{4}}'))) as years from pos where p.text is not null")
def t36_matched_spans(spark: SparkSession, path: str) -> DataFrame:
    """Distinct matches of a pattern."""
    return positives(spark, path).where("p.text is not null").select("sample_uid", F.col("i").alias("para_no"), F.array_sort(F.array_distinct(F.regexp_extract_all("p.text", F.lit("[0-9]{4}"), F.lit(0)))).alias("years"))


@query(f"with {_GOLD}, {_PRED} select rr_uid, case when p = answers[1] then 3.0 when {S.SQUAD.format('p')} = {S.SQUAD.format('answers[1]')} then 2.0 else 0.0 end as base from pred")
def m08_string_similarity(spark: SparkSession, path: str) -> DataFrame:
    """3 for equal texts, 2 for equal normalised ones; below that the F1 decides (m06)."""
    gold = F.get("answers", F.lit(0))
    return predictions(spark, path).select("rr_uid", F.when(F.col("p") == gold, 3.0).when(M.squad(F.col("p")) == M.squad(gold), 2.0).otherwise(0.0).alias("base"))


@query(f"""with {_RR}, a as (select rr_uid, unnest(list_transform(answers, lambda x: {S.words("coalesce(x, '')")})) as w, generate_subscripts(answers, 1) as i from rr where len(answers) > 1),
g as (select rr_uid, i, n, g, count(*) as c from (select rr_uid, i, 1 as n, unnest(w) as g from a union all select rr_uid, i, 2, unnest(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) from a) group by all),
h as (select x.rr_uid, x.i, x.n, x.g, x.c, coalesce(max(y.c), 0) as most from g x left join g y on y.rr_uid = x.rr_uid and y.g = x.g and y.n = x.n and y.i <> x.i group by all),
m as (select rr_uid, i, sum(least(c, most)) filter (n = 1) as h1, sum(c) filter (n = 1) as t1, sum(least(c, most)) filter (n = 2) as h2, sum(c) filter (n = 2) as t2 from h group by all),
r as (select x.rr_uid, x.i, len(x.w) as n, min(len(y.w)) as ref from a x join a y on y.rr_uid = x.rr_uid and y.i <> x.i group by x.rr_uid, x.i, len(x.w)),
b as (select r.rr_uid, r.i, case when coalesce(h1, 0) = 0 or coalesce(h2, 0) = 0 then 0.0 else 100 * sqrt((h1 / t1) * (h2 / t2)) * case when n <= greatest(1, ref) then exp(1 - greatest(1, ref) / n) else 1 end end as bleu from r left join m using (rr_uid, i))
select rr_uid, list(round(bleu, 6) order by i) as scores, round(avg(bleu), 6) as self_bleu from b group by rr_uid""")
def m14_self_bleu(spark: SparkSession, path: str) -> DataFrame:
    """Self-BLEU-2 of the answers of a record: of each against the others, and the mean."""
    rows = ranking(spark, path).where("size(answers) > 1").select("rr_uid", udf.self_bleus("answers").alias("scores"))
    mean = F.aggregate("scores", F.lit(0.0), lambda s, x: s + x) / F.size("scores")
    return rows.select("rr_uid", F.transform("scores", lambda x: F.round(x, 6)).alias("scores"), F.round(mean, 6).alias("self_bleu"))


@query(f"with {_GOLD}, {_PRED}, {_F1} select rr_uid, round(f1, 6) as f1, round(prec, 6) as prec, round(rec, 6) as rec from f1 where prec is not null and rec is not null")
def m17_precision_recall(spark: SparkSession, path: str) -> DataFrame:
    tokens = lambda c: F.filter(F.split(M.squad(c), " "), lambda w: w != "")
    rows = predictions(spark, path).select("rr_uid", tokens(F.col("p")).alias("p"), tokens(F.get("answers", F.lit(0))).alias("g")).where("size(p) > 0 and size(g) > 0")
    same = M.multiset_same(F.col("p"), F.col("g"))
    rows = rows.withColumn("n", same)
    return rows.select("rr_uid", F.round(2.0 * F.col("n") / (F.size("p") + F.size("g")), 6).alias("f1"), F.round(F.col("n") / F.size("p"), 6).alias("prec"), F.round(F.col("n") / F.size("g"), 6).alias("rec"))


_WORD = "list_filter(string_split({0}, ' '), lambda w: w <> '')"


@query(rf"""with q as (select distinct query_uid, sample_type, answer[1] as gold, sp_facts from iter_queries),
pa as (select query_uid, {S.SQUAD.format("gold")} as g, {S.SQUAD.format("p")} as p from (select *, array_to_string(list_filter(list_transform({S.words("gold")}, lambda w, i: case when i % 3 <> 0 then w end), lambda w: w is not null), ' ') as p from q where gold <> '' and query_uid % 7 <> 0)),
tp as (select query_uid, w, count(*) as n from (select query_uid, unnest({_WORD.format("p")}) as w from pa) group by all), tg as (select query_uid, w, count(*) as n from (select query_uid, unnest({_WORD.format("g")}) as w from pa) group by all),
sm as (select query_uid, sum(least(tp.n, tg.n)) as same from tp join tg using (query_uid, w) group by all),
an as (select query_uid, cast(p = g as integer) as em, case when p <> g and (p in ('yes', 'no', 'noanswer') or g in ('yes', 'no', 'noanswer')) then 0.0 else coalesce(same, 0) * 1.0 / nullif(len({_WORD.format("p")}), 0) end as pr, case when p <> g and (p in ('yes', 'no', 'noanswer') or g in ('yes', 'no', 'noanswer')) then 0.0 else coalesce(same, 0) * 1.0 / nullif(len({_WORD.format("g")}), 0) end as re from pa left join sm using (query_uid)),
gf as (select distinct query_uid, unnest(list_transform(sp_facts, lambda f: f.title || chr(1) || f.sent_idx)) as f from q where sp_facts is not null),
pf as (select distinct query_uid, title || chr(1) || s_idx as f from evidence_sents where s2_score > 0.3 and not isnan(s2_score) and title is not null),
gn as (select query_uid, count(*) as g from gf group by 1), pn as (select query_uid, count(*) as p from pf group by 1), bn as (select query_uid, count(*) as b from gf join pf using (query_uid, f) group by 1),
sp as (select query_uid, cast(coalesce(b, 0) = coalesce(g, 0) and coalesce(b, 0) = p as integer) as em, coalesce(b, 0) * 1.0 / p as pr, coalesce(coalesce(b, 0) * 1.0 / g, 0) as re from pn left join gn using (query_uid) left join bn using (query_uid)),
x as (select q.query_uid, sample_type, coalesce(an.em, 0) as em, coalesce(an.pr, 0) as prec, coalesce(an.re, 0) as recall, coalesce(sp.em, 0) as sp_em, coalesce(sp.pr, 0) as sp_prec, coalesce(sp.re, 0) as sp_recall from q left join an using (query_uid) left join sp using (query_uid)),
y as (select *, em * sp_em as joint_em, prec * sp_prec as joint_prec, recall * sp_recall as joint_recall from x)
select sample_type, count(*) as n, {", ".join(f"round(avg({p}em) * 100, 4) as {p}em, round(avg({p}prec) * 100, 4) as {p}prec, round(avg({p}recall) * 100, 4) as {p}recall, round(avg(case when {p}prec + {p}recall > 0 then 2 * {p}prec * {p}recall / ({p}prec + {p}recall) else 0 end) * 100, 4) as {p}f1" for p in ("", "sp_", "joint_"))} from y group by sample_type""")
def m20_joint_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """Answer, evidence and joint scores (em, precision, recall, F1) per type, divided by all gold queries: one without a predicted answer or evidence counts zero there and
    jointly. The answer predicted is the gold without every third word, for six of seven queries."""
    from tessel.plans.metrics import fact

    gold = table(spark, path, "iter_queries").select("query_uid", "sample_type", F.get("answer", F.lit(0)).alias("gold"), "sp_facts").distinct()
    dropped = F.array_join(F.filter(F.transform(T.words("gold"), lambda w, i: F.when((i + 1) % 3 != 0, w)), lambda w: w.isNotNull()), " ")
    predicted = gold.where("gold <> '' and query_uid % 7 <> 0").select("query_uid", M.hotpot(dropped, F.col("gold")).alias("a"))
    wanted = gold.select("query_uid", F.explode("sp_facts").alias("f")).groupBy("query_uid").agg(F.collect_set(fact(F.col("f.title"), F.col("f.sent_idx"))).alias("g"))
    found = table(spark, path, "evidence_sents").where("s2_score > 0.3 and not isnan(s2_score) and title is not null").groupBy("query_uid").agg(F.collect_set(fact(F.col("title"), F.col("s_idx"))).alias("p"))
    evidence_scores = found.join(wanted, "query_uid", "left").select("query_uid", M.set_scores(F.col("p"), F.coalesce("g", F.array().cast("array<string>"))).alias("e"))
    rows = gold.join(predicted, "query_uid", "left").join(evidence_scores, "query_uid", "left")
    of = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    parts = {"": [of("a.em"), of("a.precision"), of("a.recall")], "sp_": [of("e.em"), of("e.precision"), of("e.recall")]}
    parts["joint_"] = [x * y for x, y in zip(parts[""], parts["sp_"], strict=True)]
    mean = lambda c, name: F.round(F.avg(c) * 100, 4).alias(name)
    out = []
    for name, (em, p, r) in parts.items():
        out += [mean(em, f"{name}em"), mean(p, f"{name}prec"), mean(r, f"{name}recall"), mean(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), f"{name}f1")]
    return rows.groupBy("sample_type").agg(F.count("*").alias("n"), *out)


@query(f"with {_EV} select hop, round(corr(score, s1para_score), 6) as pearson, round(avg(cast((score > 0.5) = (s1para_score > 0.5) as integer)) * 100, 4) as accuracy from ev where score is not null and s1para_score is not null group by hop")
def m22_measures(spark: SparkSession, path: str) -> DataFrame:
    rows = evidence(spark, path, "hop", "score", "s1para_score").where("score is not null and s1para_score is not null")
    return rows.groupBy("hop").agg(F.round(F.corr("score", "s1para_score"), 6).alias("pearson"), F.round(F.avg(((F.col("score") > 0.5) == (F.col("s1para_score") > 0.5)).cast("int")) * 100, 4).alias("accuracy"))


@query(f"with {_EV}, q as (select query_uid, max(score) as a, max(s2ev_score) as b from ev where s2ev_score is not null and not isnan(s2ev_score) group by query_uid) select query_uid, case when a >= 0.9 then 'answer' when b >= 0.5 then 'evidence' else 'none' end as rule from q")
def m27_combined_rule(spark: SparkSession, path: str) -> DataFrame:
    rows = table(spark, path, "evidence_sents").where("s2ev_score is not null and not isnan(s2ev_score)").groupBy("query_uid").agg(F.max("score").alias("a"), F.max("s2ev_score").alias("b"))
    return rows.select("query_uid", F.when(F.col("a") >= 0.9, "answer").when(F.col("b") >= 0.5, "evidence").otherwise("none").alias("rule"))


@query(f"with {_SIM} select src, tsrc, count(*) as n, round(avg(sim), 4) as mean from near group by src, tsrc")
def l08_every_pair_of_sets(spark: SparkSession, path: str) -> DataFrame:
    """Every evaluation source with the training sources that hold the nearest row of one of its questions; all pairs of sets are in l08_every_train_with_every_eval."""
    return nearest_train(spark, path).groupBy("src", "tsrc").agg(F.count("*").alias("n"), F.round(F.avg("sim"), 4).alias("mean"))


@query(f"""with {_SIM}, best as (select uid, src, tsrc, max(round(100 * same / sqrt(en * tn), 6)) as sim from hit group by uid, src, tsrc), e as (select uid, src from q where not t), s as (select distinct src as tsrc from q where t)
select src, tsrc, count(*) as n, round(avg(coalesce(sim, 0)), 4) as mean from e cross join s left join best using (uid, src, tsrc) group by src, tsrc""")
def l08_every_train_with_every_eval(spark: SparkSession, path: str) -> DataFrame:
    """Every evaluation source with every training source: the mean over all questions of the one of their best similarity in the other, zero where no word is common."""
    q = questions(spark, path)
    held, train = q.where("not t"), q.where("t").withColumnRenamed("src", "tsrc")
    best = SIM.nearest_by_words(held.where("size(words) > 0"), train.where("size(words) > 0"), group="tsrc").select("uid", "tsrc", F.round(100 * F.col("score"), 6).alias("sim"))
    every = held.select("uid", "src").crossJoin(F.broadcast(train.select("tsrc").distinct()))
    return every.join(best, ["uid", "tsrc"], "left").groupBy("src", "tsrc").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("sim", F.lit(0.0))), 4).alias("mean"))


@query(f"select uid, other, round(score, 6) as score from ({_TOP.format(1)}) where uid % 40 <> 0")
def l09_only_missing(spark: SparkSession, path: str) -> DataFrame:
    """Similarities of the queries that an earlier result lacks."""
    rows = table(spark, path, "embeddings").select(F.col("vec_id").alias("uid"), F.col("embedding").alias("vector"))
    done = rows.where("uid % 40 = 0").select("uid")
    todo = cut(rows.where("uid % 20 = 0").join(done, "uid", "left_anti"))
    return SIM.nearest_by_vector(todo, rows, 1).select("uid", "other", F.round("score", 6).alias("score"))


@query("with d as (select user_id, event_type, count(*) as n, avg(value) as v from events group by all), g as (select event_type, sum(v) as s from d group by event_type) select user_id, event_type, round(v / s, 8) as p from d join g using (event_type)")
def i04_two_level_sampling(spark: SparkSession, path: str) -> DataFrame:
    """Probabilities within each of two levels."""
    d = table(spark, path, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    return d.select("user_id", "event_type", F.round(F.col("v") / F.sum("v").over(Window.partitionBy("event_type")), 8).alias("p"))


def hop_loop(evidence: DataFrame, hops: int = 4, enough: float = 0.9) -> DataFrame:
    """(query_uid, hop, s, stop_reason): where each query of (query_uid, hop, s2ev_score) stops, one row per query.

    A query stops at the first hop with enough evidence ('evsuff') or at its own last hop ('max'); a hop without a usable score has none and is passed unless it is the last.
    """
    usable = F.when(~F.isnan("s2ev_score"), F.col("s2ev_score"))
    rows = evidence.where(F.col("hop") < hops).groupBy("query_uid", "hop").agg(F.max(usable).alias("s"))
    rows = cut(rows.withColumn("last", F.max("hop").over(Window.partitionBy("query_uid"))))
    active = cut(rows.select("query_uid").distinct())
    suff, last = F.coalesce(F.col("s") >= enough, F.lit(False)), F.col("hop") == F.col("last")
    stopped = None
    for hop in range(hops):
        now = rows.where(F.col("hop") == hop).join(active, "query_uid")
        stop = now.where(suff | last).select("query_uid", "hop", "s", F.array_compact(F.array(F.when(suff, F.lit("evsuff")), F.when(last, F.lit("max")))).alias("stop_reason"))
        stopped = stop if stopped is None else stopped.unionByName(stop)
        active = cut(active.join(stop.select("query_uid"), "query_uid", "left_anti"))
    return cut(stopped)


@query("""with e as (select query_uid, hop, max(case when not isnan(s2ev_score) then s2ev_score end) as s from evidence_sents where hop < 4 group by all),
l as (select *, max(hop) over (partition by query_uid) as last from e), c as (select *, coalesce(s >= 0.9, false) as suff from l)
select distinct on (query_uid) query_uid, hop, s, list_filter([case when suff then 'evsuff' end, case when hop = last then 'max' end], lambda x: x is not null) as stop_reason from c where suff or hop = last order by query_uid, hop""")
def i02_hop_loop(spark: SparkSession, path: str) -> DataFrame:
    """The hop loop: rows of a hop are read only for queries that have not stopped; the state is checkpointed every hop."""
    return hop_loop(table(spark, path, "evidence_sents").select("query_uid", "hop", "s2ev_score"))


@query(None)
def i02_iterator(spark: SparkSession, path: str) -> DataFrame:
    """The whole iteration: dense, stage one, stage two and the stop rule at every hop, with the evidence at the end."""
    columns = ("query_uid", "hop", "idx", "s_idx", "sent_uid", "score", "s1para_score", "s2_score", "s2ev_score")
    return iterate(table(spark, path, "evidence_sents").where("query_uid is not null and hop is not null").select(*columns))


@query(f"select o_custkey, o_orderkey, {S.draw(7, 'o_custkey')} as slot from orders")
def i07_group_shuffle(spark: SparkSession, path: str) -> DataFrame:
    """A seeded order of groups; rows of a group stay together."""
    return table(spark, path, "orders").select("o_custkey", "o_orderkey", B.draw(7, "o_custkey").alias("slot"))


@query(f"""with w as (select doc_id, {S.words("text")} as w from documents where text is not null)
select doc_id, array_to_string(list_transform(w, lambda x, i: case when {S.draw(7, "doc_id", "i - 1")} < 0.1 or ({S.draw(7, "doc_id", "i - 2")} < 0.1 and {S.draw(8, "doc_id", "i - 1")} < 0.5) then '<mask>' else x end), ' ') as masked from w""")
def i11_masked_spans(spark: SparkSession, path: str) -> DataFrame:
    """Seeded spans of one to three words masked, about one word in ten."""
    rows = table(spark, path, "documents").where("text is not null").select("doc_id", T.words("text").alias("w"))
    hit = lambda i: B.draw(7, F.col("doc_id"), i) < 0.1
    masked = F.transform("w", lambda x, i: F.when(hit(i) | (hit(i - 1) & (B.draw(8, F.col("doc_id"), i) < 0.5)), F.lit("<mask>")).otherwise(x))
    return rows.select("doc_id", F.array_join(masked, " ").alias("masked"))


@query("select ds_name, t.key as key, t.value as value from (select ds_name, unnest([{'key': 'type', 'value': ds_type}, {'key': 'prefer', 'value': prefer}]) as t from dataset_catalogue)")
def g09_flattened_map(spark: SparkSession, path: str) -> DataFrame:
    """Nested entries as rows."""
    entries = F.create_map(F.lit("type"), "ds_type", F.lit("prefer"), "prefer")
    return table(spark, path, "dataset_catalogue").select("ds_name", F.explode(entries).alias("key", "value"))


@query(f"with {_RR} select rr_uid, question, coalesce(src, '') as src, coalesce(answers, []) as answers from rr")
def g07_ranking_record(spark: SparkSession, path: str) -> DataFrame:
    """The canonical ranking record."""
    return ranking(spark, path).select("rr_uid", "question", F.coalesce("src", F.lit("")).alias("src"), F.coalesce("answers", F.array().cast("array<string>")).alias("answers"))


@query(rf"""{_PARSE_WITH}, x as (select doc_id, context, 'The answer is one of ' || array_to_string(list_filter(list_transform(string_split(regexp_replace(mc_options, '\([A-H]\) ', chr(1), 'g'), chr(1)), lambda o: {S.strip('o')}), lambda o: o <> ''), ', ') || '.' as extra from parsed where mc_options <> '')
select doc_id, case when {S.draw(7, "doc_id")} < 0.5 then extra || ' ' || context else context || ' ' || extra end as text from x""")
def g08_templated_sentences(spark: SparkSession, path: str) -> DataFrame:
    """A templated sentence before or after the options, by a seeded draw."""
    rows = parsed(spark, path).where("mc_options <> ''")
    extra = F.concat(F.lit("The answer is one of "), F.array_join(qa.options(F.col("mc_options")), ", "), F.lit("."))
    return rows.select("doc_id", F.when(B.draw(7, "doc_id") < 0.5, F.concat(extra, F.lit(" "), "context")).otherwise(F.concat("context", F.lit(" "), extra)).alias("text"))


@query(f"""with {_M}, {_POS}, s as (select sample_uid, i, p.title as title, unnest(p.sentence_labels) as label, generate_subscripts(p.sentence_labels, 1) as k from pos where p.title is not null),
n as (select sample_uid, i, count(*) as n from s where label is not null group by all), e as (select s.*, n from s join n using (sample_uid, i) where label is not null),
d as (select sample_uid, i, title, label, min(k) as k from e where n > 1 group by all)
select sample_uid, title, list_sort(list_distinct(list(label))) as labels, true as single from e where n = 1 group by sample_uid, title
union all select sample_uid, title || '_vvv' || cast(row_number() over (partition by sample_uid, i order by k) - 1 as varchar), [label], false from d""")
def g16_consolidated_evidence(spark: SparkSession, path: str) -> DataFrame:
    """Evidence sets consolidated: sets of one sentence by title, any of whose sentences will do; sets of several sentences, here of one paragraph each, all of which are
    needed, so each stands under a name of its own."""
    each = positives(spark, path).where("p.title is not null").select("sample_uid", F.col("i").alias("set_no"), F.col("p.title").alias("title"), F.posexplode("p.sentence_labels").alias("k", "label"))
    return B.consolidate_evidence(each.where("label is not null"), "sample_uid", "set_no", "title", "label", "k").select("sample_uid", "title", "labels", "single")


@query(f"with {_M} select sample_uid, pos_paras[1].title as positive, coalesce(list_transform(neg_paras[1:10], lambda p: p.title), []) as negatives from m where len(pos_paras) > 0")
def g18_first_positive(spark: SparkSession, path: str) -> DataFrame:
    """The first positive with up to ten negatives of its own."""
    rows = samples(spark, path).where("size(pos_paras) > 0")
    negatives = F.coalesce(F.slice("neg_paras", 1, 10)["title"], F.array().cast("array<string>"))
    return rows.select("sample_uid", F.col("pos_paras")[0]["title"].alias("positive"), negatives.alias("negatives"))


@query(None)
def g18_topped_up(spark: SparkSession, path: str) -> DataFrame:
    """The first positive with ten negatives or more: those of the record, then titles of the index that are neither gold nor already taken."""
    rows = samples(spark, path).where("size(pos_paras) > 0")
    own = rows.select("sample_uid", F.explode("neg_paras.title").alias("title"))
    gold = rows.select("sample_uid", F.explode("pos_paras.title").alias("title"))
    found = B.top_up(rows, own, gold, table(spark, path, "index_paras"), "sample_uid", "title", 10)
    lists = found.groupBy("sample_uid").agg(F.array_sort(F.collect_list(F.struct("origin", "title"))).alias("negatives"))
    return rows.select("sample_uid", F.col("pos_paras")[0]["title"].alias("positive")).join(lists, "sample_uid")


@query(f"""with {_DOCS}, p as (select doc_id, para_idx, idx, {S.words("text")} as w from docs where text is not null), b as (select *, coalesce(sum(len(w) + 1) over (partition by doc_id order by para_idx, idx rows between unbounded preceding and 1 preceding), 0) as before from p),
o as (select *, before + len(w) > 300 as cut from b), f as (select *, coalesce(max(cast(cut as integer)) over (partition by doc_id order by para_idx, idx rows between unbounded preceding and 1 preceding), 0) as ended from o)
select doc_id, string_agg(case when cut then array_to_string(w[1:greatest(0, 300 - before - 1)], ' ') || '...' else array_to_string(w, ' ') end, ' ' order by para_idx, idx) as text,
 cast(sum(case when cut then greatest(0, 300 - before - 1) else len(w) end) as bigint) as words, count(*) as paras from f where ended = 0 group by doc_id""")
def g15_packed_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """One sample a document: its paragraphs in order while they fit 300 words, a paragraph costing one more; the first that does not fit is cut to what is left, marked and the last."""
    rows = paras(spark, path).where("text is not null").select("doc_id", "para_idx", "idx", T.words("text").alias("w"))
    kept = B.pack_cut(rows, ["doc_id"], [F.col("para_idx"), F.col("idx")], "w", 300)
    part = F.concat(F.array_join("kept", " "), F.when(F.col("cut"), "...").otherwise(""))
    parts = F.array_sort(F.collect_list(F.struct("para_idx", "idx", part.alias("text"))))
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("text"), F.sum(F.size("kept")).alias("words"), F.count("*").alias("paras"))
