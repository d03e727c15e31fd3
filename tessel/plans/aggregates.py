"""Aggregations (A), windows and top-k (W) and iteration state (I) over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.catalog import query
from tessel.functions import sql as S
from tessel.functions import text as T
from tessel.operators import statistics as ST
from tessel.operators.similarity import nearest_by_words
from tessel.sources.tables import latest, table

_EV = "ev as (select distinct sent_uid, query_uid, hop, idx, s_idx, title, sentence, score, s1para_score, s2_score, s2ev_score from evidence_sents)"
_MEAN = "cast(sum({0}) as double) / nullif(count({0}), 0)"


def evidence(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Distinct rows of the chosen columns, the key among them."""
    return table(spark, path, "evidence_sents").select("sent_uid", *columns).distinct()


def _metric(group: str, name: str) -> str:
    u = f"case when {name} <> -1 and not isnan({name}) then cast(round({name} * 1000000) as bigint) end"
    v = f"case when {name} <> -1 and not isnan({name}) then {name} end"
    return f"select {group} as grp, '{name}' as metric, coalesce({_MEAN.format(u)} / 1000000, -1) as mean, coalesce(max({v}), -1) as max, coalesce(min({v}), -1) as min, count({v}) as n from ev group by 1"


_NAMES = ("score", "s1para_score", "s2_score", "s2ev_score")


@query(f"with {_EV} " + " union all ".join(_metric(g, n) for g in ("cast(hop as varchar)",) for n in _NAMES))
def a01_grouped_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Mean, extremes and count of every score per hop."""
    return ST.grouped_metrics(evidence(spark, path, "hop", *_NAMES), "hop", list(_NAMES))


@query(f"with {_EV} " + " union all ".join(_metric("'ALL'", n) for n in _NAMES))
def a01_grouped_metrics_all(spark: SparkSession, path: str) -> DataFrame:
    return ST.grouped_metrics(evidence(spark, path, *_NAMES), None, list(_NAMES))


@query("select l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) as mean from lineitem group by l_returnflag")
def a02_weighted_mean(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_quantity")) / F.sum("l_quantity"), 4).alias("mean"))


@query("select l_returnflag as ds, year(l_shipdate) as run, round(avg(l_discount), 8) as mean, count(*) as n from lineitem group by 1, 2")
def a04_mean_over_runs(spark: SparkSession, path: str) -> DataFrame:
    rows = table(spark, path, "lineitem").groupBy(F.col("l_returnflag").alias("ds"), F.year("l_shipdate").cast("bigint").alias("run"))
    return rows.agg(F.round(F.avg("l_discount"), 8).alias("mean"), F.count("*").alias("n"))


_STATUS = ("F", "O")


@query("select l_returnflag, " + ", ".join(f"round(avg(l_quantity) filter (l_linestatus = '{s}'), 6) as \"{s}\"" for s in _STATUS) + " from lineitem group by l_returnflag")
def a05_crosstab(spark: SparkSession, path: str) -> DataFrame:
    """Runs across, datasets down."""
    return table(spark, path, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", list(_STATUS)).agg(F.round(F.avg("l_quantity"), 6))


@query("select c_mktsegment as dataset, o_orderpriority as ans_type, round(avg(o_totalprice) * 100, 2) as score, count(*) as n from orders join customer on o_custkey = c_custkey group by all")
def a06_breakdown_by_type(spark: SparkSession, path: str) -> DataFrame:
    joined = table(spark, path, "orders").join(table(spark, path, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.col("c_mktsegment").alias("dataset"), F.col("o_orderpriority").alias("ans_type")).agg(F.round(F.avg("o_totalprice") * 100, 2).alias("score"), F.count("*").alias("n"))


@query(f"with {_EV} select query_uid, max(hop) as total_hops, arg_min(hop, (-s, hop)) as best_hop from (select query_uid, hop, max(s2ev_score) as s from ev where not isnan(s2ev_score) and s2ev_score is not null group by query_uid, hop) group by query_uid")
def w03_best_hop(spark: SparkSession, path: str) -> DataFrame:
    """Hop of the highest evidence score, the first of equal ones."""
    hops = table(spark, path, "evidence_sents").where("s2ev_score is not null and not isnan(s2ev_score)").groupBy("query_uid", "hop").agg(F.max("s2ev_score").alias("s"))
    return hops.groupBy("query_uid").agg(F.max("hop").alias("total_hops"), F.max(F.struct("s", (-F.col("hop")).alias("h"))).alias("b")).select("query_uid", "total_hops", (-F.col("b.h")).alias("best_hop"))


_SIM = r"""q as (select distinct sample_uid as uid, lower(trim(split)) = 'train' as t, coalesce(src, 'hotpotqa') as src, list_distinct(regexp_extract_all(lower(question), '[\p{L}\p{N}]+')) as w
  from mdr_samples where split is not null and question <> ''),
tok as (select uid, t, src, len(w) as n, unnest(w) as w from q),
hit as (select e.uid, e.src, e.n as en, x.uid as tuid, x.src as tsrc, x.n as tn, count(*) as same from tok e join tok x on not e.t and x.t and e.w = x.w group by all),
near as (select uid, src, arg_max(tsrc, (same / sqrt(en * tn), -tuid)) as tsrc, max(round(100 * same / sqrt(en * tn), 6)) as sim from hit group by uid, src)"""


def questions(spark: SparkSession, path: str) -> DataFrame:
    """(uid, t, src, words): the distinct hashed words of every question, t for training."""
    rows = table(spark, path, "mdr_samples").where("split is not null and question <> ''")
    words = F.array_distinct(F.regexp_extract_all(F.lower("question"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return rows.select(F.col("sample_uid").alias("uid"), (F.lower(F.trim("split")) == "train").alias("t"), F.coalesce("src", F.lit("hotpotqa")).alias("src"), hashed.alias("words")).distinct()


def nearest_train(spark: SparkSession, path: str) -> DataFrame:
    """(uid, src, tsrc, sim): the nearest training question of every evaluation question by cosine of distinct words, the least key of equals."""
    q = questions(spark, path)
    best = nearest_by_words(q.where("not t").where("size(words) > 0"), q.where("t").where("size(words) > 0"))
    held, train = q.where("not t").select("uid", "src"), q.where("t").select(F.col("uid").alias("nearest"), F.col("src").alias("tsrc"))
    return best.join(held, "uid").join(train, "nearest").select("uid", "src", "tsrc", F.round(100 * F.col("score"), 6).alias("sim"))


@query(f"""with {_SIM}, b as (select *, case when sim < 60 then 0.0 when sim < 90 then 60.0 else 90.0 end as bucket from near)
select src, tsrc, cast(bucket as double) as bucket, count(*) as n, round(avg(sim), 4) as mean, min(sim) as min, max(sim) as max, round(median(sim), 4) as median, round(stddev_pop(sim), 4) as std,
 round(100.0 * count(*) / sum(count(*)) over (partition by src, tsrc), 6) as percent from b group by src, tsrc, bucket""")
def a11_similarity_buckets(spark: SparkSession, path: str) -> DataFrame:
    """Contamination report: nearest training questions per source pair and similarity bucket; the percentage is of the pair's own rows."""
    near = nearest_train(spark, path).withColumn("bucket", ST.bucket(F.col("sim"), [0, 60, 90, 101]))
    stats = near.groupBy("src", "tsrc", "bucket").agg(
        F.count("*").alias("n"), F.round(F.avg("sim"), 4).alias("mean"), F.min("sim").alias("min"), F.max("sim").alias("max"),
        F.round(F.percentile("sim", F.lit(0.5)), 4).alias("median"), F.round(F.stddev_pop("sim"), 4).alias("std"),
    )
    return stats.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("src", "tsrc")), 6))


@query(f"with {_SIM} select uid, tsrc, sim from near")
def a08_nearest_train(spark: SparkSession, path: str) -> DataFrame:
    return nearest_train(spark, path).select("uid", "tsrc", "sim")


@query(f"with {_SIM} select src, case when sim < 60 then 'no_overlap' else tsrc end as tsrc, count(*) as n, round(count(*) * 100.0 / sum(count(*)) over (partition by src), 6) as percent from near group by 1, 2")
def a09_similarity_summary(spark: SparkSession, path: str) -> DataFrame:
    """Nearest source per evaluation source, rows under the threshold as no_overlap; the percentage is of all rows of the source."""
    named = nearest_train(spark, path).withColumn("tsrc", F.when(F.col("sim") < 60, "no_overlap").otherwise(F.col("tsrc")))
    counts = named.groupBy("src", "tsrc").agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("src")), 6))


@query("select o_orderpriority as sys, count(*) as n, round(avg(o_totalprice) filter (o_orderstatus = 'F'), 2) as moved, round(avg(o_totalprice) filter (o_orderstatus <> 'F'), 2) as stayed from orders group by 1")
def a14_stayed_and_moved(spark: SparkSession, path: str) -> DataFrame:
    moved = F.col("o_orderstatus") == "F"
    mean = lambda c: F.round(F.avg(F.when(c, F.col("o_totalprice"))), 2)
    return table(spark, path, "orders").groupBy(F.col("o_orderpriority").alias("sys")).agg(F.count("*").alias("n"), mean(moved).alias("moved"), mean(~moved).alias("stayed"))


@query("with m as (select l_returnflag as ds, year(l_shipdate) as run, avg(l_tax) as m from lineitem group by 1, 2) select ds, round(avg(m), 8) as mean, round(stddev_pop(m), 8) as std, count(*) as runs from m group by ds")
def a16_mean_std_over_runs(spark: SparkSession, path: str) -> DataFrame:
    means = table(spark, path, "lineitem").groupBy(F.col("l_returnflag").alias("ds"), F.year("l_shipdate").alias("run")).agg(F.avg("l_tax").alias("m"))
    return means.groupBy("ds").agg(F.round(F.avg("m"), 8).alias("mean"), F.round(F.stddev_pop("m"), 8).alias("std"), F.count("*").alias("runs"))


@query(r"""with r as (select distinct rr_uid, answers[1] as a, coalesce(src, 'none') as src from rr_samples where answers[1] is not null)
select src, regexp_full_match(replace(a, ',', ''), '-?[0-9]+(\.[0-9]+)?') as numeric, count(*) as n, count(distinct a) as answers from r group by cube (src, numeric) having src is not null and numeric is not null
union all select 'TOTAL', null, count(*), count(distinct a) from r""")
def a18_answer_kinds(spark: SparkSession, path: str) -> DataFrame:
    """Numeric and other answers per source, and a total."""
    a = F.get("answers", F.lit(0))
    rows = table(spark, path, "rr_samples").where(a.isNotNull()).select("rr_uid", a.alias("a"), F.coalesce("src", F.lit("none")).alias("src")).distinct()
    rows = rows.withColumn("numeric", F.replace("a", F.lit(",")).rlike(r"^-?[0-9]+(\.[0-9]+)?$"))
    stats = (F.count("*").alias("n"), F.countDistinct("a").alias("answers"))
    total = rows.agg(*stats).select(F.lit("TOTAL").alias("src"), F.lit(None).cast("boolean").alias("numeric"), "n", "answers")
    return rows.groupBy("src", "numeric").agg(*stats).unionByName(total)


@query("select coalesce(c_mktsegment, 'TOTAL') as ds, coalesce(o_orderstatus, 'ALL') as opt, count(*) as n from orders join customer on o_custkey = c_custkey group by rollup (c_mktsegment, o_orderstatus)")
def a20_distribution_with_totals(spark: SparkSession, path: str) -> DataFrame:
    joined = table(spark, path, "orders").join(table(spark, path, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    counts = joined.rollup("c_mktsegment", "o_orderstatus").agg(F.count("*").alias("n"))
    return counts.select(F.coalesce("c_mktsegment", F.lit("TOTAL")).alias("ds"), F.coalesce("o_orderstatus", F.lit("ALL")).alias("opt"), "n")


@query("select doc_kind, coalesce(lang, 'none') as lang, count(*) as n from documents group by 1, 2")
def a21_count_by_type(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, "documents").groupBy("doc_kind", F.coalesce("lang", F.lit("none")).alias("lang")).agg(F.count("*").alias("n"))


@query(f"""with a as (select distinct sample_uid, lower(trim(split)) = 'train' as t, unnest(answers) as a from mdr_samples where split is not null), k as (select distinct sample_uid, t, {S.SQUAD.format("a")} as k from a where a is not null),
e as (select sample_uid, bool_or(k in (select k from k where t and k <> '')) as seen from k where not t and k <> '' group by sample_uid) select count(*) as records, count(*) filter (seen) as memorised from e""")
def a22_memorised_answers(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation records, and those with an answer that occurs in training."""
    from tessel.functions.metrics import squad

    rows = table(spark, path, "mdr_samples").where("split is not null").select("sample_uid", (F.lower(F.trim("split")) == "train").alias("t"), F.explode("answers").alias("a")).where("a is not null")
    keys = rows.select("sample_uid", "t", squad(F.col("a")).alias("k")).where("k <> ''").distinct()
    seen = keys.where("t").select("k", F.lit(True).alias("seen")).distinct()
    per = keys.where("not t").join(seen, "k", "left").groupBy("sample_uid").agg(F.bool_or(F.coalesce("seen", F.lit(False))).alias("seen"))
    return per.agg(F.count("*").alias("records"), F.sum(F.col("seen").cast("bigint")).alias("memorised"))


@query("""with r as (select distinct on (sample_uid) coalesce(src, 'hotpotqa') as src, coalesce(len(pos_paras), 0) as p, coalesce(len(neg_paras), 0) as n from mdr_samples order by sample_uid, loaded_at desc)
select coalesce(src, 'TOTAL') as src, count(*) as records, cast(sum(p) as bigint) as positives, cast(sum(n) as bigint) as negatives, bool_or(n > 0) as any_negative from r group by rollup (src)""")
def a23_source_counts(spark: SparkSession, path: str) -> DataFrame:
    """Records and nested paragraphs per source with a total."""
    rows = latest(table(spark, path, "mdr_samples"), "sample_uid", "src", "pos_paras", "neg_paras")
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0))
    rows = rows.select(F.coalesce("src", F.lit("hotpotqa")).alias("src"), size("pos_paras").alias("p"), size("neg_paras").alias("n"))
    stats = rows.rollup("src").agg(F.count("*").alias("records"), F.sum("p").alias("positives"), F.sum("n").alias("negatives"), F.bool_or(F.col("n") > 0).alias("any_negative"))
    return stats.withColumn("src", F.coalesce("src", F.lit("TOTAL")))


@query("""with r as (select distinct on (rr_uid) coalesce(src, 'none') as src, len(answers) as a, length(context) as c, question from rr_samples order by rr_uid, loaded_at desc)
select src, count(*) as n, round(avg(a), 6) as mean_answers, round(avg(c), 6) as mean_context, count(distinct question) as questions from r group by src""")
def a25_source_stats(spark: SparkSession, path: str) -> DataFrame:
    rows = latest(table(spark, path, "rr_samples"), "rr_uid", "src", "answers", "context", "question")
    answers = F.when(F.col("answers").isNotNull(), F.size("answers"))
    return rows.groupBy(F.coalesce("src", F.lit("none")).alias("src")).agg(
        F.count("*").alias("n"), F.round(F.avg(answers), 6).alias("mean_answers"), F.round(F.avg(F.length("context")), 6).alias("mean_context"), F.countDistinct("question").alias("questions"),
    )


@query("with a as (select distinct sample_uid, unnest(answers) as a from mdr_samples), c as (select a, count(*) as n from a where a is not null group by a) select a as answer, n from c order by n desc, a limit 20")
def a26_most_common_answers(spark: SparkSession, path: str) -> DataFrame:
    rows = table(spark, path, "mdr_samples").select("sample_uid", F.explode("answers").alias("answer")).where("answer is not null").distinct()
    return rows.groupBy("answer").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "answer").limit(20)


@query(None)
def a28_paired_bootstrap(spark: SparkSession, path: str) -> DataFrame:
    """Whether the second-stage score (a) beats the first-stage score (b): 10,000 resamples of half the rows."""
    rows = evidence(spark, path, "score", "s2_score").where("s2_score <> -1 and not isnan(s2_score) and score is not null")
    return ST.paired_bootstrap(rows, "sent_uid", "s2_score", "score")


_T = [i / 10 for i in range(1, 10)]


@query(f"""with {_EV}, r as (select s2_score as s, s1para_score > 0.5 as l from ev where s2_score is not null and not isnan(s2_score) and s1para_score is not null), t as (select unnest({_T}) as threshold)
select cast(threshold as double) as threshold, count(*) as n, count(*) filter ((s >= threshold) = l) as right, count(*) filter (s >= threshold and l) as tp, count(*) filter (s >= threshold and not l) as fp, count(*) filter (s < threshold and l) as fn from r, t group by threshold""")
def a31_threshold_sweep(spark: SparkSession, path: str) -> DataFrame:
    rows = evidence(spark, path, "s2_score", "s1para_score").where("s1para_score is not null").withColumn("label", F.col("s1para_score") > 0.5)
    return ST.threshold_sweep(rows, "s2_score", "label", _T)


@query(f"with {_EV} select query_uid, arg_min(sent_uid, (-s2_score, sent_uid)) as sent_uid from ev where s2_score is not null and not isnan(s2_score) group by query_uid")
def a34_argmax_option(spark: SparkSession, path: str) -> DataFrame:
    """Best option per question, the first of equal ones."""
    rows = table(spark, path, "evidence_sents").where("s2_score is not null and not isnan(s2_score)")
    return rows.groupBy("query_uid").agg(F.max(F.struct("s2_score", (-F.col("sent_uid")).alias("u"))).alias("b")).select("query_uid", (-F.col("b.u")).alias("sent_uid"))


@query("select event_type, cast(date_trunc('day', ts) as date) as step, round(avg(value), 6) as v from events group by 1, 2")
def a35_series(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, "events").groupBy("event_type", F.to_date("ts").alias("step")).agg(F.round(F.avg("value"), 6).alias("v"))


@query("""with r as (select distinct on (rr_uid) rr_uid, lower(context) as c, answers from rr_samples where context is not null and answers[1] <> '' order by rr_uid, loaded_at desc)
select contains(c, lower(answers[1])) as has_answer, count(*) as n, round(avg(length(c)), 6) as mean, max(length(c)) as max, min(length(c)) as min from r group by 1""")
def a38_by_answer_in_context(spark: SparkSession, path: str) -> DataFrame:
    rows = latest(table(spark, path, "rr_samples").where("context is not null").where(F.get("answers", F.lit(0)) != ""), "rr_uid", "context", "answers")
    c = F.lower("context")
    n = F.length("context").cast("bigint")
    return rows.groupBy(F.contains(c, F.lower(F.get("answers", F.lit(0)))).alias("has_answer")).agg(F.count("*").alias("n"), F.round(F.avg(n), 6).alias("mean"), F.max(n).alias("max"), F.min(n).alias("min"))


_BLEND = "0.5 * s1para_score + 0.5 * score"


@query(f"with {_EV} select query_uid, hop, sent_uid, cast(rn as integer) as rank from (select *, row_number() over (partition by query_uid, hop order by {_BLEND} desc, sent_uid) as rn from ev where s1para_score is not null and score is not null) where rn <= 9")
def w01_stage_one_select(spark: SparkSession, path: str) -> DataFrame:
    """The nine best sentences per query and hop by the blend of paragraph and sentence score."""
    rows = evidence(spark, path, "query_uid", "hop", "s1para_score", "score").where("s1para_score is not null and score is not null")
    w = Window.partitionBy("query_uid", "hop").orderBy(F.expr(_BLEND).desc(), "sent_uid")
    return rows.withColumn("rank", F.row_number().over(w)).where("rank <= 9").select("query_uid", "hop", "sent_uid", "rank")


@query(f"""with {_EV}, r as (select *, row_number() over (partition by query_uid, hop order by s2_score desc, sent_uid) as rn from ev where s2_score is not null and not isnan(s2_score)),
t as (select query_uid, hop, case when count(*) > 2 then least(0.1, max(s2_score) filter (rn = 2) - 1e-10) else -1e9 end as least from r group by query_uid, hop)
select query_uid, hop, sent_uid, cast(rn as integer) as rank from r join t using (query_uid, hop) where s2_score > least and rn <= 5""")
def w02_stage_two_select(spark: SparkSession, path: str) -> DataFrame:
    """At least two sentences, then those above the threshold, five at most; ranking is limited before the shuffle."""
    rows = evidence(spark, path, "query_uid", "hop", "s2_score").where("s2_score is not null and not isnan(s2_score)")
    by = Window.partitionBy("query_uid", "hop").orderBy(F.col("s2_score").desc(), "sent_uid")
    top = rows.withColumn("rank", F.row_number().over(by)).where("rank <= 5")
    every = Window.partitionBy("query_uid", "hop")
    least = F.when(F.count("*").over(every) > 2, F.least(F.lit(0.1), F.max(F.when(F.col("rank") == 2, F.col("s2_score"))).over(every) - 1e-10)).otherwise(-1e9)
    return top.withColumn("least", least).where("s2_score > least").select("query_uid", "hop", "sent_uid", "rank")


_CONTEXT = f"""p as (select distinct on (idx) idx, title, text, sentence_spans from index_paras where text is not null and sentence_spans is not null order by idx, loaded_at desc),
best as (select query_uid, idx, s_idx, min(sent_uid) as sent_uid from ev where hop = 0 and s2_score > 0.3 and not isnan(s2_score) group by query_uid, idx, s_idx),
wide as (select query_uid, idx, unnest([s_idx - 1, s_idx, case when s_idx + 1 < len(sentence_spans) - 1 then s_idx + 1 else s_idx end]) as s, min(sent_uid) over (partition by query_uid, idx) as first from best join p using (idx)),
sents as (select distinct query_uid, idx, s, first from wide where s >= 0),
summ as (select query_uid, idx, first, {S.unescape(S.strip("title"))} || ': ' || string_agg({S.strip("substr(text, sentence_spans[s + 1][1] + 1, sentence_spans[s + 1][2] - sentence_spans[s + 1][1])")}, ' ' order by s) as summary
  from sents join p using (idx) where s < len(sentence_spans) and title is not null group by query_uid, idx, first, title),
cost as (select *, sum(len(string_split(summary, ' ')) + 2) over (partition by query_uid order by first, idx) as total from summ)"""


@query(f"with {_EV}, {_CONTEXT} select query_uid, cast(count(*) as integer) as paras, string_agg(summary, ' ' order by first, idx) as context from cost where total < 200 group by query_uid")
def w04_build_context(spark: SparkSession, path: str) -> DataFrame:
    """Selected sentences with their neighbours, in paragraph order, paragraphs in order of selection, within a budget of words.

    The next sentence is added only if it is not the paragraph's last. Costs are positive, so the running sum below the budget is the greedy choice.
    """
    best = table(spark, path, "evidence_sents").where("hop = 0 and s2_score > 0.3 and not isnan(s2_score)").groupBy("query_uid", "idx", "s_idx").agg(F.min("sent_uid").alias("sent_uid"))
    p = latest(table(spark, path, "index_paras").where("text is not null and sentence_spans is not null"), "idx", "title", "text", "sentence_spans").where("title is not null")
    n = F.size("sentence_spans")
    after = F.when(F.col("s_idx") + 1 < n - 1, F.col("s_idx") + 1).otherwise(F.col("s_idx"))
    joined = best.join(p, "idx").withColumn("around", F.array(F.col("s_idx") - 1, F.col("s_idx"), after))
    inside = F.filter(F.array_sort(F.array_distinct(F.flatten(F.collect_list("around")))), lambda s: s >= 0)
    paras = joined.groupBy("query_uid", "idx").agg(F.min("sent_uid").alias("first"), inside.alias("s"), *[F.first(c).alias(c) for c in ("title", "text", "sentence_spans")])
    paras = paras.withColumn("s", F.filter("s", lambda s: s < n)).where("size(s) > 0")

    def sentence(s):
        span = F.get("sentence_spans", s)
        return T.strip(F.substring(F.col("text"), F.get(span, F.lit(0)) + 1, F.get(span, F.lit(1)) - F.get(span, F.lit(0))))

    summary = F.concat(T.unescape(T.strip("title")), F.lit(": "), F.array_join(F.transform("s", sentence), " "))
    costs = paras.select("query_uid", "idx", "first", summary.alias("summary")).withColumn("cost", F.size(F.split("summary", " ")) + 2)
    total = F.sum("cost").over(Window.partitionBy("query_uid").orderBy("first", "idx"))
    kept = costs.withColumn("total", total).where("total < 200")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("first", "idx", "summary"))), lambda x: x["summary"])
    return kept.groupBy("query_uid").agg(F.count("*").cast("int").alias("paras"), F.array_join(parts, " ").alias("context"))


@query(f"with {_EV}, r as (select query_uid, sent_uid, s2_score > 0.5 as t, rank() over (partition by query_uid order by s1para_score desc) as rk from ev where s1para_score is not null and s2_score is not null) select query_uid, 1.0 / min(rk) as rr from r where t group by query_uid")
def w06_reciprocal_rank(spark: SparkSession, path: str) -> DataFrame:
    """Reciprocal rank of the best relevant sentence of every query."""
    rows = evidence(spark, path, "query_uid", "s1para_score", "s2_score").where("s1para_score is not null and s2_score is not null")
    ranked = rows.withColumn("rk", F.rank().over(Window.partitionBy("query_uid").orderBy(F.col("s1para_score").desc())))
    return ranked.where("s2_score > 0.5").groupBy("query_uid").agg((F.lit(1.0) / F.min("rk")).alias("rr"))


@query("with r as (select doc_id, source, row_number() over (partition by source order by doc_id) as rn, count(*) over (partition by source) as n from documents where source is not null) select doc_id from r where (rn - 1) % greatest(1, cast(round_even(n / 10.0, 0) as bigint)) = 0")
def w07_systematic_sample(spark: SparkSession, path: str) -> DataFrame:
    """Every k-th document of each source for about ten of each; k is rounded half to even."""
    docs = table(spark, path, "documents").where("source is not null").select("doc_id", "source")
    step = F.greatest(F.lit(1), F.rint(F.count("*").over(Window.partitionBy("source")) / 10.0).cast("bigint"))
    rows = docs.select("doc_id", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("rn"), step.alias("step"))
    return rows.where("(rn - 1) % step = 0").select("doc_id")


@query(f"with {_SIM}, b as (select *, row_number() over (partition by src, tsrc, case when sim < 60 then 0 when sim < 90 then 60 else 90 end order by sim desc, uid) as rn from near) select uid, src, tsrc, sim, cast(rn as integer) as rank from b where rn <= 3")
def w08_most_similar(spark: SparkSession, path: str) -> DataFrame:
    """Three most similar questions per source pair and bucket."""
    near = nearest_train(spark, path).withColumn("bucket", ST.bucket(F.col("sim"), [0, 60, 90, 101]))
    w = Window.partitionBy("src", "tsrc", "bucket").orderBy(F.col("sim").desc(), "uid")
    return near.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("uid", "src", "tsrc", "sim", "rank")


@query("""with d as (select doc_id, list_filter(string_split(text, chr(10)), lambda s: s <> '') as l from documents where text is not null), e as (select doc_id, unnest(l) as s, generate_subscripts(l, 1) as i from d)
select doc_id, cast(i - 1 as integer) as pos, coalesce(sum(length(s)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as s, sum(length(s)) over (partition by doc_id order by i) as e from e""")
def w10_sentence_spans(spark: SparkSession, path: str) -> DataFrame:
    """Running offsets of the non-empty lines, folded within the row: no shuffle."""
    lines = F.filter(F.split("text", "\n"), lambda s: s != "")
    fold = F.aggregate(
        lines, F.array(F.lit(0)), lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(s)))
    )
    rows = table(spark, path, "documents").where("text is not null").select("doc_id", fold.alias("ends"))
    spans = T.let(F.col("ends"), lambda e: F.transform(F.slice(e, 2, 1 << 30), lambda x, i: F.struct(F.get(e, i).cast("bigint").alias("s"), x.cast("bigint").alias("e"))))
    return rows.select("doc_id", F.posexplode(spans).alias("pos", "x")).select("doc_id", "pos", "x.*")


@query("""with p as (select distinct on (idx) idx, text, sentence_spans from index_paras where text is not null order by idx, loaded_at desc), e as (select idx, text, unnest(sentence_spans) as sp, generate_subscripts(sentence_spans, 1) as i from p)
select idx, cast(i - 1 as integer) as pos, substr(text, sp[1] + 1, sp[2] - sp[1]) as sentence from e where sp[1] < sp[2]""")
def w11_sentences_by_span(spark: SparkSession, path: str) -> DataFrame:
    rows = latest(table(spark, path, "index_paras").where("text is not null"), "idx", "text", "sentence_spans")
    spans = rows.select("idx", "text", F.posexplode("sentence_spans").alias("pos", "sp")).where("sp[0] < sp[1]")
    return spans.select("idx", "pos", F.substring(F.col("text"), F.col("sp")[0] + 1, F.col("sp")[1] - F.col("sp")[0]).alias("sentence"))


@query("""with e as (select user_id, epoch_us(ts) // 1000000 as s, epoch_us(ts) // 1000000 + cast(floor(value * 1000) as bigint) as e from events), o as (select *, max(e) over (partition by user_id order by s, e rows between unbounded preceding and 1 preceding) as before from e),
g as (select *, sum(case when before is null or s > before then 1 else 0 end) over (partition by user_id order by s, e rows unbounded preceding) as grp from o) select user_id, min(s) as s, max(e) as e from g group by user_id, grp""")
def w12_merge_intervals(spark: SparkSession, path: str) -> DataFrame:
    """Overlapping or touching intervals of a user merged."""
    start = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    rows = table(spark, path, "events").select("user_id", start.alias("s"), (start + F.floor(F.col("value") * 1000)).alias("e"))
    w = Window.partitionBy("user_id").orderBy("s", "e")
    marked = rows.withColumn("before", F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    new = (F.col("before").isNull() | (F.col("s") > F.col("before"))).cast("int")
    return marked.withColumn("grp", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("user_id", "grp").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("grp")


@query(f"""with {_EV}, w as (select sent_uid, query_uid, hop, s2_score, len({S.words("sentence")}) as cost from ev where s2_score >= 0.2 and not isnan(s2_score) and hop is not null and sentence is not null),
r as (select *, row_number() over (partition by query_uid, hop order by s2_score desc, sent_uid) as round from w where cost > 0), t as (select query_uid, round, sum(cost) as cost from r group by all),
b as (select query_uid, round, coalesce(sum(cost) over (partition by query_uid order by round rows between unbounded preceding and 1 preceding), 0) as before from t)
select query_uid, hop, sent_uid, cast(round as integer) as round, cast(before as bigint) as before from r join b using (query_uid, round) where before < 350""")
def w15_round_robin(spark: SparkSession, path: str) -> DataFrame:
    """Sentences of a query taken from its hops in turn, the best of each first, round by round while the words of the rounds before are below a soft budget.

    A sentence has a word at least, so no round beyond the budget is looked at: the limit per hop is the budget itself and cuts a hot query before its shuffle.
    """
    budget = 350
    rows = evidence(spark, path, "query_uid", "hop", "s2_score", "sentence").where("s2_score >= 0.2 and not isnan(s2_score) and hop is not null and sentence is not null")
    rows = rows.select("query_uid", "hop", "sent_uid", "s2_score", F.size(T.words("sentence")).alias("cost")).where("cost > 0")
    rows = rows.withColumn("round", F.row_number().over(Window.partitionBy("query_uid", "hop").orderBy(F.col("s2_score").desc(), "sent_uid"))).where(F.col("round") <= budget)
    rounds = rows.groupBy("query_uid", "round").agg(F.sum("cost").alias("cost"))
    before = F.coalesce(F.sum("cost").over(Window.partitionBy("query_uid").orderBy("round").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = rounds.select("query_uid", "round", before.alias("before")).where(F.col("before") < budget)
    return rows.join(kept, ["query_uid", "round"]).select("query_uid", "hop", "sent_uid", "round", "before")


@query(f"""with {_EV}, h as (select query_uid, hop, max(s2ev_score) as s, max(score) as c from ev where not isnan(s2ev_score) group by query_uid, hop), l as (select *, lag(s) over (partition by query_uid order by hop) as before from h)
select query_uid, hop, array_to_string(list_filter([case when s >= 0.9 then 'evsuff' end, case when c >= 0.9 then 'aconf' end, case when hop + 1 >= 4 then 'max' end, case when before >= s then 'evlower' end], lambda x: x is not null), ',') as reasons from l""")
def i01_stop_reasons(spark: SparkSession, path: str) -> DataFrame:
    """Why the iteration stops after a hop: enough evidence, confidence, the last hop, or falling evidence."""
    hops = table(spark, path, "evidence_sents").where("s2ev_score is not null and not isnan(s2ev_score)").groupBy("query_uid", "hop").agg(F.max("s2ev_score").alias("s"), F.max("score").alias("c"))
    rows = hops.withColumn("before", F.lag("s").over(Window.partitionBy("query_uid").orderBy("hop")))
    reasons = F.concat_ws(",", F.when(F.col("s") >= 0.9, "evsuff"), F.when(F.col("c") >= 0.9, "aconf"), F.when(F.col("hop") + 1 >= 4, "max"), F.when(F.col("before") >= F.col("s"), "evlower"))
    return rows.select("query_uid", "hop", reasons.alias("reasons"))


@query("with a as (select l_returnflag as grp, l_linestatus as task, avg(l_discount) * 8 as acc from lineitem group by 1, 2) select grp, task, round((1 - acc) / sum(1 - acc) over (partition by grp), 6) as p from a")
def i03_error_sampling(spark: SparkSession, path: str) -> DataFrame:
    """Sampling probability of each task by its error within the group."""
    acc = table(spark, path, "lineitem").groupBy(F.col("l_returnflag").alias("grp"), F.col("l_linestatus").alias("task")).agg((F.avg("l_discount") * 8).alias("acc"))
    return acc.select("grp", "task", F.round((1 - F.col("acc")) / F.sum(1 - F.col("acc")).over(Window.partitionBy("grp")), 6).alias("p"))


@query("""with d as (select doc_id, string_split(lower(text), ' ') as w from documents where text is not null), e as (select doc_id, w, unnest(range(1, len(w))) as i from d) select doc_id, count(*) as n, cast(min(i - 1) as integer) as first from e where w[i] = 'is' and w[i + 1] = 'a' group by doc_id""")
def i14_find_sublist(spark: SparkSession, path: str) -> DataFrame:
    """Occurrences of a token pair in every passage."""
    tokens = F.split(F.lower("text"), " ")
    at = T.let(tokens, lambda w: F.filter(F.transform(w, lambda x, i: F.when((x == "is") & (F.get(w, i + 1) == "a"), i)), lambda i: i.isNotNull()))
    rows = table(spark, path, "documents").where("text is not null").select("doc_id", at.alias("at")).where("size(at) > 0")
    return rows.select("doc_id", F.size("at").cast("bigint").alias("n"), F.array_min("at").alias("first"))
