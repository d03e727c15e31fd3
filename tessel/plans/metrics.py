"""Answer and evidence metrics (M) over the driver tables: predictions are the first answers of other deliveries of a question or altered golds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.catalog import query
from tessel.functions import metrics as M
from tessel.functions import sql as S
from tessel.functions import text as T
from tessel.sources.tables import latest, table

#: Predictions: every third word of the gold is dropped.
_RR = "rr as (select distinct on (rr_uid) rr_uid, coalesce(src, 'hotpotqa') as src, answers, question from rr_samples where answers[1] <> '' order by rr_uid, loaded_at desc)"
_PRED = f"pred as (select *, array_to_string(list_filter(list_transform({S.words('answers[1]')}, lambda w, i: case when i % 3 <> 0 then w end), lambda w: w is not null), ' ') as p from rr)"


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """(rr_uid, src, answers, question, p)."""
    rows = latest(table(spark, path, "rr_samples").where(F.get("answers", F.lit(0)) != ""), "rr_uid", "src", "answers", "question")
    kept = F.filter(F.transform(T.words(F.get("answers", F.lit(0))), lambda w, i: F.when((i + 1) % 3 != 0, w)), lambda w: w.isNotNull())
    return rows.select("rr_uid", F.coalesce("src", F.lit("hotpotqa")).alias("src"), "answers", "question", F.array_join(kept, " ").alias("p"))


@query(f"with {_RR} select rr_uid, {S.SQUAD.format('answers[1]')} as value from rr")
def m01_normalise(spark: SparkSession, path: str) -> DataFrame:
    return predictions(spark, path).select("rr_uid", M.squad(F.get("answers", F.lit(0))).alias("value"))


_FLOAT = r"regexp_full_match(trim(t), '[+-]?(([0-9]+(_[0-9]+)*\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|nan|inf(inity)?)')"


def _drop_list(x: str) -> str:
    """The tokens of the number-aware normalisation of a text."""
    bare = rf"case when {_FLOAT} then t else regexp_replace(t, '[!-/:-@\[-`{{-~]', '', 'g') end"
    words = r"trim(regexp_replace(regexp_replace(t, '(^|[^\p{L}\p{N}_])(a|an|the)($|[^\p{L}\p{N}_])', '\1 \3', 'g'), '[\s\x{a0}]+', ' ', 'g'))"
    each = f"list_transform(list_transform(string_split_regex(lower({x}), '[ -]'), lambda t: {bare}), lambda t: string_split(case when {_FLOAT} then cast(cast(t as double) as varchar) else {words} end, ' '))"
    return f"list_filter(flatten({each}), lambda w: w <> '')"


def _drop(x: str) -> str:
    return f"array_to_string({_drop_list(x)}, ' ')"


@query(f"with {_RR} select rr_uid, {_drop('answers[1]')} as value from rr")
def m02_normalise_numbers(spark: SparkSession, path: str) -> DataFrame:
    """The number-aware normalisation."""
    return predictions(spark, path).select("rr_uid", F.array_join(M.drop_tokens(F.get("answers", F.lit(0))), " ").alias("value"))


_EM = f"list_bool_or(list_transform(list_filter(answers, lambda a: a is not null), lambda a: {S.SQUAD.format('a')} = {S.SQUAD.format('p')}))"


@query(f"with {_RR}, {_PRED} select rr_uid, cast({_EM} as integer) as em from pred")
def m18_exact_match(spark: SparkSession, path: str) -> DataFrame:
    """Equality after normalisation with any gold."""
    golds = F.filter("answers", lambda a: a.isNotNull())
    em = T.let(M.squad(F.col("p")), lambda v: F.exists(golds, lambda g: M.squad(g) == v)).cast("int")
    return predictions(spark, path).select("rr_uid", em.alias("em"))


@query(f"with {_RR}, {_PRED} select rr_uid, cast(list_bool_or(list_transform(list_filter(answers, lambda a: a is not null), lambda a: {_drop('a')} = {_drop('p')})) as integer) as em from pred")
def m03_exact_match_numbers(spark: SparkSession, path: str) -> DataFrame:
    golds = F.filter("answers", lambda a: a.isNotNull())
    return predictions(spark, path).select("rr_uid", M.exact(F.col("p"), golds).alias("em"))


_F1 = f"""tokp as (select rr_uid, unnest(string_split({S.SQUAD.format("p")}, ' ')) as w from pred), tokg as (select rr_uid, unnest(string_split({S.SQUAD.format("answers[1]")}, ' ')) as w from pred),
cp as (select rr_uid, w, count(*) as n from tokp where w <> '' group by all), cg as (select rr_uid, w, count(*) as n from tokg where w <> '' group by all),
np as (select rr_uid, sum(n) as n from cp group by all), ng as (select rr_uid, sum(n) as n from cg group by all), sm as (select rr_uid, sum(least(cp.n, cg.n)) as n from cp join cg using (rr_uid, w) group by all),
f1 as (select rr_uid, src, case when np.n is null or ng.n is null then cast((np.n is null) = (ng.n is null) as double) else 2.0 * coalesce(sm.n, 0) / (np.n + ng.n) end as f1, coalesce(sm.n, 0) * 1.0 / np.n as prec, coalesce(sm.n, 0) * 1.0 / ng.n as rec
 from pred left join np using (rr_uid) left join ng using (rr_uid) left join sm using (rr_uid))"""


def _tokens(x):
    return F.filter(F.split(M.squad(x), " "), lambda w: w != "")


@query(f"with {_RR}, {_PRED}, {_F1} select rr_uid, round(f1, 6) as f1 from f1")
def m06_token_f1(spark: SparkSession, path: str) -> DataFrame:
    """Multiset token F1 against the first gold."""
    f1 = M.token_f1(_tokens(F.col("p")), _tokens(F.get("answers", F.lit(0))))
    return predictions(spark, path).select("rr_uid", F.round(f1, 6).alias("f1"))


@query(None)
def m04_set_f1(spark: SparkSession, path: str) -> DataFrame:
    """Number-aware F1 of several predicted spans, the golds without every third word in reverse order, with the gold spans in their best alignment."""
    from tessel.functions import udf

    golds = F.filter("answers", lambda a: a.isNotNull())
    dropped = lambda a: F.array_join(F.filter(F.transform(T.words(a), lambda w, i: F.when((i + 1) % 3 != 0, w)), lambda w: w.isNotNull()), " ")
    spans = F.reverse(F.transform(golds, lambda a: M.drop_tokens(dropped(a))))
    return predictions(spark, path).select("rr_uid", udf.span_f1(spans, F.transform(golds, M.drop_tokens)).alias("f1"))


@query(f"with {_RR}, {_PRED}, {_F1} select src, count(*) as n, round(avg(round(f1, 6)) * 100, 3) as score from f1 group by src")
def m11_corpus_f1(spark: SparkSession, path: str) -> DataFrame:
    return m06_token_f1(spark, path).join(predictions(spark, path).select("rr_uid", "src"), "rr_uid").groupBy("src").agg(F.count("*").alias("n"), F.round(F.avg("f1") * 100, 3).alias("score"))


@query(f"with {_RR} select rr_uid, cast(list_contains(string_split({S.SQUAD.format('question')}, ' '), 'yes') and not list_contains(string_split({S.SQUAD.format('question')}, ' '), 'no') as integer) as yn, lower(answers[1]) as gold from rr where {S.SQUAD.format('answers[1]')} = 'yes'")
def m07_yes_no(spark: SparkSession, path: str) -> DataFrame:
    """The question's words as prediction of a yes."""
    rows = predictions(spark, path).where(M.squad(F.get("answers", F.lit(0))) == "yes").where("question is not null")
    yn = M.yes_no(F.split(M.squad(F.col("question")), " "), F.lit("yes"))
    return rows.select("rr_uid", yn.alias("yn"), F.lower(F.get("answers", F.lit(0))).alias("gold"))


def fact(title, number):
    return F.concat(title, F.lit("\x01"), number.cast("string"))


@query(r"""with q as (select distinct query_uid, unnest(list_transform(sp_facts, lambda f: f.title || chr(1) || f.sent_idx)) as f from iter_queries where sp_facts is not null), p as (select distinct query_uid, title || chr(1) || s_idx as f from evidence_sents where s2_score > 0.3 and not isnan(s2_score) and title is not null),
g as (select query_uid, count(*) as n from q group by 1), k as (select query_uid, count(*) as n from p group by 1), b as (select query_uid, count(*) as n from q join p using (query_uid, f) group by 1)
select query_uid, cast(coalesce(b.n, 0) = g.n and coalesce(k.n, 0) = g.n as integer) as em, round(case when k.n > 0 then coalesce(b.n, 0) / k.n else 0 end, 6) as precision, round(coalesce(b.n, 0) / g.n, 6) as recall from g left join k using (query_uid) left join b using (query_uid)""")
def m19_evidence_sets(spark: SparkSession, path: str) -> DataFrame:
    """Set scores of predicted evidence sentences against the gold facts; queries without prediction count."""
    gold = table(spark, path, "iter_queries").where("sp_facts is not null").select("query_uid", F.explode("sp_facts").alias("f")).select("query_uid", fact(F.col("f.title"), F.col("f.sent_idx")).alias("f")).distinct()
    pred = table(spark, path, "evidence_sents").where("s2_score > 0.3 and not isnan(s2_score) and title is not null").select("query_uid", fact(F.col("title"), F.col("s_idx")).alias("f")).distinct()
    both = gold.groupBy("query_uid").agg(F.collect_set("f").alias("g")).join(pred.groupBy("query_uid").agg(F.collect_set("f").alias("p")), "query_uid", "left")
    s = M.set_scores(F.coalesce("p", F.array().cast("array<string>")), F.col("g"))
    return both.select("query_uid", s.alias("s")).select("query_uid", "s.em", F.round("s.precision", 6).alias("precision"), F.round("s.recall", 6).alias("recall"))


@query(f"""with {_RR}, {_PRED}, {_F1}, m as (select ds_name, prefer from dataset_catalogue), e as (select rr_uid, cast({_EM} as double) as em from pred)
select f1.src as ds, prefer, round(avg(case when prefer = 'F1' then round(f1, 6) else em end) * 100, 3) as score, count(*) as n from f1 join e using (rr_uid) join m on m.ds_name = f1.src group by all""")
def m23_preferred_metric(spark: SparkSession, path: str) -> DataFrame:
    """Every dataset by its preferred metric: F1 where the catalogue says so, else exact match; the catalogue is a fixed small table."""
    scored = m06_token_f1(spark, path).join(m18_exact_match(spark, path), "rr_uid").join(predictions(spark, path).select("rr_uid", "src"), "rr_uid")
    catalogue = F.broadcast(table(spark, path, "dataset_catalogue").select(F.col("ds_name").alias("src"), "prefer"))
    score = F.when(F.col("prefer") == "F1", F.col("f1")).otherwise(F.col("em").cast("double"))
    return scored.join(catalogue, "src").groupBy(F.col("src").alias("ds"), "prefer").agg(F.round(F.avg(score) * 100, 3).alias("score"), F.count("*").alias("n"))


@query("select ds_name, coalesce(prefer, case ds_type when 'EX' then 'EM' when 'YN' then 'YN' else 'SS' end) as metric from dataset_catalogue")
def m24_dataset_metric(spark: SparkSession, path: str) -> DataFrame:
    default = F.when(F.col("ds_type") == "EX", "EM").when(F.col("ds_type") == "YN", "YN").otherwise("SS")
    return table(spark, path, "dataset_catalogue").select("ds_name", F.coalesce("prefer", default).alias("metric"))


_BLEU = f"""g1 as (select rr_uid, 'p' as side, unnest(string_split({S.squeeze("p")}, ' ')) as g, 1 as n from pred union all select rr_uid, 'g', unnest(string_split({S.squeeze("answers[1]")}, ' ')), 1 from pred),
g2 as (select rr_uid, 'p' as side, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as g, 2 as n from (select rr_uid, string_split({S.squeeze("p")}, ' ') as w from pred)
 union all select rr_uid, 'g', unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), 2 from (select rr_uid, string_split({S.squeeze("answers[1]")}, ' ') as w from pred)),
c as (select rr_uid, n, g, count(*) filter (side = 'p') as p, count(*) filter (side = 'g') as r from (select * from g1 union all select * from g2) where g <> '' group by all),
t as (select n, sum(least(p, r)) as hit, sum(p) as p, sum(r) as r from c group by n)"""


@query(f"with {_RR}, {_PRED}, {_BLEU} select round(exp(least(0, 1 - sum(r) filter (n = 1) / sum(p) filter (n = 1))) * exp(avg(ln(hit / p))) * 100, 6) as bleu from t")
def m13_corpus_bleu(spark: SparkSession, path: str) -> DataFrame:
    """Corpus BLEU-2 of the predictions: clipped n-gram counts, geometric mean, brevity penalty."""
    rows = predictions(spark, path).select("rr_uid", F.explode(F.array(F.struct(F.lit("p").alias("side"), T.words("p").alias("w")), F.struct(F.lit("g").alias("side"), T.words(F.get("answers", F.lit(0))).alias("w")))).alias("x")).select("rr_uid", "x.*")
    grams = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.slice("w", i, n), " ").alias("g"))))
    each = rows.select("rr_uid", "side", F.explode(F.concat(F.coalesce(grams(1), F.array().cast("array<struct<n:int,g:string>>")), F.coalesce(grams(2), F.array().cast("array<struct<n:int,g:string>>")))).alias("x")).select("rr_uid", "side", "x.*")
    side = lambda s: F.sum((F.col("side") == s).cast("bigint"))
    counts = each.groupBy("rr_uid", "n", "g").agg(side("p").alias("p"), side("g").alias("r"))
    t = counts.groupBy("n").agg(F.sum(F.least("p", "r")).alias("hit"), F.sum("p").alias("p"), F.sum("r").alias("r"))
    one = lambda c: F.sum(F.when(F.col("n") == 1, F.col(c)))
    return t.agg(F.round(F.exp(F.least(F.lit(0.0), 1 - one("r") / one("p"))) * F.exp(F.avg(F.log(F.col("hit") / F.col("p")))) * 100, 6).alias("bleu"))


def _sari(n: int) -> str:
    grams = lambda w: f"list_distinct(list_transform(range(1, len({w}) - {n - 2}), lambda i: array_to_string({w}[i:i + {n - 1}], ' ')))"
    return f"""select rr_uid, {grams("s")} as s, {grams("p")} as p, {grams("g")} as g from words"""


_BOTH, _LESS = "len(list_intersect({0}, {1}))", "list_filter({0}, lambda x: not list_contains({1}, x))"
_RATE = "case when len({1}) > 0 then len({0}) * 1.0 / len({1}) else 0.0 end"
_SARI = f"""words as (select rr_uid, src, {S.words("replace(question, '?', ' ?')")} as s, {S.words("p")} as p, {S.words("answers[1]")} as g from pred where question is not null),
grams as ({" union all ".join(_sari(n) for n in range(1, 5))}),
sets as (select rr_uid, g, list_intersect(s, p) as kept, list_intersect(s, g) as gold_kept, {_LESS.format("p", "s")} as added, {_LESS.format("g", "s")} as gold_added, {_LESS.format("s", "p")} as dropped from grams),
rates as (select rr_uid, {_RATE.format("list_intersect(kept, g)", "kept")} as kp, {_RATE.format("list_intersect(kept, g)", "gold_kept")} as kr, {_RATE.format("list_intersect(added, g)", "added")} as ap, {_RATE.format("list_intersect(added, g)", "gold_added")} as ar,
 {_RATE.format(_LESS.format("dropped", "g"), "dropped")} as dp from sets),
sari as (select rr_uid, round(sum((case when kp + kr > 0 then 2 * kp * kr / (kp + kr) else 0 end + case when ap + ar > 0 then 2 * ap * ar / (ap + ar) else 0 end + dp) / 12), 6) as sari from rates group by rr_uid)"""


@query(f"with {_RR}, {_PRED}, {_SARI} select * from sari")
def m15_sari(spark: SparkSession, path: str) -> DataFrame:
    """SARI of the predictions: keep, add and delete over sets of 1- to 4-grams."""
    def grams(w, n):
        return F.array_distinct(F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>")))

    def ratio(a, b):
        return F.when(F.size(b) > 0, F.size(a) / F.size(b)).otherwise(0.0)

    def f1(p, r):
        return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)

    rows = predictions(spark, path).where("question is not null").select("rr_uid", T.words(F.replace("question", F.lit("?"), F.lit(" ?"))).alias("s"), T.words("p").alias("p"), T.words(F.get("answers", F.lit(0))).alias("g"))
    total = F.lit(0.0)
    for n in range(1, 5):
        rows = rows.select("rr_uid", "s", "p", "g", *[c for c in rows.columns if c[0] in "SPG"], grams(F.col("s"), n).alias(f"S{n}"), grams(F.col("p"), n).alias(f"P{n}"), grams(F.col("g"), n).alias(f"G{n}"))
        s, p, g = F.col(f"S{n}"), F.col(f"P{n}"), F.col(f"G{n}")
        kept, gold_kept = F.array_intersect(s, p), F.array_intersect(s, g)
        keep = f1(ratio(F.array_intersect(kept, g), kept), ratio(F.array_intersect(kept, g), gold_kept))
        added, gold_added = F.array_except(p, s), F.array_except(g, s)
        add = f1(ratio(F.array_intersect(added, g), added), ratio(F.array_intersect(added, g), gold_added))
        dropped = F.array_except(s, p)
        total = total + (keep + add + ratio(F.array_except(dropped, g), dropped)) / 12
    return rows.select("rr_uid", F.round(total, 6).alias("sari"))


@query(None)
def m12_rouge_l(spark: SparkSession, path: str) -> DataFrame:
    """ROUGE-L F of the predictions by the longest common subsequence of words."""
    from tessel.functions.udf import common_subsequence

    rows = predictions(spark, path).select("rr_uid", T.words(F.lower("p")).alias("p"), T.words(F.lower(F.get("answers", F.lit(0)))).alias("g"))
    rows = rows.withColumn("n", common_subsequence("p", "g"))
    return rows.select("rr_uid", F.when(F.size("p") + F.size("g") > 0, F.round(2.0 * F.col("n") / (F.size("p") + F.size("g")), 6)).otherwise(0.0).alias("rouge_l"))


@query("""with ev as (select distinct sent_uid, query_uid, hop, idx, s_idx, title, score, s1para_score as a, s2_score as b, s2ev_score as e from evidence_sents where title is not null),
g as (select distinct query_uid, list_distinct(list_filter(sp, lambda t: t is not null)) as sp, list_distinct(list_transform(sp_facts, lambda f: f.title || chr(1) || f.sent_idx)) as facts from iter_queries where len(sp) > 0),
h as (select query_uid, hop, max(e) as e from ev where not isnan(e) and e is not null group by all), best as (select query_uid, arg_min(hop, (-e, hop)) as hop from h group by query_uid), r as (select unnest(range(0, 11)) / 10.0 as r),
s as (select query_uid, r, title, s_idx, max(r * a + (1 - r) * b) as v from ev join best using (query_uid, hop), r where a is not null and b is not null and not isnan(b) and b <> -1 group by all),
f as (select query_uid, r, title || chr(1) || s_idx as f, row_number() over (partition by query_uid, r order by v desc, title, s_idx) as rn from s),
t as (select query_uid, r, title, row_number() over (partition by query_uid, r order by v desc, title) as rn from (select query_uid, r, title, max(v) as v from s group by all)),
d as (select query_uid, r, title, row_number() over (partition by query_uid, r order by v desc, title) as rn from (select query_uid, r, title, max(v) as v from (select query_uid, r, hop, idx, title, r * max(a) + (1 - r) * max(score) as v from ev, r where a is not null and score is not null group by query_uid, r, hop, idx, title) group by all)),
ff as (select query_uid, r, count(*) as n from g join f using (query_uid) where list_contains(facts, f) and rn <= len(facts) group by all), tt as (select query_uid, r, count(*) as n from g join t using (query_uid) where list_contains(sp, title) and rn <= len(sp) group by all),
dd as (select query_uid, r, count(*) filter (rn <= 4) as n4, count(*) filter (rn <= 20) as n20, count(*) filter (rn <= len(sp)) as nh from g join d using (query_uid) where list_contains(sp, title) group by all)
select cast(r as double) as ratio, round(avg(case when len(facts) > 0 then cast(coalesce(ff.n, 0) = len(facts) as integer) end), 6) as facts_em, round(avg(cast(coalesce(tt.n, 0) = len(sp) as integer)), 6) as sp_em, round(avg(cast(coalesce(n4, 0) = len(sp) as integer)), 6) as r4,
 round(avg(cast(coalesce(n20, 0) = len(sp) as integer)), 6) as r20, round(avg(cast(coalesce(nh, 0) = len(sp) as integer)), 6) as r_hops, count(*) as queries from g cross join r left join ff using (query_uid, r) left join tt using (query_uid, r) left join dd using (query_uid, r) group by r""")
def m21_blend_sweep(spark: SparkSession, path: str) -> DataFrame:
    """For every blend of paragraph and sentence score: the share of queries whose gold sentences, and gold titles, are exactly the first of the best hop, and whose gold titles are all
    among the first 4, 20 and as many as there are of the paragraphs retrieved over all hops. Blends are made after the rows are reduced to their sentences and paragraphs."""
    ev = table(spark, path, "evidence_sents").where("title is not null").select("query_uid", "hop", "idx", "s_idx", "title", "score", F.col("s1para_score").alias("a"), F.col("s2_score").alias("b"), F.col("s2ev_score").alias("e"))
    facts = F.array_distinct(F.transform("sp_facts", lambda f: fact(f["title"], f["sent_idx"])))
    gold = table(spark, path, "iter_queries").where("size(sp) > 0").select("query_uid", F.array_distinct(F.filter("sp", lambda t: t.isNotNull())).alias("sp"), facts.alias("facts")).distinct()
    hops = ev.where("e is not null and not isnan(e)").groupBy("query_uid", "hop").agg(F.max("e").alias("e"))
    best = hops.groupBy("query_uid").agg(F.max(F.struct("e", (-F.col("hop")).alias("h"))).alias("m")).select("query_uid", (-F.col("m.h")).alias("hop"))
    ratios = F.explode(F.array(*[F.lit(i / 10) for i in range(11)])).alias("r")
    blend = lambda x, y: F.col("r") * F.col(x) + (1 - F.col("r")) * F.col(y)
    rank = lambda *by: F.row_number().over(Window.partitionBy("query_uid", "r").orderBy(F.col("v").desc(), *by))
    rows = ev.join(best, ["query_uid", "hop"]).where("a is not null and b is not null and not isnan(b) and b <> -1").select("query_uid", "title", "s_idx", "a", "b").distinct()
    sents = rows.select("*", ratios).groupBy("query_uid", "r", "title", "s_idx").agg(F.max(blend("a", "b")).alias("v"))
    sizes = gold.select("query_uid", "sp", "facts")
    firsts = sents.withColumn("rn", rank("title", "s_idx")).join(sizes, "query_uid").where((F.col("rn") <= F.size("facts")) & F.array_contains("facts", fact(F.col("title"), F.col("s_idx"))))
    of = lambda df, *counts: df.groupBy("query_uid", "r").agg(*counts)
    found_facts = of(firsts, F.count("*").alias("nf"))
    titles = sents.groupBy("query_uid", "r", "title").agg(F.max("v").alias("v")).withColumn("rn", rank("title")).join(sizes, "query_uid").where((F.col("rn") <= F.size("sp")) & F.array_contains("sp", F.col("title")))
    found_titles = of(titles, F.count("*").alias("nt"))
    paras = ev.where("a is not null and score is not null").groupBy("query_uid", "hop", "idx", "title").agg(F.max("a").alias("a"), F.max("score").alias("score")).select("*", ratios)
    dense = paras.groupBy("query_uid", "r", "title").agg(F.max(blend("a", "score")).alias("v")).withColumn("rn", rank("title")).join(sizes, "query_uid").where(F.array_contains("sp", F.col("title")))
    upto = lambda c, name: F.sum((F.col("rn") <= c).cast("int")).alias(name)
    found_dense = of(dense, upto(4, "n4"), upto(20, "n20"), upto(F.size("sp"), "nh"))
    every = gold.select("query_uid", F.size("sp").alias("k"), F.when(F.size("facts") > 0, F.size("facts")).alias("kf"), ratios)
    joined = every.join(found_facts, ["query_uid", "r"], "left").join(found_titles, ["query_uid", "r"], "left").join(found_dense, ["query_uid", "r"], "left")
    share = lambda n, k: F.round(F.avg((F.coalesce(F.col(n), F.lit(0)) == F.col(k)).cast("int")), 6)
    return joined.groupBy(F.col("r").alias("ratio")).agg(
        share("nf", "kf").alias("facts_em"), share("nt", "k").alias("sp_em"), share("n4", "k").alias("r4"), share("n20", "k").alias("r20"), share("nh", "k").alias("r_hops"), F.count("*").alias("queries"),
    )


@query(r"""with q as (select distinct query_uid, sample_type, list_distinct(sp) as sp from iter_queries where len(sp) > 0), r as (select distinct query_uid, title from evidence_sents where title is not null),
x as (select q.query_uid, sample_type, len(sp) as n, count(r.title) as hit from (select query_uid, sample_type, sp, unnest(sp) as t from q) q left join r on r.query_uid = q.query_uid and r.title = q.t group by all)
select sample_type, count(*) as n, count(*) filter (hit > 0) as any_found, count(*) filter (hit = n) as all_found from x group by sample_type""")
def m26_retrieval_recall(spark: SparkSession, path: str) -> DataFrame:
    """Queries whose gold titles were retrieved, any or all, per type."""
    q = table(spark, path, "iter_queries").where("size(sp) > 0").select("query_uid", "sample_type", F.array_distinct("sp").alias("sp")).distinct()
    wanted = q.select("query_uid", "sample_type", F.size("sp").alias("n"), F.explode("sp").alias("title"))
    found = table(spark, path, "evidence_sents").where("title is not null").select("query_uid", "title", F.lit(1).alias("hit")).distinct()
    per = wanted.join(found, ["query_uid", "title"], "left").groupBy("query_uid", "sample_type", "n").agg(F.count("hit").alias("hit"))
    return per.groupBy("sample_type").agg(F.count("*").alias("n"), F.sum((F.col("hit") > 0).cast("bigint")).alias("any_found"), F.sum((F.col("hit") == F.col("n")).cast("bigint")).alias("all_found"))
