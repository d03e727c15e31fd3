"""Rows of the survey that build on several others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.catalog import query
from tessel.functions import metrics as M
from tessel.functions import qa
from tessel.functions import sql as S
from tessel.functions import text as T
from tessel.operators import builders as B
from tessel.operators import lookups
from tessel.operators import search as SEARCH
from tessel.operators import similarity as SIM
from tessel.plans.builders import _M, _POS, _SENTS, positives, samples
from tessel.plans.joins import _SPANS, firsts, links, paras
from tessel.plans.files import _FLAT
from tessel.plans.metrics import _FLOAT, _PRED, _SARI, _drop_list, predictions
from tessel.plans.metrics import _RR as _GOLD
from tessel.plans.records import _BARE, _LINES, _RR
from tessel.sources.tables import latest, table


@query(None)
def j22_negative_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidates per record from one link hop, from search for the question and for the words it shares with its gold, gold titles removed, with their sources."""
    gold = positives(spark, path).select("sample_uid", F.col("p.title").alias("title")).where("title is not null").distinct()
    first = firsts(spark, path)
    index = first.groupBy("title").agg(F.min("doc_id").cast("bigint").alias("doc_id"))
    hops = lookups.map_titles(links(spark, path), first).where("idx <> -1").select("doc_id", F.col("title").alias("other")).distinct()
    linked = gold.join(index, "title").join(hops, "doc_id").select("sample_uid", F.col("other").alias("title"), F.lit("hl").alias("src"))
    # the question, and the words that it shares with its gold paragraphs
    words = lambda c: F.array_distinct(SEARCH.standard(c))
    asked = samples(spark, path).where("question <> ''").select("sample_uid", "question", words(F.concat_ws(" ", "pos_paras.text")).alias("w"))
    shared = asked.select("sample_uid", F.array_join(F.array_intersect(words(F.col("question")), "w"), " ").alias("question")).where("question <> ''")
    p = latest(table(spark, path, "index_paras"), "idx", "title", "title_unescaped", "text")
    index = SEARCH.field_index(p, "idx")
    top = [SEARCH.search(index, SEARCH.field_terms(q, "sample_uid", "question"), 10).select(F.col("query").alias("sample_uid"), F.col("key").alias("idx"), F.lit(src).alias("src")) for q, src in ((asked, "bm25"), (shared, "overlap"))]
    # what a search returns is far more than Spark takes it for: without the hint it is collected and broadcast
    found = top[0].unionByName(top[1]).hint("merge").join(p.select("idx", "title"), "idx").select("sample_uid", "title", "src")
    every = linked.unionByName(found).where("title is not null").join(gold.hint("merge"), ["sample_uid", "title"], "left_anti")
    return every.groupBy("sample_uid", "title").agg(F.array_join(F.array_sort(F.collect_set("src")), "+").alias("src"))


@query(f"""with p as (select {_SPANS}), m as (select a.idx as first, b.idx as second from p a join p b on a.doc_id = b.doc_id and a.para_idx = 0 and b.para_idx = 1)
select p.idx, case when m.first is not null then p.text || ' ' || q.text else p.text end as text from p left join m on m.first = p.idx left join p q on q.idx = m.second where p.idx not in (select second from m)""")
def d09_replace_merged(spark: SparkSession, path: str) -> DataFrame:
    """The first two paragraphs of every document merged into one, the others as they are."""
    p = latest(table(spark, path, "index_paras").where("text is not null and sentence_spans is not null"), "idx", "doc_id", "para_idx", "text")
    second = p.where("para_idx = 1").select("doc_id", F.lit(0).alias("para_idx"), F.col("text").alias("more"), F.col("idx").alias("second"))
    joined = p.join(second, ["doc_id", "para_idx"], "left")
    gone = joined.where("second is not null").select(F.col("second").alias("idx"))
    return joined.join(gone, "idx", "left_anti").select("idx", F.concat_ws(" ", "text", "more").alias("text"))


@query(r"""with r as (select distinct on (rr_uid) rr_uid, coalesce(src, 'none') as src, mc_options, answers from rr_samples where mc_options is not null and answers[1] <> '' order by rr_uid, loaded_at desc),
o as (select rr_uid, src, answers[1] as a, unnest(l) as o, generate_subscripts(l, 1) as i from (select rr_uid, src, answers, list_filter(list_transform(string_split(regexp_replace(mc_options, '\([A-H]\) ', chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') as l from r)),
s as (select rr_uid, src, a, i, o, len(list_intersect(string_split(lower(o), ' '), string_split(lower(a), ' '))) as n from o), b as (select rr_uid, src, a, arg_max(o, (n, -i)) as choice from s group by rr_uid, src, a)
select src, count(*) as n, round(avg(cast(lower(choice) = lower(a) as integer)) * 100, 4) as accuracy from b group by src""")
def m10_choice_accuracy(spark: SparkSession, path: str) -> DataFrame:
    """Accuracy of the nearest option per source."""
    from tessel.plans.builders import m09_best_option

    gold = latest(table(spark, path, "rr_samples").where("mc_options is not null and answers[0] <> ''"), "rr_uid", "src", "answers")
    rows = m09_best_option(spark, path).join(gold, "rr_uid")
    hit = (F.lower("choice") == F.lower(F.col("answers")[0])).cast("int")
    return rows.groupBy(F.coalesce("src", F.lit("none")).alias("src")).agg(F.count("*").alias("n"), F.round(F.avg(hit) * 100, 4).alias("accuracy"))


@query(f"with {_GOLD}, {_PRED}, {_SARI} select src, count(*) as n, round(avg(sari) * 100, 4) as sari from sari join words using (rr_uid) group by src")
def m16_corpus_sari(spark: SparkSession, path: str) -> DataFrame:
    """Mean SARI per source."""
    from tessel.plans.metrics import m15_sari

    rows = m15_sari(spark, path).join(predictions(spark, path).select("rr_uid", "src"), "rr_uid")
    return rows.groupBy("src").agg(F.count("*").alias("n"), F.round(F.avg("sari") * 100, 4).alias("sari"))


@query(f"""with {_M}, {_POS}, {_SENTS}, s as (select sample_uid, i, k, {S.words("lower(" + S.close('s') + ")")} as w from sents where s <> ''), p as (select sample_uid, i, {S.words("lower(p.text)")} as w from pos where p.text is not null),
cg as (select sample_uid, i, t, count(*) as n from (select sample_uid, i, unnest(w) as t from s) group by all), cw as (select sample_uid, i, t, count(*) as n from (select sample_uid, i, unnest(w) as t from p) group by all),
cs as (select sample_uid, i, k, t, count(*) as n from (select sample_uid, i, k, unnest(w) as t from s) group by all), ng as (select sample_uid, i, sum(n) as g from cg group by all),
o as (select sample_uid, i, sum(least(cg.n, cw.n)) as same from cg join cw using (sample_uid, i, t) group by all), b as (select sample_uid, i, k, sum(least(cg.n, cs.n)) as same, sum(cs.n) as n from cg join cs using (sample_uid, i, t) group by all),
x as (select sample_uid, i, max(round(2.0 * same / (n + g), 6)) as best from b join ng using (sample_uid, i) group by all)
select sample_uid, cast(i as integer) as para_no, round(2.0 * coalesce(same, 0) / (g + len(w)), 6) as overall, best from ng join p using (sample_uid, i) left join o using (sample_uid, i) join x using (sample_uid, i)""")
def m25_explanation_score(spark: SparkSession, path: str) -> DataFrame:
    """Token F1 of a rationale with its whole paragraph, and the best with one of its sentences."""
    rows = positives(spark, path).where("p.text is not null and p.sentence_spans is not null and p.sentence_labels is not null")
    sents = B.spans_to_sentences(F.col("p.text"), F.col("p.sentence_spans"), F.col("p.sentence_labels"))
    rows = rows.select("sample_uid", F.col("i").alias("para_no"), T.words(F.lower("p.text")).alias("whole"), F.transform(sents, lambda s: T.words(F.lower(s))).alias("s")).where("size(s) > 0")
    gold = F.flatten("s")
    best = F.array_max(F.transform("s", lambda x: M.token_f1(gold, x)))
    return rows.select("sample_uid", "para_no", F.round(M.token_f1(gold, F.col("whole")), 6).alias("overall"), F.round(best, 6).alias("best"))


@query(f"""with w as (select doc_id, len({S.words("text")}) as n from documents where text is not null), b as (select doc_id, n, unnest(range(0, n)) as i from w where n > 0),
s as (select doc_id, n, i as s, least(n, i + 1 + cast(floor(3 * {S.draw(10, "doc_id", "i")}) as bigint)) as e from b where {S.draw(9, "doc_id", "i")} < 0.05),
m as (select *, max(e) over (partition by doc_id order by s rows between unbounded preceding and 1 preceding) as before from s),
g as (select *, sum(case when before is null or s > before then 1 else 0 end) over (partition by doc_id order by s rows unbounded preceding) as grp from m),
u as (select doc_id, grp, min(s) as s, max(e) as e from g group by all)
select w.doc_id, cast(n as integer) as n, coalesce(list([cast(s as integer), cast(e as integer)] order by s) filter (s is not null), []) as spans from w left join u using (doc_id) where n > 0 group by w.doc_id, n""")
def i13_whole_word_spans(spark: SparkSession, path: str) -> DataFrame:
    """Seeded spans of one to three words of every text, overlapping or touching ones merged by a fold."""
    rows = table(spark, path, "documents").where("text is not null").select("doc_id", F.size(T.words("text")).alias("n")).where("n > 0")
    starts = F.filter(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.when(B.draw(9, F.col("doc_id"), i) < 0.05, i)), lambda i: i.isNotNull())
    spans = F.transform(starts, lambda i: F.struct(i.alias("s"), F.least(F.col("n"), i + 1 + F.floor(3 * B.draw(10, F.col("doc_id"), i)).cast("int")).alias("e")))
    empty = F.array().cast("array<struct<s:int,e:int>>")

    def merge(acc, x):
        last = F.get(acc, F.size(acc) - 1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
        return F.when((F.size(acc) > 0) & (x["s"] <= last["e"]), joined).otherwise(F.concat(acc, F.array(x)))

    merged = F.transform(F.aggregate(spans, empty, merge), lambda x: F.array(x["s"], x["e"]))
    return rows.select("doc_id", "n", merged.alias("spans"))


@query(f"""with {_M}, {_POS}, {_SENTS}, t as (select sample_uid, i, string_agg({S.close('s')}, ' ' order by k) as body from sents where s <> '' group by sample_uid, i),
x as (select sample_uid, cast(i as integer) as para_no, case when {S.draw(7, "sample_uid", "i")} < 0.5 then {S.unescape(S.strip('p.title'))} || ': ' || coalesce(body, '') else body end as text from pos left join t using (sample_uid, i) where p.sentence_labels is not null and p.sentence_spans is not null and p.text is not null)
select * from x where text <> ''""")
def g04_rationale_variant(spark: SparkSession, path: str) -> DataFrame:
    """Gold sentences with the title before them by a seeded draw."""
    rows = positives(spark, path).where("p.sentence_labels is not null and p.sentence_spans is not null and p.text is not null")
    body = F.array_join(B.spans_to_sentences(F.col("p.text"), F.col("p.sentence_spans"), F.col("p.sentence_labels")), " ")
    titled = F.concat(T.unescape(T.strip("p.title")), F.lit(": "), body)
    return rows.select("sample_uid", F.col("i").alias("para_no"), F.when(B.draw(7, "sample_uid", "i") < 0.5, titled).otherwise(body).alias("text")).where("text <> ''")


_TITLED = lambda c: f"select sample_uid, answers, {S.strip(S.unescape('p.title'))} as title, p.text as text, i from (select sample_uid, answers, unnest({c}) as p, generate_subscripts({c}, 1) - 1 as i from m where {c} is not null) where p.title is not null and p.text is not null"


@query(f"""with {_M}, g as (select sample_uid, title, string_agg(text, ' ' order by i) as text from ({_TITLED("pos_paras")}) group by all),
n as (select sample_uid, title, string_agg(text, ' ' order by i) as text, min(i) as i from ({_TITLED("neg_paras")}) group by all), k as (select *, row_number() over (partition by sample_uid order by i) as rn from n),
c as (select sample_uid, string_agg(title || ': ' || text, ' ' order by {S.draw(7, "sample_uid", "title")}, title) as golds from g group by sample_uid),
t as (select sample_uid, max(title || ': ' || text) filter (rn = 1) as one, max(title || ': ' || text) filter (rn = 2) as two from k group by sample_uid),
x as (select c.sample_uid, golds, case when coalesce(len(answers), 0) = 0 then one end as one, case when coalesce(len(answers), 0) = 0 and {S.draw(8, "c.sample_uid")} >= 0.5 then two end as two from c join m using (sample_uid) left join t using (sample_uid)),
y as (select *, case when one is null then golds when {S.draw(9, "sample_uid", "0")} < 0.5 then golds || ' ' || one else one || ' ' || golds end as first from x)
select sample_uid, {S.strip("case when two is null then first when " + S.draw(9, "sample_uid", "1") + " < 0.5 then first || ' ' || two else two || ' ' || first end")} as context from y""")
def g13_contexts_by_title(spark: SparkSession, path: str) -> DataFrame:
    """Gold contexts: the paragraphs of each gold title merged, titles in a seeded order; a record without answers gets one or two merged negatives too, before or after."""
    rows = samples(spark, path)

    def merged(column: str) -> DataFrame:
        each = rows.select("sample_uid", F.posexplode(column).alias("i", "p")).where("p.title is not null and p.text is not null")
        each = each.select("sample_uid", T.strip(T.unescape("p.title")).alias("title"), "i", F.col("p.text").alias("text"))
        texts = F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"])
        return each.groupBy("sample_uid", "title").agg(F.concat("title", F.lit(": "), F.array_join(texts, " ")).alias("t"), F.min("i").alias("i"))

    in_order = F.array_sort(F.collect_list(F.struct(B.draw(7, "sample_uid", "title").alias("d"), "title", "t")))
    golds = merged("pos_paras").groupBy("sample_uid").agg(F.array_join(F.transform(in_order, lambda x: x["t"]), " ").alias("golds"))
    two = F.slice(F.array_sort(F.collect_list(F.struct("i", "t"))), 1, 2)
    negatives = merged("neg_paras").groupBy("sample_uid").agg(F.transform(two, lambda x: x["t"]).alias("negs"))
    joined = golds.join(negatives, "sample_uid", "left").join(rows.select("sample_uid", "answers"), "sample_uid")
    none = F.coalesce(F.size(F.coalesce("answers", F.array().cast("array<string>"))) == 0, F.lit(True))
    taken = F.when(none, F.slice(F.coalesce("negs", F.array().cast("array<string>")), F.lit(1), F.when(B.draw(8, "sample_uid") < 0.5, 1).otherwise(2))).otherwise(F.array().cast("array<string>"))
    numbered = F.transform(taken, lambda t, i: F.struct(t.alias("t"), (B.draw(9, F.col("sample_uid"), i) < 0.5).alias("after")))
    whole = F.aggregate(numbered, F.col("golds"), lambda acc, x: F.when(x["after"], F.concat(acc, F.lit(" "), x["t"])).otherwise(F.concat(x["t"], F.lit(" "), acc)))
    return joined.select("sample_uid", T.strip(whole).alias("context"))


@query("""with q as (select distinct query_uid, question, sp from iter_queries where len(sp) > 0 and question is not null), e as (select query_uid, question, unnest(sp) as t, generate_subscripts(sp, 1) - 1 as i from q),
n as (select query_uid, i, case when row_number() over (partition by query_uid, t order by i) > 1 then t || '(' || i || ')' else t end as title, not contains(question, t) as later from e where t is not null),
l as (select *, max(cast(not later as integer)) over (partition by query_uid) as has, sum(cast(later as integer)) over (partition by query_uid order by i rows unbounded preceding) as nth from n)
select query_uid, title, cast(case when later then has + nth - 1 else 0 end as integer) as level from l""")
def g14_unique_by_suffix(spark: SparkSession, path: str) -> DataFrame:
    """Steps of a query by level: those that the question itself names (for lack of step questions with references) are all in the first, every other has a level of its own in order;
    a title that occurs again gets its position as a suffix."""
    rows = table(spark, path, "iter_queries").where("size(sp) > 0 and question is not null").select("query_uid", "question", F.posexplode("sp").alias("i", "t")).distinct()
    rows = rows.where("t is not null").select("query_uid", "i", "t", (~F.contains("question", "t")).alias("later"))
    return B.step_levels(rows, "query_uid", "i", "t", "later").select("query_uid", F.col("t").alias("title"), "level")


@query(f"""with q as (select distinct query_uid, question, answer, sample_type from iter_queries where question <> '' and len(answer) > 0 and sample_type <> ''),
r as (select *, row_number() over (partition by sample_type order by query_uid) as rn from q)
select query_uid, sample_type, regexp_replace(regexp_replace({_BARE("question")}, '[.!?]$', '') || '?', '\\?\\?$', '?') || ' \\n' || case when coalesce(answer[1], '') <> '' then ' ' || chr(9) || {_BARE("answer[1]")} else '' end as line from r where rn <= 50""")
def g20_filtered_builder(spark: SparkSession, path: str) -> DataFrame:
    """Question lines of each type, fifty of a type at most: the cap is the builder's parameter."""
    rows = table(spark, path, "iter_queries").where("question <> '' and size(answer) > 0 and sample_type <> ''").select("query_uid", "question", "answer", "sample_type").distinct()
    return B.capped(rows, "sample_type", [F.col("query_uid")], 50).select("query_uid", "sample_type", qa.example(F.col("question"), F.lit(None).cast("string"), F.get("answer", F.lit(0))).alias("line"))


@query("""with d as (select a.vec_id as uid, b.vec_id as other, round(list_inner_product(cast(a.embedding[1:32] as double[]), cast(b.embedding[1:32] as double[])), 9) as one, list_inner_product(cast(a.embedding[33:64] as double[]), cast(b.embedding[33:64] as double[])) as two
 from embeddings a join embeddings b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id), s as (select uid, other, case when one >= 0.1 then round((one + two) / 2, 9) else 0 end as score from d)
select uid, arg_max(other, (score, -other)) as other, round(max(score), 6) as score from s group by uid""")
def l05_combined_similarity(spark: SparkSession, path: str) -> DataFrame:
    """Nearest neighbour by the mean of two inner products, of the halves of a vector; a first half below a threshold counts as zero for both."""
    rows = table(spark, path, "embeddings").where("embedding is not null")
    halves = rows.select(F.col("vec_id").alias("uid"), F.slice("embedding", 1, 32).alias("first"), F.slice("embedding", 33, 32).alias("second"))
    return SIM.nearest_by_mean(halves.where("uid % 20 = 0"), halves, 0.1).select("uid", "other", F.round("score", 6).alias("score"))


@query(rf"""with {_RR}, x as (select {_FLAT.format("question")} as q, {_FLAT.format("'#!#' || array_to_string(answers, '#!#') || '#!#'")} as a from rr where question <> '' and len(answers) > 0)
select {S.strip("q")} as question, list_transform(string_split(regexp_replace({S.strip("lower(a)")}, '^[#!]+|[#!]+$', '', 'g'), '#!#'), lambda y: {S.strip("y")}) as answers, cast(null as varchar) as corrupt from x where length(q) - length(replace(q, chr(9), '')) = 0""")
def s14_question_file(spark: SparkSession, path: str) -> DataFrame:
    """Ranking records written as question lines and read again."""
    from tessel.plans.files import place
    from tessel.plans.records import ranking
    from tessel.sources import files

    rows = ranking(spark, path).where("question <> '' and size(answers) > 0")
    files.write_qa(rows.select("question", qa.encode_answers(F.col("answers")).alias("answer")), to := place(spark, "s14"))
    return files.read_qa(spark, to, lower=True).select("question", "answers", "corrupt")


def _counted(tokens):
    """struct(words, weights): distinct tokens as hashes with their counts."""
    return T.let(tokens, lambda t: F.transform(F.array_distinct(t), lambda w: F.struct(F.xxhash64(w).alias("w"), F.size(F.filter(t, lambda x: x == w)).cast("double").alias("n"))))


def _nearest_counts(spark: SparkSession, path: str, tokens) -> DataFrame:
    rows = table(spark, path, "mdr_samples").where("split is not null and question <> ''")
    q = rows.select(F.col("sample_uid").alias("uid"), (F.lower(F.trim("split")) == "train").alias("t"), _counted(tokens).alias("c")).distinct().where("size(c) > 0")
    q = q.select("uid", "t", F.col("c.w").alias("words"), F.col("c.n").alias("weights"))
    return SIM.nearest_by_words(q.where("not t"), q.where("t"), weighted=True)


_TOK = r"[\p{L}\p{N}_]{2,}"
_L01 = r"""d as (select distinct sample_uid as uid, lower(trim(split)) = 'train' as t, regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]{{2,}}') as w from mdr_samples where split is not null and question <> ''),
c as (select uid, t, term, count(*) as tf from (select uid, t, unnest(w) as term from d) group by all), n as (select uid, sum(tf * tf) as s from c group by uid),
h as (select a.uid, b.uid as nearest, sum(a.tf * b.tf) as same from c a join c b on not a.t and b.t and a.term = b.term group by all)"""
_LISTS = r"""d as (select distinct sample_uid as uid, lower(trim(split)) = 'train' as t, {0} as w from mdr_samples where split is not null and question <> ''),
c as (select uid, t, term, count(*) as tf from (select uid, t, unnest(w) as term from d) group by all), n as (select uid, sum(tf * tf) as s from c group by uid),
h as (select a.uid, b.uid as nearest, sum(a.tf * b.tf) as same from c a join c b on not a.t and b.t and a.term = b.term group by all)"""
_W = r"regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]{{2,}}')"
_TWO = "(with z as (select " + _W.format("lower(question)") + " as l) select list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1]) from z)"
_PICK = "select uid, arg_max(nearest, (sc, -nearest)) as nearest, round(max(sc) * 100, 6) as score from (select h.uid, nearest, same / sqrt(cast(x.s as double) * y.s) as sc from h join n x using (uid) join n y on y.uid = h.nearest) group by uid"


@query(f"with {_L01.format('lower(question)')} {_PICK}")
def l01_count_cosine(spark: SparkSession, path: str) -> DataFrame:
    """Nearest training question by cosine of word counts."""
    found = _nearest_counts(spark, path, F.regexp_extract_all(F.lower("question"), F.lit(_TOK), F.lit(0)))
    return found.select("uid", "nearest", F.round(F.col("score") * 100, 6).alias("score"))


@query("select 1 as n, * from (with " + _LISTS.format(_W.format("lower(question)")) + " " + _PICK + ") union all select 2 as n, * from (with " + _LISTS.format(_TWO) + " " + _PICK + ")")
def l06_ngram_loop(spark: SparkSession, path: str) -> DataFrame:
    """The same for word n-grams of one and of two, as one table."""
    words = F.regexp_extract_all(F.lower("question"), F.lit(_TOK), F.lit(0))
    pairs = T.let(words, lambda t: F.transform(F.slice(t, 2, 1 << 20), lambda w, i: F.concat(F.get(t, i), F.lit(" "), w)))
    of = lambda n, tokens: _nearest_counts(spark, path, tokens).select(F.lit(n).alias("n"), "uid", "nearest", F.round(F.col("score") * 100, 6).alias("score"))
    return of(1, words).unionByName(of(2, pairs))


@query("with " + _LISTS.format(_W.format(S.SQUAD.format("question"))) + " " + _PICK)
def l07_normalised_cosine(spark: SparkSession, path: str) -> DataFrame:
    """The same over normalised questions."""
    found = _nearest_counts(spark, path, F.regexp_extract_all(M.squad(F.col("question")), F.lit(_TOK), F.lit(0)))
    return found.select("uid", "nearest", F.round(F.col("score") * 100, 6).alias("score"))


@query("with " + _LISTS.format("regexp_extract_all(question, '[0-9][0-9,.]*')") + " " + _PICK)
def l10_numeric_similarity(spark: SparkSession, path: str) -> DataFrame:
    """Nearest training question by the numbers of both, for questions that have one."""
    return _nearest_counts(spark, path, F.regexp_extract_all("question", F.lit("[0-9][0-9,.]*"), F.lit(0))).select("uid", "nearest", F.round(F.col("score") * 100, 6).alias("score"))


@query("select l_returnflag as run, l_linestatus as dataset, 'discount' as metric, round(avg(l_discount) * 100, 6) as score from lineitem group by 1, 2 union all select l_returnflag, l_linestatus, 'tax', round(avg(l_tax) * 100, 6) from lineitem group by 1, 2")
def a03_long_results(spark: SparkSession, path: str) -> DataFrame:
    """Runs, datasets and metrics as one long table, read once."""
    means = table(spark, path, "lineitem").groupBy(F.col("l_returnflag").alias("run"), F.col("l_linestatus").alias("dataset")).agg(F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"))
    long = means.unpivot(["run", "dataset"], ["discount", "tax"], "metric", "score")
    return long.withColumn("score", F.round(F.col("score") * 100, 6))


@query(f"""with {_M}, {_POS}, gold as (select distinct p.title as title from pos where p.title is not null), d as (select distinct doc_id, para_idx from (select idx, any_value(title) as title, any_value(doc_id) as doc_id, any_value(para_idx) as para_idx from index_paras group by idx) join gold using (title)),
r as (select *, para_idx - row_number() over (partition by doc_id order by para_idx) as run from d), k as (select *, row_number() over (partition by doc_id, run order by para_idx) - 1 as k, count(*) over (partition by doc_id, run) as n from r)
select doc_id, list(para_idx order by para_idx) as merges from k where k % 2 = 0 and k + 1 < n group by doc_id""")
def a37_conflict_free_merges(spark: SparkSession, path: str) -> DataFrame:
    """Of the merges of neighbouring gold paragraphs of a document, those kept by a greedy pass in order: a merge that shares a paragraph with a kept one goes. The fold is over a
    document's few pairs."""
    gold = positives(spark, path).select(F.col("p.title").alias("title")).distinct()
    p = paras(spark, path).where("title is not null").join(gold, "title", "left_semi").select("doc_id", "para_idx")
    pairs = p.groupBy("doc_id").agg(F.array_sort(F.collect_set("para_idx")).alias("i"))
    steps = T.let(F.col("i"), lambda i: F.filter(F.transform(F.slice(i, 2, 1 << 20), lambda x, k: F.when(x == F.get(i, k) + 1, F.get(i, k))), lambda s: s.isNotNull()))
    safe = F.aggregate(steps, F.array(F.lit(-2)), lambda acc, s: F.when(F.element_at(acc, -1) + 1 < s, F.concat(acc, F.array(s))).otherwise(acc))
    return pairs.select("doc_id", F.filter(safe, lambda s: s >= 0).alias("merges")).where("size(merges) > 0")


@query(f"with {_RR}, w as (select distinct rr_uid, unnest({S.words('question')}) as t from rr where question is not null), {S.numbers('w')} select rr_uid, t as word, v as number from w join num using (t) where v is not null")
def t24_word_to_number(spark: SparkSession, path: str) -> DataFrame:
    """Single words of questions that are numbers, in digits or in words; a bare magnitude is none."""
    from tessel.functions.udf import to_number
    from tessel.plans.records import ranking

    words = ranking(spark, path).where("question is not null").select("rr_uid", F.explode(F.array_distinct(T.words("question"))).alias("word"))
    return words.select("rr_uid", "word", to_number("word").alias("number")).where("number is not null")


@query(f"""with {_GOLD}, {_PRED}, g as (select rr_uid, src, list_distinct({_drop_list("p")}) as p, list_distinct({_drop_list("a")}) as g from (select rr_uid, src, p, unnest(answers) as a from pred) where a is not null),
s as (select rr_uid, src, len(list_intersect(p, g)) as same, len(p) as np, len(g) as ng, list_filter(g, lambda t: {_FLOAT}) as nums, p from g),
f as (select rr_uid, src, case when len(nums) > 0 and len(list_intersect(nums, p)) = 0 then 0.0 else 2.0 * (case when np = 0 then 1.0 else same::double / np end) * (case when ng = 0 then 1.0 else same::double / ng end)
 / nullif((case when np = 0 then 1.0 else same::double / np end) + (case when ng = 0 then 1.0 else same::double / ng end), 0) end as f1 from s), b as (select rr_uid, src, max(round_even(coalesce(f1, 0), 2)) as f1 from f group by all)
select src, count(*) as n, round(avg(f1) * 100, 4) as score from b group by src""")
def m05_best_f1(spark: SparkSession, path: str) -> DataFrame:
    """Mean number-aware F1 of one predicted span with the best gold, per source."""
    golds = F.filter("answers", lambda a: a.isNotNull())
    best = T.let(M.drop_tokens(F.col("p")), lambda p: F.array_max(F.transform(golds, lambda g: M.set_f1(p, M.drop_tokens(g)))))
    rows = predictions(spark, path).select("src", best.alias("f1"))
    return rows.groupBy("src").agg(F.count("*").alias("n"), F.round(F.avg("f1") * 100, 4).alias("score"))


@query(rf"with {_LINES} select {S.strip(_FLAT.format('q'))} as question, {S.strip(_FLAT.format('a'))} as answer from lines")
def s11_single_answers(spark: SparkSession, path: str) -> DataFrame:
    """Question lines whose answer is kept as it is written."""
    from tessel.plans.files import place
    from tessel.plans.records import lines
    from tessel.sources import files

    files.write_qa(lines(spark, path).select(F.col("q").alias("question"), F.col("a").alias("answer")), to := place(spark, "s11"))
    return files.read_qa(spark, to, many=False).select("question", F.col("answers")[0].alias("answer"))


@query("select distinct c_custkey, c_name from customer")
def s16_gzip_or_plain(spark: SparkSession, path: str) -> DataFrame:
    """Plain and gzip JSON lines in one folder, read by extension."""
    from tessel.plans.files import place
    from tessel.sources import files

    rows = table(spark, path, "customer").select("c_custkey", "c_name", "c_nationkey")
    to = place(spark, "s16")
    files.write_jsonl(rows.where("c_nationkey < 12"), f"{to}/plain")
    files.write_jsonl(rows.where("c_nationkey >= 12"), f"{to}/gz", compression="gzip")
    return files.read_jsonl(spark, f"{to}/*", "c_custkey bigint, c_name string, c_nationkey int").select("c_custkey", "c_name")


@query("select distinct query_uid, question from iter_queries")
def s17_any_compression(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, plain, gz and bz2, in one folder, told apart by extension."""
    from tessel.plans.files import place
    from tessel.sources import files

    rows = table(spark, path, "iter_queries").select("query_uid", "question").distinct()
    to = place(spark, "s17")
    for k, kind in enumerate(("none", "gzip", "bzip2")):
        files.write_jsonl(rows.where(F.pmod("query_uid", F.lit(3)) == k), f"{to}/{kind}", compression=kind)
    return files.read_jsonl(spark, f"{to}/*", "query_uid bigint, question string").drop("_corrupt")
