"""Similarity and search (L) over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.catalog import query
from tessel.functions import text as T
from tessel.operators import search as SEARCH
from tessel.operators import similarity as SIM
from tessel.sources.tables import latest, table

_P = "p as (select idx, any_value(title) as title, any_value(title_unescaped) as tu, any_value(para_id) as para_id, any_value(text) as text, bool_or(for_hotpot) as for_hotpot from index_paras group by idx)"
_INDEX = r"""tok as (select idx, unnest(t) as term, len(t) as dl from (select idx, regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+') as t from p where {0} is not null)),
inv as (select term, idx, dl, count(*) as tf from tok group by all)"""


def paras(spark: SparkSession, path: str) -> DataFrame:
    return latest(table(spark, path, "index_paras"), "idx", "title", "title_unescaped", "para_id", "text", "for_hotpot")


def queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_uid, question), one row per key."""
    return latest(table(spark, path, "iter_queries").where("question is not null"), "query_uid", "question", "sp")


@query(f"with {_P}, {_INDEX.format('text')} select term, idx, tf, cast(dl as integer) as dl from inv")
def s20_inverted_index(spark: SparkSession, path: str) -> DataFrame:
    """Terms of every paragraph with frequency and length."""
    return SIM.inverted_index(paras(spark, path), "idx", "text")


_WORDS = r"regexp_extract_all({0}, '[\p{{L}}\p{{N}}]+')"
_NO_STOPS = f"list_filter({{0}}, lambda w: w not in ({', '.join(repr(w) for w in SEARCH.STOPS)}))"
_FOLD = "nfc_normalize(strip_accents(lower({0})))"
_GRAMS = "(with z as (select {0} as t) select list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) from z)"
_FIELDS = [
    ("title", "title", 1.25, "letters"), ("title_unescaped", "tu", 1.25, "letters"), ("text", "text", 1.0, "standard"),
    ("title.bigram", "title", 1.25, "pairs"), ("title_unescaped.bigram", "tu", 1.25, "pairs"), ("text.bigram", "text", 1.0, "pairs_without_stops"),
]


def _analysed(kind: str, x: str) -> str:
    words = _WORDS.format(f"lower({x})")
    folded = _WORDS.format(_FOLD.format(x))
    return {
        "letters": f"regexp_extract_all(lower({x}), '\\p{{L}}+')", "standard": _NO_STOPS.format(words), "pairs": _GRAMS.format(folded), "pairs_without_stops": _GRAMS.format(_NO_STOPS.format(folded)),
    }[kind]


_FT = " union all ".join(f"select idx, '{f}' as field, {b} as boost, {_analysed(kind, c)} as t from p where {c} is not null" for f, c, b, kind in _FIELDS)
_QT = " union all ".join(f"select query_uid, '{f}' as field, {_analysed(kind, 'question')} as t from q" for f, _, _, kind in _FIELDS)
_Q = f"""q as (select distinct query_uid, question from iter_queries where question is not null), ft as ({_FT}), tok as (select idx, field, boost, len(t) as dl, unnest(t) as term from ft),
inv as (select field, boost, term, idx, dl, count(*) as tf from tok group by all), st as (select field, count(*) as n, sum(dl) * 1.0 / count(*) as m from (select distinct field, idx, dl from inv) group by field),
dfs as (select field, term, count(*) as df from inv group by all), qt as (select distinct query_uid, field, unnest(t) as term from ({_QT})),
per as (select query_uid, idx, field, sum(boost * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / m))) as score from qt join inv using (field, term) join dfs using (field, term) join st using (field) group by all),
hits as (select query_uid, idx, round(max(score), 6) as score from per group by all)"""


def hits(spark: SparkSession, path: str, k: int, allowed: DataFrame | None = None, barred: DataFrame | None = None) -> DataFrame:
    """(query_uid, idx, score, rank): the k best paragraphs of every question over the six fields."""
    index = SEARCH.field_index(paras(spark, path), "idx")
    found = SEARCH.search(index, SEARCH.field_terms(queries(spark, path), "query_uid", "question"), k, allowed=allowed, barred=barred)
    return found.select(F.col("query").alias("query_uid"), F.col("key").alias("idx"), "score", "rank")


@query(f"with {_P}, {_Q} select query_uid, idx, score, cast(rn as integer) as rank from (select *, row_number() over (partition by query_uid order by score desc, idx) as rn from hits) where rn <= 10")
def l11_bm25(spark: SparkSession, path: str) -> DataFrame:
    """Ten best paragraphs for every question over title, unescaped title, text and their bigrams; the best boosted field counts."""
    return hits(spark, path, 10)


_GOLD = "gold as (select distinct query_uid, unnest(sp) as title from iter_queries where sp is not null)"


@query(f"""with {_P}, {_Q}, {_GOLD}, h as (select * from hits where idx in (select idx from p where for_hotpot) and (query_uid, idx) not in (select query_uid, idx from gold join p using (title)))
select query_uid, idx, score from (select *, row_number() over (partition by query_uid order by score desc, idx) as rn from h) where rn between 3 and 7""")
def l12_search_page(spark: SparkSession, path: str) -> DataFrame:
    """A page of hits, offset 2 and size 5, among the paragraphs of one collection (filter) and without those of gold titles (must not)."""
    # gold titles are barred as titles: their pairs with paragraphs grow with the product of both where titles repeat
    allowed = latest(table(spark, path, "index_paras"), "idx", "title", "for_hotpot").where("for_hotpot").select("idx", "title")
    gold = queries(spark, path).select("query_uid", F.explode("sp").alias("title"))
    return hits(spark, path, 7, allowed=allowed, barred=gold).where("rank > 2").select("query_uid", "idx", "score")


_CORE = r"trim(regexp_replace(tu, '\s*\([^)]*\)$', ''))"
_BOOST = f"""case when tu in (question, q1) then 1.5 when lower(tu) in (lower(question), lower(q1)) then 1.2 when contains(question, lower(tu)) then 1.1 when {_CORE} in (question, q1) then 1.2
 when lower({_CORE}) in (lower(question), lower(q1)) then 1.1 when contains(lower(question), lower({_CORE})) then 1.05 else 1 end"""


@query(f"""with {_P}, {_Q}, best as (select * from (select *, row_number() over (partition by query_uid order by score desc, idx) as rn from hits) where rn <= 50),
r as (select query_uid, idx, round(score * {_BOOST}, 6) as score from best join (select *, case when lower(left(question, 4)) = 'the ' and left(question, 1) in ('T', 't') then substr(question, 5) else question end as q1 from q) using (query_uid) join p using (idx))
select query_uid, idx, score, cast(rn as integer) as rank from (select *, row_number() over (partition by query_uid order by score desc, idx) as rn from r) where rn <= 10""")
def l13_rerank_by_title(spark: SparkSession, path: str) -> DataFrame:
    """Fifty hits of every question boosted by how their title meets it, the ten best of them."""
    q, t = F.col("question"), F.col("title_unescaped")
    bare = F.when(q.rlike("^[Tt]he "), F.substring(q, 5, 1 << 20)).otherwise(q)
    core = F.trim(F.regexp_replace(t, r"\s*\([^)]*\)$", ""))
    boost = (
        F.when((t == q) | (t == bare), 1.5).when(F.lower(t).isin(F.lower(q), F.lower(bare)), 1.2).when(F.contains(q, F.lower(t)), 1.1).when((core == q) | (core == bare), 1.2)
        .when(F.lower(core).isin(F.lower(q), F.lower(bare)), 1.1).when(F.contains(F.lower(q), F.lower(core)), 1.05).otherwise(1.0)
    )
    # what a search returns is far more than Spark takes it for: without the hints it is collected and broadcast
    found = hits(spark, path, 50).hint("merge").join(queries(spark, path), "query_uid").hint("merge").join(paras(spark, path).select("idx", "title_unescaped"), "idx")
    scored = found.select("query_uid", "idx", F.round(F.col("score") * F.coalesce(boost, F.lit(1.0)), 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_uid").orderBy(F.col("score").desc(), "idx"))).where("rank <= 10")


@query(f"with {_P} select idx, para_id from p where para_id like '%_0'")
def l14_term_query(spark: SparkSession, path: str) -> DataFrame:
    """Keyword match on the paragraph id."""
    return paras(spark, path).where("para_id like '%_0'").select("idx", "para_id")


@query(rf"with {_P} select idx, {_CORE} as core from p where tu is not null")
def l15_core_title(spark: SparkSession, path: str) -> DataFrame:
    """Titles without a bracketed suffix."""
    core = F.trim(F.regexp_replace("title_unescaped", r"\s*\([^)]*\)$", ""))
    return paras(spark, path).where("title_unescaped is not null").select("idx", core.alias("core"))


_DOT = "round(list_inner_product(cast(a.embedding as double[]), cast(b.embedding as double[])), 9)"
_TOP = f"select uid, other, score, cast(rn as integer) as rank from (select *, row_number() over (partition by uid order by score desc, other) as rn from (select a.vec_id as uid, b.vec_id as other, {_DOT} as score from embeddings a join embeddings b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id)) where rn <= {{0}}"


def dense(spark: SparkSession, path: str, k: int) -> DataFrame:
    rows = table(spark, path, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("uid"), F.col("embedding").alias("vector"))
    return SIM.nearest_by_vector(rows.where("uid % 20 = 0"), rows, k)


@query(f"select uid, other, round(score, 6) as score, rank from ({_TOP.format(10)})")
def l03_embedding_neighbours(spark: SparkSession, path: str) -> DataFrame:
    """Ten exact neighbours by cosine (unit vectors) of every twentieth vector among all."""
    return dense(spark, path, 10).select("uid", "other", F.round("score", 6).alias("score"), "rank")


@query(f"select uid, other, round(score, 6) as score from ({_TOP.format(5)}) t where not exists (select 1 from embeddings x, embeddings y where x.vec_id = t.uid and y.vec_id = t.other and x.label = y.label)")
def l16_dense_search_with_exclusion(spark: SparkSession, path: str) -> DataFrame:
    """Five neighbours, those already taken (of the same label) excluded after the cut, so fewer may be left."""
    labels = table(spark, path, "embeddings").select(F.col("vec_id"), "label")
    top = dense(spark, path, 5).join(labels.toDF("uid", "la"), "uid").join(labels.toDF("other", "lb"), "other")
    return top.where("la <> lb").select("uid", "other", F.round("score", 6).alias("score"))


@query("with n as (select vec_id, list_inner_product(cast(embedding as double[]), cast(embedding as double[])) as s from embeddings) select vec_id, round(sqrt(greatest(0, max(s) over () - s)), 3) as extra from n")
def l17_inner_product_to_distance(spark: SparkSession, path: str) -> DataFrame:
    """The extra coordinate that turns inner product into distance: the root of what a squared norm lacks to the largest."""
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = table(spark, path, "embeddings").select("vec_id", square.alias("s"))
    return rows.join(F.broadcast(rows.agg(F.max("s").alias("m")))).select("vec_id", F.round(F.sqrt(F.greatest(F.lit(0.0), F.col("m") - F.col("s"))), 3).alias("extra"))


@query(f"""with one as ({_TOP.format(3)}), two as (select a.uid, a.other as mid, a.score as s1, b.other, b.score as s2 from one a join (select uid, other, score from (select *, row_number() over (partition by uid order by score desc, other) as rn from
 (select a.vec_id as uid, b.vec_id as other, {_DOT} as score from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id in (select other from one))) where rn <= 3) b on a.other = b.uid where b.other <> a.uid)
select uid, mid, other, round(s1 + s2, 6) as score, cast(rn as integer) as rank from (select *, row_number() over (partition by uid order by round(s1 + s2, 6) desc, mid, other) as rn from two) where rn <= 3""")
def l18_two_hop_search(spark: SparkSession, path: str) -> DataFrame:
    """Beam search of two hops: three neighbours of three, the path score is the sum, three best paths."""
    from tessel.session import cut

    rows = table(spark, path, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("uid"), F.col("embedding").alias("vector"))
    one = cut(SIM.nearest_by_vector(rows.where("uid % 20 = 0"), rows, 3).select("uid", F.col("other").alias("mid"), F.col("score").alias("s1")))
    beam = rows.join(one.select(F.col("mid").alias("uid")).distinct(), "uid", "left_semi")
    two = SIM.nearest_by_vector(beam, rows, 3).select(F.col("uid").alias("mid"), "other", F.col("score").alias("s2"))
    paths = one.join(two, "mid").where("other <> uid").select("uid", "mid", "other", F.round(F.col("s1") + F.col("s2"), 6).alias("score"))
    return paths.withColumn("rank", F.row_number().over(Window.partitionBy("uid").orderBy(F.col("score").desc(), "mid", "other"))).where("rank <= 3")


@query(r"""with d as (select distinct sample_uid as uid, lower(trim(split)) = 'train' as t, regexp_extract_all(lower(question), '\w\w+') as w from mdr_samples where split is not null and question <> ''),
f as (select uid, t, unnest(w) as term from d), c as (select uid, t, term, count(*) as tf from f group by all), l as (select uid, sum(tf) as n from c group by uid),
h as (select a.uid, b.uid as tuid, sum(least(a.tf, b.tf)) as same from c a join c b on not a.t and b.t and a.term = b.term group by all)
select uid, max(round(200.0 * same / (x.n + y.n), 6)) as f1 from h join l x using (uid) join l y on y.uid = h.tuid group by uid""")
def l02_f1_neighbours(spark: SparkSession, path: str) -> DataFrame:
    """Highest multiset F1 of every evaluation question with a training question.

    A repeated word is told apart by its number, so the multiset intersection is the number of common (word, number) pairs, and the F1 order is found among them in blocks.
    """
    import numpy as np
    import pyarrow as pa

    rows = table(spark, path, "mdr_samples").where("split is not null and question <> ''").select(F.col("sample_uid").alias("uid"), (F.lower(F.trim("split")) == "train").alias("t"), F.regexp_extract_all(F.lower("question"), F.lit(r"[0-9A-Za-z_]{2,}"), F.lit(0)).alias("w")).distinct()
    numbered = F.transform("w", lambda x, i: F.xxhash64(x, F.size(F.filter(F.slice("w", 1, i + 1), lambda y: y == x))))
    q = rows.select("uid", "t", numbered.alias("words")).where("size(words) > 0")

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        schema = pa.schema([("uid", pa.int64()), ("f1", pa.float64())])
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        (aw, ao), (bw, bo) = SIM._flat(a.column("words")), SIM._flat(b.column("words"))
        alphabet, code = np.unique(aw, return_inverse=True)
        an, bn = np.diff(ao), np.diff(bo)
        owner = np.repeat(np.arange(len(an)), an)[np.argsort(code, kind="stable")]
        first = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(alphabet)))])
        best = np.zeros(len(an))
        for lo in range(0, len(bn), 250):
            hi = min(lo + 250, len(bn))
            w = bw[bo[lo] : bo[hi]]
            k = np.minimum(np.searchsorted(alphabet, w), len(alphabet) - 1)
            hit = alphabet[k] == w
            row, k = np.repeat(np.arange(hi - lo), bn[lo:hi])[hit], k[hit]
            n = first[k + 1] - first[k]
            pos = np.repeat(first[k] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            same = np.bincount(owner[pos] * (hi - lo) + np.repeat(row, n), minlength=len(an) * (hi - lo)).reshape(len(an), hi - lo)
            best = np.maximum(best, (200.0 * same / (an[:, None] + bn[None, lo:hi])).max(axis=1))
        return pa.table([a.column("uid"), pa.array(best)], schema=schema)

    found = SIM.compare(q.where("not t"), q.where("t"), ("words",), run, "uid bigint, f1 double")
    return found.groupBy("uid").agg(F.round(F.max("f1"), 6).alias("f1")).where("f1 > 0")


@query("""with e as (select vec_id, label, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings) select label, cast(i - 1 as integer) as dim, round(avg(cast(x as double)), 6) as x from e group by label, i""")
def l20_mean_pooling(spark: SparkSession, path: str) -> DataFrame:
    """Mean vector of every label."""
    each = table(spark, path, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    return each.groupBy("label", "dim").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))


@query("""with s as (select user_id, event_id, value as v, row_number() over (partition by user_id order by ts, event_id) as i from events)
select a.user_id, arg_max(a.i, (round(a.v + b.v, 4), -a.i, -b.i)) as s, arg_max(b.i, (round(a.v + b.v, 4), -a.i, -b.i)) as e from s a join s b on a.user_id = b.user_id and b.i between a.i and a.i + 35 group by a.user_id""")
def l21_best_span(spark: SparkSession, path: str) -> DataFrame:
    """Start and end, at most 35 apart, of the highest summed score: a range join without pairs, as the best start in a sliding window is a running maximum."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, path, "events").select("user_id", "value", F.row_number().over(w).alias("i"))
    back = Window.partitionBy("user_id").orderBy("i").rowsBetween(-35, 0)
    starts = rows.withColumn("a", F.max(F.struct("value", (-F.col("i")).alias("n"))).over(back))
    best = starts.groupBy("user_id").agg(F.max(F.struct(F.round(F.col("value") + F.col("a.value"), 4).alias("t"), F.col("a.n").alias("n"), (-F.col("i")).alias("m"))).alias("b"))
    return best.select("user_id", (-F.col("b.n")).cast("bigint").alias("s"), (-F.col("b.m")).cast("bigint").alias("e"))


@query(None)
def l19_ivf(spark: SparkSession, path: str) -> DataFrame:
    """Inverted-file search: the index is fitted on a bounded sample, every vector is indexed, the nearest lists are probed."""
    from tessel.operators.ivf import ivf_search

    rows = table(spark, path, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("uid"), F.col("embedding").alias("vector"))
    return ivf_search(rows.where("uid % 20 = 0"), rows, 10)


@query("select distinct q.query_uid, t.title from (select query_uid, unnest(sp) as title from iter_queries) q join (select distinct title from index_paras where title is not null) t using (title)")
def l08_gold_in_index(spark: SparkSession, path: str) -> DataFrame:
    """Gold titles of the queries that are in the index."""
    gold = table(spark, path, "iter_queries").select("query_uid", F.explode("sp").alias("title")).distinct()
    return gold.join(table(spark, path, "index_paras").select("title"), "title", "left_semi").select("query_uid", "title")


def _cosine(name: str, text: str) -> str:
    """CTEs: {name}h (uid, nearest, sim), cosines x 100 of word counts of all evaluation and training records with a common word."""
    return rf"""{name}c as (select uid, t, term, count(*) as tf from (select uid, t, unnest(regexp_extract_all(lower(coalesce({text}, '')), '[\p{{L}}\p{{N}}_]{{2,}}')) as term from rows) group by all), {name}n as (select uid, sum(tf * tf) as s from {name}c group by uid),
{name}h as (select h.uid, nearest, round(100 * same / sqrt(cast(x.s as double) * y.s), 6) as sim from (select a.uid, b.uid as nearest, sum(a.tf * b.tf) as same from {name}c a join {name}c b on not a.t and b.t and a.term = b.term group by all) h join {name}n x using (uid) join {name}n y on y.uid = h.nearest)"""


@query(f"""with rows as (select distinct sample_uid as uid, lower(trim(split)) = 'train' as t, coalesce(src, 'hotpotqa') as src, question, answers[1] as answer from mdr_samples where split is not null and question <> ''),
{_cosine("q", "question")}, {_cosine("a", "answer")}, s as (select ah.uid, ah.nearest, (case when qh.sim >= 60 then qh.sim else 0 end + ah.sim) / 2 as score from ah left join qh using (uid, nearest) where ah.sim >= 40),
b as (select uid, arg_max(nearest, (score, -nearest)) as nearest, max(score) as score from s group by uid), f as (select min(uid) as uid from rows where t)
select e.uid, e.src, x.src as tsrc, x.uid as nearest, round(coalesce(b.score, 0), 6) as score from (select uid, src from rows where not t) e cross join f left join b on b.uid = e.uid join (select uid, src from rows where t) x on x.uid = coalesce(b.nearest, f.uid)""")
def l04_question_and_answer(spark: SparkSession, path: str) -> DataFrame:
    """The training record of the highest mean of question and first-answer similarity for every evaluation record; no question counts below 60, nothing where the answers are below 40."""
    rows = table(spark, path, "mdr_samples").where("split is not null and question <> ''")
    words = lambda c: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    q = rows.select(F.col("sample_uid").alias("uid"), (F.lower(F.trim("split")) == "train").alias("t"), F.coalesce("src", F.lit("hotpotqa")).alias("src"), words(F.col("question")).alias("q"), words(F.get("answers", F.lit(0))).alias("a")).distinct()
    hashed = lambda c: F.transform(F.array_distinct(c), lambda w: F.xxhash64(w))
    counts = lambda c: F.transform(F.array_distinct(c), lambda w: F.size(F.filter(c, lambda x: x == w)).cast("double"))
    q = q.select("uid", "t", "src", *[f(F.col(c)).alias(f"{c}_{n}") for c in ("q", "a") for n, f in (("w", hashed), ("n", counts))])
    held, train = q.where("not t"), q.where("t")
    best = SIM.nearest_by_question_and_answer(held, train, 60.0, 40.0)
    return best.join(held.select("uid", "src"), "uid").join(train.select(F.col("uid").alias("nearest"), F.col("src").alias("tsrc")), "nearest").select("uid", "src", "tsrc", "nearest", F.round("score", 6).alias("score"))
