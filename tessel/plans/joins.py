"""Joins (J) and set operations (D) over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.catalog import query
from tessel.functions import sql as S
from tessel.functions import text as T
from tessel.operators import lookups, shredding
from tessel.plans.nested import _PAGES
from tessel.plans.records import _RR, ranking
from tessel.sources.tables import latest, table

_DOCS = "docs as (select idx, any_value(title) as title, any_value(doc_id) as doc_id, any_value(para_idx) as para_idx, any_value(text) as text from index_paras group by idx)"
_FIRST = "firsts as (select idx, title, doc_id from docs where para_idx = 0 and title is not null)"
_LINKS = """links as (select distinct doc_id, para_no, h.key as link from paras, json_each(para, '$.hyperlinks_cased') h where json_type(h.value) = 'ARRAY')"""
_KEY = S.unescape("lower({})")
_MAPPED = f"""keyed as (select {_KEY.format("title")} as k, title, idx from firsts), per as (select k, count(*) as n, min(idx) as first_idx, arg_min(title, idx) as first_title from keyed group by k),
ex as (select title, min(idx) as exact_idx from firsts group by title),
mapped as (select l.*, case when n is null or exact_idx is not null then link else first_title end as title,
 case when n is null then 'nf' when n = 1 then case when exact_idx is not null then 'sok' else 'sc' end when exact_idx is not null then 'mok' else 'mc' end as status,
 case when n is null then -1 when exact_idx is not null then exact_idx else first_idx end as idx
 from links l left join per on per.k = {_KEY.format("l.link")} left join ex on ex.title = l.link)"""
_WITH = f"with {_PAGES}, {_DOCS}, {_FIRST}, {_LINKS}, {_MAPPED}"


def paras(spark: SparkSession, path: str) -> DataFrame:
    """One row per idx."""
    return latest(table(spark, path, "index_paras"), "idx", "title", "doc_id", "para_idx", "text")


def firsts(spark: SparkSession, path: str) -> DataFrame:
    """First paragraphs, one per document, as the title table."""
    return paras(spark, path).where("para_idx = 0 and title is not null").select("idx", "title", "doc_id")


def links(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, para_no, link): the links of every paragraph."""
    pages = table(spark, path, "wiki_docs").where("doc_id is not null and payload is not null").select(F.col("doc_id").alias("rec_id"), "payload")
    return pages.mapInArrow(shredding.page_links, "doc_id bigint, para_no int, link string").distinct()


@query(f"with {_DOCS}, {_FIRST} select {_KEY.format('title')} as key, count(*) as n, min(idx) as first_idx from firsts group by 1")
def j01_title_index(spark: SparkSession, path: str) -> DataFrame:
    return lookups.title_index(firsts(spark, path)).select("key", "n", "first_idx").distinct()


@query(f"with {_DOCS}, {_FIRST} select idx, title, {_KEY.format('title')} as key from firsts")
def j02_inverted_title_index(spark: SparkSession, path: str) -> DataFrame:
    return lookups.title_index(firsts(spark, path)).select("idx", "title", "key")


@query(f"{_WITH} select distinct link, title, status, idx from mapped")
def j03_map_titles(spark: SparkSession, path: str) -> DataFrame:
    """Every link resolved with its outcome."""
    return lookups.map_titles(links(spark, path).select("link").distinct(), firsts(spark, path)).select("link", "title", "status", "idx")


@query(f"{_WITH} select status, count(*) as n from mapped group by status")
def j04_title_status(spark: SparkSession, path: str) -> DataFrame:
    return lookups.map_titles(links(spark, path), firsts(spark, path)).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""with {_PAGES}, {_DOCS}, p as (select doc_id, para_no, lower(trim(para ->> '$.text')) as t from paras where para ->> '$.text' is not null)
select d.idx, min(p.para_no) as para_no from docs d join p on cast(d.doc_id as bigint) = p.doc_id and contains(p.t, lower(trim(d.text))) where length(trim(d.text)) > 0 group by d.idx""")
def j05_match_paragraph(spark: SparkSession, path: str) -> DataFrame:
    """First paragraph of the same page that contains the index paragraph."""
    pages = shredding.page_tables(table(spark, path, "wiki_docs"))[0].where("text is not null").select(F.col("rec_id").alias("page"), "para_no", F.lower(F.trim("text")).alias("t"))
    rows = paras(spark, path).select("idx", F.col("doc_id").cast("bigint").alias("page"), F.lower(F.trim("text")).alias("part")).where("length(part) > 0")
    return rows.join(pages, "page").where(F.contains("t", "part")).groupBy("idx").agg(F.min("para_no").alias("para_no"))


@query("""with r as (select distinct sample_uid, coalesce(src, 'hotpotqa') as src, unnest(list_transform(pos_paras, lambda p: p.title)) as title from mdr_samples) select title, src, count(distinct sample_uid) as n from r where title is not null group by title, src""")
def j07_titles_per_source(spark: SparkSession, path: str) -> DataFrame:
    """Gold titles with the number of records per source."""
    rows = table(spark, path, "mdr_samples").select("sample_uid", F.coalesce("src", F.lit("hotpotqa")).alias("src"), F.explode("pos_paras.title").alias("title")).where("title is not null")
    return rows.groupBy("title", "src").agg(F.countDistinct("sample_uid").alias("n"))


@query(f"{_WITH} select distinct m.doc_id, m.para_no, m.idx from mapped m join firsts f on f.idx = m.idx where m.idx <> -1 and cast(f.doc_id as bigint) <> m.doc_id")
def j08_linked_documents(spark: SparkSession, path: str) -> DataFrame:
    """One hop over the links of every paragraph, without links to the page itself."""
    first = firsts(spark, path)
    mapped = lookups.map_titles(links(spark, path), first).where("idx <> -1").select("doc_id", "para_no", "idx")
    own = first.select("idx", F.col("doc_id").cast("bigint").alias("doc_id"))
    return mapped.join(own, ["idx", "doc_id"], "left_anti").select("doc_id", "para_no", "idx").distinct()


@query(f"with {_DOCS} select doc_id, string_agg(text, ' ' order by para_idx, idx) as text from docs where para_idx in (0, 1, 2) and text is not null group by doc_id")
def j09_paragraphs_of_documents(spark: SparkSession, path: str) -> DataFrame:
    """The first paragraphs of every document, joined in order."""
    rows = paras(spark, path).where("para_idx in (0, 1, 2) and text is not null")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("para_idx", "idx", "text"))), lambda x: x["text"])
    return rows.groupBy("doc_id").agg(F.array_join(parts, " ").alias("text"))


@query(f"""with {_DOCS}, {_FIRST}, r as (select distinct sample_uid, unnest(list_transform(pos_paras, lambda p: p.title)) as title from mdr_samples), e as (select title, min(idx) as idx from firsts group by title)
select sample_uid, r.title, coalesce(e.idx, -1) as idx from r left join e using (title) where r.title is not null""")
def j10_paragraph_documents(spark: SparkSession, path: str) -> DataFrame:
    """Gold titles with the idx of their document, -1 where none matches."""
    titles = table(spark, path, "mdr_samples").select("sample_uid", F.explode("pos_paras.title").alias("title")).where("title is not null").distinct()
    index = firsts(spark, path).groupBy("title").agg(F.min("idx").alias("idx"))
    return titles.join(index, "title", "left").select("sample_uid", "title", F.coalesce("idx", F.lit(-1)).alias("idx"))


@query("""with r as (select distinct on (sample_uid) sample_uid, pos_paras from mdr_samples order by sample_uid, loaded_at desc), e as (select sample_uid, unnest(list_transform(pos_paras, lambda p: p.title)) as title, generate_subscripts(pos_paras, 1) - 1 as pos from r)
select sample_uid, title, list(cast(pos as integer) order by pos) as positions from e group by sample_uid, title""")
def j11_title_positions(spark: SparkSession, path: str) -> DataFrame:
    rows = latest(table(spark, path, "mdr_samples"), "sample_uid", "pos_paras").select("sample_uid", F.posexplode("pos_paras.title").alias("pos", "title"))
    return rows.groupBy("sample_uid", "title").agg(F.array_sort(F.collect_list("pos")).alias("positions"))


_QK = f"regexp_replace({S.strip('question')}, '[?!:. ]+$', '')"


@query(f"""with {_RR}, l as (select distinct on (k) rr_uid, {_QK} as k from rr where question <> '' order by k, rr_uid desc),
m as (select distinct on (sample_uid) sample_uid, {_QK} as k, pos_paras from mdr_samples where question <> '' order by sample_uid, loaded_at desc),
g as (select k, sum(coalesce(len(pos_paras), 0)) as n from m group by k)
select rr_uid, coalesce(n, 0) as added from l left join g using (k)""")
def j14_merge_positives(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs that join a ranking record by its normalised question; of equal left keys the last remains."""
    key = lookups.question_key(F.col("question")).alias("k")
    left = ranking(spark, path).where("question <> ''").select("rr_uid", key).groupBy("k").agg(F.max("rr_uid").alias("rr_uid"))
    right = latest(table(spark, path, "mdr_samples").where("question <> ''"), "sample_uid", "question", "pos_paras")
    added = right.select(key, F.when(F.col("pos_paras").isNull(), 0).otherwise(F.size("pos_paras")).alias("n")).groupBy("k").agg(F.sum("n").alias("n"))
    return left.join(added, "k", "left").select("rr_uid", F.coalesce("n", F.lit(0)).alias("added"))


@query(f"""with {_RR}, l as (select rr_uid, question as q, lower({_QK}) as k from rr where question <> ''),
m as (select distinct sample_uid, question as q, lower({_QK}) as k from mdr_samples where question <> ''),
e as (select q, min(sample_uid) as u from m group by q), o as (select k, min(sample_uid) as u from m group by k)
select rr_uid, coalesce(e.u, o.u) as sample_uid, case when e.u is not null then 'exact' when o.u is not null then 'loose' else 'none' end as how from l left join e using (q) left join o using (k)""")
def j16_cascade(spark: SparkSession, path: str) -> DataFrame:
    """Ranking records with the sample of the same question, exactly or else by the normalised question."""
    left = ranking(spark, path).where("question <> ''")
    right = table(spark, path, "mdr_samples").where("question <> ''").select("sample_uid", "question").distinct()
    return lookups.first_hit(left, right, "rr_uid", "question", "sample_uid")


@query(f"""select min(sample_uid) as sample_uid from mdr_samples where question <> '' and lower(trim(split)) = 'train' and {_QK} in (select {_QK} from mdr_samples where question <> '' and lower(trim(split)) in ('dev', 'test')) group by {_QK}""")
def j17_filter_to_unique(spark: SparkSession, path: str) -> DataFrame:
    """First training record of every normalised question that also is in a list, here that of the evaluation records."""
    rows = table(spark, path, "mdr_samples").where("question <> ''").select("sample_uid", F.lower(F.trim("split")).alias("split"), lookups.question_key(F.col("question")).alias("k"))
    wanted = rows.where(F.col("split").isin("dev", "test")).select("k")
    return rows.where("split = 'train'").join(wanted, "k", "left_semi").groupBy("k").agg(F.min("sample_uid").alias("sample_uid")).select("sample_uid")


@query(f"""with {_DOCS}, s as (select distinct sent_uid, idx, s_idx from evidence_sents), p as (select distinct on (idx) idx, sentence_spans, text from index_paras order by idx, loaded_at desc)
select sent_uid, s.idx, s_idx, p.sentence_spans[s_idx + 1][1] as s, p.sentence_spans[s_idx + 1][2] as e from s join p using (idx)""")
def j18_span_annotation(spark: SparkSession, path: str) -> DataFrame:
    """Evidence sentences with the span of their position in the paragraph."""
    sents = table(spark, path, "evidence_sents").select("sent_uid", "idx", "s_idx").distinct()
    spans = latest(table(spark, path, "index_paras"), "idx", "sentence_spans")
    span = F.get("sentence_spans", F.col("s_idx"))
    return sents.join(spans, "idx").select("sent_uid", "idx", "s_idx", F.get(span, F.lit(0)).alias("s"), F.get(span, F.lit(1)).alias("e"))


@query("""with i as (select distinct title, strip_accents(title) as bare from index_paras where title is not null), b as (select bare, min(title) as title from i group by bare),
q as (select distinct strip_accents(title) as probe from evidence_sents where title is not null) select probe, coalesce(i.title, b.title) as title from q left join (select distinct title from i) i on i.title = probe left join b on b.bare = probe""")
def j19_unaccented_fallback(spark: SparkSession, path: str) -> DataFrame:
    """Titles without accents found exactly, else by the title without its accents."""
    from tessel.functions.udf import strip_accents

    index = table(spark, path, "index_paras").where("title is not null").select("title").distinct()
    bare = index.groupBy(strip_accents("title").alias("probe")).agg(F.min("title").alias("loose"))
    probes = table(spark, path, "evidence_sents").where("title is not null").select("title").distinct().select(strip_accents("title").alias("probe")).distinct()
    found = probes.join(index.withColumn("probe", F.col("title")), "probe", "left").join(bare, "probe", "left")
    return found.select("probe", F.coalesce("title", "loose").alias("title"))


@query(f"""with {_DOCS}, old as (select distinct on (idx) idx, for_hotpot from index_paras order by idx, loaded_at desc), new as (select idx, bool_or(s2_score > 0.5) as flag from evidence_sents where not isnan(s2_score) group by idx)
select old.idx, coalesce(new.flag, old.for_hotpot) as flag from old left join new using (idx)""")
def j20_overwrite_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels replaced where new ones exist."""
    old = latest(table(spark, path, "index_paras"), "idx", "for_hotpot")
    new = table(spark, path, "evidence_sents").where("not isnan(s2_score)").groupBy("idx").agg(F.bool_or(F.col("s2_score") > 0.5).alias("flag"))
    return old.join(new, "idx", "left").select("idx", F.coalesce("flag", "for_hotpot").alias("flag"))


@query("""with r as (select distinct sample_uid, coalesce(answers[1], '') as ans, unnest(list_transform(neg_paras, lambda p: {'t': p.text, 's': coalesce(p.src, 'none')})) as n from mdr_samples where neg_paras is not null)
select sample_uid, lower(n.t) as text, array_to_string(list_sort(list_distinct(list(n.s))), '+') as src from r where n.t is not null and (lower(ans) in ('yes', 'no', '') or not contains(lower(n.t), lower(ans))) group by sample_uid, lower(n.t)""")
def j23_consolidate_negatives(spark: SparkSession, path: str) -> DataFrame:
    """Negatives once per text with their sources; those that hold the answer are dropped, except for yes and no."""
    rows = table(spark, path, "mdr_samples").where("neg_paras is not null").select("sample_uid", F.lower(F.coalesce(F.get("answers", F.lit(0)), F.lit(""))).alias("ans"), F.explode("neg_paras").alias("n"))
    rows = rows.select("sample_uid", "ans", F.lower("n.text").alias("text"), F.coalesce("n.src", F.lit("none")).alias("src")).where("text is not null")
    kept = rows.where(F.col("ans").isin("yes", "no", "") | ~F.contains("text", "ans"))
    return kept.groupBy("sample_uid", "text").agg(F.array_join(F.array_sort(F.collect_set("src")), "+").alias("src"))


_SQUAD = S.SQUAD.format("a")


@query(f"""with a as (select distinct sample_uid, lower(trim(split)) = 'train' as t, unnest(answers) as a from mdr_samples where split is not null), n as (select sample_uid, t, {_SQUAD} as k from a where a is not null),
tok as (select distinct unnest(string_split(k, ' ')) as w from n where t and k <> '')
select distinct sample_uid, k as answer from n where not t and k <> '' and not exists (select 1 from (select unnest(string_split(n.k, ' ')) as w) x where x.w in (select w from tok))""")
def j25_answers_not_in_train(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation answers that share no token with any training answer: an anti-join of tokens, not of pairs."""
    from tessel.functions.metrics import squad

    rows = table(spark, path, "mdr_samples").where("split is not null").select("sample_uid", (F.lower(F.trim("split")) == "train").alias("t"), F.explode("answers").alias("a"))
    keys = rows.where("a is not null").select("sample_uid", "t", squad(F.col("a")).alias("answer")).where("answer <> ''").distinct()
    tokens = keys.select("*", F.explode(F.split("answer", " ")).alias("w"))
    seen = tokens.where("not t").join(tokens.where("t").select("w").distinct(), "w", "left_semi").select("answer").distinct()
    return keys.where("not t").join(seen, "answer", "left_anti").select("sample_uid", "answer").distinct()


@query("""with s as (select distinct coalesce(src, 'hotpotqa') as src, lower(trim(split)) as sp, unnest(list_transform(pos_paras, lambda p: p.title)) as title from mdr_samples where split is not null),
d as (select distinct src, title from s where sp <> 'train' and title is not null), t as (select distinct src, title from s where sp = 'train' and title is not null)
select d.src, count(*) as eval_titles, count(t.title) as in_train from d left join t on t.src = d.src and t.title = d.title group by d.src""")
def j26_split_title_overlap(spark: SparkSession, path: str) -> DataFrame:
    """Distinct evaluation titles per source and how many of them are in the training split."""
    rows = table(spark, path, "mdr_samples").where("split is not null").select(F.coalesce("src", F.lit("hotpotqa")).alias("src"), (F.lower(F.trim("split")) == "train").alias("t"), F.explode("pos_paras.title").alias("title")).where("title is not null")
    sides = rows.groupBy("src", "title").agg(F.bool_or("t").alias("train"), F.bool_or(~F.col("t")).alias("held")).where("held")
    return sides.groupBy("src").agg(F.count("*").alias("eval_titles"), F.sum(F.col("train").cast("bigint")).alias("in_train"))


@query("select count(*) as before, (select count(*) from (select distinct title, text, lang, source from documents)) as after from documents")
def d01_dedup_counts(spark: SparkSession, path: str) -> DataFrame:
    """Rows before and after exact deduplication without the key."""
    docs = table(spark, path, "documents")
    return docs.agg(F.count("*").alias("before")).join(docs.select("title", "text", "lang", "source").distinct().agg(F.count("*").alias("after")))


@query("select text, count(*) as n, min(doc_id) as first from documents where text is not null group by text having count(*) > 1")
def d02_duplicates(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, "documents").where("text is not null").groupBy("text").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query("""with q as (select distinct query_uid, list_sort(list_distinct(sp)) as k from iter_queries where sp is not null) select min(query_uid) as query_uid, k as titles from q group by k""")
def d03_dedup_as_sets(spark: SparkSession, path: str) -> DataFrame:
    """Title lists once per set of titles, the first kept."""
    rows = table(spark, path, "iter_queries").where("sp is not null").select("query_uid", F.array_sort(F.array_distinct("sp")).alias("titles"))
    return rows.groupBy("titles").agg(F.min("query_uid").alias("query_uid")).select("query_uid", "titles")


@query("""with s as (select query_uid, sent_uid, any_value(trim(lower(sentence))) as t from evidence_sents where sentence is not null and length(trim(sentence)) >= 20 group by query_uid, sent_uid),
u as (select query_uid, t, max(sent_uid) as sent_uid from s group by query_uid, t)
select query_uid, sent_uid from u where not exists (select 1 from u v where v.query_uid = u.query_uid and v.t <> u.t and contains(v.t, u.t))""")
def d04_substring_filter(spark: SparkSession, path: str) -> DataFrame:
    """Sentences of a query that are long enough and not contained in another; of equal ones the last stays.

    Containment is tested only against sentences that hold the contained one's longest word, so no group is paired with itself.
    """
    rows = table(spark, path, "evidence_sents").where("sentence is not null").select("query_uid", "sent_uid", F.trim(F.lower("sentence")).alias("t")).where("length(t) >= 20")
    once = rows.groupBy("query_uid", "t").agg(F.max("sent_uid").alias("sent_uid"))
    inner = F.filter(F.slice(F.split("t", " "), 2, 1 << 20), lambda w: F.length(w) > 0)
    inner = F.slice(inner, 1, F.greatest(F.size(inner) - 1, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    anchors = once.select("query_uid", "t", "sent_uid", longest.alias("w"))
    held = once.select("query_uid", F.col("t").alias("other"), F.explode(F.array_distinct(F.split("t", " "))).alias("w"))
    covered = anchors.where("w is not null").join(held, ["query_uid", "w"]).where((F.col("t") != F.col("other")) & F.contains("other", "t")).select("query_uid", "sent_uid").distinct()
    return once.join(covered, ["query_uid", "sent_uid"], "left_anti").select("query_uid", "sent_uid")


@query("select distinct sample_uid from mdr_samples where coalesce(src, 'hotpotqa') <> 'squad'")
def d05_without_source(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, "mdr_samples").where(F.coalesce("src", F.lit("hotpotqa")) != "squad").select("sample_uid").distinct()


@query("""select 'mdr' as origin, sample_uid as uid, question, sample_type from (select distinct sample_uid, question, sample_type from mdr_samples)
union all select 'rr', rr_uid, question, null from (select distinct rr_uid, question from rr_samples) union all select 'query', query_uid, question, sample_type from (select distinct query_uid, question, sample_type from iter_queries)""")
def d07_union(spark: SparkSession, path: str) -> DataFrame:
    """Union of three record tables, missing columns null."""
    of = lambda name, key, *more: table(spark, path, name).select(F.lit(name.split("_")[0] if name != "iter_queries" else "query").alias("origin"), F.col(key).alias("uid"), "question", *more).distinct()
    return of("mdr_samples", "sample_uid", "sample_type").unionByName(of("rr_samples", "rr_uid"), allowMissingColumns=True).unionByName(of("iter_queries", "query_uid", "sample_type"))


_SPANS = "distinct on (idx) idx, doc_id, para_idx, text, sentence_spans from index_paras where text is not null and sentence_spans is not null order by idx, loaded_at desc"


@query(f"""with p as (select {_SPANS}) select a.idx, b.idx as next_idx, a.text || ' ' || b.text as text, list_concat(a.sentence_spans, list_transform(b.sentence_spans, lambda s: [s[1] + length(a.text) + 1, s[2] + length(a.text) + 1])) as spans
 from p a join p b on a.doc_id = b.doc_id and b.para_idx = a.para_idx + 1""")
def d10_merge_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """Neighbouring paragraphs merged, the second's spans shifted."""
    p = latest(table(spark, path, "index_paras").where("text is not null and sentence_spans is not null"), "idx", "doc_id", "para_idx", "text", "sentence_spans")
    b = p.select("doc_id", (F.col("para_idx") - 1).alias("para_idx"), F.col("idx").alias("next_idx"), F.col("text").alias("t"), F.col("sentence_spans").alias("sp"))
    both = p.join(b, ["doc_id", "para_idx"]).withColumn("by", F.length("text") + 1)
    shifted = F.transform("sp", lambda s: F.array(F.get(s, F.lit(0)) + F.col("by"), F.get(s, F.lit(1)) + F.col("by")))
    return both.select("idx", "next_idx", F.concat("sentence_spans", shifted).alias("spans"), F.concat_ws(" ", "text", "t").alias("text"))


@query("""with p as (select doc_id, para_idx, idx from index_paras group by all), d as (select doc_id, para_idx, lead(para_idx) over (partition by doc_id order by para_idx, idx) - para_idx as gap from p)
select gap, count(*) as n from d where gap is not null group by gap""")
def a36_paragraph_gaps(spark: SparkSession, path: str) -> DataFrame:
    """Histogram of the distances between neighbouring paragraphs of a document."""
    p = table(spark, path, "index_paras").select("doc_id", "para_idx", "idx").distinct()
    gap = F.lead("para_idx").over(Window.partitionBy("doc_id").orderBy("para_idx", "idx")) - F.col("para_idx")
    return p.select(gap.alias("gap")).where("gap is not null").groupBy("gap").agg(F.count("*").alias("n"))


@query(f"with {_DOCS} select doc_id, idx, {S.strip('text')} as text from docs where text is not null and len({S.words('text')}) > 8")
def proj36_long_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs of more than eight words; positions of the dropped ones stay taken."""
    return paras(spark, path).where("text is not null").where(F.size(T.words("text")) > 8).select("doc_id", "idx", T.strip("text").alias("text"))
