"""Text functions over whole tables (T)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.catalog import query
from tessel.functions import sql as S
from tessel.functions import text as T
from tessel.functions import udf
from tessel.sources.tables import table


def on_documents(name: str, build: Callable[[Column], Column], sql: str | None, where: str = "text is not null") -> None:
    """Register a function of documents.text as (doc_id, value)."""

    def run(spark: SparkSession, path: str) -> DataFrame:
        return table(spark, path, "documents").where(where).select("doc_id", build(F.col("text")).alias("value"))

    query(sql and f"select doc_id, {sql} as value from documents where {where}", name=name)(run)


_CLEAN = r"regexp_replace(regexp_replace(text, '[\t\n\r]|\p{Zs}', ' ', 'g'), '[\p{Cc}\p{Cf}\x{fffd}]', '', 'g')"
_CHARS = S.replace_all(S.squeeze("text"), T.REWRITES)
_ENDED = f"case when v = '' or contains('.?!:;', right(v, 1)) then v else v || '.' end"

on_documents("t01_norm_text", T.norm_text, S.squeeze(_CLEAN))
on_documents("t02_clean_text", T.clean, _CLEAN)
on_documents("t05_convert_brackets", lambda x: T.convert_brackets(F.concat(F.lit("-LRB-"), x, F.lit("-RRB-"))), S.replace_all("'-LRB-' || text || '-RRB-'", T.BRACKETS.items()))
on_documents("t06_replace_control", T.replace_control, r"regexp_replace(text, '[^\P{C}\t\n\r]', ' ', 'g')")
on_documents("t07_squeeze", T.squeeze, S.squeeze("text"))
on_documents("t08_replace_chars", lambda x: T.replace_chars(T.squeeze(x)), _CHARS)
on_documents("t11_drop_stop_words", T.drop_stop_words, f"array_to_string(list_filter(string_split(text, ' '), lambda w: lower(w) not in {S.STOPS}), ' ')")
on_documents("t29_simple_tokens", T.simple_tokens, S.TOKENS.format("text"))
on_documents("t46_fix_number_spacing", T.fix_number_spacing, r"regexp_replace(text, '([a-z,:;>])([0-9-])', '\1 \2', 'g')")
on_documents("proj34_remove_tags", lambda x: T.remove_tags(F.concat(F.lit("<b>"), x, F.lit("</b>"))), "regexp_replace('<b>' || text || '</b>', '<[^>]*>', '', 'g')")
on_documents(
    "t32_ngrams", lambda x: T.ngrams(T.words(x), 3),
    f"(with w as (select {S.words('text')} as t) select flatten(list_transform(range(len(t)), lambda i: list_transform(range(1, least(3, len(t) - i) + 1), lambda n: array_to_string(t[i + 1 : i + n], ' ')))) from w)",
)
# decomposed, without marks; composed again only to compare the two engines
on_documents("t04_strip_accents", udf.fold, "nfc_normalize(strip_accents(text))")


@query(f"""select doc_id, word, cast(pos - 1 as integer) as pos from (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as pos from (select doc_id, {S.words("text")} as w from documents where text is not null)) where lower(word) not in {S.STOPS}""")
def t12_kept_words(spark: SparkSession, path: str) -> DataFrame:
    """Words that are no stop words, with their positions."""
    kept = table(spark, path, "documents").where("text is not null").select("doc_id", F.explode(T.kept_words(T.words("text"))).alias("k"))
    return kept.select("doc_id", "k.word", "k.pos")


@query(f"select doc_id, case when v = '' then '' else upper(left(v, 1)) || substr(v, 2) end as value from (select doc_id, {_ENDED} as v from (select doc_id, {_CHARS} as v from documents where text is not null))")
def t09_format_sentence(spark: SparkSession, path: str) -> DataFrame:
    """Squeezed, rewritten, closed and capitalised texts."""
    return table(spark, path, "documents").where("text is not null").select("doc_id", T.format_sentence("text").alias("value"))


@query(rf"""select doc_id, cast(i as integer) as pos, s as sentence from (select doc_id, unnest(l) as s, generate_subscripts(l, 1) - 1 as i from
 (select doc_id, list_filter(list_transform(string_split(regexp_replace({S.strip("text")}, '([.!?]){S.WS}+', '\1' || chr(1), 'g'), chr(1)), lambda s: {S.strip("s")}), lambda s: s <> '') as l
  from documents where text is not null))""")
def t10_sentences(spark: SparkSession, path: str) -> DataFrame:
    """One row per sentence."""
    return table(spark, path, "documents").where("text is not null").select("doc_id", F.posexplode(T.sentences("text")).alias("pos", "sentence"))


@query("""select doc_id, cast(i as integer) as para_no, p as para, doc_id || '_' || i as para_id from (select doc_id, unnest(l) as p, generate_subscripts(l, 1) - 1 as i from
 (select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '<[^>]*>', '', 'g'), chr(10)), lambda s: """ + S.strip("s") + """), lambda s: s <> '') as l from documents where text is not null))""")
def proj35_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """One row per paragraph with its key, document id and position."""
    rows = table(spark, path, "documents").where("text is not null").select("doc_id", F.posexplode(T.paragraphs("text")).alias("para_no", "para"))
    return rows.withColumn("para_id", F.concat_ws("_", "doc_id", "para_no"))


@query(rf"""with g as (select doc_id, unnest(list_transform(range(1, len(w)), lambda i: [w[i], w[i + 1]])) as g from (select doc_id, {S.words("text")} as w from documents where text is not null)),
f as (select doc_id, g, lower(g[1]) in {S.STOPS} or regexp_full_match(g[1], '\p{{P}}*') as a, lower(g[2]) in {S.STOPS} or regexp_full_match(g[2], '\p{{P}}*') as b from g)
select doc_id, count(*) as bigrams, count(*) filter (a or b) as any_filler, count(*) filter (a and b) as all_filler, count(*) filter (a or b) as end_filler from f group by doc_id""")
def t33_filter_ngrams(spark: SparkSession, path: str) -> DataFrame:
    """Numbers of bigrams that the three filter modes drop."""
    tokens = table(spark, path, "documents").where("text is not null").select("doc_id", T.words("text").alias("w")).where("size(w) > 1")
    grams = tokens.select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.slice("w", i, 2))).alias("g"))
    counts = [F.sum(T.keep_ngram(F.col("g"), m).cast("bigint")).alias(n) for m, n in (("any", "any_filler"), ("all", "all_filler"), ("ends", "end_filler"))]
    return grams.groupBy("doc_id").agg(F.count("*").alias("bigrams"), *counts)


@query(rf"""select token, n, lower(token) in {S.STOPS} or regexp_full_match(token, '\p{{P}}*') as filler from
(select token, count(*) as n from (select unnest({S.TOKENS.format("text")}) as token from documents where text is not null) group by token)""")
def t34_filter_words(spark: SparkSession, path: str) -> DataFrame:
    """Token counts with the filler flag."""
    tokens = table(spark, path, "documents").where("text is not null").select(F.explode(T.simple_tokens("text")).alias("token"))
    return tokens.groupBy("token").agg(F.count("*").alias("n")).withColumn("filler", T.is_filler(F.col("token")))


@query(rf"""with r as (select distinct on (sample_uid) sample_uid, answers, pos_paras from mdr_samples where answers is not null and pos_paras is not null order by sample_uid, loaded_at desc),
p as (select sample_uid, answers, cast(i as integer) as para_no, text from (select sample_uid, answers, unnest(list_transform(pos_paras, lambda x: x.text)) as text, generate_subscripts(pos_paras, 1) - 1 as i from r))
select sample_uid, para_no, coalesce(list_bool_or(list_transform(list_filter(answers, lambda a: a is not null and len({S.TOKENS.format("lower(a)")}) > 0),
 lambda a: contains(chr(1) || array_to_string({S.TOKENS.format("lower(text)")}, chr(1)) || chr(1), chr(1) || array_to_string({S.TOKENS.format("lower(a)")}, chr(1)) || chr(1)))), false) as has_answer from p where text is not null""")
def t35_para_has_answer(spark: SparkSession, path: str) -> DataFrame:
    """Whether any answer is a run of tokens of each positive paragraph."""
    from tessel.sources.tables import latest

    rows = latest(table(spark, path, "mdr_samples").where("answers is not null and pos_paras is not null"), "sample_uid", "answers", "pos_paras")
    paras = rows.select("sample_uid", "answers", F.posexplode("pos_paras.text").alias("para_no", "text")).where("text is not null")
    tokens = paras.select("sample_uid", "para_no", "answers", T.simple_tokens(F.lower("text")).alias("tokens"))
    given = F.filter("answers", lambda a: a.isNotNull())
    found = F.exists(given, lambda a: T.contains_tokens(F.col("tokens"), T.simple_tokens(F.lower(a))))
    return tokens.select("sample_uid", "para_no", found.alias("has_answer"))


@query(r"""select l_orderkey, l_linenumber, case when l_extendedprice < 0 then '- ' else '' end || array_to_string(list_transform(range(len(d)),
 lambda i: d[i + 1 : i + 1] || ' 10e' || (len(d) - 1 - i - 2)), ' ') as value from (select l_orderkey, l_linenumber, l_extendedprice,
 lpad(c, cast(greatest(3, len(c)) as integer), '0') as d from (select *, cast(cast(round(abs(l_extendedprice) * 100) as bigint) as varchar) as c from lineitem))""")
def t23_base_ten(spark: SparkSession, path: str) -> DataFrame:
    """Prices with two decimals in place notation."""
    cents = F.round(F.abs("l_extendedprice") * 100).cast("bigint").cast("string")
    padded = F.when(F.length(cents) < 3, F.lpad(cents, 3, "0")).otherwise(cents)
    number = F.concat(F.when(F.col("l_extendedprice") < 0, "-").otherwise(""), F.regexp_replace(padded, "(..)$", ".$1"))
    return table(spark, path, "lineitem").select("l_orderkey", "l_linenumber", T.base_ten(number).alias("value"))


@query(r"""select doc_id, flatten(list_transform(string_split('Ġ' || replace(text, ' ', ' Ġ'), ' '), lambda p: case when regexp_full_match(p, '[Ġ0-9.,^$-]+') and p <> 'Ġ'
 then list_transform(string_split(replace(p, 'Ġ', ''), ''), lambda d, i: case when i = 1 and p[1] = 'Ġ' then 'Ġ' || d else d end) else [p] end)) as value from documents where text is not null and doc_kind = 'table'""")
def t27_split_digits(spark: SparkSession, path: str) -> DataFrame:
    """Word pieces of table texts with numbers cut into digits."""
    pieces = F.split(F.concat(F.lit("Ġ"), F.replace("text", F.lit(" "), F.lit(" Ġ"))), " ")
    return table(spark, path, "documents").where("text is not null and doc_kind = 'table'").select("doc_id", T.split_digits(pieces).alias("value"))


@query("select p_partkey, format('{:x}', p_partkey) as hex, format('{:b}', p_partkey) as bin from part")
def t28_convert_base(spark: SparkSession, path: str) -> DataFrame:
    """Keys to base 16 and 2."""
    convert = lambda b: F.lower(F.conv(F.col("p_partkey").cast("string"), 10, b))
    return table(spark, path, "part").select("p_partkey", convert(16).alias("hex"), convert(2).alias("bin"))


@query(rf"""select sent_uid, regexp_replace({S.strip(r"regexp_replace(regexp_replace(' ' || sentence || ' ', '[^\p{L}\p{N}\p{M}_]+' || q || '[^\p{L}\p{N}\p{M}_]+', ', WHAT ', 'g'), '^,\s*', '')")}, ',$', '') as awb from
 (select sent_uid, any_value(sentence) as sentence, regexp_replace(any_value(title), '([^A-Za-z0-9 ])', '\\\1', 'g') as q from evidence_sents where sentence is not null and title is not null group by sent_uid)
 where regexp_full_match(q, '[A-Za-z0-9 ]+')""")
def t20_cloze_awb(spark: SparkSession, path: str) -> DataFrame:
    """Sentences with their title asked for; titles of plain letters and blanks."""
    from tessel.sources.tables import latest

    rows = latest(table(spark, path, "evidence_sents").where("sentence is not null and title is not null"), "sent_uid", "sentence", "title")
    return rows.where(F.col("title").rlike("^[A-Za-z0-9 ]+$")).select("sent_uid", T.cloze_awb(F.col("sentence"), F.col("title"), "WHAT").alias("awb"))


@query(rf"""select sent_uid, trim(regexp_replace(regexp_replace({S.strip(r"regexp_replace(' ' || sentence || ' ', '^(.*?)[^\p{L}\p{N}\p{M}_]+' || regexp_escape(title) || '[^\p{L}\p{N}\p{M}_]+(.*?)[^\p{L}\p{N}\p{M}_]*$', 'What \2, \1')")}, '^,\s*', ''), '\s+', ' ', 'g')) as wba from
 (select sent_uid, any_value(sentence) as sentence, any_value(title) as title from evidence_sents where sentence is not null and title is not null group by sent_uid)""")
def t21_cloze_wba(spark: SparkSession, path: str) -> DataFrame:
    from tessel.sources.tables import latest

    rows = latest(table(spark, path, "evidence_sents").where("sentence is not null and title is not null"), "sent_uid", "sentence", "title")
    return rows.select("sent_uid", T.cloze_wba(F.col("sentence"), F.col("title"), "What").alias("wba"))


@query("""with e as (select user_id, event_id, event_type, row_number() over (partition by user_id order by ts, event_id) as n,
 row_number() over (partition by user_id, event_type order by ts, event_id) as m from events)
select user_id, event_type, cast(min(n) as integer) as first_no, count(*) as length from e group by user_id, event_type, n - m""")
def t38_runs(spark: SparkSession, path: str) -> DataFrame:
    """Runs of equal event types of each user."""
    from pyspark.sql import Window

    by = lambda *k: Window.partitionBy(*k).orderBy("ts", "event_id")
    numbered = table(spark, path, "events").select(
        "user_id", "event_type", F.row_number().over(by("user_id")).alias("n"), F.row_number().over(by("user_id", "event_type")).alias("m")
    )
    return numbered.groupBy("user_id", "event_type", (F.col("n") - F.col("m")).alias("run")).agg(F.min("n").alias("first_no"), F.count("*").alias("length")).drop("run")


_SENT = S.close(S.strip("sentence"))
_EVID = f"(select distinct query_uid, hop, idx, s_idx, sent_uid, title, sentence, score from evidence_sents where title is not null and sentence is not null and len({S.strip('sentence')}) > 0)"


@query(f"""with s as (select query_uid, hop, title, sent_uid, {_SENT} as sentence from {_EVID} where score > 0.2),
g as (select query_uid, hop, title, min(sent_uid) as first, ' ' || string_agg(sentence, ' ' order by sent_uid) as body from s group by all)
select query_uid, hop, trim(string_agg(' ' || {S.unescape("(" + S.strip("title") + " || ':')")} || ' ' || body, '' order by first)) as context from g group by query_uid, hop""")
def t39_aggregate_sentences(spark: SparkSession, path: str) -> DataFrame:
    """Sentences above a score grouped by title in order of appearance, one context per query and hop."""
    s = T.close_sentence(T.strip("sentence"))
    rows = table(spark, path, "evidence_sents").where("title is not null and score > 0.2").select("query_uid", "hop", "title", "sent_uid", s.alias("sentence")).where("sentence <> ''").distinct()
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sent_uid", "sentence"))), lambda x: x["sentence"]), " ")
    titles = rows.groupBy("query_uid", "hop", "title").agg(F.min("sent_uid").alias("first"), joined.alias("body"))
    part = F.concat(F.lit(" "), T.unescape(F.concat(T.strip("title"), F.lit(":"))), F.lit("  "), F.col("body"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("first", part.alias("part")))), lambda x: x["part"])
    return titles.groupBy("query_uid", "hop").agg(F.trim(F.array_join(whole, "")).alias("context"))


@query(f"""select query_uid, hop, string_agg('[unused1] ' || {S.unescape(S.strip("title"))} || ' | ' || {_SENT}, ' ' order by sent_uid) as context from {_EVID} group by query_uid, hop""")
def t40_concat_title_sentences(spark: SparkSession, path: str) -> DataFrame:
    """Marked title and sentence pairs, one context per query and hop."""
    s = T.close_sentence(T.strip("sentence"))
    rows = table(spark, path, "evidence_sents").where("title is not null").select("query_uid", "hop", "title", "sent_uid", s.alias("sentence")).where("sentence <> ''").distinct()
    part = F.concat(F.lit("[unused1] "), T.unescape(T.strip("title")), F.lit(" | "), "sentence")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("sent_uid", part.alias("part")))), lambda x: x["part"])
    return rows.groupBy("query_uid", "hop").agg(F.array_join(parts, " ").alias("context"))


@query(None)
def t43_subword_offsets(spark: SparkSession, path: str) -> DataFrame:
    """Documents with a marker before every sentence: whole words, their first subwords, and where sentences start among the subwords."""
    from tessel.functions.subwords import MARKER, subwords

    marked = F.concat(F.lit(f"{MARKER} "), F.array_join(T.sentences("text"), f" {MARKER} "))
    rows = table(spark, path, "documents").where("text is not null").select("doc_id", subwords(spark, marked).alias("x"))
    return rows.select("doc_id", F.size("x.words").alias("n_words"), F.size("x.tokens").alias("n_tokens"), "x.first", "x.starts")
