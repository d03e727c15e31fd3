"""Record shaping over question-answering lines and tables (P)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.catalog import query
from tessel.functions import qa
from tessel.functions import sql as S
from tessel.functions import text as T
from tessel.sources.tables import latest, table

_LINES = r"""lines as (select doc_id, string_split(text, chr(9))[1] as q, string_split(text, chr(9))[2] as a from documents
 where doc_kind = 'uqa' and len(string_split(text, chr(9))) = 2)"""
_PARTS = r"parts as (select *, string_split(q, '\n') as p from lines)"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, q, a) of the record lines with exactly one tab."""
    rows = table(spark, path, "documents").where("doc_kind = 'uqa'").select("doc_id", F.split("text", "\t").alias("p")).where("size(p) = 2")
    return rows.select("doc_id", F.col("p")[0].alias("q"), F.col("p")[1].alias("a"))


_PARSED = f"""parsed as (select doc_id, a, {S.strip("p[1]")} as q_only,
 case when len(p) >= 2 then case when starts_with({S.strip("p[2]")}, '(A)') then {S.strip("p[2]")} else '' end end as mc_options,
 case when len(p) >= 2 then case when starts_with({S.strip("p[2]")}, '(A)') then coalesce({S.strip("p[3]")}, '') else {S.strip("p[2]")} end end as context from parts)"""
_WITH = f"with {_LINES}, {_PARTS}, {_PARSED}"


def parsed(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path).select("doc_id", "a", qa.parse(F.col("q")).alias("p")).select("doc_id", "a", "p.*")


@query(f"{_WITH} select doc_id, q_only, mc_options, context from parsed")
def proj01_parse(spark: SparkSession, path: str) -> DataFrame:
    """Question, options and context of every line."""
    return parsed(spark, path).drop("a")


@query(rf"{_WITH} select doc_id, list_filter(list_transform(string_split(regexp_replace(mc_options, '\([A-H]\) ', chr(1), 'g'), chr(1)), lambda o: {S.strip('o')}), lambda o: o <> '') as options from parsed where mc_options <> ''")
def proj02_options(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark, path).where("mc_options <> ''").select("doc_id", qa.options(F.col("mc_options")).alias("options"))


@query(rf"""{_WITH} select doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace({S.squeeze("mc_options")}, '(^| )\([A-Z]\)( |$)', chr(1), 'g'), ' *' || chr(1) || ' *', chr(1), 'g'), chr(1)), lambda o: trim(o)), lambda o: o <> '') as options from parsed where mc_options <> ''""")
def proj03_options_by_token(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark, path).where("mc_options <> ''").select("doc_id", qa.options_by_token(F.col("mc_options")).alias("options"))


@query(rf"{_WITH} select doc_id, {S.strip(r'''regexp_extract(mc_options, '\(B\)([^(]*)', 1)''')} as option_b from parsed where mc_options <> ''")
def proj04_option_after(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark, path).where("mc_options <> ''").select("doc_id", qa.option_after(F.col("mc_options"), "B").alias("option_b"))


_RR = "rr as (select distinct on (rr_uid) * from rr_samples order by rr_uid, loaded_at desc)"
_CTX = f"case when m <> '' and p <> '' then m || '\\n' || p when m <> '' then m when p <> '' then p end"
_MP = f"mp as (select rr_uid, question, answers, {S.strip("coalesce(mc_options, '')")} as m, {S.strip("coalesce(context, '')")} as p from rr)"
_BARE = lambda x: f"regexp_replace({S.strip(x)}, '[\\n\\t]', '', 'g')"


def ranking(spark: SparkSession, path: str) -> DataFrame:
    return latest(table(spark, path, "rr_samples"), "rr_uid", "src", "question", "answers", "pos_paras", "neg_paras", "mc_options", "context")


@query(f"""with {_RR}, {_MP} select rr_uid, regexp_replace(regexp_replace({_BARE("question")}, '[.!?]$', '') || '?', '\\?\\?$', '?') || ' \\n' ||
 case when {_CTX} is not null then ' ' || {_BARE("(" + _CTX + ")")} else '' end || case when len(answers) > 0 then ' ' || chr(9) || {_BARE("('#!#' || array_to_string(answers, '#!#') || '#!#')")} else '' end as line
 from mp where question <> ''""")
def proj05_example(spark: SparkSession, path: str) -> DataFrame:
    """Ranking records as lines with encoded answers."""
    rows = ranking(spark, path).where("question <> ''")
    answer = F.when(F.size("answers") > 0, qa.encode_answers(F.col("answers")))
    return rows.select("rr_uid", qa.example(F.col("question"), qa.context(F.col("mc_options"), F.col("context")), answer).alias("line"))


@query(f"with {_RR}, {_MP} select rr_uid, {_CTX} as context from mp")
def proj06_context(spark: SparkSession, path: str) -> DataFrame:
    return ranking(spark, path).select("rr_uid", qa.context(F.col("mc_options"), F.col("context")).alias("context"))


@query(rf"""with {_LINES} select doc_id, regexp_replace(regexp_replace({_BARE("string_split(q, '\\n')[1]")}, '[.!?]$', '') || '?', '\?\?$', '?') || ' \n' ||
 case when instr(q, '\n') > 0 and {S.strip(r"substr(q, instr(q, '\n') + 2)")} <> '' then ' ' || {_BARE(r"substr(q, instr(q, '\n') + 2)")} else '' end || case when {S.strip("a")} <> '' then ' ' || chr(9) || {_BARE("a")} else '' end as line from lines""")
def proj07_rebuild(spark: SparkSession, path: str) -> DataFrame:
    """Lines rebuilt from the part before the first separator and the rest."""
    at = F.instr("q", "\\n")
    rest = F.when(at > 0, T.strip(F.substring(F.col("q"), at + 2, F.lit(1 << 30))))
    question = F.when(at > 0, F.substring(F.col("q"), F.lit(1), at - 1)).otherwise(F.col("q"))
    return lines(spark, path).select("doc_id", qa.example(question, rest, T.strip("a")).alias("line"))


@query(f"with {_RR} select rr_uid, coalesce(answers[1], '<none>') as answer from rr")
def proj08_default_answer(spark: SparkSession, path: str) -> DataFrame:
    return ranking(spark, path).select("rr_uid", F.coalesce(F.get("answers", F.lit(0)), F.lit("<none>")).alias("answer"))


@query("select src, _id, rr_uid from (select *, row_number() over (partition by _id order by rr_uid desc) as rn from (select distinct _id, src, rr_uid from rr_samples where _id is not null)) where rn = 1")
def proj12_last_wins(spark: SparkSession, path: str) -> DataFrame:
    """One row per _id: the one with the greatest key."""
    rows = table(spark, path, "rr_samples").where("_id is not null")
    return rows.groupBy("_id").agg(F.max(F.struct("rr_uid", "src")).alias("m")).select("m.src", "_id", "m.rr_uid")


@query("""select query_uid, hop, coalesce(cast(sum(u) as double) / nullif(count(u), 0) / 10000, -1) as mean from (select distinct sent_uid, query_uid, hop, case when s2_score <> -1 and not isnan(s2_score) then cast(round(s2_score * 10000) as bigint) end as u from evidence_sents) group by query_uid, hop""")
def proj13_filtered_mean(spark: SparkSession, path: str) -> DataFrame:
    """Mean of the scores that apply, -1 where none does."""
    rows = table(spark, path, "evidence_sents").select("sent_uid", "query_uid", "hop", "s2_score").distinct()
    applies = F.when((F.col("s2_score") != -1) & ~F.isnan("s2_score"), F.col("s2_score"))
    units = F.round(applies * 10000).cast("bigint")
    mean = F.sum(units).cast("double") / F.nullif(F.count(units), F.lit(0)) / 10000
    return rows.groupBy("query_uid", "hop").agg(F.coalesce(mean, F.lit(-1.0)).alias("mean"))


@query("with r as (select distinct on (sample_uid) sample_uid, pos_paras from mdr_samples order by sample_uid, loaded_at desc) select sample_uid, flatten(list_transform(pos_paras, lambda p: p.sentence_labels)) as labels, list_distinct(list_transform(pos_paras, lambda p: p.title)) as titles_any_order from r where pos_paras is not null and len(pos_paras) = 1")
def proj14_flatten(spark: SparkSession, path: str) -> DataFrame:
    """Sentence labels flattened and distinct titles of records with one paragraph."""
    rows = latest(table(spark, path, "mdr_samples"), "sample_uid", "pos_paras").where("size(pos_paras) = 1")
    return rows.select("sample_uid", F.flatten(F.filter("pos_paras.sentence_labels", lambda x: x.isNotNull())).alias("labels"), F.array_distinct("pos_paras.title").alias("titles_any_order"))


@query("select title, min(idx) as idx from index_paras where title is not null group by title")
def proj15_unique_in_order(spark: SparkSession, path: str) -> DataFrame:
    """First occurrence of every title."""
    return table(spark, path, "index_paras").where("title is not null").groupBy("title").agg(F.min("idx").alias("idx"))


@query(r"""select idx, case when g = '' then title else replace(title, g, replace(replace(replace(g, '_', ' '), '(', ''), ')', ':')) end as title from (select idx, any_value(title) as title, regexp_extract(any_value(title), '\([^)]*\)') as g from index_paras where title is not null group by idx)""")
def proj20_reformat_title(spark: SparkSession, path: str) -> DataFrame:
    rows = latest(table(spark, path, "index_paras"), "idx", "title").where("title is not null")
    return rows.select("idx", qa.reformat_title(F.col("title")).alias("title"))


@query(f"{_WITH} select doc_id, 'answer: ' || q_only as question, 1 as const from parsed")
def proj21_prefix(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark, path).select("doc_id", F.concat(F.lit("answer: "), "q_only").alias("question"), F.lit(1).alias("const"))


@query("select doc_id, case when instr(text, 'Therefore ') > 0 then trim(split_part(text, 'Therefore ', 2)) else '' end as rationale from documents where doc_kind = 'rationale' and text is not null")
def proj22_extract_rationale(spark: SparkSession, path: str) -> DataFrame:
    """What stands between a fixed marker and its next occurrence."""
    marker = "Therefore "
    rows = table(spark, path, "documents").where("doc_kind = 'rationale' and text is not null")
    after = F.trim(F.get(F.split("text", marker), F.lit(1)))
    return rows.select("doc_id", F.coalesce(after, F.lit("")).alias("rationale"))


@query(rf"{_WITH} select doc_id, case when context <> '' then context || case when contains('.?!', right(context, 1)) then ' ' else '. ' end else '' end || q_only || case when mc_options <> '' then chr(10) || 'Answer Choices:' || chr(10) || mc_options else '' end as prompt from parsed")
def proj23_prompt(spark: SparkSession, path: str) -> DataFrame:
    """Context, question and options as a prompt."""
    c = F.when(F.col("context") != "", F.concat(T.close_sentence(F.col("context")), F.lit(" "))).otherwise("")
    m = F.when(F.col("mc_options") != "", F.concat(F.lit("\nAnswer Choices:\n"), "mc_options")).otherwise("")
    return parsed(spark, path).select("doc_id", F.concat(c, "q_only", m).alias("prompt"))


@query(rf"""with r as (select doc_id, {S.strip("string_split(substr(text, instr(text, chr(10)) + 1), chr(10))[1]")} as l from documents where doc_kind = 'rationale' and text is not null),
c as (select doc_id, l, case when regexp_matches(l, '(?is)^(.*)so the answer is(.*)$') then {S.strip("regexp_extract(l, '(?is)^(.*)so the answer is(.*)$', 1)")} else l end as b, {S.strip("regexp_replace(" + S.strip("regexp_extract(l, '(?is)^(.*)so the answer is(.*)$', 2)") + r", '\.$', '')")} as answer from r)
select doc_id, case when b = '' or contains('.?!:;', right(b, 1)) then b else b || '.' end as text, answer from c""")
def proj24_split_rationale(spark: SparkSession, path: str) -> DataFrame:
    """Rationale text and answer of the lines after the question."""
    rows = table(spark, path, "documents").where("doc_kind = 'rationale' and text is not null")
    rest = F.substring(F.col("text"), F.instr("text", "\n") + 1, F.lit(1 << 30))
    return rows.select("doc_id", qa.rationale(rest).alias("r")).select("doc_id", "r.*")


@query(f"{_WITH} select doc_id, replace(replace('Q: {{question}} C: {{context}} A:', '{{question}}', q_only), '{{context}}', coalesce(context, '')) as prompt from parsed")
def proj25_template(spark: SparkSession, path: str) -> DataFrame:
    filled = F.replace(F.lit("Q: {question} C: {context} A:"), F.lit("{question}"), F.col("q_only"))
    return parsed(spark, path).select("doc_id", F.replace(filled, F.lit("{context}"), F.coalesce("context", F.lit(""))).alias("prompt"))


_ATYPE = r"case when len(answers) > 1 then 'SPANS' when regexp_full_match(replace(answers[1], ',', ''), '-?[0-9]+(\.[0-9]+)?') then 'NUM' when regexp_matches(answers[1], '^[A-Z][a-z]+ [0-9]{1,2}, [0-9]{4}$') then 'DATE' else 'SPAN' end"


@query(f"with {_RR} select rr_uid, {_ATYPE} as ans_type from rr where len(answers) > 0 and answers[1] is not null")
def proj26_answer_type(spark: SparkSession, path: str) -> DataFrame:
    """SPANS, NUM, DATE or SPAN; records without an answer are dropped."""
    first = F.get("answers", F.lit(0))
    kind = (
        F.when(F.size("answers") > 1, "SPANS").when(F.replace(first, F.lit(",")).rlike(r"^-?[0-9]+(\.[0-9]+)?$"), "NUM")
        .when(first.rlike("^[A-Z][a-z]+ [0-9]{1,2}, [0-9]{4}$"), "DATE").otherwise("SPAN")
    )
    return ranking(spark, path).where(first.isNotNull()).select("rr_uid", kind.alias("ans_type"))


@query("select doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda r: array_to_string(list_transform(string_split(r, ' | '), lambda c: case when trim(c) in ('', 'N/A', 'n/a') then 'none' else trim(c) end), ' | ')), ' ') as line from documents where doc_kind = 'table' and text is not null")
def proj27_linearise_table(spark: SparkSession, path: str) -> DataFrame:
    """Table texts on one line, cells by bars, empty cells as none."""
    cell = lambda c: F.when(F.trim(c).isin("", "N/A", "n/a"), "none").otherwise(F.trim(c))
    row = lambda r: F.array_join(F.transform(F.split(r, r" \| "), cell), " | ")
    rows = table(spark, path, "documents").where("doc_kind = 'table' and text is not null")
    return rows.select("doc_id", F.array_join(F.transform(F.split("text", "\n"), row), " ").alias("line"))


@query("""with p as (select distinct idx, text, sentence_spans from index_paras where sentence_spans is not null), s as (select idx, length(coalesce(text, '')) as n, unnest(sentence_spans) as sp from p)
select idx, count(*) as spans, count(*) filter (sp[2] > n) as beyond, count(*) filter (sp[1] >= sp[2]) as reversed from s group by idx""")
def proj29_span_report(spark: SparkSession, path: str) -> DataFrame:
    """Spans per paragraph that reach beyond the text or are empty or reversed."""
    rows = table(spark, path, "index_paras").where("sentence_spans is not null").select("idx", "text", "sentence_spans").distinct()
    spans = rows.select("idx", F.length(F.coalesce("text", F.lit(""))).alias("n"), F.explode("sentence_spans").alias("sp"))
    count = lambda c: F.count(F.when(c, 1))
    return spans.groupBy("idx").agg(F.count("*").alias("spans"), count(F.col("sp")[1] > F.col("n")).alias("beyond"), count(F.col("sp")[0] >= F.col("sp")[1]).alias("reversed"))


_VERDICT = "case upper(trim(a)) when 'SUPPORTED' then 'yes' when 'SUPPORTS' then 'yes' when 'REFUTES' then 'no' when 'NOT_SUPPORTED' then 'no' when 'NOT ENOUGH INFO' then '<No Answer>' else a end"


@query(f"select distinct query_uid, list_transform(answer, lambda a: {_VERDICT}) as answer from iter_queries where answer is not null")
def proj30_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """Verdict words as yes, no and <No Answer>."""
    word = lambda a: F.upper(F.trim(a))
    mapped = lambda a: F.when(word(a).isin("SUPPORTED", "SUPPORTS"), "yes").when(word(a).isin("REFUTES", "NOT_SUPPORTED"), "no").when(word(a) == "NOT ENOUGH INFO", "<No Answer>").otherwise(a)
    return table(spark, path, "iter_queries").where("answer is not null").select("query_uid", F.transform("answer", mapped).alias("answer")).distinct()


_END = lambda x: S.close(x, ".!?:;")


@query(rf"""with {_LINES}, s as (select doc_id, q, a, list_filter(list_transform(string_split(q, '\n'), lambda x: {S.strip("x")}), lambda x: x <> '') as l, regexp_replace({S.strip("a")}, '\.+$', '') as b from lines),
w as (select *, case when instr(l[1], ' _ ') > 0 then substr(l[1], 1, instr(l[1], ' _ ')) || b || substr(l[1], instr(l[1], ' _ ') + 2) else {_END("l[1]")} || ' ' || upper(left(b, 1)) || lower(substr(b, 2)) end as w from s),
c as (select *, regexp_replace(w, '\?+$', '') as v from w), d as (select *, replace(regexp_replace({_END("v")}, '{S.WS}+', ' ', 'g'), ' .', '.') as z, coalesce(l[2], '') as two, coalesce(l[3], '') as three from c)
select doc_id, case when {S.strip("a")} = '' then q else z || ' ' || case when two = '' or starts_with(two, '(A)') then '' else {_END("two")} || ' ' end || case when three = '' then '' else {_END("three")} || ' ' end || '\n' end as statement from d""")
def proj31_restate(spark: SparkSession, path: str) -> DataFrame:
    """Questions and answers as statements."""
    return lines(spark, path).select("doc_id", qa.restate(F.col("q"), F.col("a")).alias("statement"))


@query(f"{_WITH} select doc_id, {S.strip('q_only')} as ans, 0 as n_steps from parsed where q_only not like '%##%'")
def proj17_decomposition(spark: SparkSession, path: str) -> DataFrame:
    """Steps of decomposition strings; questions without any have none."""
    rows = parsed(spark, path).where("q_only not like '%##%'").select("doc_id", qa.decomposition(F.col("q_only")).alias("d"))
    return rows.select("doc_id", "d.ans", F.size("d.steps").alias("n_steps"))


@query("select m.name as mixture, c.ds_name from dataset_catalogue c join (values ('extractive', 'EX'), ('verdicts', 'YN'), ('choice', 'MC')) m(name, t) on c.ds_type = m.t")
def proj32_mixtures(spark: SparkSession, path: str) -> DataFrame:
    """Group aliases expanded to dataset names."""
    groups = spark.createDataFrame([("extractive", "EX"), ("verdicts", "YN"), ("choice", "MC")], "mixture string, ds_type string")
    return table(spark, path, "dataset_catalogue").join(groups, "ds_type").select("mixture", "ds_name")


@query("select ds_name, coalesce(p, ds_name) as proxy from dataset_catalogue left join (values ('eqasc', 'qasc'), ('worldtree', 'qasc')) a(d, p) on ds_name = d")
def proj33_proxies(spark: SparkSession, path: str) -> DataFrame:
    aliases = spark.createDataFrame([("eqasc", "qasc"), ("worldtree", "qasc")], "ds_name string, proxy string")
    return table(spark, path, "dataset_catalogue").join(aliases, "ds_name", "left").select("ds_name", F.coalesce("proxy", "ds_name").alias("proxy"))


@query("select distinct doc_id, replace(replace(text, chr(9), ' '), chr(13), '') as text from documents where text is not null")
def proj38_cleanup(spark: SparkSession, path: str) -> DataFrame:
    """Texts without tabs and carriage returns, other columns dropped."""
    return table(spark, path, "documents").where("text is not null").select("doc_id", F.replace(F.replace("text", F.lit("\t"), F.lit(" ")), F.lit("\r"), F.lit("")).alias("text"))
