"""What surrounds a model: encoding in batches, look-ups in supplied lexicons, and the rules of a training loop. Models themselves and their weights are supplied or left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.catalog import query
from tessel.functions import sql as S
from tessel.functions import text as T
from tessel.operators.encode import HashingEncoder, encode
from tessel.operators.iteration import Steps, iterate
from tessel.plans.records import _RR, ranking
from tessel.sources.tables import latest, table


@query(None)
def s21_encoded_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Every paragraph as a vector by a batch encoder, here one of hashed words."""
    return encode(latest(table(spark, path, "index_paras").where("text is not null"), "idx", "text"), "idx", "text", HashingEncoder(64))


@query(None)
def s23_iteration_by_arguments(spark: SparkSession, path: str) -> DataFrame:
    """The iteration under parameters given as command-line arguments."""
    columns = ("query_uid", "hop", "idx", "s_idx", "sent_uid", "score", "s1para_score", "s2_score", "s2ev_score")
    rows = table(spark, path, "evidence_sents").where("query_uid is not null and hop is not null").select(*columns)
    return iterate(rows, Steps.of_arguments(["--beam_size", "3", "--topk", "6", "--stop_ev_thresh", "0.8", "--s1_para_sent_ratio", "0.3"]))


#: A lexicon (word, lemma) and a synonym table (word, synset, definition) as they may be supplied; small examples stand in.
LEXICON = [("was", "be"), ("were", "be"), ("is", "be"), ("has", "have"), ("had", "have"), ("did", "do"), ("saw", "see"), ("moved", "move"), ("designed", "design"), ("called", "call")]
SYNSETS = [("opera", "opera.n.01", "a drama set to music"), ("magazine", "magazine.n.01", "a periodical"), ("magazine", "magazine.n.02", "a store of arms"), ("atlas", "atlas.n.01", "a book of maps")]
_ROWS = lambda rows: ", ".join("(" + ", ".join(S.quote(x) for x in r) + ")" for r in rows)


@query(f"""with {_RR}, w as (select rr_uid, unnest({S.TOKENS.format("question")}) as token, generate_subscripts({S.TOKENS.format("question")}, 1) as i from rr where question is not null), l as (select * from (values {_ROWS(LEXICON)}) x(word, lemma))
select rr_uid, list(coalesce(lemma, lower(token)) order by i) as lemmas from w left join l on word = lower(token) group by rr_uid""")
def t18_lemmas(spark: SparkSession, path: str) -> DataFrame:
    """Lemmas of the tokens of every question by a supplied lexicon, which is joined by word; other tokens stay in lower case."""
    tokens = ranking(spark, path).where("question is not null").select("rr_uid", F.posexplode(T.simple_tokens("question")).alias("i", "token"))
    lexicon = spark.createDataFrame(LEXICON, "word string, lemma string")
    joined = tokens.withColumn("word", F.lower("token")).join(lexicon, "word", "left")
    in_order = F.array_sort(F.collect_list(F.struct("i", F.coalesce("lemma", "word").alias("lemma"))))
    return joined.groupBy("rr_uid").agg(F.transform(in_order, lambda x: x["lemma"]).alias("lemmas"))


@query(f"""with {_RR}, w as (select distinct rr_uid, lower(unnest({S.words("question")})) as word from rr where question is not null), s as (select * from (values {_ROWS(SYNSETS)}) x(word, synset, definition))
select rr_uid, word, synset, definition from w join s using (word)""")
def t45_synsets(spark: SparkSession, path: str) -> DataFrame:
    """Senses of the words of every question in a supplied synonym table."""
    words = ranking(spark, path).where("question is not null").select("rr_uid", F.explode(T.words("question")).alias("word")).select("rr_uid", F.lower("word").alias("word")).distinct()
    return words.join(spark.createDataFrame(SYNSETS, "word string, synset string, definition string"), "word").select("rr_uid", "word", "synset", "definition")


@query("""with b as (select (row_number() over (order by vec_id) - 1) // 50 as batch, vec_id, label from embeddings), g as (select batch, count(*) as n, sum(label) as s, min(vec_id) as first from b group by batch)
select cast(batch as bigint) as batch, cast(coalesce(sum(n) over w, 0) as bigint) as queued, cast(coalesce(sum(s) over w, 0) as bigint) as labels, min(first) over w as oldest from g window w as (order by batch rows between 4 preceding and 1 preceding)""")
def i08_negative_queue(spark: SparkSession, path: str) -> DataFrame:
    """The queue of past vectors that every batch of fifty sees as negatives: the four batches before it."""
    from tessel.operators.statistics import positions

    rows = positions(table(spark, path, "embeddings").select("vec_id", "label"), "vec_id")
    batches = rows.groupBy(F.floor(F.col("pos") / 50).alias("batch")).agg(F.count("*").alias("n"), F.sum("label").alias("s"), F.min("vec_id").alias("first"))
    # batches meet the four after them by number; no window over all of them
    seen = batches.select(F.explode(F.sequence(F.col("batch") + 1, F.col("batch") + 4)).alias("batch"), "n", "s", "first")
    queue = seen.groupBy("batch").agg(F.sum("n").alias("queued"), F.sum("s").alias("labels"), F.min("first").alias("oldest"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return batches.select("batch").join(queue, "batch", "left").select("batch", zero("queued"), zero("labels"), "oldest")


@query("""with c as (select query_uid, hop, idx, max(10 * s1para_score) as x, max(s2_score) as s2 from evidence_sents where s1para_score is not null and s2_score is not null and not isnan(s2_score) and idx is not null group by all),
p as (select query_uid, hop, arg_max(idx, (s2, -idx)) as pos from c group by all),
k as (select c.* from c where not exists (select 1 from p where p.query_uid = c.query_uid and p.hop > c.hop and p.pos = c.idx) or exists (select 1 from p where p.query_uid = c.query_uid and p.hop = c.hop and p.pos = c.idx)),
l as (select k.query_uid, k.hop, ln(sum(exp(x))) - max(case when idx = pos then x end) as loss from k join p using (query_uid, hop) group by all) select hop, count(*) as n, round(avg(loss), 6) as loss from l group by hop""")
def i09_contrastive_loss(spark: SparkSession, path: str) -> DataFrame:
    """Mean contrastive loss of each hop: the best paragraph against the others, those that are wanted at a later hop masked."""
    rows = table(spark, path, "evidence_sents").where("s1para_score is not null and s2_score is not null and not isnan(s2_score) and idx is not null")
    c = rows.groupBy("query_uid", "hop", "idx").agg(F.max(10 * F.col("s1para_score")).alias("x"), F.max("s2_score").alias("s2"))
    best = c.groupBy("query_uid", "hop").agg(F.max(F.struct("s2", (-F.col("idx")).alias("i"))).alias("b")).select("query_uid", "hop", (-F.col("b.i")).alias("pos"))
    later = best.select("query_uid", F.col("hop").alias("at"), F.col("pos").alias("idx")).groupBy("query_uid", "idx").agg(F.max("at").alias("at"))
    joined = c.join(best, ["query_uid", "hop"]).join(later, ["query_uid", "idx"], "left")
    kept = joined.where(F.col("at").isNull() | (F.col("at") <= F.col("hop")) | (F.col("idx") == F.col("pos")))
    loss = kept.groupBy("query_uid", "hop").agg((F.log(F.sum(F.exp("x"))) - F.max(F.when(F.col("idx") == F.col("pos"), F.col("x")))).alias("loss"))
    return loss.groupBy("hop").agg(F.count("*").alias("n"), F.round(F.avg("loss"), 6).alias("loss"))


@query("""with s as (select event_type, cast(ts as date) as step, round(avg(value), 6) as v from events group by all), r as (select *, row_number() over (partition by event_type order by step) as rn, max(v) over (partition by event_type order by step rows between unbounded preceding and 1 preceding) as before from s),
i as (select *, max(case when before is null or v > before then rn end) over (partition by event_type order by step) as last from r), e as (select event_type, min(rn) filter (rn - last >= 3) as stop from i group by event_type)
select event_type, max(step) filter (rn = last and (stop is null or rn <= stop)) as best_step, max(v) filter (stop is null or rn <= stop) as best, max(step) filter (rn = stop) as stopped from i join e using (event_type) group by event_type""")
def i10_early_stopping(spark: SparkSession, path: str) -> DataFrame:
    """Where a training run stops, by its measure per step: at the third step in a row without improvement, or not at all; with the best step until then."""
    by = Window.partitionBy("event_type").orderBy("step")
    steps = table(spark, path, "events").groupBy("event_type", F.to_date("ts").alias("step")).agg(F.round(F.avg("value"), 6).alias("v"))
    rows = steps.withColumn("rn", F.row_number().over(by)).withColumn("before", F.max("v").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("last", F.max(F.when(F.col("before").isNull() | (F.col("v") > F.col("before")), F.col("rn"))).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    stop = F.min(F.when(F.col("rn") - F.col("last") >= 3, F.col("rn"))).over(Window.partitionBy("event_type"))
    rows = rows.withColumn("stop", stop)
    until = F.col("stop").isNull() | (F.col("rn") <= F.col("stop"))
    return rows.groupBy("event_type").agg(
        F.max(F.when(until & (F.col("rn") == F.col("last")), F.col("step"))).alias("best_step"), F.max(F.when(until, F.col("v"))).alias("best"), F.max(F.when(F.col("rn") == F.col("stop"), F.col("step"))).alias("stopped"),
    )
