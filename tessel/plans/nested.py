"""Deeply nested records as related flat tables (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessel.catalog import query
from tessel.operators import shredding
from tessel.sources.tables import table

_PAGES = """
pages as (select doc_id, payload from wiki_docs where json_valid(payload)),
paras as (select doc_id, cast(p.key as integer) as para_no, p.value as para from pages, json_each(payload, '$.paras') p
  where json_type(payload, '$.paras') = 'ARRAY')"""

_ORDER = """
raw as (select distinct sample_uid, bridge from mdr_samples where bridge <> ''),
typed as (select sample_uid, bridge, case when json_valid(bridge) then json_type(bridge) else 'BARE' end as t from raw),
steps as (select sample_uid, cast(s.key as integer) as outer_no, s.value as v, json_type(s.value) as vt
  from (select * from typed where t = 'ARRAY') x, json_each(x.bridge) s),
orders as (
  select sample_uid, 0 as outer_no, 0 as inner_no, case when t = 'VARCHAR' then bridge ->> '$' else bridge end as title from typed where t <> 'ARRAY'
  union all select sample_uid, outer_no, 0, v ->> '$' from steps where vt = 'VARCHAR'
  union all select sample_uid, outer_no, cast(s.key as integer), s.value ->> '$' from (select * from steps where vt = 'ARRAY') y, json_each(y.v) s)"""


@query(f"""
with {_PAGES}, {_ORDER}
select distinct 'pos_paras' as child, sample_uid as rec_id, cast(p.i - 1 as integer) as outer_no, 0 as inner_no, p.x.title as title
  from (select sample_uid, unnest(list_transform(pos_paras, lambda x, i: {{'x': x, 'i': i}})) as p from mdr_samples)
union select distinct 'neg_paras', sample_uid, cast(p.i - 1 as integer), 0, p.x.title
  from (select sample_uid, unnest(list_transform(neg_paras, lambda x, i: {{'x': x, 'i': i}})) as p from mdr_samples)
union select 'bridge', sample_uid, outer_no, inner_no, title from orders where title <> ''
union select 'hyperlinks_cased', doc_id, para_no, cast(e.key as integer), h.key
  from paras, json_each(para, '$.hyperlinks_cased') h, json_each(h.value) e where json_type(h.value) = 'ARRAY'""")
def p4_found(spark: SparkSession, path: str) -> DataFrame:
    """Distinct child rows of samples and pages."""
    return shredding.child_rows(table(spark, path, "mdr_samples"), table(spark, path, "wiki_docs"))


@query(f"""with {_PAGES} select distinct doc_id as rec_id, para_no, para ->> '$.pid' as pid, para ->> '$.text' as text from paras""")
def p4_paras(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs of the pages."""
    return shredding.page_tables(table(spark, path, "wiki_docs"))[0]


@query(f"""with {_PAGES} select distinct doc_id as rec_id, para_no, cast(s.key as integer) as sent_no,
  cast(s.value ->> '$[0]' as integer) as s, cast(s.value ->> '$[1]' as integer) as e from paras, json_each(para, '$.sentence_spans') s""")
def p4_spans(spark: SparkSession, path: str) -> DataFrame:
    """Sentence spans of the paragraphs."""
    return shredding.page_tables(table(spark, path, "wiki_docs"))[1]
