"""op3: near-duplicate documents."""

from earshot.llm.minhash import near_duplicates
from earshot.llm.registry import query
from earshot.llm.store import table

SQL = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') ws from documents
), s as (
  select doc_id, list_distinct(case when len(ws) >= 3 then list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
    when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) sh from w
), e as (select doc_id, unnest(sh) g from s),
common as (select a.doc_id a, b.doc_id b, count(*) c from e a join e b on a.g = b.g and a.doc_id <> b.doc_id group by all),
links as (
  select a, b from common join s x on x.doc_id = a join s y on y.doc_id = b where 100 * c >= 85 * (len(x.sh) + len(y.sh) - c)
), reach as (
  select doc_id node, doc_id other from documents union select r.node, l.b from reach r join links l on l.a = r.other
), least as (select node, min(other) component_id from reach group by node)
select doc_id, cast(len(sh) as bigint) n_shingles, component_id, doc_id = component_id kept from s join least on node = doc_id
"""


@query("op3_hyperminhash", SQL)
def op3_hyperminhash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, shingle=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")
