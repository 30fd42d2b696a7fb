"""op5: near-equal rows of ``embeddings``."""

from earshot.llm.embedding_dedup import link_vectors
from earshot.llm.registry import query
from earshot.llm.store import table

SQL = """
with recursive v as (
  select vec_id, label, cast(embedding as double[]) e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id a, b.vec_id b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.98
), reach as (
  select vec_id node, vec_id other from embeddings
  union select r.node, l.b from reach r join links l on l.a = r.other
), least as (select node, min(other) component_id from reach group by node)
select node vec_id, (select count(*) from links where a = node) n_links, component_id, node = component_id kept from least
"""


@query("op5_sign_hashing", SQL)
def op5_sign_hashing(spark, sf_dir):
    return link_vectors(table(spark, sf_dir, "embeddings"), cosine=0.98)
