"""op7: the ten nearest rows of ``embeddings`` by integer inner product."""

from earshot.llm.registry import query
from earshot.llm.store import table
from earshot.llm.topk import top_k

SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) score
  from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id
), r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""


@query("op7_uniform_threshold", SQL)
def op7_uniform_threshold(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), is_query="vec_id % 100 = 0", k=10)
