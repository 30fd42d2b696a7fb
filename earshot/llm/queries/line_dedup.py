"""op12: lines that several ``documents`` share."""

from pyspark.sql import functions as F

from earshot.llm.line_dedup import drop_repeated_lines
from earshot.llm.registry import query
from earshot.llm.store import table

SQL = """
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) place from documents
), keyed as (
  select doc_id, place, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') k from lines
), shared as (
  select k, min(doc_id) owner from keyed where length(k) >= 10 group by k having count(distinct doc_id) >= 2
)
select doc_id, count(*) n_lines, count(owner) filter (owner <> doc_id) n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by place) filter (owner is null or owner = doc_id), '')) kept_sha256
from keyed left join shared using (k) group by doc_id
"""


@query("op12_line_dedup", SQL)
def op12_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
