"""op11: every row of ``documents`` proved against the manifest, a fifth of them tampered with."""

from pyspark.sql import functions as F

from earshot.llm import merkle
from earshot.llm.registry import query
from earshot.llm.store import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL = """
with recursive crc_table as (
  select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
    case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) t
), chars as (
  select doc_id, list_reduce(list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ascii(x) as bigint)),
    lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)]), cast(4294967295 as bigint)) c from documents, crc_table
), d as (
  select doc_id, source, xor(c, 4294967295) % 5 = 0 bad,
    coalesce(strlen(cast(doc_id as varchar)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(cast(n_chars as varchar)) || ':' || n_chars, '-') front, text
  from documents join chars using (doc_id)
), leaves as (
  select doc_id, source, sha256(front || coalesce(strlen(text) || ':' || text, '-')) leaf,
    sha256(front || coalesce(strlen(text) || ':' || case when bad then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end, '-')) came,
    row_number() over (partition by source order by doc_id) - 1 pos, count(*) over (partition by source) n
  from d
), low as (
  select source, 0 lvl, pos, n, leaf dig, [cast(null as varchar)] kids from leaves
  union all
  select source, lvl + 1, pos // 16, (any_value(n) + 15) // 16, sha256(string_agg(dig, '' order by pos)), list(dig order by pos)
  from low where n > 1 group by source, lvl, pos // 16
), subs as (
  select source, lvl, dig, row_number() over (order by source nulls first) - 1 pos, count(*) over () n from low where n = 1
), high as (
  select 0 lvl, pos, n, dig, [cast(null as varchar)] kids from subs
  union all
  select lvl + 1, pos // 16, (any_value(n) + 15) // 16, sha256(string_agg(dig, '' order by pos)), list(dig order by pos)
  from high where n > 1 group by lvl, pos // 16
), climb as (
  select doc_id, source, 0 step, pos, came folded, '' proof from leaves
  union all
  select doc_id, c.source, step + 1, c.pos // 16,
    sha256(array_to_string(kids[:c.pos % 16], '') || folded || array_to_string(kids[c.pos % 16 + 2:], '')),
    proof || array_to_string(kids[:c.pos % 16], '') || array_to_string(kids[c.pos % 16 + 2:], '')
  from climb c join low l on l.source is not distinct from c.source and l.lvl = step + 1 and l.pos = c.pos // 16
), over_ as (
  select doc_id, 0 step, s.pos, folded, proof from climb c join subs s on s.source is not distinct from c.source and s.lvl = step
  union all
  select doc_id, step + 1, c.pos // 16,
    sha256(array_to_string(kids[:c.pos % 16], '') || folded || array_to_string(kids[c.pos % 16 + 2:], '')),
    proof || array_to_string(kids[:c.pos % 16], '') || array_to_string(kids[c.pos % 16 + 2:], '')
  from over_ c join high l on l.lvl = step + 1 and l.pos = c.pos // 16
)
select l.doc_id, leaf, s.dig subroot, r.dig root, sha256(proof) proof_sha256, folded folded_root, folded = r.dig verified
from leaves l join subs s on s.source is not distinct from l.source join high r on r.n = 1
join over_ o on o.doc_id = l.doc_id and o.step = r.lvl
"""


@query("op11_merkle_manifest", SQL)
def op11_merkle_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    came = {"text": F.when(tampered, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))}
    checked = merkle.verify(merkle.build(docs, ["doc_id", "source", "lang", "n_chars", "text"], "source", "doc_id", 16, came))
    digests = ["leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), "folded_root"]
    named = [(F.col(c) if isinstance(c, str) else c) for c in digests]
    texts = [merkle.hex_text(c).alias(n) for c, n in zip(named, ("leaf", "subroot", "root", "proof_sha256", "folded_root"), strict=True)]
    return checked.select(F.col("order").alias("doc_id"), *texts, "verified")
