"""op2: a verdict for every row of ``pages``."""

from earshot.llm.registry import query
from earshot.llm.store import table
from earshot.llm.url_templates import judge

RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]


def _sql() -> str:
    """The same tree in SQL, level by level."""
    out = ["""
with parsed as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end rest from pages
), split_ as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from parsed
), rules(v, h, p) as (
  values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fitting as (
  select distinct host, path, arg_max(v, length(h || p)) ruled, arg_max(h || p, length(h || p)) as rule
  from (select distinct host, path from split_) s join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by host, path
), rows_ as (select s.*, f.rule, f.ruled from split_ s left join fitting f using (host, path)),
p0 as (
  select host, path, count(*) n, count(ruled) l, count(*) filter (ruled = 'block') b,
    list_filter(string_split(path, '/'), lambda x: x <> '') segs, '' t0 from rows_ group by host, path
)"""]
    for k in range(1, 5):
        out.append(f"""
, c{k} as (
  select host, t{k - 1}, segs[{k}] seg, sum(l) l, sum(b) b from p{k - 1} where len(segs) >= {k}
    and not regexp_full_match(segs[{k}], '[0-9].*|.*[0-9]{{4}}.*|[0-9a-f]{{8,}}|.{{40,}}')
  group by host, t{k - 1}, segs[{k}] having sum(n) >= 5
), m{k} as (
  select host, t{k - 1}, seg from (select *, sum(l) over w al, sum(b) over w ab from c{k} window w as (partition by host, t{k - 1}))
  where not (case when l > 0 and al > l then abs(b / l - (ab - b) / (al - l)) < 1.3581 * (1 / sqrt(l) + 1 / sqrt(al - l)) else false end)
), p{k} as (
  select p.*, case when len(segs) < {k} then p.t{k - 1} when m.seg is not null then p.t{k - 1} || '/' || segs[{k}] else p.t{k - 1} || '/*' end t{k}
  from p{k - 1} p left join m{k} m on p.host = m.host and p.t{k - 1} = m.t{k - 1} and segs[{k}] = m.seg
)""")
    out.append("""
, s0 as (select host, t0, (sum(b) + 4.0 * (select coalesce(sum(b) / nullif(sum(l), 0), 0) from p4)) / (sum(l) + 4.0) share from p4 group by host, t0)""")
    for k in range(1, 5):
        keys = ", ".join(f"t{i}" for i in range(k + 1))
        up = ", ".join(f"t{i}" for i in range(k))
        out.append(f"""
, s{k} as (
  select host, {keys}, x.l, x.b, case when t{k} = t{k - 1} then s.share else (x.b + 4.0 * s.share) / (x.l + 4.0) end share
  from (select host, {keys}, sum(l) l, sum(b) b from p4 group by host, {keys}) x join s{k - 1} s using (host, {up})
)""")
    out.append("""
select page_id, r.host, r.path, rule, coalesce(ruled, case when s.l >= 5 and s.share >= 0.8 then 'block' else 'allow' end) verdict,
  r.host || p4.t4 as template, round(s.share, 9) bad_share
from rows_ r left join p4 on r.host = p4.host and r.path = p4.path left join s4 s on p4.host = s.host and p4.t1 = s.t1 and p4.t2 = s.t2 and p4.t3 = s.t3 and p4.t4 = s.t4
""")
    return "".join(out)


@query("op2_path_templates", _sql())
def op2_path_templates(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)
