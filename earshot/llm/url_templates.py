"""URL verdicts by rules, and by a tree of path templates where no rule fits.

Per host, a tree of path segments is built level by level. A segment that looks generated (numbers, long hex strings) or
has little support below its parent becomes a wildcard. Labelled siblings whose shares of bad pages are statistically
alike (Hoeffding bound against the rest of their labelled siblings) are merged into the wildcard too. A page belongs to
the template of all its segments. Levels are built until no path has a further segment; below a node with fewer than
``SUPPORT`` pages there are only wildcards, so its few paths are finished at once.

The share of bad pages of a template is smoothed towards its parent's, down from the host and the whole table. A
template is rejected when it has enough labelled pages and its smoothed share reaches a limit. The labels are the pages
that a rule decides. Trees are aggregates by (host, parent, segment): a host with a great share of all pages is summed up
map-side first, and joins carry one row per distinct path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earshot.llm.store import Scratch

SUPPORT = 5
#: Hoeffding test of two shares: alpha 0.05.
BOUND = 1.3581
#: Weight of the parent's share, least labelled pages and least smoothed share of a rejected template.
SMOOTHING, LABELLED, LIMIT = 4.0, 5, 0.8
VARIABLE = "^([0-9].*|.*[0-9]{4}.*|[0-9a-f]{8,}|.{40,})$"


def split_url(url: str = "url") -> tuple[str, str]:
    """SQL for host and path of a URL; both empty without ``://``."""
    rest = f"if(instr({url}, '://') > 0, substr({url}, instr({url}, '://') + 3), '')"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = f"coalesce(translate(regexp_extract({rest}, '^[^/?#]*', 0), '{upper}', '{lower}'), '')"
    return host, f"coalesce(regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), '')"


def rule_of(rules: list[tuple[str, str, str]]) -> tuple[str, str]:
    """SQL for the longest fitting rule and its verdict, from (verdict, host, path)."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    cases = [(f"(host = '{h}' or endswith(host, '.{h}')) and startswith(path, '{p}')", h + p, v) for v, h, p in ordered]
    if not cases:
        return ("cast(null as string)",) * 2
    return tuple("case " + " ".join(f"when {c} then '{(r, v)[i]}'" for c, r, v in cases) + " end" for i in (0, 1))


def _level(paths: DataFrame) -> DataFrame:
    """Paths with the first of their ``segments`` moved into the template ``t``."""
    paths = paths.withColumn("seg", F.expr("segments[0]")).withColumn("segments", F.expr("slice(segments, 2, size(segments))"))
    children = paths.groupBy("host", "t", "seg").agg(
        F.sum("n").alias("n"), F.sum("labelled").alias("l"), F.sum("bad").alias("b")
    ).where(f"not regexp_like(seg, '{VARIABLE}') and n >= {SUPPORT}")
    siblings = children.groupBy("host", "t").agg(F.sum("l").alias("all_l"), F.sum("b").alias("all_b"))
    alike = (
        "l > 0 and all_l > l and abs(b / l - (all_b - b) / (all_l - l)) "
        f"< {BOUND} * (1 / sqrt(l) + 1 / sqrt(all_l - l))"
    )
    literal = children.join(siblings, ["host", "t"]).where(f"not coalesce({alike}, false)").select("host", "t", "seg", F.lit(True).alias("literal"))
    return paths.join(literal, ["host", "t", "seg"], "left").withColumn(
        "t", F.expr("case when literal then concat(t, '/', seg) else concat(t, '/*') end")
    ).drop("seg", "literal")


def _shared(paths: DataFrame) -> DataFrame:
    """Paths with ``share``, that of their node smoothed towards the one above, and ``room``, its pages that go deeper."""
    nodes = paths.groupBy("host", "t").agg(
        F.expr(f"(sum(bad) + {SMOOTHING}D * first(share)) / (sum(labelled) + {SMOOTHING}D)").alias("share"),
        F.expr("sum(if(size(segments) > 0, n, 0))").alias("room"),
    )
    return paths.drop("share", "room").join(nodes, ["host", "t"])


def _finished(paths: DataFrame) -> DataFrame:
    """``host, path, labelled, t, share`` at the end of paths that have no literal segments left; few share a node."""
    node = Window.partitionBy("host", "t")
    sums = lambda x: f"aggregate(kin, 0D, (sum, r) -> sum + if(r.left >= j, r.{x}, 0))"
    share = f"aggregate(sequence(1, left), share, (up, j) -> ({sums('bad')} + {SMOOTHING}D * up) / ({sums('labelled')} + {SMOOTHING}D))"
    return (
        paths.withColumn("left", F.size("segments"))
        .withColumn("kin", F.collect_list(F.struct("left", "labelled", "bad")).over(node))
        .select("host", "path", "labelled", F.expr("concat(t, repeat('/*', left))").alias("t"), F.expr(share).alias("share"))
    )


def judge(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, bad_share`` of every row of ``pages`` (``page_id``, ``url``).

    ``rules`` are (verdict, host, path); the longest that fits decides, else the template. A URL without ``://`` or
    null has empty host and path and is allowed unless its (empty) template is rejected. Repeated rows count each.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    host, path = split_url()
    rule, verdict = rule_of(rules)
    rows = pages.select("page_id", F.expr(host).alias("host"), F.expr(path).alias("path"))
    rows = rows.withColumn("rule", F.expr(rule)).withColumn("ruled", F.expr(verdict))
    # the rule depends on host and path alone, so one row per distinct path carries the counts
    paths = rows.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("n"), F.count("ruled").alias("labelled"), F.sum(F.expr("int(coalesce(ruled = 'block', false))")).alias("bad")
    )
    paths = scratch.write(paths, "paths")
    total = paths.agg(F.sum("bad"), F.sum("labelled")).first()
    share = (total[0] or 0) / total[1] if total[1] else 0.0
    segments = F.expr("filter(split(path, '/'), x -> x <> '')")
    open_ = paths.withColumn("segments", segments).withColumn("t", F.lit("")).withColumn("share", F.lit(share))
    level, k = scratch.write(_shared(open_), "levels/k=0"), 0
    open_ = level.where(f"room >= {SUPPORT} and size(segments) > 0")
    while not open_.isEmpty():
        k += 1
        level = scratch.write(_shared(_level(open_)), f"levels/k={k}")
        open_ = level.where(f"room >= {SUPPORT} and size(segments) > 0")
    # each path ends at one level
    levels = pages.sparkSession.read.schema(level.schema).option("recursiveFileLookup", "true").parquet(f"{scratch.root}/levels")
    ended = levels.where("size(segments) = 0").select("host", "path", "labelled", "t", "share")
    ended = ended.union(_finished(levels.where(f"size(segments) > 0 and room < {SUPPORT}")))
    tree = ended.groupBy("host", "t").agg(F.sum("labelled").alias("l"))
    rejected = F.when((F.col("l") >= LABELLED) & (F.col("share") >= LIMIT), "block").otherwise("allow")
    known = ended.join(tree, ["host", "t"]).select(
        "host", "path", F.concat("host", "t").alias("template"), F.round("share", 9).alias("bad_share"), rejected.alias("judged")
    )
    return rows.join(known, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", "judged").alias("verdict"), "template", "bad_share"
    )
