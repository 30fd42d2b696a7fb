"""Merkle manifest of a dataset: built levels are stored as parent-linked rows, a recursive query climbs per leaf.

A row's leaf is the digest of its fields. The leaves of a group, in order, are folded in runs of ``fanout`` to one
subroot; the subroots, in group order, are folded likewise to the root. A stored node has its digest, the digests of
its children and the key and slot of its parent.

The proof of a row is climbed by a recursive query: every step joins a leaf's climber with the node above it, appends
the siblings and folds the digest that was received for the row. A node is stored once for every ``CLIMBERS`` leaves
below it and a climber picks its copy by its row number, so that no key of the join has more than about that many rows,
not even the root's. Ranks come from a range sort and counts per sorted part, so a group of any size is spread out.
"""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.llm.store import Scratch

#: Leaves that one stored copy of a node serves.
CLIMBERS = 4096
#: Bytes of a digest, and the tree above the subroots (other trees are numbered from 0).
WIDTH, TOP = 32, -1


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def hex_text(value: Column) -> Column:
    return F.lower(F.hex(value))


@dataclass
class Manifest:
    """``leaves``: ``row, order, digest, received, part, tree`` and where the row stands; ``stretches``: the groups of
    every sorted part; ``subroots``: ``tree, level, digest, weight, children``; ``anchors``: the leaves linked to their
    parents; ``nodes``: all higher nodes, linked; ``root``: one row, none for an empty table."""

    leaves: DataFrame
    stretches: DataFrame
    subroots: DataFrame
    anchors: DataFrame
    nodes: DataFrame
    root: DataFrame


def _numbered(rows: DataFrame, group: str, order: list[str], scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows sorted by ``order`` (which begins with ``group``) with ``row`` and ``part``, and per part and group how
    many rows of the group come before the part, its first row and the group's size."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id())
    placed = scratch.write(placed, name).withColumn("part", F.shiftright("row", 33))
    here = placed.groupBy("part", group).agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("here"))
    whole = Window.partitionBy(group)
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    stretches = here.select(
        "part", group, "first", F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias("before"),
        F.sum("here").over(whole).alias("n"), F.min("first").over(whole).alias("tree"),
    )
    return placed, scratch.write(stretches, f"{name}-stretches")


def _with_place(rows: DataFrame, stretches: DataFrame, group: str) -> DataFrame:
    """``rows`` with ``tree``, ``pos`` (from 0) and ``n`` of their group; the null group is one too."""
    s = stretches.withColumnRenamed("part", "_part").withColumnRenamed(group, "_group")
    joined = rows.join(s, (F.col("part") == F.col("_part")) & F.col(group).eqNullSafe(F.col("_group")))
    return joined.withColumn("pos", F.col("row") - F.col("first") + F.col("before")).drop("_part", "_group", "first", "before")


def _copies(weight: Column) -> Column:
    return F.ceil(weight / CLIMBERS).cast("int")


def _below(pos: str, level: int, fanout: int) -> Column:
    """Leaves below a node of a group's tree, whose ``size`` is known."""
    width = fanout**level
    return F.least(F.lit(width), F.col("size") - F.col(pos) * width)


def _above(level: DataFrame, number: int, fanout: int) -> DataFrame:
    """Nodes of ``level`` whose tree goes on, with the key of their parent, their slot and the parent's copies."""
    up = level.where("n > 1").withColumns({
        "up_tree": F.col("tree"), "up_level": F.lit(number + 1), "up_pos": F.floor(F.col("pos") / fanout),
        "slot": F.pmod("pos", F.lit(fanout)).cast("int"),
    })
    if "size" in level.columns:
        return up.withColumn("up_copies", _copies(_below("up_pos", number + 1, fanout)))
    # above the subroots, whose groups differ in size
    return up.withColumn("up_copies", _copies(F.sum("weight").over(Window.partitionBy("tree", "up_pos"))))


def _next(level: DataFrame, fanout: int) -> DataFrame:
    weight = F.first("size").alias("size") if "size" in level.columns else F.sum("weight").alias("weight")
    run = level.where("n > 1").groupBy("tree", F.floor(F.col("pos") / fanout).alias("pos")).agg(
        F.array_sort(F.collect_list(F.struct(F.pmod("pos", F.lit(fanout)).alias("slot"), "digest"))).alias("run"),
        weight, F.ceil(F.first("n") / fanout).alias("n"),
    )
    children = F.array_join(F.transform("run", lambda x: hex_text(x["digest"])), "")
    return run.select("tree", "pos", "n", digest(children).alias("digest"), run.columns[3], F.unhex(children).alias("children"))


def _levels(level: DataFrame, fanout: int, scratch: Scratch, name: str) -> list[DataFrame]:
    """``level`` and the levels above it up to the one at which the largest tree has a single node."""
    levels, widest = [level], level.agg(F.max("n")).first()[0] or 0
    while widest > 1:
        levels.append(scratch.write(_next(levels[-1], fanout), f"{name}-{len(levels)}"))
        widest = -(-widest // fanout)
    return levels


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


LINK = ["up_tree", "up_level", "up_pos", "slot", "up_copies"]


def build(
    docs: DataFrame, fields: Sequence[str], group: str, order: str, fanout: int = 16, received: dict[str, Column] | None = None
) -> Manifest:
    """The manifest of ``docs``: leaves over ``fields``, per ``group`` (null first) ascending by ``order``.

    ``received`` replaces columns by what came in for a row; its digest is kept beside the leaf's and is what a climb
    folds. Nulls are values of their own in every column. Equal places are ordered by leaf, so repeated rows are leaves
    that can be exchanged; an empty table has no root. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    leaf = lambda columns: digest(F.concat(*[field(c) for c in columns]))
    own = [F.col(f"`{c}`") for c in fields]
    came = [(received or {}).get(c, F.col(f"`{c}`")) for c in fields]
    hashed = docs.select(F.col(f"`{group}`").alias("group"), F.col(f"`{order}`").alias("order"), leaf(own).alias("digest"), leaf(came).alias("received"))
    # the last key spreads rows that are equal in all others
    hashed = scratch.write(hashed.withColumn("tie", F.monotonically_increasing_id()), "hashed")
    leaves, stretches = _numbered(hashed, "group", ["group", "order", "digest", "received", "tie"], scratch, "leaves")
    scratch.drop("hashed")
    leaves = scratch.write(_with_place(leaves.drop("tie"), stretches, "group"), "places")
    scratch.drop("leaves")
    bottom = leaves.select("tree", "pos", "n", "digest", F.col("n").alias("size"), F.lit(None).cast("binary").alias("children"), "row", "received")
    levels = _levels(bottom, fanout, scratch, "level")

    plain = ["tree", "digest", "weight", "children"]
    ends = _union([x.where("n = 1").select("tree", "digest", F.col("size").alias("weight"), "children", F.lit(k).alias("level")) for k, x in enumerate(levels)])
    ends = ends.withColumn("all", F.lit(TOP).cast("long"))
    subroots, over = _numbered(ends, "all", ["all", "tree"], scratch, "subroots")
    top = _with_place(subroots.withColumnRenamed("tree", "of_tree").withColumnRenamed("level", "of_level"), over, "all")
    top = top.withColumn("tree", F.col("all"))
    tops = _levels(top.select(*plain, "pos", "n", "of_tree", "of_level"), fanout, scratch, "top")

    node = ["tree", "level", "pos", "children", "weight"]
    inner = [
        _above(x, k, fanout).withColumns({"level": F.lit(k), "weight": _below("pos", k, fanout)}).select(*node, *LINK)
        for k, x in enumerate(levels) if k
    ]
    crowns = scratch.write(
        _above(tops[0], 0, fanout).select(
            F.col("of_tree").alias("tree"), F.col("of_level").alias("level"), F.lit(0).cast("long").alias("pos"), "children", "weight", *LINK
        ), "crowns",
    )
    high = [_above(x, k, fanout).withColumn("level", F.lit(k)).select(*node, *LINK) for k, x in enumerate(tops) if k]
    none = [F.lit(None).cast(t).alias(c) for c, t in zip(LINK, ("long", "int", "long", "int", "int"), strict=True)]
    last = tops[-1].where("n = 1").select(*plain, "pos", *[F.col(c) for c in ("of_tree", "of_level") if c in tops[-1].columns])
    if len(tops) == 1:  # one group: its subroot is the root
        end = last.select(F.col("of_tree").alias("tree"), F.col("of_level").alias("level"), "pos", "children", "weight", *none)
    else:
        end = last.withColumn("level", F.lit(len(tops) - 1)).select(*node, *none)
    typed = lambda x: x.select("tree", F.col("level").cast("int").alias("level"), F.col("pos").cast("long").alias("pos"), "children", "weight", *[
        F.col(c).cast(t).alias(c) for c, t in zip(LINK, ("long", "int", "long", "int", "int"), strict=True)])
    nodes = _union([typed(x) for x in [*inner, crowns.where("level > 0"), *high, end.where("level > 0")]])
    nodes = scratch.write(nodes.withColumn("copies", _copies(F.col("weight"))), "nodes")

    linked = _above(bottom, 0, fanout).select("row", "received", *LINK)
    lone = bottom.where("n = 1").select("row", "received", "tree")
    lone = lone.join(crowns.where("level = 0").select("tree", *LINK), "tree", "left").select("row", "received", *LINK)
    casts = [F.col(c).cast(t).alias(c) for c, t in zip(LINK, ("long", "int", "long", "int", "int"), strict=True)]
    anchors = linked.select("row", "received", *casts).union(lone.select("row", "received", *casts))
    return Manifest(leaves, stretches, subroots.select("tree", "level", "digest"), anchors, nodes, last.select("digest"))


#: Every step appends the siblings of a level; a climber that has reached the root has no parent and meets no node.
CLIMB = f"""
with recursive climb as (
  select row, 0 step, cast('' as binary) siblings, received folded, up_tree, up_level, up_pos, slot, up_copies from {{anchors}}
  union all
  select row, step + 1, concat(before, after), unhex(sha2(lower(concat(hex(before), hex(folded), hex(after))), 256)),
    up_tree, up_level, up_pos, slot, up_copies
  from (
    select c.row, c.step, c.folded, substring(n.children, 1, c.slot * {WIDTH}) before,
      substring(n.children, (c.slot + 1) * {WIDTH} + 1) after, n.up_tree, n.up_level, n.up_pos, n.slot, n.up_copies
    from climb c join {{nodes}} n
      on n.tree = c.up_tree and n.level = c.up_level and n.pos = c.up_pos and n.copy = pmod(xxhash64(c.row), c.up_copies)
  )
)
select row, step, siblings, folded from climb
"""


def climb(manifest: Manifest) -> DataFrame:
    """``row, step, siblings, folded`` for every leaf and level: the digests beside its path and what is folded so far.

    Spark holds a recursive query to ``spark.sql.cteRecursionRowLimit`` rows; a caller lifts that where it runs this.
    """
    nodes = manifest.nodes.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return manifest.nodes.sparkSession.sql(CLIMB, anchors=manifest.anchors, nodes=nodes)


@contextmanager
def _unlimited(spark):
    name = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def verify(manifest: Manifest) -> DataFrame:
    """``order, leaf, subroot, root, proof, folded_root, verified`` for every row of the manifest, digests as bytes.

    ``proof`` holds the siblings level by level, left to right, as one digest of their hex text; ``folded_root`` is what
    the received digest climbs to, and ``verified`` says that this is the root.
    """
    spark = manifest.leaves.sparkSession
    steps = F.array_sort(F.collect_list(F.struct("step", "siblings")))
    proof = digest(F.array_join(F.transform("steps", lambda s: hex_text(s["siblings"])), ""))
    # rows of a leaf come from different steps, so there is nothing to combine before they are shuffled
    climbed = climb(manifest).repartition("row").groupBy("row").agg(steps.alias("steps"), F.max_by("folded", "step").alias("folded_root"))
    with _unlimited(spark):
        proofs = Scratch(spark, "merkle").write(climbed.select("row", proof.alias("proof"), "folded_root"), "proofs")
    subroots = manifest.subroots.select("tree", F.col("digest").alias("subroot"))
    # per sorted part, so that the rows of a large group do not meet on one key
    known = manifest.stretches.select("part", "tree").join(subroots, "tree")
    rows = manifest.leaves.select("row", "part", "tree", "order", F.col("digest").alias("leaf")).join(proofs, "row").join(known, ["part", "tree"])
    return rows.withColumn("root", manifest.root.scalar()).select(
        "order", "leaf", "subroot", "root", "proof", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )
