"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm.store import Scratch


def _stars(links: DataFrame, upward: bool) -> DataFrame:
    """Every node's neighbours (larger ones when ``upward``, else smaller ones) linked to its smallest neighbour."""
    sides = links.union(links.select(F.col("b"), F.col("a"))) if upward else links
    least = sides.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    moved = sides.join(least, "a").where(F.col("b") > F.col("a") if upward else F.col("b") != F.col("least"))
    out = moved.select(F.col("b").alias("a"), F.col("least").alias("b"))
    if not upward:
        out = out.union(least.select("a", F.col("least").alias("b")))
    return out.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of ``links`` (columns ``a``, ``b``).

    Each round is a written table. Joins on a node with many neighbours are plain equi-joins, which adaptive execution
    splits; nothing is gathered but a count and a checksum per round.
    """
    state = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state, seen, turn = scratch.write(state, f"{label}-0"), None, 0
    while True:
        turn += 1
        state = scratch.write(_stars(_stars(state, True), False), f"{label}-{turn}")
        scratch.drop(f"{label}-{turn - 1}")
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
