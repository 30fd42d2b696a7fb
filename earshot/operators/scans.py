"""Ordered scans over groups of any size.

A plain window puts a whole group into one task. Here the rows are cut by
sampled quantiles of (group, order) into slices of about equal size: every
slice is scanned on its own, a small summary of the slices carries totals
forward, and both are joined again. A single key, value or outlier may own any
share of the rows; only rows that are equal in all order columns stay together.

``bucketed_scan`` does the same over buckets that the caller has cut, and is
only as even as those.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.functions.hashing import order_key
from earshot.session import materialize

DEFAULT_BLOCK_ROWS = 4096


def bucketed_scan(
    df: DataFrame,
    group: list[str],
    bucket: str,
    order: list[str],
    rank: str | None = None,
    count: str | None = None,
    sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    totals: dict[str, Column] | None = None,
    following: dict[str, str] | None = None,
    preceding: dict[str, str] | None = None,
    summarised: DataFrame | None = None,
) -> DataFrame:
    """Running values along ``order`` inside ``group``, exact across buckets.

    ``bucket`` must be non-decreasing along ``order``. ``rank`` adds the row
    number, ``count`` the group size, ``sums``/``maxes`` inclusive running
    aggregates, ``totals`` group-wide sums, ``following``/``preceding`` the
    value of a column in the next / previous row (NULL at the group's end).
    ``summarised`` is ``df`` less an arrangement of its rows that the summary
    does not need. Null is a group like any other.
    """
    sums, maxes, totals = sums or {}, maxes or {}, totals or {}
    following, preceding = following or {}, preceding or {}

    in_bucket = Window.partitionBy(*group, bucket).orderBy(*order)
    running = in_bucket.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = df
    if rank:
        local = local.withColumn("_rank", F.row_number().over(in_bucket))
    for name, expr in sums.items():
        local = local.withColumn(f"_sum_{name}", F.sum(expr).over(running))
    for name, expr in maxes.items():
        local = local.withColumn(f"_max_{name}", F.max(expr).over(running))
    # Wrapped in a struct so that a NULL value differs from "no such row".
    if following:
        nxt = F.struct(*[F.col(c).alias(n) for n, c in following.items()])
        local = local.withColumn("_next", F.lead(nxt).over(in_bucket))
    if preceding:
        prv = F.struct(*[F.col(c).alias(n) for n, c in preceding.items()])
        local = local.withColumn("_prev", F.lag(prv).over(in_bucket))

    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.sum(e).alias(f"_bs_{n}") for n, e in sums.items()]
    aggs += [F.max(e).alias(f"_bm_{n}") for n, e in maxes.items()]
    aggs += [F.sum(e).alias(f"_bt_{n}") for n, e in totals.items()]
    position = F.struct(*order)
    if following:
        aggs.append(F.min_by(nxt, position).alias("_first"))
    if preceding:
        aggs.append(F.max_by(prv, position).alias("_last"))
    summary = (df if summarised is None else summarised).groupBy(*group, bucket).agg(*aggs)

    along = Window.partitionBy(*group).orderBy(bucket)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    carried = [F.col(c) for c in [*group, bucket]]
    if rank:
        carried.append(F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    if count:
        carried.append(F.sum("_n").over(whole).alias(count))
    carried += [F.sum(f"_bs_{n}").over(before).alias(f"_bs_{n}") for n in sums]
    carried += [F.max(f"_bm_{n}").over(before).alias(f"_bm_{n}") for n in maxes]
    carried += [F.sum(f"_bt_{n}").over(whole).alias(n) for n in totals]
    if following:
        carried.append(F.lead("_first").over(along).alias("_after"))
    if preceding:
        carried.append(F.lag("_last").over(along).alias("_ahead"))

    keys = [*group, bucket]
    told = summary.select(*carried).withColumnsRenamed({c: f"_of_{c}" for c in keys})
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys]
    out = local.join(told, same).drop(*(f"_of_{c}" for c in keys))
    dropped = []
    if rank:
        out = out.withColumn(rank, (F.col("_rank") + F.col("_before")).cast("bigint"))
        dropped += ["_rank", "_before"]
    for name in sums:
        out = out.withColumn(name, F.coalesce(F.col(f"_bs_{name}"), F.lit(0)) + F.col(f"_sum_{name}"))
        dropped += [f"_bs_{name}", f"_sum_{name}"]
    for name in maxes:
        out = out.withColumn(name, F.greatest(F.col(f"_bm_{name}"), F.col(f"_max_{name}")))
        dropped += [f"_bm_{name}", f"_max_{name}"]
    if following:
        hop = F.coalesce("_next", "_after")
        for name in following:
            out = out.withColumn(name, hop[name])
        dropped += ["_next", "_after"]
    if preceding:
        hop = F.coalesce("_prev", "_ahead")
        for name in preceding:
            out = out.withColumn(name, hop[name])
        dropped += ["_prev", "_ahead"]
    return out.drop(*dropped)


def range_scan(df: DataFrame, group: list[str], order: list[str], keep_slice: bool = False, **scan) -> DataFrame:
    """``bucketed_scan`` over slices cut at sampled quantiles of (group, order), left in ``_slice`` where asked.

    The cut rows are written once, so that their slice is the same in every
    pass. The summary has one row per slice and group that starts or goes on
    in it: at most as many as there are slices and groups together.
    """
    cut = df.repartitionByRange(*[F.col(c) for c in (*group, *order)]).withColumn("_slice", F.spark_partition_id())
    placed = materialize(cut)
    # a slice is a task again: hashing would put several into one
    out = bucketed_scan(placed.repartitionByRange("_slice"), group, "_slice", order, summarised=placed, **scan)
    return out if keep_slice else out.drop("_slice")


def hash_rank(df, group: list[str], ids: list[str], seed, rank: str, count: str | None = None) -> DataFrame:
    """Position of each row in a seeded shuffle of its group (1-based)."""
    keyed = df.withColumn("_digest", order_key(seed, *ids))
    return range_scan(keyed, group, ["_digest", *ids], rank=rank, count=count).drop("_digest")


# Up to this n Spark limits a row_number filter to n rows per group map-side
# (default of spark.sql.optimizer.windowGroupLimitThreshold).
MAP_SIDE_ROWS = 1000


def top_rows(
    df: DataFrame, group: list[str], order: list, n: int, salt_from: list[str], rank: str = "_rn", n_salts: int = 256
) -> DataFrame:
    """First ``n`` rows per group with their number in ``rank``.

    A larger ``n`` than Spark limits by itself is first applied inside salted
    parts of each group; the final pass then sees at most n_salts * n rows.
    """
    def first(frame, keys):
        window = Window.partitionBy(*keys).orderBy(*order)
        return frame.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)

    if n > MAP_SIDE_ROWS:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_from), F.lit(n_salts)).cast("int"))
        df = first(salted, [*group, "_salt"]).drop("_salt", rank)
    return first(df, group)


def top_hashed(df, group: list[str], ids: list[str], seed, k: int) -> DataFrame:
    """``k`` rows per group without replacement; ``k`` <= 0 keeps all rows."""
    if k <= 0:
        return df
    keyed = df.withColumn("_digest", order_key(seed, *ids))
    return top_rows(keyed, group, ["_digest", *ids], k, ids).drop("_rn", "_digest")


def integer_rank(df, group: list[str], key: str, rank: str, count: str | None = None) -> DataFrame:
    """Position along a unique key, e.g. the file order of a corpus."""
    return range_scan(df, group, [key], rank=rank, count=count)


def series_rank(df, key: list[str], ts: str, tie: str, rank: str, **scan) -> DataFrame:
    """Position of each row in the time order of its series."""
    return range_scan(df, key, [ts, tie], rank=rank, **scan)


def with_blocks(df: DataFrame, position: str, block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    return df.withColumn("block", F.floor((F.col(position) - 1) / F.lit(block_rows)).cast("bigint"))


def with_halo(df: DataFrame, position: str, halo: int, block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Cut a series into blocks, each preceded by the last ``halo`` rows before it.

    Adds ``block`` and ``is_halo``; windows of up to halo+1 rows evaluated per
    block and filtered to ``~is_halo`` equal the windows of the whole series.
    """
    block_rows = max(block_rows, halo)
    at = F.col(position) - 1
    own = F.floor(at / F.lit(block_rows)).cast("bigint")
    near_end = at % F.lit(block_rows) >= F.lit(block_rows - halo)
    blocks = F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))
    return df.withColumn("_own", own).withColumn("block", F.explode(blocks)).withColumn(
        "is_halo", F.col("block") != F.col("_own")
    ).drop("_own")


def with_margins(df: DataFrame, position: str, before: int, after: int, block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Cut a series into blocks that also hold the last ``before`` rows ahead of them and the first ``after`` behind.

    Adds ``block`` and ``is_own``.
    """
    block_rows = max(block_rows, before, after)
    at = F.col(position) - 1
    own = F.floor(at / F.lit(block_rows)).cast("bigint")
    offset = F.pmod(at, F.lit(block_rows))
    # columns alone, without a function per row: this is passed by every row of a series
    low = own - ((offset < after) & (own > 0)).cast("bigint")
    high = own + (offset >= block_rows - before).cast("bigint")
    return df.withColumn("_own", own).withColumn("block", F.explode(F.sequence(low, high))).withColumn(
        "is_own", F.col("block") == F.col("_own")
    ).drop("_own")


def map_stretches(
    df: DataFrame, keys: list[str], order: list[str], fn: Callable[[pa.Table, list[int]], pa.RecordBatch | None], schema: str,
    stretch_rows: int = 65_536,
) -> DataFrame:
    """``fn(rows, bounds)`` for stretches of whole groups of equal ``keys``, sorted by ``order``, as one Arrow pass.

    Spark deals out and sorts the groups; a task holds a stretch of whole groups, or one longer group. Group ``i`` has
    the rows from ``bounds[i]`` to ``bounds[i + 1]``.
    """
    n_keys = len(keys)

    def cuts(rows: pa.Table) -> list[int]:
        differs = np.zeros(max(rows.num_rows - 1, 0), dtype=bool)
        for i in range(n_keys):
            column = rows.column(i).combine_chunks()
            a, b = column.slice(1), column.slice(0, max(len(column) - 1, 0))
            same = pc.or_kleene(pc.equal(a, b), pc.and_(pc.is_null(a), pc.is_null(b))).fill_null(False)
            differs |= ~same.to_numpy(zero_copy_only=False)
        return [0, *(np.flatnonzero(differs) + 1).tolist(), rows.num_rows]

    def run(batches) -> Iterator[pa.RecordBatch]:
        def told(rows: pa.Table, bounds: list[int]) -> Iterator[pa.RecordBatch]:
            out = fn(rows.slice(0, bounds[-1]), bounds)
            if out is not None and out.num_rows:
                yield out

        held, n = [], 0
        for batch in (whole.slice(at, stretch_rows) for whole in batches for at in range(0, whole.num_rows, stretch_rows)):
            held.append(batch)
            n += batch.num_rows
            if n < stretch_rows:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            bounds = cuts(rows)
            if len(bounds) > 2:
                yield from told(rows, bounds[:-1])
                rows = rows.slice(bounds[-2])
            held, n = rows.to_batches(), rows.num_rows
        if n:
            rows = pa.Table.from_batches(held).combine_chunks()
            yield from told(rows, cuts(rows))

    dealt = df.select(*keys, *(c for c in df.columns if c not in keys)).repartition(*keys)
    # a number first: groups are told apart without a look at their keys
    ordered = dealt.withColumn("_deal", F.xxhash64(*keys)).sortWithinPartitions("_deal", *keys, *order).drop("_deal")
    return ordered.mapInArrow(run, schema)


def map_groups(
    df: DataFrame, keys: list[str], order: list[str], fn: Callable[[pa.Table, int, int], pa.RecordBatch | None], schema: str,
    stretch_rows: int = 65_536,
) -> DataFrame:
    """``fn(rows, begin, end)`` for every group of equal ``keys``, sorted by ``order``; many small groups are cheap."""

    def each(rows: pa.Table, bounds: list[int]) -> pa.RecordBatch | None:
        found = [out for begin, end in zip(bounds[:-1], bounds[1:]) if (out := fn(rows, begin, end)) is not None and out.num_rows]
        return pa.Table.from_batches(found).combine_chunks().to_batches()[0] if found else None

    return map_stretches(df, keys, order, each, schema, stretch_rows)
