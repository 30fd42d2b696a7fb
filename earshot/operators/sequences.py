"""Windows, smoothing and runs along time-ordered series of any length.

``position`` is the 1-based row number inside a series (see ``series_rank``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.operators.scans import bucketed_scan, with_blocks, with_halo


def rolling_window(
    df: DataFrame, key: list[str], position: str, width: int, hop: int, aggs: dict[str, Column], block_rows: int = 4096
) -> DataFrame:
    """Aggregates of the last ``width`` rows, every ``hop`` rows once the window is full."""
    blocks = with_halo(df, position, width - 1, block_rows)
    w = Window.partitionBy(*key, "block").orderBy(position).rowsBetween(-(width - 1), 0)
    out = blocks.select("*", *[a.over(w).alias(n) for n, a in aggs.items()])
    due = (F.col(position) >= width) & (F.pmod(F.col(position) - width, F.lit(hop)) == 0)
    return out.filter(~F.col("is_halo") & due).drop("block", "is_halo")


def ema(df: DataFrame, key: list[str], position: str, columns: dict[str, str], alpha: float) -> DataFrame:
    """Exponential smoothing s1 = p1, s = alpha*p + (1-alpha)*s, one output per column.

    A sample's weight falls below double precision after ``halo`` rows, so a
    block with that halo gives the values of the whole series. Inside a block
    the recurrence is a running sum of p / decay**i, times decay**i.
    """
    decay = 1.0 - alpha
    if decay <= 0:
        return df.withColumns({out: F.col(c) for out, c in columns.items()})
    halo = math.ceil(64 * math.log(2) / -math.log(decay))
    longest = int(600 / -math.log(decay))
    if longest <= 2 * halo:
        raise ValueError("alpha outside the supported range")
    block_rows = min(max(4096, halo), longest - halo)
    blocks = with_halo(df, position, halo, block_rows)
    w = Window.partitionBy(*key, "block").orderBy(position)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    index = (F.col(position) - F.col("block") * F.lit(block_rows)).cast("double")
    weight = F.when(F.col(position) == 1, F.lit(1.0)).otherwise(F.lit(alpha))
    growth, shrink = F.pow(F.lit(1.0 / decay), index), F.pow(F.lit(decay), index)
    blocks = blocks.withColumns({
        out: F.sum(weight * F.col(c) * growth).over(running) * shrink for out, c in columns.items()
    })
    return blocks.filter(~F.col("is_halo")).drop("block", "is_halo")


def streaks(
    df: DataFrame, key: list[str], position: str, above: Column, label: str, prev_above: Column, prev_label: str,
    out: str = "streak", block_rows: int = 4096,
) -> DataFrame:
    """Number of consecutive rows above the threshold with the same label, 0 below it.

    The columns of the previous row come from the same scan that numbered the series.
    """
    starts = above & (~F.coalesce(prev_above, F.lit(False)) | ~(F.col(label).eqNullSafe(F.col(prev_label))))
    marked = with_blocks(df, position, block_rows).withColumn("_begin", F.when(starts, F.col(position)))
    scanned = bucketed_scan(marked, key, "block", [position], maxes={"_since": F.col("_begin")})
    return scanned.withColumn(
        out, F.when(above, F.col(position) - F.col("_since") + 1).otherwise(F.lit(0)).cast("bigint")
    ).drop("block", "_begin", "_since")


def energy_crop(
    df: DataFrame, key: list[str], position: str, value: str, width: int, hop: int = 1, block_rows: int = 4096
) -> DataFrame:
    """Start (0-based) of the window of ``width`` frames with the highest energy.

    Starts lie on the hop grid, the first maximum wins, a shorter series starts at 0.
    """
    blocks = with_halo(df.withColumn("_sq", F.col(value) * F.col(value)), position, width, max(block_rows, width))
    w = Window.partitionBy(*key, "block").orderBy(position)
    total = F.sum("_sq").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sums = blocks.withColumn("_total", total).withColumn(
        "_energy", F.col("_total") - F.coalesce(F.lag("_total", width).over(w), F.lit(0.0))
    )
    start = F.col(position) - F.lit(width)
    on_grid = (start >= 0) & (F.pmod(start, F.lit(hop)) == 0) & ~F.col("is_halo")
    best = F.max(F.when(on_grid, F.struct(F.col("_energy").alias("e"), (-start).alias("s"))))
    return sums.groupBy(*key).agg(best.alias("_b")).select(
        *key, F.coalesce(-F.col("_b.s"), F.lit(0)).alias("start"), F.col("_b.e").alias("energy")
    )
