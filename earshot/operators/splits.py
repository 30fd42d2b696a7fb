"""Leak-free and balanced splits, episode draws, seeded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.functions.hashing import order_key, uniform
from earshot.operators.scans import hash_rank, integer_rank, range_scan, top_hashed, top_rows


def _round_half_even(x: Column) -> Column:
    return F.rint(x).cast("bigint")


def capped_files(files: DataFrame, path: str, n: int, seed) -> DataFrame:
    """The first ``n`` files of a seeded shuffle, all of them where ``n`` is 0: a cap on a corpus that is only sampled."""
    return hash_rank(files, [], [path], seed, "_rn").filter(F.col("_rn") <= n).drop("_rn") if n > 0 else files


def speaker_split(
    records: DataFrame, speaker: str, seed, val_pct: float, test_pct: float, out: str = "split"
) -> DataFrame:
    """Whole speakers to testing, validation, training (in that order of a shuffle).

    At least one speaker each for testing and validation from three speakers on,
    and always at least one for training.
    """
    ranked = hash_rank(records.select(speaker).distinct(), [], [speaker], seed, "_rn", "_n")
    n = F.col("_n")
    share = lambda pct: F.when(n >= 3, F.greatest(F.lit(1), _round_half_even(n * pct / 100.0))).otherwise(0)
    crowded = n - share(test_pct) - share(val_pct) < 1
    n_test = F.when(crowded, F.greatest(F.lit(0), n - 1)).otherwise(share(test_pct))
    n_val = F.when(crowded, F.lit(0)).otherwise(share(val_pct))
    split = (
        F.when(F.col("_rn") <= n_test, "testing")
        .when(F.col("_rn") <= n_test + n_val, "validation")
        .otherwise("training")
    )
    return records.join(ranked.select(speaker, split.alias(out)), speaker)


def manifest_split(records: DataFrame, speaker: str, seed, out: str = "split") -> DataFrame:
    """Five per cent of the speakers each to val and test, val first; others train."""
    ranked = hash_rank(records.select(speaker).distinct(), [], [speaker], seed, "_rn", "_n")
    n = F.col("_n")
    share = F.when(n >= 3, F.greatest(F.lit(1), _round_half_even(n * 0.05))).otherwise(0)
    share = F.when(2 * share >= n, F.when(n >= 3, 1).otherwise(0)).otherwise(share)
    split = F.when(F.col("_rn") <= share, "val").when(F.col("_rn") <= 2 * share, "test").otherwise("train")
    assigned = ranked.select(speaker, split.alias(out))
    return records.join(assigned, speaker, "left").withColumn(out, F.coalesce(out, F.lit("train")))


def merge_validation(split: Column, into: str) -> Column:
    return F.when(split == "validation", F.lit(into)).otherwise(split)


def _ratio(rank: str, n: str) -> Column:
    n_train = F.floor(F.col(n) * 0.8)
    n_val = F.floor(F.col(n) * 0.1)
    return (
        F.when(F.col(rank) <= n_train, "training")
        .when(F.col(rank) <= n_train + n_val, "validation")
        .otherwise("testing")
    )


def ratio_split_by_speaker(records: DataFrame, speaker: str, seed, out: str) -> DataFrame:
    ranked = hash_rank(records.select(speaker).distinct(), [], [speaker], seed, "_rn", "_n")
    return records.join(ranked.select(speaker, _ratio("_rn", "_n").alias(out)), speaker)


def ratio_split_by_row(records: DataFrame, row_id: str, seed, out: str) -> DataFrame:
    return hash_rank(records, [], [row_id], seed, "_rn", "_n").withColumn(out, _ratio("_rn", "_n")).drop("_rn", "_n")


def half_split(
    records: DataFrame, label: str, row_id: str, seed, sampled: list[str], fraction: float, out: str = "split"
) -> DataFrame:
    """First half of each class to training, the rest to testing.

    Classes in ``sampled`` are first cut to ``fraction`` of their rows, then halved together.
    """
    pool = F.when(F.col(label).isin(*sampled), F.lit("_sampled_")).otherwise(F.col(label))
    ranked = hash_rank(records.withColumn("_pool", pool), ["_pool"], [row_id], seed, "_rn", "_n")
    kept = F.when(F.col("_pool") == "_sampled_", _round_half_even(F.col("_n") * fraction)).otherwise(F.col("_n"))
    return (
        ranked.withColumn("_kept", kept)
        .filter(F.col("_rn") <= F.col("_kept"))
        .withColumn(out, F.when(F.col("_rn") <= F.floor(F.col("_kept") / 2), "training").otherwise("testing"))
        .drop("_pool", "_rn", "_n", "_kept")
    )


def balanced_cap(records: DataFrame, split: str, label: str, order: str) -> DataFrame:
    """First N records of each class in file order, N = smallest class of the split."""
    ranked = integer_rank(records, [split, label], order, "_rn")
    smallest = (
        records.groupBy(split, label).agg(F.count(F.lit(1)).alias("_c")).groupBy(split).agg(F.min("_c").alias("_min"))
    )
    return ranked.join(smallest, split).filter(F.col("_rn") <= F.col("_min")).drop("_rn", "_min")


def attribute_split(block: Column, training: list[str], testing: list[str]) -> Column:
    return F.when(block.isin(*training), "training").when(block.isin(*testing), "testing")


def episode_classes(classes: DataFrame, label: str, n_episodes: int, n_way: int, seed, fixed: list[str] = ()) -> DataFrame:
    """``n_way`` classes per episode without replacement; ``fixed`` ones always first."""
    drawn = classes.select(
        label, F.explode(F.sequence(F.lit(0), F.lit(n_episodes - 1))).alias("episode")
    ).withColumn("_key", order_key(seed, "episode", label))
    is_fixed = F.when(F.col(label).cast("string").isin(*fixed), 0).otherwise(1) if fixed else F.lit(1)
    window = Window.partitionBy("episode").orderBy(is_fixed, "_key")
    return (
        drawn.withColumn("class_pos", F.row_number().over(window) - 1)
        .filter(F.col("class_pos") < n_way)
        .drop("_key")
    )


def draw_numbers(n: Column, k: int, seed, *names: str) -> Column:
    """``k`` different numbers of 1..n (all, if fewer) as an array, by the hash of ``names`` and the step alone.

    Step j of n-k+1..n takes a number of 1..j, or j itself where that one has been taken; every set of numbers is as
    likely as any other.
    """
    steps = F.sequence(F.greatest(F.lit(1).cast("bigint"), n - k + 1), n)

    def take(taken, j):
        number = (F.floor(uniform(seed, *names, j) * j) + 1).cast("bigint")
        return F.concat(taken, F.array(F.when(F.array_contains(taken, number), j).otherwise(number)))

    return F.when(n > 0, F.aggregate(steps, F.array().cast("array<bigint>"), take))


def episode_support(
    rows: DataFrame, episodes: DataFrame, label: str, row_id: str, k: int, seed
) -> DataFrame:
    """``k`` rows of every drawn class of every episode, drawn by number.

    The rows of a class are numbered once; an episode costs its ``k`` numbers per class, however many rows there are.
    """
    if k <= 0:
        return rows.join(episodes, label)
    numbered = range_scan(rows, [label], [row_id], rank="_no")
    sizes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    drawn = episodes.join(sizes, label).select(
        "episode", label, F.posexplode(draw_numbers(F.col("_n"), k, seed, "episode", label)).alias("_pos", "_no")
    )
    return drawn.join(numbered, [label, "_no"]).withColumn("sample_no", F.col("_pos") + 1).drop("_pos", "_no")


def review_sample(rows: DataFrame, category: str, row_id: str, seed, per_category: int = 25) -> DataFrame:
    return top_hashed(rows, [category], [row_id], seed, per_category)


def rows_from_counts(counts: DataFrame, n: str, out: str, chunk: int = 10_000) -> DataFrame:
    """``n`` rows numbered 1..n for each input row, generated in chunks.

    Two nested generators with a shuffle between keep every array small, so one
    input row may ask for any number of rows.
    """
    chunks = counts.filter(F.col(n) > 0).withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(n) - 1) / F.lit(chunk)).cast("bigint")))
    )
    spread = chunks.repartition("_chunk")
    first = F.col("_chunk") * chunk + 1
    last = F.least(F.col(n), (F.col("_chunk") + 1) * chunk).cast("bigint")
    return spread.withColumn(out, F.explode(F.sequence(first, last))).drop("_chunk")


def random_slice(duration: Column, min_sec: float, max_sec: float, u_dur: Column, u_off: Column, margin: float = 0.05):
    """(offset, duration) columns of a uniform slice; NULL when the source is too short."""
    usable = duration - F.lit(margin)
    high = F.least(F.lit(max_sec), usable)
    length = F.when(high > min_sec, F.lit(min_sec) + u_dur * (high - min_sec)).otherwise(F.lit(min_sec))
    room = usable - length
    offset = F.when(room > 0, u_off * room).otherwise(F.lit(0.0))
    fits = usable >= min_sec
    return F.when(fits, offset), F.when(fits, length)


def assign_background(records: DataFrame, row_id: str, backgrounds: DataFrame, bg_id: str, seed) -> DataFrame:
    """One background per record: entry floor(u * n) of the numbered list."""
    numbered = integer_rank(backgrounds, [], bg_id, "_no", "_total")
    total = backgrounds.agg(F.count(F.lit(1))).scalar()
    pick = (F.floor(uniform(seed, row_id) * total) + 1).cast("bigint")
    return records.withColumn("_no", pick).join(numbered.select("_no", bg_id), "_no").drop("_no")


def weighted_sample(
    weights: DataFrame, row_id: str, weight: str, draws: DataFrame, draw_id: str, seed, carry: list[str] = ()
) -> DataFrame:
    """Weighted draws with replacement: each draw with the row it takes and that row's ``carry`` columns.

    Weights become consecutive ranges of [0, total); each draw takes the range
    its number falls into. Ranges and numbers are merged in one ordered scan,
    so neither side is paired with the other and no row weight causes skew.
    """
    ranges = range_scan(
        weights.filter(F.col(weight) > 0).select(row_id, weight, *carry), [], [row_id],
        sums={"_hi": F.col(weight)}, totals={"_total": F.col(weight)},
    )
    starts = ranges.select(
        ((F.col("_hi") - F.col(weight)) / F.col("_total")).alias("_at"),
        F.lit(0).alias("_kind"), F.col(row_id).cast("bigint").alias("_row"), F.lit(None).cast("bigint").alias(draw_id), *carry,
    )
    types = dict(weights.dtypes)
    points = draws.select(
        uniform(seed, draw_id).alias("_at"),
        F.lit(1).alias("_kind"), F.lit(None).cast("bigint").alias("_row"), F.col(draw_id).cast("bigint").alias(draw_id),
        *(F.lit(None).cast(types[c]).alias(c) for c in carry),
    )
    merged = starts.unionByName(points).withColumn("_tie", F.coalesce("_row", draw_id))
    owner = F.when(F.col("_kind") == 0, F.struct("_at", "_row", *carry))
    scanned = range_scan(merged, [], ["_at", "_kind", "_tie"], maxes={"_owner": owner})
    return scanned.filter(F.col("_kind") == 1).select(
        draw_id, F.col("_owner._row").alias(row_id), *(F.col(f"_owner.{c}").alias(c) for c in carry)
    )


def epoch_size(records: DataFrame, label: str, per_class: int) -> int:
    """Draws of an epoch: ``per_class`` for every class, or as many as there are records where that is 0."""
    if per_class > 0:
        return per_class * records.agg(F.count_distinct(label)).first()[0]
    return records.count()


def epoch_batches(
    weights: DataFrame, row_id: str, weight: str, length: str, n_draws: int, batch_size: int, bucket_samples: int, seed
) -> DataFrame:
    """An epoch of weighted draws with replacement, in batches of like length, the batches shuffled.

    ``draw_no, row_id, length, batch`` (in the order of lengths) ``, place`` (of the batch in the epoch). A row that is
    drawn very often spreads like any other, as draws carry their length along and are ordered by range.
    """
    spark = weights.sparkSession
    draws = spark.range(1, n_draws + 1).withColumnRenamed("id", "draw_no")
    drawn = weighted_sample(weights, row_id, weight, draws, "draw_no", seed, [length])
    batched = length_buckets(drawn, "draw_no", length, bucket_samples, batch_size)
    # one row per batch
    batches = spark.range(-(-n_draws // batch_size)).withColumnRenamed("id", "batch")
    places = hash_rank(batches, [], ["batch"], seed, "place")
    return batched.join(places, "batch")


def length_buckets(df: DataFrame, row_id: str, length: str, bucket_samples: int, batch_size: int) -> DataFrame:
    """Batch number after sorting by (length bucket, length): neighbours share a batch."""
    bucket = F.floor(F.col(length) / bucket_samples).cast("int") if bucket_samples > 0 else F.lit(0)
    keyed = df.withColumn("bucket", bucket).withColumn("_digest", order_key("len", row_id))
    ranked = range_scan(keyed, [], [length, "_digest", row_id], rank="_rn")
    return ranked.withColumn("batch", F.floor((F.col("_rn") - 1) / batch_size).cast("bigint")).drop("_rn", "_digest")
