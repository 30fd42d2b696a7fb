"""Corpus records: shape, filters, class dictionaries, rejection sources, weights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from earshot import presets


def path_records(files: DataFrame, path: str) -> DataFrame:
    """(label, file, speaker) from ``.../<label>/<speaker>_....wav`` paths."""
    parts = F.split(F.col(path), "/")
    label = F.lower(F.element_at(parts, -2))
    speaker = F.element_at(F.split(F.element_at(parts, -1), "_"), 1)
    records = files.filter(F.size(parts) >= 2).select(
        *files.columns, label.alias("label"), F.col(path).alias("file"), speaker.alias("speaker")
    )
    return records.filter(F.col("label") != presets.BACKGROUND_NOISE_DIR)


def take_records(files: DataFrame, path: str, channel: str) -> DataFrame:
    """Records from ``<wake>/<employee>/<take>/<channel>.wav``; background folders are skipped."""
    parts = F.split(F.col(path), "/")
    wake, speaker, take = (F.element_at(parts, -k) for k in (4, 3, 2))
    return (
        files.filter(F.size(parts) >= 4)
        .filter(F.element_at(parts, -1) == f"{channel}.wav")
        .filter(~wake.endswith(presets.BACKGROUND_DIR_SUFFIX) & ~speaker.endswith(presets.BACKGROUND_DIR_SUFFIX))
        .select(wake.alias("label"), F.col(path).alias("file"), speaker.alias("speaker"), take.alias("take"))
    )


def filename_parts(df: DataFrame, name: str) -> DataFrame:
    """Speaker, block, word id and channel of names with exactly four parts."""
    parts = F.split(F.col(name), "_")
    return df.filter(F.size(parts) == 4).select(
        "*", parts[0].alias("speaker"), parts[1].alias("block"), parts[2].alias("word_id"), parts[3].alias("channel")
    )


def class_role(label: Column, positives: list[str], negatives: list[str]) -> Column:
    return (
        F.when(label.isin(*positives), "positive")
        .when(label.isin(*negatives), "negative")
        .otherwise("rest")
    )


def task_presets(spark: SparkSession) -> DataFrame:
    """``task, label, role``: the word lists of the named tasks, positive and negative ones."""
    rows = [(task, word, role) for task, lists in presets.TASKS.items() for role, words in zip(("positive", "negative"), lists) for word in words]
    return spark.createDataFrame(rows, "task string, label string, role string")


def records_of_tasks(records: DataFrame, label: str, tasks: list[str]) -> DataFrame:
    """Records whose label belongs to one of ``tasks``, once per task, with ``task`` and ``role``."""
    unknown = [t for t in tasks if t not in presets.TASKS]
    if unknown:
        raise ValueError(f"no such task: {', '.join(unknown)}")
    wanted = task_presets(records.sparkSession).filter(F.col("task").isin(*tasks)).withColumnRenamed("label", label)
    return records.join(wanted, label)


def group_by_prefix(name: Column, groups: dict[str, str]) -> Column:
    """The group whose prefix ``name`` has, the first that fits; NULL without one."""
    hits = [F.when(name.startswith(prefix), group) for prefix, group in groups.items()]
    return F.coalesce(*hits)


def partition_by_class(records: DataFrame, classes: list[str], label: str = "label"):
    """(matching records, remaining records)."""
    hit = F.coalesce(F.col(label).isin(*classes), F.lit(False))
    return records.filter(hit), records.filter(~hit)


def class_list(wanted: list[str], silence: bool, unknown: bool) -> list[str]:
    extra = [presets.SILENCE_LABEL] * silence + [presets.UNKNOWN_LABEL] * unknown
    return extra + list(wanted)


def class_index(records: DataFrame, label: str = "label") -> DataFrame:
    """Dimension (label, class_idx, class_idx_unknown_last, is_reject).

    Reserved labels come first; the second index counts the known classes and
    puts the unknown class behind them.
    """
    reserved = [presets.UNKNOWN_LABEL, presets.SILENCE_LABEL]
    labels = records.select(label).distinct()
    order = (
        F.when(F.col(label) == reserved[0], 0).when(F.col(label) == reserved[1], 1).otherwise(2)
    )
    tail = F.when(F.col(label) == reserved[0], 2).otherwise(1)
    return labels.select(
        label,
        (F.row_number().over(Window.orderBy(order, label)) - 1).alias("class_idx"),
        (F.row_number().over(Window.orderBy(tail, label)) - 1).alias("class_idx_unknown_last"),
        F.col(label).isin(*reserved).alias("is_reject"),
    )


def class_coverage(records: DataFrame, wanted: list[str], label: str = "label") -> DataFrame:
    """One row per wanted class with its record count; 0 marks a missing class."""
    counts = records.filter(F.col(label).isin(*wanted)).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    seen = F.map_from_entries(F.collect_list(F.struct(label, "n")))
    return counts.agg(seen.alias("seen")).select(
        F.explode(F.array(*[F.lit(w) for w in wanted])).alias(label), "seen"
    ).select(label, F.coalesce(F.element_at("seen", F.col(label)), F.lit(0)).alias("n"))


def require_classes(records: DataFrame, wanted: list[str], label: str = "label") -> DataFrame:
    """Coverage rows; reading the result fails when a wanted class is absent."""
    return class_coverage(records, wanted, label).withColumn(
        "n",
        F.when(F.col("n") > 0, F.col("n")).otherwise(
            F.raise_error(F.concat(F.lit("no records for class "), F.col(label))).cast("bigint")
        ),
    )


def first_word_lookup(facts: DataFrame, dim: DataFrame, key: str, word: str, order: str) -> DataFrame:
    """Look an id up in a dimension whose ids may repeat; the first entry wins."""
    unique = dim.groupBy(key).agg(F.min_by(word, order).alias(word))
    return facts.join(unique, key)


def unknown_source(
    is_silence: Column, explicit: Column, speaker: Column
) -> Column:
    """Source bucket of a rejection record; the first matching rule decides."""
    speaker = F.coalesce(speaker, F.lit(""))
    return (
        F.when(F.coalesce(is_silence, F.lit(False)), "silence")
        .when(F.coalesce(explicit, F.lit("")) != "", explicit)
        .when(speaker.startswith("hard_negative_"), "hard_negative")
        .when(speaker == "gsc_unknown", "gsc_words")
        .when(speaker.startswith("librispeech_"), "librispeech")
        .when(speaker.startswith("gsc_noise_"), "gsc_noise")
        .when(speaker == "background", "company_background")
        .otherwise("unknown_other")
    )


def effective_length(
    is_silence: Column, silence_sec: Column, slice_sec: Column, file_samples: Column, rate: int, max_samples: int
) -> Column:
    """Length in samples: silence, else slice, else file clamped to the maximum."""
    def seconds(x):
        return F.greatest(F.lit(1), F.floor(x * rate).cast("int"))

    whole_file = F.least(F.greatest(F.lit(1), F.coalesce(file_samples, F.lit(max_samples)).cast("int")), F.lit(max_samples))
    return F.coalesce(
        F.when(is_silence & silence_sec.isNotNull(), seconds(silence_sec)),
        F.when(slice_sec.isNotNull(), seconds(slice_sec)),
        whole_file,
    )


def union_records(parts: list[DataFrame], defaults: dict) -> DataFrame:
    """Union of record tables with different columns; gaps get typed defaults."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return merged.fillna(defaults)


def parse_options(text: Column) -> Column:
    """``k=v,k=v`` to a map of doubles; an entry without ``=`` is an error."""
    items = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    checked = F.transform(
        items,
        lambda x: F.when(x.contains("="), x).otherwise(
            F.raise_error(F.concat(F.lit("entries must be name=value, got "), x)).cast("string")
        ),
    )
    return F.map_from_entries(
        F.transform(
            checked,
            lambda x: F.struct(
                F.trim(F.substring_index(x, "=", 1)).alias("k"),
                F.trim(F.regexp_replace(x, "^[^=]*=", "")).cast("double").alias("v"),
            ),
        )
    )


def filter_options(options: Column, tag: str) -> Column:
    """Entries ``tag.x`` of a flat option map, with the prefix removed."""
    kept = F.map_filter(options, lambda k, _: F.substring_index(k, ".", 1) == tag)
    return F.transform_keys(kept, lambda k, _: F.substr(k, F.lit(len(tag) + 2)))


def lookup_weight(weights: dict[str, float], key: Column, default: float) -> Column:
    if not weights:
        return F.lit(default)
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return F.coalesce(F.element_at(table, key), F.lit(default))


def sample_weights(
    records: DataFrame,
    source_weights: dict[str, float],
    category_weights: dict[str, float] | None = None,
    label: str = "label",
    source: str = "source",
    category: str = "hardneg_category",
) -> DataFrame:
    """Sampling weight per record.

    A known class weighs 1 in total. The unknown class weighs 1 in total too,
    shared over its active sources, and hard negatives over their categories.
    """
    unknown = F.col(label) == presets.UNKNOWN_LABEL
    is_hard = unknown & (F.col(source) == "hard_negative")
    keyed = records.withColumn("_source", F.when(unknown, F.col(source)).otherwise(F.lit(""))).withColumn(
        "_category",
        F.when(is_hard, F.coalesce(F.col(category), F.lit("unknown_hard_negative"))).otherwise(F.lit("")),
    )
    cells = keyed.groupBy(label, "_source", "_category").agg(F.count(F.lit(1)).alias("_n"))
    other = source_weights.get("unknown_other", 0.0)
    cells = cells.withColumn(
        "_sw", F.when(unknown, F.greatest(F.lit(0.0), lookup_weight(source_weights, F.col("_source"), other)))
    ).withColumn(
        "_cw",
        F.when(F.col("_category") != "", F.greatest(F.lit(0.0), lookup_weight(category_weights or {}, F.col("_category"), 1.0))),
    )
    per_label, per_source = Window.partitionBy(label), Window.partitionBy(label, "_source")
    # A source counts once however many categories it has.
    share = F.when(F.row_number().over(per_source.orderBy("_category")) == 1, F.col("_sw"))
    cells = cells.withColumn("_first", share)
    total_source = F.sum("_first").over(per_label)
    total_category = F.sum("_cw").over(per_source)

    def positive(value, what):
        return F.when(value > 0, value).otherwise(F.raise_error(F.lit(f"all active {what} weights are <= 0")).cast("double"))

    weight = (
        F.when(~unknown, F.lit(1.0) / F.sum("_n").over(per_label))
        .when(
            F.col("_category") != "",
            F.col("_sw") / positive(total_source, "source") * (F.col("_cw") / positive(total_category, "category")) / F.col("_n"),
        )
        .otherwise(F.col("_sw") / positive(total_source, "source") / F.sum("_n").over(per_source))
    )
    cells = cells.select(label, "_source", "_category", weight.alias("weight"))
    return keyed.join(cells, [label, "_source", "_category"]).drop("_source", "_category")


def category_counts(df: DataFrame, category: str, known: list[str]) -> DataFrame:
    """Row count per category, with a 0 row for known categories without rows."""
    zeros = df.sparkSession.createDataFrame([(k, 0) for k in known], f"{category} string, _one long")
    rows = df.groupBy(category).agg(F.count(F.lit(1)).alias("_one"))
    return rows.unionByName(zeros).groupBy(category).agg(F.sum("_one").alias("n"))


def duration_stats(df: DataFrame, category: str, value: str, known: list[str]) -> DataFrame:
    """Count, min, median, mean, p95 and max per category, NULLs for empty ones.

    Percentiles interpolate linearly and are exact: equal durations are counted
    first, and the two neighbouring order statistics are found by a sliced
    running count, so a hot category is never collected.
    """
    from earshot.operators.scans import range_scan

    base = df.filter(F.col(value).isNotNull())
    stats = base.groupBy(category).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(value).alias("min"),
        F.avg(value).alias("mean"),
        F.max(value).alias("max"),
    )
    distinct = base.groupBy(category, value).agg(F.count(F.lit(1)).alias("_c"))
    ranked = range_scan(distinct, [category], [value], sums={"_upto": F.col("_c")}, totals={"_all": F.col("_c")})

    def order_statistic(rank: Column) -> Column:
        hit = (F.col("_upto") >= rank) & (F.col("_upto") - F.col("_c") < rank)
        return F.max(F.when(hit, F.col(value)))

    def at(fraction, ceil=False):
        position = (F.col("_all") - 1) * F.lit(fraction)
        return (F.ceil(position) if ceil else F.floor(position)) + 1

    picked = ranked.groupBy(category).agg(
        F.max("_all").alias("_all"),
        *[order_statistic(at(f, c)).alias(f"_{n}") for n, f, c in
          [("m0", 0.5, False), ("m1", 0.5, True), ("p0", 0.95, False), ("p1", 0.95, True)]],
    )

    def blend(lo, hi, fraction):
        position = (F.col("_all") - 1) * F.lit(fraction)
        part = position - F.floor(position)
        return F.col(lo) * (F.lit(1.0) - part) + F.col(hi) * part

    picked = picked.select(category, blend("_m0", "_m1", 0.5).alias("p50"), blend("_p0", "_p1", 0.95).alias("p95"))
    dim = category_counts(df, category, known).select(category)
    return (
        dim.join(stats, category, "left").join(picked, category, "left")
        .select(category, F.coalesce("n", F.lit(0)).alias("n"), "min", "p50", "mean", "p95", "max")
    )


def top_classes(records: DataFrame, label: str, order: str, n_classes: int | None, min_count: int, stop: list[str]) -> DataFrame:
    """Most frequent classes with more than ``min_count`` records, ties by first appearance."""
    counts = records.filter(~F.col(label).isin(*stop)).groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seen")
    )
    ordered = counts.orderBy(F.desc("n"), "first_seen", label)
    if n_classes is not None:
        ordered = ordered.limit(n_classes)
    return ordered.filter(F.col("n") > min_count)


def split_stats(records: DataFrame, label: str, split: str = "split") -> DataFrame:
    per_class = records.groupBy(split, label).agg(F.count(F.lit(1)).alias("c"))
    return per_class.groupBy(split).agg(
        F.count(F.lit(1)).alias("n_classes"),
        F.min("c").alias("min_samples"),
        F.max("c").alias("max_samples"),
        F.sum("c").alias("total_samples"),
        F.avg("c").alias("avg_samples"),
    )
