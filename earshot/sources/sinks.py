"""Writers: manifests, reports, metrics and model tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot import presets
from earshot.functions.hashing import clip_path


def manifest_rows(candidates: DataFrame, dataset: str = "LibriSpeech") -> DataFrame:
    """Candidates in manifest form: lists joined by blanks, numbers with four digits."""
    def digits(c: str) -> Column:
        return F.format_string("%.4f", F.col(c).cast("double"))

    formatted = candidates.withColumns({
        "wav_path": clip_path(F.col("source_utt_id"), F.col("start_sec"), F.col("end_sec"), F.col("category")),
        "label": F.lit(presets.UNKNOWN_LABEL), "source_dataset": F.lit(dataset),
        **{c: F.array_join(c, " ") for c in ("words", "phones", "normalized_phones")},
    })
    numbers = {c: digits(c) for c in ("start_sec", "end_sec", "duration_sec", "similarity")}
    return formatted.withColumns({**numbers, "edit_distance": F.col("edit_distance").cast("string")}).select(
        *presets.MANIFEST_FIELDS, *(["split"] if "split" in candidates.columns else [])
    )


def write_manifests(rows: DataFrame, folder: str) -> None:
    """``all`` plus one folder per split, CSV with a header, ordered within each file."""
    order = ["source_split", "speaker_id", "chapter_id", "source_utt_id", "start_sec"]
    writer = rows.drop("split").sortWithinPartitions(*order).write.mode("overwrite").option("header", True)
    writer.csv(f"{folder}/all")
    by_split = rows.repartition("split", F.pmod(F.xxhash64("source_utt_id"), F.lit(64))).sortWithinPartitions("split", *order)
    by_split.write.mode("overwrite").partitionBy("split").option("header", True).csv(f"{folder}/by_split")


def write_report(report: DataFrame, folder: str) -> None:
    report.write.mode("overwrite").option("header", True).csv(folder)


def append_metrics(metrics: DataFrame, folder: str) -> None:
    metrics.write.mode("append").json(folder)


def save_model(prototypes: DataFrame, meta: DataFrame, folder: str) -> str:
    """New version of a model table; a small pointer row names the current one.

    A version is complete before the pointer mentions it, so a reader never
    sees a half-written model, and a model may be rebuilt from itself.
    """
    version = uuid.uuid4().hex
    prototypes.write.parquet(f"{folder}/versions/{version}/prototypes")
    meta.write.parquet(f"{folder}/versions/{version}/meta")
    pointer = prototypes.sparkSession.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("at"))
    pointer.write.mode("append").parquet(f"{folder}/pointer")
    return version


def load_model(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    latest = spark.read.parquet(f"{folder}/pointer").agg(F.max_by("version", "at").alias("v")).first()["v"]
    base = f"{folder}/versions/{latest}"
    return spark.read.parquet(f"{base}/prototypes"), spark.read.parquet(f"{base}/meta")
