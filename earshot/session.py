"""Session helpers: table access, checkpoint folder, written intermediates."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# The most bytes of a model that a task holds at once.
MODEL_PART_BYTES = 64 * 1024 * 1024


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for lineage cuts: that of ``spark.checkpoint.dir``, one of its own only where that is unset, as in tests."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="earshot-checkpoint-")
        context.setCheckpointDir(named)
    return named


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows out by ``keys`` before heavy work on each row; adaptive execution picks the number of tasks."""
    return df.repartition(*keys)


def materialize(df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
    """Write an expensive intermediate once to the checkpoint folder and read it back.

    The written table survives the loss of executors and cuts the lineage; later
    passes read only the columns they need. ``replaces`` is a table of an earlier
    round that nothing reads any more; it is deleted.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/earshot-{uuid.uuid4().hex}"
    df.write.parquet(path)
    old = getattr(replaces, "_written_to", None)
    if old:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(old)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out
