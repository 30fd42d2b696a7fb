"""Tables, intermediate tables and Arrow helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one is chosen only where the setting is missing, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="earshot-shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named


class Scratch:
    """Intermediate tables of one call, written to the shared folder under a name of their own.

    A written table cuts the lineage and survives lost executors. ``drop`` deletes a table that a later
    one has superseded; what the result still reads stays.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns that an operator's own ``names`` replace."""
    return df.drop(*(c for c in df.columns if c.lower() in names))


def with_row_key(df: DataFrame, name: str = "row_key") -> DataFrame:
    """A number per row (input split and place in it), for a plan that is run once: another read of the same table may
    split it otherwise, as splits follow the cores that are there."""
    return df.withColumn(name, F.monotonically_increasing_id())


def numbered(df: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows with ``row_key``, written once; all passes over that table see the same numbers."""
    return scratch.write(with_row_key(df), "numbered")


def text_chunks(column: pa.Array, max_bytes: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column whose bytes stay near ``max_bytes``; a longer row is alone."""
    begin = size = 0
    lengths = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    for i, n in enumerate(lengths):
        if i > begin and size + n > max_bytes:
            yield begin, i
            begin, size = i, 0
        size += int(n)
    if begin < len(lengths):
        yield begin, len(lengths)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return df.mapInArrow(run, schema)


def grouped(
    df: DataFrame, keys: list[str], fn: Callable[[pa.Table, list[tuple[int, int]]], Iterator[pa.RecordBatch]], schema: str,
    max_rows: int = 20_000,
) -> DataFrame:
    """``fn(rows, group bounds)`` over whole groups of equal keys, many small groups per call.

    The groups are dealt out and sorted by Spark; ``fn`` sees the rows of a stretch of complete groups. Only a single
    group may have more than ``max_rows`` rows, so callers bound the size of their groups.
    """
    n_keys = len(keys)

    def bounds_of(rows: pa.Table) -> list[int]:
        change = None
        for i in range(n_keys):
            column = rows.column(i).combine_chunks()
            differs = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1))
            change = differs if change is None else pc.or_(change, differs)
        return [0, *(pc.indices_nonzero(change).to_numpy() + 1).tolist(), rows.num_rows]

    def run(batches):
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n < max_rows:
                continue
            rows = pa.Table.from_batches(held)
            bounds = bounds_of(rows)
            if len(bounds) > 2:
                whole = bounds[-2]
                yield from fn(rows.slice(0, whole).combine_chunks(), list(zip(bounds[:-2], bounds[1:-1], strict=True)))
                held = rows.slice(whole).combine_chunks().to_batches()
                n = rows.num_rows - whole
        if n:
            rows = pa.Table.from_batches(held).combine_chunks()
            bounds = bounds_of(rows)
            yield from fn(rows, list(zip(bounds[:-1], bounds[1:], strict=True)))

    ordered = df.select(*keys, *(c for c in df.columns if c not in keys)).repartition(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(run, schema)


class Forest:
    """Union-find over 0..n-1 with the spanning links that were made."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def join(self, a: int, others: np.ndarray) -> None:
        """Unite ``a`` with each of ``others``."""
        labels = np.unique(self.label[others])
        labels = labels[labels != self.label[a]]
        if len(labels):
            first = {}
            for o, lab in zip(others.tolist(), self.label[others].tolist(), strict=True):
                first.setdefault(lab, o)
            self.links += [(a, first[lab]) for lab in labels.tolist()]
            self.label[np.isin(self.label, labels)] = self.label[a]
