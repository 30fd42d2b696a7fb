"""Near-equal vectors by random-hyperplane signs in several tables, exact cosines and connected components.

Equal vectors of a label are one class with a weight. Each table gives a class a code of sign bits; classes that share
the code of a table meet there, and every pair is compared by its cosine in double precision. A pair is counted in the
first table it shares, so nothing has to be made distinct. Per bucket only link counts and the links of a spanning
forest are returned, never pairs. Buckets above a block are cut and each pair of blocks is a task.

The number of bits follows the number of classes (buckets stay small at every size), the number of tables follows from
the bits: a pair at the threshold is missed with probability ``MISS``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm import rolling
from earshot.llm.components import components
from earshot.llm.store import Forest, Scratch, arrow_map, grouped

MISS = 1e-6
BLOCK = 2048


def table_shape(n: int, cosine: float) -> tuple[int, int]:
    """Bits and tables for ``n`` classes."""
    bits = max(10, math.ceil(math.log2(max(n, 2))))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log1p(-same))


def vectors_of(column: pa.Array) -> list[np.ndarray | None]:
    """Rows as double arrays; None for null rows and rows with null or non-finite components."""
    offsets, flat = column.offsets.to_numpy(), column.values
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    whole = flat.is_valid().to_numpy(zero_copy_only=False)
    numbers = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    whole = whole & np.isfinite(numbers)
    return [
        numbers[b:e] if ok and whole[b:e].all() else None
        for b, e, ok in zip(offsets[:-1], offsets[1:], valid, strict=True)
    ]


def _classes(rows: DataFrame) -> DataFrame:
    def run(batch):
        vectors = vectors_of(batch.column(2))
        packed = [v.astype("<f8").tobytes() if v is not None and v.any() else None for v in vectors]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["vec_id", "label", "vector"])

    kind = rows.schema["label"].dataType.simpleString()
    return arrow_map(rows, run, f"vec_id long, label {kind}, vector binary")


def _codes(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    planes = np.random.default_rng([bits, tables, vectors.shape[1]]).standard_normal((vectors.shape[1], tables * bits))
    signs = (vectors @ planes >= 0).reshape(len(vectors), tables, bits)
    return (signs * (np.uint64(1) << np.arange(bits, dtype=np.uint64))).sum(axis=2).astype("<u8")


def _coded(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """``rep, place`` (hash of label, dimension, table and code) and all codes of the class."""

    def run(batch):
        rep, group = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        raw = batch.column(2).to_pylist()
        sizes = np.array([len(x) for x in raw])
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            vectors = np.frombuffer(b"".join(raw[i] for i in at), "<f8").reshape(len(at), -1)
            codes = _codes(vectors, bits, tables)
            place = codes.astype(np.uint64) * rolling.BASE + np.arange(tables, dtype=np.uint64)
            place = rolling.mix(place) + group[at].view(np.uint64)[:, None] + np.uint64(size)
            yield pa.record_batch(
                [np.repeat(rep[at], tables), rolling.mix(place).view(np.int64).ravel(), np.tile(np.arange(tables, dtype=np.int32), len(at)),
                 pa.array(np.repeat(np.array([c.tobytes() for c in codes], dtype=object), tables), pa.binary())],
                names=["rep", "place", "turn", "codes"],
            )

    return arrow_map(classes.select("rep", F.xxhash64("label"), "vector"), run, "rep long, place long, turn int, codes binary")


def _compare(members: DataFrame, cosine: float) -> DataFrame:
    """Rows ``a, b, n``: ``n`` vectors are linked with class ``a`` (b null), or a spanning link (n null)."""

    def run(rows, bounds):
        rep, weight, side, turn = (rows[c].to_numpy() for c in ("rep", "weight", "side", "turn"))
        raw, coded = rows["vector"].to_pylist(), rows["codes"].to_pylist()
        out: list[tuple[int, int | None, int | None]] = []
        for begin, end in bounds:
            n = end - begin
            if len({len(x) for x in raw[begin:end]}) > 1:
                raise ValueError("vectors of different lengths share a bucket")
            v = np.frombuffer(b"".join(raw[begin:end]), "<f8").reshape(n, -1)
            # scaled first, so that tiny and huge components neither vanish nor overflow
            v = v / np.abs(v).max(axis=1, keepdims=True)
            v = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
            codes = np.frombuffer(b"".join(coded[begin:end]), "<u8").reshape(n, -1)
            hit = v @ v.T >= cosine
            if side[begin:end].any():
                hit &= side[begin:end, None] != side[None, begin:end]
            np.fill_diagonal(hit, False)
            for earlier in range(turn[begin]):
                hit &= codes[:, earlier][:, None] != codes[:, earlier][None, :]
            sums = hit @ weight[begin:end]
            out += [(int(rep[begin + k]), None, int(sums[k])) for k in np.flatnonzero(sums)]
            forest = Forest(n)
            for k in np.flatnonzero(hit.any(axis=1)):
                forest.join(int(k), np.flatnonzero(hit[k]))
            out += [(int(rep[begin + a]), int(rep[begin + b]), None) for a, b in forest.links]
        if out:
            a, b, n = zip(*out, strict=True)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "n"])

    return grouped(members, ["place", "i", "j"], run, "a long, b long, n long")


def link_vectors(rows: DataFrame, cosine: float = 0.98) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``rows`` (``vec_id``, ``embedding``, ``label``).

    Rows with equal labels are linked when their cosine reaches ``cosine``. A null label, a null or zero vector, null
    or non-finite components and another length link with nothing; a null vec_id too (its component is null).
    ``n_links`` counts the other rows linked directly; rows that repeat count one by one, and rows that share a vec_id
    but not label and vector have links of their own.
    """
    scratch = Scratch(rows.sparkSession, "vectors")
    own = scratch.write(_classes(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")), "rows")
    usable = own.where("vec_id is not null and label is not null and vector is not null")
    # classes have numbers of their own, as several may share their least vec_id
    alike = usable.groupBy("label", "vector").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight"))
    classes = scratch.write(alike.withColumn("rep", F.monotonically_increasing_id()), "classes")
    bits, tables = table_shape(classes.count(), cosine)
    coded = _coded(classes, bits, tables)
    shared = coded.groupBy("place").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK)
    met = (
        coded.join(shared, "place").withColumn("blocks", blocks)
        .withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
        .withColumn("other", F.explode(F.expr("sequence(0, int(blocks) - 1)")))
        .select("place", F.least("own", "other").cast("int").alias("i"), F.greatest("own", "other").cast("int").alias("j"),
                F.expr("int(own > other)").alias("side"), "turn", "codes", "rep")
        .join(classes.select("rep", "weight", "vector"), "rep")
    )
    found = scratch.write(_compare(met, cosine), "found")
    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    linked = components(found.where("b is not null").select("a", "b"), scratch, "links")
    placed = classes.select("rep", "least").join(linked.withColumnRenamed("node", "rep"), "rep")
    heads = placed.groupBy("component").agg(F.min("least").alias("head"))
    headed = placed.join(heads, "component").select("rep", "head")
    known = (
        classes.join(counts, "rep", "left").join(headed, "rep", "left")
        .select("label", "vector", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("head", "least").alias("component"))
    )
    free = own.join(known, ["label", "vector"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return free.select(
        "vec_id", F.when(F.col("vec_id").isNotNull(), F.coalesce("n", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), (component == F.col("vec_id")).alias("kept"),
    )
