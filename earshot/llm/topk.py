"""Exact top-k by inner product with a three-phase uniform threshold.

The dimensions are cut into slices; the list of a slice holds every candidate's partial score for a query.

1. Each slice gathers its local top-k list per query. The listed candidates' whole scores give a cutoff: the k-th best
   of them bounds the k-th best of all from below.
2. The cutoff goes back to the slices. A candidate at or above it has a partial score of at least cutoff / slices in
   some slice, so the entries that reach this uniform threshold are sufficient. A slice that is not reported lies below
   the threshold and above the slice's least score; entries whose upper bound stays below the k-th best lower bound
   are dropped.
3. The scores of the remaining entries are resolved exactly from both vectors, and ranked.

Queries and candidates meet in blocks, as each query is scored against all rows; a task holds one block of each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earshot.llm.embedding_dedup import vectors_of
from earshot.llm.store import Scratch, arrow_map, grouped, with_row_key

QUERY_BLOCK, CANDIDATE_BLOCK = 512, 4096


def _integers(rows: DataFrame, scale: int) -> DataFrame:
    def run(batch):
        vectors = [None if v is None else np.floor(scale * v) for v in vectors_of(batch.column(2))]
        for v in vectors:
            if v is not None and len(v) and float(np.abs(v).max()) ** 2 * len(v) >= 2.0**62:
                raise ValueError("a score would not fit in 64 bits")
        keep = [i for i, v in enumerate(vectors) if v is not None]
        lists = pa.array([vectors[i].astype(np.int64) for i in keep], pa.list_(pa.int64()))
        yield pa.record_batch([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64())), lists],
                              names=["row_key", "vec_id", "vector"])

    return arrow_map(rows, run, "row_key long, vec_id long, vector array<bigint>")


def _matrix(rows: pa.Table, at: np.ndarray) -> np.ndarray:
    lists = rows["vector"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    part = lists.take(pa.array(at))
    return part.values.to_numpy(zero_copy_only=False)[part.offsets[0].as_py() :].reshape(len(at), -1)


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products; by the faster double product where no sum can round."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(q.shape[1], 1)
    return (q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64) if bound < 2.0**53 else q @ c.T


def _partials(rows: pa.Table, begin: int, end: int, slices: int):
    """Row numbers of queries and candidates of a task, and the partial scores of every slice (own rows masked)."""
    kind = rows["kind"].to_numpy()[begin:end]
    q, c = np.flatnonzero(kind == 0) + begin, np.flatnonzero(kind == 1) + begin
    if not len(q) or not len(c):
        return None
    qv, cv = _matrix(rows, q), _matrix(rows, c)
    keys = rows["row_key"].to_numpy()
    cuts = np.linspace(0, qv.shape[1], slices + 1).astype(int)
    parts = np.stack([_products(qv[:, a:b], cv[:, a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
    return q, c, parts, keys[q][:, None] == keys[c][None, :]


def _lists(meeting: DataFrame, k: int, slices: int) -> DataFrame:
    """Phase 1: the best ``k`` of every slice with their whole scores, and the slice's least partial score."""

    def run(rows, bounds):
        keys = rows["row_key"].to_numpy()
        for begin, end in bounds:
            found = _partials(rows, begin, end, slices)
            if found is None:
                continue
            q, c, parts, own = found
            total = parts.sum(axis=0)
            for s in range(slices):
                score = np.where(own, np.iinfo(np.int64).min, parts[s])
                m = min(k, len(c))
                best = np.argpartition(-score.astype(np.float64), m - 1, axis=1)[:, :m]
                line = np.repeat(np.arange(len(q)), m)
                best = best.ravel()
                use = ~own[line, best]
                line, best = line[use], best[use]
                yield pa.record_batch(
                    [keys[q[line]], np.full(len(line), s, np.int32), keys[c[best]], parts[s][line, best], total[line, best],
                     parts[s].min(axis=1)[line]],
                    names=["query", "slice", "row", "partial", "total", "least"],
                )

    return grouped(meeting, ["dim", "qb", "cb"], run, "query long, slice int, row long, partial long, total long, least long", max_rows=4096)


def _entries(meeting: DataFrame, slices: int) -> DataFrame:
    """Phase 2: entries with some partial score at or above cutoff / slices: what was seen, and which slices were."""

    def run(rows, bounds):
        keys, cutoffs = rows["row_key"].to_numpy(), rows["cutoff"].to_numpy(zero_copy_only=False)
        for begin, end in bounds:
            found = _partials(rows, begin, end, slices)
            if found is None:
                continue
            q, c, parts, own = found
            # cutoff / slices rounded up: partial scores are whole numbers
            need = -(-cutoffs[q].astype(np.int64) // slices)
            seen = (parts >= need[None, :, None]) & ~own
            line, at = np.nonzero(seen.any(axis=0))
            which = seen[:, line, at]
            yield pa.record_batch(
                [keys[q[line]], keys[c[at]], np.where(which, parts[:, line, at], 0).sum(axis=0),
                 (which << np.arange(slices)[:, None]).sum(axis=0).astype(np.int32)],
                names=["query", "row", "seen", "slices"],
            )

    return grouped(meeting, ["dim", "qb", "cb"], run, "query long, row long, seen long, slices int", max_rows=4096)


def top_k(rows: DataFrame, is_query: str, k: int = 10, scale: int = 1024, slices: int = 2) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best candidates of every query row.

    ``rows`` has ``vec_id`` and ``embedding``; queries are the rows where ``is_query`` holds, candidates all rows but
    the query's own. Components become floor(scale * x). Ties go to the smaller vec_id. Vectors that are null or hold
    null or non-finite components take no part, nor do rows without vec_id; only vectors of one length are compared.
    Rows that repeat a vec_id are rows of their own.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "topk")
    keyed = with_row_key(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
    vectors = scratch.write(_integers(keyed.select("row_key", "vec_id", "embedding"), scale).where("vec_id is not null"), "vectors")
    queries = vectors.where(is_query)
    n_c, n_q = vectors.count(), queries.count()
    c_blocks, q_blocks = max(1, -(-n_c // CANDIDATE_BLOCK)), max(1, -(-n_q // QUERY_BLOCK))
    spot = lambda n: F.pmod(F.xxhash64("row_key"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    shape = ["dim", "qb", "cb", "kind", "row_key", "vector"]
    asked = queries.withColumns({"dim": F.size("vector"), "qb": spot(q_blocks), "kind": F.lit(0)})
    offered = (
        vectors.withColumns({"dim": F.size("vector"), "cb": spot(c_blocks), "kind": F.lit(1)}).withColumn("qb", every(q_blocks)).select(shape)
    )
    lists = scratch.write(_lists(asked.withColumn("cb", every(c_blocks)).select(shape).union(offered), k, slices), "lists")
    nth = Window.partitionBy("query", "slice").orderBy(F.desc("partial"), "row")
    listed = lists.withColumn("n", F.row_number().over(nth)).where(F.col("n") <= k)
    # a candidate listed by two slices counts once
    ranked = listed.select("query", "row", "total").distinct().withColumn(
        "n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("total")))
    )
    cutoff = ranked.where(F.col("n") == k).select("query", F.col("total").alias("cutoff"))
    least = lists.groupBy("query").pivot("slice", list(range(slices))).agg(F.min("least"))
    least = least.select("query", *(F.col(str(s)).alias(f"least_{s}") for s in range(slices)))
    bounds = scratch.write(asked.select(F.col("row_key").alias("query")).join(cutoff, "query", "left").join(least, "query", "left"), "bounds")
    # fewer than k listed: everything is sufficient
    floor = -(1 << 62)
    told = asked.join(bounds.select(F.col("query").alias("row_key"), F.coalesce("cutoff", F.lit(floor)).alias("cutoff")), "row_key")
    told = told.withColumn("cb", every(c_blocks)).select(*shape, "cutoff")
    entries = scratch.write(_entries(told.union(offered.withColumn("cutoff", F.lit(floor))), slices), "entries").join(bounds, "query")
    unseen = [F.col("slices").bitwiseAND(1 << s) == 0 for s in range(slices)]
    upper, lower = F.col("seen"), F.col("seen")
    for s in range(slices):
        upper = upper + F.when(unseen[s], F.ceil(F.col("cutoff") / slices)).otherwise(0)
        lower = lower + F.when(unseen[s], F.col(f"least_{s}")).otherwise(0)
    entries = entries.withColumns({"upper": F.when(F.col("cutoff").isNull(), F.lit(1 << 62)).otherwise(upper), "lower": lower})
    better = (
        entries.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("lower"))))
        .where(F.col("n") == k).select("query", F.col("lower").alias("cutoff_2"))
    )
    left = entries.join(better, "query", "left").where("cutoff_2 is null or upper >= cutoff_2").select("query", "row")
    known = vectors.select(F.col("row_key").alias("row"), "vec_id", F.col("vector").alias("v"))
    sought = queries.select(F.col("row_key").alias("query"), F.col("vec_id").alias("query_id"), F.col("vector").alias("u"))
    score = F.aggregate(F.zip_with("u", "v", lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)
    scored = left.join(known, "row").join(sought, "query").select("query", "query_id", "vec_id", "row", score.alias("score"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
