"""Pair and triplet mining inside training batches, and metric losses.

A batch holds ``n_way`` classes with up to ``k`` rows each, as an episodic
sampler would draw it. Every row of the table belongs to one batch, so the
work grows linearly with the table and each group has at most n_way * k rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.functions import vectors as V
from earshot.operators.scans import hash_rank


def assign_batches(rows: DataFrame, label: str, row_id: str, seed, n_way: int, k: int) -> DataFrame:
    """Adds ``batch``: block of classes and block of k shuffled rows per class."""
    ranked = hash_rank(rows, [label], [row_id], seed, "_rn")
    shot = F.floor((F.col("_rn") - 1) / F.lit(k)).cast("bigint")
    way = F.floor(F.col(label) / F.lit(n_way)).cast("bigint")
    return ranked.withColumn("batch", F.concat_ws(":", way, shot)).drop("_rn")


#: Fixed values of the draw order: a prime modulus and factors for up to three ids.
MODULUS, FACTORS, SPREAD = 2_147_483_647, (73_856_093, 19_349_663, 83_492_791), 48_271


def draw_order(seed: int, *ids: np.ndarray) -> np.ndarray:
    """A seeded pseudo-random number per combination of integer ids; the least is drawn first."""
    mixed = sum(((np.asarray(x, dtype=np.int64) % MODULUS) * f for x, f in zip(ids, FACTORS)), np.int64(seed % MODULUS))
    return mixed % MODULUS * SPREAD % MODULUS


def _distances(vectors: np.ndarray) -> np.ndarray:
    sq = (vectors * vectors).sum(axis=1)
    return sq[:, None] + sq[None, :] - 2.0 * vectors @ vectors.T


def _batch(pdf: pd.DataFrame, label: str, row_id: str, vec: str):
    pdf = pdf.sort_values(row_id)
    return pdf[row_id].to_numpy(), pdf[label].to_numpy(), _distances(np.stack(pdf[vec].to_numpy()).astype(float))


def pairs(batches: DataFrame, label: str, row_id: str, vec: str, negatives: str, seed) -> DataFrame:
    """Positive pairs of each batch and as many negative ones.

    ``negatives``: 'random' (seeded), 'hard' (closest) or 'all'.
    """
    def select(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, labels, dist = _batch(pdf, label, row_id, vec)
        i, j = np.triu_indices(len(ids), 1)
        same = labels[i] == labels[j]
        pos, neg = np.flatnonzero(same), np.flatnonzero(~same)
        if negatives == "random":
            neg = neg[np.lexsort((ids[j[neg]], ids[i[neg]], draw_order(seed, ids[i[neg]], ids[j[neg]])))][: len(pos)]
        elif negatives == "hard":
            neg = neg[np.lexsort((ids[j[neg]], ids[i[neg]], np.round(dist[i[neg], j[neg]], 9)))][: len(pos)]
        take = np.concatenate([pos, neg]).astype(int)
        return pd.DataFrame({
            "batch": pdf["batch"].iloc[0], "a": ids[i[take]], "b": ids[j[take]], "positive": same[take],
            "distance": dist[i[take], j[take]],
        })

    kind = dict(batches.dtypes)[row_id]
    return batches.groupBy("batch").applyInPandas(
        select, f"batch string, a {kind}, b {kind}, positive boolean, distance double"
    )


#: Losses that are compared at once.
GRID = 1 << 22


def _chosen(strategy: str, losses: np.ndarray, margin: float, order) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a (pairs, negatives) grid for which a negative qualifies, and the negative; draws follow ``order()``."""
    if strategy == "hardest":
        best = losses.argmax(axis=1)
        rows = np.flatnonzero(losses[np.arange(len(losses)), best] > 0)
        return rows, best[rows]
    fits = losses > 0
    if strategy == "semihard":
        fits &= losses < margin
    rows = np.flatnonzero(fits.any(axis=1))
    ranks = np.where(fits, order(), np.iinfo(np.int64).max)
    return rows, ranks[rows].argmin(axis=1)


def triplets(batches: DataFrame, label: str, row_id: str, vec: str, strategy: str, margin: float, seed) -> DataFrame:
    """(anchor, positive, negative) of each batch with the squared distances.

    ``strategy``: 'all', or one negative per positive pair: 'hardest',
    'random' (violating the margin) or 'semihard'. A batch in which no
    negative qualifies yields its last pair with the first negative. The pairs
    of a class meet all negatives in grids of bounded size.
    """
    def select(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, labels, dist = _batch(pdf, label, row_id, vec)
        found, fallback = [], None
        for value in np.unique(labels):
            own, other = np.flatnonzero(labels == value), np.flatnonzero(labels != value)
            if len(own) < 2 or not len(other):
                continue
            x, y = np.triu_indices(len(own), 1)
            a, p = own[x], own[y]
            fallback = np.array([[a[-1], p[-1], other[0]]])
            step = max(1, GRID // len(other))
            for lo in range(0, len(a), step):
                ai, pi = a[lo : lo + step], p[lo : lo + step]
                if strategy == "all":
                    found.append(np.column_stack((np.repeat(ai, len(other)), np.repeat(pi, len(other)), np.tile(other, len(ai)))))
                    continue
                losses = dist[ai, pi][:, None] - dist[ai[:, None], other[None, :]] + margin
                rows, picks = _chosen(strategy, losses, margin, lambda: draw_order(seed, ids[ai][:, None], ids[pi][:, None], ids[other][None, :]))
                found.append(np.column_stack((ai[rows], pi[rows], other[picks])))
        t = np.concatenate([*found, np.zeros((0, 3), dtype=int)])
        if not len(t) and fallback is not None:
            t = fallback
        return pd.DataFrame({
            "batch": pd.Series([pdf["batch"].iloc[0]] * len(t), dtype=object), "anchor": ids[t[:, 0]], "positive": ids[t[:, 1]], "negative": ids[t[:, 2]],
            "d_pos": dist[t[:, 0], t[:, 1]], "d_neg": dist[t[:, 0], t[:, 2]],
        })

    kind = dict(batches.dtypes)[row_id]
    return batches.groupBy("batch").applyInPandas(
        select, f"batch string, anchor {kind}, positive {kind}, negative {kind}, d_pos double, d_neg double"
    )


def triplet_hinge(mined: DataFrame, margin: float) -> DataFrame:
    """Mean hinge of the triplets over all batches."""
    loss = F.greatest(F.lit(0.0), F.col("d_pos") - F.col("d_neg") + F.lit(margin))
    return mined.agg(F.avg(loss).alias("loss"), F.count(F.lit(1)).alias("n_triplets"))


def _log_sum_exp(pairs_: Column) -> Column:
    top = F.array_max(F.transform(pairs_, lambda x: x["s"]))
    return V.let(top, lambda t: t + F.log(F.aggregate(pairs_, F.lit(0.0), lambda acc, x: acc + F.exp(x["s"] - t))))


def _at(pairs_: Column, cls: Column) -> Column:
    return F.get(F.filter(pairs_, lambda x: x["cls"] == cls), F.lit(0))["s"]


def nll(scored: DataFrame, label: str, margin: float = 0.0, scale: float = 1.0, shift: float = 0.0) -> DataFrame:
    """Mean negative log-likelihood of the true class and accuracy.

    The margin is taken off the true class's score before scaling: 0 gives the
    prototypical loss, cosine scores with a margin the angular one, and a
    margin with scale 64 the additive-margin softmax.
    """
    moved = F.transform("scores", lambda x: F.struct(
        x["cls"].alias("cls"),
        ((x["s"] - F.when(x["cls"] == F.col(label), F.lit(margin)).otherwise(F.lit(0.0))) * scale + shift).alias("s"),
    ))
    def parts(p):
        best = F.array_max(F.transform(p, lambda x: F.struct(x["s"].alias("s"), (-x["cls"]).alias("c"))))
        return F.struct((_log_sum_exp(p) - _at(p, F.col(label))).alias("nll"), (-best["c"] == F.col(label)).alias("ok"))

    out = scored.select(V.let(moved, parts).alias("r")).select("r.*")
    return out.agg(
        F.avg("nll").alias("loss"), F.avg(F.when(F.col("ok"), 1.0).otherwise(0.0)).alias("accuracy"), F.count(F.lit(1)).alias("n")
    )


def open_entropy(scored: DataFrame) -> DataFrame:
    """Mean of sum p*log p over samples of unknown classes (scores are -distance)."""
    def entropy(p):
        return V.let(_log_sum_exp(p), lambda z: F.aggregate(
            p, F.lit(0.0), lambda acc, x: acc + F.exp(x["s"] - z) * (x["s"] - z)
        ))

    return scored.select(V.let(F.col("scores"), entropy).alias("e")).agg(F.avg("e").alias("loss"), F.count(F.lit(1)).alias("n"))
