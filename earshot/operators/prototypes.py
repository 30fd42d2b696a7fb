"""Class prototypes and few-shot open-set scoring of embedding rows.

A fitted model is a small table of (class, vector) rows, one set per episode,
like the centres of a clustering model: it is fetched in parts of bounded size
and sent to the tasks. Queries are scored batch by batch with one matrix
product, so no row pairs are produced; parts are combined exactly.
Array lambdas evaluate the same arithmetic about a hundred times slower.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.functions import vectors as V
from earshot.operators.scans import top_rows
from earshot.session import MODEL_PART_BYTES

# The most bytes of scores that a task computes at once.
SCORE_BYTES = 32 * 1024 * 1024


def class_means(rows: DataFrame, keys: list[str], vec: str, dim: int, out: str = "proto") -> DataFrame:
    """Mean vector per key with the row count; partial sums are formed map-side.

    A vector of another length than ``dim`` stops the job; a null vector counts as a row and adds nothing.
    """
    other = F.raise_error(F.concat(F.lit(f"a vector of length {dim} was expected, not of "), F.size(vec).cast("string")))
    whole = F.when(F.size(vec) == dim, F.col(vec)).when(F.col(vec).isNotNull(), other)
    rows = rows.withColumn(vec, whole)
    means = F.array(*[F.avg(F.col(vec)[i]) for i in range(dim)])
    return rows.groupBy(*keys).agg(means.alias(out), F.count(F.lit(1)).alias("n_support"))


def normalized_class_means(rows: DataFrame, keys: list[str], vec: str, dim: int, each: bool = False) -> DataFrame:
    """L2-normalised class means; ``each`` normalises every row first as well."""
    if each:
        rows = rows.withColumn(vec, V.l2_normalize(F.col(vec)))
    return class_means(rows, keys, vec, dim).withColumn("proto", V.l2_normalize(F.col("proto")))


def fetch_model(protos: DataFrame, keys: list[str], cls: str, dim: int, n_vectors: int):
    """Prototype rows on the driver: key values, classes (an Arrow array) and an (n, dim) matrix.

    ``n_vectors`` is the declared bound of the table; a larger one stops the job, it is never cut.
    """
    table = protos.select(*keys, cls, "proto").limit(n_vectors + 1).toArrow().sort_by([(c, "ascending") for c in [*keys, cls]])
    if table.num_rows > n_vectors:
        raise ValueError(f"more than the declared {n_vectors} prototypes")
    matrix = np.array(table["proto"].to_pylist(), dtype=float).reshape(table.num_rows, dim)
    columns = [table[k].to_numpy() for k in keys]
    return columns, table[cls].combine_chunks(), matrix


def row_chunks(rows: int, width: int):
    """Bounds of stretches of rows whose score matrix of ``width`` columns stays small."""
    step = max(1, SCORE_BYTES // (8 * max(width, 1)))
    return [(lo, min(lo + step, rows)) for lo in range(0, rows, step)]


def score_matrix(method: str, z: np.ndarray, p: np.ndarray, beta: float = 0.0) -> np.ndarray:
    """(rows, prototypes) similarity; larger is closer."""
    qp = z @ p.T
    if method == "dot":
        return qp
    qq, pp = (z * z).sum(axis=1)[:, None], (p * p).sum(axis=1)[None, :]
    if method == "euclidean":
        return -np.maximum(qq - 2.0 * qp + pp, 0.0)
    if method == "cosine":
        return qp / np.maximum(np.sqrt(qq) * np.sqrt(pp), 1e-8)
    if method == "reprojection":
        a, rho = qp / (pp + 1.0 / z.shape[1]), math.exp(beta)
        return -(rho * rho * a * a * pp - 2.0 * rho * a * qp + qq)
    raise ValueError(f"unknown scoring method {method!r}")


def vectors_of(batch: pa.RecordBatch, vec: str, dim: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(vec))
    if column.null_count or not (column.value_lengths().to_numpy() == dim).all():
        raise ValueError(f"every vector needs {dim} components")
    return column.flatten().to_numpy().reshape(-1, dim)


def kept_columns(batch: pa.RecordBatch, keep: list[str]) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(c)) for c in keep]


def schema_of(df: DataFrame, keep: list[str], extra: str) -> str:
    types = dict(df.dtypes)
    return ", ".join([f"{c} {types[c]}" for c in keep] + [extra])


def with_scores(
    queries: DataFrame, protos: DataFrame, cls: str, vec: str, dim: int, n_way: int, keep: list[str], method: str, **options
) -> DataFrame:
    """``keep`` columns plus ``scores``: array of (cls, s), ordered by class."""
    _, classes, matrix = fetch_model(protos, [], cls, dim, n_way)
    kind = dict(protos.dtypes)[cls]

    def run(batches):
        for batch in batches:
            for lo, hi in row_chunks(batch.num_rows, len(classes)):
                part = batch.slice(lo, hi - lo)
                scores = score_matrix(method, vectors_of(part, vec, dim), matrix, **options)
                names = classes.take(pa.array(np.tile(np.arange(len(classes)), len(part))))
                flat = pa.StructArray.from_arrays([names, pa.array(scores.ravel())], ["cls", "s"])
                offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * len(classes))
                yield pa.RecordBatch.from_arrays([*kept_columns(part, keep), pa.ListArray.from_arrays(offsets, flat)], [*keep, "scores"])

    return queries.select(*keep, vec).mapInArrow(run, schema_of(queries, keep, f"scores array<struct<cls:{kind},s:double>>"))


def decide(scores: np.ndarray, classes: np.ndarray, reject: list[int]) -> list[np.ndarray]:
    """pred, conf, close_max, ood for (..., n) scores and classes; ties go to the lowest class."""
    weights = np.exp(scores - scores.max(axis=-1, keepdims=True))
    probs = weights / weights.sum(axis=-1, keepdims=True)
    rejected = np.isin(classes, reject)
    best = probs.argmax(axis=-1)
    pred = np.take_along_axis(np.broadcast_to(classes, probs.shape), best[..., None], axis=-1)[..., 0]
    close = np.where(rejected, -np.inf, probs).max(axis=-1)
    return [pred.astype(np.int32), probs.max(axis=-1), close, np.where(rejected, probs, 0.0).sum(axis=-1)]


PREDICTION = "pred int, conf double, close_max double, ood double"
PREDICTION_NAMES = ["pred", "conf", "close_max", "ood"]


def predict(
    queries: DataFrame, protos: DataFrame, cls: str, vec: str, dim: int, n_way: int, keep: list[str],
    reject: list[int], method: str = "euclidean", part_bytes: int = MODEL_PART_BYTES, **options,
) -> DataFrame:
    """pred, conf, close_max (best accepted class) and ood (rejected mass) per query.

    ``n_way`` is the declared number of classes. The model is cut into parts of about ``part_bytes``; a part gives a
    row's best class, its exponential masses and its best accepted score, from which the softmax over all parts is exact.
    """
    n_parts = max(1, math.ceil(n_way * dim * 8 / part_bytes))
    kind = dict(protos.dtypes)[cls]
    rows = queries.select(*keep, vec).withColumn("_row", F.monotonically_increasing_id())
    parts = [
        _part_scores(rows, protos.filter(F.pmod(F.xxhash64(cls), F.lit(n_parts)) == i), cls, vec, dim, n_way, keep, reject, method, kind, options)
        for i in range(n_parts)
    ]
    whole = reduce(DataFrame.unionByName, parts).withColumn("_p", F.struct("top", "best", "mass", "close", "refused"))
    if n_parts == 1:
        gathered = whole.select(*keep, F.array("_p").alias("p"))
    else:
        # one entry per part
        gathered = whole.groupBy("_row").agg(*(F.first(c).alias(c) for c in keep), F.collect_list("_p").alias("p"))
    top = F.array_max(F.transform("p", lambda x: x["top"]))
    best = F.array_min(F.transform(F.filter("p", lambda x: x["top"] == F.col("_t")), lambda x: x["best"]))

    def share(field):
        return F.aggregate("p", F.lit(0.0), lambda s, x: s + x[field] * F.exp(x["top"] - F.col("_t")))

    close = F.array_max(F.transform("p", lambda x: x["close"]))
    return gathered.withColumn("_t", top).withColumn("_mass", share("mass")).select(
        *keep, best.alias("pred"), (1.0 / F.col("_mass")).alias("conf"), (F.exp(close - F.col("_t")) / F.col("_mass")).alias("close_max"),
        (share("refused") / F.col("_mass")).alias("ood"),
    )


def _part_scores(rows, protos, cls, vec, dim, n_way, keep, reject, method, kind, options) -> DataFrame:
    """A row's best score and class, masses relative to it and best accepted score, for one part of the model."""
    _, classes, matrix = fetch_model(protos, [], cls, dim, n_way)
    rejected = np.isin(np.array(classes.to_pylist(), dtype=object), reject)
    names = ["top", "best", "mass", "close", "refused"]

    def run(batches):
        for batch in batches:
            for lo, hi in row_chunks(batch.num_rows, len(classes)):
                if not len(classes):
                    continue
                part = batch.slice(lo, hi - lo)
                scores = score_matrix(method, vectors_of(part, vec, dim), matrix, **options)
                top = scores.max(axis=1)
                weights = np.exp(scores - top[:, None])
                out = [
                    pa.array(top), classes.take(pa.array(scores.argmax(axis=1))), pa.array(weights.sum(axis=1)),
                    pa.array(np.where(rejected, -np.inf, scores).max(axis=1)), pa.array(np.where(rejected, weights, 0.0).sum(axis=1)),
                ]
                yield pa.RecordBatch.from_arrays([*kept_columns(part, [*keep, "_row"]), *out], [*keep, "_row", *names])

    return rows.mapInArrow(run, schema_of(rows, [*keep, "_row"], f"top double, best {kind}, mass double, close double, refused double"))


def predict_episodes(
    queries: DataFrame, protos: DataFrame, cls: str, vec: str, dim: int, n_way: int, n_episodes: int, keep: list[str],
    asked: str, reject: list[int], method: str = "euclidean", **options,
) -> DataFrame:
    """Predictions of every query under each episode listed in its ``asked`` array.

    A query travels once; its scores under all episodes are one matrix product.
    """
    (episodes,), classes, matrix = fetch_model(protos, ["episode"], cls, dim, n_way * n_episodes)
    classes = classes.to_numpy(zero_copy_only=False)
    numbers, first = np.unique(episodes, return_index=True)
    width = np.diff(np.append(first, len(episodes)))
    # Episodes may hold fewer classes than n_way; missing slots never win.
    slots = first[:, None] + np.minimum(np.arange(n_way)[None, :], width[:, None] - 1)
    absent = np.arange(n_way)[None, :] >= width[:, None]
    slot_classes = np.where(absent, np.iinfo(np.int32).max, classes[slots])

    def run(batches):
        for batch in batches:
            z = vectors_of(batch, vec, dim)
            lists = batch.column(batch.schema.get_field_index(asked))
            rows = np.repeat(np.arange(len(z)), lists.value_lengths().to_numpy())
            wanted = lists.flatten().to_numpy()
            at = np.searchsorted(numbers, wanted)
            for lo, hi in row_chunks(len(rows), max(n_way, len(matrix))):
                r, e = rows[lo:hi], at[lo:hi]
                span = slice(r[0], r[-1] + 1)
                scores = score_matrix(method, z[span], matrix, **options)[(r - r[0])[:, None], slots[e]]
                scores = np.where(absent[e], -np.inf, scores)
                out = [pa.array(x) for x in decide(scores, slot_classes[e], reject)]
                kept = [c.take(pa.array(r)) for c in kept_columns(batch, keep)]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(wanted[lo:hi].astype(np.int32)), *out], [*keep, "episode", *PREDICTION_NAMES]
                )

    return queries.select(*keep, vec, asked).mapInArrow(run, schema_of(queries, keep, "episode int, " + PREDICTION))


def probabilities(scores: Column) -> Column:
    """Array of (cls, p): softmax over an array of (cls, s)."""
    def weigh(pairs):
        return V.let(
            F.array_max(F.transform(pairs, lambda x: x["s"])),
            lambda top: F.transform(
                pairs, lambda x: F.struct(x["cls"].alias("cls"), F.exp(x["s"] - top).alias("w"))
            ),
        )

    def share(weights):
        return V.let(
            F.aggregate(weights, F.lit(0.0), lambda acc, x: acc + x["w"]),
            lambda mass: F.transform(
                weights, lambda x: F.struct(x["cls"].alias("cls"), (x["w"] / mass).alias("p"))
            ),
        )

    return V.let(V.let(scores, weigh), share)


def tail_distances(
    rows: DataFrame, protos: DataFrame, cls: str, vec: str, row_id: str, tail: int = 5, kind: str = "euclidean"
) -> DataFrame:
    """The ``tail`` largest distances of each class's rows to its mean: squared euclidean, one less the cosine, or both."""
    square, angle = V.squared_distance(F.col(vec), F.col("proto")), 1.0 - V.cosine(F.col(vec), F.col("proto"))
    distance = {"euclidean": square, "cosine": angle, "combined": square + angle}[kind]
    far = rows.join(protos.select(cls, "proto"), cls).select(cls, row_id, distance.alias("distance"))
    return top_rows(far, [cls], [F.desc("distance"), row_id], tail, [row_id], rank="tail_no")


def weibull_fit(values: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Maximum-likelihood (shape, scale) of positive values by Newton steps on the shape."""
    x = np.asarray(values, dtype=float)
    logs = np.log(x)
    shape = 1.2 / max(logs.std(), 1e-3)
    for _ in range(rounds):
        powers = np.exp(shape * (logs - logs.max()))
        weighted = powers / powers.sum()
        first = (weighted * logs).sum()
        slope = (weighted * logs**2).sum() - first**2 + 1.0 / shape**2
        step = (first - 1.0 / shape - logs.mean()) / slope
        shape = max(shape - step, shape / 2)
        if abs(step) < 1e-12 * shape:
            break
    scale = np.exp(logs.max()) * np.mean(np.exp(shape * (logs - logs.max()))) ** (1.0 / shape)
    return float(shape), float(scale)


def openmax_fit(tails: DataFrame, cls: str) -> DataFrame:
    """Weibull tail model per class from its few largest distances.

    Distances are moved so that the smallest tail value becomes 1; ``shift``
    is that smallest value. Each group holds at most the tail size.
    """
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        low = pdf["distance"].min()
        shape, scale = weibull_fit(pdf["distance"].to_numpy() + 1.0 - low)
        return pd.DataFrame({cls: [pdf[cls].iloc[0]], "shape": [shape], "scale": [scale], "shift": [low]})

    key = dict(tails.dtypes)[cls]
    return tails.select(cls, "distance").groupBy(cls).applyInPandas(
        fit, f"{cls} {key}, shape double, scale double, shift double"
    )


def openmax_probabilities(scores: Column, unknown_cls: int) -> Column:
    """OpenMax over an array of (cls, d, shape, scale, shift) of one query.

    w = Weibull CDF of d; a known class scores d*w, the unknown class gets the
    sum of d - d*w; the softmax runs over the negated scores.
    """
    def cdf(x):
        moved = x["d"] + 1.0 - x["shift"]
        return F.when(moved > 0, 1.0 - F.exp(-F.pow(moved / x["scale"], x["shape"]))).otherwise(F.lit(0.0))

    def recombine(entries):
        known = F.transform(entries, lambda x: F.struct(x["cls"].alias("cls"), (-x["d"] * cdf(x)).alias("s")))
        unknown = F.aggregate(entries, F.lit(0.0), lambda acc, x: acc + (x["d"] - x["d"] * cdf(x)))
        return F.concat(known, F.array(F.struct(F.lit(unknown_cls).alias("cls"), (-unknown).alias("s"))))

    return probabilities(V.let(scores, recombine))


def dummy_prototype_scores(scores: Column, known, unknown_cls: int, t_known=1.0, t_unknown=3.0) -> Column:
    """Known classes score -d/t_known; the best unknown prototype scores -d/t_unknown.

    ``scores`` holds (cls, -d); ``known`` maps an entry to whether its class is known.
    """
    near = F.transform(F.filter(scores, known), lambda x: F.struct(x["cls"].alias("cls"), (x["s"] / t_known).alias("s")))
    far = F.array_max(F.transform(F.filter(scores, lambda x: ~known(x)), lambda x: x["s"] / t_unknown))
    return F.concat(near, F.array(F.struct(F.lit(unknown_cls).alias("cls"), far.alias("s"))))
