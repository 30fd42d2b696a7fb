"""Linear softmax head on frozen embeddings, trained and scored with Spark ML."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.operators import evaluation as E
from earshot.operators import prototypes as P
from earshot.session import materialize, spread
from earshot.sources.sinks import load_model, save_model


def train_head(rows: DataFrame, vec: str, label_idx: str, weight: str, max_iter: int = 50, reg: float = 1e-3, tol: float = 1e-6) -> LogisticRegressionModel:
    """Multinomial logistic regression with per-row weights and the penalty reg / 2 * |coefficients|^2.

    A step is a job over all rows, so these are first brought into as many tasks as adaptive execution finds worth it.
    """
    features = spread(rows, vec).select(array_to_vector(vec).alias("features"), F.col(label_idx).cast("double").alias("y"), F.col(weight).alias("w"))
    return LogisticRegression(
        featuresCol="features", labelCol="y", weightCol="w", family="multinomial", maxIter=max_iter, regParam=reg, tol=tol, standardization=False,
    ).fit(features)


def gradient(head: DataFrame, rows: DataFrame, vec: str, label_idx: str, weight: str, dim: int, n_classes: int) -> DataFrame:
    """``class, feature, slope``: the weighted mean of (p - y) * x per class and feature; feature ``dim`` is the intercept.

    Partial sums of every batch are added up, so the table has a row per weight of the head and batch.
    """
    _, classes, matrix = P.fetch_model(head, [], "class", dim + 1, n_classes)
    order = classes.to_numpy(zero_copy_only=False)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack((P.vectors_of(batch, vec, dim), np.ones(batch.num_rows)))
            y, w = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            score = x @ matrix.T
            p = np.exp(score - score.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            sums = ((p - (y[:, None] == order[None, :])) * w[:, None]).T @ x
            n = dim + 1
            yield pa.record_batch(
                [np.repeat(order.astype(np.int32), n), np.tile(np.arange(n, dtype=np.int32), len(order)), sums.ravel(), np.full(sums.size, w.sum())],
                names=["class", "feature", "s", "w"],
            )

    parts = rows.select(vec, F.col(label_idx).cast("int"), F.col(weight).cast("double")).mapInArrow(run, "class int, feature int, s double, w double")
    return parts.groupBy("class", "feature").agg((F.sum("s") / F.sum("w")).alias("slope"))


def head_rows(model: LogisticRegressionModel) -> DataFrame:
    """The head as a table: ``class`` and ``proto``, its weights with the intercept as the last one."""
    spark = SparkSession.active()
    weights, offsets = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    rows = [(k, [*w.tolist(), float(b)]) for k, (w, b) in enumerate(zip(weights, offsets))]
    return spark.createDataFrame(rows, "class int, proto array<double>")


def class_probabilities(model: LogisticRegressionModel, rows: DataFrame, vec: str, keep: list[str]) -> DataFrame:
    """``keep`` columns plus ``p``: the probability of every class."""
    scored = model.transform(rows.withColumn("features", array_to_vector(vec)))
    return scored.select(*keep, vector_to_array("probability").alias("p"))


def head_predictions(
    head: DataFrame, rows: DataFrame, vec: str, dim: int, n_classes: int, keep: list[str], true_idx: str, reject: list[int]
) -> DataFrame:
    """Open-set predictions of a stored head: rejected classes collapse to -1, keyword scores stay apart."""
    extended = rows.withColumn("_x", F.concat(F.col(vec), F.array(F.lit(1.0))))
    out = P.predict(extended, head, "class", "_x", dim + 1, n_classes, list(dict.fromkeys([*keep, true_idx])), reject, method="dot")
    collapse = lambda c: F.when(F.col(c).isin(*reject), F.lit(-1)).otherwise(F.col(c).cast("int"))
    return out.select(
        *keep, (~F.col(true_idx).isin(*reject)).alias("pos"), collapse(true_idx).alias("true_cls"),
        collapse("pred").alias("pred_cls"), "conf", "close_max", "ood",
    )


def evaluate_stored(
    spark: SparkSession, folder: str, rows: DataFrame, vec: str, dim: int, n_classes: int, row_id: str, true_idx: str,
    reject: list[int], target_far: float = 0.05,
) -> DataFrame:
    """Scores held-out rows and the reject pool with the head stored in ``folder`` and writes its threshold back.

    The new figures become a new version of the model, which readers see once it is complete; returns the predictions.
    """
    head, meta = load_model(spark, folder)
    preds = materialize(head_predictions(head, rows, vec, dim, n_classes, [row_id], true_idx, reject))
    save_model(head, recalibrate(meta, preds, target_far), folder)
    return preds


def recalibrate(meta: DataFrame, preds: DataFrame, target_far: float = 0.05) -> DataFrame:
    """Model metadata with threshold, accuracy and AUC measured on ``preds``."""
    at = E.operating_point(preds, [], target_far)
    area = E.auroc(preds, [])
    return meta.drop("thr_far05", "acc_far05", "aucROC").withColumns({
        "thr_far05": at.select("thr_far05").scalar(), "acc_far05": at.select("acc_far05").scalar(),
        "aucROC": area.select("auc").scalar(),
    })
