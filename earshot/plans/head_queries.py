"""Linear head trained on the embedding table, and recalibration of a model's threshold."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from earshot.operators import head as H
from earshot.operators import records as R
from earshot.plans import views as V
from earshot.plans.registry import query
from earshot.plans.scoring_queries import _ROC_SQL, DIM, N_CLASSES, predictions
from earshot.session import ensure_checkpoint_dir, materialize
from earshot.sources.sinks import load_model, save_model

#: Rows held out of the training, and the penalty.
HELD_OUT, REG = "vec_id % 5 = 0", 1e-3


def trained_head(spark, sf):
    """(model, weighted training rows): even shares of every class, without the held-out rows."""
    rows = V.embeddings(spark, sf).withColumn("name", F.concat(F.lit("c"), "label")).withColumn("source", F.lit(""))
    train = rows.filter(f"NOT ({HELD_OUT})").withColumn("hardneg_category", F.lit(None).cast("string"))
    weighted = materialize(R.sample_weights(train, {}, label="name").select("vec_id", "z", "label", "weight"))
    return H.train_head(weighted, "z", "label", "weight", max_iter=300, reg=REG, tol=1e-10), weighted


@query("linear_head", f"""
SELECT label, count(*) FILTER (WHERE NOT ({HELD_OUT})) AS n_train, count(*) FILTER (WHERE {HELD_OUT}) AS n_held_out,
 0.0::DOUBLE AS residual, 0.0::DOUBLE AS slope, 0::BIGINT AS bad_sums FROM embeddings GROUP BY label
""")
def linear_head(spark, sf):
    """At the optimum the gradient of the penalised likelihood vanishes, by intercept and by feature; held-out rows are scored too."""
    model, train = trained_head(spark, sf)
    head = materialize(H.head_rows(model))
    weights = head.select("class", F.posexplode("proto").alias("feature", "b"))
    slopes = H.gradient(head, train, "z", "label", "weight", DIM, N_CLASSES).join(weights, ["class", "feature"])
    penalty = F.when(F.col("feature") < DIM, REG * F.col("b")).otherwise(0.0)
    steepest = slopes.groupBy(F.col("class").alias("label")).agg(
        (F.round(F.max(F.when(F.col("feature") == DIM, F.abs("slope"))), 4) + F.lit(0.0)).alias("residual"),
        (F.round(F.max(F.abs(F.col("slope") + penalty)), 4) + F.lit(0.0)).alias("slope"),
    )
    rows = V.embeddings(spark, sf).withColumn("held", F.expr(f"int({HELD_OUT})"))
    scored = H.class_probabilities(model, rows, "z", ["label", "held"])
    total = F.aggregate("p", F.lit(0.0), lambda s, x: s + x)
    counts = scored.groupBy("label").agg(
        F.sum((F.col("held") == 0).cast("int")).alias("n_train"), F.sum("held").alias("n_held_out"),
        F.sum((F.abs(total - 1) > 1e-9).cast("int")).alias("bad_sums"),
    )
    return counts.join(steepest, "label").select("label", "n_train", "n_held_out", "residual", "slope", "bad_sums")


@query("head_eval", f"""
SELECT count(*) FILTER (WHERE label < {V.N_KNOWN}) AS n_pos, count(*) FILTER (WHERE label >= {V.N_KNOWN}) AS n_neg, 2::BIGINT AS versions,
 true AS unset_before, true AS within_target, true AS next_exceeds, true AS same_accuracy, true AS same_area, 0::BIGINT AS bad_rows
FROM embeddings WHERE {HELD_OUT}
""")
def head_eval(spark, sf):
    """A trained head is stored, scores the held-out rows and the reject pool, and gets its threshold written back.

    The figures that a later load gives are held against plain counts over the same predictions.
    """
    folder = f"{ensure_checkpoint_dir(spark)}/head-{uuid.uuid4().hex}"
    model, _ = trained_head(spark, sf)
    start = spark.range(1).select(F.lit("linear").alias("model"), F.lit(None).cast("double").alias("thr_far05"))
    save_model(H.head_rows(model), start, folder)
    before = load_model(spark, folder)[1].first()["thr_far05"]
    rows = V.embeddings(spark, sf).filter(HELD_OUT)
    preds = H.evaluate_stored(spark, folder, rows, "z", DIM, N_CLASSES, "vec_id", "label", V.REJECT)
    _, meta = load_model(spark, folder)
    known = meta.first()
    thr, accuracy, area = known["thr_far05"], known["acc_far05"], known["aucROC"]
    n_neg = preds.filter("NOT pos").count()
    above = lambda strict: F.sum((~F.col("pos") & ((F.col("close_max") > thr) if strict else (F.col("close_max") >= thr))).cast("int"))
    counts = preds.groupBy("close_max").agg(F.sum(F.col("pos").cast("int")).alias("p"), F.sum((~F.col("pos")).cast("int")).alias("n"))
    below = counts.filter(F.col("close_max") < thr).agg(F.max_by(F.col("n"), "close_max")).first()[0]
    # pairs of a positive and a negative that are in order, ties by half
    ranked = preds.select("pos", F.percent_rank().over(Window.orderBy("close_max")).alias("r"), F.count(F.lit(1)).over(Window.partitionBy("close_max")).alias("ties"))
    rank = F.col("r") * F.lit(preds.count() - 1) + 1 + (F.col("ties") - 1) / 2.0
    totals = ranked.agg(F.sum(F.when(F.col("pos"), rank)).alias("s"), F.sum(F.col("pos").cast("int")).alias("p")).first()
    plain = (totals["s"] - totals["p"] * (totals["p"] + 1) / 2.0) / (totals["p"] * n_neg) if n_neg and totals["p"] else None
    masked = F.when(F.col("conf") < thr, -1).otherwise(F.col("pred_cls"))
    versions = spark.read.parquet(f"{folder}/pointer").count()
    probability = (F.col("conf") <= 1 + 1e-9) & (F.col("close_max") <= F.col("conf") + 1e-9) & (F.col("close_max") + F.col("ood") <= 1 + 1e-9)
    return preds.agg(
        F.sum(F.col("pos").cast("int")).alias("n_pos"), F.sum((~F.col("pos")).cast("int")).alias("n_neg"),
        F.lit(versions).cast("bigint").alias("versions"), F.lit(before is None).alias("unset_before"),
        (above(False) <= 0.05 * n_neg).alias("within_target"),
        (F.lit(below is None) | (above(False) + F.lit(below or 0) > 0.05 * n_neg) | F.lit((below or 0) == 0)).alias("next_exceeds"),
        (F.abs(F.avg(F.when(F.col("pos"), (masked == F.col("true_cls")).cast("double"))) - accuracy) < 1e-9).alias("same_accuracy"),
        F.lit(plain is not None and abs(plain - area) < 1e-9).alias("same_area"),
        F.sum((~probability).cast("int")).alias("bad_rows"),
    )


@query("recalibrate_scores", f"""WITH {_ROC_SQL}, t AS (SELECT min(thr) AS thr FROM roc WHERE fpr <= 0.05),
m AS (SELECT true_cls, CASE WHEN conf < thr THEN -1 ELSE pred_cls END AS pc, thr FROM pred, t WHERE pos),
c2 AS (SELECT close_max, count(*) FILTER (WHERE pos) AS p, count(*) FILTER (WHERE NOT pos) AS n FROM pred GROUP BY close_max),
k2 AS (SELECT *, sum(n) OVER (ORDER BY close_max) - n AS below FROM c2)
SELECT label AS model, round((SELECT max(thr) FROM m), 6) AS thr_far05,
 round((SELECT avg(CASE WHEN pc = true_cls THEN 1.0::DOUBLE ELSE 0 END) FROM m), 6) AS acc_far05,
 round((SELECT (sum(p * (below + n / 2.0)) / (sum(p) * sum(n)))::DOUBLE FROM k2), 6) AS "aucROC"
FROM (SELECT DISTINCT label FROM embeddings)
""")
def recalibrate_scores(spark, sf):
    """Stored scores recalibrate the metadata of the models that were saved for them, one per class here."""
    preds = materialize(predictions(spark, sf))
    meta = V.embeddings(spark, sf).select(F.col("label").alias("model")).distinct().withColumn("thr_far05", F.lit(0.5))
    out = H.recalibrate(meta, preds)
    return out.withColumns({c: F.round(c, 6) for c in ("thr_far05", "acc_far05", "aucROC")})
