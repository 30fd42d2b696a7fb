"""Open-set evaluation: accuracy, confusion, ROC, operating point, summaries.

``preds`` has one row per evaluated sample: ``pos`` (keyword sample?),
``true_cls``, ``pred_cls`` (rejections collapsed to one id), ``conf`` (overall
confidence) and ``close_max`` (best keyword probability). ``keys`` group runs
or episodes; everything is computed for all of them in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.operators.scans import range_scan
from earshot.session import materialize


def accuracy_conf(preds: DataFrame, keys: list[str]) -> DataFrame:
    ok = F.col("pred_cls") == F.col("true_cls")
    n_ok, n_bad = F.sum(F.when(ok, 1).otherwise(0)), F.sum(F.when(ok, 0).otherwise(1))
    right, wrong = F.when(ok, F.col("conf")).otherwise(0.0), F.when(ok, 0.0).otherwise(F.col("conf"))
    return preds.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(ok, 1.0).otherwise(0.0)).alias("accuracy"),
        F.coalesce(F.sum(right) / F.when(n_ok > 0, n_ok), F.lit(0.0)).alias("mean_conf_ok"),
        F.coalesce(F.sum(wrong) / F.when(n_bad > 0, n_bad), F.lit(0.0)).alias("mean_conf_wrong"),
        F.avg("conf").alias("batch_score"),
        F.avg(right).alias("batch_score_ok"),
        F.avg(wrong).alias("batch_score_wrong"),
    )


def confusion(preds: DataFrame, keys: list[str]) -> DataFrame:
    """Dense counts over the sorted union of true and predicted labels."""
    cells = preds.groupBy(*keys, "true_cls", "pred_cls").agg(F.count(F.lit(1)).alias("n"))
    # From here on rows are bounded by the squared number of classes.
    labels = F.array_sort(F.array_union(F.collect_set("true_cls"), F.collect_set("pred_cls")))
    packed = (cells.groupBy(*keys) if keys else cells).agg(labels.alias("_l"))
    grid = packed.withColumn("true_cls", F.explode("_l")).withColumn("pred_cls", F.explode("_l")).drop("_l")
    names = [*keys, "true_cls", "pred_cls"]
    counted = cells.toDF(*(f"_{c}" for c in names), "_n")
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names]
    return grid.join(counted, on, "left").select(*names, F.coalesce("_n", F.lit(0)).alias("n"))


def _score_counts(preds: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Positives and negatives per distinct score; ties collapse map-side."""
    return preds.groupBy(*keys, F.col(score).alias("threshold")).agg(
        F.sum(F.when(F.col("pos"), 1).otherwise(0)).alias("n_pos"),
        F.sum(F.when(F.col("pos"), 0).otherwise(1)).alias("n_neg"),
    ).withColumn("_down", -F.col("threshold"))


def cumulative_counts(preds: DataFrame, keys: list[str], score: str = "close_max") -> DataFrame:
    """tps / fps at every distinct score, highest first."""
    counts = _score_counts(preds, keys, score)
    return range_scan(
        counts, keys, ["_down"], rank="rank",
        sums={"tps": F.col("n_pos"), "fps": F.col("n_neg")},
        totals={"all_pos": F.col("n_pos"), "all_neg": F.col("n_neg")},
        following={"next_pos": "n_pos", "next_neg": "n_neg"},
    ).drop("_down")


def _area() -> list[Column]:
    won = F.sum(F.col("n_pos") * (F.col("all_neg") - F.col("fps") + F.col("n_neg") / 2.0))
    area = F.try_divide(won, F.max("all_pos").cast("double") * F.max("all_neg"))
    return [area.alias("auc"), F.max("all_pos").alias("n_pos"), F.max("all_neg").alias("n_neg")]


def _bends() -> Column:
    """Whether a score is a point of the curve: the first, the last, or followed by other counts."""
    same = (F.col("next_pos") == F.col("n_pos")) & (F.col("next_neg") == F.col("n_neg"))
    return (F.col("rank") == 1) | F.col("next_pos").isNull() | ~same


def auroc(preds: DataFrame, keys: list[str], score: str = "close_max") -> DataFrame:
    """Mann-Whitney statistic, ties counted half; NULL without both kinds of rows."""
    c = cumulative_counts(preds, keys, score)
    return (c.groupBy(*keys) if keys else c).agg(*_area())


def roc_curve(preds: DataFrame, keys: list[str], score: str = "close_max", drop_collinear: bool = True) -> DataFrame:
    """(fpr, tpr, threshold) with a leading (0, 0, highest + 1) row.

    Interior points on a straight segment are dropped: there the next distinct
    score adds the same counts.
    """
    c = cumulative_counts(preds, keys, score)
    if drop_collinear:
        c = c.filter(_bends())
    point = F.struct(
        F.try_divide("fps", "all_neg").alias("fpr"),
        F.try_divide("tps", "all_pos").alias("tpr"),
        F.col("threshold").alias("threshold"),
    )
    origin = F.struct(F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), (F.col("threshold") + 1).alias("threshold"))
    points = F.explode(F.when(F.col("rank") == 1, F.array(origin, point)).otherwise(F.array(point)))
    return c.select(*keys, points.alias("p")).select(*keys, "p.fpr", "p.tpr", "p.threshold")


def operating_threshold(preds: DataFrame, keys: list[str], target_far: float = 0.05, **roc) -> DataFrame:
    """Threshold of the last ROC row before the false-alarm rate exceeds the target."""
    curve = roc_curve(preds, keys, **roc).filter(F.col("fpr") <= target_far)
    return (curve.groupBy(*keys) if keys else curve).agg(F.min("threshold").alias("threshold"))


def _threshold(target_far: float) -> Column:
    """The same from the running counts: the leading row of the curve has no false alarms."""
    within = _bends() & (F.try_divide("fps", "all_neg") <= target_far)
    leading = F.when(F.max("all_neg") > 0, F.max("threshold") + 1)
    return F.coalesce(F.min(F.when(within, F.col("threshold"))), leading)


def operating_point(
    preds: DataFrame, keys: list[str], target_far: float = 0.05, unknown_cls: int = -1,
    score: str = "conf", drop_collinear: bool = True,
) -> DataFrame:
    """Accuracy and false rejections of the positives at the target false-alarm rate.

    By default positives are compared by their overall confidence although the
    threshold comes from the keyword scores; ``score='close_max'`` aligns both.
    """
    limit = operating_threshold(preds, keys, target_far, drop_collinear=drop_collinear)
    return _at_threshold(preds, keys, limit, unknown_cls, score)


def _at_threshold(preds: DataFrame, keys: list[str], limit: DataFrame, unknown_cls: int, score: str) -> DataFrame:
    positives = preds.filter("pos")
    if keys:
        at = positives.join(limit, keys)
    else:
        at = positives.withColumn("threshold", limit.scalar())
    masked = F.when(F.col(score) < F.col("threshold"), F.lit(unknown_cls)).otherwise(F.col("pred_cls"))
    share = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
    return (at.groupBy(*keys) if keys else at).agg(
        F.max("threshold").alias("thr_far05"),
        share(masked == F.col("true_cls")).alias("acc_far05"),
        share(masked == unknown_cls).alias("frr_far05"),
    )


def episode_metrics(
    preds: DataFrame, keys: list[str], target_far: float = 0.05, unknown_cls: int = -1, score: str = "conf"
) -> DataFrame:
    """One row per key: AUC, counts, accuracies, operating point (NULL when closed-set).

    One running count serves the area and the threshold. ``cerr_far05`` is
    reported and always 0, as nothing defines it.
    """
    preds = materialize(preds)  # several passes over scores that are costly to compute
    ok = F.when(F.col("pred_cls") == F.col("true_cls"), 1.0).otherwise(0.0)
    base = preds.groupBy(*keys).agg(
        F.avg(F.when(F.col("pos"), ok)).alias("accuracy_pos"),
        F.avg(F.when(~F.col("pos"), ok)).alias("accuracy_neg"),
    )
    # one row per key
    curve = materialize(cumulative_counts(preds, keys).groupBy(*keys).agg(*_area(), _threshold(target_far).alias("threshold")))
    limit = curve.filter("threshold IS NOT NULL").select(*keys, "threshold")
    return (
        base.join(curve.drop("threshold"), keys, "left")
        .join(_at_threshold(preds, keys, limit, unknown_cls, score), keys, "left")
        .withColumn("cerr_far05", F.when(F.col("n_neg") > 0, F.lit(0.0)))
    )


def summarize(metrics: DataFrame, fields: list[str]) -> DataFrame:
    """Mean and sample deviation (0 for one row) of each field over the rows."""
    stacked = metrics.select(
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("v")) for f in fields])).alias("x")
    ).select("x.field", "x.v")
    return stacked.groupBy("field").agg(
        F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("std")
    )


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(value * weight), F.sum(weight))


def source_false_alarms(preds: DataFrame, source: str = "source", unknown_cls: int = -1) -> DataFrame:
    """Totals, false alarms and their keywords per rejection source, plus an ALL row."""
    cells = preds.groupBy(source, "pred_cls").agg(F.count(F.lit(1)).alias("n"))
    # Bounded by sources times classes from here on.
    both = cells.withColumn(source, F.explode(F.array(F.col(source), F.lit("ALL"))))
    per = both.groupBy(source, "pred_cls").agg(F.sum("n").alias("n"))
    alarm = F.col("pred_cls") != unknown_cls
    named = F.array_sort(F.collect_list(F.when(alarm, F.struct("pred_cls", "n"))))
    fa = F.sum(F.when(alarm, F.col("n")).otherwise(0))
    return per.groupBy(source).agg(
        F.sum("n").alias("total"),
        fa.alias("fa"),
        (fa * 100.0 / F.sum("n")).alias("far_pct"),
        F.array_join(F.transform(named, lambda x: F.concat_ws(":", x["pred_cls"], x["n"])), ",").alias("per_keyword"),
    )


def best_epoch(epochs: DataFrame, keys: list[str], score: list[str], epoch: str) -> DataFrame:
    """Epoch with the lexicographically largest score; the first one on ties."""
    rank = F.struct(*score, (-F.col(epoch)).alias("_first"))
    return epochs.groupBy(*keys).agg(F.max_by(F.struct(epoch, *score), rank).alias("b")).select(*keys, "b.*")


def early_stop(epochs: DataFrame, run: str, epoch: str, score: str, patience: int) -> DataFrame:
    """First epoch after ``patience`` epochs without a strictly better score.

    A run has few epochs; its curve is a bounded window.
    """
    from pyspark.sql import Window

    along = Window.partitionBy(run).orderBy(epoch)
    best_before = F.max(score).over(along.rowsBetween(Window.unboundedPreceding, -1))
    marked = epochs.withColumn(
        "_hit", F.when(best_before.isNull() | (F.col(score) > best_before), F.col(epoch))
    )
    last = F.max("_hit").over(along.rowsBetween(Window.unboundedPreceding, 0))
    stale = marked.withColumn("_stale", F.col(epoch) - last)
    return stale.groupBy(run).agg(
        F.min(F.when(F.col("_stale") >= patience, F.col(epoch))).alias("stop_epoch"),
        F.min_by(epoch, F.struct(-F.col(score), F.col(epoch))).alias("best_epoch"),
        F.max(score).alias("best_score"),
    )


def aggregate_windows(scores: DataFrame, keys: list[str], score: str) -> DataFrame:
    """max / log-sum-exp / mean of window scores per sample and class."""
    tops = scores.groupBy(*keys).agg(F.max(score).alias("max_logit"), F.avg(score).alias("mean_logit"))
    shifted = scores.join(tops, keys).groupBy(*keys).agg(
        F.max("max_logit").alias("max_logit"),
        F.max("mean_logit").alias("mean_logit"),
        F.sum(F.exp(F.col(score) - F.col("max_logit"))).alias("_mass"),
    )
    return shifted.withColumn("logsumexp", F.log("_mass") + F.col("max_logit")).drop("_mass")


def aggregated_scores(scores: DataFrame, keys: list[str], score: str, by: str) -> DataFrame:
    """``score`` per sample and class by the named rule: max_logit, logsumexp or mean_logit."""
    if by not in ("max_logit", "logsumexp", "mean_logit"):
        raise ValueError(f"no such aggregation: {by}")
    if by == "logsumexp":
        return aggregate_windows(scores, keys, score).select(*keys, F.col(by).alias(score))
    rule = F.max if by == "max_logit" else F.avg
    return scores.groupBy(*keys).agg(rule(score).alias(score))
