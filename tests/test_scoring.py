import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot import presets
from earshot.functions import arrays, vectors
from earshot.operators import evaluation as E
from earshot.operators import pairs as PR
from earshot.operators import prototypes as P
from earshot.operators import records as R
from earshot.operators import splits as S
from earshot.operators.classifiers import classifier


@pytest.fixture(scope="module")
def vectors_(spark):
    rng = random.Random(6)
    rows = [(i, i % 7, [rng.gauss(0, 1) for _ in range(5)]) for i in range(140)]
    return rows, spark.createDataFrame(rows, "vec_id long, label int, z array<double>")


def test_parts_equal_one_model(spark, vectors_):
    _, df = vectors_
    protos = P.class_means(df, ["label"], "z", 5)
    parts = P.predict(df, protos, "label", "z", 5, 7, ["vec_id"], [2, 5], part_bytes=100).collect()
    whole = {r.vec_id: r for r in P.predict(df, protos, "label", "z", 5, 7, ["vec_id"], [2, 5]).collect()}
    assert len(parts) == 140
    for r in parts:
        want = whole[r.vec_id]
        assert r.pred == want.pred and np.allclose([r.conf, r.close_max, r.ood], [want.conf, want.close_max, want.ood], atol=1e-12)


def test_labels_may_be_text(spark, vectors_):
    _, df = vectors_
    named = df.withColumn("label", F.concat(F.lit("c"), "label"))
    by_number = {r.vec_id: r for r in P.predict(df, P.class_means(df, ["label"], "z", 5), "label", "z", 5, 7, ["vec_id"], [2]).collect()}
    for r in P.predict(named, P.class_means(named, ["label"], "z", 5), "label", "z", 5, 7, ["vec_id"], ["c2"]).collect():
        assert r.pred == f"c{by_number[r.vec_id].pred}" and abs(r.ood - by_number[r.vec_id].ood) < 1e-12


def test_vector_of_another_length_stops_the_job(spark, vectors_):
    _, df = vectors_
    with pytest.raises(Exception, match="length 4"):
        P.class_means(df, ["label"], "z", 4).collect()


def test_model_bound_is_checked(spark, vectors_):
    _, df = vectors_
    protos = P.class_means(df, ["label"], "z", 5)
    with pytest.raises(ValueError, match="more than the declared"):
        P.predict(df, protos, "label", "z", 5, 3, ["vec_id"], [])


def test_reprojection_equals_matrix_form():
    rng = np.random.default_rng(0)
    z, p = rng.normal(size=(6, 5)), rng.normal(size=(3, 5))
    got = P.score_matrix("reprojection", z, p, beta=0.3)
    for j in range(3):
        s = p[j : j + 1]
        w = s.T @ np.linalg.inv(s @ s.T + np.eye(1) / 5) @ s
        want = -((math.exp(0.3) * z @ w - z) ** 2).sum(axis=1)
        assert np.allclose(got[:, j], want)


def test_column_forms_agree_with_matrix_form(spark, vectors_):
    rows, df = vectors_
    p = rows[0][2]
    lit = F.array(*[F.lit(x) for x in p])
    out = df.select(
        "vec_id", vectors.squared_distance(F.col("z"), lit).alias("d"), vectors.cosine(F.col("z"), lit).alias("c"),
        vectors.reprojection_score(F.col("z"), lit, 0.1, 5).alias("r"),
    ).orderBy("vec_id").collect()
    z = np.array([r[2] for r in rows])
    for name, got in (("euclidean", [-r.d for r in out]), ("cosine", [r.c for r in out])):
        assert np.allclose(P.score_matrix(name, z, np.array([p]))[:, 0], got)
    assert np.allclose(P.score_matrix("reprojection", z, np.array([p]), beta=0.1)[:, 0], [r.r for r in out])


def preds(spark, seed=1, n=300, digits=2):
    rng = random.Random(seed)
    rows = [(i, rng.random() < 0.6, round(rng.random(), digits), rng.randrange(3)) for i in range(n)]
    rows = [(i, pos, c if pos else -1, rng.choice([0, 1, 2, -1]), min(1.0, s + 0.01), s) for i, pos, s, c in rows]
    return rows, spark.createDataFrame(rows, "id int, pos boolean, true_cls int, pred_cls int, conf double, close_max double")


def test_auc_roc_and_operating_point_against_brute_force(spark):
    rows, df = preds(spark)
    p, n = [r[5] for r in rows if r[1]], [r[5] for r in rows if not r[1]]
    auc = sum((a > b) + 0.5 * (a == b) for a in p for b in n) / len(p) / len(n)
    assert abs(E.auroc(df, []).first().auc - auc) < 1e-12
    mirrored = df.withColumn("close_max", 1 - F.col("close_max"))
    assert abs(E.auroc(mirrored, []).first().auc - (1 - auc)) < 1e-9
    full = sorted((r.fpr, r.tpr, r.threshold) for r in E.roc_curve(df, [], drop_collinear=False).collect())
    thresholds = sorted({r[5] for r in rows}, reverse=True)
    want = [(0.0, 0.0, thresholds[0] + 1)] + [(sum(x >= t for x in n) / len(n), sum(x >= t for x in p) / len(p), t) for t in thresholds]
    assert np.allclose(full, sorted(want))
    kept = [(r.fpr, r.tpr) for r in E.roc_curve(df, []).orderBy(F.desc("threshold")).collect()]
    steps = [(f, t) for f, t, _ in want[1:]]
    expect = [(0.0, 0.0)] + [
        s for i, s in enumerate(steps)
        if i in (0, len(steps) - 1) or not np.allclose(np.subtract(steps[i + 1], s), np.subtract(s, steps[i - 1]), atol=1e-12)
    ]
    assert np.allclose(kept, expect)
    point = E.operating_point(df, [], 0.1, drop_collinear=False).first()
    thr = min(t for f, _, t in want if f <= 0.1)
    mine = [r for r in rows if r[1]]
    masked = [(-1 if r[4] < thr else r[3], r[2]) for r in mine]
    assert point.thr_far05 == thr
    assert abs(point.acc_far05 - sum(a == b for a, b in masked) / len(mine)) < 1e-12
    assert abs(point.frr_far05 - sum(a == -1 for a, _ in masked) / len(mine)) < 1e-12


def test_closed_set_episode_has_no_open_set_fields(spark):
    _, df = preds(spark)
    out = E.episode_metrics(df.filter("pos").withColumn("episode", F.lit(1)), ["episode"]).first()
    assert out.accuracy_neg is None and 0 <= out.accuracy_pos <= 1


def test_weibull_fit_is_the_likelihood_maximum():
    rng = np.random.default_rng(3)
    x = rng.weibull(1.7, 5) + 0.2
    shape, scale = P.weibull_fit(x)

    def loglik(k, s):
        return np.sum(np.log(k / s) + (k - 1) * np.log(x / s) - (x / s) ** k)

    best = loglik(shape, scale)
    assert all(best >= loglik(shape * a, scale * b) - 1e-9 for a in (0.98, 1, 1.02) for b in (0.98, 1, 1.02))


def test_sample_weights_share_one_per_class(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", "_unknown_"]), rng.choice(["hard_negative", "librispeech", "gsc_words"]), rng.choice(["x", "y", None])) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, label string, source string, hardneg_category string")
    out = R.sample_weights(df, presets.SOURCE_WEIGHTS, {"x": 3.0})
    assert out.count() == 200
    for r in out.groupBy("label").agg(F.sum("weight").alias("w")).collect():
        assert abs(r.w - 1) < 1e-12
    with pytest.raises(Exception, match="weights are <= 0"):
        R.sample_weights(df, {"unknown_other": 0.0, "hard_negative": -1.0}).collect()


def test_triplets_and_pairs_in_one_batch(spark):
    rows = [("b", i, i // 2, [float(i), 0.0]) for i in range(6)]
    df = spark.createDataFrame(rows, "batch string, vec_id long, label int, z array<double>")
    pairs = PR.pairs(df, "label", "vec_id", "z", "hard", 1).collect()
    assert sum(r.positive for r in pairs) == 3 and sum(not r.positive for r in pairs) == 3
    assert sorted(r.distance for r in pairs if not r.positive)[:2] == [1.0, 1.0]
    everything = PR.triplets(df, "label", "vec_id", "z", "all", 0.5, 1)
    assert everything.count() == 3 * 4
    far = df.withColumn("z", F.transform("z", lambda x: x + F.col("label") * 100))
    fallback = PR.triplets(far, "label", "vec_id", "z", "hardest", 0.5, 1).collect()
    assert [(r.anchor, r.positive, r.negative) for r in fallback] == [(4, 5, 0)]


def test_array_functions(spark):
    one = spark.range(1)
    sig = F.array(*[F.lit(float(x)) for x in range(1, 7)])
    row = one.select(
        arrays.shift_and_pad(sig, F.lit(2), 6).alias("right"), arrays.shift_and_pad(sig, F.lit(-2), 6).alias("left"),
        arrays.center_crop(sig, 3).alias("crop"), arrays.time_slice(sig, F.lit(0.2), F.lit(0.5), 10).alias("cut"),
        arrays.window_starts(F.lit(10), 4, 3).alias("starts"), arrays.window_starts(F.lit(3), 4, 3).alias("short"),
        arrays.zero_pad(F.array(F.lit(1.0)), F.lit(1), F.lit(2)).alias("pad"), arrays.channel_mean(sig, sig).alias("mono"),
        arrays.samples_to_frames(F.lit(16000), 640, 320).alias("frames"), arrays.format_magnitude(F.lit(1234.0)).alias("m"),
        arrays.random_crop(sig, 2, F.lit(0.99)).alias("rc"),
    ).first()
    assert row.right == [0.0, 0.0, 1.0, 2.0, 3.0, 4.0] and row.left == [3.0, 4.0, 5.0, 6.0, 0.0, 0.0]
    assert row.crop == [2.0, 3.0, 4.0] and row.cut == [3.0, 4.0, 5.0]
    assert row.starts == [0, 3, 6] and row.short == [0] and row.pad == [0.0, 1.0, 0.0, 0.0]
    assert row.mono == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0] and row.frames == 49 and row.m == "1.234 KFLOPs" and row.rc == [5.0, 6.0]


def test_confusion_grid_of_many_classes(spark):
    rows = [(i % 300, (i * 7) % 300) for i in range(3000)]
    out = E.confusion(spark.createDataFrame(rows, "true_cls int, pred_cls int"), []).filter("n > 0").collect()
    assert {(r.true_cls, r.pred_cls): r.n for r in out} == {p: rows.count(p) for p in set(rows)}


def test_classifiers_by_name(spark):
    rng = random.Random(5)
    rows = [(i, i % 3, [rng.gauss(5.0 * (i % 3 == d), 0.4) for d in range(4)]) for i in range(60)]
    support, queries = (spark.createDataFrame(r, "id long, cls int, z array<double>") for r in (rows[:36], rows[36:]))
    for name, options in (("ncm", {"reject": (2,)}), ("ncm_openmax", {"reject": (2,)}), ("ncm_openmax", {"reject": (2,), "distance": "combined"}), ("dproto", {"reject": (2,)})):
        fitted = classifier(name, dim=4, n_way=3, **options).fit(support, "cls", "z", "id")
        out = fitted.predict(queries, "z", ["id", "cls"]).collect()
        assert len(out) == 24 and set(fitted.tables) == {"prototypes"}
        for r in out:
            assert 0 <= r.ood <= 1 and r.close_max <= r.conf + 1e-12
        if name != "ncm_openmax":
            assert all((r.pred == r.cls) or (r.cls == 2 and r.pred == -1) for r in out)
    with pytest.raises(ValueError):
        classifier("peeler", dim=4, n_way=3)


def test_aggregation_by_name(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 0, 3.0), (1, 1, 2.0)], "id long, cls int, s double")
    got = {by: sorted((r.cls, round(r.s, 6)) for r in E.aggregated_scores(df, ["id", "cls"], "s", by).collect()) for by in ("max_logit", "mean_logit", "logsumexp")}
    assert got["max_logit"] == [(0, 3.0), (1, 2.0)] and got["mean_logit"] == [(0, 2.0), (1, 2.0)] and got["logsumexp"] == [(0, 3.126928), (1, 2.0)]


def test_support_by_number(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(100)] + [(500, 7)], "id long, cls int")
    episodes = spark.createDataFrame([(e, c) for e in range(40) for c in (0, 1, 7)], "episode int, cls int")
    out = S.episode_support(rows, episodes, "cls", "id", 4, 3).collect()
    picked = {}
    for r in out:
        picked.setdefault((r.episode, r.cls), []).append(r.id)
    assert all(len(set(v)) == len(v) == (1 if c == 7 else 4) for (_, c), v in picked.items()) and len(picked) == 120
    # every row is as likely as any other
    assert len({i for (_, c), v in picked.items() if c == 0 for i in v}) > 30
