"""Prototype, scoring and open-set evaluation queries on the embedding table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot import presets
from earshot.functions import arrays, vectors
from earshot.operators import evaluation as E
from earshot.operators import prototypes as P
from earshot.operators import splits as S
from earshot.operators.classifiers import classifier
from earshot.plans import views as V
from earshot.plans.registry import query
from earshot.session import read_table

SEED, DIM = presets.SEED, V.DIM
N_CLASSES = 10


def support_means(spark, sf):
    return P.class_means(V.support(spark, sf), ["label"], "z", DIM).withColumnRenamed("label", "class")


def scored_queries(spark, sf, method, **options):
    return P.with_scores(
        V.queries(spark, sf), support_means(spark, sf), "class", "z", DIM, N_CLASSES, ["vec_id", "label"], method, **options
    )


def long_scores(df, digits=6):
    return df.select("vec_id", F.explode("scores").alias("x")).select(
        "vec_id", F.col("x.cls").alias("class"), F.round("x.s", digits).alias("score")
    )


def predictions(spark, sf):
    out = P.predict(
        V.queries(spark, sf), support_means(spark, sf), "class", "z", DIM, N_CLASSES, ["vec_id", "label"], V.REJECT
    )
    known = lambda c: F.when(F.col(c) < V.N_KNOWN, F.col(c)).otherwise(F.lit(-1))
    return out.select(
        "vec_id", "label", (F.col("label") < V.N_KNOWN).alias("pos"), known("label").alias("true_cls"),
        known("pred").alias("pred_cls"), "conf", "close_max", "ood",
    )


@query("prototypes_mean", f"""
WITH {V.PROTO_SQL}
SELECT class, unnest(range(0, {DIM}))::INTEGER AS dim, round(unnest(p), 6) AS value FROM proto
""")
def prototypes_mean(spark, sf):
    return support_means(spark, sf).select("class", F.posexplode("proto").alias("dim", "v")).select(
        "class", "dim", F.round("v", 6).alias("value")
    )


@query("prototypes_norm", f"""
WITH l AS (SELECT label, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label, i, avg(v) AS v, count(*) AS n FROM l GROUP BY label, i),
s AS (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY label)) AS nrm FROM m)
SELECT label AS class, (i - 1)::INTEGER AS dim, round(v / greatest(nrm, 1e-12), 6) AS value, n AS n_support FROM s
""")
def prototypes_norm(spark, sf):
    protos = P.normalized_class_means(V.embeddings(spark, sf), ["label"], "z", DIM)
    return protos.select(F.col("label").alias("class"), "n_support", F.posexplode("proto").alias("dim", "v")).select(
        "class", "dim", F.round("v", 6).alias("value"), "n_support"
    )


@query("l2_normalize", """
WITH x AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda v: v * (vec_id % 5)) AS a FROM embeddings),
n AS (SELECT vec_id, a, greatest(sqrt(list_sum(list_transform(a, lambda v: v * v))), 1e-12) AS nrm FROM x)
SELECT vec_id, generate_subscripts(a, 1)::INTEGER - 1 AS dim, round(unnest(a) / nrm, 6) + 0.0 AS value FROM n
""")
def l2_normalize(spark, sf):
    scaled = F.transform("z", lambda v: v * F.pmod("vec_id", F.lit(5)))
    return V.embeddings(spark, sf).select("vec_id", F.posexplode(vectors.l2_normalize(scaled)).alias("dim", "v")).select(
        "vec_id", "dim", (F.round("v", 6) + F.lit(0.0)).alias("value")
    )


_PAIR = "SELECT vec_id, class, round({}, 6) AS score FROM qry, proto"
_DOT = "list_inner_product({}, {})"


@query("proto_sqdist", f"WITH {V.PROBA_SQL} SELECT vec_id, class, round(-s, 6) AS score FROM dist")
def proto_sqdist(spark, sf):
    return long_scores(scored_queries(spark, sf, "euclidean")).withColumn("score", -F.col("score"))


@query("proto_cosine", f"WITH {V.PROTO_SQL} " + _PAIR.format(
    "list_inner_product(z, p) / greatest(sqrt(list_inner_product(z, z)) * sqrt(list_inner_product(p, p)), 1e-8)"))
def proto_cosine(spark, sf):
    return long_scores(scored_queries(spark, sf, "cosine"))


@query("reprojection_scores", f"""WITH {V.PROTO_SQL},
d AS (SELECT vec_id, class, list_inner_product(z, p) AS qp, list_inner_product(p, p) AS pp, list_inner_product(z, z) AS qq FROM qry, proto),
a AS (SELECT *, qp / (pp + 1.0::DOUBLE / {DIM}) AS a FROM d)
SELECT vec_id, class, round(-(exp(0.4::DOUBLE) * a * a * pp - 2 * exp(0.2::DOUBLE) * a * qp + qq), 6) AS score FROM a
""")
def reprojection_scores(spark, sf):
    return long_scores(scored_queries(spark, sf, "reprojection", beta=0.2))


@query("openset_scores", f"WITH {V.PROBA_SQL} SELECT vec_id, pos, true_cls, pred_cls, round(conf, 6) AS conf, round(close_max, 6) AS close_max, round(ood, 6) AS ood FROM pred")
def openset_scores(spark, sf):
    rounded = {c: F.round(c, 6) for c in ("conf", "close_max", "ood")}
    return predictions(spark, sf).drop("label").withColumns(rounded)


@query("fewshot_rank", f"""
WITH {V.EMB_SQL},
nz AS (SELECT vec_id, label, unnest(z) / sqrt(list_inner_product(z, z)) AS v, generate_subscripts(z, 1) AS i FROM sup),
nm AS (SELECT label, i, avg(v) AS v FROM nz GROUP BY label, i),
np AS (SELECT label AS class, list(v / nrm ORDER BY i) AS p FROM (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY label)) AS nrm FROM nm) GROUP BY label),
qn AS (SELECT vec_id, list_transform(z, lambda v: v / sqrt(list_inner_product(z, z))) AS z FROM qry),
d AS (SELECT vec_id, class, list_sum(list_transform(list_zip(z, p), lambda t: (t[1]-t[2])*(t[1]-t[2]))) AS d FROM qn, np),
e AS (SELECT *, exp(-d - max(-d) OVER (PARTITION BY vec_id)) AS e FROM d),
r AS (SELECT vec_id, class, sqrt(d) AS d, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM e),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, class) AS rk FROM r)
SELECT vec_id, rk::INTEGER AS place, class, round(p, 6) AS probability, round(d, 6) AS distance,
  CASE WHEN max(p) OVER (PARTITION BY vec_id) < 0.13 THEN '_reject_' ELSE class::VARCHAR END AS decision
FROM k WHERE rk <= 3
""")
def fewshot_rank(spark, sf):
    protos = P.normalized_class_means(V.support(spark, sf), ["label"], "z", DIM, each=True)
    unit = V.queries(spark, sf).withColumn("z", vectors.l2_normalize(F.col("z")))
    rows = P.with_scores(unit, protos, "label", "z", DIM, N_CLASSES, ["vec_id"], "euclidean")

    def rank(pairs):
        ranked = F.zip_with(
            P.probabilities(pairs), pairs,
            lambda a, b: F.struct((-a["p"]).alias("np"), a["cls"].alias("cls"), F.sqrt(-b["s"]).alias("d")),
        )
        return F.slice(F.array_sort(ranked), 1, 3)

    top = rows.select("vec_id", vectors.let(F.col("scores"), rank).alias("top"))
    best = -F.col("top")[0]["np"]
    return top.select("vec_id", best.alias("best"), F.posexplode("top").alias("pos", "x")).select(
        "vec_id", (F.col("pos") + 1).alias("place"), F.col("x.cls").alias("class"),
        F.round(-F.col("x.np"), 6).alias("probability"), F.round("x.d", 6).alias("distance"),
        F.when(F.col("best") < 0.13, presets.REJECT_LABEL).otherwise(F.col("x.cls").cast("string")).alias("decision"),
    )


_TAIL_SQL = V.PROTO_SQL + f""",
sd AS (SELECT label, vec_id, list_sum(list_transform(list_zip(z, p), lambda t: (t[1]-t[2])*(t[1]-t[2]))) AS d FROM sup JOIN proto ON class = label WHERE label < {V.N_KNOWN}),
tail AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d DESC, vec_id) AS tail_no FROM sd) WHERE tail_no <= 5)
"""


def tails(spark, sf):
    rows = V.support(spark, sf).filter(F.col("label") < V.N_KNOWN)
    protos = P.class_means(rows, ["label"], "z", DIM)
    return P.tail_distances(rows, protos, "label", "z", "vec_id")


@query("tail_distances", f"WITH {_TAIL_SQL} SELECT label, vec_id, tail_no::INTEGER AS tail_no, round(d, 6) AS distance FROM tail")
def tail_distances(spark, sf):
    return tails(spark, sf).withColumn("distance", F.round("distance", 6))


@query("openmax_fit", f"""WITH {_TAIL_SQL}
SELECT label, count(*) AS n_tail, round(min(d), 6) AS shift, 0.0::DOUBLE AS shape_residual, 0.0::DOUBLE AS scale_residual FROM tail GROUP BY label
""")
def openmax_fit(spark, sf):
    """The fit put into its likelihood equations: at the maximum both residuals vanish."""
    far = tails(spark, sf)
    x = far.join(P.openmax_fit(far, "label"), "label").withColumn("x", F.col("distance") + 1 - F.col("shift"))
    power, log = F.pow(F.col("x") / F.col("scale"), F.col("shape")), F.ln("x")
    shape = F.avg(log) + 1 / F.first("shape") - F.sum(power * log) / F.sum(power)
    residuals = {"shape_residual": shape, "scale_residual": F.avg(power) - 1}
    return x.groupBy("label").agg(
        F.count(F.lit(1)).alias("n_tail"), F.round(F.first("shift"), 6).alias("shift"),
        *((F.round(v, 6) + F.lit(0.0)).alias(n) for n, v in residuals.items()),
    )


@query("openmax_scores", f"""WITH {_TAIL_SQL},
par AS (SELECT label, 2.0::DOUBLE AS shape, avg(d) + 1 - min(d) AS scale, min(d) AS shift FROM tail GROUP BY label),
dd AS (SELECT vec_id, class, shape, scale, shift, list_sum(list_transform(list_zip(z, p), lambda t: (t[1]-t[2])*(t[1]-t[2]))) AS d FROM qry, proto JOIN par ON par.label = class),
w AS (SELECT *, CASE WHEN d + 1 - shift > 0 THEN 1 - exp(-pow((d + 1 - shift) / scale, shape)) ELSE 0 END AS w FROM dd),
sc AS (SELECT vec_id, class, -d * w AS s FROM w UNION ALL SELECT vec_id, 99, -sum(d - d * w) FROM w GROUP BY vec_id),
e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY vec_id)) AS e FROM sc)
SELECT vec_id, class, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS probability FROM e
""")
def openmax_scores(spark, sf):
    params = tails(spark, sf).groupBy("label").agg(
        F.lit(2.0).alias("shape"), (F.avg("distance") + 1 - F.min("distance")).alias("scale"), F.min("distance").alias("shift")
    )
    return openmax_with(spark, sf, params).withColumn("probability", F.round("probability", 6))


def openmax_with(spark, sf, params):
    """OpenMax probabilities of all queries under given tail models."""
    known = support_means(spark, sf).filter(F.col("class") < V.N_KNOWN)
    scored = P.with_scores(V.queries(spark, sf), known, "class", "z", DIM, N_CLASSES, ["vec_id"], "euclidean")
    # One entry per known class; a class without a tail model takes no part.
    table = params.agg(F.map_from_entries(F.collect_list(F.struct("label", F.struct("shape", "scale", "shift")))))
    rows = scored.withColumn("params", table.scalar())
    fitted = F.filter("scores", lambda x: F.map_contains_key("params", x["cls"]))
    dist = F.transform(fitted, lambda x: vectors.let(F.element_at("params", x["cls"]), lambda t: F.struct(
        x["cls"].alias("cls"), (-x["s"]).alias("d"), t["shape"].alias("shape"), t["scale"].alias("scale"), t["shift"].alias("shift"),
    )))
    probs = rows.select("vec_id", dist.alias("d")).select("vec_id", F.explode(P.openmax_probabilities(F.col("d"), 99)).alias("x"))
    return probs.select("vec_id", F.col("x.cls").alias("class"), F.col("x.p").alias("probability"))


_KINDS = ("euclidean", "cosine", "combined")
_SQUARE = "list_sum(list_transform(list_zip(z, p), lambda t: (t[1]-t[2])*(t[1]-t[2])))"
_ANGLE = "(1 - list_inner_product(z, p) / greatest(sqrt(list_inner_product(z, z)) * sqrt(list_inner_product(p, p)), 1e-8))"
_KIND_SQL = "unnest([{'kind': 'euclidean', 'd': q}, {'kind': 'cosine', 'd': a}, {'kind': 'combined', 'd': q + a}], recursive := true)"


@query("openmax_classify", f"""WITH RECURSIVE {V.PROTO_SQL},
sd AS (SELECT label AS class, vec_id, {_KIND_SQL} FROM (SELECT label, vec_id, {_SQUARE} AS q, {_ANGLE} AS a FROM sup JOIN proto ON class = label WHERE label < {V.N_KNOWN})),
tail AS (SELECT * FROM sd QUALIFY row_number() OVER (PARTITION BY kind, class ORDER BY d DESC, vec_id) <= 5),
x AS (SELECT kind, class, min(d) AS shift, list(d + 1) AS raw FROM tail GROUP BY kind, class),
u AS (SELECT kind, class, shift, list_transform(raw, lambda d: d - shift) AS x FROM x),
fit AS (SELECT kind, class, 0 AS turn, 1e-3::DOUBLE AS lo, 1e5::DOUBLE AS hi, list_transform(x, lambda v: v / list_max(x)) AS x FROM u
  UNION ALL
  SELECT kind, class, turn + 1, CASE WHEN f < 0 THEN mid ELSE lo END, CASE WHEN f < 0 THEN hi ELSE mid END, x FROM (
    SELECT *, list_sum(list_transform(x, lambda v: pow(v, mid) * ln(v))) / list_sum(list_transform(x, lambda v: pow(v, mid))) - 1 / mid - list_avg(list_transform(x, lambda v: ln(v))) AS f
    FROM (SELECT *, sqrt(lo * hi) AS mid FROM fit WHERE turn < 90))),
par AS (SELECT kind, class, shift, k AS shape, list_max(u.x) * pow(list_avg(list_transform(f.x, lambda v: pow(v, k))), 1 / k) AS scale
  FROM (SELECT kind, class, x, sqrt(lo * hi) AS k FROM fit WHERE turn = 90) f JOIN u USING (kind, class)),
qd AS (SELECT vec_id, class, {_KIND_SQL} FROM (SELECT vec_id, class, {_SQUARE} AS q, {_ANGLE} AS a FROM qry, proto WHERE class < {V.N_KNOWN})),
w AS (SELECT kind, vec_id, class, d, d * CASE WHEN d + 1 - shift > 0 THEN 1 - exp(-pow((d + 1 - shift) / scale, shape)) ELSE 0 END AS kept FROM qd JOIN par USING (kind, class)),
sc AS (SELECT kind, vec_id, class, -kept AS s FROM w UNION ALL SELECT kind, vec_id, -1, -sum(d - kept) FROM w GROUP BY kind, vec_id),
e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY kind, vec_id)) AS e FROM sc),
pr AS (SELECT *, e / sum(e) OVER (PARTITION BY kind, vec_id) AS p FROM e)
SELECT kind, vec_id, round(max(p), 6) AS conf, round(max(p) FILTER (WHERE class >= 0), 6) AS close_max, round(sum(p) FILTER (WHERE class = -1), 6) AS ood FROM pr GROUP BY kind, vec_id
""")
def openmax_classify(spark, sf):
    """Tail models fitted on the support score every query, for each kind of distance."""
    support, rows = V.support(spark, sf), V.queries(spark, sf)

    def under(kind):
        fitted = classifier("ncm_openmax", dim=DIM, n_way=N_CLASSES, reject=tuple(V.REJECT), distance=kind).fit(support, "label", "z", "vec_id")
        return fitted.predict(rows, "z", ["vec_id"]).withColumn("kind", F.lit(kind))

    out = reduce(DataFrame.unionByName, [under(k) for k in _KINDS])
    return out.select("kind", "vec_id", *(F.round(c, 6).alias(c) for c in ("conf", "close_max", "ood")))


@query("dummy_proto_scores", f"""WITH {V.PROBA_SQL},
sc AS (SELECT vec_id, class, s FROM dist WHERE class < {V.N_KNOWN} UNION ALL SELECT vec_id, 99, max(s / 3) FROM dist WHERE class >= {V.N_KNOWN} GROUP BY vec_id),
e2 AS (SELECT *, exp(s - max(s) OVER (PARTITION BY vec_id)) AS e FROM sc)
SELECT vec_id, class, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS probability FROM e2
""")
def dummy_proto_scores(spark, sf):
    rows = scored_queries(spark, sf, "euclidean")
    is_known = lambda x: x["cls"] < V.N_KNOWN
    dummy = vectors.let(F.col("scores"), lambda pairs: P.dummy_prototype_scores(pairs, is_known, 99))
    scored = rows.select("vec_id", dummy.alias("scores"))
    return scored.select("vec_id", F.explode(P.probabilities(F.col("scores"))).alias("x")).select(
        "vec_id", F.col("x.cls").alias("class"), F.round("x.p", 6).alias("probability")
    )


@query("accuracy_conf", f"""WITH {V.PROBA_SQL}, o AS (SELECT *, pred_cls = true_cls AS ok FROM pred)
SELECT pos, count(*) AS n, round(avg(CASE WHEN ok THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy,
 round(coalesce(sum(conf) FILTER (WHERE ok) / nullif(count(*) FILTER (WHERE ok), 0), 0), 6) AS mean_conf_ok,
 round(coalesce(sum(conf) FILTER (WHERE NOT ok) / nullif(count(*) FILTER (WHERE NOT ok), 0), 0), 6) AS mean_conf_wrong,
 round(avg(conf), 6) AS batch_score, round(avg(CASE WHEN ok THEN conf ELSE 0 END), 6) AS batch_score_ok,
 round(avg(CASE WHEN ok THEN 0 ELSE conf END), 6) AS batch_score_wrong FROM o GROUP BY pos
""")
def accuracy_conf(spark, sf):
    out = E.accuracy_conf(predictions(spark, sf), ["pos"])
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c not in ("pos", "n")})


@query("confusion", f"""WITH {V.PROBA_SQL}, l AS (SELECT true_cls AS c FROM pred UNION SELECT pred_cls FROM pred),
g AS (SELECT true_cls, pred_cls, count(*) AS n FROM pred GROUP BY 1, 2)
SELECT a.c AS true_cls, b.c AS pred_cls, coalesce(n, 0)::BIGINT AS n FROM l a CROSS JOIN l b LEFT JOIN g ON g.true_cls = a.c AND g.pred_cls = b.c
""")
def confusion(spark, sf):
    return E.confusion(predictions(spark, sf), [])


@query("auroc", f"""WITH {V.PROBA_SQL},
c AS (SELECT close_max, count(*) FILTER (WHERE pos) AS p, count(*) FILTER (WHERE NOT pos) AS n FROM pred GROUP BY close_max),
k AS (SELECT *, sum(n) OVER (ORDER BY close_max) - n AS below FROM c)
SELECT round((sum(p * (below + n / 2.0)) / (sum(p) * sum(n)))::DOUBLE, 6) AS auc, sum(p)::BIGINT AS n_pos, sum(n)::BIGINT AS n_neg FROM k
""")
def auroc(spark, sf):
    return E.auroc(predictions(spark, sf), []).withColumn("auc", F.round("auc", 6))


_ROC_SQL = V.PROBA_SQL + """,
c AS (SELECT close_max AS thr, count(*) FILTER (WHERE pos) AS p, count(*) FILTER (WHERE NOT pos) AS n FROM pred GROUP BY close_max),
k AS (SELECT *, sum(p) OVER w AS tps, sum(n) OVER w AS fps, lead(p) OVER w AS np, lead(n) OVER w AS nn, row_number() OVER w AS rn,
             sum(p) OVER () AS ap, sum(n) OVER () AS an FROM c WINDOW w AS (ORDER BY thr DESC)),
roc AS (SELECT (fps / an)::DOUBLE AS fpr, (tps / ap)::DOUBLE AS tpr, thr FROM k WHERE rn = 1 OR np IS NULL OR np <> p OR nn <> n
        UNION ALL SELECT 0.0, 0.0, thr + 1 FROM k WHERE rn = 1)
"""


@query("roc_curve", f"WITH {_ROC_SQL} SELECT round(fpr, 6) AS fpr, round(tpr, 6) AS tpr, round(thr, 6) AS threshold FROM roc")
def roc_curve(spark, sf):
    return E.roc_curve(predictions(spark, sf), []).select(
        *[F.round(c, 6).alias(c) for c in ("fpr", "tpr", "threshold")]
    )


@query("operating_point", f"""WITH {_ROC_SQL}, t AS (SELECT min(thr) AS thr FROM roc WHERE fpr <= 0.05),
m AS (SELECT true_cls, CASE WHEN conf < thr THEN -1 ELSE pred_cls END AS pc, thr FROM pred, t WHERE pos)
SELECT round(max(thr), 6) AS thr_far05, round(avg(CASE WHEN pc = true_cls THEN 1.0::DOUBLE ELSE 0 END), 6) AS acc_far05,
       round(avg(CASE WHEN pc = -1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS frr_far05 FROM m
""")
def operating_point(spark, sf):
    out = E.operating_point(predictions(spark, sf), [])
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("source_false_alarms", f"""WITH {V.RECORD_SQL}, {V.PROBA_SQL},
n AS (SELECT coalesce(source, 'unknown_other') AS source, pred_cls FROM pred JOIN rec ON event_id = vec_id WHERE NOT pos),
b AS (SELECT source, pred_cls FROM n UNION ALL SELECT 'ALL', pred_cls FROM n),
g AS (SELECT source, pred_cls, count(*) AS n FROM b GROUP BY 1, 2)
SELECT source, sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (WHERE pred_cls <> -1), 0)::BIGINT AS fa,
  round(coalesce(sum(n) FILTER (WHERE pred_cls <> -1), 0) * 100.0::DOUBLE / sum(n), 6) AS far_pct,
  coalesce(string_agg(pred_cls || ':' || n, ',' ORDER BY pred_cls) FILTER (WHERE pred_cls <> -1), '') AS per_keyword
FROM g GROUP BY source
""")
def source_false_alarms(spark, sf):
    negatives = predictions(spark, sf).filter(~F.col("pos")).select("vec_id", "pred_cls")
    rec = V.event_records(spark, sf).select(F.col("event_id").alias("vec_id"), "source")
    joined = negatives.join(rec, "vec_id").withColumn("source", F.coalesce("source", F.lit("unknown_other")))
    return E.source_false_alarms(joined).withColumn("far_pct", F.round("far_pct", 6))


EPISODES, WAYS, SHOTS = 100, 6, 5
_EPISODE_SQL = f"""
m AS (SELECT vec_id, CASE WHEN label < {V.N_KNOWN} THEN label ELSE -1 END AS cls, embedding::DOUBLE[] AS z FROM embeddings),
ec AS (SELECT episode, cls FROM (SELECT episode, cls, row_number() OVER (PARTITION BY episode ORDER BY CASE WHEN cls = -1 THEN 0 ELSE 1 END, md5('{SEED}:' || episode || ':' || cls)) AS rn
       FROM (SELECT DISTINCT cls FROM m), (SELECT unnest(range(0, {EPISODES}))::INTEGER AS episode)) WHERE rn <= {WAYS}),
{V.draw_sql("ec JOIN (SELECT cls, count(*) AS n FROM m GROUP BY cls) USING (cls)", "cls", SHOTS)},
num AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY vec_id) AS no FROM m),
er AS (SELECT ec.episode, cls, vec_id, z, sample_no FROM num JOIN ec USING (cls) LEFT JOIN taken USING (episode, cls, no)),
el AS (SELECT episode, cls, unnest(z) AS v, generate_subscripts(z, 1) AS i FROM er WHERE sample_no IS NOT NULL),
em AS (SELECT episode, cls, i, avg(v) AS v FROM el GROUP BY ALL),
ep AS (SELECT episode, cls, list(v ORDER BY i) AS p FROM em GROUP BY episode, cls),
ed AS (SELECT er.episode, vec_id, er.cls AS true_cls, ep.cls, list_inner_product(z, z) + list_inner_product(p, p) - 2 * list_inner_product(z, p) AS d
       FROM er JOIN ep USING (episode) WHERE sample_no IS NULL),
ex AS (SELECT *, exp(-d - max(-d) OVER (PARTITION BY episode, vec_id)) AS e FROM ed),
eq AS (SELECT *, e / sum(e) OVER (PARTITION BY episode, vec_id) AS pr FROM ex),
pred AS (SELECT episode, vec_id, any_value(true_cls) AS true_cls, any_value(true_cls) >= 0 AS pos, arg_max(cls, (pr, -cls)) AS pred_cls,
         max(pr) AS conf, round(max(pr) FILTER (WHERE cls >= 0), 9) AS close_max FROM eq GROUP BY episode, vec_id),
acc AS (SELECT episode, avg(CASE WHEN pos THEN CASE WHEN pred_cls = true_cls THEN 1.0::DOUBLE ELSE 0 END END) AS accuracy_pos,
        avg(CASE WHEN NOT pos THEN CASE WHEN pred_cls = true_cls THEN 1.0::DOUBLE ELSE 0 END END) AS accuracy_neg FROM pred GROUP BY episode),
c AS (SELECT episode, close_max AS thr, count(*) FILTER (WHERE pos) AS p, count(*) FILTER (WHERE NOT pos) AS n FROM pred GROUP BY ALL),
k AS (SELECT *, sum(p) OVER w AS tps, sum(n) OVER w AS fps, lead(p) OVER w AS np, lead(n) OVER w AS nn, row_number() OVER w AS rn,
             sum(p) OVER (PARTITION BY episode) AS ap, sum(n) OVER (PARTITION BY episode) AS an FROM c WINDOW w AS (PARTITION BY episode ORDER BY thr DESC)),
auc AS (SELECT episode, (sum(p * (an - fps + n / 2.0)) / (max(ap) * max(an)))::DOUBLE AS auc, max(ap)::BIGINT AS n_pos, max(an)::BIGINT AS n_neg FROM k GROUP BY episode),
roc AS (SELECT episode, fps / an AS fpr, thr FROM k WHERE rn = 1 OR np IS NULL OR np <> p OR nn <> n UNION ALL SELECT episode, 0.0, thr + 1 FROM k WHERE rn = 1),
t AS (SELECT episode, min(thr) AS thr FROM roc WHERE fpr <= 0.05 GROUP BY episode),
op AS (SELECT episode, max(thr) AS thr_far05, avg(CASE WHEN conf >= thr AND pred_cls = true_cls THEN 1.0::DOUBLE ELSE 0 END) AS acc_far05,
       avg(CASE WHEN conf < thr OR pred_cls = -1 THEN 1.0::DOUBLE ELSE 0 END) AS frr_far05 FROM pred JOIN t USING (episode) WHERE pos GROUP BY episode),
met AS (SELECT episode, round(auc, 6) AS auc, n_pos, n_neg, round(accuracy_pos, 6) AS accuracy_pos, round(accuracy_neg, 6) AS accuracy_neg,
        round(thr_far05, 6) AS thr_far05, round(acc_far05, 6) AS acc_far05, round(frr_far05, 6) AS frr_far05, 0.0::DOUBLE AS cerr_far05
        FROM acc JOIN auc USING (episode) JOIN op USING (episode))
"""
METRICS = ["auc", "accuracy_pos", "accuracy_neg", "thr_far05", "acc_far05", "frr_far05", "cerr_far05"]


def episode_predictions(spark, sf, n_episodes=EPISODES, n_way=WAYS, k=SHOTS):
    """Predictions of every episode: drawn classes, support means, softmax, argmax."""
    rows = V.embeddings(spark, sf).select(
        "vec_id", F.when(F.col("label") < V.N_KNOWN, F.col("label")).otherwise(F.lit(-1)).alias("cls"), "z"
    )
    drawn = S.episode_classes(rows.select("cls").distinct(), "cls", n_episodes, n_way, SEED, ["-1"]).drop("class_pos")
    picked = S.episode_support(rows.select("vec_id", "cls"), drawn, "cls", "vec_id", k, SEED).select("episode", "vec_id", "cls")
    # Vectors are fetched only for the k * n_way * n_episodes chosen rows.
    support = picked.join(rows.select("vec_id", "z"), "vec_id")
    protos = P.class_means(support, ["episode", "cls"], "z", DIM)
    # A row is used by every episode that drew its class, except where it is support.
    uses = rows.join(drawn.groupBy("cls").agg(F.collect_list("episode").alias("eps")), "cls").join(
        picked.groupBy("vec_id").agg(F.collect_list("episode").alias("taken")), "vec_id", "left"
    )
    asked = F.array_except("eps", F.coalesce("taken", F.array().cast("array<int>")))
    queries = uses.select("vec_id", F.col("cls").alias("true_cls"), "z", asked.alias("asked"))
    out = P.predict_episodes(
        queries, protos, "cls", "z", DIM, n_way, n_episodes, ["vec_id", "true_cls"], "asked", [-1]
    )
    return out.select(
        "episode", "vec_id", "true_cls", (F.col("true_cls") >= 0).alias("pos"), F.col("pred").alias("pred_cls"),
        "conf", F.round("close_max", 9).alias("close_max"),
    )


def fewshot_metrics(spark, sf, **kw):
    out = E.episode_metrics(episode_predictions(spark, sf, **kw), ["episode"])
    return out.withColumns({c: F.round(c, 6) for c in METRICS})


@query("fewshot_eval", f"WITH {_EPISODE_SQL} SELECT * FROM met")
def fewshot_eval(spark, sf):
    return fewshot_metrics(spark, sf)


@query("fewshot_summary", f"WITH {_EPISODE_SQL} " + " UNION ALL ".join(
    f"SELECT '{f}' AS field, round(avg({f}), 6) AS mean, round(coalesce(stddev_samp({f}), 0), 6) AS std FROM met" for f in METRICS))
def fewshot_summary(spark, sf):
    return E.summarize(fewshot_metrics(spark, sf), METRICS).withColumns({c: F.round(c, 6) for c in ("mean", "std")})


_DAY_SQL = """
day AS (SELECT event_type AS run, (date_diff('day', DATE '2024-01-01', ts::DATE) + 1)::BIGINT AS epoch, round(avg(value), 3) AS score,
        count(*) AS n, round(max(value), 1) AS peak, sum(value) AS work, sum(('0' || regexp_extract(props, '(\\d+)', 1))::BIGINT) AS audio FROM events GROUP BY ALL)
"""


def daily(spark, sf):
    e = read_table(spark, sf, "events")
    epoch = (F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + 1).cast("bigint")
    return e.groupBy(F.col("event_type").alias("run"), epoch.alias("epoch")).agg(
        F.round(F.avg("value"), 3).alias("score"), F.count(F.lit(1)).alias("n"), F.round(F.max("value"), 1).alias("peak"),
        F.sum("value").alias("work"), F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("audio"),
    )


@query("best_epoch", f"WITH {_DAY_SQL} SELECT run, arg_max(epoch, (score, peak, -epoch)) AS epoch, arg_max(score, (score, peak, -epoch)) AS score, arg_max(peak, (score, peak, -epoch)) AS peak FROM day GROUP BY run")
def best_epoch(spark, sf):
    return E.best_epoch(daily(spark, sf), ["run"], ["score", "peak"], "epoch")


@query("early_stop", f"""WITH {_DAY_SQL},
b AS (SELECT *, max(score) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM day),
h AS (SELECT *, max(CASE WHEN prev IS NULL OR score > prev THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS last FROM b)
SELECT run, min(epoch) FILTER (WHERE epoch - last >= 5) AS stop_epoch, arg_max(epoch, (score, -epoch)) AS best_epoch, max(score) AS best_score FROM h GROUP BY run
""")
def early_stop(spark, sf):
    return E.early_stop(daily(spark, sf), "run", "epoch", "score", 5)


@query("episode_summary", f"""WITH {_DAY_SQL}
SELECT run, round(avg(score), 6) AS mean, round(coalesce(stddev_samp(score), 0), 6) AS std, round(sum(score * n) / sum(n), 6) AS weighted_mean,
       round(sum(work) / sum(audio), 6) AS real_time_factor FROM day GROUP BY run
""")
def episode_summary(spark, sf):
    return daily(spark, sf).groupBy("run").agg(
        F.round(F.avg("score"), 6).alias("mean"),
        F.round(F.coalesce(F.stddev_samp("score"), F.lit(0.0)), 6).alias("std"),
        F.round(E.weighted_mean(F.col("score"), F.col("n")), 6).alias("weighted_mean"),
        F.round(F.sum("work") / F.sum("audio"), 6).alias("real_time_factor"),
    )


@query("window_score_agg", """
WITH s AS (SELECT user_id, event_type AS class, value / 10 AS s FROM events),
m AS (SELECT *, max(s) OVER (PARTITION BY user_id, class) AS mx FROM s)
SELECT user_id, class, round(max(s), 6) AS max_logit, round(ln(sum(exp(s - mx))) + max(mx), 6) AS logsumexp, round(avg(s), 6) AS mean_logit FROM m GROUP BY user_id, class
""")
def window_score_agg(spark, sf):
    scores = read_table(spark, sf, "events").select("user_id", F.col("event_type").alias("class"), (F.col("value") / 10).alias("s"))
    out = E.aggregate_windows(scores, ["user_id", "class"], "s")
    return out.withColumns({c: F.round(c, 6) for c in ("max_logit", "logsumexp", "mean_logit")})


@query("masked_mean", """
WITH l AS (SELECT vec_id, embedding::DOUBLE[] AS z, 20 + (vec_id * 7) % 100 AS n FROM embeddings),
a AS (SELECT *, greatest(1, floor((floor((n + 2*5 - 9 - 1) / 2.0) + 1 + 2*1 - 2 - 1) / 1.0) + 1)::INTEGER AS len FROM l)
SELECT vec_id, len AS n_frames, round(list_sum(z[1:len]) / least(len, 64), 6) AS pooled FROM a
""")
def masked_mean(spark, sf):
    n = arrays.conv_length(F.lit(20) + F.pmod(F.col("vec_id") * 7, F.lit(100)), [(10, 2, 5, 1), (3, 1, 1, 1)])
    rows = V.embeddings(spark, sf).select("vec_id", "z", n.alias("n_frames"))
    valid = F.slice("z", F.lit(1), F.col("n_frames"))
    return rows.select("vec_id", "n_frames", F.round(vectors.total(valid) / F.size(valid), 6).alias("pooled"))
