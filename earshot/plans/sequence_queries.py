"""Pair, metric-loss, signal, window and detector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from earshot import presets
from earshot.functions import arrays
from earshot.operators import pairs as PR
from earshot.operators import prototypes as P
from earshot.operators import scans
from earshot.operators import sequences as Q
from earshot.operators.detect import SegmentMachine, TriggerMachine, replay
from earshot.plans import views as V
from earshot.plans.registry import query
from earshot.plans.scoring_queries import N_CLASSES, scored_queries, support_means

SEED, DIM = presets.SEED, V.DIM
N_WAY, K_ROWS, MARGIN = 10, 4, 0.5

_BATCH_SQL = f"""
bt AS (SELECT vec_id, label, embedding::DOUBLE[] AS z, (label // {N_WAY}) || ':' || ((row_number() OVER (PARTITION BY label ORDER BY md5('{SEED}:' || vec_id), vec_id) - 1) // {K_ROWS}) AS batch FROM embeddings),
pr AS (SELECT a.batch, a.vec_id AS a, b.vec_id AS b, a.label = b.label AS positive, a.label AS la, b.label AS lb,
        list_sum(list_transform(list_zip(a.z, b.z), lambda t: (t[1]-t[2])*(t[1]-t[2]))) AS d FROM bt a JOIN bt b ON a.batch = b.batch AND a.vec_id < b.vec_id),
np AS (SELECT batch, count(*) AS n FROM pr WHERE positive GROUP BY batch)
"""
_TRIPLET_SQL = _BATCH_SQL + """,
dd AS (SELECT batch, a AS x, b AS y, lb AS ly, d FROM pr UNION ALL SELECT batch, b, a, la, d FROM pr),
tr AS (SELECT p.batch, p.a AS anchor, p.b AS positive, n.y AS negative, p.la, p.d AS d_pos, n.d AS d_neg, p.d - n.d + """ + str(MARGIN) + """ AS loss
       FROM pr p JOIN dd n ON n.batch = p.batch AND n.x = p.a AND n.ly <> p.la WHERE p.positive),
fb AS (SELECT batch, arg_max({'a': anchor, 'p': positive, 'n': negative, 'dp': d_pos, 'dn': d_neg}, (la, anchor, positive, -negative)) AS f FROM tr GROUP BY batch)
"""


def batches(spark, sf):
    return PR.assign_batches(V.embeddings(spark, sf), "label", "vec_id", SEED, N_WAY, K_ROWS)


def _pairs(spark, sf, negatives):
    out = PR.pairs(batches(spark, sf), "label", "vec_id", "z", negatives, SEED)
    return out.withColumn("distance", F.round("distance", 6))


_NEG = "SELECT batch, a, b, positive, d FROM (SELECT pr.*, row_number() OVER (PARTITION BY pr.batch ORDER BY {}) AS rn, n FROM pr JOIN np USING (batch) WHERE NOT positive) WHERE rn <= n"
_PAIR_OUT = "SELECT batch, a, b, positive, round(d, 6) AS distance FROM (SELECT batch, a, b, positive, d FROM pr WHERE positive UNION ALL {})"


@query("pairs_all", f"WITH {_BATCH_SQL} " + _PAIR_OUT.format(_NEG.format(f"((abs(a) % {PR.MODULUS}) * {PR.FACTORS[0]} + (abs(b) % {PR.MODULUS}) * {PR.FACTORS[1]} + {SEED}) % {PR.MODULUS} * {PR.SPREAD} % {PR.MODULUS}, a, b")))
def pairs_all(spark, sf):
    return _pairs(spark, sf, "random")


@query("pairs_hard", f"WITH {_BATCH_SQL} " + _PAIR_OUT.format(_NEG.format("round(d, 9), a, b")))
def pairs_hard(spark, sf):
    return _pairs(spark, sf, "hard")


def mined(spark, sf, strategy):
    return PR.triplets(batches(spark, sf), "label", "vec_id", "z", strategy, MARGIN, SEED)


def _triplets(spark, sf, strategy):
    return mined(spark, sf, strategy).withColumns({c: F.round(c, 6) for c in ("d_pos", "d_neg")})


_T = "batch, anchor, positive, negative, round(d_pos, 6) AS d_pos, round(d_neg, 6) AS d_neg"
_PICK = "WITH " + _TRIPLET_SQL.replace("{", "{{").replace("}", "}}") + """,
sel AS (SELECT * FROM tr WHERE {where} QUALIFY row_number() OVER (PARTITION BY batch, anchor, positive ORDER BY {order}) = 1),
res AS (SELECT batch, anchor, positive, negative, d_pos, d_neg FROM sel UNION ALL SELECT batch, f.a, f.p, f.n, f.dp, f.dn FROM fb WHERE batch NOT IN (SELECT batch FROM sel))
"""
_FACTORS = dict(zip(("anchor", "positive", "negative"), PR.FACTORS))
_DRAW = f"(({' + '.join(f'(abs({c}) % {PR.MODULUS}) * {f}' for c, f in _FACTORS.items())} + {SEED}) % {PR.MODULUS} * {PR.SPREAD} % {PR.MODULUS}), negative"


@query("triplets_all", f"WITH {_TRIPLET_SQL} SELECT {_T} FROM tr")
def triplets_all(spark, sf):
    return _triplets(spark, sf, "all")


@query("triplets_hardest", _PICK.format(where="loss > 0", order="loss DESC, negative") + f"SELECT {_T} FROM res")
def triplets_hardest(spark, sf):
    return _triplets(spark, sf, "hardest")


@query("triplets_semihard", _PICK.format(where=f"loss > 0 AND loss < {MARGIN}", order=_DRAW) + f"SELECT {_T} FROM res")
def triplets_semihard(spark, sf):
    return _triplets(spark, sf, "semihard")


@query("triplet_hinge", _PICK.format(where="loss > 0", order=_DRAW) + f"SELECT round(avg(greatest(0, d_pos - d_neg + {MARGIN})), 6) AS loss, count(*) AS n_triplets FROM res")
def triplet_hinge(spark, sf):
    return PR.triplet_hinge(mined(spark, sf, "random"), MARGIN).withColumn("loss", F.round("loss", 6))


_NLL_TAIL = """,
mx AS (SELECT *, max(s) OVER (PARTITION BY vec_id) AS m FROM ms),
lp AS (SELECT vec_id, any_value(m) + ln(sum(exp(s - m))) - max(s) FILTER (WHERE class = label) AS nll, arg_max(class, (s, -class)) = any_value(label) AS ok FROM mx GROUP BY vec_id)
SELECT round(avg(nll), 6) AS loss, round(avg(CASE WHEN ok THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy, count(*) AS n FROM lp
"""
_COS = "list_inner_product(z, p) / greatest(sqrt(list_inner_product(z, z)) * sqrt(list_inner_product(p, p)), 1e-8)"


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in df.columns if c in ("loss", "accuracy")})


@query("proto_nll", f"WITH {V.PROBA_SQL}, ms AS (SELECT vec_id, label, class, s FROM dist)" + _NLL_TAIL)
def proto_nll(spark, sf):
    return _rounded(PR.nll(scored_queries(spark, sf, "euclidean"), "label"))


@query("angular_nll", f"WITH {V.PROTO_SQL}, ms AS (SELECT vec_id, label, class, 10 * ({_COS} - CASE WHEN class = label THEN 0.2 ELSE 0 END) - 5 AS s FROM qry, proto)" + _NLL_TAIL)
def angular_nll(spark, sf):
    return _rounded(PR.nll(scored_queries(spark, sf, "cosine"), "label", margin=0.2, scale=10.0, shift=-5.0))


@query("am_softmax_eval", f"WITH {V.PROTO_SQL}, ms AS (SELECT vec_id, label, class, 64 * (list_inner_product(z, p) / greatest(sqrt(list_inner_product(p, p)), 1e-12) - CASE WHEN class = label THEN 0.05 ELSE 0 END) AS s FROM qry, proto)" + _NLL_TAIL)
def am_softmax_eval(spark, sf):
    from earshot.functions.vectors import l2_normalize

    weights = support_means(spark, sf).withColumn("proto", l2_normalize(F.col("proto")))
    scored = P.with_scores(V.queries(spark, sf), weights, "class", "z", DIM, N_CLASSES, ["vec_id", "label"], "dot")
    return _rounded(PR.nll(scored, "label", margin=0.05, scale=64.0))


@query("open_entropy", f"""WITH {V.PROBA_SQL}, ms AS (SELECT vec_id, class, -sqrt(-s) AS s FROM dist WHERE class < {V.N_KNOWN} AND label >= {V.N_KNOWN}),
mx AS (SELECT *, max(s) OVER (PARTITION BY vec_id) AS m FROM ms), z AS (SELECT *, m + ln(sum(exp(s - m)) OVER (PARTITION BY vec_id)) AS z FROM mx),
e AS (SELECT vec_id, sum(exp(s - z) * (s - z)) AS e FROM z GROUP BY vec_id) SELECT round(avg(e), 6) AS loss, count(*) AS n FROM e
""")
def open_entropy(spark, sf):
    unknown = V.queries(spark, sf).filter(F.col("label") >= V.N_KNOWN)
    known = support_means(spark, sf).filter(F.col("class") < V.N_KNOWN)
    scored = P.with_scores(unknown, known, "class", "z", DIM, N_CLASSES, ["vec_id"], "euclidean")
    roots = F.transform("scores", lambda x: F.struct(x["cls"].alias("cls"), (-F.sqrt(-x["s"])).alias("s")))
    return _rounded(PR.open_entropy(scored.withColumn("scores", roots)))


# --- array functions on short signals -------------------------------------------------


def _long(df, value):
    return df.select("vec_id", F.posexplode(value).alias("i", "v")).select("vec_id", "i", (F.round("v", 6) + F.lit(0.0)).alias("value"))


def _long_sql(expr, source="embeddings"):
    return f"SELECT vec_id, generate_subscripts(a, 1)::INTEGER - 1 AS i, round(unnest(a), 6) + 0.0 AS value FROM (SELECT vec_id, {expr} AS a FROM {source})"


@query("gain_clamp", _long_sql("list_transform(embedding::DOUBLE[], lambda x: greatest(-1, least(1, x * pow(10, (vec_id % 37) / 20.0::DOUBLE))))"))
def gain_clamp(spark, sf):
    return _long(V.embeddings(spark, sf), arrays.apply_gain(F.col("z"), F.pmod("vec_id", F.lit(37)).cast("double")))


def _snr_sql(ratio: str) -> str:
    return (
        "WITH n AS (SELECT label, embedding::DOUBLE[] AS z FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1),"
        "s AS (SELECT vec_id, e.embedding::DOUBLE[] AS z, n.z AS nz, sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])"
        f" / ({ratio} * list_inner_product(n.z, n.z))) AS k FROM embeddings e JOIN n ON n.label = e.label)"
    ) + _long_sql("list_transform(list_zip(z, nz), lambda t: greatest(-1, least(1, t[1] + t[2] * k)))", "s")


def _snr_mix(spark, sf, decibel):
    rows = V.embeddings(spark, sf)
    # One noise vector per class; min_by keeps it a map-side aggregate.
    noise = rows.groupBy("label").agg(F.min_by("z", "vec_id").alias("noise"))
    scale = arrays.snr_scale(F.col("z"), F.col("noise"), F.pmod("vec_id", F.lit(20)).cast("double"), decibel)
    return _long(rows.join(noise, "label"), arrays.mix(F.col("z"), F.col("noise"), scale))


@query("snr_mix", _snr_sql("(pow(10, (vec_id % 20)::DOUBLE) / 10)"))
def snr_mix(spark, sf):
    return _snr_mix(spark, sf, decibel=False)


@query("snr_mix_decibel", _snr_sql("pow(10, (vec_id % 20) / 10.0::DOUBLE)"))
def snr_mix_decibel(spark, sf):
    return _snr_mix(spark, sf, decibel=True)


@query("shift_pad", _long_sql("CASE WHEN sh > 0 THEN list_concat(list_resize([]::DOUBLE[], sh, 0), list_slice(z, 1, 64 - sh)) ELSE list_concat(list_slice(z, 1 - sh, 64), list_resize([]::DOUBLE[], -sh, 0)) END",
                              "(SELECT vec_id, embedding::DOUBLE[] AS z, (vec_id % 41 - 20) AS sh FROM embeddings)"))
def shift_pad(spark, sf):
    shift = (F.pmod("vec_id", F.lit(41)) - 20).cast("int")
    return _long(V.embeddings(spark, sf), arrays.shift_and_pad(F.col("z"), shift, DIM))


_CROP = "CASE WHEN len(z) > {n} THEN list_slice(z, (len(z) - {n}) // 2 + 1, (len(z) - {n}) // 2 + {n}) ELSE list_concat(z, list_resize([]::DOUBLE[], {n} - len(z), 0)) END"


@query("center_crop", _long_sql("CASE WHEN vec_id % 2 = 0 THEN " + _CROP.format(n=24) + " ELSE " + _CROP.format(n=80) + " END",
                                "(SELECT vec_id, embedding::DOUBLE[] AS z FROM embeddings)"))
def center_crop(spark, sf):
    cropped = F.when(F.pmod("vec_id", F.lit(2)) == 0, arrays.center_crop(F.col("z"), 24)).otherwise(arrays.center_crop(F.col("z"), 80))
    return _long(V.embeddings(spark, sf), cropped)


@query("time_slice", _long_sql("list_slice(z, round_even(s * 16, 0)::INTEGER + 1, least(64, round_even(e * 16, 0)::INTEGER))",
                               "(SELECT vec_id, embedding::DOUBLE[] AS z, (vec_id % 40) / 10.0::DOUBLE AS s, (vec_id % 40) / 10.0::DOUBLE + (vec_id % 13) / 10.0::DOUBLE AS e FROM embeddings)"))
def time_slice(spark, sf):
    start = F.pmod("vec_id", F.lit(40)) / 10.0
    cut = arrays.time_slice(F.col("z"), start, start + F.pmod("vec_id", F.lit(13)) / 10.0, 16)
    return _long(V.embeddings(spark, sf).withColumn("cut", cut).filter("cut IS NOT NULL"), F.col("cut"))


# --- series --------------------------------------------------------------------------


def frames(spark, sf, **scan):
    return scans.series_rank(V.event_frames(spark, sf), ["user_id"], "ts", "event_id", "seq", **scan)


@query("rolling_window", f"""WITH {V.FRAME_SQL}
SELECT user_id, event_id, round(sum(value) OVER w, 6) AS total, max(value) OVER w AS peak FROM fr
WINDOW w AS (PARTITION BY user_id ORDER BY seq ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) QUALIFY seq >= 8 AND (seq - 8) % 2 = 0
""")
def rolling_window(spark, sf):
    out = Q.rolling_window(
        frames(spark, sf).select("user_id", "event_id", "seq", "value"), ["user_id"], "seq", 8, 2,
        {"total": F.sum("value"), "peak": F.max("value")},
    )
    return out.select("user_id", "event_id", F.round("total", 6).alias("total"), "peak")


@query("ema", f"""WITH {V.FRAME_SQL}, l AS (SELECT user_id, list(sqrt(value) ORDER BY seq) AS v FROM fr GROUP BY user_id)
SELECT user_id, event_id, round(list_reduce(list_slice(v, 1, seq), lambda s, x: 0.3::DOUBLE * x + 0.7::DOUBLE * s), 6) AS smooth FROM fr JOIN l USING (user_id)
""")
def ema(spark, sf):
    loud = frames(spark, sf).select("user_id", "event_id", "seq", F.sqrt("value").alias("level"))
    out = Q.ema(loud, ["user_id"], "seq", {"smooth": "level"}, 0.3)
    return out.select("user_id", "event_id", F.round("smooth", 6).alias("smooth"))


@query("streaks", f"""WITH {V.FRAME_SQL},
a AS (SELECT *, value > 30 AS up, coalesce(lag(value > 30) OVER w, false) AS pup, lag(event_type) OVER w AS pl FROM fr WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
b AS (SELECT *, max(CASE WHEN up AND (NOT pup OR pl <> event_type) THEN seq END) OVER (PARTITION BY user_id ORDER BY seq) AS since FROM a)
SELECT user_id, event_id, CASE WHEN up THEN seq - since + 1 ELSE 0 END AS streak FROM b
""")
def streaks(spark, sf):
    df = frames(spark, sf, preceding={"prev_label": "event_type", "prev_value": "value"})
    out = Q.streaks(df, ["user_id"], "seq", F.col("value") > 30, "event_type", F.col("prev_value") > 30, "prev_label")
    return out.select("user_id", "event_id", "streak")


@query("energy_crop", f"""WITH {V.FRAME_SQL},
e AS (SELECT user_id, seq, n, sum(value * value) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS e FROM fr)
SELECT user_id, coalesce(arg_max(seq - 10, (round(e, 4), -seq)) FILTER (WHERE seq >= 10), 0) AS start, round(max(e) FILTER (WHERE seq >= 10), 4) AS energy FROM e GROUP BY user_id
""")
def energy_crop(spark, sf):
    out = Q.energy_crop(frames(spark, sf).select("user_id", "seq", "value"), ["user_id"], "seq", "value", 10)
    return out.withColumn("energy", F.round("energy", 4))


WAKE = ["click", "purchase", "signup", "view"]
TRIGGER = TriggerMachine(threshold=0.45, trigger_frames=2, cooldown_frames=3)
ALPHA = 0.6
_SHARE = "CASE WHEN event_type = '{c}' THEN value / (value + 30) ELSE (1 - value / (value + 30)) / 4 END"
_SMOOTH_SQL = V.FRAME_SQL + ", sh AS (SELECT *, " + ", ".join(f"{_SHARE.format(c=c)} AS p_{c}" for c in WAKE) + " FROM fr),\nls AS (SELECT user_id, " + ", ".join(
    f"list(p_{c} ORDER BY seq) AS l_{c}" for c in WAKE) + " FROM sh GROUP BY user_id),\nsm AS (SELECT user_id, seq, event_id, " + ", ".join(
    f"round(list_reduce(list_slice(l_{c}, 1, seq), lambda s, x: 0.6::DOUBLE * x + (1 - 0.6::DOUBLE) * s), 9) AS s_{c}" for c in WAKE) + """ FROM fr JOIN ls USING (user_id)),
bt AS (SELECT user_id, seq, event_id, greatest(""" + ", ".join(f"s_{c}" for c in WAKE) + ") AS score, CASE " + " ".join(
    f"WHEN s_{c} = greatest({', '.join('s_' + x for x in WAKE)}) THEN '{c}'" for c in WAKE) + " END AS label FROM sm)"


def smoothed(spark, sf):
    """Best accepted label and its smoothed probability for every frame."""
    share = F.col("value") / (F.col("value") + 30)
    probs = frames(spark, sf).select("user_id", "event_id", "seq", *[
        F.when(F.col("event_type") == c, share).otherwise((1 - share) / 4).alias(f"p_{c}") for c in WAKE
    ])
    s = Q.ema(probs, ["user_id"], "seq", {f"s_{c}": f"p_{c}" for c in WAKE}, ALPHA)
    best = F.array_max(F.array(*[
        F.struct(F.round(f"s_{c}", 9).alias("score"), F.lit(-i).alias("i"), F.lit(c).alias("label")) for i, c in enumerate(WAKE)
    ]))
    return s.select("user_id", "event_id", "seq", best.alias("b")).select("user_id", "event_id", "seq", "b.label", "b.score")


@query("detect_triggers", f"""WITH RECURSIVE {_SMOOTH_SQL},
m AS (SELECT user_id, 0::BIGINT AS seq, 0 AS cd, NULL::VARCHAR AS lab, 0 AS k, false AS fired, NULL::VARCHAR AS label, 0.0::DOUBLE AS score FROM (SELECT DISTINCT user_id FROM fr)
  UNION ALL SELECT q.user_id, q.seq, CASE WHEN q.pcd > 0 THEN q.pcd - 1 WHEN q.k2 >= 2 THEN 3 ELSE 0 END,
     CASE WHEN q.pcd > 0 OR q.k2 = 0 OR q.k2 >= 2 THEN NULL ELSE q.label END, CASE WHEN q.pcd > 0 OR q.k2 >= 2 THEN 0 ELSE q.k2 END,
     q.pcd = 0 AND q.k2 >= 2, q.label, q.score
  FROM (SELECT b.user_id, b.seq, b.label, b.score, m.cd AS pcd, CASE WHEN m.cd > 0 OR b.score < 0.45 THEN 0 WHEN m.lab = b.label THEN m.k + 1 ELSE 1 END AS k2
        FROM m JOIN bt b ON b.user_id = m.user_id AND b.seq = m.seq + 1) q)
SELECT user_id, seq, label, round(score, 6) AS score FROM m WHERE fired
""")
def detect_triggers(spark, sf):
    out = replay(smoothed(spark, sf), ["user_id"], "seq", TRIGGER, ["label", "score"], {"label": "string", "score": "double"})
    return out.withColumn("score", F.round("score", 6))


SEGMENT = SegmentMachine(threshold=60.0, onset=2, hangover=2, shortest=2, longest=12, pre=3, cooldown=4)
SEGMENT_FIELDS = {"first_frame": "bigint", "last_frame": "bigint", "speech_frames": "bigint", "score": "double", "fired": "boolean"}


@query("segments_exact", f"""WITH RECURSIVE {V.FRAME_SQL},
f AS (SELECT user_id, seq, value, value > 50 AS act, least(seq, 3) AS rn, list(value) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rs FROM fr),
m AS (SELECT user_id, 0::BIGINT AS seq, 0 AS cd, 0 AS run, 0 AS spk, 0 AS sil, 0::BIGINT AS len, []::DOUBLE[] AS vals, 0 AS ev, 0::BIGINT AS elen, 0::BIGINT AS sp, 0.0::DOUBLE AS score FROM (SELECT DISTINCT user_id FROM fr)
  UNION ALL
  SELECT user_id, seq,
    CASE WHEN pcd > 0 THEN pcd - 1 WHEN ev = 1 AND nscore >= 60 THEN 4 ELSE 0 END,
    CASE WHEN pcd > 0 THEN prun WHEN pspk = 0 AND nrun < 2 THEN nrun ELSE 0 END,
    CASE WHEN pcd > 0 THEN pspk WHEN pspk = 0 THEN (nrun >= 2)::INTEGER WHEN done THEN 0 ELSE 1 END,
    CASE WHEN pcd > 0 THEN psil WHEN pspk = 0 OR done THEN 0 ELSE nsil END,
    CASE WHEN pcd > 0 THEN plen WHEN pspk = 0 AND nrun >= 2 THEN rn WHEN pspk = 0 OR done THEN 0 ELSE nlen END,
    CASE WHEN pcd > 0 THEN pvals WHEN pspk = 0 AND nrun >= 2 THEN rs WHEN pspk = 0 OR done THEN []::DOUBLE[] ELSE nvals END,
    ev, nlen, speech, coalesce(nscore, 0)
  FROM (SELECT *, done::INTEGER AS ev, list_avg(list_slice(nvals, 1, speech)) AS nscore FROM (
    SELECT *, pcd = 0 AND pspk = 1 AND (nlen >= 12 OR nsil >= 2) AS done, greatest(2, CASE WHEN nlen >= 12 THEN nlen ELSE nlen - 2 END) AS speech FROM (
      SELECT f.user_id, f.seq, f.rn, f.rs, m.cd AS pcd, m.run AS prun, m.spk AS pspk, m.sil AS psil, m.len AS plen, m.vals AS pvals,
        CASE WHEN act THEN m.run + 1 ELSE 0 END AS nrun, CASE WHEN act THEN 0 ELSE m.sil + 1 END AS nsil, m.len + 1 AS nlen, list_append(m.vals, f.value) AS nvals
      FROM m JOIN f ON f.user_id = m.user_id AND f.seq = m.seq + 1))))
SELECT user_id, seq - elen + 1 AS first_frame, seq AS last_frame, sp AS speech_frames, round(score, 6) AS score, score >= 60 AS fired FROM m WHERE ev = 1
""")
def segments_exact(spark, sf):
    df = frames(spark, sf).select("user_id", "seq", "value", (F.col("value") > 50).alias("active"), F.col("seq").alias("at"))
    out = replay(df, ["user_id"], "seq", SEGMENT, ["at", "value", "active"], SEGMENT_FIELDS)
    return out.drop("seq").withColumn("score", F.round("score", 6))


GAP_SECONDS = 20 * 3600


@query("segments_session", f"""
WITH a AS (SELECT user_id, event_id, ts, value, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events WHERE value > 50),
s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= {GAP_SECONDS} * 1000000::BIGINT THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM a)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + {GAP_SECONDS} * 1000000::BIGINT AS end_us, count(*) AS n_frames, round(avg(value), 6) AS mean_value FROM s GROUP BY user_id, sid
""")
def segments_session(spark, sf):
    active = V.event_frames(spark, sf).filter("value > 50")
    linked = scans.series_rank(active, ["user_id"], "ts", "event_id", "seq", preceding={"prev_ts": "ts"})
    gap = F.unix_micros("ts") - F.unix_micros("prev_ts")
    begins = F.when(gap.isNull() | (gap >= GAP_SECONDS * 1_000_000), 1).otherwise(0)
    marked = scans.with_blocks(linked.withColumn("_begins", begins), "seq")
    numbered = scans.bucketed_scan(marked, ["user_id"], "block", ["seq"], sums={"session": F.col("_begins")})
    return numbered.groupBy("user_id", "session").agg(
        F.unix_micros(F.min("ts")).alias("start_us"), (F.unix_micros(F.max("ts")) + GAP_SECONDS * 1_000_000).alias("end_us"),
        F.count(F.lit(1)).alias("n_frames"), F.round(F.avg("value"), 6).alias("mean_value"),
    ).drop("session")
