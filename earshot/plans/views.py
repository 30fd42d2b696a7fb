"""Views of the test tables shaped like corpus records, embeddings and streams.

Each Spark view has a SQL text with the same meaning for the check queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot import presets
from earshot.operators.records import unknown_source
from earshot.operators.scans import top_hashed
from earshot.session import read_table

SEED = presets.SEED
SHOTS = 10
DIM = 64
N_KNOWN = 8  # labels 0..7 are keywords, 8 and 9 the rejection classes
REJECT = [8, 9]


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("z")
    )


def support(spark, sf_dir) -> DataFrame:
    """Ten hashed rows per class."""
    return top_hashed(embeddings(spark, sf_dir), ["label"], ["vec_id"], SEED, SHOTS)


def queries(spark, sf_dir) -> DataFrame:
    """Every row outside the support set."""
    picked = top_hashed(embeddings(spark, sf_dir).select("vec_id", "label"), ["label"], ["vec_id"], SEED, SHOTS)
    return embeddings(spark, sf_dir).join(picked.select("vec_id"), "vec_id", "left_anti")


EMB_SQL = f"""
emb AS (SELECT vec_id, label, embedding::DOUBLE[] AS z,
               row_number() OVER (PARTITION BY label ORDER BY md5('{SEED}:' || vec_id), vec_id) AS rn
        FROM embeddings),
sup AS (SELECT vec_id, label, z FROM emb WHERE rn <= {SHOTS}),
qry AS (SELECT vec_id, label, z FROM emb WHERE rn > {SHOTS})
"""

# Class means of the support set, not normalised, as lists.
PROTO_SQL = EMB_SQL + """,
long_sup AS (SELECT label, unnest(z) AS v, generate_subscripts(z, 1) AS i FROM sup),
dim_mean AS (SELECT label, i, avg(v) AS v FROM long_sup GROUP BY label, i),
proto AS (SELECT label AS class, list(v ORDER BY i) AS p FROM dim_mean GROUP BY label)
"""

# Softmax of the negative squared distance to every class mean, long form.
PROBA_SQL = PROTO_SQL + f""",
dist AS (SELECT vec_id, label, class, -list_sum(list_transform(list_zip(z, p), lambda t: (t[1]-t[2])*(t[1]-t[2]))) AS s
         FROM qry, proto),
ex AS (SELECT *, exp(s - max(s) OVER (PARTITION BY vec_id)) AS e FROM dist),
prob AS (SELECT vec_id, label, class, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM ex),
scored AS (SELECT vec_id, any_value(label) AS label,
                  arg_max(class, (p, -class)) AS pred0, max(p) AS conf,
                  max(p) FILTER (WHERE class < {N_KNOWN}) AS close_max,
                  sum(p) FILTER (WHERE class >= {N_KNOWN}) AS ood
           FROM prob GROUP BY vec_id),
pred AS (SELECT vec_id, label, label < {N_KNOWN} AS pos,
                CASE WHEN label < {N_KNOWN} THEN label ELSE -1 END AS true_cls,
                CASE WHEN pred0 < {N_KNOWN} THEN pred0 ELSE -1 END AS pred_cls,
                conf, close_max, ood
         FROM scored)
"""


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as corpus records: 'error' rows are the unknown class."""
    e = read_table(spark, sf_dir, "events")
    unknown = F.col("event_type") == "error"
    kind = F.pmod("user_id", F.lit(6))
    speaker = (
        F.when(~unknown, F.concat(F.lit("S"), "user_id"))
        .when(kind == 0, F.concat(F.lit("hard_negative_"), "user_id"))
        .when(kind == 1, "gsc_unknown")
        .when(kind == 2, F.concat(F.lit("librispeech_"), "user_id"))
        .when(kind == 3, F.concat(F.lit("gsc_noise_"), "user_id"))
        .when(kind == 4, "background")
        .otherwise(F.concat(F.lit("S"), "user_id"))
    )
    is_silence = unknown & (F.pmod("user_id", F.lit(7)) == 0)
    df = e.select(
        "event_id",
        F.when(unknown, presets.UNKNOWN_LABEL).otherwise(F.col("event_type")).alias("label"),
        speaker.alias("speaker"),
        is_silence.alias("is_silence"),
        F.when(unknown & (F.col("value") > 120), "hard_negative").alias("unknown_source"),
        F.when(is_silence, F.col("value") / 50).alias("silence_duration_seconds"),
        F.when(unknown & kind.isin(2, 3, 4), F.col("value") / 40).alias("bg_duration_seconds"),
        (F.col("value") * 400).cast("int").alias("file_samples"),
        F.when(F.pmod("event_id", F.lit(3)) > 0, F.concat(F.lit("cat"), F.pmod("event_id", F.lit(3)))).alias("hardneg_category"),
    )
    source = F.when(
        F.col("label") == presets.UNKNOWN_LABEL,
        unknown_source(F.col("is_silence"), F.col("unknown_source"), F.col("speaker")),
    )
    return df.withColumn("source", source)


RECORD_SQL = """
rec0 AS (SELECT event_id, event_type = 'error' AS unk, user_id, value,
    CASE WHEN event_type = 'error' THEN '_unknown_' ELSE event_type END AS label,
    CASE WHEN event_type <> 'error' THEN 'S' || user_id
         WHEN user_id % 6 = 0 THEN 'hard_negative_' || user_id
         WHEN user_id % 6 = 1 THEN 'gsc_unknown'
         WHEN user_id % 6 = 2 THEN 'librispeech_' || user_id
         WHEN user_id % 6 = 3 THEN 'gsc_noise_' || user_id
         WHEN user_id % 6 = 4 THEN 'background'
         ELSE 'S' || user_id END AS speaker,
    event_type = 'error' AND user_id % 7 = 0 AS is_silence,
    CASE WHEN event_type = 'error' AND value > 120 THEN 'hard_negative' END AS unknown_source,
    CASE WHEN event_type = 'error' AND user_id % 7 = 0 THEN value / 50 END AS silence_duration_seconds,
    CASE WHEN event_type = 'error' AND user_id % 6 IN (2,3,4) THEN value / 40 END AS bg_duration_seconds,
    trunc(value * 400)::INTEGER AS file_samples,
    CASE WHEN event_id % 3 > 0 THEN 'cat' || (event_id % 3) END AS hardneg_category
  FROM events),
rec AS (SELECT *, CASE WHEN label <> '_unknown_' THEN NULL
    WHEN is_silence THEN 'silence'
    WHEN unknown_source IS NOT NULL THEN unknown_source
    WHEN starts_with(speaker, 'hard_negative_') THEN 'hard_negative'
    WHEN speaker = 'gsc_unknown' THEN 'gsc_words'
    WHEN starts_with(speaker, 'librispeech_') THEN 'librispeech'
    WHEN starts_with(speaker, 'gsc_noise_') THEN 'gsc_noise'
    WHEN speaker = 'background' THEN 'company_background'
    ELSE 'unknown_other' END AS source FROM rec0)
"""


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a frame stream per device, ordered by (ts, event_id)."""
    return read_table(spark, sf_dir, "events").select(
        "user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value"
    )


FRAME_SQL = """
fr AS (SELECT user_id, event_id, ts, event_type, value,
              row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
              count(*) OVER (PARTITION BY user_id) AS n
       FROM events)
"""


def draw_sql(drawn: str, label: str, k: int) -> str:
    """CTE ``taken`` (episode, label, no, sample_no): ``k`` numbers of 1..n for every row of ``drawn`` (episode, label, n)."""
    return f"""steps AS (SELECT episode, {label}, list_transform(range(greatest(1, n - {k} + 1), n + 1), lambda j:
    [j, 1 + floor(('0x' || right(md5('{SEED}:' || episode || ':' || {label} || ':' || j), 8))::BIGINT / 4294967296.0::DOUBLE * j)::BIGINT]) AS s FROM {drawn}),
nos AS (SELECT episode, {label}, list_reduce(s, lambda a, x: list_append(a, CASE WHEN list_contains(a, x[2]) THEN x[1] ELSE x[2] END), []::BIGINT[]) AS l FROM steps),
taken AS (SELECT episode, {label}, unnest(l) AS no, generate_subscripts(l, 1) AS sample_no FROM nos)"""
