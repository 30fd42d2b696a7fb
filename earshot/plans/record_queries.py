"""Record, filter, join, split and sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from earshot import presets
from earshot.functions import text as T
from earshot.functions import arrays, hashing, text
from earshot.operators import records as R
from earshot.operators import splits as S
from earshot.plans import views as V
from earshot.plans.registry import query
from earshot.session import read_table, spread

SEED = presets.SEED


@query("path_records", """
SELECT page_id, lower(string_split(url,'/')[-2]) AS label, url AS file,
       string_split(string_split(url,'/')[-1],'_')[1] AS speaker
FROM pages WHERE lower(string_split(url,'/')[-2]) <> '_background_noise_'
""")
def path_records(spark, sf):
    return R.path_records(read_table(spark, sf, "pages").select("page_id", "url"), "url").drop("url")


@query("filename_grammar", """
WITH f AS (SELECT page_id, regexp_extract(url,'^(https?)://',1) || '_' ||
   regexp_replace(regexp_extract(url,'^https?://[^/]+/(.*)$',1),'[^A-Za-z0-9]+','_','g') AS name FROM pages),
p AS (SELECT page_id, name, string_split(name,'_') AS a FROM f)
SELECT page_id, a[1] AS speaker, a[2] AS block, a[3] AS word_id, a[4] AS channel,
       split_part(replace(name,'_','-'),'-',1) AS utt_speaker, split_part(replace(name,'_','-'),'-',2) AS utt_chapter
FROM p WHERE len(a) = 4
""")
def filename_grammar(spark, sf):
    pages = read_table(spark, sf, "pages")
    tail = F.regexp_replace(F.regexp_extract("url", r"^https?://[^/]+/(.*)$", 1), "[^A-Za-z0-9]+", "_")
    named = pages.select("page_id", F.concat_ws("_", F.regexp_extract("url", "^(https?)://", 1), tail).alias("name"))
    utt = F.replace(F.col("name"), F.lit("_"), F.lit("-"))
    return R.filename_parts(named, "name").select(
        "page_id", "speaker", "block", "word_id", "channel",
        F.split_part(utt, F.lit("-"), F.lit(1)).alias("utt_speaker"),
        F.split_part(utt, F.lit("-"), F.lit(2)).alias("utt_chapter"),
    )


PART_CLASSES = (["ring", "widget", "bolt", "plate"], ["rod", "gear"])


@query("class_filter", """
SELECT p_partkey, CASE WHEN w IN ('ring','widget','bolt','plate') THEN 'positive'
                       WHEN w IN ('rod','gear') THEN 'negative' ELSE 'rest' END AS role
FROM (SELECT p_partkey, string_split(p_name,' ')[-1] AS w FROM part)
""")
def class_filter(spark, sf):
    label = F.element_at(F.split("p_name", " "), -1)
    return read_table(spark, sf, "part").select("p_partkey", R.class_role(label, *PART_CLASSES).alias("role"))


TASKS = ["GSC35", "GSC10", "UASpeech12", "UASpeech22", "UASpeech5"]
_TASK_VALUES = ", ".join(
    f"('{t}', '{w}', '{role}')" for t in TASKS for role, words in zip(("positive", "negative"), presets.TASKS[t]) for w in words
)


@query("task_words", f"""
WITH t(task, label, role) AS (VALUES {_TASK_VALUES}),
w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS label FROM conversations)
SELECT task, label, role, count(*) AS n, count(DISTINCT conv_id) AS n_conversations FROM w JOIN t USING (label) GROUP BY ALL
""")
def task_words(spark, sf):
    """Spoken words of the named tasks, by task and role."""
    words = read_table(spark, sf, "conversations").select("conv_id", F.explode(F.split("text", " ")).alias("label"))
    spoken = R.records_of_tasks(words, "label", TASKS)
    return spoken.groupBy("task", "label", "role").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("conv_id").alias("n_conversations"))


@query("prefix_groups", """
SELECT c_custkey, CASE WHEN starts_with(c_mktsegment, 'F') THEN 'control' WHEN starts_with(c_mktsegment, 'M') THEN 'patient' END AS grp,
 coalesce(TRY_CAST(trim(split_part(c_name, '#', 2)) AS DOUBLE), 'nan'::DOUBLE) AS number, 'nan'::DOUBLE AS no_number,
 trim(replace('"' || '"' || c_mktsegment || ' ', '""', '"')) AS label FROM customer
""")
def prefix_groups(spark, sf):
    quoted = F.concat(F.lit('""'), "c_mktsegment", F.lit(" "))
    return read_table(spark, sf, "customer").select(
        "c_custkey", R.group_by_prefix(F.col("c_mktsegment"), {"F": "control", "M": "patient"}).alias("grp"),
        T.safe_float(F.split_part("c_name", F.lit("#"), F.lit(2))).alias("number"), T.safe_float(F.col("c_name")).alias("no_number"),
        T.clean_text(quoted).alias("label"),
    )


@query("label_encode", f"""
WITH {V.RECORD_SQL}, d AS (SELECT DISTINCT label FROM rec),
x AS (SELECT label,
  row_number() OVER (ORDER BY CASE label WHEN '_unknown_' THEN 0 WHEN '_silence_' THEN 1 ELSE 2 END, label) - 1 AS a,
  row_number() OVER (ORDER BY CASE label WHEN '_unknown_' THEN 2 ELSE 1 END, label) - 1 AS b FROM d)
SELECT event_id, a::INTEGER AS class_idx, b::INTEGER AS class_idx_unknown_last, label IN ('_unknown_','_silence_') AS is_reject
FROM rec JOIN x USING (label)
""")
def label_encode(spark, sf):
    rec = V.event_records(spark, sf).select("event_id", "label")
    return rec.join(R.class_index(rec), "label").drop("label")


WORDS_SQL = r"""
tok AS (SELECT unnest(regexp_split_to_array(upper(replace(p_name,'ß','ss')), '\s+')) AS t FROM part
        UNION ALL SELECT unnest(regexp_split_to_array(upper(replace(text,'ß','ss')), '\s+')) FROM documents),
wrd AS (SELECT DISTINCT regexp_replace(replace(t,'’',''''), '^[^A-Z''<]+|[^A-Z''>]+$', '', 'g') AS word FROM tok),
lex AS (SELECT word FROM wrd WHERE length(word) BETWEEN 2 AND 12 AND regexp_full_match(word, '[A-Z'']+')
        AND NOT ends_with(word, '''S'))
"""


def lexicon_words(spark, sf):
    """Distinct admissible words of part names and whole document texts."""
    tokens = (
        read_table(spark, sf, "part").select(F.explode(F.split("p_name", r"\s+")).alias("t"))
        .unionByName(spread(read_table(spark, sf, "documents").select("doc_id", "text"), "doc_id").select(
            F.explode(F.split("text", r"\s+")).alias("t")
        ))
    )
    # Distinct raw tokens first: normalisation then runs once per spelling.
    words = tokens.distinct().select(text.normalize_word(F.col("t")).alias("word")).filter(text.word_allowed(F.col("word")))
    return words.distinct()


@query("lexicon_filter", f"WITH {WORDS_SQL} SELECT word, length(word)::INTEGER AS n_letters FROM lex")
def lexicon_filter(spark, sf):
    return lexicon_words(spark, sf).select("word", F.length("word").alias("n_letters"))


@query("word_normalize", r"""
WITH tok AS (SELECT conv_id, turn, unnest(regexp_split_to_array(replace(text,'ß','ss'), '\s+')) AS t FROM conversations),
w AS (SELECT conv_id, turn, regexp_replace(replace(upper(trim(t)),'’',''''), '^[^A-Z''<]+|[^A-Z''>]+$', '', 'g') AS word FROM tok)
SELECT conv_id, turn, count(*) FILTER (WHERE word NOT IN ('','<UNK>','<SPOKEN_NOISE>','{NS}','[NOISE]')) AS n_visible,
       count(DISTINCT word) AS n_distinct, max(word) AS last_word FROM w GROUP BY conv_id, turn
""")
def word_normalize(spark, sf):
    rows = spread(read_table(spark, sf, "conversations"), "conv_id", "turn")
    tokens = rows.select("conv_id", "turn", F.explode(F.split("text", r"\s+")).alias("t"))
    words = tokens.select("conv_id", "turn", text.normalize_word(F.col("t")).alias("word"))
    return words.groupBy("conv_id", "turn").agg(
        F.count(F.when(text.is_visible(F.col("word")), 1)).alias("n_visible"),
        F.countDistinct("word").alias("n_distinct"),
        F.max("word").alias("last_word"),
    )


@query("phone_normalize", r"""
WITH t AS (SELECT p_partkey, unnest(string_split(p_name || ' ' || p_brand || ' sp spn', ' ')) AS w FROM part),
n AS (SELECT p_partkey, w, regexp_replace(upper(trim(w)), '\d', '', 'g') AS b FROM t)
SELECT p_partkey, w AS phone, CASE WHEN b IN ('','SIL','SP','SPN','NSN','LAU','BRTH','CGN') THEN 'SIL' ELSE b END AS normalized,
       b NOT IN ('','SIL','SP','SPN','NSN','LAU','BRTH','CGN') AS scores
FROM n
""")
def phone_normalize(spark, sf):
    raw = F.concat_ws(" ", "p_name", "p_brand", F.lit("sp spn"))
    tokens = read_table(spark, sf, "part").select("p_partkey", F.explode(F.split(raw, " ")).alias("phone"))
    normal = text.normalize_phone(F.col("phone"))
    scores = F.size(text.scoring_phones(F.array("phone"))) > 0
    return tokens.select("p_partkey", "phone", normal.alias("normalized"), scores.alias("scores"))


@query("regex_exclude", """
SELECT o_orderkey, o_custkey FROM orders
WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey
                  AND regexp_matches(coalesce(c_mktsegment,''), '(house|machin)', 'i'))
""")
def regex_exclude(spark, sf):
    severe = read_table(spark, sf, "customer").filter(F.coalesce("c_mktsegment", F.lit("")).rlike("(?i)(house|machin)"))
    facts = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return facts.join(severe.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_anti")


@query("source_bucket", f"WITH {V.RECORD_SQL} SELECT event_id, source FROM rec WHERE source IS NOT NULL")
def source_bucket(spark, sf):
    return V.event_records(spark, sf).filter("source IS NOT NULL").select("event_id", "source")


@query("missing_classes", """
WITH w AS (SELECT unnest(['ring','widget','valve','bolt','piston','gear']) AS label),
c AS (SELECT string_split(p_name,' ')[-1] AS label, count(*) AS n FROM part GROUP BY 1)
SELECT label, coalesce(n, 0)::BIGINT AS n, n IS NULL AS missing FROM w LEFT JOIN c USING (label)
""")
def missing_classes(spark, sf):
    parts = read_table(spark, sf, "part").select(F.element_at(F.split("p_name", " "), -1).alias("label"))
    cover = R.class_coverage(parts, ["ring", "widget", "valve", "bolt", "piston", "gear"])
    return cover.withColumn("missing", F.col("n") == 0)


@query("attribute_split", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag IN ('A') THEN 'training' WHEN l_returnflag = 'R' THEN 'testing' END AS split
FROM lineitem WHERE l_returnflag IN ('A','R')
""")
def attribute_split(spark, sf):
    rows = read_table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", S.attribute_split(F.col("l_returnflag"), ["A"], ["R"]).alias("split")
    )
    return rows.filter("split IS NOT NULL")


@query("dim_lookup", """
SELECT s_suppkey, arg_min(c_name, c_custkey) AS word FROM supplier JOIN customer ON c_nationkey = s_nationkey GROUP BY s_suppkey
""")
def dim_lookup(spark, sf):
    dim = read_table(spark, sf, "customer").select(F.col("c_nationkey").alias("id"), F.col("c_name").alias("word"), "c_custkey")
    facts = read_table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("id"))
    return R.first_word_lookup(facts, dim, "id", "word", "c_custkey").select("s_suppkey", "word")


@query("anti_unaligned", """
SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
""")
def anti_unaligned(spark, sf):
    unaligned = read_table(spark, sf, "labels").filter("toxic = 1").select("doc_id")
    return read_table(spark, sf, "documents").select("doc_id", "lang").join(unaligned, "doc_id", "left_anti")


@query("semi_present", """
SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'present' END AS status,
       CASE WHEN l.doc_id IS NULL THEN 'flac_not_found' END AS reason
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id
""")
def semi_present(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id")
    audio = read_table(spark, sf, "labels").select("doc_id")
    present = docs.join(audio, "doc_id", "left_semi").select("doc_id", F.lit("present").alias("status"))
    missing = docs.join(audio, "doc_id", "left_anti").select(
        "doc_id", F.lit("missing").alias("status"), F.lit("flac_not_found").alias("reason")
    )
    return present.unionByName(missing, allowMissingColumns=True)


@query("category_counts", """
SELECT k AS category, count(l_returnflag)::BIGINT AS n
FROM (SELECT unnest(['A','N','R','X','Z']) AS k) LEFT JOIN lineitem ON l_returnflag = k GROUP BY k
""")
def category_counts(spark, sf):
    rows = read_table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("category"))
    return R.category_counts(rows, "category", ["A", "N", "R", "X", "Z"])


@query("duration_stats", """
SELECT k AS category, count(n_chars)::BIGINT AS n, min(n_chars)::DOUBLE AS min, round(quantile_cont(n_chars, 0.5), 4) AS p50,
       round(avg(n_chars), 4) AS mean, round(quantile_cont(n_chars, 0.95), 4) AS p95, max(n_chars)::DOUBLE AS max
FROM (SELECT unnest(['de', 'en', 'es', 'fr', 'xx']) AS k UNION SELECT lang FROM documents) LEFT JOIN documents ON lang = k GROUP BY k
""")
def duration_stats(spark, sf):
    rows = read_table(spark, sf, "documents").select(F.col("lang").alias("category"), F.col("n_chars").cast("double").alias("n_chars"))
    stats = R.duration_stats(rows, "category", "n_chars", ["de", "en", "es", "fr", "xx"])
    return stats.withColumns({c: F.round(F.col(c), 4) for c in ("p50", "mean", "p95")})


@query("top_words", """
WITH w AS (SELECT p_partkey, unnest(string_split(p_name,' ')) AS word FROM part)
SELECT word, count(*) AS n FROM w WHERE word NOT IN ('red','hot') GROUP BY word HAVING count(*) > 10
ORDER BY n DESC, min(p_partkey), word LIMIT 9
""")
def top_words(spark, sf):
    words = read_table(spark, sf, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))
    return R.top_classes(words, "word", "p_partkey", 9, 10, ["red", "hot"]).select("word", "n")


@query("hash_split", """
WITH h AS (SELECT c_custkey, ('0x' || right(sha1(regexp_replace(string_split(c_name || '_nohash_' || c_nationkey, '/')[-1], '_nohash_.*$', '')), 7))::BIGINT % 134217728 AS s FROM customer)
SELECT c_custkey, CASE WHEN s * (100.0::DOUBLE / 134217727) < 10 THEN 'validation' WHEN s * (100.0::DOUBLE / 134217727) < 20 THEN 'testing' ELSE 'training' END AS split FROM h
""")
def hash_split(spark, sf):
    name = F.concat_ws("_nohash_", "c_name", "c_nationkey")
    return read_table(spark, sf, "customer").select("c_custkey", hashing.hash_split(name, 10, 10).alias("split"))


@query("split_stats", """
WITH h AS (SELECT string_split(p_name,' ')[-1] AS label, ('0x' || right(sha1(p_name || p_partkey), 7))::BIGINT % 134217728 AS s FROM part),
c AS (SELECT CASE WHEN s * (100.0::DOUBLE / 134217727) < 10 THEN 'validation' WHEN s * (100.0::DOUBLE / 134217727) < 20 THEN 'testing' ELSE 'training' END AS split, label, count(*) AS c FROM h GROUP BY 1, 2)
SELECT split, count(*) AS n_classes, min(c) AS min_samples, max(c) AS max_samples, sum(c)::BIGINT AS total_samples, round(avg(c), 6) AS avg_samples FROM c GROUP BY split
""")
def split_stats(spark, sf):
    rows = read_table(spark, sf, "part").select(
        F.element_at(F.split("p_name", " "), -1).alias("label"),
        hashing.hash_split(F.concat("p_name", "p_partkey"), 10, 10).alias("split"),
    )
    return R.split_stats(rows, "label").withColumn("avg_samples", F.round("avg_samples", 6))


@query("stable_id", """
SELECT event_id, left(sha1(printf('u%d:%.3f:%.3f:%s', user_id, value, value + 0.5, event_type)), 12) AS uid,
       'wavs/' || event_type || '/' || printf('u%d_%.2f_%.2f_%s.wav', user_id, value, value + 0.5,
          left(sha1(printf('u%d:%.3f:%.3f:%s', user_id, value, value + 0.5, event_type)), 12)) AS path
FROM events
""")
def stable_id(spark, sf):
    e = read_table(spark, sf, "events")
    utt, start, end = F.concat(F.lit("u"), "user_id"), F.col("value"), F.col("value") + 0.5
    return e.select(
        "event_id",
        hashing.stable_id(utt, start, end, F.col("event_type")).alias("uid"),
        hashing.clip_path(utt, start, end, F.col("event_type")).alias("path"),
    )


_SPEAKER_SQL = f"""
spk AS (SELECT o_custkey, row_number() OVER (ORDER BY md5('{SEED}:' || o_custkey), o_custkey) AS rn, count(*) OVER () AS n
        FROM (SELECT DISTINCT o_custkey FROM orders))
"""


@query("speaker_split", f"""
WITH {_SPEAKER_SQL},
k AS (SELECT *, CASE WHEN n >= 3 THEN greatest(1, round_even(n * 10 / 100.0, 0)) ELSE 0 END AS t,
             CASE WHEN n >= 3 THEN greatest(1, round_even(n * 0.05, 0)) ELSE 0 END AS f FROM spk),
a AS (SELECT o_custkey, CASE WHEN rn <= t THEN 'testing' WHEN rn <= 2 * t THEN 'validation' ELSE 'training' END AS split,
             CASE WHEN rn <= f THEN 'val' WHEN rn <= 2 * f THEN 'test' ELSE 'train' END AS manifest_split FROM k)
SELECT o_orderkey, split, CASE WHEN split = 'validation' THEN 'testing' ELSE split END AS split_merged, manifest_split
FROM orders JOIN a USING (o_custkey)
""")
def speaker_split(spark, sf):
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    both = S.manifest_split(S.speaker_split(orders, "o_custkey", SEED, 10, 10), "o_custkey", SEED, "manifest_split")
    return both.withColumn("split_merged", S.merge_validation(F.col("split"), "testing")).drop("o_custkey")


@query("ratio_split", f"""
WITH {_SPEAKER_SQL},
a AS (SELECT o_custkey, CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'training' WHEN rn <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'validation' ELSE 'testing' END AS speaker_split FROM spk),
r AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY md5('{SEED}:' || o_orderkey), o_orderkey) AS rn, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, speaker_split, CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'training' WHEN rn <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'validation' ELSE 'testing' END AS row_split
FROM r JOIN a USING (o_custkey)
""")
def ratio_split(spark, sf):
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    by_speaker = S.ratio_split_by_speaker(orders, "o_custkey", SEED, "speaker_split")
    return S.ratio_split_by_row(by_speaker, "o_orderkey", SEED, "row_split").drop("o_custkey")


@query("half_split", f"""
WITH p AS (SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderpriority IN ('4-NOT SPECIFIED','5-LOW') THEN '_s_' ELSE o_orderpriority END AS pool FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY md5('{SEED}:' || o_orderkey), o_orderkey) AS rn, count(*) OVER (PARTITION BY pool) AS n FROM p),
k AS (SELECT *, CASE WHEN pool = '_s_' THEN round_even(n * 0.3::DOUBLE, 0) ELSE n END AS kept FROM r)
SELECT o_orderkey, o_orderpriority, CASE WHEN rn <= floor(kept / 2) THEN 'training' ELSE 'testing' END AS split FROM k WHERE rn <= kept
""")
def half_split(spark, sf):
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return S.half_split(orders, "o_orderpriority", "o_orderkey", SEED, ["4-NOT SPECIFIED", "5-LOW"], 0.3)


@query("balanced_cap", """
WITH p AS (SELECT p_partkey, p_brand AS label, CASE WHEN p_size <= 25 THEN 'training' ELSE 'testing' END AS split FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY split, label ORDER BY p_partkey) AS rn, count(*) OVER (PARTITION BY split, label) AS c FROM p),
m AS (SELECT *, min(c) OVER (PARTITION BY split) AS mn FROM r)
SELECT p_partkey, label, split FROM m WHERE rn <= mn
""")
def balanced_cap(spark, sf):
    parts = read_table(spark, sf, "part").select(
        "p_partkey", F.col("p_brand").alias("label"),
        F.when(F.col("p_size") <= 25, "training").otherwise("testing").alias("split"),
    )
    return S.balanced_cap(parts, "split", "label", "p_partkey")


@query("review_sample", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag FROM (
  SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY md5('{SEED}:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey), l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem)
WHERE rn <= 25
""")
def review_sample(spark, sf):
    rows = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    ids = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return S.top_hashed(rows, ["l_returnflag"], ids, SEED, 25).drop("l_suppkey")


N_EPISODES, N_WAY, K_SHOT = 20, 5, 4


@query("episode_classes", f"""
WITH c AS (SELECT DISTINCT label FROM embeddings), e AS (SELECT unnest(range(0, {N_EPISODES}))::INTEGER AS episode),
r AS (SELECT episode, label, row_number() OVER (PARTITION BY episode ORDER BY CASE WHEN label IN (8, 9) THEN 0 ELSE 1 END, md5('{SEED}:' || episode || ':' || label)) - 1 AS pos FROM c, e)
SELECT episode, label, pos::INTEGER AS class_pos FROM r WHERE pos < {N_WAY}
""")
def episode_classes(spark, sf):
    classes = V.embeddings(spark, sf).select("label").distinct()
    return S.episode_classes(classes, "label", N_EPISODES, N_WAY, SEED, ["8", "9"])


@query("episode_support", f"""
WITH c AS (SELECT DISTINCT label FROM embeddings), e AS (SELECT unnest(range(0, {N_EPISODES}))::INTEGER AS episode),
r AS (SELECT episode, label, row_number() OVER (PARTITION BY episode ORDER BY md5('{SEED}:' || episode || ':' || label)) - 1 AS pos FROM c, e),
d AS (SELECT episode, label FROM r WHERE pos < {N_WAY}),
{V.draw_sql("d JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) USING (label)", "label", K_SHOT)},
num AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS no FROM embeddings)
SELECT episode, label, vec_id, sample_no::INTEGER AS sample_no FROM taken JOIN num USING (label, no)
""")
def episode_support(spark, sf):
    rows = V.embeddings(spark, sf).select("vec_id", "label")
    episodes = S.episode_classes(rows.select("label").distinct(), "label", N_EPISODES, N_WAY, SEED).drop("class_pos")
    return S.episode_support(rows, episodes, "label", "vec_id", K_SHOT, SEED)


@query("negatives_union", """
SELECT event_id, CASE event_type WHEN 'error' THEN '_unknown_' WHEN 'view' THEN '_silence_' ELSE event_type END AS label,
  CASE WHEN event_type = 'error' THEN value / 10 ELSE 0.0 END AS bg_offset_seconds,
  CASE WHEN event_type = 'error' THEN value / 20 ELSE 0.0 END AS bg_duration_seconds,
  event_type = 'view' AS is_silence,
  CASE WHEN event_type = 'view' THEN value / 30 ELSE 0.0 END AS silence_duration_seconds,
  CASE WHEN event_type = 'signup' THEN 'cat' || (user_id % 3) ELSE '' END AS hardneg_category
FROM events
""")
def negatives_union(spark, sf):
    e = read_table(spark, sf, "events")

    def rows(kind, *cols):
        return e.filter(F.col("event_type") == kind).select("event_id", *cols)

    label = F.col("event_type").alias("label")
    parts = [
        rows("click", label),
        rows("purchase", label),
        rows("error", F.lit(presets.UNKNOWN_LABEL).alias("label"), (F.col("value") / 10).alias("bg_offset_seconds"),
             (F.col("value") / 20).alias("bg_duration_seconds")),
        rows("view", F.lit(presets.SILENCE_LABEL).alias("label"), F.lit(True).alias("is_silence"),
             (F.col("value") / 30).alias("silence_duration_seconds")),
        rows("signup", label, F.concat(F.lit("cat"), F.pmod("user_id", F.lit(3))).alias("hardneg_category")),
    ]
    defaults = {
        "bg_offset_seconds": 0.0, "bg_duration_seconds": 0.0, "is_silence": False,
        "silence_duration_seconds": 0.0, "hardneg_category": "",
    }
    return R.union_records(parts, defaults)


_EV_SPLIT = "CASE WHEN s * (100.0::DOUBLE / 134217727) < 10 THEN 'validation' WHEN s * (100.0::DOUBLE / 134217727) < 20 THEN 'testing' ELSE 'training' END"


@query("inject_negatives", f"""
WITH h AS (SELECT event_id, event_type, ('0x' || right(sha1('f' || event_id), 7))::BIGINT % 134217728 AS s FROM events),
r AS (SELECT event_id, event_type, {_EV_SPLIT} AS split FROM h),
n AS (SELECT split, count(*) AS n FROM r WHERE event_type <> 'error' GROUP BY split),
sil AS (SELECT split, '_silence_' AS label, unnest(range(1, (ceil(n * 10.0 / 100) + 1)::BIGINT)) AS ref FROM n),
bg AS (SELECT split, '_background_' AS label, unnest(range(1, (ceil(n / 4.0) + 1)::BIGINT)) AS no FROM n),
u AS (SELECT split, event_id, row_number() OVER (PARTITION BY split ORDER BY md5('{SEED}:' || event_id), event_id) AS rn FROM r WHERE event_type = 'error'),
m AS (SELECT count(*) AS c FROM supplier)
SELECT split, label, ref FROM sil
UNION ALL SELECT u.split, '_unknown_', event_id FROM u JOIN n USING (split) WHERE rn <= ceil(n * 10.0 / 100)
UNION ALL SELECT split, label, floor(('0x' || right(md5('{SEED}:' || split || ':' || no), 8))::BIGINT / 4294967296.0::DOUBLE * c)::BIGINT AS ref FROM bg, m
""")
def inject_negatives(spark, sf):
    from earshot.operators.scans import hash_rank

    e = read_table(spark, sf, "events").select(
        "event_id", "event_type", hashing.hash_split(F.concat(F.lit("f"), "event_id"), 10, 10).alias("split")
    )
    sizes = e.filter("event_type <> 'error'").groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    quota = F.ceil(F.col("n") * 10.0 / 100)
    silence = S.rows_from_counts(sizes.select("split", quota.alias("k")), "k", "ref").select(
        "split", F.lit(presets.SILENCE_LABEL).alias("label"), "ref"
    )
    pool = hash_rank(e.filter("event_type = 'error'").select("event_id", "split"), ["split"], ["event_id"], SEED, "rn")
    unknown = pool.join(sizes, "split").filter(F.col("rn") <= quota).select(
        "split", F.lit(presets.UNKNOWN_LABEL).alias("label"), F.col("event_id").alias("ref")
    )
    n_bg = read_table(spark, sf, "supplier").agg(F.count(F.lit(1))).scalar()
    slots = S.rows_from_counts(sizes.select("split", F.ceil(F.col("n") / 4.0).alias("k")), "k", "no")
    slices = slots.select(
        "split", F.lit("_background_").alias("label"),
        F.floor(hashing.uniform(SEED, "split", "no") * n_bg).cast("bigint").alias("ref"),
    )
    return silence.unionByName(unknown).unionByName(slices)


@query("random_slices", f"""
WITH d AS (SELECT event_id, value / 20 AS dur, unnest([0, 1, 2]) AS no FROM events),
u AS (SELECT *, ('0x' || right(md5('{SEED}:d:' || event_id || ':' || no), 8))::BIGINT / 4294967296.0::DOUBLE AS ud,
             ('0x' || right(md5('{SEED}:o:' || event_id || ':' || no), 8))::BIGINT / 4294967296.0::DOUBLE AS uo FROM d),
k AS (SELECT *, dur - 0.05::DOUBLE AS usable, least(3.1::DOUBLE, dur - 0.05::DOUBLE) AS hi FROM u WHERE dur - 0.05::DOUBLE >= 0.5),
l AS (SELECT *, CASE WHEN hi > 0.5 THEN 0.5 + ud * (hi - 0.5) ELSE 0.5 END AS len FROM k)
SELECT event_id, no, round(CASE WHEN usable - len > 0 THEN uo * (usable - len) ELSE 0 END, 6) AS offset_seconds, round(len, 6) AS duration_seconds FROM l
""")
def random_slices(spark, sf):
    sources = read_table(spark, sf, "events").select(
        "event_id", (F.col("value") / 20).alias("dur"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("no")
    )
    u_dur = hashing.uniform(f"{SEED}:d", "event_id", "no")
    u_off = hashing.uniform(f"{SEED}:o", "event_id", "no")
    offset, length = S.random_slice(F.col("dur"), 0.5, 3.1, u_dur, u_off)
    return sources.select(
        "event_id", "no", F.round(offset, 6).alias("offset_seconds"), F.round(length, 6).alias("duration_seconds")
    ).filter("duration_seconds IS NOT NULL")


@query("background_assign", f"""
WITH b AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS no, count(*) OVER () AS n FROM supplier),
r AS (SELECT event_id, floor(('0x' || right(md5('{SEED}:' || event_id), 8))::BIGINT / 4294967296.0::DOUBLE * (SELECT count(*) FROM supplier))::BIGINT AS no FROM events WHERE event_type <> 'error')
SELECT event_id, s_suppkey FROM r JOIN b USING (no)
""")
def background_assign(spark, sf):
    rows = read_table(spark, sf, "events").filter("event_type <> 'error'").select("event_id")
    return S.assign_background(rows, "event_id", read_table(spark, sf, "supplier").select("s_suppkey"), "s_suppkey", SEED)


CATEGORY_WEIGHTS = {"cat1": 2.0, "cat2": 0.5}
WEIGHT_SQL = V.RECORD_SQL + """,
sw AS (SELECT * FROM (VALUES ('company_background',0.30),('gsc_noise',0.25),('gsc_words',0.25),('silence',0.10),('librispeech',0.10),('hard_negative',0.25),('unknown_other',0.10)) t(source, w)),
k AS (SELECT event_id, label, source, CASE WHEN source = 'hard_negative' THEN coalesce(hardneg_category, 'unknown_hard_negative') END AS cat FROM rec),
cc AS (SELECT label, count(*) AS n FROM k GROUP BY label),
sc AS (SELECT source, count(*) AS n FROM k WHERE source IS NOT NULL GROUP BY source),
st AS (SELECT sum(w)::DOUBLE AS t FROM sc JOIN sw USING (source)),
hc AS (SELECT cat, count(*) AS n, CASE cat WHEN 'cat1' THEN 2.0 WHEN 'cat2' THEN 0.5 ELSE 1.0 END::DOUBLE AS w FROM k WHERE cat IS NOT NULL GROUP BY cat),
ht AS (SELECT sum(w)::DOUBLE AS t FROM hc),
wt AS (SELECT event_id, CASE WHEN k.label <> '_unknown_' THEN 1.0::DOUBLE / cc.n
      WHEN k.cat IS NOT NULL THEN (sw.w::DOUBLE / st.t) * (hc.w / ht.t) / hc.n
      ELSE (sw.w::DOUBLE / st.t) / sc.n END AS weight
  FROM k JOIN cc USING (label) LEFT JOIN sc ON sc.source = k.source LEFT JOIN sw ON sw.source = k.source LEFT JOIN hc ON hc.cat = k.cat, st, ht)
"""


def event_weights(spark, sf):
    rec = V.event_records(spark, sf).select("event_id", "label", "source", "hardneg_category")
    return R.sample_weights(rec, presets.SOURCE_WEIGHTS, CATEGORY_WEIGHTS).select("event_id", "weight")


@query("sample_weights", f"WITH {WEIGHT_SQL} SELECT event_id, round(weight, 10) AS weight FROM wt")
def sample_weights(spark, sf):
    return event_weights(spark, sf).withColumn("weight", F.round("weight", 10))


@query("weighted_sample", f"""
WITH {WEIGHT_SQL},
c AS (SELECT event_id, sum(weight) OVER (ORDER BY event_id) - weight AS lo, sum(weight) OVER (ORDER BY event_id) AS hi, sum(weight) OVER () AS t FROM wt),
d AS (SELECT event_id AS draw_no, ('0x' || right(md5('{SEED}:' || event_id), 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM events),
g AS (SELECT lo / t AS lo, event_id FROM c)
SELECT draw_no, event_id FROM d ASOF JOIN g ON d.u >= g.lo
""")
def weighted_sample(spark, sf):
    draws = read_table(spark, sf, "events").select(F.col("event_id").alias("draw_no"))
    return S.weighted_sample(event_weights(spark, sf), "event_id", "weight", draws, "draw_no", SEED)


@query("sampler_epoch", f"""
WITH {WEIGHT_SQL},
len AS (SELECT event_id, CASE WHEN is_silence AND silence_duration_seconds IS NOT NULL THEN greatest(1, floor(silence_duration_seconds * 16000))::INTEGER
   WHEN bg_duration_seconds IS NOT NULL THEN greatest(1, floor(bg_duration_seconds * 16000))::INTEGER
   ELSE least(greatest(1, file_samples), 49600) END AS n_samples FROM rec),
c AS (SELECT event_id, sum(weight) OVER (ORDER BY event_id) - weight AS lo, sum(weight) OVER () AS t FROM wt),
g AS (SELECT lo / t AS lo, event_id FROM c),
size AS (SELECT (count(*) // 20) * count(DISTINCT label) AS n FROM rec),
d AS (SELECT draw_no, ('0x' || right(md5('{SEED}:' || draw_no), 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM (SELECT unnest(range(1, n + 1)) AS draw_no FROM size)),
dr AS (SELECT draw_no, event_id, n_samples FROM d ASOF JOIN g ON d.u >= g.lo JOIN len USING (event_id)),
b AS (SELECT *, (row_number() OVER (ORDER BY n_samples, md5('len:' || draw_no), draw_no) - 1) // 64 AS batch FROM dr),
p AS (SELECT batch, row_number() OVER (ORDER BY md5('{SEED}:' || batch), batch) AS place FROM (SELECT DISTINCT batch FROM b))
SELECT draw_no, event_id, n_samples, floor(n_samples / 8000)::INTEGER AS bucket, batch::BIGINT AS batch, place::BIGINT AS place FROM b JOIN p USING (batch)
""")
def sampler_epoch(spark, sf):
    """An epoch of a twentieth of the records for each class, in shuffled batches of like length."""
    rec = V.event_records(spark, sf)
    n = R.effective_length(
        F.col("is_silence"), F.col("silence_duration_seconds"), F.col("bg_duration_seconds"), F.col("file_samples"), 16000, 49600
    )
    weighted = event_weights(spark, sf).join(rec.select("event_id", n.alias("n_samples")), "event_id")
    draws = S.epoch_size(rec, "label", rec.count() // 20)
    return S.epoch_batches(weighted, "event_id", "weight", "n_samples", draws, 64, 8000, SEED)


@query("capped_files", f"""
SELECT event_id FROM events QUALIFY row_number() OVER (ORDER BY md5('{SEED}:' || event_id), event_id) <= (SELECT count(*) // 3 FROM events)
""")
def capped_files(spark, sf):
    """A third of the files, by a seeded shuffle."""
    files = read_table(spark, sf, "events").select("event_id")
    return S.capped_files(files, "event_id", files.count() // 3, SEED)


@query("length_bucket", f"""
WITH {V.RECORD_SQL},
l AS (SELECT event_id, CASE WHEN is_silence AND silence_duration_seconds IS NOT NULL THEN greatest(1, floor(silence_duration_seconds * 16000))::INTEGER
   WHEN bg_duration_seconds IS NOT NULL THEN greatest(1, floor(bg_duration_seconds * 16000))::INTEGER
   ELSE least(greatest(1, file_samples), 49600) END AS n_samples FROM rec),
r AS (SELECT event_id, n_samples, floor(n_samples / 8000)::INTEGER AS bucket, row_number() OVER (ORDER BY n_samples, md5('len:' || event_id), event_id) AS rn FROM l)
SELECT event_id, n_samples, bucket, floor((rn - 1) / 64)::BIGINT AS batch FROM r
""")
def length_bucket(spark, sf):
    rec = V.event_records(spark, sf)
    n = R.effective_length(
        F.col("is_silence"), F.col("silence_duration_seconds"), F.col("bg_duration_seconds"), F.col("file_samples"), 16000, 49600
    )
    return S.length_buckets(rec.select("event_id", n.alias("n_samples")), "event_id", "n_samples", 8000, 64)


@query("blacklist_setops", """
WITH a AS (SELECT DISTINCT string_split(p_name,' ')[1] AS word FROM part),
b AS (SELECT DISTINCT string_split(p_name,' ')[-1] AS word FROM part UNION SELECT DISTINCT lower(string_split(p_type,' ')[1]) FROM part)
SELECT word, 'union' AS op FROM (SELECT word FROM a UNION SELECT word FROM b)
UNION ALL SELECT word, 'difference' FROM (SELECT word FROM b EXCEPT SELECT word FROM a WHERE word LIKE 's%')
""")
def blacklist_setops(spark, sf):
    part = read_table(spark, sf, "part")
    words = F.split("p_name", " ")
    a = part.select(words[0].alias("word")).distinct()
    b = part.select(F.element_at(words, -1).alias("word")).union(part.select(F.lower(F.split("p_type", " ")[0]))).distinct()
    union = a.union(b).distinct().withColumn("op", F.lit("union"))
    difference = b.join(a.filter(F.col("word").startswith("s")), "word", "left_anti").withColumn("op", F.lit("difference"))
    return union.unionByName(difference)


@query("window_starts", """
WITH l AS (SELECT event_id, (value * 400)::DOUBLE AS v FROM events),
n AS (SELECT event_id, trunc(v)::INTEGER AS len FROM l),
s AS (SELECT event_id, unnest(CASE WHEN len <= 16000 THEN [0] ELSE list_distinct(list_concat(range(0, len - 16000 + 1, 4000), [len - 16000])) END) AS start FROM n)
SELECT event_id, start::INTEGER AS start FROM s
""")
def window_starts(spark, sf):
    e = read_table(spark, sf, "events").select("event_id", (F.col("value") * 400).cast("int").alias("len"))
    return e.select("event_id", F.explode(arrays.window_starts(F.col("len"), 16000, 4000)).alias("start"))


@query("format_magnitude", """
SELECT o_orderkey, CASE WHEN x >= 1e9 THEN printf('%.3f GFLOPs', x / 1e9) WHEN x >= 1e6 THEN printf('%.3f MFLOPs', x / 1e6)
  WHEN x >= 1e3 THEN printf('%.3f KFLOPs', x / 1e3) ELSE printf('%.0f FLOPs', x) END AS label
FROM (SELECT o_orderkey, sqrt(o_totalprice) * (o_custkey + 1) * 100 AS x FROM orders)
""")
def format_magnitude(spark, sf):
    x = F.sqrt("o_totalprice") * (F.col("o_custkey") + 1) * 100
    return read_table(spark, sf, "orders").select("o_orderkey", arrays.format_magnitude(x).alias("label"))
