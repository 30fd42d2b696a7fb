"""Lexicon and n-gram mining, overlap, suppression and quota queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from earshot import presets
from earshot.functions import text as T
from earshot.operators import mining as M
from earshot.plans.record_queries import WORDS_SQL, lexicon_words
from earshot.plans.registry import query
from earshot.session import materialize, read_table, spread

SEED = presets.SEED
LETTERS = [*"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "'"]
LEXICON_TARGETS = {"hey_camy": [*"HEYCAMY"], "hey_reco": [*"HEYRECO"]}


@query("token_levenshtein", """
WITH w AS (SELECT p_partkey, lower(p_name) AS a, lower(p_type) AS b FROM part)
SELECT p_partkey, levenshtein(a, b) AS distance, round(1 - levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE, 6) AS similarity,
       round(levenshtein(a, b) / greatest(length(a), length(b), 1)::DOUBLE, 6) AS norm_distance FROM w
""")
def token_levenshtein(spark, sf):
    a, b = F.split(F.lower("p_name"), ""), F.split(F.lower("p_type"), "")
    rows = read_table(spark, sf, "part").select("p_partkey", a.alias("a"), b.alias("b"))
    scored = rows.select("p_partkey", "a", "b", T.token_levenshtein(F.col("a"), F.col("b")).cast("bigint").alias("distance"))
    la, lb = F.size("a"), F.size("b")
    return scored.select(
        "p_partkey", "distance", F.round(T.edit_similarity(F.col("distance"), la, lb), 6).alias("similarity"),
        F.round(T.normalized_distance(F.col("distance"), la, lb), 6).alias("norm_distance"),
    )


_BLACK = ", ".join(f"('{t}','{w}')" for t, ws in presets.WAKE_SPELLINGS.items() for w in ws)


@query("lexicon_hard_negatives", f"""
WITH {WORDS_SQL},
p AS (SELECT word, 1 AS no, word AS l FROM lex UNION ALL SELECT word, 2, replace(word, 'C', 'K') FROM lex),
t AS (SELECT * FROM (VALUES ('hey_camy', 'HEYCAMY'), ('hey_reco', 'HEYRECO')) t(target, tl)),
s AS (SELECT target, tl, word, no, 'HEY' || l AS c, levenshtein('HEY' || l, tl) AS d FROM p, t WHERE (target, word) NOT IN (SELECT * FROM (VALUES {_BLACK}))),
n AS (SELECT *, d / greatest(length(c), length(tl))::DOUBLE AS nd FROM s),
b AS (SELECT target, any_value(tl) AS tl, word, arg_min(c, (d, nd, length(c), no)) AS c, min(d) AS d, arg_min(nd, (d, nd, length(c), no)) AS nd FROM n GROUP BY target, word),
k AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY d, round(nd, 4), word) AS rn FROM b WHERE d BETWEEN 2 AND 5 AND nd <= 0.7)
SELECT target, 'HEY ' || word AS candidate, word, d::INTEGER AS distance, round(nd, 4) AS norm_distance,
       array_to_string(string_split(tl, ''), ' ') AS target_phones, array_to_string(string_split(c, ''), ' ') AS candidate_phones FROM k WHERE rn <= 100
""")
def lexicon_hard_negatives(spark, sf):
    words = lexicon_words(spark, sf)
    spoken = words.select("word", F.explode(F.array(
        F.struct(F.lit(1).alias("pron_no"), F.split("word", "").alias("phones")),
        F.struct(F.lit(2).alias("pron_no"), F.split(F.replace("word", F.lit("C"), F.lit("K")), "").alias("phones")),
    )).alias("p")).select("word", "p.*")
    return M.lexicon_hard_negatives(spoken, LEXICON_TARGETS, "HEY", [*"HEY"], LETTERS, presets.WAKE_SPELLINGS)


# Letters stand in for phones: those the targets use map to their phone.
LETTER_PHONES = {"H": "HH", "E": "EY", "K": "K", "A": "AE", "M": "M", "I": "IY", "Y": "IY", "R": "R", "O": "OW"}
PHONE_ALPHABET = ["HH", "EY", "K", "AE", "M", "IY", "R", "OW", "AY"]
EXTRA_PHRASES = ["ERE", "OF THE", "LA"]
WAKE = ["hey_camy", "hey_reco", "camy", "reco"]
WORD_SLOT, PHONE_SEC = 10.0, 0.1


def aligned_utterances(spark, sf):
    """(words, phones) interval rows: word i starts at 10*i s, each letter lasts 0.1 s."""
    utts = read_table(spark, sf, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("utt_id"), "text").unionByName(
        read_table(spark, sf, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("_"), "turn").alias("utt_id"), "text")
    )
    # rows are numbered where they are dealt, so that a window over one of them deals nothing out again
    utts = spread(utts, "utt_id").withColumn("row", F.monotonically_increasing_id())
    visible = F.filter(F.transform(F.split("text", r"\s+"), T.normalize_word), T.is_visible)
    spoken = utts.select("utt_id", "row", F.posexplode(visible).alias("i", "text"))
    before = Window.partitionBy("utt_id", "row").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    # Written once, as a corpus of aligned utterances would be: both tiers are read from it.
    spoken = materialize(spoken.withColumn("letters", F.regexp_replace("text", "[^A-Z]", "")).select(
        "utt_id", (F.col("i") + 1).cast("bigint").alias("pos"), "text", "letters",
        F.coalesce(F.sum(F.length("letters")).over(before), F.lit(0)).alias("before"),
    ))
    start = (F.col("pos") - 1) * WORD_SLOT
    words = spoken.select("utt_id", "pos", start.alias("start"), (start + F.length("letters") * PHONE_SEC).alias("end"), "text")
    phone_of = F.create_map(*[F.lit(x) for kv in LETTER_PHONES.items() for x in kv])
    lettered = spoken.filter("letters <> ''").select(
        "utt_id", start.alias("begun"), "before", F.posexplode(F.split("letters", "")).alias("j", "letter"),
    ).filter("letter <> ''")
    # a phone's number is its place among the letters of the whole utterance
    phones = lettered.select(
        "utt_id", (F.col("before") + F.col("j") + 1).cast("int").alias("pos"), (F.col("begun") + F.col("j") * PHONE_SEC).alias("start"),
        (F.col("begun") + (F.col("j") + 1) * PHONE_SEC).alias("end"),
        F.coalesce(F.element_at(phone_of, F.col("letter")), F.col("letter")).alias("text"),
    )
    return words, phones


def candidates(spark, sf):
    words, phones = aligned_utterances(spark, sf)
    return M.mine_candidates(
        words, phones, PHONE_ALPHABET, min_sec=0.35, max_sec=11.05, pre_pad=0.1, post_pad=0.1, similarity=0.5, max_distance=3,
        phrase_blacklist=presets.PHRASE_BLACKLIST + EXTRA_PHRASES, wake_targets=WAKE,
    )


_SPELLED = {"hey": "HE", "hi_high": "Hy", "he": "HI", "hey_camy": "HEKAMI", "hey_reco": "HERIKO", "camy": "KAMI", "reco": "RIKO"}
_CAT = ", ".join(f"('{c}','{t}','{_SPELLED[t]}')" for c, ts in presets.CATEGORY_TARGETS.items() for t in ts)
_WAKE_CASE = "CASE " + " ".join(
    f"WHEN len = 0 THEN '' WHEN levenshtein(l, '{_SPELLED[t]}') <= 1 OR (1 - levenshtein(l, '{_SPELLED[t]}') / greatest(len, {len(_SPELLED[t])})::DOUBLE >= 0.92 AND len >= {len(_SPELLED[t]) - 1}) THEN 'wake_phone_blacklist:{t}'"
    for t in WAKE) + " ELSE '' END"
_TEXT_HIT = "(SELECT bool_or(phrase = i OR starts_with(phrase, i || ' ') OR ends_with(phrase, ' ' || i)) FROM (SELECT unnest(['" + "','".join(
    presets.PHRASE_BLACKLIST + EXTRA_PHRASES) + "']) AS i))"
_NGRAM_SQL = r"""
u AS (SELECT 'b' || item_id AS utt, text FROM benchmark UNION ALL SELECT 'c' || conv_id || '_' || turn, text FROM conversations),
t AS (SELECT utt, unnest(a) AS t, generate_subscripts(a, 1) AS i FROM (SELECT utt, regexp_split_to_array(upper(replace(text,'ß','ss')), '\s+') AS a FROM u)),
w0 AS (SELECT utt, i, regexp_replace(replace(t,'’',''''), '^[^A-Z''<]+|[^A-Z''>]+$', '', 'g') AS word FROM t),
w AS (SELECT utt, word, row_number() OVER (PARTITION BY utt ORDER BY i) AS pos, replace(regexp_replace(word, '[^A-Z]', '', 'g'), 'Y', 'I') AS l
      FROM w0 WHERE word NOT IN ('','<UNK>','<SPOKEN_NOISE>','{NS}','[NOISE]')),
g AS (SELECT utt, pos, 1 AS n, word AS w1, word AS phrase, l, l AS last FROM w
  UNION ALL SELECT a.utt, a.pos, 2, a.word, a.word || ' ' || b.word, a.l || b.l, b.l FROM w a JOIN w b ON a.utt = b.utt AND b.pos = a.pos + 1
  UNION ALL SELECT a.utt, a.pos, 3, a.word, a.word || ' ' || b.word || ' ' || c.word, a.l || b.l || c.l, c.l FROM w a JOIN w b ON a.utt = b.utt AND b.pos = a.pos + 1 JOIN w c ON a.utt = c.utt AND c.pos = a.pos + 2),
wc AS (SELECT utt, phrase, l, (pos - 1) * 10.0::DOUBLE AS s, (pos + n - 2) * 10.0::DOUBLE + length(last) * 0.1::DOUBLE AS e,
              unnest(list_filter([CASE WHEN w1 IN ('HEY','HAY','HI','HIGH') AND n = 2 THEN ['hey_nonwake', 'hey_plus_1_word'] END,
               CASE WHEN w1 IN ('HEY','HAY','HI','HIGH') AND n = 3 THEN ['hey_nonwake', 'hey_plus_2_words'] END,
               CASE WHEN n <= 2 THEN ['hey_phoneme_similar', 'hey_prefix_word_' || n || '_gram'] END,
               CASE WHEN n <= 2 THEN ['camy_phoneme_similar', 'word_' || n || '_gram'] END,
               CASE WHEN n <= 2 THEN ['reco_phoneme_similar', 'word_' || n || '_gram'] END], lambda x: x IS NOT NULL)) AS c FROM g),
lt0 AS (SELECT utt, pos AS wp, unnest(range(1, length(l) + 1)) AS j, l FROM w),
lt AS (SELECT utt, wp, j, l[j] AS letter, row_number() OVER (PARTITION BY utt ORDER BY wp, j) AS p, count(*) OVER (PARTITION BY utt) AS np FROM lt0),
us AS (SELECT utt, string_agg(letter, '' ORDER BY p) AS "full", list(wp ORDER BY p) AS wps, list(j ORDER BY p) AS js FROM lt GROUP BY utt),
uw AS (SELECT utt, list(word ORDER BY pos) AS words FROM w GROUP BY utt),
pr AS (SELECT utt, p, n FROM lt, (SELECT unnest([4,5,6,7]) AS n) WHERE p + n - 1 <= np),
pc AS (SELECT pr.utt, array_to_string(list_slice(words, wps[p], wps[p + n - 1]), ' ') AS phrase, substring("full", p, n) AS l,
              (wps[p] - 1) * 10.0::DOUBLE + (js[p] - 1) * 0.1::DOUBLE AS s, (wps[p + n - 1] - 1) * 10.0::DOUBLE + js[p + n - 1] * 0.1::DOUBLE AS e,
              ['local_phoneme_confuser', 'local_phone_ngram'] AS c FROM pr JOIN us USING (utt) JOIN uw USING (utt)),
cand AS (SELECT utt, phrase, l, length(l) AS len, c[1] AS category, c[2] AS rule, greatest(0, s - 0.1::DOUBLE) AS s, e + 0.1::DOUBLE AS e FROM (SELECT * FROM wc UNION ALL BY NAME SELECT * FROM pc)),
uniq AS (SELECT DISTINCT category, l FROM cand),
ct AS (SELECT * FROM (VALUES """ + _CAT + r""") t(category, target, tl)),
sc AS (SELECT category, l, target, CASE WHEN length(l) = 0 THEN 0.0 ELSE greatest(0.0, 1 - levenshtein(l, tl) / greatest(length(l), length(tl))::DOUBLE) END AS sim,
              CASE WHEN length(l) = 0 THEN length(tl) ELSE levenshtein(l, tl) END AS d FROM uniq JOIN ct USING (category)),
bs AS (SELECT category, l, arg_max(target, (sim, -d, target)) AS target, max(sim) AS sim, arg_max(d, (sim, -d, target)) AS d FROM sc GROUP BY category, l),
ph AS (SELECT phrase, """ + _TEXT_HIT + r""" AS hit FROM (SELECT DISTINCT phrase FROM cand)),
fl AS (SELECT cand.*, target, sim, d, CASE WHEN hit THEN 'text_blacklist' ELSE """ + _WAKE_CASE + r""" END AS flag, e - s AS dur FROM cand JOIN bs USING (category, l) JOIN ph USING (phrase)),
res AS (SELECT *, dur BETWEEN 0.35 AND 11.05 AND CASE WHEN category = 'hey_phoneme_similar' THEN len BETWEEN 2 AND 4 AND d <= 1 AND sim >= 0.66
               ELSE sim >= 0.5 AND d <= 3 AND len >= 2 END AS passes FROM fl)
"""
_CAND_COLS = "utt AS utt_id, category, rule, phrase, round(s, 3) AS start_sec, round(e, 3) AS end_sec, target, round(sim, 6) AS similarity, d::INTEGER AS edit_distance"


def _candidate_columns(df):
    return df.select(
        "utt_id", "category", "rule", "phrase", F.round("start_sec", 3).alias("start_sec"), F.round("end_sec", 3).alias("end_sec"),
        "target", F.round("similarity", 6).alias("similarity"), F.col("edit_distance").cast("int").alias("edit_distance"),
    )


@query("ngram_candidates", f"WITH {_NGRAM_SQL} SELECT {_CAND_COLS} FROM res WHERE passes AND flag = ''")
def ngram_candidates(spark, sf):
    return _candidate_columns(candidates(spark, sf).filter("passes AND blacklist_flag = ''"))


@query("phrase_blacklist", f"WITH {_NGRAM_SQL} SELECT utt AS utt_id, category, rule, phrase, round(s, 3) AS start_sec, flag AS blacklist_flag FROM res WHERE flag <> ''")
def phrase_blacklist(spark, sf):
    return candidates(spark, sf).filter("blacklist_flag <> ''").select(
        "utt_id", "category", "rule", "phrase", F.round("start_sec", 3).alias("start_sec"), "blacklist_flag"
    )


def event_spans(spark, sf, minutes):
    e = read_table(spark, sf, "events")
    start = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return e.select(
        "event_id", "user_id", "event_type", "value", start.alias("start"), (start + F.col("value") * 60 * minutes).alias("end"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


_SPAN_SQL = """
sp AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) / 1e6::DOUBLE AS s, epoch_us(ts) / 1e6::DOUBLE + value * 60 * {m} AS e,
              json_extract(props, '$.k')::INTEGER AS k FROM events)
"""
_OVERLAP_SQL = _SPAN_SQL.format(m=10) + """,
ov AS (SELECT a.event_id AS span_id, b.event_id AS interval_id, a.s AS s1, a.e AS e1, b.s AS s2, b.e AS e2 FROM sp a JOIN sp b
   ON a.user_id = b.user_id AND b.e > a.s + 1e-5 AND b.s < a.e - 1e-5 WHERE a.event_type = 'signup' AND b.event_type = 'click')
"""


def overlaps(spark, sf):
    e = event_spans(spark, sf, 10)
    spans = e.filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("span_id"), "start", "end")
    clicks = e.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("interval_id"), "start", "end")
    return M.overlap_join(spans, clicks, "user_id", "start", "end", 6 * 3600.0)


@query("interval_overlap", f"WITH {_OVERLAP_SQL} SELECT span_id, interval_id FROM ov")
def interval_overlap(spark, sf):
    return overlaps(spark, sf).select("span_id", "interval_id")


@query("interval_iou", f"WITH {_OVERLAP_SQL} SELECT span_id, interval_id, round(greatest(0, least(e1, e2) - greatest(s1, s2)) / (greatest(e1, e2) - least(s1, s2)), 6) AS iou FROM ov")
def interval_iou(spark, sf):
    iou = M.interval_iou(*[F.col(c) for c in ("span_start", "span_end", "iv_start", "iv_end")])
    return overlaps(spark, sf).select("span_id", "interval_id", F.round(iou, 6).alias("iou"))


@query("nms_dedupe", f"""WITH RECURSIVE {_SPAN_SQL.format(m=30)},
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY -value, event_id % 3, s, event_id) AS rn FROM sp WHERE e > s),
g AS (SELECT user_id, 0::BIGINT AS rn, -1::BIGINT AS event_id, []::STRUCT(s DOUBLE, e DOUBLE)[] AS kept, false AS keep FROM (SELECT DISTINCT user_id FROM sp)
  UNION ALL
  SELECT q.user_id, q.rn, q.event_id, CASE WHEN q.ok THEN list_append(q.kept, {{'s': q.s, 'e': q.e}}) ELSE q.kept END, q.ok FROM (
    SELECT o.user_id, o.rn, o.event_id, o.s, o.e, g.kept,
      len(list_filter(g.kept, lambda x: greatest(0, least(x.e, o.e) - greatest(x.s, o.s)) > 0.5 * (greatest(x.e, o.e) - least(x.s, o.s)))) = 0 AS ok
    FROM g JOIN o ON o.user_id = g.user_id AND o.rn = g.rn + 1) q)
SELECT user_id, event_id FROM g WHERE keep UNION ALL SELECT user_id, event_id FROM sp WHERE e <= s
""")
def nms_dedupe(spark, sf):
    spans = event_spans(spark, sf, 30).withColumn("distance", F.pmod("event_id", F.lit(3)))
    return M.suppress_overlaps(spans, "user_id", "start", "end", "value", "distance", "event_id").select("user_id", "event_id")


QUOTA = dict(speaker_cap=5, phrase_cap=12, phrase_caps={"view": 6}, category_cap=300)


@query("quota_exact", f"""WITH RECURSIVE {_SPAN_SQL.format(m=1)},
o AS (SELECT *, CASE WHEN event_type = 'view' THEN 6 ELSE 12 END AS cap, row_number() OVER (PARTITION BY event_type ORDER BY -value, event_id % 3, e - s, event_id) AS rn FROM sp),
g AS (SELECT event_type, 0::BIGINT AS rn, -1::BIGINT AS event_id, []::STRUCT(u BIGINT, k INTEGER)[] AS acc, false AS keep FROM (SELECT DISTINCT event_type FROM sp)
  UNION ALL
  SELECT q.event_type, q.rn, q.event_id, CASE WHEN q.ok THEN list_append(q.acc, {{'u': q.user_id, 'k': q.k}}) ELSE q.acc END, q.ok FROM (
    SELECT o.event_type, o.rn, o.event_id, o.user_id, o.k, g.acc,
      len(list_filter(g.acc, lambda x: x.u = o.user_id)) < 5 AND len(list_filter(g.acc, lambda x: x.k = o.k)) < o.cap AS ok
    FROM g JOIN o ON o.event_type = g.event_type AND o.rn = g.rn + 1 WHERE len(g.acc) < 300) q)
SELECT event_type, event_id FROM g WHERE keep
""")
def quota_exact(spark, sf):
    rows = event_spans(spark, sf, 1).withColumns({"distance": F.pmod("event_id", F.lit(3)), "dur": F.col("end") - F.col("start")})
    return M.limit_candidates(rows, "event_type", "user_id", "k", "value", "distance", "dur", "event_id", **QUOTA).select(
        "event_type", "event_id"
    )


@query("quota_chained", f"""WITH {_SPAN_SQL.format(m=1)},
a AS (SELECT * FROM sp QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY -value, event_id) <= 5),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY event_type, k ORDER BY -value, event_id) <= 12)
SELECT event_type, event_id FROM b QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY -value, event_id) <= 300
""")
def quota_chained(spark, sf):
    rows = event_spans(spark, sf, 1)
    return M.chained_quota(
        rows, [(["event_type", "user_id"], 5), (["event_type", "k"], 12), (["event_type"], 300)], [F.desc("value"), F.col("event_id")], "event_id"
    ).select("event_type", "event_id")
