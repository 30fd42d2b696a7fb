"""Parsers of corpus texts, run over texts that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from earshot.operators import records as R
from earshot.plans.registry import query
from earshot.plans.scoring_queries import daily
from earshot.session import read_table, spread
from earshot.sources import readers


@query("tier_intervals", r"""
WITH t AS (SELECT conv_id, turn, unnest(a) AS w, generate_subscripts(a, 1) AS i FROM (SELECT conv_id, turn, regexp_split_to_array(text, '\s+') AS a FROM conversations)),
x AS (SELECT conv_id || '-' || turn || '-0' AS utt_id, conv_id::VARCHAR AS speaker_id, turn::VARCHAR AS chapter_id, i AS pos, w FROM t)
SELECT utt_id, speaker_id, chapter_id, 'words' AS tier, pos::INTEGER AS pos, (pos - 1) * 0.5::DOUBLE AS start_sec, pos * 0.5::DOUBLE AS end_sec, trim(w) AS text FROM x
UNION ALL SELECT utt_id, speaker_id, chapter_id, 'phones', pos::INTEGER, (pos - 1) * 0.5::DOUBLE, pos * 0.5::DOUBLE, upper(left(replace(w, 'ß', 'ss'), 1)) FROM x
""")
def tier_intervals(spark, sf):
    rows = spread(read_table(spark, sf, "conversations"), "conv_id", "turn").select(
        F.concat_ws("-", "conv_id", "turn", F.lit("0")).alias("utt"), F.split("text", r"\s+").alias("words")
    )

    def tier(number, name, text_of):
        def interval(w, i):
            return F.concat(
                F.lit("        intervals ["), i + 1, F.lit("]:\n            xmin = "), i * 0.5, F.lit("\n            xmax = "),
                (i + 1) * 0.5, F.lit('\n            text = "'), F.replace(text_of(w), F.lit('"'), F.lit('""')), F.lit('"\n'),
            )

        return F.concat(
            F.lit(f'    item [{number}]:\n        class = "IntervalTier"\n        name = "{name}"\n'),
            F.array_join(F.transform("words", interval), ""),
        )

    texts = rows.select("utt", F.concat(
        F.lit('File type = "ooTextFile"\nObject class = "TextGrid"\nxmin = 0\nitem []:\n'),
        tier(1, "words", lambda w: w), tier(2, "phones", lambda w: F.upper(F.left(F.replace(w, F.lit("ß"), F.lit("ss")), F.lit(1)))),
    ).alias("content"))
    return readers.parse_tiers(texts, "utt", "content").filter("error IS NULL").select(
        "utt_id", "speaker_id", "chapter_id", "tier", "pos", F.col("start").alias("start_sec"), F.col("end").alias("end_sec"), "text"
    )


@query("trace_curve", """
SELECT event_type AS run, (date_diff('day', DATE '2024-01-01', ts::DATE) + 1)::BIGINT AS epoch, round(avg(value), 3) AS train_loss FROM events GROUP BY ALL
""")
def trace_curve(spark, sf):
    lines = daily(spark, sf).select("run", F.to_json(F.struct(F.struct(F.col("score").alias("loss")).alias("train"), "epoch")).alias("line"))
    parsed = lines.select("run", F.from_json("line", "train struct<loss: double>, epoch bigint").alias("t")).select("run", "t.*")
    return parsed.select("run", "epoch", F.col("train.loss").alias("train_loss"))


@query("option_maps", """
SELECT event_id, user_id::DOUBLE AS w_user, value AS w_value, 'speech.' || event_type AS kept_key, event_type AS stripped FROM events
""")
def option_maps(spark, sf):
    e = read_table(spark, sf, "events")
    text = F.concat(F.lit("user="), "user_id", F.lit(", value="), "value", F.lit(","))
    options = F.create_map(F.concat(F.lit("speech."), "event_type"), F.lit("x"), F.lit("fsl.k"), F.lit("y"))
    rows = e.select("event_id", "event_type", R.parse_options(text).alias("w"), R.filter_options(options, "speech").alias("o"))
    return rows.select(
        "event_id", F.col("w")["user"].alias("w_user"), F.col("w")["value"].alias("w_value"),
        F.concat(F.lit("speech."), F.map_keys("o")[0]).alias("kept_key"), F.map_keys("o")[0].alias("stripped"),
    )
