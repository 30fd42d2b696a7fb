"""Readers: each turns files into a DataFrame without touching the driver."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot import presets
from earshot.functions.vectors import let
from earshot.operators import records as R

RECORD_SCHEMA = "label string, file string, speaker string"


def list_files(spark: SparkSession, root: str, pattern: str = "*.wav") -> DataFrame:
    """Paths and sizes below ``root``; the contents are not read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
        .load(root).select("path", "length")
    )


def path_corpus(spark: SparkSession, root: str, pattern: str = "*.wav") -> DataFrame:
    return R.path_records(list_files(spark, root, pattern).select("path"), "path").drop("path")


def take_corpus(spark: SparkSession, root: str, channel: str) -> DataFrame:
    return R.take_records(list_files(spark, root, f"{channel}.wav").select("path"), "path", channel)


def support_set(spark: SparkSession, root: str, extensions: list[str]) -> DataFrame:
    """(label, file) per supported file below one folder per class; empty folders vanish."""
    files = list_files(spark, root, "*")
    suffix = F.lower(F.concat(F.lit("."), F.element_at(F.split("path", r"\."), -1)))
    inside = F.regexp_extract("path", "^.*?" + _quoted(root.rstrip("/")) + "/([^/]+)/.+$", 1)
    return files.filter(suffix.isin(*extensions)).select(inside.alias("label"), F.col("path").alias("file")).filter("label <> ''")


def _quoted(text: str) -> str:
    return r"\Q" + text + r"\E"


def _line_place() -> Column:
    """Order of a line: its file's name, the split of the file it stands in, its place in the split."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )


def label_file(spark: SparkSession, path: str) -> DataFrame:
    """``<file> <label>`` lines; the first six characters of the file are the speaker."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(F.size(parts) >= 2)
    label = F.when(parts[1] == "Hey", "Hey Siri").otherwise(parts[1])
    speaker = F.substring(parts[0], 1, 6)
    file = F.concat_ws("/", F.lit("wav"), speaker, F.concat(parts[0], F.lit(".wav")))
    return rows.select(label.alias("label"), file.alias("file"), speaker.alias("speaker"))


def split_csvs(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """One CSV with WORD, LINK, SPEAKER columns per split, in file order.

    ``pos`` orders the lines, by file name and then by place in the file.
    """
    def one(split, path):
        rows = spark.read.option("header", True).csv(path)
        return rows.select(
            F.col("WORD").alias("label"), F.col("LINK").alias("file"), F.col("SPEAKER").alias("speaker"),
            F.lit(split).alias("split"), _line_place().alias("pos"),
        )

    return reduce(DataFrame.unionByName, [one(s, p) for s, p in paths.items()])


def hard_negative_manifests(spark: SparkSession, root: str, paths: dict[str, str]) -> DataFrame:
    """Manifest rows as rejection records; defaults fill missing or empty fields."""
    schema = ", ".join(f"{f} string" for f in presets.MANIFEST_FIELDS)

    def filled(name, default):
        return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(default))

    def one(split, path):
        rows = spark.read.option("header", True).schema(schema).option("enforceSchema", False).csv(path)
        wav = F.when(F.col("wav_path").startswith("/"), F.col("wav_path")).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), "wav_path"))
        kept = rows.filter(filled("label", presets.UNKNOWN_LABEL) == presets.UNKNOWN_LABEL).filter(
            F.coalesce("wav_path", F.lit("")) != ""
        )
        return kept.select(
            F.lit(presets.UNKNOWN_LABEL).alias("label"), wav.alias("file"),
            F.concat(F.lit("hard_negative_"), filled("speaker_id", "unknown_speaker")).alias("speaker"),
            F.lit("hard_negative").alias("unknown_source"), filled("category", "unknown_hard_negative").alias("hardneg_category"),
            filled("target", "").alias("hardneg_target"), filled("words", "").alias("hardneg_words"),
            filled("source_utt_id", "").alias("hardneg_source_utt_id"), F.lit(split).alias("split"),
        )

    return reduce(DataFrame.unionByName, [one(s, p) for s, p in paths.items()])


def lexicon(spark: SparkSession, path: str, keep_stress: bool = False) -> DataFrame:
    """(word, pron_no, phones) of a latin-1 pronunciation lexicon.

    Comment lines start with ``;;;`` or ``#``; ``WORD(2)`` is another
    pronunciation of WORD. Lines are read in parallel and numbered per word.
    """
    from pyspark.sql import Window

    # The CSV reader decodes other charsets line by line; separator and quote are switched off.
    raw = spark.read.schema("value string").option("encoding", "ISO-8859-1").option("sep", "\u0001").option("quote", "").csv(path)
    lines = raw.select(F.trim("value").alias("line"), _line_place().alias("at"))
    lines = lines.filter("line <> ''").filter(~F.col("line").startswith(";;;") & ~F.col("line").startswith("#"))
    parts = F.split("line", r"\s+")
    rows = lines.filter(F.size(parts) >= 2).select("at", parts.alias("p"))
    word = F.regexp_replace(F.upper(F.col("p")[0]), r"\(\d+\)$", "")
    phones = F.slice("p", F.lit(2), F.size("p") - 1)
    if not keep_stress:
        phones = F.transform(phones, lambda x: F.regexp_replace(x, r"\d", ""))
    # A word has a handful of pronunciations, so this window is small.
    number = F.row_number().over(Window.partitionBy("word").orderBy("at"))
    return rows.select(word.alias("word"), "at", phones.alias("phones")).select("word", number.alias("pron_no"), "phones")


def word_list(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.trim("value").alias("line")).filter("line <> ''").filter(~F.col("line").startswith("#"))
    return lines.select(F.explode(F.split("line", r"[,\s]+")).alias("w")).filter("w <> ''").select(F.upper("w").alias("word")).distinct()


def inline_words(text: Column) -> Column:
    """Upper-case words of a comma separated option."""
    return F.filter(F.transform(F.split(text, ","), lambda w: F.upper(F.trim(w))), lambda w: w != "")


def unaligned_utterances(spark: SparkSession, path: str) -> DataFrame:
    first = F.split(F.trim("value"), r"\s+")[0]
    return spark.read.text(path).select(first.alias("utt_id")).filter("utt_id <> ''").distinct()


def parse_tiers(files: DataFrame, utt: str, content: str) -> DataFrame:
    """Interval-tier texts to (utt_id, speaker_id, chapter_id, tier, pos, start, end, text, error).

    A text without both a words and a phones tier yields one row whose ``error`` says so; nothing stops the job. A text
    is matched once: its intervals, or its error, are one array, and an interval is taken apart by plain splits.
    """
    # Everything after a 'name = "..."' line up to the next one belongs to that tier.
    chunks = F.split(content, r'(?m)^\s*name\s*=\s*')

    def tier_of(chunk: Column) -> Column:
        name = F.substring_index(F.substring(chunk, 2, 1 << 30), '"', 1)
        return F.struct(name.alias("name"), F.regexp_extract_all(chunk, F.lit(presets.TIER_INTERVAL), F.lit(0)).alias("items"))

    def row(tier, pos, item, error) -> Column:
        return F.struct(
            F.lit(tier).cast("string").alias("tier") if tier is None else tier.alias("tier"), F.lit(pos).cast("int").alias("pos"),
            F.lit(item).cast("string").alias("item"), F.lit(error).cast("string").alias("error"),
        )

    def rows_of(tiers: Column) -> Column:
        names = F.transform(tiers, lambda t: t["name"])
        complete = F.array_contains(names, "words") & F.array_contains(names, "phones")
        intervals = F.flatten(F.transform(tiers, lambda t: F.transform(t["items"], lambda item, i: row(t["name"], i + 1, item, None))))
        return F.when(complete, intervals).otherwise(F.array(row(None, None, None, "missing required words/phones tiers")))

    tiers = F.transform(F.slice(chunks, F.lit(2), F.size(chunks)), tier_of)
    parts = F.split(utt, "-")
    found = files.select(
        F.col(utt).alias("utt_id"), parts[0].alias("speaker_id"), F.when(F.size(parts) >= 2, parts[1]).otherwise("").alias("chapter_id"),
        F.explode(let(tiers, rows_of)).alias("r"),
    )
    # 'intervals [i]: xmin = a xmax = b text = "..."', where only the text may hold further signs of equality
    sides = found.select("utt_id", "speaker_id", "chapter_id", "r.tier", "r.pos", F.split("r.item", "=", 4).alias("p"), "r.error")
    number = lambda side: F.trim(F.regexp_replace(side, r"\s*[a-z]+\s*$", "")).cast("double")
    quoted = F.trim(F.translate(F.col("p")[3], "\t\r\n", "   "))
    inner = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    return sides.select(
        "utt_id", "speaker_id", "chapter_id", "tier", "pos", number(F.col("p")[1]).alias("start"), number(F.col("p")[2]).alias("end"),
        F.trim(F.replace(inner, F.lit('""'), F.lit('"'))).alias("text"), "error",
    )


def tier_files(spark: SparkSession, root: str, pattern: str = "*.TextGrid") -> DataFrame:
    """Parsed interval-tier files; one small text per utterance."""
    whole = (
        spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern).load(root).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("content"))
    )
    named = whole.withColumn("utt", F.regexp_replace("name", r"\.[^.]*$", ""))
    return parse_tiers(named, "utt", "content")


def metric_trace(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines ``{"train": {"loss": x}, "epoch": n}`` as flat columns."""
    return flatten_trace(spark.read.schema("train struct<loss: double>, epoch bigint").json(path))


def flatten_trace(trace: DataFrame) -> DataFrame:
    return trace.select("epoch", F.col("train.loss").alias("train_loss"))
