"""Lines that several documents share: exploded, hashed, counted by distinct documents, dropped, and put back in place.

A line's key is the line stripped of white space with A-Z in lower case. Every document's lines are exploded with their
places, documents are counted per hash of the key, and the places of the lines to drop go back to their document, where
the others are joined again in order. Only hashes and places are shuffled for the count; texts move once, to meet the
places. Counts are combined before they are shuffled (a document counts once per hash, then hashes are counted), and a
line that a great share of the documents hold is one hot key of a join on its hash, which adaptive execution splits.

A document is told by its doc_id and a fingerprint of its text, not by a number of its row, so that the two reads of
the table need not split it alike. Hashes have 128 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.llm.store import Scratch, without

#: The white space that is stripped, and the letters that are lowered.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(SPACE)), UPPER, LOWER)


def _lines(text: Column) -> Column:
    """A null text is one empty line, as an empty one is."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def repeated_lines(docs: DataFrame, min_docs: int = 2, min_chars: int = 10) -> DataFrame:
    """``key, n_docs, owner``: keys of at least ``min_chars`` code points held by ``min_docs`` documents.

    ``key`` is the MD5 of the key text. The owner is the smallest doc_id that holds it; rows without doc_id count as one document and own nothing.
    """
    return _shared(_keyed(docs, min_chars), min_docs)


def _shared(keyed: DataFrame, min_docs: int) -> DataFrame:
    held = keyed.select("key", "doc_id").distinct()
    counted = held.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("owner"))
    return counted.where(F.col("n_docs") >= min_docs)


def _keyed(docs: DataFrame, min_chars: int) -> DataFrame:
    """``doc_id, text_key, place, key`` of the lines that are long enough to count."""
    text = F.col("text")
    exploded = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(_lines(text)).alias("place", "line"))
    keyed = exploded.withColumn("line", line_key(F.col("line"))).where(F.char_length("line") >= min_chars)
    return keyed.select("doc_id", "text_key", "place", F.unhex(F.md5("line")).alias("key"))


def drop_repeated_lines(docs: DataFrame, min_docs: int = 2, min_chars: int = 10) -> DataFrame:
    """Every row of ``docs`` with ``kept`` (the other lines, joined by a line feed), ``n_lines`` and ``n_dropped``.

    Keys of at least ``min_chars`` code points that at least ``min_docs`` distinct documents hold lose all their lines
    but those in the document of the smallest doc_id. Documents are told apart by doc_id: rows that repeat one count as
    one document, and so do all rows without doc_id, which own a line only among themselves. Null and empty texts are
    one empty line, which is too short to go. Other columns stay, but for any named like a new one.
    """
    own = without(docs, "kept", "n_lines", "n_dropped", "text_key", "gone", "_id")
    # written, as both the count and the join read it: a hash and two numbers a line
    lines = Scratch(docs.sparkSession, "lines").write(_keyed(docs.select("doc_id", "text"), min_chars), "keyed")
    shared = _shared(lines, min_docs).select("key", "owner")
    dropped = lines.join(shared, "key").where("owner is not null and not (doc_id <=> owner)")
    gone = dropped.groupBy("doc_id", "text_key").agg(F.collect_set("place").alias("gone")).withColumnRenamed("doc_id", "_id")
    told = own.withColumn("text_key", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (told["text_key"] == gone["text_key"])
    joined = told.join(gone, same, "left").drop("text_key", "_id").withColumn("_lines", _lines(F.col("text")))
    places = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.coalesce("gone", F.array().cast("array<int>")))
    rest = F.transform(F.array_sort(places), lambda i: F.get("_lines", i))
    return joined.withColumns({
        "kept": F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(rest, "\n")),
        "n_lines": F.size("_lines").cast("long"),
        "n_dropped": F.coalesce(F.size("gone"), F.lit(0)).cast("long"),
    }).drop("_lines", "gone")
