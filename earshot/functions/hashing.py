"""Reproducible pseudo-randomness and stable identifiers.

Random choices are a function of (seed, row id), never of row order, so a lost
task recomputes the same rows and any engine can repeat the draw.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def order_key(seed, *cols) -> Column:
    """Hex digest whose order is a seeded shuffle of the rows."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[_col(c).cast("string") for c in cols]))


def uniform_of(digest: Column) -> Column:
    """Uniform number in [0, 1) from the last eight hex digits of a digest."""
    return F.conv(F.substring(digest, -8, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def uniform(seed, *cols) -> Column:
    return uniform_of(order_key(seed, *cols))


# Fixed value: size of the hash space that decides a file's split.
HASH_SPLIT_SPACE = 2**27


def hash_split(name: Column, validation_pct: float, testing_pct: float) -> Column:
    """training / validation / testing from the SHA-1 of the file's base name.

    Everything from ``_nohash_`` on is ignored, so variants of one recording
    share a split. 2**27 divides 2**28, hence the last seven hex digits suffice.
    """
    base = F.regexp_replace(F.element_at(F.split(name, "/"), -1), "_nohash_.*$", "")
    slot = F.conv(F.substring(F.sha1(base), -7, 7), 16, 10).cast("bigint") % F.lit(HASH_SPLIT_SPACE)
    pct = slot * F.lit(100.0 / (HASH_SPLIT_SPACE - 1))
    return (
        F.when(pct < validation_pct, "validation")
        .when(pct < validation_pct + testing_pct, "testing")
        .otherwise("training")
    )


def stable_id(utt: Column, start: Column, end: Column, category: Column) -> Column:
    text = F.format_string("%s:%.3f:%.3f:%s", utt, start, end, category)
    return F.substring(F.sha1(text), 1, 12)


def clip_path(utt: Column, start: Column, end: Column, category: Column) -> Column:
    name = F.format_string("%s_%.2f_%.2f_%s.wav", utt, start, end, stable_id(utt, start, end, category))
    return F.concat_ws("/", F.lit("wavs"), category, name)
