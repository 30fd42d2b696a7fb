"""Bytes of repeated passages, by bucket-pointer refinement of content-chosen suffixes.

A suffix is kept for every place where the hash of the next ``q`` bytes is the leftmost minimum of a window; each
string of ``window`` bytes holds such a place at the same offset in all its copies, so the suffixes in between need no
sorting. The windows that have their minimum at suffix ``a`` start at ``a - l`` for ``l`` in a range.

Suffixes start in buckets of equal ``q``-grams. A bucket is then refined by the identifiers of the strings at earlier
and later offsets of its members: a cell of starts ``l1..l2`` is decided by two identifiers, of the bytes that all its
windows share (alone in its bucket: no window is repeated) and of the bytes that they cover together (not alone: every
window is). Undecided cells are split and refined again, with the bucket of the level before as their candidates, down
to single windows. Identifiers are 64-bit fingerprints, so that no rank has to be known globally; buckets are formed by
Spark's shuffle and sort.

Buckets held by a great share of the rows are found on a sample of the rows (which decides only where rows go, never the
result) and are split: their members are known to be repeated, so they are dealt out by the finer identifier.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earshot.llm import rolling
from earshot.llm.store import Scratch, arrow_map, numbered, text_chunks, without

CHUNK_BYTES = 1 << 19
#: Starts per cell on the middle level.
CELL = 14
SAMPLE_ONE_IN = 16
HEAVY_IN_SAMPLE = 128
SALTS = 64

_SEGMENTS = "row_key long, a long, lmin int, lmax int, core long, full long"


def choose_suffixes(data: np.ndarray, offsets: np.ndarray, window: int, q: int):
    """Suffix starts, their first and last window start, over all windows inside one row."""
    n, width = len(data), window - q + 1
    if n < window:
        return None
    prefix = rolling.prefix_hashes(data)
    m = n - q + 1
    grams = prefix[q:] - prefix[:-q]
    grams *= rolling.powers(n + 1)[1][:m]
    grams = rolling.mix(grams)
    # leftmost minimum of every `width` neighbours: minima from both ends of blocks, place in the low bits
    bits = int(2 * width - 1).bit_length()
    low = np.uint64((1 << bits) - 1)
    key = np.full(-(-m // width) * width, np.iinfo(np.uint64).max, np.uint64)
    key[:m] = grams
    key &= ~low
    key = key.reshape(-1, width)
    place = np.arange(width, dtype=np.uint64)
    from_right = np.minimum.accumulate((key | place)[:, ::-1], axis=1)[:, ::-1].ravel()
    from_left = np.minimum.accumulate(key | (place + np.uint64(width)), axis=1).ravel()
    starts = n - window + 1
    least = np.minimum(from_right[:starts], from_left[width - 1 : width - 1 + starts])
    block = np.arange(starts) // width * width
    aligned = block == np.arange(starts)
    least[aligned] = from_right[:starts][aligned]
    chosen = (least & low).astype(np.int64) + block
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    ok = np.flatnonzero(row[:starts] == row[window - 1 :])
    if not len(ok):
        return None
    chosen, rows = chosen[ok], row[ok]
    new = np.flatnonzero(np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (rows[1:] != rows[:-1]))))
    last = ok[np.concatenate((new[1:] - 1, [len(ok) - 1]))]
    return prefix, rows[new], chosen[new], ok[new], last


def cell_identifiers(prefix, a, lmin, lmax, cell: int, window: int, q: int):
    """One entry per cell that a range of starts touches: which suffix, clipped range, both identifiers."""
    first = lmin // cell
    count = lmax // cell - first + 1
    of = np.repeat(np.arange(len(a)), count)
    grid = np.repeat(first, count) + rolling.ragged_arange(count)
    low, high = grid * cell, np.minimum(grid * cell + cell - 1, window - q)
    at = a[of]
    core = rolling.substring_hashes(prefix, at - low, at - high + window)
    core = rolling.mix(core + grid.astype(np.uint64) * rolling.BASE + np.uint64(cell))
    low, high = np.maximum(low, lmin[of]), np.minimum(high, lmax[of])
    full = rolling.substring_hashes(prefix, at - high, at - low + window)
    full = rolling.mix(full + low.astype(np.uint64) * rolling.BASE + high.astype(np.uint64) * rolling.BASE_INVERSE)
    return of, low, high, core.view(np.int64), full.view(np.int64)


def _pieces(column: pa.Array, begin: int, end: int, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Bytes, row starts and the byte where the piece begins in its row; long rows come in overlapping pieces."""
    data, offsets = rolling.buffer_of(column, begin, end)
    if end - begin > 1 or len(data) <= 2 * CHUNK_BYTES + window:
        yield data, offsets, 0
        return
    for base in range(0, len(data) - window + 1, CHUNK_BYTES):
        part = data[base : base + CHUNK_BYTES + window - 1]
        yield part, np.array([0, len(part)]), base


def _first_segments(docs: DataFrame, window: int, q: int) -> DataFrame:
    def run(batch):
        keys, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        for begin, end in text_chunks(texts, CHUNK_BYTES):
            for data, offsets, base in _pieces(texts, begin, end, window):
                found = choose_suffixes(data, offsets, window, q)
                if found is None:
                    continue
                prefix, rows, a, first, last = found
                _, low, high, core, full = cell_identifiers(prefix, a, a - last, a - first, window - q + 1, window, q)
                yield pa.record_batch(
                    [keys[begin + rows], a - offsets[rows] + base, low.astype(np.int32), high.astype(np.int32), core, full],
                    names=["row_key", "a", "lmin", "lmax", "core", "full"],
                )

    return arrow_map(docs, run, _SEGMENTS)


def refine(segments: DataFrame, sample: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Segments whose bucket has other members: repeated (``done``) and what the next level looks at (``onward``).

    One member of a repeated class goes on too where its bucket has undecided members, as their counterpart.
    """
    # at most sampled segments / HEAVY_IN_SAMPLE keys; written, so that Spark knows their size before it plans the joins
    counts = lambda c: scratch.write(
        sample.groupBy(c).count().where(F.col("count") >= HEAVY_IN_SAMPLE).select(c, F.lit(True).alias(f"heavy_{c}")),
        f"{name}-heavy-{c}",
    )
    marked = segments.join(counts("core"), "core", "left").join(counts("full"), "full", "left")
    heavy = F.col("heavy_core").isNotNull()
    # members of a core are dealt by `full` all or none: else they would not meet
    same = heavy & F.col("heavy_full").isNotNull()
    dealt = marked.select(
        "row_key", "a", "lmin", "lmax", "core", "full", heavy.alias("heavy"), same.alias("same"),
        F.when(same, F.xxhash64("full", F.pmod(F.xxhash64("row_key", "a"), F.lit(SALTS))))
        .when(heavy, F.col("full")).otherwise(F.col("core")).alias("bucket"),
    )
    bucket, cls = Window.partitionBy("bucket"), Window.partitionBy("bucket", "full")
    return (
        dealt.withColumn("n", F.count(F.lit(1)).over(bucket))
        .where("n > 1 or heavy or same")
        .withColumn("n_full", F.count(F.lit(1)).over(cls))
        .withColumn("nth", F.row_number().over(cls.orderBy("row_key", "a", "lmin")))
        .withColumn("done", F.expr("n_full > 1 or same"))
        .withColumn("open", F.sum(F.expr("int(not done)")).over(bucket))
        .withColumn("onward", F.expr("not done or (nth = 1 and (open > 0 or heavy or same))"))
        .select("row_key", "a", "lmin", "lmax", "done", "onward")
    )


def _contexts(docs: DataFrame, open_: DataFrame, window: int) -> DataFrame:
    """The bytes that each open suffix needs, cut from its row."""
    wanted = open_.groupBy("row_key").agg(F.collect_list(F.struct("a", "lmin", "lmax")).alias("wanted"))

    def run(batch):
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        texts = batch.column(1).cast(pa.large_binary())
        offsets, flat = batch.column(2).offsets.to_numpy(), batch.column(2).flatten()
        offsets = offsets - offsets[0]
        a, low, high = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
        row = np.repeat(np.arange(len(keys)), np.diff(offsets))
        step = 1 + CHUNK_BYTES // (2 * window)
        for begin in range(0, len(a), step):
            cut = slice(begin, begin + step)
            views = {r: memoryview(texts[r].as_buffer()) for r in np.unique(row[cut])}
            context = [bytes(views[r][i - h : i - m + window]) for r, i, m, h in zip(row[cut], a[cut], low[cut], high[cut], strict=True)]
            yield pa.record_batch(
                [keys[row[cut]], a[cut], low[cut].astype(np.int32), high[cut].astype(np.int32), pa.array(context, pa.binary())],
                names=["row_key", "a", "lmin", "lmax", "context"],
            )

    joined = docs.join(wanted, "row_key").select("row_key", "text", "wanted")
    return arrow_map(joined, run, "row_key long, a long, lmin int, lmax int, context binary")


def _segments_of(contexts: DataFrame, cell: int, window: int, q: int) -> DataFrame:
    """Cells of the ranges ``lmin..lmax``; ``top`` is the start of the context before its suffix."""

    def run(batch):
        for begin, end in text_chunks(batch.column(5), CHUNK_BYTES):
            data, offsets = rolling.buffer_of(batch.column(5), begin, end)
            key, a, low, high, top = (batch.column(i).slice(begin, end - begin).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5))
            here = offsets[:-1] + top
            of, low, high, core, full = cell_identifiers(rolling.prefix_hashes(data), here, low, high, cell, window, q)
            yield pa.record_batch(
                [key[of], a[of], low.astype(np.int32), high.astype(np.int32), core, full],
                names=["row_key", "a", "lmin", "lmax", "core", "full"],
            )

    return arrow_map(contexts.select("row_key", "a", "lmin", "lmax", "top", "context"), run, _SEGMENTS)


def _sampled(df: DataFrame) -> DataFrame:
    return df.where(F.pmod(F.xxhash64("row_key"), F.lit(SAMPLE_ONE_IN)) == 0)


def repeated_spans(docs: DataFrame, window: int = 400, scratch: Scratch | None = None) -> DataFrame:
    """Byte ranges covered by repeated strings: row_key, begin, end (they may overlap).

    ``docs`` has ``row_key`` (a number that repeated reads give alike) and ``text``.
    """
    scratch = scratch or Scratch(docs.sparkSession, "suffixes")
    q = window // 2
    level = scratch.write(refine(_first_segments(docs, window, q), _first_segments(_sampled(docs), window, q), scratch, "bucketed"), "bucketed")
    span = [F.col("row_key"), (F.col("a") - F.col("lmax")).alias("begin"), (F.col("a") - F.col("lmin") + window).alias("end")]
    spans = level.where("done").select(*span)
    contexts = scratch.write(
        _contexts(docs, level.where("onward"), window).withColumn("top", F.col("lmax")), "contexts"
    )
    cells = _segments_of(contexts, CELL, window, q)
    level = scratch.write(refine(cells, _sampled(cells), scratch, "cells"), "cells")
    spans = spans.union(level.where("done").select(*span))
    # the two ranges of a suffix cut between pieces of a long row are told apart by their bounds
    narrowed = (
        level.where("onward").alias("c").join(contexts.alias("x"), ["row_key", "a"])
        .where("c.lmin >= x.lmin and c.lmax <= x.lmax")
        .select("row_key", "a", "c.lmin", "c.lmax", F.expr("c.lmax").alias("top"),
                F.expr(f"substring(context, int(x.lmax - c.lmax + 1), int(c.lmax - c.lmin + {window}))").alias("context"))
    )
    windows = _segments_of(narrowed, 1, window, q)
    singles = refine(windows, _sampled(windows), scratch, "windows")
    return spans.union(singles.where("done").select(*span))


def remove_repeats(docs: DataFrame, window: int = 400, as_text: bool = False) -> DataFrame:
    """Every row of ``docs`` with ``kept`` (remaining bytes), ``n_bytes``, ``n_removed`` and ``n_spans``.

    With ``as_text`` ``kept`` is a string, less the parts of characters that a cut has left.

    Removes each byte that lies in a string of ``window`` bytes which starts somewhere else too, the same row
    included. Null and shorter texts lose nothing (null: no bytes). Repeated rows remove each other. Other columns stay,
    but for any named like a new one. The rows are numbered and written once; every pass reads that table.
    """
    scratch = Scratch(docs.sparkSession, "suffixes")
    keyed = numbered(without(docs, "row_key", "spans", "kept", "n_bytes", "n_removed", "n_spans"), scratch)
    spans = repeated_spans(keyed.select("row_key", F.col("text")), window, scratch)
    merged = spans.groupBy("row_key").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    joined = keyed.join(merged, "row_key", "left").drop("row_key")
    kept_in = len(joined.columns) - 1
    text_at = joined.columns.index("text")

    def run(batch):
        texts = batch.column(text_at).cast(pa.large_binary())
        lists = batch.column(kept_in)
        kept, n_bytes, n_removed, n_spans = [], [], [], []
        for i in range(batch.num_rows):
            text = texts[i].as_py() or b""
            n_bytes.append(len(text))
            if not lists[i].is_valid:
                kept.append(text)
                n_removed.append(0)
                n_spans.append(0)
                continue
            flat = lists[i].values
            begin, end = (flat.field(k).to_numpy() for k in (0, 1))
            order = np.argsort(begin, kind="stable")
            begin, reach = begin[order], np.maximum.accumulate(end[order])
            new = np.flatnonzero(np.concatenate(([True], begin[1:] > reach[:-1])))
            begin, end = begin[new], reach[np.concatenate((new[1:] - 1, [len(reach) - 1]))]
            edges = [0, *np.column_stack((begin, end)).ravel().tolist(), len(text)]
            rest = b"".join(text[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2))
            kept.append(rest)
            n_removed.append(len(text) - len(rest))
            n_spans.append(len(begin))
        columns = [batch.column(i) for i in range(kept_in)]
        if as_text:
            kept = [x.decode("utf-8", "ignore") for x in kept]
        columns += [pa.array(kept, pa.string() if as_text else pa.binary()), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans))]
        yield pa.record_batch(columns, names=[f"c{i}" for i in range(len(columns))])

    kinds = [f.dataType.simpleString() for f in joined.schema.fields[:-1]]
    schema = ", ".join(f"c{i} {k}" for i, k in enumerate([*kinds, "string" if as_text else "binary", "long", "long", "long"]))
    names = [*joined.columns[:-1], "kept", "n_bytes", "n_removed", "n_spans"]
    return arrow_map(joined, run, schema).toDF(*names)

