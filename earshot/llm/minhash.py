"""Near-duplicate documents by HyperMinHash: compressed registers, banding, corrected estimate, exact verification.

Every shingle falls into one of the buckets of its document; a bucket keeps the leading-zero count (4 bits) and the
next bits (4) of its least hash value. Empty buckets borrow another bucket's value in an order fixed per bucket.
Bands of registers propose candidates. A candidate's Jaccard similarity is estimated from equal registers, less the
share that is equal by chance at the two set sizes. Groups of candidates then meet with their full sets, where every
pair is decided exactly by counting common shingles through an inverted list.

Neither candidates nor links are listed as pairs: within a group only the links of a spanning forest are returned,
which give the same components. Large buckets and groups are cut into blocks, and each pair of blocks is a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm import rolling
from earshot.llm.components import components
from earshot.llm.store import Forest, Scratch, arrow_map, grouped, numbered, text_chunks, without

CHUNK_BYTES = 1 << 19
BANDS, ROWS = 25, 5
BASE_SALTS = (0x3C6EF372FE94F82B, 0xDAA66D2B57FD3A13)
REGISTERS = BANDS * ROWS
#: Registers are equal with probability J; the estimate of 125 registers at J = 0.85 strays 0.032 (one sigma).
SLACK_SIGMAS = 6
#: Members of a block in a bucket of signatures; members and shingles of a block of full sets.
BUCKET_BLOCK = 4096
SET_BLOCK, SET_BLOCK_SHINGLES = 1024, 2_000_000

_LOANS = np.argsort(np.random.default_rng(7).random((REGISTERS, REGISTERS)), axis=1)


def distinct_shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every row, and their number."""
    hashes, counts = rolling.shingle_hashes(data, offsets, size)
    row = np.repeat(np.arange(len(counts)), counts)
    order = np.argsort(hashes)
    order = order[np.argsort(row[order], kind="stable")]
    hashes, row = hashes[order], row[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[new], np.bincount(row[new], minlength=len(counts))


def set_names(hashes: np.ndarray, row: np.ndarray, n: int, salt: int) -> np.ndarray:
    """A fingerprint of each row's set."""
    total = np.zeros(n, dtype=np.uint64)
    np.add.at(total, row, rolling.mix(hashes + np.uint64(salt)))
    return total.view(np.int64)


def registers(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """HyperMinHash registers, one byte each, for rows with at least one shingle (others: zeros)."""
    n = len(counts)
    row = np.repeat(np.arange(n), counts)
    mixed = rolling.mix(hashes * rolling.BASE)
    slot = row * REGISTERS + ((mixed >> np.uint64(40)) % np.uint64(REGISTERS)).astype(np.int64)
    value = (mixed & np.uint64((1 << 40) - 1)).astype(np.int64)
    least = np.full(n * REGISTERS, 1 << 40, dtype=np.int64)
    np.minimum.at(least, slot, value)
    least = least.reshape(n, REGISTERS)
    bits = np.frexp(np.maximum(least, 1).astype(np.float64))[1]
    zeros = np.minimum(40 - bits, 15)
    mantissa = (least << zeros >> 35) & 15  # the four bits after the leading one
    out = ((zeros << 4) | mantissa).astype(np.uint8)
    empty = least == 1 << 40
    todo = np.flatnonzero(empty.any(axis=1) & ~empty.all(axis=1))
    filled = out[todo]
    missing = empty[todo]
    for step in range(REGISTERS):
        lender = _LOANS[:, step]
        take = missing & ~empty[todo][:, lender]
        filled[take] = out[todo][:, lender][take]
        missing &= ~take
        if not missing.any():
            break
    out[todo] = filled
    out[empty.all(axis=1)] = 0
    return out


def chance_of_equal(n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Probability that two registers over disjoint sets of these sizes agree."""
    s1, s2 = np.maximum(n1 / REGISTERS, 0.5), np.maximum(n2 / REGISTERS, 0.5)
    total = np.zeros(np.broadcast(s1, s2).shape)
    for zeros in range(16):
        low, high = (0.0 if zeros == 15 else 2.0 ** -(zeros + 1)), 2.0**-zeros
        cells = np.linspace(low, high, 17)
        for u, v in zip(cells[:-1], cells[1:], strict=True):
            total += (np.exp(-s1 * u) - np.exp(-s1 * v)) * (np.exp(-s2 * u) - np.exp(-s2 * v))
    return total


def estimate(sig: np.ndarray, sizes: np.ndarray, one: int, others: np.ndarray) -> np.ndarray:
    """Jaccard estimates of row ``one`` against ``others``, corrected for chance."""
    equal = (sig[others] == sig[one]).mean(axis=1)
    chance = np.interp(np.log(sizes[others]), _LOG_SIZES, _chance_row(sizes[one]))
    return (equal - chance) / (1 - chance)


_LOG_SIZES = np.log(2.0 ** np.arange(0, 40))
_rows: dict[int, np.ndarray] = {}


def _chance_row(size: int) -> np.ndarray:
    step = round(float(np.log2(max(size, 1))) * 4)
    if step not in _rows:
        _rows[step] = chance_of_equal(np.full(40, 2.0 ** (step / 4)), np.exp(_LOG_SIZES))
    return _rows[step]


def _sketches(docs: DataFrame, shingle: int) -> DataFrame:
    def run(batch):
        row_key, ids, texts = batch.columns
        for begin, end in text_chunks(texts, CHUNK_BYTES):
            hashes, counts = distinct_shingles(*rolling.buffer_of(texts, begin, end), shingle)
            row = np.repeat(np.arange(len(counts)), counts)
            names = [set_names(hashes, row, len(counts), salt) for salt in BASE_SALTS]
            sig = registers(hashes, counts)
            yield pa.record_batch(
                [row_key.slice(begin, end - begin), ids.slice(begin, end - begin), counts.astype(np.int64), *names, pa.array([x.tobytes() for x in sig], pa.binary())],
                names=["row_key", "doc_id", "n_shingles", "name", "name2", "sig"],
            )

    return arrow_map(docs, run, "row_key long, doc_id long, n_shingles long, name long, name2 long, sig binary")


def _bands(sets: DataFrame) -> DataFrame:
    """One row per set and band."""

    def run(batch):
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, REGISTERS).astype(np.uint64)
        key = np.zeros((len(sig), BANDS), dtype=np.uint64)
        for r in range(ROWS):
            key = key * np.uint64(256) + sig[:, r::ROWS]
        key = rolling.mix(key * np.uint64(BANDS) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
        yield pa.record_batch([key.ravel(), np.repeat(batch.column(0).to_numpy(), BANDS)], names=["band", "name"])

    return arrow_map(sets.select("name", "sig"), run, "band long, name long")


def _block_pairs(df: DataFrame, key: str, node: str, n_blocks) -> DataFrame:
    """Rows copied to each pair of blocks that theirs is in: columns ``i <= j``, ``side`` 0 for block i."""
    own = F.pmod(F.xxhash64(node), F.col("_blocks"))
    return (
        df.withColumn("_blocks", n_blocks).withColumn("_own", own)
        .withColumn("_other", F.explode(F.expr("sequence(0, int(_blocks) - 1)")))
        .withColumns({"i": F.least("_own", "_other").cast("int"), "j": F.greatest("_own", "_other").cast("int"),
                      "side": F.expr("int(_own > _other)")})
        .drop("_blocks", "_own", "_other")
    )


def _candidate_forest(members: DataFrame, cut: float) -> DataFrame:
    """Spanning links between members of a bucket whose estimate reaches ``cut``."""

    def run(rows, bounds):
        name, size = rows["name"].to_numpy(), rows["n_shingles"].to_numpy()
        sig = np.frombuffer(b"".join(rows["sig"].to_pylist()), np.uint8).reshape(-1, REGISTERS)
        left, right = [], []
        for begin, end in bounds:
            forest = Forest(end - begin)
            s, z = sig[begin:end], size[begin:end]
            for k in range(end - begin - 1):
                rest = np.flatnonzero(forest.label[k + 1 :] != forest.label[k]) + k + 1
                if len(rest):
                    forest.join(k, rest[estimate(s, z, k, rest) >= cut])
            left += [name[begin + a] for a, _ in forest.links]
            right += [name[begin + b] for _, b in forest.links]
        if left:
            yield pa.record_batch([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return grouped(members, ["band", "i", "j"], run, "a long, b long")


def _linked(hashes: np.ndarray, starts: np.ndarray, side: np.ndarray, cross: bool, percent: int) -> list[tuple[int, int]]:
    """Spanning links of sets with 100 * common >= percent * union, decided on the full sets."""
    n = len(starts) - 1
    sizes = np.diff(starts)
    forest = Forest(n)
    ids, codes = np.unique(hashes, return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    listed = np.flatnonzero(side[owner] == 1) if cross else np.arange(len(owner))
    order = listed[np.argsort(codes[listed], kind="stable")]
    posting = np.searchsorted(codes[order], np.arange(len(ids) + 1))
    holders = owner[order]
    for x in np.flatnonzero(side == 0) if cross else range(n):
        if cross or x < n - 1:
            open_ = forest.label != forest.label[x]
            if not open_.any():
                continue
            mine = codes[starts[x] : starts[x + 1]]
            count = posting[mine + 1] - posting[mine]
            common = np.bincount(holders[np.repeat(posting[mine], count) + rolling.ragged_arange(count)], minlength=n)
            union = sizes + sizes[x] - common
            hit = open_ & (common > 0) & (100 * common >= percent * union)
            hit[x] = False
            if hit.any():
                forest.join(int(x), np.flatnonzero(hit))
    return forest.links


def _verified_forest(members: DataFrame, shingle: int, percent: int) -> DataFrame:
    def run(rows, bounds):
        left, right = [], []
        names, sides = rows["name"].to_numpy(), rows["side"].to_numpy()
        texts = rows["text"].combine_chunks()
        texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
        for begin, end in bounds:
            parts, counts = [], []
            for b, e in text_chunks(texts.slice(begin, end - begin), CHUNK_BYTES):
                h, c = distinct_shingles(*rolling.buffer_of(texts, begin + b, begin + e), shingle)
                parts.append(h)
                counts.append(c)
            starts = np.concatenate(([0], np.cumsum(np.concatenate(counts))))
            side = sides[begin:end]
            for a, b in _linked(np.concatenate(parts), starts, side, bool(side.any()), percent):
                left.append(names[begin + a])
                right.append(names[begin + b])
        if left:
            yield pa.record_batch([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return grouped(members, ["cluster", "i", "j"], run, "a long, b long", max_rows=200)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``row_key, doc_id, n_shingles, component_id, kept, first`` for every row of ``docs`` (``doc_id``, ``text``).

    Documents are linked when 100 * |A & B| >= percent * |A | B| for their sets of distinct ``shingle``-word runs. A
    text of fewer words is one run; without words (or null) it has none and is linked with nothing. ``component_id``
    is the smallest doc_id reachable; ``kept`` says that it is the row's own. Repeated rows share their component, so
    repeated rows with one doc_id are all kept or all not; ``first`` holds for exactly one row of every component, and
    for every row that links nothing. A row without doc_id links nothing and has a null component and ``kept`` null.
    ``row_key`` numbers the rows; they are numbered and written once, and every pass reads that table.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    return _grouped(numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")), scratch), shingle, percent, scratch)


def first_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that are first in their component (see ``near_duplicates``), with all their columns."""
    scratch = Scratch(docs.sparkSession, "minhash")
    rows = numbered(without(docs, "row_key"), scratch)
    known = rows.select("row_key", F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = _grouped(known, shingle, percent, scratch).where("first").select("row_key")
    return rows.join(first, "row_key", "left_semi").drop("row_key")


def _grouped(docs: DataFrame, shingle: int, percent: int, scratch: Scratch) -> DataFrame:
    rows = scratch.write(_sketches(docs.select("row_key", "doc_id", "text"), shingle), "sketches")
    named = rows.where("doc_id is not null and n_shingles > 0")
    sets = scratch.write(
        named.groupBy("name", "name2").agg(F.min(F.struct("doc_id", "row_key")).alias("head"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
        .select("name", "name2", F.col("head.doc_id").alias("least"), F.col("head.row_key").alias("least_row"), "n_shingles", "sig"),
        "sets",
    )
    bands = _bands(sets)
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = bands.join(shared, "band").join(sets.select("name", "n_shingles", "sig"), "name")
    blocks = _block_pairs(members, "band", "name", F.ceil(F.col("n") / BUCKET_BLOCK))
    spread = (percent / 100 * (1 - percent / 100) / REGISTERS) ** 0.5
    maybe = _candidate_forest(
        blocks.select("band", "i", "j", "name", "n_shingles", "sig"), percent / 100 - SLACK_SIGMAS * spread
    )
    clusters = scratch.write(components(maybe, scratch, "candidates"), "clusters")
    placed = clusters.withColumnRenamed("node", "name").withColumnRenamed("component", "cluster").join(sets.select("name", "least_row", "n_shingles"), "name")
    sizes = placed.groupBy("cluster").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / SET_BLOCK), F.ceil(F.sum("n_shingles") / SET_BLOCK_SHINGLES)).alias("blocks")
    )
    placed = placed.join(sizes, "cluster").select("cluster", "name", "least_row", "blocks")
    # the text of one row for each set
    texts = scratch.write(docs.select(F.col("row_key").alias("least_row"), "text").join(placed, "least_row"), "texts")
    links = _verified_forest(
        _block_pairs(texts, "cluster", "name", F.col("blocks")).select("cluster", "i", "j", "side", "name", "text"), shingle, percent
    )
    linked = components(links, scratch, "links").withColumnRenamed("node", "name").withColumnRenamed("component", "head")
    classes = sets.select("name", "name2", F.struct("least", "least_row").alias("least")).join(linked, "name", "left").withColumn("head", F.coalesce("head", "name"))
    heads = classes.groupBy("head").agg(F.min("least").alias("owner"))
    owner = classes.join(heads, "head").select("name", "name2", F.col("owner.least").alias("component_id"), F.col("owner.least_row").alias("owner"))
    out = rows.drop("sig").join(owner, ["name", "name2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select(
        "row_key", "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
        F.when(F.col("doc_id").isNotNull(), component == F.col("doc_id")).alias("kept"),
        F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("row_key") == F.col("owner")).otherwise(True).alias("first"),
    )
