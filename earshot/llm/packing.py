"""Documents packed into fixed sequences along a Hilbert curve.

A document's hashed vector (its token counts) is projected to four dimensions by random signs; the Hilbert key of the
projected point orders the documents, so that neighbours in the packed stream are alike. The rows are range-sorted by
(key, row), running token counts are carried over the ranges, and the stream of all tokens is cut every ``length``
tokens: only the last sequence is not full. A key that many rows share is split between ranges by its second part.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm import rolling
from earshot.llm.byte_bpe import encoder
from earshot.llm.store import Scratch, arrow_map, text_chunks, with_row_key

CHUNK_BYTES = 1 << 19
DIMENSIONS, BITS = 4, 12
#: Spread of the projected means over the grid.
STRETCH = 4.0


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Place of integer points (rows) along the Hilbert curve of a grid with ``bits`` bits per dimension."""
    x = points.astype(np.int64).copy()
    n = x.shape[1]
    # undo the rotations and reflections of the sub-cubes, from the coarsest bit down
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            turned = (x[:, i] & q) != 0
            x[turned, 0] ^= low
            swap = np.where(turned, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= swap
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    parity = np.zeros(len(x), dtype=np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        parity ^= np.where((x[:, n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= parity[:, None]
    key = np.zeros(len(x), dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[:, i] >> b & 1)
    return key


def curve_keys(ids: np.ndarray, counts: np.ndarray, vocabulary: int = 1 << 16) -> np.ndarray:
    """Hilbert keys of rows given by their token ids; a row without ids has the centre's key."""
    signs = np.random.default_rng(11).integers(0, 2, (vocabulary, DIMENSIONS), dtype=np.int8) * 2 - 1
    sums = np.zeros((len(counts), DIMENSIONS))
    some = counts > 0
    if some.any():
        first = (np.cumsum(counts) - counts)[some]
        for d in range(DIMENSIONS):
            sums[some, d] = np.add.reduceat(signs[ids, d].astype(np.int64), first)
    mean = sums / np.maximum(counts, 1)[:, None]
    grid = np.clip((np.tanh(STRETCH * mean) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1)
    return hilbert_keys(grid.astype(np.int64), BITS)


def _tokenised(docs: DataFrame, ranks_path: str, pattern: str, end_id: int) -> DataFrame:
    """``row_key, doc_id, n, curve, ids`` (little-endian 16-bit ids with the closing one)."""

    def run(batch):
        words = encoder(ranks_path, pattern)
        texts = batch.column(2)
        for begin, end in text_chunks(texts, CHUNK_BYTES):
            ids, counts = words.encode(*rolling.buffer_of(texts, begin, end))
            curve = curve_keys(ids, counts)
            ids = np.insert(ids, np.cumsum(counts), end_id).astype("<u2")
            ends = 2 * np.cumsum(counts + 1)
            raw = ids.tobytes()
            lines = pa.array([raw[e - 2 * (c + 1) : e] for e, c in zip(ends.tolist(), counts.tolist(), strict=True)], pa.binary())
            cut = slice(begin, end)
            yield pa.record_batch(
                [batch.column(0)[cut], batch.column(1)[cut], counts + 1, curve, lines], names=["row_key", "doc_id", "n", "curve", "ids"]
            )

    return arrow_map(docs.select("row_key", "doc_id", "text"), run, "row_key long, doc_id long, n long, curve long, ids binary")


def _places(tokens: DataFrame, scratch: Scratch) -> DataFrame:
    """``row_key, place``: tokens that precede the row in curve order."""
    ranges = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        range_no, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(1).to_numpy()
            before = total + np.cumsum(n) - n
            total += int(n.sum())
            yield pa.record_batch([batch.column(0), np.full(len(n), range_no), before, n], names=["row_key", "range", "before", "n"])

    ordered = tokens.select("row_key", "n", "curve").repartitionByRange(ranges, "curve", "row_key").sortWithinPartitions("curve", "row_key")
    placed = scratch.write(
        ordered.select("row_key", "n").mapInArrow(run, "row_key long, range long, before long, n long"), "places"
    )
    # one number per range: at most as many as there are shuffle partitions
    totals = {r["range"]: r["n"] for r in placed.groupBy("range").agg(F.sum("n").alias("n")).collect()}
    starts, at = [], 0
    for r in range(ranges):
        starts.append(at)
        at += totals.get(r, 0)
    first = tokens.sparkSession.createDataFrame(list(enumerate(starts)), "range long, first long")
    return placed.join(F.broadcast(first), "range").select("row_key", (F.col("before") + F.col("first")).alias("place"))


def pack(docs: DataFrame, ranks_path: str, pattern: str, length: int = 1024, end_id: int = 0) -> DataFrame:
    """Pieces of ``docs`` (``doc_id``, ``text``) in sequences of ``length`` tokens.

    ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``: the piece holds the ids from ``start`` on of its
    row, at ``offset`` in its sequence; ``ids`` are little-endian 16-bit. A row is its ids and then ``end_id``; null and
    empty texts are ``end_id`` alone. Repeated rows and rows without doc_id are packed like any other. ``docs`` is
    read once.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    keyed = with_row_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")))
    tokens = scratch.write(_tokenised(keyed, ranks_path, pattern, end_id), "tokens")

    def run(batch):
        out: list[tuple] = []
        doc, n, place = (batch.column(i).to_pylist() for i in (0, 1, 3))
        size = 0
        for k, raw in enumerate(batch.column(2)):
            ids, start = raw.as_buffer(), 0
            while start < n[k]:
                sequence, offset = divmod(place[k] + start, length)
                size_here = min(n[k] - start, length - offset)
                out.append((doc[k], start, size_here, ids.slice(2 * start, 2 * size_here).to_pybytes(), n[k], sequence, offset))
                start += size_here
                size += 1
                if size >= 4096:
                    yield _piece_batch(out)
                    out, size = [], 0
        if out:
            yield _piece_batch(out)

    placed = tokens.select("row_key", "doc_id", "n", "ids").join(_places(tokens, scratch), "row_key")
    return arrow_map(placed.select("doc_id", "n", "ids", "place"), run, _PIECE)


_PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_PIECE_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PIECE_TYPES, strict=True)], names=names)


def ids_crc32(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``ids_crc32`` (of the ids as little-endian 32-bit numbers) in place of ``ids``."""

    def run(batch):
        sums = [zlib.crc32(np.frombuffer(x.as_buffer(), "<u2").astype("<u4").tobytes()) for x in batch.column(3)]
        columns = [batch.column(i) for i in range(7)]
        columns[3] = pa.array(sums, pa.int64())
        yield pa.record_batch(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return arrow_map(pieces, run, _PIECE.replace("ids binary", "ids_crc32 long"))
