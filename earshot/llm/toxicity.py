"""Severity of toxic language by cumulative-link ordinal regression on sparse text features.

P(grade > k) = sigmoid(w . x - theta_k): one weight vector serves all ordered thresholds. Features are words and the
first four to six bytes of words (so that new endings of a known stem count), as log(1 + occurrences), each by its
64-bit hash. The model reports the expected grade, the sum of the P(grade > k).

The labels say only whether a text is toxic. Grade 0 is not toxic; toxic texts of the fit are graded 1 to ``GRADES`` - 1
by equal shares by how many of their words hold a marker.

The fit sees at most ``FIT_TOXIC`` toxic and ``FIT_OTHER`` other labelled rows, those with the least hash of their id
(weighted back to their share of the labels); markers are features that toxic texts hold significantly more often, at
most ``MAX_MARKERS``. All sizes of the fit are bounded by these parameters, so it runs on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earshot.llm import rolling
from earshot.llm.store import Scratch, arrow_map, text_chunks, without

CHUNK_BYTES = 1 << 19
FIT_TOXIC, FIT_OTHER = 4_000, 8_000
MAX_MARKERS = 4_096
#: Least log odds of a marker, and least number of toxic texts that hold it. Its likelihood ratio must be one that
#: less than one of all tested features would reach by chance.
MARKER_ODDS, MARKER_TEXTS = 2.0, 4
PREFIXES = (4, 5, 6)
#: Least shingle hashes by which near copies among the rows of the fit are found.
KEYS = 4
GRADES = 4
RIDGE = 1e-5
STEPS, STEP = 400, 0.1
FILTER_BITS = 22

#: Words are runs of ASCII letters, digits and bytes beyond ASCII.
GAP = np.ones(256, dtype=bool)
GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


@dataclass(frozen=True)
class Model:
    """Sorted marker hashes, their weights and the ordered thresholds."""

    markers: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def severity(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade, and the probability of any grade above 0."""
        above = 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -500, 500)))
        return above.sum(axis=1), above[:, 0] if len(self.thresholds) else np.zeros(len(scores))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all features, the word that each belongs to, and the row of every word."""
    data = rolling.LOWER[data]
    starts, ends, counts = rolling.word_bounds(data, offsets, GAP)
    prefix = rolling.prefix_hashes(data)
    row = np.repeat(np.arange(len(counts)), counts)
    hashes, words = [rolling.substring_hashes(prefix, starts, ends)], [np.arange(len(starts))]
    for size in PREFIXES:
        long = ends - starts > size
        cut = rolling.substring_hashes(prefix, starts[long], starts[long] + size)
        hashes.append(rolling.mix(cut + np.uint64(size)))
        words.append(np.flatnonzero(long))
    return np.concatenate(hashes), np.concatenate(words), row


def _marker_counts(hashes, words, row, markers, seen) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, marker and occurrences of features among ``markers``, and the row of every word with such a feature.

    ``seen`` is the bitmap of the markers' low hash bits.
    """
    near = np.flatnonzero(seen[(hashes & np.uint64(len(seen) - 1)).astype(np.int64)])
    at = np.minimum(np.searchsorted(markers, hashes[near]), len(markers) - 1)
    real = markers[at] == hashes[near]
    pair, n = np.unique(row[words[near][real]] * len(markers) + at[real], return_counts=True)
    return pair // len(markers), pair % len(markers), n, row[np.unique(words[near][real])]


def _bitmap(markers: np.ndarray) -> np.ndarray:
    seen = np.zeros(1 << FILTER_BITS, dtype=bool)
    seen[(markers & np.uint64(len(seen) - 1)).astype(np.int64)] = True
    return seen


def fit_rows(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """The labelled rows of the fit: ``text, toxic``, near copies only once.

    Of rows that share one of four least shingle hashes the first by doc_id stays: else the words of a text with many
    copies would pass for markers.
    """
    known = labels.where("doc_id is not null and toxic is not null").select("doc_id", F.expr("int(toxic > 0)").alias("toxic"))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = [known.where(f"toxic = {t}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for t, n in ((1, FIT_TOXIC), (0, FIT_OTHER))]
    # at most FIT_TOXIC + FIT_OTHER rows of two numbers
    sample = F.broadcast(chosen[0].union(chosen[1]))
    drawn = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sample, "doc_id")

    def run(batch):
        for begin, end in text_chunks(batch.column(1), CHUNK_BYTES):
            hashes, counts = rolling.shingle_hashes(*rolling.buffer_of(batch.column(1), begin, end), 3)
            some = counts > 0
            first = (np.cumsum(counts) - counts)[some]
            keys = np.zeros((KEYS, end - begin), dtype=np.uint64)
            keys[:, ~some] = rolling.mix(np.arange(begin, end, dtype=np.uint64))[None, ~some]
            for k in range(KEYS):
                if some.any():
                    keys[k, some] = np.minimum.reduceat(rolling.mix(hashes + np.uint64(k + 1)), first)
            part = batch.slice(begin, end - begin)
            yield pa.record_batch([*part.columns, *keys.view(np.int64)], names=["doc_id", "text", "toxic", *(f"k{k}" for k in range(KEYS))])

    keyed = ", ".join(f"k{k} long" for k in range(KEYS))
    rows = scratch.write(arrow_map(drawn.select("doc_id", "text", "toxic"), run, f"doc_id long, text string, toxic int, {keyed}"), "drawn")
    ids = rows.drop("text")
    for k in range(KEYS):
        ids = ids.withColumn(f"n{k}", F.row_number().over(Window.partitionBy(f"k{k}").orderBy("doc_id")))
    firsts = ids.where(" and ".join(f"n{k} = 1" for k in range(KEYS))).select("doc_id")
    return scratch.write(rows.select("doc_id", "text", "toxic").join(firsts, "doc_id", "left_semi"), "rows")


def _document_frequencies(rows: DataFrame) -> DataFrame:
    def run(batch):
        toxic = batch.column(1).to_numpy()
        for begin, end in text_chunks(batch.column(0), CHUNK_BYTES):
            hashes, words, row = features(*rolling.buffer_of(batch.column(0), begin, end))
            row = row[words]
            order = np.lexsort((row, hashes))
            hashes, row = hashes[order], row[order]
            new = np.ones(len(hashes), dtype=bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
            hashes, bad = hashes[new], toxic[begin + row[new]]
            ids, first = np.unique(hashes, return_index=True)
            n = np.diff(np.append(first, len(hashes)))
            pos = np.add.reduceat(bad.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
            yield pa.record_batch([ids.view(np.int64), pos, n - pos], names=["feature", "pos", "neg"])

    counted = arrow_map(rows.select("text", "toxic"), run, "feature long, pos long, neg long")
    return counted.groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _solve(row, marker, value, grade, weight, n_markers: int) -> tuple[np.ndarray, np.ndarray]:
    """Penalised likelihood of the cumulative-link model by gradient steps with momentum and scaling."""
    n, cuts = len(grade), int(grade.max(initial=0))
    shares = np.array([weight[grade > k].sum() / weight.sum() for k in range(cuts)])
    # thresholds are a first value and positive gaps
    theta = np.log((1 - shares) / shares)
    raw = np.concatenate((theta[:1], np.log(np.maximum(np.diff(theta), 1e-3)), np.zeros(n_markers)))
    mean, square = np.zeros_like(raw), np.zeros_like(raw)
    total = weight.sum()
    for step in range(1, STEPS + 1):
        gaps = np.exp(raw[1:cuts])
        theta = raw[0] + np.concatenate(([0.0], np.cumsum(gaps)))
        w = raw[cuts:]
        score = np.bincount(row, w[marker] * value, minlength=n)
        edges = np.concatenate(([-np.inf], theta, [np.inf]))
        low, high = (1 / (1 + np.exp(np.clip(score - edges[grade + k], -500, 500))) for k in (0, 1))
        p = np.maximum(high - low, 1e-12)
        d_low, d_high = low * (1 - low), high * (1 - high)
        by_score = weight * (d_high - d_low) / p / total
        by_theta = np.zeros(cuts)
        for k in range(cuts):
            by_theta[k] = (-(weight * d_high / p)[grade == k].sum() + (weight * d_low / p)[grade == k + 1].sum()) / total
        slope = np.concatenate(([by_theta.sum()], np.cumsum(by_theta[::-1])[::-1][1:] * gaps, np.bincount(marker, by_score[row] * value, minlength=n_markers) + RIDGE * w))
        mean = 0.9 * mean + 0.1 * slope
        square = 0.999 * square + 0.001 * slope**2
        # a marker never lowers the severity
        raw = raw - STEP * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        raw[cuts:] = np.maximum(raw[cuts:], 0)
    return raw[cuts:], raw[0] + np.concatenate(([0.0], np.cumsum(np.exp(raw[1:cuts]))))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the labelled rows. Without rows of both kinds, or without markers, nothing is toxic."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = fit_rows(docs, labels, scratch)
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    all_ = {r["t"]: r["n"] for r in labels.where("toxic is not null").groupBy(F.expr("int(toxic > 0)").alias("t")).agg(F.count(F.lit(1)).alias("n")).collect()}
    none = Model(np.zeros(1, np.uint64), np.zeros(1), np.full(GRADES - 1, 30.0))
    if len(sizes) < 2:
        return none
    odds = f"ln((pos + 0.5) / ({sizes[1]} - pos + 0.5)) - ln((neg + 0.5) / ({sizes[0]} - neg + 0.5))"
    part = sizes[1] / (sizes[0] + sizes[1])
    tested = scratch.write(_document_frequencies(rows).where(f"pos >= {MARKER_TEXTS}"), "tested")
    least = 2 * np.log(max(tested.count(), 2))
    found = (
        tested.withColumn("odds", F.expr(odds))
        .withColumn("ratio", F.expr(f"2 * (pos * ln(pos / ((pos + neg) * {part})) + if(neg > 0, neg * ln(neg / ((pos + neg) * {1 - part})), 0))"))
        .where(f"ratio >= {least} and odds >= {MARKER_ODDS}").orderBy(F.desc("ratio"), "feature").limit(MAX_MARKERS).select("feature").toPandas()
    )
    if found.empty:
        return none
    markers = np.sort(found["feature"].to_numpy().view(np.uint64))
    seen = _bitmap(markers)

    def run(batch):
        toxic = batch.column(1).to_numpy()
        for begin, end in text_chunks(batch.column(0), CHUNK_BYTES):
            found = features(*rolling.buffer_of(batch.column(0), begin, end))
            row, marker, n, marked = _marker_counts(*found, markers, seen)
            cuts = np.searchsorted(row, np.arange(end - begin + 1))
            yield pa.record_batch(
                [toxic[begin:end], np.bincount(marked, minlength=end - begin), pa.ListArray.from_arrays(cuts.astype(np.int32), pa.array(marker, pa.int64())),
                 pa.ListArray.from_arrays(cuts.astype(np.int32), pa.array(n, pa.int64()))],
                names=["toxic", "marked", "marker", "n"],
            )

    # at most the rows of the fit, each with at most MAX_MARKERS numbers
    data = arrow_map(rows.select("text", "toxic"), run, "toxic int, marked long, marker array<bigint>, n array<bigint>").toPandas()
    held = data["marker"].map(len).to_numpy()
    row = np.repeat(np.arange(len(data)), held)
    marker = np.concatenate([*data["marker"], np.zeros(0)]).astype(np.int64)
    count = np.concatenate([*data["n"], np.zeros(0)]).astype(np.int64)
    toxic = data["toxic"].to_numpy()
    marked = data["marked"].to_numpy()
    steps = np.quantile(marked[toxic == 1], np.arange(1, GRADES - 1) / (GRADES - 1))
    grade = np.where(toxic == 1, 1 + np.searchsorted(np.unique(steps), marked, side="right"), 0)
    _, grade = np.unique(grade, return_inverse=True)
    weight = np.array([all_.get(t, 1) / sizes[t] for t in (0, 1)])[toxic]
    weights, thresholds = _solve(row, marker, np.log1p(count), grade, weight, len(markers))
    return Model(markers, weights, thresholds)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of ``docs`` with ``severity`` (expected grade), ``p_toxic`` and ``toxic`` (``p_toxic`` of one half or more).

    Null and empty texts have the model's base rate. Other columns stay, but for any named like these three.
    """
    docs = without(docs, "severity", "p_toxic", "toxic")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_MARKERS numbers, and their weights
    text_at = docs.columns.index("text")

    def run(batch):
        here = shared.value
        seen = _bitmap(here.markers)
        for begin, end in text_chunks(batch.column(text_at), 8 * CHUNK_BYTES):
            total = np.zeros(end - begin)
            part = batch.slice(begin, end - begin)
            for b, e in text_chunks(part.column(text_at), CHUNK_BYTES):
                found = features(*rolling.buffer_of(part.column(text_at), b, e))
                row, marker, n, _ = _marker_counts(*found, here.markers, seen)
                total[b:e] = np.bincount(row, here.weights[marker] * np.log1p(n), minlength=e - b)
            severity, p = here.severity(total)
            columns = [*part.columns, pa.array(severity), pa.array(p), pa.array(p >= 0.5)]
            yield pa.record_batch(columns, names=[f"c{i}" for i in range(len(columns))])

    kinds = [f.dataType.simpleString() for f in docs.schema.fields] + ["double", "double", "boolean"]
    out = arrow_map(docs, run, ", ".join(f"c{i} {k}" for i, k in enumerate(kinds)))
    return out.toDF(*docs.columns, "severity", "p_toxic", "toxic")
