"""Spelling variants of a corpus's words: k-d trees over letter counts, box-pruned range searches, letter order.

A word is a point, its letter counts. One inserted or deleted letter moves a point by one along one axis, a replaced
letter by one up and one down, so near words lie within L1 distance two. Words of one length are one tree. The upper
part of every tree is cut on a bounded sample of the vocabulary and only decides where words go; each of its boxes is a
task's bucket and holds all its words. A word is looked for in the tree of its own length and in that of the next
shorter one: it is sent to each box that one such step reaches, and inside a bucket a k-d tree over all its words is
searched in the same way. Points that are reached are the neighbours in letter counts; their words are then compared
letter by letter.

Every pair of near words is found once, from its longer word or, at equal lengths, from the word that has more of the
earlier letter; both words get their share (how many, and the most frequent) from there. No pairs are returned.
A bucket's searches pass in batches beside its tree, so a task holds one bucket and one batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm.store import Scratch, arrow_map

#: The most words whose points are gathered to cut the upper trees.
SAMPLE_WORDS = 200_000
#: Words of a bucket (expected) and points of a leaf of the tree inside it.
BUCKET_WORDS, LEAF_POINTS = 4096, 32
#: Words of a search batch, and letters compared at once.
SEARCH_WORDS, LETTERS_AT_ONCE = 8192, 1 << 23
#: The letters of a word.
WORD = "[A-Za-z\\u00C0-\\u00FF]+"
FIRST, ACCENTED = ord("a"), 0xC0
AXES = 26 + 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, min_length: int = 5, min_count: int = 3, loss: int = 97) -> DataFrame:
    """``word, n`` of ``docs`` (``doc_id``, ``text``): runs of letters, A-Z lowered, as often as they occur.

    Where the CRC-32 of ``<doc_id>:<run>`` is a multiple of ``loss``, the run loses the code point at that number modulo
    its length. Null texts have no words; a null doc_id is written as nothing. Words of fewer than ``min_length`` code
    points or ``min_count`` occurrences are left out. Counts are combined before they are shuffled.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(WORD), F.lit(0))).alias("run"))
    told = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    runs = runs.select("run", F.crc32(told.cast("binary")).alias("h"))
    at = F.pmod("h", F.char_length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.char_length("run")))
    word = F.when(F.col("h") % loss == 0, cut).otherwise(F.col("run"))
    words = runs.select(word.alias("word")).where(F.char_length("word") >= min_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def letters_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, one after the other, and the length of each."""
    raw = np.array(words.to_pylist(), dtype=object)
    lengths = np.array([len(w) for w in raw], dtype=np.int64)
    return np.frombuffer("".join(raw).encode("utf-32-le"), "<u4"), lengths


def axis_of(letters: np.ndarray) -> np.ndarray:
    return np.where(letters >= ACCENTED, letters.astype(np.int64) - ACCENTED + 26, letters.astype(np.int64) - FIRST)


def points_of(letters: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Letter counts, one row per word."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    counts = np.bincount(row * AXES + axis_of(letters), minlength=len(lengths) * AXES)
    return counts.reshape(-1, AXES).astype(np.int32)


@dataclass
class Tree:
    """A k-d tree: ``axis`` (-1 at a leaf), ``cut`` (left: at most), children, and the leaf's number."""

    axis: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaf: np.ndarray


def grow(points: np.ndarray, limit: float) -> tuple[Tree, list[np.ndarray]]:
    """The tree of ``points`` and the rows of every leaf. Leaves have at most ``limit`` points or equal ones."""
    axis, cut, left, right, leaf, leaves = [], [], [], [], [], []

    def add() -> int:
        for x, start in ((axis, -1), (cut, 0), (left, 0), (right, 0), (leaf, -1)):
            x.append(start)
        return len(axis) - 1

    todo = [(add(), np.arange(len(points)))]
    while todo:
        node, rows = todo.pop()
        side = None
        if len(rows) > limit:
            here = points[rows]
            spread = here.var(axis=0)
            d = int(spread.argmax())
            if spread[d] > 0:
                values, counts = np.unique(here[:, d], return_counts=True)
                below = np.cumsum(counts)[:-1]
                c = int(values[np.abs(below - len(rows) / 2).argmin()])
                side = here[:, d] <= c
        if side is None:
            leaf[node] = len(leaves)
            leaves.append(rows)
            continue
        axis[node], cut[node] = d, c
        left[node], right[node] = add(), add()
        todo += [(left[node], rows[side]), (right[node], rows[~side])]
    return Tree(*(np.array(x, dtype=np.int64) for x in (axis, cut, left, right, leaf))), leaves


def reach(tree: Tree, points: np.ndarray, replaced: bool) -> Iterator[tuple[int, np.ndarray]]:
    """Leaves whose box holds a point that is one step away, with the rows of ``points`` for which it does.

    A step takes one from an axis; ``replaced``: and adds one to a later axis. What has been spent on the way down is
    kept per row: ``down`` and ``up`` are the axes that had to give way so far, or -1.
    """
    none = np.full(len(points), -1, dtype=np.int64)
    todo = [(0, np.arange(len(points)), none, none)]
    while todo:
        node, rows, down, up = todo.pop()
        if not len(rows):
            continue
        d = int(tree.axis[node])
        if d < 0:
            yield int(tree.leaf[node]), rows
            continue
        value = points[rows, d] - (down == d) + (up == d)
        over = value - tree.cut[node]
        fits = over <= 0
        lower = (over == 1) & (down < 0) & ((up < 0) | (d < up)) & (up != d)
        take = fits | lower
        todo.append((int(tree.left[node]), rows[take], np.where(lower, d, down)[take], up[take]))
        fits = over >= 1
        if replaced:
            higher = (over == 0) & (up < 0) & (down < d) & (down != d)
            take = fits | higher
            todo.append((int(tree.right[node]), rows[take], down[take], np.where(higher, d, up)[take]))
        else:
            todo.append((int(tree.right[node]), rows[fits], down[fits], up[fits]))


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of code points ``a`` and ``b`` (as long, or one shorter) that differ by exactly one code point."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    before = np.logical_and.accumulate(a[:, :-1] == b, axis=1).sum(axis=1)
    after = np.logical_and.accumulate((a[:, 1:] == b)[:, ::-1], axis=1).sum(axis=1)
    return before + after >= b.shape[1]


class Bucket:
    """The words of a bucket, all of one length, in a k-d tree of their own."""

    def __init__(self, words: pa.Array, n: np.ndarray):
        letters, lengths = letters_of(words)
        self.words, self.n = np.array(words.to_pylist(), dtype=object), n
        self.letters = letters.reshape(len(n), -1)
        points, self.of = np.unique(points_of(letters, lengths), axis=0, return_inverse=True)
        self.of = self.of.ravel()
        self.order = np.argsort(self.of, kind="stable")
        self.first = np.searchsorted(self.of[self.order], np.arange(len(points) + 1))
        self.points = points
        self.tree, self.leaves = grow(points, LEAF_POINTS)

    def pairs(self, words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of ``words`` (of one length) and of the bucket's words that are near."""
        letters, lengths = letters_of(words)
        length = int(lengths[0])
        letters, points = letters.reshape(len(lengths), -1), points_of(letters, lengths)
        replaced = length == self.letters.shape[1]
        # lengths of the steps: one axis (deleted), two axes (replaced)
        want = 2 if replaced else 1
        own, held = (points.astype(np.float64) ** 2).sum(axis=1), (self.points.astype(np.float64) ** 2).sum(axis=1)
        for leaf, rows in reach(self.tree, points, replaced):
            at = self.leaves[leaf]
            far = own[rows, None] + held[None, at] - 2.0 * (points[rows].astype(np.float64) @ self.points[at].astype(np.float64).T)
            i, j = np.nonzero(np.rint(far) == want)
            if replaced and len(i):
                # each pair from one side: the letter lost comes before the letter won
                step = self.points[at[j]] - points[rows[i]]
                first = step.argmin(axis=1) < step.argmax(axis=1)
                i, j = i[first], j[first]
            yield from self._verified(letters, rows[i], at[j])

    def _verified(self, letters: np.ndarray, rows: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a word and a neighbouring point, spelled out over the point's words and compared in order."""
        many = self.first[at + 1] - self.first[at]
        step = max(1, LETTERS_AT_ONCE // max(1, letters.shape[1]))
        ends = np.cumsum(many)
        total = int(ends[-1]) if len(ends) else 0
        for begin in range(0, total, step):
            k = np.arange(begin, min(begin + step, total))
            which = np.searchsorted(ends, k, side="right")
            word = self.order[self.first[at[which]] + k - (ends[which] - many[which])]
            good = one_edit(letters[rows[which]], self.letters[word])
            if good.any():
                yield rows[which[good]], word[good]


class Best:
    """Per word how many near words were found and the best of them: largest n, then first in code-point order."""

    def __init__(self) -> None:
        self.found: dict[str, list] = {}

    def add(self, words: np.ndarray, others: np.ndarray, n: np.ndarray) -> None:
        for w, o, m in zip(words.tolist(), others.tolist(), n.tolist(), strict=True):
            seen = self.found.get(w)
            if seen is None:
                self.found[w] = [1, m, o]
            else:
                seen[0] += 1
                if (-m, o) < (-seen[1], seen[2]):
                    seen[1], seen[2] = m, o

    def batch(self) -> pa.RecordBatch:
        found, self.found = self.found, {}
        columns = [list(found), *([x[i] for x in found.values()] for i in range(3))]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["word", "n_near", "top", "near"])


#: Tree of a length: the upper tree, the first bucket of every leaf, and how many buckets it is dealt over.
Upper = dict[int, tuple[Tree, np.ndarray, np.ndarray]]


def upper_trees(words: DataFrame, total: int) -> tuple[Upper, int]:
    """The upper trees, cut on a sample by hash, and the number of buckets.

    At most about ``SAMPLE_WORDS`` words are gathered; a length without a sampled word is one bucket. Points that are
    equal cannot be cut, so their words are dealt over several buckets.
    """
    every = max(1, -(-total // SAMPLE_WORDS))
    sample = words.where(F.pmod(F.xxhash64("word"), F.lit(every)) == 0).select("word").toArrow()
    column = sample.column("word").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    letters, lengths = letters_of(column)
    points, trees, buckets = points_of(letters, lengths), {}, 0
    for length in np.unique(lengths).tolist():
        here = points[lengths == length]
        tree, leaves = grow(here, max(BUCKET_WORDS / every, 1))
        dealt = np.array([max(1, -(-len(x) * every // BUCKET_WORDS)) for x in leaves], dtype=np.int64)
        trees[length] = (tree, buckets + np.cumsum(dealt) - dealt, dealt)
        buckets += int(dealt.sum())
    return trees, buckets


def _routed(words: DataFrame, trees: Upper, buckets: int) -> DataFrame:
    """``bucket, kind, word, n``: words in the one bucket that holds them (kind 0) and where they are sought (else
    their length). Buckets from ``buckets`` on are lengths without a tree."""

    def homes(length: int, points: np.ndarray, salt: np.ndarray) -> np.ndarray:
        if length not in trees:
            return np.full(len(points), buckets + length, dtype=np.int64)
        tree, first, dealt = trees[length]
        node = np.zeros(len(points), dtype=np.int64)
        while (tree.axis[node] >= 0).any():
            inner = tree.axis[node] >= 0
            go = points[np.arange(len(points)), np.maximum(tree.axis[node], 0)] <= tree.cut[node]
            node = np.where(inner, np.where(go, tree.left[node], tree.right[node]), node)
        leaf = tree.leaf[node]
        return first[leaf] + salt % dealt[leaf]

    def sought(length: int, points: np.ndarray, replaced: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if length not in trees:
            yield np.arange(len(points)), np.full(len(points), buckets + length, dtype=np.int64)
            return
        tree, first, dealt = trees[length]
        for leaf, rows in reach(tree, points, replaced):
            for k in range(int(dealt[leaf])):
                yield rows, np.full(len(rows), first[leaf] + k, dtype=np.int64)

    def run(batch):
        words, n, salt = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        letters, lengths = letters_of(words)
        points = points_of(letters, lengths)
        for length in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == length)
            found = [(np.arange(len(at)), homes(length, points[at], salt[at]), 0)]
            found += [(r, b, length) for r, b in sought(length, points[at], True)]
            if length > 1:
                found += [(r, b, length) for r, b in sought(length - 1, points[at], False)]
            for rows, bucket, kind in found:
                if len(rows):
                    yield pa.record_batch(
                        [bucket, np.full(len(rows), kind, np.int32), words.take(pa.array(at[rows])), n[at[rows]]],
                        names=["bucket", "kind", "word", "n"],
                    )

    salted = words.select("word", "n", F.pmod(F.xxhash64("word", F.lit(1)), F.lit(1 << 30)).alias("salt"))
    return arrow_map(salted, run, "bucket long, kind int, word string, n long")


def _searched(routed: DataFrame) -> DataFrame:
    """``word, n_near, top, near``: what each bucket adds to a word; several rows a word."""

    def run(batches):
        best, bucket, words, counts, tree = Best(), None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            place, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            change = np.flatnonzero((place[1:] != place[:-1]) | (kind[1:] != kind[:-1])) + 1
            for begin, end in zip([0, *change.tolist()], [*change.tolist(), len(place)], strict=True):
                part = batch.slice(begin, end - begin)
                if place[begin] != bucket:
                    bucket, words, counts, tree = place[begin], [], [], None
                if kind[begin] == 0:
                    words.append(part.column(2))
                    counts.append(part.column(3).to_numpy())
                    continue
                if not words:
                    continue
                tree = tree or Bucket(pa.concat_arrays(words), np.concatenate(counts))
                for low in range(0, part.num_rows, SEARCH_WORDS):
                    asked, n = part.column(2).slice(low, SEARCH_WORDS), part.column(3).slice(low, SEARCH_WORDS).to_numpy()
                    names = np.array(asked.to_pylist(), dtype=object)
                    for i, j in tree.pairs(asked):
                        best.add(names[i], tree.words[j], tree.n[j])
                        best.add(tree.words[j], names[i], n[i])
                    if len(best.found) > SEARCH_WORDS:
                        yield best.batch()
        if best.found:
            yield best.batch()

    dealt = routed.repartition("bucket").sortWithinPartitions("bucket", "kind")
    return dealt.mapInArrow(run, "word string, n_near long, top long, near string")


def group_variants(words: DataFrame, dominance: int = 2) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every row of ``words`` (``word``, ``n``; words are distinct).

    Near words differ by exactly one inserted, deleted or replaced code point. The form of a word is its near word of
    largest n (ties: first in code-point order) if that has at least ``dominance`` times its n, else null. The root is
    where following forms ends. Words are made of the letters of ``WORD`` without A-Z. An empty table has no rows.
    """
    spark = words.sparkSession
    scratch = Scratch(spark, "spelling")
    words = scratch.write(words.select("word", F.col("n").cast("long").alias("n")), "words")
    trees, buckets = upper_trees(words, words.count())
    found = _searched(_routed(words, trees, buckets))
    best = F.min_by("near", F.struct(-F.col("top"), "near"))
    near = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("near"), F.max("top").alias("top"))
    formed = F.col("top") >= dominance * F.col("n")
    known = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(formed, F.col("near")).alias("form"), F.when(formed, F.col("top")).alias("form_n"),
    )
    known = scratch.write(known, "known")
    return known.join(_roots(known, scratch), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def _roots(known: DataFrame, scratch: Scratch) -> DataFrame:
    """``word, root`` of the words that have a form. Every round follows twice as many forms as the one before; forms
    at least double n, so few rounds are needed."""
    state, turn = scratch.write(known.where("form is not null").select("word", F.col("form").alias("root")), "roots-0"), 0
    while True:
        turn += 1
        further = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = scratch.write(
            state.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
            f"roots-{turn}",
        )
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        scratch.drop(f"roots-{turn - 1}")
        state = moved.select("word", "root")
