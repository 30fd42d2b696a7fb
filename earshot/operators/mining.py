"""Hard-negative mining: lexicon scoring, n-gram candidates, suppression, quotas.

Intervals are kept as rows (utt_id, pos, start, end, text), never as one list
per utterance, so a very long recording is spread over many tasks.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import reduce
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot import presets
from earshot.functions import text as T
from earshot.operators.scans import bucketed_scan, map_groups, map_stretches, range_scan, top_rows, with_halo
from earshot.session import materialize


def _targets_array(targets: dict[str, list[str]], alphabet: list[str]) -> Column:
    code = T.letters_of(alphabet)
    return F.array(*[
        F.struct(
            F.lit(name).alias("target"), F.lit("".join(code[p] for p in phones)).alias("spelled"),
            F.lit(len(phones)).alias("n"), F.lit(" ".join(phones)).alias("phones"),
        )
        for name, phones in targets.items()
    ])


def lexicon_hard_negatives(
    lexicon: DataFrame, targets: dict[str, list[str]], prefix: str, prefix_phones: list[str], alphabet: list[str],
    blacklist: dict[str, list[str]] | None = None, min_distance=2, max_distance=5, min_norm=0.0, max_norm=0.7, top_k=100,
) -> DataFrame:
    """Words whose best pronunciation lies within a band of edit distances of a target.

    ``lexicon`` has (word, pron_no, phones). Targets are a fixed short list, so
    each pronunciation carries them along instead of being joined with them.
    """
    scored = lexicon.withColumn("phones", F.concat(F.array(*[F.lit(p) for p in prefix_phones]), "phones"))
    scored = scored.withColumn("_spelled", T.spell_with(F.col("phones"), alphabet)).withColumn(
        "_t", F.explode(_targets_array(targets, alphabet))
    )
    length = F.size("phones")
    distance = F.levenshtein("_spelled", "_t.spelled")
    scored = scored.select(
        F.col("_t.target").alias("target"), F.col("_t.phones").alias("target_phones"), "word", "phones",
        distance.alias("distance"), T.normalized_distance(distance, length, F.col("_t.n")).alias("norm"), "pron_no",
    )
    if blacklist:
        hit = [(F.col("target") == t) & F.col("word").isin(*words) for t, words in blacklist.items() if words]
        for h in hit:
            scored = scored.filter(~h)
    best = scored.groupBy("target", "word").agg(
        F.min_by(
            F.struct("distance", "norm", "phones", "target_phones"), F.struct("distance", "norm", F.size("phones"), "pron_no")
        ).alias("b")
    ).select("target", "word", "b.*")
    kept = best.filter(F.col("distance").between(min_distance, max_distance) & F.col("norm").between(min_norm, max_norm))
    if top_k > 0:
        kept = top_rows(kept, ["target"], ["distance", F.round("norm", 4), "word"], top_k, ["word"])
    return kept.select(
        "target", F.concat(F.lit(prefix.upper() + " "), "word").alias("candidate"), "word", "distance",
        F.round("norm", 4).alias("norm_distance"), "target_phones", F.array_join("phones", " ").alias("candidate_phones"),
    )


def overlap_join(
    spans: DataFrame, intervals: DataFrame, key: str, start: str, end: str, bin_seconds: float, eps: float = 1e-5
) -> DataFrame:
    """Intervals of the same ``key`` overlapping each span by more than ``eps``.

    Both sides have (key, start, end). Each is copied to the time bins it
    touches; a pair is kept only in the first bin both touch, hence once.
    """
    def bins(df, prefix):
        lo = F.floor(F.col(start) / bin_seconds)
        hi = F.floor(F.greatest(F.col(end), F.col(start)) / bin_seconds)
        out = df.withColumn("_first", lo).withColumn("_bin", F.explode(F.sequence(lo, hi)))
        return out.withColumnsRenamed({start: f"{prefix}_start", end: f"{prefix}_end", "_first": f"{prefix}_first"})

    left, right = bins(spans, "span"), bins(intervals, "iv")
    pairs = left.join(right, [key, "_bin"]).filter(
        (F.col("_bin") == F.greatest("span_first", "iv_first"))
        & (F.col("iv_end") > F.col("span_start") + eps)
        & (F.col("iv_start") < F.col("span_end") - eps)
    )
    return pairs.drop("_bin", "span_first", "iv_first")


def ngrams(items: DataFrame, key: str, lengths: list[int], fields: list[str], block_rows: int = 4096) -> DataFrame:
    """Runs of n consecutive items: (key, last_pos, n, items), oldest item first.

    ``items`` has (key, pos from 1, ...fields). Blocks with a halo of the
    longest run keep every window inside a bounded group; one window serves
    all lengths.
    """
    longest = max(lengths)
    blocks = with_halo(items, "pos", longest - 1, block_rows)
    window = Window.partitionBy(key, "block").orderBy("pos").rowsBetween(-(longest - 1), 0)
    seen = blocks.withColumn("_seen", F.collect_list(F.struct(*fields)).over(window)).filter(~F.col("is_halo"))
    runs = F.array_compact(F.array(*[
        F.when(F.size("_seen") >= n, F.struct(F.lit(n).alias("n"), F.slice("_seen", -n, n).alias("items"))) for n in lengths
    ]))
    return seen.select(key, F.col("pos").alias("last_pos"), F.explode(runs).alias("r")).select(key, "last_pos", "r.*")


def _bisect(values: np.ndarray, x: np.ndarray, low: np.ndarray, high: np.ndarray, right: bool) -> np.ndarray:
    """Place of each ``x`` in its own sorted stretch ``values[low:high]``, behind equal ones if ``right``."""
    while (open_ := low < high).any():
        mid = (low + high) // 2
        found = values[np.minimum(mid, len(values) - 1)]
        before = open_ & ((found <= x) if right else (found < x))
        low, high = np.where(before, mid + 1, low), np.where(open_ & ~before, mid, high)
    return low


#: A spelled target with the most distance and the least similarity of what is near it.
Reach = tuple[str, float, float]


def _within_reach(points: np.ndarray, begin: np.ndarray, sizes: np.ndarray, reach: list[Reach]) -> np.ndarray:
    """Whether the strings of ``sizes`` code points from ``begin`` on are near a target; one row of sizes per ``begin``.

    Strings with one beginning share their table of distances: its rows are those of all their lengths. So do the bounds
    of one target.
    """
    near = np.zeros(sizes.shape, dtype=bool)
    longest = int(sizes.max(initial=0))
    bounds: dict[str, list[tuple[float, float]]] = {}
    for spelled, most, least in reach:
        bounds.setdefault(spelled, []).append((most, least))
    seen: list[np.ndarray] = []
    for spelled, limits in bounds.items():
        target = np.frombuffer(spelled.encode("utf-32-le"), dtype=np.uint32)
        n = len(target)
        before = [np.full(len(begin), k, dtype=np.int16) for k in range(n + 1)]
        if any(n <= most and least <= 0 for most, least in limits):
            near |= sizes == 0
        # longer ones are further away than allowed
        most_size = max(min(longest, n + most, n / least + 1e-9 if least > 0 else longest) for most, least in limits)
        for size in range(1, int(most_size) + 1):
            if len(seen) < size:
                seen.append(points[np.minimum(begin + size - 1, len(points) - 1)])
            row = [np.full(len(begin), size, dtype=np.int16)]
            for k in range(1, n + 1):
                row.append(np.minimum(np.minimum(before[k], row[k - 1]) + 1, before[k - 1] + (seen[size - 1] != target[k - 1])))
            before = row
            bound = max(min(most, (1 - least) * max(size, n) + 1e-9) for most, least in limits)
            near |= (sizes == size) & (row[n] <= bound)[:, None]
    return near


#: Columns of ``packs``: how many intervals, their bytes before they are compressed, and these.
PACKED = ["n", "size", "held"]


def packs(
    rows: DataFrame, key: str, codes: dict[str, str] | None = None, carried: list[str] | None = None, pack_rows: int = 256
) -> DataFrame:
    """Intervals (key, pos, start, end, text) of up to ``pack_rows`` neighbours as one row: far fewer rows to deal out.

    A row's ``code`` is that column or, where there is none, what ``codes`` has for its text, ``~`` for other texts, and
    nothing without ``codes``. Rows are packed where they lie, so a stretch of positions that is stored in several places
    has several packs. Returns (key, pack, start, end, ...PACKED); ``_opened`` gives the intervals back. Carried columns
    are integers.
    """
    carried = carried or []
    coded = "code" in rows.columns

    def pack(batches):
        codec = pa.Codec("zstd")
        for batch in batches:
            if not batch.num_rows:
                continue
            whose = pc.dictionary_encode(batch.column(0), null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
            pos = batch.column(1).to_numpy()
            step, on = np.diff(whose), np.diff(pos)
            if not ((step > 0) | ((step == 0) & (on >= 0))).all():
                order = np.lexsort((pos, whose))
                batch, whose, pos = batch.take(pa.array(order)), whose[order], pos[order]
                step = np.diff(whose)
            part = (pos - 1) // pack_rows
            first = np.concatenate(([0], np.flatnonzero((step != 0) | (np.diff(part) != 0)) + 1))
            bounds = np.append(first, len(pos))
            start, end, text = batch.column(2).to_numpy(), batch.column(3).to_numpy(), batch.column(4)
            if coded:
                code = batch.column(5)
            elif codes:
                code = pa.array([*codes.values(), "~"]).take(pc.fill_null(pc.index_in(text, value_set=pa.array([*codes])), len(codes)))
            else:
                code = pa.array([""]).take(pa.array(np.zeros(len(pos), dtype=np.int64)))
            # parts of a pack, each with the bytes at which its intervals begin; steps of positions and of the bits of times
            # repeat, which they themselves don't
            by_item = np.arange(len(pos) + 1)
            bits, until = (np.ascontiguousarray(x).view(np.int64) for x in (start, end))
            parts = [(x.tobytes(), 8 * by_item) for x in (_steps(pos, first), _steps(bits, first), until - bits)]
            for texts in (text, code):
                sizes = pc.fill_null(pc.binary_length(texts), -1).to_numpy().astype(np.int32)
                data = _joined(pc.fill_null(texts, "")).encode()
                parts += [(sizes.tobytes(), 4 * by_item), (data, np.concatenate(([0], np.cumsum(np.maximum(sizes, 0)))))]
            parts += [(column.to_numpy().astype(np.int64).tobytes(), 8 * by_item) for column in batch.columns[5 + coded :]]
            cuts = [(values, at[bounds].tolist()) for values, at in parts]
            raw = [b"".join(values[at[i] : at[i + 1]] for values, at in cuts) for i in range(len(first))]
            columns = [
                batch.column(0).take(pa.array(first)), pa.array(part[first]),
                pa.array(np.minimum.reduceat(start, first)), pa.array(np.maximum.reduceat(end, first)), pa.array(np.diff(bounds).astype(np.int32)),
                pa.array([len(x) for x in raw], pa.int32()), pa.array([codec.compress(x, asbytes=True) for x in raw], pa.binary()),
            ]
            yield pa.record_batch(columns, names=[key, "pack", "start", "end", *PACKED])

    plain = rows.select(
        key, F.col("pos").cast("bigint"), F.col("start").cast("double"), F.col("end").cast("double"), "text", *(["code"] * coded), *carried
    )
    return plain.mapInArrow(pack, f"{key} {dict(rows.dtypes)[key]}, pack bigint, start double, end double, n int, size int, held binary")


def _joined(texts: pa.Array) -> str:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), "")[0].as_py()


def _steps(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Differences of integers to the one before, but for those at ``first``."""
    out = np.diff(values, prepend=np.int64(0))
    out[first] = values[first]
    return out


def _opened(rows: pa.Table, n_carried: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, pa.Array, list[np.ndarray]]:
    """Pos, starts, ends, texts, codes and carried columns of packs, one pack after the other; ``n_carried`` is per pack."""
    codec = pa.Codec("zstd")
    pos, starts, ends, carried = [], [], [], [[] for _ in range(int(n_carried.max(initial=0)))]
    texts = [([], []), ([], [])]
    for n, size, held, more in zip(*(rows.column(c).to_pylist() for c in PACKED), n_carried.tolist(), strict=True):
        raw, at = codec.decompress(held, size, asbytes=True), 24 * n
        steps = np.frombuffer(raw, np.int64, 3 * n).reshape(3, n)
        pos.append(np.cumsum(steps[0]))
        bits = np.cumsum(steps[1])
        starts.append(bits.view(np.float64))
        ends.append((bits + steps[2]).view(np.float64))
        for sizes, data in texts:
            sizes.append(np.frombuffer(raw, np.int32, n, at))
            long = int(np.maximum(sizes[-1], 0).sum())
            data.append(raw[at + 4 * n : at + 4 * n + long])
            at += 4 * n + long
        for i in range(more):
            carried[i].append(np.frombuffer(raw, np.int64, n, at + 8 * n * i))
    joined = (np.concatenate(x) for x in (pos, starts, ends))
    return (*joined, *(_texts(np.concatenate(sizes), b"".join(data)) for sizes, data in texts), [np.concatenate(x) for x in carried])


def _texts(size: np.ndarray, data: bytes) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(np.maximum(size, 0)))).astype(np.int32)
    texts = pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(data))
    return pc.if_else(pa.array(size < 0), pa.scalar(None, pa.string()), texts) if (size < 0).any() else texts


def runs_with_overlaps(
    items: DataFrame, others: DataFrame, key: str, lengths: list[int], spelled_by: str, reach: list[Reach],
    also: Callable[[SimpleNamespace], np.ndarray], carried: dict[str, str] | None = None, bin_seconds: float = 600.0,
    eps: float = 1e-5, block_rows: int = 1024,
) -> DataFrame:
    """Runs of consecutive items near a target, and those that ``also`` picks, with what of the other tier they overlap.

    Both sides have (key, pos, start, end, text, code), disjoint and in time order, as rows or as their ``packs`` of
    ``block_rows / 4``. Items are cut into blocks that hold the items behind them too; packs of the other tier are dealt
    to the blocks whose time they overlap, and there all runs are looked up, spelled and compared at once, so that only
    those that are wanted leave the task. A run is spelled by the codes of its ``items`` or by those of the ``others`` it
    overlaps. ``also`` gets ``size`` (how many of the others a run overlaps), ``carried`` (integer columns of the others,
    at its "first" or "last" one; a large number where there is none), ``matches`` (whether a run's joined texts match a
    pattern) and ``hears`` (whether the texts of the others begin or close with a phrase); rows are first items, columns
    lengths.

    Returns (key, pos of the first item, n, start, end, texts, spelled, heard: the texts of the others, also).
    """
    carried = carried or {}
    behind = max(lengths) - 1
    in_pack = -(-max(block_rows, behind) // 4)
    block_rows = 4 * in_pack
    items = items if "pack" in items.columns else packs(items, key, pack_rows=in_pack)
    others = others if "pack" in others.columns else packs(others, key, None, list(carried), in_pack)
    own = F.floor(F.col("pack") / F.lit(4)).cast("bigint")
    # the packs at the head of a block also stand behind the block before
    ahead = (own > 0) & (F.pmod("pack", F.lit(4)) * in_pack < behind)
    asked = items.withColumn("block", F.explode(F.when(ahead, F.array(own - 1, own)).otherwise(F.array(own))))
    ranges = asked.groupBy(key, "block").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    # times alone are dealt to bins; a pack itself goes to the blocks that it overlaps
    lasting = others.groupBy(key, "pack").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    held = others.join(overlap_join(ranges, lasting, key, "start", "end", bin_seconds, eps).select(key, "block", "pack"), [key, "pack"])
    both = held.withColumn("_kind", F.lit(0)).select(key, "block", "_kind", "pack", *PACKED).unionByName(
        asked.select(key, "block", F.lit(1).alias("_kind"), "pack", *PACKED)
    )

    def find(rows: pa.Table, bounds: list[int]) -> pa.RecordBatch:
        tiers = rows.column("_kind").to_numpy()
        pos, start, end, texts, codes, more = _opened(rows, np.where(tiers == 0, len(carried), 0))
        held_in = np.repeat(np.arange(rows.num_rows), rows.column("n").to_numpy())
        group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[held_in]
        kind, block = tiers[held_in], rows.column("block").to_numpy()[held_in]
        told_of = {c: np.zeros(len(held_in), dtype=np.int64) for c in carried}
        for c, values in zip(carried, more):
            told_of[c][kind == 0] = values
        order = np.flatnonzero((kind == 0) | (pos <= (block + 1) * block_rows + behind))
        tier = 2 * group + kind
        step = np.diff(tier[order])
        if not ((step > 0) | ((step == 0) & (np.diff(pos[order]) >= 0))).all():
            order = order[np.lexsort((pos[order], tier[order]))]
        held_in, group, kind, block, pos = held_in[order], group[order], kind[order], block[order], pos[order]
        start, end, texts, codes = start[order], end[order], texts.take(pa.array(order)), codes.take(pa.array(order))

        theirs, mine = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
        edges = np.searchsorted(group, np.arange(len(bounds)))
        group = group[mine]
        low_of, high_of = np.searchsorted(theirs, edges[:-1])[group], np.searchsorted(theirs, edges[1:])[group]
        low = _bisect(end[theirs], start[mine] + eps, low_of, high_of, True)
        high = _bisect(start[theirs], end[mine] - eps, low_of, high_of, False)
        first = np.flatnonzero((pos[mine] - 1) // block_rows == block[mine])
        left = np.cumsum(np.bincount(group, minlength=len(bounds) - 1))[group[first]] - first
        until, above = [end[mine][first]], [high[first]]
        for k in range(1, max(lengths)):
            at = np.minimum(first + k, len(mine) - 1)
            until.append(np.maximum(until[-1], end[mine][at]))
            above.append(np.maximum(above[-1], high[at]))
        pick = np.array(lengths) - 1
        until, above, low = np.stack(until, 1)[:, pick], np.stack(above, 1)[:, pick], low[first]
        whole = left[:, None] > pick
        size = np.maximum(above - low[:, None], 0)

        source = mine if spelled_by == "items" else theirs
        codes = codes.take(pa.array(source))
        ends = np.concatenate(([0], np.cumsum(pc.utf8_length(codes).to_numpy(), dtype=np.int64)))
        text = _joined(codes)
        begin_at, stop_at = (first[:, None], np.minimum(first[:, None] + pick + 1, len(mine))) if source is mine else (low[:, None], low[:, None] + size)
        begin, stop = ends[begin_at], ends[stop_at]
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        near = _within_reach(points, begin[:, 0], np.where(whole, stop - begin, -1), reach)

        def matches(pattern: str) -> np.ndarray:
            found = np.zeros(whole.shape, dtype=bool)
            for i, n in enumerate(lengths):
                at = [texts.take(pa.array(mine[np.minimum(first + k, len(mine) - 1)])) for k in range(n)]
                joined = pc.binary_join_element_wise(*at, " ", null_handling="skip")
                found[:, i] = pc.match_substring_regex(joined, pattern).to_numpy(zero_copy_only=False)
            return found

        def hears(phrases: list[str]) -> np.ndarray:
            words = texts.take(pa.array(theirs))
            begins, closes = (np.full(len(theirs) + 1, np.iinfo(np.int32).max) for _ in range(2))
            by_words: dict[int, list[str]] = {}
            for item in phrases:
                by_words.setdefault(len(item.split(" ")), []).append(item)
            # the fewest words from one on, or up to it, that are a phrase: it fits a run that overlaps as many
            for k, listed_ones in sorted(by_words.items(), reverse=True):
                if k <= len(words):
                    spoken = pc.binary_join_element_wise(*(words.slice(i, len(words) - k + 1) for i in range(k)), " ")
                    hit = np.flatnonzero(pc.is_in(spoken, value_set=pa.array(listed_ones, pa.string())).to_numpy(zero_copy_only=False))
                    begins[hit], closes[hit + k - 1] = k, k
            return (size > 0) & ((begins[low][:, None] <= size) | (closes[above - 1] <= size))

        def told(name: str, which: str) -> np.ndarray:
            values = told_of[name][order][theirs] if len(theirs) else np.zeros(1, dtype=np.int32)
            spot = np.broadcast_to(low[:, None], size.shape) if which == "first" else above - 1
            return np.where(size > 0, values[np.clip(spot, 0, len(values) - 1)], np.iinfo(np.int32).max)

        run = SimpleNamespace(size=size, carried={c: told(c, which) for c, which in carried.items()}, matches=matches, hears=hears)
        extra = also(run)
        one, which = np.nonzero(whole & (near | extra))

        def listed(of: np.ndarray, at: np.ndarray, counts: np.ndarray) -> pa.ListArray:
            places = np.repeat(at, counts) + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
            bounds_of = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(bounds_of), texts.take(pa.array(of[places] if len(places) else places)))

        row, n = mine[first[one]], pick[which] + 1
        begin, stop = np.broadcast_to(begin, whole.shape)[one, which], np.broadcast_to(stop, whole.shape)[one, which]
        out = {
            key: rows.column(key).combine_chunks().take(pa.array(held_in[row])), "pos": pa.array(pos[row], pa.int64()),
            "n": pa.array(n, pa.int32()), "start": pa.array(start[row]), "end": pa.array(until[one, which]),
            "texts": listed(mine, first[one], n),
            "spelled": pa.array([text[b:e] for b, e in zip(begin.tolist(), stop.tolist(), strict=True)], pa.string()),
            "heard": listed(theirs, low[one], size[one, which]), "also": pa.array(extra[one, which]),
        }
        return pa.record_batch(list(out.values()), names=list(out))

    schema = f"{key} {dict(items.dtypes)[key]}, pos bigint, n int, start double, end double, texts array<string>, spelled string, heard array<string>, also boolean"
    return map_stretches(both, [key, "block"], ["_kind", "pack"], find, schema, stretch_rows=512)


def _best_target(spelled: Column, length: Column, names: list[str], targets, alphabet) -> Column:
    """Best (sim, -dist, target): highest similarity, then distance, then name."""
    code = T.letters_of(alphabet)
    options = []
    for name in names:
        n = len(targets[name])
        raw = F.levenshtein(spelled, F.lit("".join(code[p] for p in targets[name])))
        dist = T.edit_distance_or_length(raw, length, F.lit(n))
        options.append(F.struct(
            T.edit_similarity(raw, length, F.lit(n)).alias("sim"), (-dist).alias("neg_dist"), F.lit(name).alias("target")
        ))
    return F.array_max(F.array(*options))


def mine_candidates(
    words: DataFrame, phones: DataFrame, alphabet: list[str], min_sec: float, max_sec: float, pre_pad: float, post_pad: float,
    similarity: float, max_distance: int, targets=None, category_targets=None, phrase_blacklist=None, wake_targets=None,
    bin_seconds: float = 600.0,
) -> DataFrame:
    """Scored, flagged and gated candidates of time-aligned utterances.

    ``words`` and ``phones`` have (utt_id, pos, start, end, text) with
    normalised visible words and scoring phones. Runs that pass the gates or
    carry a ``blacklist_flag`` are returned; one is kept when it ``passes`` and
    carries no flag.
    """
    targets = targets or presets.PHONE_TARGETS
    category_targets = category_targets or presets.CATEGORY_TARGETS
    phrase_blacklist = presets.PHRASE_BLACKLIST if phrase_blacklist is None else phrase_blacklist
    wake_targets = presets.WAKE_TARGETS if wake_targets is None else wake_targets

    # One character per phone, assigned once; a run is then spelled by joining characters.
    # Packs are written once: either tier is read as items and as the other tier.
    coded = materialize(packs(phones, "utt_id", T.letters_of(alphabet)))
    plain = materialize(packs(words, "utt_id"))

    def reach(names: list[str]) -> list[Reach]:
        return _reach(names, alphabet, similarity, max_distance, targets, category_targets, wake_targets)

    # Word runs: one to three words; phones are those overlapping the run in time.
    pattern = _phrase_pattern(phrase_blacklist)
    sound = runs_with_overlaps(
        plain, coded, "utt_id", [1, 2, 3], "others", reach([c for c in category_targets if c != PHONE_RUNS]),
        lambda run: run.matches(pattern), bin_seconds=bin_seconds,
    )
    is_prefix = F.col("texts")[0].isin(*presets.PREFIX_WORDS)

    def entry(cond, category, rule):
        return F.when(cond, F.struct(F.lit(category).alias("category"), rule.alias("rule")))

    gram = F.format_string("word_%d_gram", "n")
    short = F.col("n") <= 2
    entries = F.array_compact(F.array(
        entry(is_prefix & (F.col("n") == 2), "hey_nonwake", F.lit("hey_plus_1_word")),
        entry(is_prefix & (F.col("n") == 3), "hey_nonwake", F.lit("hey_plus_2_words")),
        entry(short, presets.PREFIX_CATEGORY, F.concat(F.lit("hey_prefix_"), gram)),
        entry(short, "camy_phoneme_similar", gram),
        entry(short, "reco_phoneme_similar", gram),
    ))
    from_words = sound.withColumn("_e", F.explode(entries)).select(
        "utt_id", "start", "end", "spelled", F.col("_e.category").alias("category"), F.col("_e.rule").alias("rule"),
        F.col("texts").alias("words"), F.col("heard").alias("phones"),
        T.phrase_hits(F.array_join("texts", " "), phrase_blacklist).alias("listed"),
    )
    # Phone runs: four to seven phones; their words are those overlapping in time.
    spoken = runs_with_overlaps(
        coded, plain, "utt_id", [4, 5, 6, 7], "items", reach([PHONE_RUNS]), lambda run: run.hears(phrase_blacklist),
        bin_seconds=bin_seconds,
    )
    from_phones = spoken.select(
        "utt_id", "start", "end", "spelled", F.lit(PHONE_RUNS).alias("category"), F.lit("local_phone_ngram").alias("rule"),
        F.when(F.size("heard") > 0, F.col("heard")).otherwise(F.array(F.lit("<PHONE_SPAN>"))).alias("words"),
        F.col("texts").alias("phones"), F.col("also").alias("listed"),
    )
    # written once: read for the distinct spellings, and to be judged by them
    spans = materialize(from_words.unionByName(from_phones))
    kept = score_candidates(
        spans, alphabet, min_sec, max_sec, pre_pad, post_pad, similarity, max_distance, targets, category_targets, wake_targets,
    )
    return kept.drop("listed").withColumn("phrase", F.array_join("words", " "))


def _phrase_pattern(blacklist: list[str]) -> str:
    """Matches texts that are a listed phrase, or start or end with one (whole words)."""
    if not blacklist:
        return r"[^\s\S]"
    items = "|".join(re.escape(x) for x in blacklist)
    return rf"^(?:{items})(?: |$)|(?:^| )(?:{items})$"


def _reach(names, alphabet, similarity, max_distance, targets, category_targets, wake_targets) -> list[Reach]:
    """All that the gates of the categories ``names``, or a flag, can ask of a spelling; ``score_candidates`` decides."""
    code = T.letters_of(alphabet)
    spelled = lambda name: "".join(code[p] for p in targets[name])
    out = set()
    for category in names:
        gate = (1, 0.66) if category == presets.PREFIX_CATEGORY else (max_distance, similarity)
        out |= {(spelled(name), *gate) for name in category_targets[category]}
    for name in wake_targets:
        out |= {(spelled(name), 1, 0.0), (spelled(name), float("inf"), 0.92)}
    return sorted(out)


#: Category of the runs of phones.
PHONE_RUNS = "local_phoneme_confuser"


def score_candidates(
    spans: DataFrame, alphabet, min_sec, max_sec, pre_pad, post_pad, similarity, max_distance, targets, category_targets, wake_targets,
) -> DataFrame:
    """Spans (with their spelling) that pass the gates or carry a flag, with best target, flag and verdict.

    Every distinct spelling of a category is scored once; spans are then looked up.
    """
    code = T.letters_of(alphabet)
    spellings = spans.select("category", "spelled").distinct()
    spelled, length = F.col("spelled"), F.char_length("spelled")
    best = None
    for category, names in category_targets.items():
        value = _best_target(spelled, length, names, targets, alphabet)
        best = F.when(F.col("category") == category, value) if best is None else best.when(F.col("category") == category, value)
    near = F.lit(None).cast("string")
    for name in reversed(wake_targets):
        n = len(targets[name])
        raw = F.levenshtein(spelled, F.lit("".join(code[p] for p in targets[name])))
        dist, sim = T.edit_distance_or_length(raw, length, F.lit(n)), T.edit_similarity(raw, length, F.lit(n))
        hit = (dist <= max(1, min(max_distance, 1))) | ((sim >= 0.92) & (length >= n - 1))
        near = F.when(hit, F.lit(f"wake_phone_blacklist:{name}")).otherwise(near)
    scored = spellings.withColumn("_b", best).select(
        "category", "spelled", F.col("_b.target").alias("target"), F.col("_b.sim").alias("similarity"),
        (-F.col("_b.neg_dist")).alias("edit_distance"), F.coalesce(near, F.lit("")).alias("near"),
    )
    prefix_gate = length.between(2, 4) & (F.col("edit_distance") <= 1) & (F.col("similarity") >= 0.66)
    general_gate = (F.col("similarity") >= similarity) & (F.col("edit_distance") <= max_distance) & (length >= 2)
    gate = F.when(F.col("category") == presets.PREFIX_CATEGORY, prefix_gate).otherwise(general_gate)
    # written, so that Spark knows the size before it plans the join
    scored = materialize(scored.withColumn("gate", gate))
    timed = spans.withColumns({"start_sec": F.greatest(F.lit(0.0), F.col("start") - pre_pad), "end_sec": F.col("end") + post_pad})
    timed = timed.withColumn("duration_sec", F.greatest(F.lit(0.0), F.col("end_sec") - F.col("start_sec")))
    flag = F.when(F.col("listed"), F.lit("text_blacklist")).otherwise(F.col("near"))
    passes = F.col("gate") & F.col("duration_sec").between(min_sec, max_sec)
    judged = timed.join(scored, ["category", "spelled"]).withColumns({"blacklist_flag": flag, "passes": passes})
    return judged.filter("passes OR blacklist_flag <> ''").drop("spelled", "start", "end", "gate", "near")


def interval_iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Intersection over the hull of both intervals; 0 for an empty hull."""
    inter = F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2))
    hull = F.greatest(e1, e2) - F.least(s1, s2)
    return F.when(hull > 0, inter / hull).otherwise(F.lit(0.0))


def _settle(
    start: np.ndarray, end: np.ndarray, order: np.ndarray, kept: np.ndarray, max_iou: float,
    low: float = -np.inf, high: float = np.inf, longest: float = np.inf,
) -> np.ndarray:
    """States of rows after greedy suppression in ``order``: 0 undecided, 1 kept, 2 suppressed.

    ``kept`` rows are settled before. Rows that start up to ``low`` or from ``high`` on may be missing: a row that could
    clash with them stays undecided, and so does one that clashes with a better undecided row and no kept one.
    Only rows that are kept or undecided cost a step.
    """
    by_start = np.argsort(start, kind="stable")
    sorted_start = start[by_start]
    length = end - start
    # clashing rows start at most this much later, or earlier
    ahead = length * (1 - max_iou) * (1 + 1e-9)
    back = np.minimum(ahead / max_iou if max_iou > 0 else np.inf, longest)
    inside = (start - back > low) & (start + ahead < high)
    first, last = np.searchsorted(sorted_start, start - back, "left"), np.searchsorted(sorted_start, start + ahead, "right")
    state, tainted = kept.astype(np.int8), np.zeros(len(start), bool)

    def clashing(i: int) -> np.ndarray:
        near = by_start[first[i] : last[i]]
        inter = np.minimum(end[near], end[i]) - np.maximum(start[near], start[i])
        hull = np.maximum(end[near], end[i]) - np.minimum(start[near], start[i])
        return near[(inter > 0) & (inter > max_iou * hull) & (near != i)]

    for i in np.flatnonzero(kept):
        hit = clashing(i)
        state[hit[state[hit] == 0]] = 2
    for i in order:
        if state[i]:
            continue
        hit = clashing(i)
        if inside[i] and not tainted[i]:
            state[i] = 1
            state[hit[state[hit] == 0]] = 2
        else:
            # what comes later in the order has to wait for this row
            tainted[hit] = True
    return state


#: What a row needs to be compared: bounds, order and state (1: kept before).
_ROW = ["_s", "_e", "_p1", "_p2", "_tie", "_state"]


def _settled(df: DataFrame, group: list[str], max_iou: float, edges: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the states of its rows after one greedy pass over every group."""
    names = [*group, *_ROW]

    def run(rows: pa.Table, begin: int, end_: int) -> pa.RecordBatch:
        part = rows.slice(begin, end_ - begin)
        s, e, p1, p2, tie, kept = (part.column(c).to_numpy() for c in _ROW)
        # undecided rows in the greedy order
        order = np.lexsort((tie, s, p2, p1))
        bounds = [float(part.column(c)[0].as_py()) for c in edges]
        state = _settle(s, e, order, kept == 1, max_iou, *bounds)
        columns = [pa.concat_arrays(part.column(c).chunks) for c in names[:-1]]
        return pa.record_batch([*columns, pa.array(state.astype(np.int32))], names=names)

    kinds = dict(df.dtypes)
    return map_groups(df, group, ["_s", "_tie"], run, ", ".join(f"{c} {kinds[c]}" for c in names))


def _components(state: DataFrame, key: str, max_iou: float) -> DataFrame:
    """``state`` with ``_band``, ``_comp``, ``_rn`` (place in the component), ``_n`` (its rows) and ``_open`` (undecided ones).

    Two rows clash only if neither is longer than the other by more than 1 / max_iou, and only if the later one starts
    before the first has run for 1 - max_iou of its length. So a key falls apart in bands of lengths that are that far
    from each other, and a band at each start that no row before it reaches.
    """
    steps = F.floor(F.ln(F.col("_e") - F.col("_s")) / math.log(1 / max_iou)).cast("int") if max_iou > 0 else F.lit(0)
    graded = state.withColumn("_step", steps)
    # at most as many lengths as there are exponents
    held = graded.groupBy(key, "_step").agg(F.count(F.lit(1)).alias("_c"))
    along = Window.partitionBy(key).orderBy("_step")
    gap = F.when(F.col("_step") - F.lag("_step").over(along) > 1, 1).otherwise(0)
    bands = held.withColumn("_gap", gap).withColumn("_band", F.sum("_gap").over(along)).select(key, "_step", "_band")
    banded = graded.join(bands, [key, "_step"]).drop("_step")
    reach = F.col("_s") + (F.col("_e") - F.col("_s")) * (1 - max_iou) * (1 + 1e-9)
    swept = range_scan(
        banded, [key, "_band"], ["_s", "_tie"], keep_slice=True, maxes={"_reach": reach}, following={"_then": "_s"},
    )
    # written, as the components are counted from it by the same slices
    swept = materialize(swept.withColumn("_ends", F.when(F.col("_then").isNull() | (F.col("_reach") <= F.col("_then")), 1).otherwise(0)))
    numbered = bucketed_scan(swept, [key, "_band"], "_slice", ["_s", "_tie"], rank="_at", sums={"_upto": F.col("_ends")})
    numbered = numbered.withColumn("_comp", (F.col("_upto") - F.col("_ends")).cast("bigint"))
    sizes = numbered.groupBy(key, "_band", "_comp").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.expr("int(_state = 0)")).alias("_open"), F.min("_at").alias("_begin"), F.max(F.col("_e") - F.col("_s")).alias("_longest"),
    )
    out = numbered.join(sizes, [key, "_band", "_comp"]).withColumn("_rn", F.col("_at") - F.col("_begin") + 1)
    return out.select(key, "_band", "_comp", "_rn", "_n", "_open", "_longest", *_ROW)


def suppress_overlaps(
    df: DataFrame, key: str, start: str, end: str, score: str, distance: str, tie: str,
    max_iou: float = 0.5, block_rows: int = 20_000,
) -> DataFrame:
    """Greedy overlap suppression per key in the order (-score, distance, start, tie).

    Keys of up to ``block_rows`` rows are settled in one pass. A longer key is
    split into components that cannot clash with each other; those that fit
    are settled as a whole, the others in blocks along their starts. A block
    decides the rows whose neighbourhood it sees; only undecided components go
    on to the next round, split anew, with the cuts moved by half a block.
    Where neither cut decides a row, neighbourhoods are wider than a block:
    then the best rows of small cells are compared. Blocks never grow. The
    result equals the sequential pass over each key. Of exact copies of an
    interval only the best can survive, so the others are dropped before
    anything is compared.
    """
    keyed = df.withColumns({
        "_s": F.col(start).cast("double"), "_e": F.col(end).cast("double"),
        "_p1": -F.col(score).cast("double"), "_p2": F.col(distance).cast("double"), "_tie": F.col(tie).cast("bigint"),
    })
    order = F.struct("_p1", "_p2", "_tie")
    positive = F.col("_e") > F.col("_s")
    rest = keyed.filter(~positive)  # empty intervals overlap nothing
    best = keyed.filter(positive).groupBy(key, "_s", "_e").agg(F.min_by(F.struct("_p1", "_p2", "_tie"), order).alias("b")).select(
        key, "_s", "_e", "b.*", F.lit(0).alias("_state")
    )
    if max_iou >= 1:
        chosen = [best.select(key, "_tie")]
    else:
        best = materialize(best)
        counts = best.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        sized = best.join(counts, key)
        small, large = sized.filter(F.col("_n") <= block_rows).drop("_n"), sized.filter(F.col("_n") > block_rows).drop("_n")
        chosen = [_settled(small, [key], max_iou).filter("_state = 1").select(key, "_tie")]
        if not counts.filter(F.col("_n") > block_rows).isEmpty():
            chosen += _rounds(materialize(large), key, max_iou, block_rows)
    kept = reduce(DataFrame.unionByName, chosen).distinct().unionByName(rest.select(key, "_tie"))
    return keyed.join(kept, [key, "_tie"], "left_semi").select(*df.columns)


def _rounds(state: DataFrame, key: str, max_iou: float, block_rows: int) -> list[DataFrame]:
    """Kept rows (key, _tie) of keys that are longer than a block; every round decides at least one row of each component."""
    chosen, group = [], [key, "_band", "_comp", "_block"]
    open_before, stuck, turn = None, 0, 0
    while True:
        parts = _components(state, key, max_iou).filter("_open > 0")
        shift = (block_rows // 2) * (turn % 2)
        fits = F.col("_n") <= block_rows
        block = F.when(fits, 0).otherwise(F.floor((F.col("_rn") - 1 + shift) / F.lit(block_rows))).cast("bigint")
        last = F.floor((F.col("_n") - 1 + shift) / F.lit(block_rows)).cast("bigint")
        blocked = materialize(parts.withColumns({"_block": block, "_last": F.when(fits, 0).otherwise(last)}))
        edges = blocked.groupBy(*group).agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi"), F.first("_last").alias("_end"), F.first("_longest").alias("_longest"))
        edges = edges.select(
            *group, "_longest", F.when(F.col("_block") == 0, F.lit(float("-inf"))).otherwise(F.col("_lo")).alias("_low"),
            F.when(F.col("_block") == F.col("_end"), F.lit(float("inf"))).otherwise(F.col("_hi")).alias("_high"),
        )
        told = blocked.select(*group, *_ROW).join(edges, group)
        done = materialize(_settled(told, group, max_iou, ("_low", "_high", "_longest")))
        chosen.append(done.filter("_state = 1").select(key, "_tie"))
        left = done.filter("_state < 2").select(key, *_ROW)
        n_open = left.filter("_state = 0").count()
        if not n_open:
            return chosen
        stuck = stuck + 1 if n_open == open_before else 0
        if stuck > 1:  # both cuts have been tried
            left, stuck = materialize(_best_of_cells(left, key, max_iou)), 0
            chosen.append(left.filter("_state = 1").select(key, "_tie"))
        state, turn, open_before = materialize(left, replaces=state), turn + 1, n_open


def _best_of_cells(state: DataFrame, key: str, max_iou: float, grain: float = 1.25) -> DataFrame:
    """``state`` after one round in which a row is kept if no row near it is better; suppressed rows are gone.

    Rows of like length and start share a cell. The best undecided row of a cell is kept if it is better than the best
    of every cell that may hold a row it clashes with; it then suppresses the rows it clashes with, as do the rows kept
    before. Rows reach a bounded number of cells, and kept rows do not clash, so few of them share one.
    """
    if max_iou <= 0:
        return _best_of_all(state, key)
    length = F.col("_e") - F.col("_s")
    graded = state.withColumn("_g", F.floor(F.ln(length) / math.log(grain)).cast("int"))
    width = F.pow(F.lit(grain), F.col("_g")) * (grain - 1)
    celled = materialize(graded.withColumn("_cell", F.floor(F.col("_s") / width).cast("bigint")))
    cell, reach = [key, "_g", "_cell"], math.ceil(math.log(1 / max_iou) / math.log(grain)) + 1

    def around(rows: DataFrame) -> DataFrame:
        """Rows under every cell that may hold a row they clash with."""
        levels = rows.withColumn("_g", F.explode(F.sequence(F.col("_g") - reach, F.col("_g") + reach)))
        step, reached = F.pow(F.lit(grain), F.col("_g")) * (grain - 1), length * (1 - max_iou) * (1 + 1e-9)
        low, high = F.col("_s") - reached / max_iou, F.col("_s") + reached
        cells = F.sequence(F.floor(low / step).cast("bigint"), F.floor(high / step).cast("bigint"))
        return levels.withColumn("_cell", F.explode(cells))

    def without_clashes(rows: DataFrame, kept: DataFrame) -> DataFrame:
        told = around(kept.select(*cell, "_s", "_e", "_tie")).select(
            *cell, F.col("_s").alias("_ks"), F.col("_e").alias("_ke"), F.col("_tie").alias("_kt")
        )
        inter = F.least("_e", "_ke") - F.greatest("_s", "_ks")
        hull = F.greatest("_e", "_ke") - F.least("_s", "_ks")
        met = rows.filter("_state = 0").join(told, cell).filter((inter > 0) & (inter > max_iou * hull) & (F.col("_tie") != F.col("_kt")))
        return rows.join(met.select(key, "_tie").distinct(), [key, "_tie"], "left_anti")

    celled = materialize(without_clashes(celled, celled.filter("_state = 1")))
    mine = F.struct("_p1", "_p2", "_s", "_tie", "_e")
    best = materialize(celled.filter("_state = 0").groupBy(*cell).agg(F.min(mine).alias("_best")))
    leaders = best.select(*cell, F.col("_g").alias("_own_g"), F.col("_cell").alias("_own_cell"), "_best.*")
    rivals = around(leaders).select(key, "_g", "_cell", "_own_g", "_own_cell").join(best, cell)
    least = rivals.groupBy(key, "_own_g", "_own_cell").agg(F.min("_best").alias("_least"))
    wins = leaders.join(least, [key, "_own_g", "_own_cell"]).filter(F.col("_least") == mine).select(*cell, "_s", "_e", "_tie")
    wins = materialize(wins)
    left = without_clashes(celled, wins).join(wins.select(key, "_tie", F.lit(1).alias("_won")), [key, "_tie"], "left")
    return left.withColumn("_state", F.coalesce("_won", "_state")).select(key, *_ROW)


def _best_of_all(state: DataFrame, key: str) -> DataFrame:
    """The same where any overlap is a clash: the best undecided row of a key is kept."""
    mine = F.struct("_p1", "_p2", "_s", "_tie", "_e")

    def without_clashes(rows: DataFrame) -> DataFrame:
        # kept rows are disjoint: of those that start before a row ends, one that ends after its start overlaps it
        points = rows.withColumn("_at", F.when(F.col("_state") == 1, F.col("_s")).otherwise(F.col("_e")))
        ends = F.when(F.col("_state") == 1, F.col("_e"))
        swept = range_scan(points, [key], ["_at", "_state", "_tie"], maxes={"_top": ends})
        return swept.filter((F.col("_state") == 1) | F.col("_top").isNull() | (F.col("_top") <= F.col("_s"))).select(key, *_ROW)

    free = materialize(without_clashes(state))
    wins = free.filter("_state = 0").groupBy(key).agg(F.min(mine).alias("_w")).select(key, F.col("_w._tie").alias("_won"))
    chosen = free.join(wins, key, "left").withColumn("_state", F.when(F.col("_tie") == F.col("_won"), 1).otherwise(F.col("_state")))
    return without_clashes(chosen.select(key, *_ROW))


def _quota_pass(pdf: pd.DataFrame, speaker_cap: int, category_cap: int) -> pd.DataFrame:
    """Sequential quota pass over one category's undecided rows."""
    speakers: dict = {}
    phrases: dict = {}
    keep = []
    taken = 0
    pdf = pdf.sort_values(["_p1", "_p2", "_p3", "_id"], kind="stable")
    for speaker, phrase, cap, state in zip(pdf["_speaker"], pdf["_phrase"], pdf["_cap"], pdf["_state"]):
        full = category_cap > 0 and taken >= category_cap
        ok = not full and (state == 1 or (speakers.get(speaker, 0) < speaker_cap and phrases.get(phrase, 0) < cap))
        if ok:
            speakers[speaker] = speakers.get(speaker, 0) + 1
            phrases[phrase] = phrases.get(phrase, 0) + 1
            taken += 1
        keep.append(ok)
    return pdf.loc[keep, ["_category", "_id"]]


def limit_candidates(
    df: DataFrame, category: str, speaker: str, phrase: str, score: str, distance: str, duration: str, row_id: str,
    speaker_cap: int = 50, phrase_cap: int = 20, phrase_caps: dict[str, int] | None = None, category_cap: int = 1000,
    local_rows: int = 200_000,
) -> DataFrame:
    """Quota selection in the order (-score, distance, duration, id), exactly.

    A row is taken while its speaker, its phrase and its category have room
    (``phrase_caps`` overrides the phrase cap of single categories, a category
    cap of 0 means none); a refused row uses up nothing.

    Four facts keep every group bounded. Rows of one (speaker, phrase) pair
    are taken as a prefix, so only the first min(caps) rows of a pair matter.
    A row among the first speaker_cap rows of its speaker and the first
    phrase_cap rows of its phrase, counting rows not yet refused, is certainly
    taken. Once a speaker or phrase is full its other rows are refused. Rows
    behind category_cap taken ones are out. Rounds of these rules run on all
    executors until at most ``local_rows`` open rows are left, which one
    sequential pass per category settles.
    """
    caps = phrase_caps or {}
    widest = max([phrase_cap, *caps.values()])
    cap = F.lit(phrase_cap)
    for name, value in caps.items():
        cap = F.when(F.col(category) == name, F.lit(value)).otherwise(cap)
    rows = df.select(
        F.col(category).alias("_category"), F.col(speaker).alias("_speaker"), F.col(phrase).alias("_phrase"),
        (-F.col(score)).cast("double").alias("_p1"), F.col(distance).cast("double").alias("_p2"),
        F.col(duration).cast("double").alias("_p3"), F.col(row_id).alias("_id"), cap.cast("int").alias("_cap"),
    )
    order = ["_p1", "_p2", "_p3", "_id"]
    unlimited = category_cap <= 0
    if unlimited:
        local_rows = 0

    def first_rows(frame, by, bound, limit=None):
        # The constant bound is applied map-side, so hot keys shrink before the shuffle.
        ranked = top_rows(frame, ["_category", *by], order, bound, ["_id"])
        return ranked.filter(F.col("_rn") <= (bound if limit is None else limit))

    pair_bound = min(speaker_cap, widest)
    pruned = first_rows(rows, ["_speaker", "_phrase"], pair_bound, F.least(F.lit(speaker_cap), F.col("_cap"))).drop("_rn")
    state = materialize(pruned.withColumn("_state", F.lit(0)))
    while state.filter("_state = 0").count() > local_rows:
        state = materialize(_quota_round(state, first_rows, speaker_cap, widest, category_cap), replaces=state)
    if unlimited:
        chosen = state.filter("_state = 1").select("_category", "_id")
    else:
        taken = first_rows(state.filter("_state = 1"), [], category_cap).drop("_rn")
        key = dict(state.dtypes)
        chosen = taken.unionByName(state.filter("_state = 0")).groupBy("_category").applyInPandas(
            lambda pdf: _quota_pass(pdf, speaker_cap, category_cap), f"_category {key['_category']}, _id {key['_id']}"
        )
    chosen = chosen.withColumnsRenamed({"_category": category, "_id": row_id})
    return df.join(chosen, [category, row_id], "left_semi")


def _quota_round(state: DataFrame, first_rows, speaker_cap: int, widest: int, category_cap: int) -> DataFrame:
    by_speaker = first_rows(state, ["_speaker"], speaker_cap).select("_category", "_id")
    by_phrase = first_rows(state, ["_phrase"], widest, F.col("_cap")).select("_category", "_id")
    sure = by_speaker.join(by_phrase, ["_category", "_id"]).withColumn("_sure", F.lit(1))
    marked = state.join(sure, ["_category", "_id"], "left").withColumn(
        "_state", F.when(F.col("_sure") == 1, 1).otherwise(F.col("_state"))
    ).drop("_sure")
    taken = marked.filter("_state = 1")
    full_speakers = taken.groupBy("_category", "_speaker").agg(F.count(F.lit(1)).alias("_c")).filter(
        F.col("_c") >= speaker_cap
    ).select("_category", "_speaker", F.lit(1).alias("_fs"))
    full_phrases = taken.groupBy("_category", "_phrase").agg(
        F.count(F.lit(1)).alias("_c"), F.max("_cap").alias("_m")
    ).filter(F.col("_c") >= F.col("_m")).select("_category", "_phrase", F.lit(1).alias("_fp"))
    still = marked.join(full_speakers, ["_category", "_speaker"], "left").join(full_phrases, ["_category", "_phrase"], "left")
    still = still.filter((F.col("_state") == 1) | (F.col("_fs").isNull() & F.col("_fp").isNull()))
    if category_cap > 0:
        position = F.struct("_p1", "_p2", "_p3", "_id")
        last = first_rows(taken, [], category_cap).filter(F.col("_rn") == category_cap).select("_category", position.alias("_cut"))
        still = still.join(last, "_category", "left").filter(F.col("_cut").isNull() | (position <= F.col("_cut")))
    return still.select(*state.columns)


def chained_quota(df: DataFrame, caps: list[tuple[list[str], int]], order: list[Column], row_id: str) -> DataFrame:
    """Independent top-n filters one after another.

    Cheaper than ``limit_candidates`` but not the same: here a row refused by a
    later cap has already used room under an earlier one.
    """
    for keys, n in caps:
        df = top_rows(df, keys, order, n, [row_id]).drop("_rn")
    return df
