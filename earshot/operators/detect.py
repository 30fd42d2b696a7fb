"""Keyword detectors as small state machines, and their replay over series.

A machine has ``start()`` and ``step(state, *frame) -> (state, event | None)``;
states are plain lists, so the same machine runs in a streaming query and in a
test loop. For batch jobs a machine also tells what it would do from a fresh
start, frame by frame (``candidates``); ``replay`` then only has to find which
of these starts the sequential pass goes through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.operators.scans import map_groups, with_margins
from earshot.session import materialize

#: No further frame.
NEVER = 1 << 62


def runs_of(flags: np.ndarray) -> np.ndarray:
    """How many flags in a row are set up to each place."""
    at = np.arange(len(flags))
    return at - np.maximum.accumulate(np.where(flags, -1, at)) if len(flags) else at


@dataclass(frozen=True)
class TriggerMachine:
    """Fires after ``trigger_frames`` consecutive frames of one label above the threshold.

    Then ``cooldown_frames`` frames are ignored; a label switch restarts the
    count at one; a frame below the threshold clears it.
    """

    threshold: float
    trigger_frames: int = 3
    cooldown_frames: int = 50

    def start(self):
        return [0, None, 0]  # cooldown left, streak label, streak length

    def step(self, state, label, score):
        cooldown, streak_label, streak = state
        if cooldown > 0:
            return [cooldown - 1, None, 0], None
        if score < self.threshold:
            return [0, None, 0], None
        streak = streak + 1 if label == streak_label else 1
        if streak >= self.trigger_frames:
            return [self.cooldown_frames, None, 0], (label, float(score))
        return [0, label, streak], None

    def reach(self) -> tuple[int, int]:
        """Rows that a candidate needs before and after its frame."""
        return self.trigger_frames, 0

    def candidates(self, position: np.ndarray, label: np.ndarray, score: np.ndarray):
        """Places at which a streak is complete, the first position allowed to complete the next one, whether there is
        an event, and the events: position and fields.

        From a fresh start the machine fires at the first complete streak that lies wholly after the start.
        """
        loud = score >= self.threshold
        same = np.concatenate(([False], label[1:] == label[:-1])) if len(label) else loud
        # a streak goes on where label and loudness do
        goes_on = runs_of(loud & same & np.concatenate(([False], loud[:-1]))) if len(label) else loud
        hit = np.flatnonzero(loud & (goes_on + 1 >= self.trigger_frames))
        free = position[hit] + self.cooldown_frames + max(self.trigger_frames, 1)
        return hit, free, np.ones(len(hit), bool), [position[hit], label[hit], score[hit]]

    @property
    def first(self) -> int:
        """The first position at which a candidate may stand in a fresh series."""
        return max(self.trigger_frames, 1)


@dataclass(frozen=True)
class SmoothedTrigger:
    """Exponential smoothing of class probabilities, then ``TriggerMachine``.

    Smoothing goes on during the cooldown; rejected classes never compete.
    Scores are rounded so that ties do not depend on the order of additions.
    """

    labels: tuple[str, ...]
    machine: TriggerMachine
    alpha: float = 1.0
    reject: tuple[str, ...] = ("_unknown_", "_silence_")
    digits: int = 9

    def start(self):
        return [None, self.machine.start()]

    def step(self, state, *probs):
        smooth, inner = state
        probs = [float(p) for p in probs]
        if smooth is None:
            smooth = probs
        else:
            smooth = [self.alpha * p + (1 - self.alpha) * s for p, s in zip(probs, smooth)]
        score, _, label = max(
            (round(s, self.digits), -i, name)
            for i, (s, name) in enumerate(zip(smooth, self.labels)) if name not in self.reject
        )
        inner, event = self.machine.step(inner, label, score)
        return [smooth, inner], event

    def reach(self) -> tuple[int, int]:
        """What is further back than this many rows is below the precision of a double."""
        before, after = self.machine.reach()
        memory = math.ceil(-38 / math.log1p(-self.alpha)) if self.alpha < 1 else 0
        return before + memory, after

    def candidates(self, position: np.ndarray, *probs: np.ndarray):
        smooth = np.column_stack(probs).astype(float)
        for i in range(1, len(smooth)):
            smooth[i] = self.alpha * smooth[i] + (1 - self.alpha) * smooth[i - 1]
        accepted = [i for i, name in enumerate(self.labels) if name not in self.reject]
        rounded = np.array([[round(x, self.digits) for x in row] for row in smooth[:, accepted].tolist()]).reshape(-1, len(accepted))
        best = rounded.argmax(axis=1) if len(rounded) else np.zeros(0, int)
        names = np.array([self.labels[i] for i in accepted], dtype=object)
        return self.machine.candidates(position, names[best], rounded[np.arange(len(best)), best])

    @property
    def first(self) -> int:
        return self.machine.first


@dataclass(frozen=True)
class SegmentMachine:
    """Speech segments from an external activity flag, in frames.

    Onset after ``onset`` active frames, with up to ``pre`` earlier frames
    included; a segment closes after ``hangover`` silent frames or at
    ``longest`` frames. Its speech is what comes before the hangover, at least
    ``shortest`` frames; it fires when the mean value of the speech frames
    reaches the threshold, and ``cooldown`` frames are then skipped.
    ``discard_short`` drops segments whose raw speech is below ``shortest``.
    """

    threshold: float
    onset: int = 3
    hangover: int = 15
    shortest: int = 10
    longest: int = 155
    pre: int = 5
    cooldown: int = 50
    discard_short: bool = False

    def start(self):
        # cooldown, active run, in speech, silent run, values of the segment, recent values
        return [0, 0, 0, 0, [], []]

    def step(self, state, position, value, active):
        cooldown, run, speaking, silent, values, recent = state
        recent = [*recent, value][-self.pre:] if self.pre else []
        if cooldown > 0:
            return [cooldown - 1, run, speaking, silent, values, recent], None
        if not speaking:
            run = run + 1 if active else 0
            if run >= self.onset:
                return [0, 0, 1, 0, recent, recent], None
            return [0, run, 0, 0, [], recent], None
        values = [*values, value]
        length = len(values)
        silent = 0 if active else silent + 1
        by_length = length >= self.longest
        if not by_length and silent < self.hangover:
            return [0, 0, 1, silent, values, recent], None
        speech = length if by_length else length - self.hangover
        if speech < self.shortest and self.discard_short:
            return [0, 0, 0, 0, [], recent], None
        speech = max(self.shortest, speech)
        score = sum(values[:speech]) / len(values[:speech])
        fired = score >= self.threshold
        event = (int(position - length + 1), int(position), int(speech), float(score), bool(fired))
        return [self.cooldown if fired else 0, 0, 0, 0, [], recent], event

    @property
    def first(self) -> int:
        return max(self.onset, 1)

    def reach(self) -> tuple[int, int]:
        return max(self.onset, self.pre, 1) + 1, max(self.longest, 1) + self.hangover

    def candidates(self, place: np.ndarray, position: np.ndarray, value: np.ndarray, active: np.ndarray):
        """Frames at which speech would set in, and the segments that start there.

        From a fresh start, speech sets in at the first frame whose last ``onset`` frames are active and come after the
        start. The segment then ends by its length or at the first frame after ``hangover`` silent ones, whichever is
        first; the machine is fresh again after it and its cooldown. A segment that the series ends in has no event.
        """
        n = len(place)
        active = active.astype(bool)
        hit = np.flatnonzero(runs_of(active) >= max(self.onset, 1))
        length = np.minimum(self.pre, place[hit])
        silences = np.flatnonzero(runs_of(~active) >= self.hangover)
        by_silence = np.append(silences, n)[np.searchsorted(silences, hit + 1)]
        by_length = hit + np.maximum(self.longest - length, 1)
        end = np.minimum(by_silence, by_length)
        closed = end < n
        end = np.minimum(end, max(n - 1, 0))
        length = length + end - hit
        at_length = length >= self.longest
        raw = np.where(at_length, length, length - self.hangover)
        kept = closed & ~((raw < self.shortest) & self.discard_short)
        speech = np.maximum(self.shortest, raw)
        first = end - length + 1
        total = np.concatenate(([0], np.cumsum(value.astype(np.longdouble))))
        counted = np.maximum(np.minimum(speech, length), 1)
        score = (total[np.minimum(first + counted, n)] - total[first]).astype(np.float64) / counted
        fired = kept & (score >= self.threshold)
        rest = np.where(closed, place[end] + 1 + np.where(fired, self.cooldown, 0) + max(self.onset, 1) - 1, NEVER)
        # the event stands at the frame that closes it
        return hit, rest, kept, [place[end], position[end] - length + 1, position[end], speech, score, fired]


def after_first_window(frames: DataFrame, position: str, window_frames: int) -> DataFrame:
    """Frames from the one that fills the window on, numbered from 1: before it a detector neither scores nor smooths."""
    return frames.filter(F.col(position) >= window_frames).withColumn(position, F.col(position) - (window_frames - 1))


def _chain(at: np.ndarray, free: np.ndarray, entry: int) -> tuple[list[int], int]:
    """Candidates that a sequential pass entering at position ``entry`` goes through, and the position it leaves with."""
    taken = []
    i = int(np.searchsorted(at, entry))
    while i < len(at):
        taken.append(i)
        entry = int(free[i])
        i = int(np.searchsorted(at, entry))
    return taken, entry


def _transitions(at: np.ndarray, free: np.ndarray) -> np.ndarray:
    """The position with which a pass leaves the block, for each candidate at which it may enter."""
    out = free.copy()
    nxt = np.searchsorted(at, free)
    for i in range(len(at) - 1, -1, -1):
        if nxt[i] < len(at):
            out[i] = out[nxt[i]]
    return out


def replay(
    frames: DataFrame, keys: list[str], position: str, machine, columns: list[str], fields: dict[str, str],
    block_rows: int = 65_536,
) -> DataFrame:
    """Events of a machine run along every series (``position`` is 1, 2, ...), exactly as one sequential pass.

    1. Every block of a series, with the frames around it that a candidate
       needs, lists its candidates: what the machine does from a fresh start
       and the first position at which the next candidate may stand. A series
       of one block is settled at once.
    2. A block is a map from the position at which a pass enters it to the one
       with which it leaves. The maps of a series are applied in order, which
       gives the entry of every block.
    3. Every block picks its candidates from its entry.

    These are all passes, whatever the states do. A task holds one block, or
    the maps of one series, which have a row per block, and only the entries
    that the longest step can reach.
    """
    before, after = machine.reach()
    blocks = with_margins(frames.select(*keys, position, *columns), position, before, after, block_rows)
    block_rows = max(block_rows, before, after)
    types = dict(blocks.dtypes)
    key_fields = ", ".join(f"{k} {types[k]}" for k in keys)
    event_fields = ", ".join(f"{n} {t}" for n, t in fields.items())
    group = [*keys, "block"]

    def one(column: pa.ChunkedArray) -> pa.Array:
        return pa.concat_arrays(column.chunks)

    def arrays(rows, names, begin, end):
        return [rows.column(n).slice(begin, end - begin).to_numpy() for n in names]

    def list_candidates(rows: pa.Table, begin: int, end: int) -> pa.RecordBatch | None:
        at, own = arrays(rows, [position, "is_own"], begin, end)
        hit, free, told, values = machine.candidates(at, *arrays(rows, columns, begin, end))
        stays = own[hit]
        hit, free, told, values = hit[stays], free[stays], told[stays], [v[stays] for v in values]
        settled = rows.column("block")[begin].as_py() == 0 and at[-1] <= block_rows and not (len(at) == block_rows and after == 0)
        if settled:
            taken, _ = _chain(at[hit], free, machine.first)
            taken = [i for i in taken if told[i]]
            hit, free, told, values = hit[taken], free[taken], told[taken], [v[taken] for v in values]
        if not len(hit):
            return None
        lead = [one(rows.column(k).take(pa.array(np.full(len(hit), begin)))) for k in group]
        return pa.record_batch(
            [*lead, pa.array(at[hit], pa.int64()), pa.array(free, pa.int64()), pa.array(told), pa.array(np.full(len(hit), settled)), *(pa.array(v) for v in values)],
            names=[*group, "_at", "_free", "_told", "_settled", position, *fields],
        )

    schema = f"{key_fields}, block bigint, _at bigint, _free bigint, _told boolean, _settled boolean, {position} {types[position]}, {event_fields}"
    found = materialize(map_groups(blocks, group, [position], list_candidates, schema))
    settled = found.filter("_settled")
    open_ = found.filter("not _settled")
    longest = open_.agg(F.max(F.when(F.col("_free") < NEVER, F.col("_free") - F.col("_at")))).first()[0]
    events = settled.select(*keys, position, *fields)
    if longest is None and open_.isEmpty():
        return events
    longest = longest or 0  # no candidate leads on

    def transitions(rows: pa.Table, begin: int, end: int) -> pa.RecordBatch:
        at, free = arrays(rows, ["_at", "_free"], begin, end)
        leaves = _transitions(at, free)
        # a pass comes in at most one step behind the block's first row
        block = rows.column("block")[begin].as_py()
        within = at <= block * block_rows + longest + 1
        within[: int(np.searchsorted(at, block * block_rows + longest + 1)) + 1] = True
        lead = [one(rows.column(k).slice(begin, 1)) for k in group]
        return pa.record_batch([*lead, pa.array([at[within].tolist()]), pa.array([leaves[within].tolist()])], names=[*group, "_at", "_leaves"])

    maps = map_groups(open_, group, ["_at"], transitions, f"{key_fields}, block bigint, _at array<bigint>, _leaves array<bigint>")

    def entries(rows: pa.Table, begin: int, end: int) -> pa.RecordBatch:
        entry, out = machine.first, []
        for k in range(begin, end):
            out.append(entry)
            at = rows.column("_at")[k].values.to_numpy()
            i = int(np.searchsorted(at, entry))
            if i < len(at):
                entry = int(rows.column("_leaves")[k].values[i].as_py())
        lead = [one(rows.column(k).slice(begin, end - begin)) for k in group]
        return pa.record_batch([*lead, pa.array(out, pa.int64())], names=[*group, "_entry"])

    entered = map_groups(maps, keys, ["block"], entries, f"{key_fields}, block bigint, _entry bigint")
    told_of = entered.withColumnsRenamed({c: f"_of_{c}" for c in group})
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in group]
    started = open_.join(told_of, same).drop(*(f"_of_{c}" for c in group))

    def pick(rows: pa.Table, begin: int, end: int) -> pa.RecordBatch:
        at, free, told = arrays(rows, ["_at", "_free", "_told"], begin, end)
        taken, _ = _chain(at, free, rows.column("_entry")[begin].as_py())
        picked = pa.array([begin + i for i in taken if told[i]], pa.int64())
        return rows.select([*keys, position, *fields]).take(picked).combine_chunks().to_batches()[0] if len(picked) else None

    picked = map_groups(started, group, ["_at"], pick, f"{key_fields}, {position} {types[position]}, {event_fields}")
    return events.union(picked)
