"""Detector machines as stateful streaming operators, one state per device."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Length of the stretches of event time in which frames wait.
BUCKET_MS = 1000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State store that ``transformWithStateInPandas`` needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class MachineProcessor(StatefulProcessor):
    """Runs a machine over the frames of one key.

    With ``buffered`` frames wait in state until the watermark has passed them
    and are then handled in time order; without it each micro-batch is sorted
    and handled at once, which suits sources that deliver in order. Waiting
    frames lie in stretches of event time, each an entry of a map with one
    timer, at its end; a timer reads and removes its own entries only.
    """

    def __init__(self, machine, keys, order, columns, fields, buffered):
        self.machine, self.keys, self.order = machine, keys, order
        self.columns, self.fields, self.buffered = columns, fields, buffered

    def init(self, handle) -> None:
        self.state = handle.getValueState("machine", "body string")
        if self.buffered:
            self.waiting = handle.getMapState("waiting", "bucket bigint", "body string")
        self.handle = handle

    def _advance(self, key, frames: list[list]) -> pd.DataFrame:
        state = json.loads(self.state.get()[0]) if self.state.exists() else self.machine.start()
        out = []
        for frame in sorted(frames, key=lambda f: f[: len(self.order)]):
            state, event = self.machine.step(state, *frame[len(self.order):])
            if event is not None:
                out.append((*key, frame[len(self.order) - 1], *event))
        self.state.update((json.dumps(state),))
        return pd.DataFrame(out, columns=[*self.keys, self.order[-1], *self.fields])

    def _frames(self, rows: Iterator[pd.DataFrame]) -> list[list]:
        names = [*self.order, *self.columns]
        # A key whose timers fire without new rows may come with a column-less frame.
        return [list(r) for pdf in rows if len(pdf) for r in zip(*[pdf[c].tolist() for c in names])]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = self._frames(rows)
        if not self.buffered:
            yield self._advance(key, frames)
            return
        by_bucket: dict[int, list[list]] = {}
        for frame in frames:
            by_bucket.setdefault(int(frame[0] // (1000 * BUCKET_MS)), []).append(frame)
        for bucket, new in by_bucket.items():
            if self.waiting.containsKey((bucket,)):
                new = json.loads(self.waiting.getValue((bucket,))[0]) + new
            else:
                self.handle.registerTimer((bucket + 1) * BUCKET_MS)
            self.waiting.updateValue((bucket,), (json.dumps(new),))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # timers of one key come in the order of their times
        bucket = (expiredTimerInfo.getExpiryTimeInMs() // BUCKET_MS - 1,)
        if not self.waiting.containsKey(bucket):
            yield pd.DataFrame()
            return
        ready = json.loads(self.waiting.getValue(bucket)[0])
        self.waiting.removeKey(bucket)
        yield self._advance(key, ready)

    def close(self) -> None:
        pass


def detect_stream(
    frames: DataFrame, key: str, ts: str, tie: str, machine, columns: list[str], fields: dict[str, str], lateness: str | None = None
) -> DataFrame:
    """Events of ``machine`` along each device's frames.

    ``lateness`` (e.g. ``"10 seconds"``) turns on reordering by event time:
    frames are held back until the watermark passes, later ones are dropped.
    """
    types = dict(frames.dtypes)
    schema = ", ".join([f"{key} {types[key]}", f"{tie} {types[tie]}"] + [f"{n} {t}" for n, t in fields.items()])
    # The processor sorts by (microseconds, tie); both survive as JSON numbers.
    base = frames.withWatermark(ts, lateness) if lateness else frames
    base = base.withColumn("at_us", F.unix_micros(ts)).select(key, ts, "at_us", tie, *columns)
    return base.groupBy(key).transformWithStateInPandas(
        statefulProcessor=MachineProcessor(machine, [key], ["at_us", tie], columns, list(fields), lateness is not None),
        outputStructType=schema, outputMode="Append", timeMode="EventTime" if lateness else "None",
    )
