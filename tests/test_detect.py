import random

from earshot.operators.detect import SegmentMachine, SmoothedTrigger, TriggerMachine, replay


def sequential(machine, frames):
    state, out = machine.start(), []
    for at, *frame in frames:
        state, event = machine.step(state, *frame)
        if event is not None:
            out.append((at, *event))
    return out


def test_trigger_replay_in_blocks(spark):
    rng = random.Random(4)
    frames = [(k, i, rng.choice("xy"), rng.random()) for k, n in ((0, 900), (1, 150), (2, 30)) for i in range(1, n + 1)]
    machine = TriggerMachine(0.4, 2, 7)
    df = spark.createDataFrame(frames, "dev int, seq long, label string, score double")
    got = replay(df, ["dev"], "seq", machine, ["label", "score"], {"hit": "string", "at_score": "double"}, block_rows=16).collect()
    for k in (0, 1, 2):
        want = sequential(machine, [f[1:] for f in frames if f[0] == k])
        assert sorted((r.seq, r.hit, r.at_score) for r in got if r.dev == k) == want


def test_segment_replay_in_blocks(spark):
    rng = random.Random(8)
    frames, on = [], False
    for i in range(1, 1500):
        on = on if rng.random() < 0.8 else not on
        frames.append((1, i, i, round(rng.random(), 3), on))
    machine = SegmentMachine(threshold=0.5, onset=2, hangover=3, shortest=2, longest=20, pre=4, cooldown=6)
    fields = {"first": "long", "last": "long", "speech": "long", "score": "double", "fired": "boolean"}
    df = spark.createDataFrame(frames, "dev int, seq long, at long, value double, active boolean")
    got = replay(df, ["dev"], "seq", machine, ["at", "value", "active"], fields, block_rows=25).collect()
    want = sequential(machine, [f[1:] for f in frames])
    assert len(want) > 10
    assert sorted(tuple(r)[1:] for r in got) == sorted(want)


def test_trigger_rules():
    machine = TriggerMachine(0.5, 2, 2)
    frames = [(1, "a", 0.9), (2, "b", 0.9), (3, "b", 0.9), (4, "b", 0.9), (5, "b", 0.9), (6, "b", 0.9), (7, "b", 0.1), (8, "b", 0.9)]
    # the switch restarts the count, frames 4 and 5 are cooldown, 6 starts again, 7 clears it
    assert sequential(machine, frames) == [(3, "b", 0.9)]


def test_smoothing_runs_through_cooldown_and_skips_rejected():
    machine = SmoothedTrigger(("_unknown_", "a", "b"), TriggerMachine(0.5, 1, 1), alpha=0.5)
    frames = [(1, 0.0, 1.0, 0.0), (2, 1.0, 0.0, 0.0), (3, 1.0, 0.0, 0.0), (4, 0.0, 0.0, 1.0)]
    assert sequential(machine, frames) == [(1, "a", 1.0), (4, "b", 0.5)]


def test_segment_closed_by_length_and_short_discard():
    by_length = SegmentMachine(0.0, onset=1, hangover=2, shortest=1, longest=4, pre=1, cooldown=0)
    assert sequential(by_length, [(i, i, 1.0, True) for i in range(1, 6)])[0] == (4, 1, 4, 4, 1.0, True)
    frames = [(1, 1, 1.0, True), (2, 2, 0.0, False), (3, 3, 0.0, False)]
    short = dict(onset=1, hangover=2, shortest=2, longest=9, pre=1, cooldown=0)
    assert sequential(SegmentMachine(0.0, **short, discard_short=True), frames) == []
    # the length is raised to the least, and only those frames are scored
    assert sequential(SegmentMachine(0.0, **short), frames)[0][3:] == (2, 0.5, True)
