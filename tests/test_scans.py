import random

from pyspark.sql import functions as F

from earshot.operators import scans
from earshot.operators import sequences as Q
from earshot.operators import splits as S


def skewed(spark, n=600, seed=3):
    """A third of all rows belongs to one key."""
    rng = random.Random(seed)
    rows = [(0 if rng.random() < 0.34 else rng.randrange(1, 6), i, rng.randrange(50), round(rng.random(), 3)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k int, id long, ord int, v double")


def test_bucketed_scan_matches_sequential_pass(spark):
    rows, df = skewed(spark)
    out = scans.bucketed_scan(
        df.withColumn("b", F.floor(F.col("ord") / 7)), ["k"], "b", ["ord", "id"], rank="rn", count="n",
        sums={"run": F.col("v")}, maxes={"top": F.when(F.col("v") > 0.5, F.col("v"))}, totals={"all": F.lit(1)},
        following={"nxt": "id"}, preceding={"prv": "id"},
    ).collect()
    got = {r.id: r for r in out}
    assert len(got) == len(rows)
    for key in range(6):
        series = sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1]))
        total, top = 0.0, None
        for i, (_, rid, _, v) in enumerate(series):
            total += v
            top = max([x for x in (top, v if v > 0.5 else None) if x is not None], default=None)
            r = got[rid]
            assert (r.rn, r.n, r.top) == (i + 1, len(series), top) and abs(r.run - total) < 1e-9
            assert getattr(r, "all") == len(series)
            assert r.prv == (series[i - 1][1] if i else None)
            assert r.nxt == (series[i + 1][1] if i + 1 < len(series) else None)


def test_hash_rank_is_a_permutation_per_group(spark):
    rows, df = skewed(spark)
    out = scans.hash_rank(df, ["k"], ["id"], 7, "rn", "n").collect()
    for key in range(6):
        ranks = sorted(r.rn for r in out if r.k == key)
        assert ranks == list(range(1, len(ranks) + 1))
    again = scans.hash_rank(df.repartition(5), ["k"], ["id"], 7, "rn").collect()
    assert {r.id: r.rn for r in out} == {r.id: r.rn for r in again}


def test_halo_windows_equal_whole_series(spark):
    rows, df = skewed(spark)
    series = scans.integer_rank(df, ["k"], "id", "seq")
    out = Q.rolling_window(series, ["k"], "seq", 6, 1, {"s": F.sum("v")}, block_rows=16).collect()
    got = {r.id: r.s for r in out}
    for key in range(6):
        values = [r for r in rows if r[0] == key]
        for i in range(5, len(values)):
            assert abs(got[values[i][1]] - sum(x[3] for x in values[i - 5 : i + 1])) < 1e-9
    assert len(got) == sum(max(0, sum(r[0] == k for r in rows) - 5) for k in range(6))


def test_ema_streaks_and_crop_on_small_blocks(spark):
    rows, df = skewed(spark, 400)
    series = scans.integer_rank(df, ["k"], "id", "seq").withColumn("lab", (F.col("ord") % 2).cast("string"))
    smooth = {r.id: r.e for r in Q.ema(series, ["k"], "seq", {"e": "v"}, 0.25).collect()}
    prev = scans.bucketed_scan(
        scans.with_blocks(series, "seq", 8), ["k"], "block", ["seq"], preceding={"pl": "lab", "pv": "v"}
    ).drop("block")
    runs = {r.id: r.streak for r in Q.streaks(
        prev, ["k"], "seq", F.col("v") > 0.4, "lab", F.col("pv") > 0.4, "pl", block_rows=8).collect()}
    crop = {r.k: r.start for r in Q.energy_crop(series, ["k"], "seq", "v", 7, hop=2, block_rows=16).collect()}
    for key in range(6):
        mine = [r for r in rows if r[0] == key]
        s, run, last = None, 0, None
        for _, rid, order, v in mine:
            s = v if s is None else 0.25 * v + 0.75 * s
            assert abs(smooth[rid] - s) < 1e-9
            lab = order % 2
            run = 0 if v <= 0.4 else (run + 1 if run and last == lab else 1)
            last = lab
            assert runs[rid] == run
        energy = [(sum(x[3] ** 2 for x in mine[i : i + 7]), -i) for i in range(0, len(mine) - 6, 2)]
        assert crop[key] == -max((round(e, 9), i) for e, i in energy)[1]


def test_ema_over_many_blocks(spark):
    df = spark.range(1, 5001).select(F.lit(1).alias("k"), F.col("id").alias("seq"), F.sin("id").alias("v"))
    got = {r.seq: r.e for r in Q.ema(df, ["k"], "seq", {"e": "v"}, 0.3).collect()}
    import math

    s = math.sin(1)
    for i in range(2, 5001):
        s = 0.3 * math.sin(i) + 0.7 * s
        assert abs(got[i] - s) < 1e-10


def test_rows_from_counts_in_chunks(spark):
    counts = spark.createDataFrame([("a", 25), ("b", 0), ("c", 10)], "s string, n long")
    out = S.rows_from_counts(counts, "n", "i", chunk=10).groupBy("s").agg(F.count("*").alias("c"), F.countDistinct("i").alias("d"), F.max("i").alias("m"))
    assert {(r.s, r.c, r.d, r.m) for r in out.collect()} == {("a", 25, 25, 25), ("c", 10, 10, 10)}


def test_splits_keep_speakers_apart(spark):
    _, df = skewed(spark)
    people = df.withColumn("spk", F.concat(F.lit("s"), F.col("id") % 23))
    for out in (S.speaker_split(people, "spk", 1, 10, 10), S.manifest_split(people, "spk", 1)):
        assert out.groupBy("spk").agg(F.countDistinct("split").alias("n")).filter("n > 1").isEmpty()
    two = spark.createDataFrame([("a",), ("b",)], "spk string")
    assert {r.split for r in S.speaker_split(two, "spk", 1, 10, 10).collect()} == {"training"}
    four = spark.createDataFrame([(x,) for x in "abcd"], "spk string")
    crowded = [r.split for r in S.speaker_split(four, "spk", 1, 50, 50).collect()]
    assert sorted(crowded) == ["testing"] * 3 + ["training"]


def test_length_buckets_order(spark):
    df = spark.createDataFrame([(i, (i * 37) % 90) for i in range(200)], "id long, n int")
    out = S.length_buckets(df, "id", "n", 10, 16).collect()
    spans = {}
    for r in out:
        spans.setdefault(r.batch, []).append(r.n)
    assert all(len(v) == 16 for b, v in spans.items() if b < 12)
    for b in range(len(spans) - 1):
        assert max(spans[b]) <= min(spans[b + 1])


def test_large_top_n_uses_salted_parts(spark, monkeypatch):
    rows, df = skewed(spark)
    monkeypatch.setattr(scans, "MAP_SIDE_ROWS", 5)
    out = scans.top_rows(df, ["k"], [F.desc("v"), "id"], 20, ["id"]).collect()
    for key in range(6):
        want = [r[1] for r in sorted((r for r in rows if r[0] == key), key=lambda r: (-r[3], r[1]))[:20]]
        assert [r.id for r in sorted((r for r in out if r.k == key), key=lambda r: r._rn)] == want
