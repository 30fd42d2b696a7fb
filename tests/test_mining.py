import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from earshot.functions import text as T
from earshot.operators import mining as M


def follows_quotas(rows, chosen, speaker_cap, phrase_cap, caps, category_cap):
    """Whether a row is chosen exactly if its speaker, phrase and category have room among the chosen rows before it."""
    frame = pd.DataFrame(rows, columns=["id", "cat", "spk", "phr", "score", "dist", "dur"])
    frame = frame.sort_values(["cat", "score", "dist", "dur", "id"], ascending=[True, False, True, True, True])
    frame["taken"] = frame["id"].isin(chosen).astype(int)
    before = {tuple(by): frame.groupby(list(by))["taken"].cumsum() - frame["taken"] for by in (("cat", "spk"), ("cat", "phr"), ("cat",))}
    room = (before["cat", "spk"] < speaker_cap) & (before["cat", "phr"] < frame["cat"].map(caps).fillna(phrase_cap))
    if category_cap:
        room &= before[("cat",)] < category_cap
    return (room == (frame["taken"] == 1)).all()


def quota_rows(seed):
    rng = random.Random(seed)
    hot = lambda n: 0 if rng.random() < 0.34 else rng.randrange(n)
    return [(i, rng.choice("ab"), hot(25), hot(15), rng.randrange(40) / 10, rng.randrange(3), rng.random()) for i in range(500)]


def test_quota_rounds_equal_sequential_pass(spark):
    for seed, local_rows, category_cap in ((1, 200_000, 60), (2, 0, 60), (3, 0, 0), (4, 40, 25)):
        rows = quota_rows(seed)
        df = spark.createDataFrame(rows, "id long, cat string, spk long, phr long, score double, dist int, dur double")
        out = M.limit_candidates(
            df, "cat", "spk", "phr", "score", "dist", "dur", "id", speaker_cap=4, phrase_cap=6, phrase_caps={"b": 3},
            category_cap=category_cap, local_rows=local_rows,
        )
        assert follows_quotas(rows, {r.id for r in out.collect()}, 4, 6, {"b": 3}, category_cap)


def iou(a, b):
    inter = max(0.0, min(a[3], b[3]) - max(a[2], b[2]))
    hull = max(a[3], b[3]) - min(a[2], b[2])
    return inter / hull if hull > 0 else 0.0


def test_suppression_in_small_blocks_equals_sequential_pass(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        key = 0 if rng.random() < 0.5 else rng.randrange(1, 4)
        start = round(rng.random() * 60, 2)
        rows.append((i, key, start, start + rng.choice([0.0, 0.5, 1.0, 1.5, 2.0]), rng.randrange(20) / 20, rng.randrange(3)))
    rows += [(1000 + i, 0, 10.0, 11.0, 0.5, 1) for i in range(50)]  # copies
    want = []
    for key in range(4):
        kept = []
        for r in sorted((r for r in rows if r[1] == key), key=lambda r: (-r[4], r[5], r[2], r[0])):
            if all(iou(r, k) <= 0.5 for k in kept):
                kept.append(r)
        want += [r[0] for r in kept]
    df = spark.createDataFrame(rows, "id long, k int, s double, e double, score double, dist int")
    for block_rows in (60, 20_000):
        out = M.suppress_overlaps(df, "k", "s", "e", "score", "dist", "id", block_rows=block_rows)
        assert sorted(r.id for r in out.collect()) == sorted(want)


def test_suppression_of_a_long_chain_and_one_interval_over_all(spark):
    # rising scores: every decision waits for the next row's, over several blocks; one interval spans the key
    rows = [(i, 0, i * 1.0, i + 1.4, i / 1000, 0) for i in range(90)] + [(5000, 0, 0.0, 500.0, 2.0, 0)]
    df = spark.createDataFrame(rows, "id long, k int, s double, e double, score double, dist int")
    out = sorted(r.id for r in M.suppress_overlaps(df, "k", "s", "e", "score", "dist", "id", max_iou=0.15, block_rows=25).collect())
    assert out == [*range(1, 90, 2), 5000]


def greedy(rows, max_iou):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[4], r[5], r[2], r[0])):
        clash = False
        for k in kept:
            inter = min(r[3], k[3]) - max(r[2], k[2])
            clash |= inter > 0 and inter > max_iou * (max(r[3], k[3]) - min(r[2], k[2]))
        if not clash:
            kept.append(r)
    return sorted(r[0] for r in kept)


@pytest.mark.parametrize("max_iou", [0.5, 0.0])
def test_suppression_of_neighbourhoods_wider_than_a_block(spark, max_iou):
    rng = random.Random(3)
    rows = [(i, 0, rng.random(), 10 + rng.random(), rng.random(), rng.randrange(3)) for i in range(30)]
    rows += [(i, 0, s := rng.random() * 40, s + rng.choice([0.3, 4.0]), rng.random(), 0) for i in range(100, 115)]
    df = spark.createDataFrame(rows, "id long, k int, s double, e double, score double, dist int")
    out = M.suppress_overlaps(df, "k", "s", "e", "score", "dist", "id", max_iou=max_iou, block_rows=8)
    assert sorted(r.id for r in out.collect()) == greedy(rows, max_iou)


def test_components_part_a_key_at_an_interval_over_all(spark):
    rows = [(0, i * 2.0, i * 2 + 1.0, 0.0, 0.0, i, 0) for i in range(50)] + [(0, 0.0, 100.0, 0.0, 0.0, 99, 0)]
    state = spark.createDataFrame(rows, "k int, _s double, _e double, _p1 double, _p2 double, _tie long, _state int")
    parts = M._components(state, "k", 0.5).collect()
    assert len({(r["_band"], r["_comp"]) for r in parts}) == 51 and {r["_n"] for r in parts} == {1}


def test_overlap_join_reports_each_pair_once(spark):
    rng = random.Random(9)
    make = lambda n: [(rng.randrange(2), i, s := round(rng.random() * 30, 1), s + rng.choice([0.1, 3.0, 12.0])) for i in range(n)]
    spans, ivs = make(60), make(60)
    out = M.overlap_join(
        spark.createDataFrame(spans, "k int, a int, start double, end double"),
        spark.createDataFrame(ivs, "k int, b int, start double, end double"), "k", "start", "end", 2.0,
    ).select("a", "b").collect()
    want = sorted((a[1], b[1]) for a in spans for b in ivs if a[0] == b[0] and b[3] > a[2] + 1e-5 and b[2] < a[3] - 1e-5)
    assert sorted((r.a, r.b) for r in out) == want


def test_ngrams_cross_block_borders(spark):
    df = spark.createDataFrame([("u", i, float(i), i + 1.0, f"w{i}") for i in range(1, 30)], "utt_id string, pos long, start double, end double, text string")
    out = M.ngrams(df, "utt_id", [2, 4], ["text"], block_rows=5).collect()
    got = {(r.n, r.last_pos): [x.text for x in r["items"]] for r in out}
    for n in (2, 4):
        for last in range(n, 30):
            assert got[(n, last)] == [f"w{i}" for i in range(last - n + 1, last + 1)]
    assert len(got) == 28 + 26


def test_token_edit_distance(spark):
    rng = random.Random(2)
    phones = ["HH", "EY", "K", "AE", "M", "IY", "é", "long-token"]
    rows = [([rng.choice(phones) for _ in range(rng.randrange(7))], [rng.choice(phones) for _ in range(rng.randrange(7))]) for _ in range(60)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    out = df.select("a", "b", T.token_levenshtein(F.col("a"), F.col("b")).alias("d")).collect()
    spell = lambda tokens: "".join("abcdefgh"[phones.index(t)] for t in tokens)
    con = duckdb.connect()
    assert all(r.d == con.execute("select levenshtein(?, ?)", [spell(r.a), spell(r.b)]).fetchone()[0] for r in out)


def test_large_alphabet_is_spelled(spark):
    alphabet = [f"p{i}" for i in range(300)]
    df = spark.createDataFrame([(["p0", "p299", "p150"], ["p0", "p298", "p150", "zz"])], "a array<string>, b array<string>")
    row = df.select(T.spell_with(F.col("a"), alphabet).alias("a"), T.spell_with(F.col("b"), alphabet).alias("b")).first()
    assert len(row.a) == 3 and row.a[0] == row.b[0] and row.a[1] != row.b[1] and row.a[2] == row.b[2] and row.b[3] == "~"


def test_hard_negative_mining_of_phones(spark):
    words = [("u1", 1, 0.0, 0.2, "HEY"), ("u1", 2, 0.2, 0.6, "CANDY"), ("u1", 3, 0.6, 1.0, "NOW")]
    phones = ["HH", "EY", "K", "AE", "N", "IY", "N", "AW"]
    times = [(0.0, 0.1), (0.1, 0.2), (0.2, 0.3), (0.3, 0.4), (0.4, 0.5), (0.5, 0.6), (0.6, 0.8), (0.8, 1.0)]
    w = spark.createDataFrame(words, "utt_id string, pos long, start double, end double, text string")
    p = spark.createDataFrame([("u1", i + 1, *t, x) for i, (t, x) in enumerate(zip(times, phones))], "utt_id string, pos long, start double, end double, text string")
    out = M.mine_candidates(
        w, p, ["HH", "EY", "AY", "IY", "K", "AE", "M", "R", "OW"], 0.1, 2.0, 0.0, 0.0, 0.5, 3
    ).collect()
    by = {(r.category, r.phrase, r.rule): r for r in out}
    two = by[("hey_nonwake", "HEY CANDY", "hey_plus_1_word")]
    assert two.target == "hey_camy" and two.edit_distance == 1 and two.blacklist_flag == "wake_phone_blacklist:hey_camy"
    camy = by[("camy_phoneme_similar", "CANDY", "word_1_gram")]
    assert (camy.target, camy.edit_distance, camy.similarity, camy.passes) == ("camy", 1, 0.75, True)
    hey = by[("hey_phoneme_similar", "HEY", "hey_prefix_word_1_gram")]
    assert hey.passes and hey.blacklist_flag == ""
    assert by[("local_phoneme_confuser", "HEY CANDY", "local_phone_ngram")].words == ["HEY", "CANDY"]


def test_runs_over_block_borders_equal_plain_overlaps(spark):
    rng = random.Random(11)

    def tier(n, texts, gaps):
        rows, at = [], 0.0
        for i in range(1, n + 1):
            at += rng.choice(gaps)
            rows.append((i, round(at, 3), round(at := at + rng.choice([0.1, 0.2, 0.9]), 3), rng.choice(texts)))
        return rows

    sides = {u: (tier(90, "abc", [0.0, 0.0, 0.3, 9.0]), tier(60, "xyz", [0.0, 0.4, 5.0])) for u in ("u1", "u2", None, "alone")}
    sides["alone"] = (sides["alone"][0], [])
    rows = lambda side: [(u, *r, r[3]) for u, both in sides.items() for r in both[side]]
    schema = "utt_id string, pos long, start double, end double, text string, code string"
    items, others = spark.createDataFrame(rows(0), schema), spark.createDataFrame(rows(1), schema)
    others = others.withColumn("rank", F.col("pos").cast("int"))

    def plain(by):
        for u, (own, other) in sides.items():
            for i in range(len(own)):
                for n in (1, 3):
                    run = own[i : i + n]
                    start, end = run[0][1], max(r[2] for r in run)
                    # rows without an utterance meet no others, as in a join
                    heard = [o for o in other if u is not None and o[2] > start + 1e-5 and o[1] < end - 1e-5]
                    if len(run) == n:
                        yield u, i + 1, n, end, "".join(r[3] for r in run), "".join(o[3] for o in heard), heard[0][0] if heard else 0

    con = duckdb.connect()
    for by, target in (("items", "abb"), ("others", "xyz")):
        out = M.runs_with_overlaps(
            items, others, "utt_id", [1, 3], by, [(target, 1, 0.5)], lambda run: run.carried["rank"] == 7, {"rank": "first"},
            bin_seconds=7.0, block_rows=8,
        ).collect()
        got = {(r.utt_id, r.pos, r.n, r.end, "".join(r.texts), "".join(r.heard), r.also) for r in out}
        near = lambda s: (d := con.execute("select levenshtein(?, ?)", [s, target]).fetchone()[0]) <= 1 and 1 - d / max(len(s), 3) >= 0.5
        want = {
            (u, i, n, end, own, heard, at == 7) for u, i, n, end, own, heard, at in plain(by)
            if at == 7 or near(own if by == "items" else heard)
        }
        assert got == want and len(out) == len(want) > 4


def test_runs_are_judged_where_they_are_formed(spark, monkeypatch):
    # of many runs only those near a target or listed may leave the task that forms them
    letters = "HEYCAMY" + "BDFGLNPST" * 40
    schema = "utt_id string, pos long, start double, end double, text string"
    w = spark.createDataFrame([("u1", 1, 0.0, 100.0, "LONG")], schema)
    p = spark.createDataFrame([("u1", i + 1, i / 10, (i + 1) / 10, x) for i, x in enumerate(letters)], schema)
    seen = []
    monkeypatch.setattr(M, "score_candidates", lambda spans, *a, real=M.score_candidates: (seen.append(spans.count()), real(spans, *a))[1])
    targets = {k: [*v] for k, v in {"hey": "HEY", "hi_high": "HY", "he": "HE", "hey_camy": "HEYCAMY", "hey_reco": "HEYRECO", "camy": "CAMY", "reco": "RECO"}.items()}
    out = M.mine_candidates(w, p, sorted({*letters, *"RO"}), 0.1, 200.0, 0.0, 0.0, 0.5, 3, targets=targets, phrase_blacklist=[]).collect()
    assert any(r.edit_distance == 0 and r.target == "hey_camy" for r in out)
    assert seen[0] < 40 < len(letters)


def test_tiers_are_dealt_out_as_packs(spark, monkeypatch):
    # a row per word and phone went through every shuffle and sort before; packs of rows that lie in any order give the same
    rng = random.Random(4)
    spoken = {u: [rng.choice(["HEY", "CAMY", "RECO", "LOW", "É'S"]) for _ in range(700)] for u in ("u1", "u2")}
    words, phones = [], []
    for u, texts in spoken.items():
        for i, text in enumerate(texts):
            letters = [x for x in text if x.isascii() and x.isalpha()]
            words.append((u, i + 1, i * 10.0, i * 10.0 + len(letters) / 10, text))
            phones += [(u, None, i * 10.0 + j / 10, i * 10.0 + (j + 1) / 10, x) for j, x in enumerate(letters)]
    number = {u: 0 for u in spoken}
    for k, (u, _, *rest) in enumerate(phones):
        number[u] += 1
        phones[k] = (u, number[u], *rest)
    schema = "utt_id string, pos long, start double, end double, text string"
    targets = {k: [*v] for k, v in {"hey": "HEY", "hi_high": "HY", "he": "HE", "hey_camy": "HEYCAMY", "hey_reco": "HEYRECO", "camy": "CAMY", "reco": "RECO"}.items()}
    dealt = []

    def spy(df, *a, real=M.map_stretches, **b):
        dealt.append(df.count())
        return real(df, *a, **b)

    monkeypatch.setattr(M, "map_stretches", spy)
    out = []
    for mixed in (False, True):
        w, p = ([*x] for x in (words, phones))
        if mixed:
            rng.shuffle(w), rng.shuffle(p)
        rows = M.mine_candidates(
            spark.createDataFrame(w, schema).coalesce(1), spark.createDataFrame(p, schema).coalesce(1), [*"ABCEHLMORWYS"], 0.1, 200.0, 0.0, 0.0,
            0.5, 3, targets=targets, phrase_blacklist=["LOW", "HEY RECO", "CAMY LOW HEY"],
        ).collect()
        out.append(sorted(map(repr, rows)))
    assert out[0] == out[1] and len(out[0]) > 1000 and any("text_blacklist" in r for r in out[0])
    heard = lambda texts: next((k for k in (1, 2, 3) for ph in ["LOW", "HEY RECO", "CAMY LOW HEY"] if ph.split() in (texts[:k], texts[-k:])), 0)
    assert all((r.blacklist_flag == "text_blacklist") == (heard(r.words) > 0) for r in rows)
    assert len(words) + len(phones) > 5000 and max(dealt) < 100
