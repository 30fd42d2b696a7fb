"""Merkle manifest, line dedup and spelling variants against plain Python, with the awkward cases."""

import collections
import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.llm import html_text, line_dedup, merkle, minhash, spelling, suffix_dedup, url_templates
from earshot.llm.embedding_dedup import link_vectors
from earshot.llm.store import Scratch

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
DOCS = "doc_id long, source string, lang string, n_chars long, text string, row string, part string, tree string, kept string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(rows, received):
    """(leaf, subroot, root, proof, folded) per row, by position."""
    rank = lambda v: (v is not None, v if v is not None else 0)
    text = lambda v: (v is not None, (v or "").encode())
    order = sorted(range(len(rows)), key=lambda i: (text(rows[i][1]), rank(rows[i][0]), leaf(rows[i])))
    siblings, folded = {i: [] for i in order}, {i: leaf(received[i]) for i in order}

    def up(nodes):  # nodes: [(digest, rows below)]
        while len(nodes) > 1:
            above = []
            for k in range(0, len(nodes), 16):
                run = nodes[k : k + 16]
                for slot, (_, below) in enumerate(run):
                    for i in below:
                        left, right = [d for d, _ in run[:slot]], [d for d, _ in run[slot + 1 :]]
                        siblings[i] += left + right
                        folded[i] = h(*left, folded[i], *right)
                above.append((h(*[d for d, _ in run]), [i for _, below in run for i in below]))
            nodes = above
        return nodes[0]

    subs, sub_of = [], {}
    for _, members in itertools.groupby(order, key=lambda i: rows[i][1]):
        subs.append(up([(leaf(rows[i]), [i]) for i in members]))
        sub_of.update(dict.fromkeys(subs[-1][1], subs[-1][0]))
    root = up(subs)[0]
    return [(leaf(rows[i]), sub_of[i], root, h(*siblings[i]), folded[i]) for i in range(len(rows))]


def lowered(text):
    return text if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def tree_rows(sizes, seed=1):
    rng, out = random.Random(seed), []
    for s, n in sizes.items():
        start = len(out)
        out += [((start + i) * 3 % 1009, s, rng.choice(["en", None]), rng.choice([None, 5]), rng.choice(["Ab Üß\n", "plain", "", None, "X" * 3000])) for i in range(n)]
    return out


@pytest.mark.parametrize("sizes", [
    {"a": 1}, {"a": 300, "b": 16, "": 33, None: 2, "é": 1}, {f"s{i}": 1 + i % 3 for i in range(40)},
])
def test_manifest(spark, monkeypatch, sizes):
    monkeypatch.setattr(merkle, "CLIMBERS", 7)  # several copies of the upper nodes
    rows = tree_rows(sizes)
    bad = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    want = climb(rows, [(*r[:4], lowered(r[4])) if bad(r[0]) else r for r in rows])
    docs = spark.createDataFrame([(*r, "x", "y", "z", "k") for r in rows], DOCS).repartition(5)
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    came = {"text": F.when(tampered, F.translate("text", line_dedup.UPPER, line_dedup.LOWER)).otherwise(F.col("text"))}
    got = {r.order: r for r in merkle.verify(merkle.build(docs, FIELDS, "source", "doc_id", 16, came)).collect()}
    assert len(got) == len(rows)
    for row, (own, sub, root, proof, folded) in zip(rows, want, strict=True):
        r = got[row[0]]
        assert (r.leaf.hex(), r.subroot.hex(), r.root.hex(), r.proof.hex(), r.folded_root.hex()) == (own, sub, root, proof, folded)
        assert r.verified == (folded == root)


def test_manifest_of_repeated_rows_and_null_ids(spark):
    rows = [(None, "a", None, None, None)] * 3 + [(4, None, "en", 1, "t")] * 40 + [(4, None, "en", 2, "u")]
    docs = spark.createDataFrame([(*r, "x", "y", "z", "k") for r in rows], DOCS)
    got = merkle.verify(merkle.build(docs, FIELDS, "source", "doc_id")).collect()
    want = climb(rows, rows)
    assert sorted((r.leaf.hex(), r.proof.hex()) for r in got) == sorted((w[0], w[3]) for w in want)
    assert all(r.verified and r.root.hex() == want[0][2] for r in got)


def test_manifest_of_nothing(spark):
    assert merkle.verify(merkle.build(spark.createDataFrame([], DOCS), FIELDS, "source", "doc_id")).count() == 0


def test_recursion_limit_is_put_back(spark):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    docs = spark.createDataFrame([(i, "a", "en", 1, "t", "x", "y", "z", "k") for i in range(20)], DOCS)
    assert merkle.verify(merkle.build(docs, FIELDS, "source", "doc_id")).where("verified").count() == 20
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before


def line_key(line):
    return lowered(line.strip(" \t\n\x0b\x0c\r"))


def without_repeats(rows, min_docs, min_chars):
    held = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            held.setdefault(line_key(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = []
        for line in lines:
            ids = held[line_key(line)]
            owner = min((x for x in ids if x is not None), default=None)
            if len(line_key(line)) < min_chars or len(ids) < min_docs or i == owner:
                stay.append(line)
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


LINES = "doc_id long, text string, kept string, gone string, key string"


@pytest.mark.parametrize(("min_docs", "min_chars"), [(2, 10), (3, 4)])
def test_lines(spark, min_docs, min_chars):
    rng = random.Random(min_docs)
    pool = ["", "short", "License: see the FILE", "  license: see the file\t", "ÄÖ common line ÄÖ", "äö common line äö", "nine char", "ten chars!", "\x0bcut here now\x0c", " not space here ", "a\tb\tc\td\te\tf"]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.6 else f"own line {rng.random()}" for _ in range(rng.randrange(1, 12)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "License: see the FILE\n" * 4000), (None, "License: see the FILE\nonly nameless rows"), (None, "only nameless rows")]
    rows += [(7, "License: see the FILE"), (7, "twice the same row\nx"), (7, "twice the same row\nx"), (104, "end\nLICENSE: see the file")]
    docs = spark.createDataFrame([(*r, "k", "g", "y") for r in rows], LINES).repartition(7)
    out = line_dedup.drop_repeated_lines(docs, min_docs, min_chars)
    assert set(out.columns) == {"doc_id", "text", "kept", "key", "n_lines", "n_dropped"}
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in out.collect()), key=key)
    assert got == sorted(without_repeats(rows, min_docs, min_chars), key=key)
    assert line_dedup.drop_repeated_lines(docs.limit(0)).count() == 0


def test_lines_with_a_hot_line(spark):
    rows = [(i, f"the same line everywhere\nown line of {i}\nthe same line everywhere") for i in range(3000)]
    out = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out.agg(F.sum("n_dropped")).first()[0] == 2 * 2999
    assert out.where("kept = concat('own line of ', doc_id)").count() == 2999


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = (a, b) if len(a) < len(b) else (b, a)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(words):
    out = {}
    for w, n in words.items():
        others = [(-m, o) for o, m in words.items() if near(w, o)]
        form = min(others)[1] if others and -min(others)[0] >= 2 * n else None
        out[w] = (form, n, len(others), words[form] if form else None)
    for w, (form, *rest) in list(out.items()):
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w] = (form, root, *rest)
    return out


def test_vocabulary(spark):
    rng = random.Random(3)
    pool = ["Colour", "color", "colours", "ÀÉÎõü", "naïve", "abcd", "Übermut", "übermut", "x×y÷z", "aaaaaa"]
    rows = [(i, " 12,".join(rng.choice(pool) for _ in range(rng.randrange(1, 30)))) for i in range(300)] + [(900, None), (901, ""), (None, "colour nameless " * 3), (902, "colour" * 3000)]
    want = {}
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            code = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if code % 97 == 0:
                at = code % len(run)
                run = run[:at] + run[at + 1 :]
            want[run] = want.get(run, 0) + 1
    want = {w: n for w, n in want.items() if len(w) >= 5 and n >= 3}
    got = {r.word: r.n for r in spelling.vocabulary(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


@pytest.mark.parametrize("tiny", [False, True])
def test_variants(spark, monkeypatch, tiny):
    if tiny:  # deep upper trees cut on a part of the words, many buckets and batches
        for name, value in (("SAMPLE_WORDS", 150), ("BUCKET_WORDS", 8), ("LEAF_POINTS", 2), ("SEARCH_WORDS", 3), ("LETTERS_AT_ONCE", 20)):
            monkeypatch.setattr(spelling, name, value)
    rng = random.Random(8)
    words = {}
    for _ in range(90):
        base = "".join(rng.choice("abcdeéÿ") for _ in range(rng.randrange(5, 9)))
        words[base] = rng.randrange(3, 3000)
        for _ in range(8):
            at, kind = rng.randrange(len(base)), rng.randrange(4)
            if kind == 3:
                other = "".join(rng.sample(base, len(base)))  # as many letters of each, in another order
            else:
                other = base[:at] + (rng.choice("abcdeéÿ") if kind else "") + base[at + (kind != 1) :]
            words.setdefault(other, rng.randrange(3, 100))
    words |= {"".join(p): 3 for p in itertools.permutations("aabbcd")}  # equal letter counts cannot be cut
    words |= {"z" * 200: 9, "z" * 201: 40, "z" * 202: 100, "lonely": 5}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.group_variants(frame).collect()}
    assert got == variants(words)


def test_no_words(spark):
    assert spelling.group_variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_reach_finds_every_neighbour():
    rng = np.random.default_rng(4)
    points = np.unique(rng.integers(0, 3, (400, 6)).astype(np.int32), axis=0)
    wide = np.zeros((len(points), spelling.AXES), np.int32)
    wide[:, 3:9] = points
    tree, leaves = spelling.grow(wide, 3)
    assert sorted(np.concatenate(leaves).tolist()) == list(range(len(wide)))
    for replaced in (True, False):
        found = {(int(r), int(x)) for leaf, rows in spelling.reach(tree, wide, replaced) for r in rows for x in leaves[leaf]}
        for a, b in itertools.permutations(range(len(wide)), 2):
            step = wide[b] - wide[a]
            up, down = np.flatnonzero(step > 0), np.flatnonzero(step < 0)
            one = np.abs(step).max() == 1 and len(down) == 1
            if one and (len(up) == 1 and down[0] < up[0] if replaced else len(up) == 0):
                assert (a, b) in found


@pytest.fixture
def shifting_splits(spark, monkeypatch):
    """Other file splits after every written table, as when cores come and go between two jobs."""
    turn, plain = itertools.count(1), Scratch.write

    def write(self, df, name):
        out = plain(self, df, name)
        n = next(turn)
        spark.conf.set("spark.sql.files.minPartitionNum", 1 + 7 * n % 23)
        spark.conf.set("spark.sql.files.openCostInBytes", 1 + 4096 * (n * 37 % 101))
        return out

    monkeypatch.setattr(Scratch, "write", write)
    yield
    for name in ("spark.sql.files.minPartitionNum", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(name)


def test_splits_may_change_between_reads(spark, tmp_path, shifting_splits):
    rng = random.Random(11)
    base = [" ".join(f"w{rng.randrange(300)}" for _ in range(80)) for _ in range(30)]
    rows = [(i, (base[i] if i < 30 else rng.choice(base)) + ("" if i % 3 else f" tail{i}")) for i in range(150)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(24).write.parquet(path)
    docs = spark.read.parquet(path)
    groups = {}
    for r in minhash.near_duplicates(docs, 5, 80).collect():
        groups.setdefault(r.component_id, set()).add(r.doc_id)
    words = dict(rows)
    stems = {}
    for i, text in words.items():
        stems.setdefault(text.split(" tail")[0], set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, stems.values()))
    assert minhash.first_of_each(docs).count() == len(stems)
    out = suffix_dedup.remove_repeats(docs, 60).collect()
    count = collections.Counter()
    for text in words.values():
        count.update({(text[k : k + 60], k) for k in range(len(text) - 59)})
    assert len(out) == 150 and all(r.n_removed >= len(words[r.doc_id].split(" tail")[0]) for r in out if len(stems[words[r.doc_id].split(" tail")[0]]) > 1)


def test_vectors_that_share_an_id(spark):
    v, w = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0, 2.0]
    rows = [(1, v, "a"), (1, v, "b"), (2, v, "a"), (3, w, "a"), (3, v, "c"), (3, [2.0, 0.0, 0.0], "c"), (4, w, "a")]
    out = link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in out)
    assert got == sorted([(1, 1, 1, True), (1, 0, 1, True), (2, 1, 1, False), (3, 1, 3, True), (3, 1, 3, True), (3, 1, 3, True), (4, 1, 3, False)])


def test_urls_without_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x"), (2, None)], "page_id long, url string")
    assert {(r.page_id, r.rule, r.verdict) for r in url_templates.judge(pages, []).collect()} == {(1, None, "allow"), (2, None, "allow")}


def test_deep_and_unmatched_html():
    deep = "<div>" * 20_000 + "</b></i></section>" * 20_000 + "<p>some words here</p>"
    begin = time.perf_counter()
    assert html_text.main_text(deep, {}) == "some words here"
    assert time.perf_counter() - begin < 5


def test_pieces_are_decoded_a_batch_at_a_time_and_found_without_search():
    import numpy as np
    import public_tokenizers
    import pyarrow as pa

    from earshot.llm import pieces

    vocab = pieces.vocabulary(public_tokenizers.path("piece_bpe_32k.model"), 0.5)
    texts = ["", "one two", "é ▁ \U0001f600 x", " ", "a\nb"]
    rows = pieces.sample(vocab, texts, np.arange(5, dtype=np.uint64), 2)
    lists = pa.array([None, *(np.asarray(r[5], dtype=np.int32) for r in rows)], pa.list_(pa.int32()))
    assert vocab.decode(lists) == ["", *(texts[r[0]] for r in rows)]
    assert vocab.decode(lists.slice(2, 3)) == [texts[r[0]] for r in rows[1:4]]
    assert vocab.decode(lists.slice(0, 1)) == [""]
    # every piece is found at its own place, also where two share a slot
    found, place, _ = vocab.find(vocab.hashes)
    assert (found == np.arange(len(vocab.hashes))).all() and (place == found).all()
    assert not len(vocab.find(vocab.hashes ^ np.uint64(1))[0])


def test_units_of_one_ending_share_lattice_nodes_over_batches(monkeypatch):
    import math

    import public_tokenizers

    from earshot.llm import pieces

    vocab = pieces.vocabulary(public_tokenizers.path("piece_bpe_32k.model"), 0.5)
    texts = ["talking walking king", "", "walking \u2581king \U0001f600king", "king  talking", " ", "x" * 40 + " walking"]
    made, whole = [], pieces.Lattices.__init__

    def count(self, *args):
        whole(self, *args)
        made.append(self)

    monkeypatch.setattr(pieces.Lattices, "__init__", count)
    seeds = np.arange(len(texts), dtype=np.uint64)
    rows = pieces.sample(vocab, texts, seeds, 3)
    # batches, stretches of nodes and of units change nothing, and lattices are made once for all batches
    for name in ("CHUNK_BYTES", "NODES_AT_ONCE", "UNITS_AT_ONCE"):
        monkeypatch.setattr(pieces, name, 3)
    again = pieces.sample(vocab, texts, seeds, 3)
    key = lambda r: (r[0], r[1], r[5].tolist())
    assert sorted(map(key, again)) == sorted(map(key, rows)) and len(made) == 2
    marked = [(" " + t).replace("\u2581", "\0").replace(" ", "\u2581") if t else "" for t in texts]
    units = {u for t in marked for u in re.findall("\u2581+[^\u2581]*", t)}
    assert all(len(x.first) - 1 == len({u[i:] for u in units for i in range(len(u))}) for x in made)

    # probabilities by plain sums over the pieces of a text
    weight = {}
    for place, i in enumerate(vocab.ids.tolist()):
        weight[vocab.raw[i].as_py().decode().replace(" ", "\u2581")] = float(vocab.weights[place])
    by_id = dict(zip(vocab.ids.tolist(), vocab.weights.tolist(), strict=True))
    for i, rank, log_prob, _, _, ids in rows:
        t = marked[i]
        total = [0.0] * (len(t) + 1)
        for a in range(len(t) - 1, -1, -1):
            ways = [(weight[t[a:b]], b) for b in range(a + 1, min(a + vocab.longest, len(t)) + 1) if t[a:b] in weight and not re.search("[^\u2581]\u2581", t[a:b])]
            if t[a] not in weight:
                ways.append((vocab.byte_weight * len((t[a] if t[a] != "\0" else "\u2581").encode()), a + 1))
            top = max(w + total[b] for w, b in ways)
            total[a] = top + math.log(sum(math.exp(w + total[b] - top) for w, b in ways))
        got = sum(by_id.get(x, vocab.byte_weight) for x in ids.tolist())
        assert abs(got - total[0] - log_prob) < 1e-9, (t, rank)
