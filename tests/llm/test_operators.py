"""The corpus operators against plain Python, on small tables with the awkward cases."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from earshot.llm import embedding_dedup, html_text, minhash, packing, pieces, pii, rolling, suffix_dedup, topk, toxicity, url_templates
from earshot.llm.components import components
from earshot.llm.store import Scratch

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
MODEL = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, kept string, `spans` int, row_key string, toxic string"


def words(rng, n, pool=400):
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies, shared passages, repeats, short, empty, null, long, other alphabets."""
    rng = random.Random(5)
    base = [words(rng, 120) for _ in range(12)]
    out = [" ".join(b) for b in base]
    for b in base[:6]:
        for _ in range(4):
            near = list(b)
            for _ in range(rng.randrange(1, 6)):
                near[rng.randrange(len(near))] = "x%d" % rng.randrange(99)
            out.append(" ".join(near))
    out += [out[0]] * 5
    passage = " ".join(words(rng, 30))
    out += [" ".join([*words(rng, 20), passage, *words(rng, 20)]) for _ in range(5)]
    out += ["", "   ", "one", "one two", "one two", "Ärger über ßtraße " * 9, "a" * 3000, "ab" * 700, " ".join(words(rng, 9000)), "😀 é　x", "tail\n\t "]
    return [(i, t) for i, t in enumerate(out)] + [(900, None), (901, None)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "k", 1, "r", "t") for i, t in texts]
    return spark.createDataFrame(rows, DOCS).repartition(5, "doc_id").sortWithinPartitions("doc_id")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text, size):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = [x for x in re.split("[\x20\x09-\x0d]+", low) if x]
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def closure(ids, links):
    head = {i: i for i in ids}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        head[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, texts, size, percent):
    sets = {i: shingles(t, size) for i, t in texts}
    links = [
        (a, b) for a, b in itertools.combinations(sets, 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    want = closure(sets, links)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, size, percent).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}
    assert sum(r.first for r in got.values()) == len(set(want.values()))


def test_near_duplicates_of_repeated_and_nameless_rows(spark, none):
    text = " ".join(f"t{i}" for i in range(50))
    rows = [(3, text), (3, text), (2, text), (None, text), (None, None), (7, ""), (7, "")]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.first for r in out if r.doc_id in (2, 3)) == [False, False, True]
    assert {r.component_id for r in out if r.doc_id in (2, 3)} == {2}
    assert all(r.component_id is None and r.kept is None and r.first for r in out if r.doc_id is None)
    assert all(r.first and r.kept for r in out if r.doc_id == 7)
    assert minhash.near_duplicates(none).count() == 0


def test_registers_estimate():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.85, 0.95):
        common = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
        own = int(4000 * (1 - share) / (2 * share))
        sets = [np.unique(np.concatenate((common, rng.integers(0, 1 << 63, own, dtype=np.uint64)))) for _ in range(2)]
        sig = minhash.registers(np.concatenate(sets), np.array([len(s) for s in sets]))
        found = minhash.estimate(sig, np.array([len(s) for s in sets]), 0, np.array([1]))[0]
        assert abs(found - 4000 / (4000 + 2 * own)) < 0.17


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(140)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 580)]
    links = [(a, b) for a, b in links if a != b]
    nodes = {x for pair in links for x in pair}
    frame = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in components(frame, Scratch(spark, "test"), "c").collect()}
    assert got == closure(nodes, links)


def removed(texts, window):
    count = collections.Counter()
    raw = {i: (t or "").encode() for i, t in texts}
    for b in raw.values():
        count.update(b[k : k + window] for k in range(len(b) - window + 1))
    out = {}
    for i, b in raw.items():
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if count[b[k : k + window]] > 1:
                gone[k : k + window] = b"\1" * window
        out[i] = (len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1])), bytes(c for c, g in zip(b, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("window", [24, 80, 400])
def test_remove_repeats(docs, texts, window):
    got = {r[0]: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs, window).collect()}
    assert got == removed(texts, window)


def test_remove_repeats_in_pieces_of_long_rows(spark, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 700)
    part = "".join(rng.choice("abcdefgh") for _ in range(900))
    rows = [(1, part + "x" * 1500 + part[:500]), (2, "q" + part[100:] + "".join(rng.choice("abc") for _ in range(3000)))]
    column = __import__("pyarrow").array([t for _, t in rows])
    found = set()
    for i in range(2):
        for data, offsets, base in suffix_dedup._pieces(column, i, i + 1, 60):
            _, _, a, first, last = suffix_dedup.choose_suffixes(data, offsets, 60, 30)
            for x, f, e in zip(a, first, last, strict=True):
                found |= {(i, base + s) for s in range(f, e + 1)}
    assert found == {(i, s) for i in range(2) for s in range(len(rows[i][1]) - 60 + 1)}


def test_remove_repeats_with_many_heavy_buckets(spark, monkeypatch):
    # more than 4,096 buckets count as heavy, many with a near copy whose finer identifier is another
    rng = random.Random(12)
    monkeypatch.setattr(suffix_dedup, "SAMPLE_ONE_IN", 1)
    monkeypatch.setattr(suffix_dedup, "HEAVY_IN_SAMPLE", 2)
    rows = []
    for i in range(150):
        base = words(rng, 300, 100_000)
        cuts = set(itertools.takewhile(lambda at: at < 300, itertools.accumulate(rng.randrange(5, 15) for _ in range(60))))
        near = [" ".join("x%d" % rng.randrange(10**6) if at in cuts else w for at, w in enumerate(base)) for _ in range(3)]
        # the first have no exact copies: common buckets, but no common finer identifiers
        rows += near if i < 110 else [" ".join(base), near[0], " ".join(base)]
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs, 60).collect()}
    assert got == removed(rows, 60)


def test_remove_repeats_as_text(spark, none):
    rows = [(1, "ü" * 40), (2, "x" + "ü" * 40), (None, None)]
    out = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 21, as_text=True).collect()
    assert {r.doc_id: r.kept for r in out} == {1: "", 2: "x", None: ""}
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_packing(docs, texts, none):
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array([*e.ids, 0], "<u4") for (i, _), e in zip(texts, model.encode_batch([t or "" for _, t in texts], add_special_tokens=False), strict=True)}
    rows = packing.ids_crc32(packing.pack(docs, RANKS, PATTERN, 64)).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        by_doc[r.doc_id].append((r.start, r.length))
        by_seq[r.sequence_id].append((r.offset, r.length))
    for pieces_, total in [(by_doc[i], len(x)) for i, x in ids.items()] + [(x, None) for x in by_seq.values()]:
        at = 0
        for start, length in sorted(pieces_):
            assert start == at
            at += length
        assert at == total if total else at <= 64
    assert sum(sum(n for _, n in x) < 64 for x in by_seq.values()) <= 1
    assert packing.pack(none, RANKS, PATTERN).count() == 0


def test_hilbert_curve_is_connected():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        key = packing.hilbert_keys(grid, bits)
        assert sorted(key) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_tokens_of_odd_texts():
    from earshot.llm.byte_bpe import Encoder

    import pyarrow as pa

    rng = random.Random(1)
    letters = "ab Z'strevmld09  \n\t.,!é ß　x ½²Ⅷ漢字’😀\r\x1c\x85\x0b́"
    odd = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(4000)] + ["I'll we've don't ''s 'd", "", "   ", "\n's x'rex", " '"]
    ids, counts = Encoder(RANKS, PATTERN).encode(*rolling.buffer_of(pa.array(odd), 0, len(odd)))
    ends = np.cumsum(counts)
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert [ids[e - c : e].tolist() for e, c in zip(ends, counts, strict=True)] == [e.ids for e in model.encode_batch(odd, add_special_tokens=False)]


def vectors_case(rng):
    centres = rng.standard_normal((6, 16))
    rows = []
    for i in range(240):
        v = centres[i % 6] + rng.standard_normal(16) * (0.02, 0.06, 0.4)[i % 3]
        rows.append((1000 - i, v.tolist(), i % 6 if i % 5 else 0, "n"))
    rows += [(2000 + i, rows[0][1], rows[0][2], "n") for i in range(20)]
    rows += [(3000, None, 1, "n"), (3001, [0.0] * 16, 1, "n"), (3002, [None] + [1.0] * 15, 1, "n"), (3003, [float("nan")] * 16, 1, "n"),
             (3004, rows[0][1], None, "n"), (3005, [float("inf")] + [1.0] * 15, 1, "n"), (3006, [1.0] * 3, 1, "n"), (None, rows[0][1], rows[0][2], "n")]
    return rows


def test_link_vectors(spark):
    rows = vectors_case(np.random.default_rng(4))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links string")
    usable = {i: (np.array(v), lab) for i, v, lab, _ in rows if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    links = [
        (a, b) for a, b in itertools.combinations(usable, 2)
        if usable[a][1] == usable[b][1] and len(usable[a][0]) == len(usable[b][0])
        and usable[a][0] @ usable[b][0] >= 0.98 * np.linalg.norm(usable[a][0]) * np.linalg.norm(usable[b][0])
    ]
    degree = collections.Counter(x for pair in links for x in pair)
    head = closure([r[0] for r in rows if r[0] is not None], links)
    got = embedding_dedup.link_vectors(frame).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_links == (degree[r.vec_id] if r.vec_id is not None else 0)
        assert r.component_id == (head[r.vec_id] if r.vec_id is not None else None)
    assert embedding_dedup.link_vectors(frame.where("false")).count() == 0


@pytest.mark.parametrize("k", [1, 10])
def test_top_k(spark, monkeypatch, k):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 64)
    rows = vectors_case(np.random.default_rng(6))
    frame = spark.createDataFrame([(i, v, "c") for i, v, _, _ in rows], "vec_id long, embedding array<double>, score string")
    usable = {i: np.floor(1024 * np.array(v)).astype(int) for i, v, _, _ in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    want = []
    for q in usable:
        if q % 20 == 0:
            best = sorted((-int(usable[q] @ usable[c]), c) for c in usable if c != q and len(usable[c]) == len(usable[q]))[:k]
            want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    assert sorted(tuple(r) for r in topk.top_k(frame, "vec_id % 20 = 0", k).collect()) == sorted(want)
    assert topk.top_k(frame.where("false"), "true").count() == 0


def luhn(digits):
    doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(digits))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def base_spans(text):
    valid = {
        "email": lambda m, g: True, "ip": lambda m, g: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda m, g: 12 <= len(g) <= 19 and luhn(g), "phone": lambda m, g: 9 <= len(g) <= 15,
    }
    found = []
    for order, (kind, pattern) in enumerate(pii.PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            if valid[kind](m.group(), re.sub("[^0-9]", "", m.group())):
                found.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for *_, x in sorted(found))


def test_personal_spans(spark, none):
    rng = random.Random(3)
    letters = "ab.@-+1 2(3)45é😀%"
    odd = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(1500)]
    odd += [None, "", "m a@b.c%d@e.f x", "4111 1111 1111 1111", "a" * 100_000, "1." * 50_000, "1 " * 50_000, "a@" + "b." * 30_000 + "c", "+1" * 20_000,
            "iban DE89 3704 0044 0532 0130 00 ok", "ssn 123-45-6789", "no 123-45-6789", "call 212-555-1234 😀 1.2.3.4", "1.2.3.4 " * 300]
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(odd)], "doc_id long, text string, spans string").repartition(8)
    out = {r.doc_id: r for r in pii.masked(pii.personal_spans(frame)).selectExpr("doc_id", "text", "spans", "filter(spans, s -> s.base) base").collect()}
    join = lambda spans: ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)
    assert all(join(out[i].base) == base_spans(t) for i, t in enumerate(odd))
    n = len(odd)
    assert [join(out[i].spans) for i in (n - 5, n - 4, n - 3)] == ["iban:5:32", "ssn:4:15", ""]
    assert out[n - 2].text == "call <local_phone> 😀 <ip>" and out[n - 1].text == "<ip> " * 300 and out[n - 14].text is None
    assert pii.personal_spans(none).count() == 0


def test_personal_spans_run_no_python(spark, docs):
    plan = pii.masked(pii.personal_spans(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_toxicity(spark, none):
    rng = random.Random(9)
    bad = ["vile", "rotten", "loathsome"]
    rows, labels = [], []
    for i in range(900):
        text, toxic = words(rng, rng.randrange(1, 60)), int(i % 4 == 0)
        for _ in range(rng.randrange(1, 5) * toxic):
            text.insert(rng.randrange(len(text)), rng.choice(bad) + rng.choice(["", "ly", "ness"]))
        rows.append((i, " ".join(text), "s"))
        if i % 3:
            labels.append((i, toxic))
    rows += [(None, None, "s"), (5000, "", "s"), (5000, "", "s"), (5001, "Vileish " * 20_000, "s")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, severity string")
    known = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(frame, known)
    assert (np.diff(model.thresholds) > 0).all() and (model.weights >= 0).all()
    out = toxicity.score(frame, model).collect()
    assert len(out) == len(rows)
    held = [r for r in out if r.doc_id is not None and r.doc_id < 900 and r.doc_id % 3 == 0]
    assert sum(r.toxic == (r.doc_id % 4 == 0) for r in held) >= 0.97 * len(held)
    assert [r.toxic for r in out if r.doc_id == 5001] == [True] and not any(r.toxic for r in out if r.doc_id in (None, 5000))
    nothing = toxicity.fit(none, known)
    assert toxicity.score(none, nothing).count() == 0
    assert not any(r.toxic for r in toxicity.score(frame, toxicity.fit(frame, known.where("toxic = 0"))).collect())


def test_html_text(spark):
    page = (
        "<html><head><title>t</title><style>p{}</style></head><body><nav><a>Home</a></nav><div class='ad'>Buy now</div><article><h1>A &amp; B</h1>"
        "<p>One  <b>two</b>\n three<br>four<p>five &lt;six&gt;<script>var x='</p>';</script><form>name <input></form><div class=\"user-comments\"><p>me too</p></div>"
        "</article><footer>c</footer></body></html>"
    )
    rows = [(i, f"u{i}", page, 1) for i in range(20)] + [(50, "u", None, 1), (51, "u", "", 1), (52, None, "plain words", 1), (53, "u", "<p>a<p>b", 1)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    out = {r.page_id: r for r in html_text.extract(frame, html_text.fit(frame)).collect()}
    assert {out[i].text for i in range(20)} == {"A & B\nOne two three four\nfive <six>"} and out[0].n_chars == 35
    assert [out[i].text for i in (50, 51, 52, 53)] == ["", "", "plain words", "a\nb"]
    assert html_text.extract(frame.where("false"), html_text.fit(frame.where("false"))).count() == 0


def labelled_pages(spark):
    pages = [
        f"<body><nav><a>Home</a><a>More</a></nav><div class='extra'><a>x{i}</a></div><article><h1>T{i}</h1><p>{'word ' * 40}</p><p>{'text ' * 30}</p></article>"
        f"<div class='extra'><a>y</a><a>z</a></div><footer>c</footer></body>" for i in range(20)
    ]
    return spark.createDataFrame([(i, "u", p) for i, p in enumerate(pages)], "page_id long, url string, html string")


def test_marks_do_not_decide_alone(spark):
    weights = html_text.fit(labelled_pages(spark))
    story = " ".join(f"s{i}" for i in range(80))
    body = f"<div class='extra'><a>x</a><a>y</a></div><div><p>{story}</p><p>{story}</p></div>"
    assert html_text.main_text(f"<body><nav><a>Home</a></nav>{body}</body>", weights) == f"{story}\n{story}"
    # the only <article> is a card beside the body
    card = html_text.main_text(f"<body>{body}<div class='extra'><a>x</a></div><article><p>Read this too</p></article></body>", weights)
    assert card.startswith(f"{story}\n{story}")
    named = html_text.main_text(f"<body>{body}<article class='related teaser'><p>Read this too</p></article></body>", weights)
    assert named == f"{story}\n{story}"


def test_names_of_wrappers_and_asides(spark):
    weights = html_text.fit(labelled_pages(spark))
    story = " ".join(f"s{i}" for i in range(80))
    body = f"<p>{story}</p><p>{story}</p>"
    for name in ("has-sidebar", "no-header", "search-results", "page-comments", "search", "with-sidebar wide"):
        page = f"<body><div class='{name}'><article>{body}</article></div><footer>c</footer></body>"
        assert html_text.main_text(page, weights) == f"{story}\n{story}", name
        assert html_text.main_text(page.replace("article", "div"), weights) == f"{story}\n{story}", name
    assert html_text.main_text(f"<body><form>{body}<div class='user-comments'><p>me too</p></div></form></body>", weights) == f"{story}\n{story}"
    # what is skipped inside a body costs nothing
    box = "<div class='comments'>" + f"<p>{'said ' * 9}</p>" * 9 + "</div>"
    assert html_text.main_text(f"<body><div>{body}{box}<p>after all</p></div></body>", weights) == f"{story}\n{story}\nafter all"


def test_best_run_is_the_best():
    rng = random.Random(1)
    for _ in range(300):
        scores = [rng.randrange(-5, 6) for _ in range(rng.randrange(12))]
        begin, end = html_text.best_run(scores)
        assert sum(scores[begin:end]) == max([0, *(sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1))])


def test_url_verdicts(spark):
    rules = [("allow", "good.org", "/"), ("block", "bad.com", "/x/"), ("block", "good.org", "/spam/")]
    rows = [(i, f"http://A.Good.ORG/spam/{i}?q") for i in range(9)] + [(20 + i, f"https://bad.com/x/{i}") for i in range(9)]
    rows += [(40, "https://bad.com/y/1"), (41, None), (42, "no scheme"), (43, "http://"), (44, "http://notgood.org/spam/1#f"), (45, "http://h?a/b"), (45, "http://h?a/b")]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, host string")
    out = [tuple(r)[:5] for r in url_templates.judge(frame, rules).orderBy("page_id").collect()]
    assert out[0] == (0, "a.good.org", "/spam/0", "good.org/spam/", "block") and out[9] == (20, "bad.com", "/x/0", "bad.com/x/", "block")
    assert out[18:] == [
        (40, "bad.com", "/y/1", None, "allow"), (41, "", "", None, "allow"), (42, "", "", None, "allow"), (43, "", "", None, "allow"),
        (44, "notgood.org", "/spam/1", None, "allow"), (45, "h", "", None, "allow"), (45, "h", "", None, "allow"),
    ]
    assert url_templates.judge(frame.where("false"), rules).count() == 0


def test_template_is_rejected_by_its_labels(spark):
    # the rule knows the pages of one depth; the template of their siblings follows
    rules = [("block", "h.com", "/shop/1")]
    rows = [(i, f"http://h.com/shop/{100 + i}") for i in range(30)] + [(99, "http://h.com/shop/7"), (98, "http://h.com/blog/7")]
    out = {r.page_id: r.verdict for r in url_templates.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert out[99] == "block" and out[98] == "allow"


def test_templates_of_deep_paths(spark):
    rules = [("block", "h.com", "/a/b/c/d/bad/e/1"), ("allow", "h.com", "/a/b/c/d/good/e/1")]
    rows = [(i, f"http://h.com/a/b/c/d/{kind}/e/1{i:02}") for i in range(60) for kind in ("bad", "good")]
    rows += [(90, "http://h.com/a/b/c/d/bad/e/7"), (91, "http://h.com/a/b/c/d/good/e/7"), (92, "http://h.com/a/b/c/d/bad/e/1x/" + "y/" * 300), (93, "http://one.com/" + "z/" * 300)]
    out = {r.page_id: r for r in url_templates.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect() if r.page_id >= 90}
    assert [out[i].verdict for i in (90, 91)] == ["block", "allow"]
    assert [out[i].template for i in (90, 91)] == ["h.com/a/b/c/d/bad/e/*", "h.com/a/b/c/d/good/e/*"]
    assert out[92].template == "h.com/a/b/c/d/bad/e/*" + "/*" * 300 and out[93].template == "one.com" + "/*" * 300
    # the share of the node above, then 300 nodes of this one page
    share = 61 / 121
    for bad, all_ in ((61, 121), *[(61, 121)] * 4, (61, 61), (61, 61), (61, 61)):
        share = (bad + 4 * share) / (all_ + 4)
    for _ in range(300):
        share = (1 + 4 * share) / (1 + 4)
    assert out[92].bad_share == pytest.approx(share, abs=1e-8)


def test_segmentations(spark, texts, none):
    frame = spark.createDataFrame([*texts, (None, "x y")], "doc_id long, text string").repartition(4)
    rows = pieces.decoded(pieces.segmentations(frame, MODEL, k=4), MODEL).collect()
    by_doc = collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    known = dict(texts)
    for i, group in by_doc.items():
        assert {r.text for r in group} == {known.get(i) or ("x y" if i is None else "")}
        assert len({tuple(r.ids) for r in group}) == len(group) == max(r["rank"] for r in group)
        values = [r.perturbed for r in sorted(group, key=lambda r: r["rank"])]
        assert values == sorted(values, reverse=True) and all(0 < r.inclusion <= 1 for r in group)
    assert set(by_doc) == {*known, None}
    again = pieces.segmentations(frame.repartition(3), MODEL, k=4).collect()
    assert {(r.doc_id, r["rank"], tuple(r.ids)) for r in again} == {(r.doc_id, r["rank"], tuple(r.ids)) for r in rows}
    assert pieces.segmentations(none, MODEL).count() == 0


def test_op6_gives_three_segmentations(spark, tmp_path):
    from earshot.llm.queries.pieces import op6_gumbel_pieces

    frame = spark.createDataFrame([(1, "several words to cut"), (2, "more of them here"), (3, "")], "doc_id long, text string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    ranks = [(r.doc_id, r["rank"]) for r in op6_gumbel_pieces(spark, str(tmp_path)).collect()]
    assert sorted(ranks) == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (3, 1)]
    assert sorted((r.doc_id, r["rank"]) for r in pieces.segmentations(frame, MODEL).collect()) == sorted(ranks)


def test_segmentations_follow_their_probabilities():
    vocab, n = pieces.Vocabulary(MODEL, 0.5), 6000
    rows = pieces.sample(vocab, ["thea of"] * n, rolling.mix(np.arange(n).astype(np.uint64)), 2)
    p = {tuple(x[5]): math.exp(x[2]) for x in rows}
    first = collections.Counter(tuple(x[5]) for x in rows if x[1] == 1)
    both = collections.Counter(tuple(x[5]) for x in rows)
    for s, q in p.items():
        included = q + sum(p[a] * q / (1 - p[a]) for a in p if a != s)
        assert abs(first[s] / n - q) < 5 * math.sqrt(q / n) + 1e-3 and abs(both[s] / n - included) < 5 * math.sqrt(included / n) + 1e-3
    # the inclusion scores weight the samples back to the probabilities
    back = collections.defaultdict(float)
    for x in rows:
        back[tuple(x[5])] += p[tuple(x[5])] / x[4] / n
    assert all(abs(back[s] - p[s]) < 0.03 for s in p)


def test_hash_of_words_and_substrings():
    data = np.frombuffer(b"abcabc bc", np.uint8)
    prefix = rolling.prefix_hashes(data)
    h = lambda a, b: int(rolling.substring_hashes(prefix, np.array([a]), np.array([b]))[0])
    assert h(0, 3) == h(3, 6) and h(1, 3) == h(7, 9) and h(0, 3) != h(0, 2)
    assert hashlib  # the digests of the queries are Spark's
