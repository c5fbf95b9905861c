"""Every operator on nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables, and against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian.llm import e8, url_filters
from meridian.llm import simhash as sim
from meridian.llm.boosting import calibrated, fit_trees, isotonic
from meridian.llm.decontaminate import contaminated
from meridian.llm.embedding_dedup import near_duplicate_vectors
from meridian.llm.line_dedup import drop_recurring_lines
from meridian.llm.packing import improve, in_order, pack, search
from meridian.llm.quality_crf import forward_backward, score_quality
from meridian.llm.scratch import Scratch
from meridian.llm.components import connected_components
from meridian.llm.substring_dedup import DIFFERENCE_COVERS, cover_for, remove_repeated_windows
from meridian.llm.token_counts import count_tokens
from meridian.llm.tokens import Encoder, tokenizer_path
from meridian.llm.toxicity import score_toxicity
from meridian.llm.url_filters import filter_urls, site_rule, word_rule

SCHEMA = "doc_id long, text string, dk string, id int, label string, h string, row string"
rng = random.Random(7)
WORDS = [f"w{i}" for i in range(400)]
LONG = " ".join(rng.choice(WORDS) for _ in range(6000))
SHARED = " ".join(rng.choice(WORDS) for _ in range(60))
TEXTS = [None, "", " \n\t ", "one", "a b c", "a b c", LONG, SHARED, "x y " + SHARED + " z", SHARED + "\n" + SHARED, "É ñ <|endoftext|> 漢字", "same line here now\nother"] + [
    "same line here now\n" + " ".join(rng.choice(WORDS) for _ in range(50)) for _ in range(4)
]
ROWS = [(i if i != 5 else None, t, "d", 1, "l", "h", "r") for i, t in enumerate(TEXTS)] + [(7, SHARED, "d", 1, "l", "h", "r")]
JSON, RANKS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def split(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())


def test_substring_dedup(docs, none):
    count = Counter(tuple(w[i : i + 35]) for w in (split(r[1]) for r in ROWS) for i in range(len(w) - 34))
    want = []
    for r in ROWS:
        w = split(r[1])
        gone = {j for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        want.append((r[0], len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    got = [tuple(r) for r in remove_repeated_windows(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert remove_repeated_windows(none).count() == 0
    for v, cover in DIFFERENCE_COVERS.items():
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))
    assert cover_for(35)[0] == 21


def test_simhash(spark, docs, none):
    prints = [sim.fingerprint((r[1] or "").encode()) for r in ROWS]
    label = list(range(len(ROWS)))
    for i in range(len(ROWS)):
        for j in range(len(ROWS)):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    least = {k: min((r[0] for r, x in zip(ROWS, label, strict=True) if x == k and r[0] is not None), default=None) for k in label}
    want = [(r[0], f"{p:016x}", least[k]) for r, p, k in zip(ROWS, prints, label, strict=True)]
    assert sorted(map(str, map(tuple, sim.near_duplicates(docs).collect()))) == sorted(map(str, want))
    assert sim.near_duplicates(none).count() == 0


def test_large_nodes_are_cut(spark, monkeypatch):
    g = np.random.default_rng(0)
    base = g.integers(0, 2**62, 6).astype(np.uint64)
    x = np.unique(np.concatenate([base[g.integers(0, 6, 80)] ^ (np.uint64(1) << g.integers(0, 64, 80).astype(np.uint64)) for _ in range(4)]))
    df = spark.createDataFrame([(int(v.astype(np.int64)), i) for i, v in enumerate(x)], "fp long, rep long")
    want = {(i, j) for i in range(len(x)) for j in range(i) if int(x[i] ^ x[j]).bit_count() <= 4}

    def groups(pairs):
        label = list(range(len(x)))
        for a, b in pairs:
            a, b = label[a], label[b]
            if a != b:
                label = [min(a, b) if v in (a, b) else v for v in label]
        return label

    for n, block in ((len(x), 4096), (1 << 22, 4096), (len(x), 16)):
        monkeypatch.setattr(sim, "BLOCK", block)
        assert groups([(r.u, r.v) for r in sim.hamming_links(df, n).collect()]) == groups(want)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 7), (200, 201), (5, 5), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark)).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 0, 200: 200, 201: 200}


def test_line_dedup(docs, none):
    got = {(r.doc_id, r.text): r for r in drop_recurring_lines(docs).collect()}
    assert got[(0, None)].n_lines == 0 and got[(1, "")].n_lines == 1
    assert sum(r.n_dropped for r in got.values()) >= 4 and sum("same line here now" in (t or "") for _, t in got) == 1
    assert set(drop_recurring_lines(docs).columns) == {*docs.columns, "n_lines", "n_dropped"}
    assert drop_recurring_lines(none).count() == 0


def test_line_templates_generalise(spark):
    rows = [(i, f"log entry from host {w} at {i}:00 done ok\nown text {i} {w} {w}x{w}") for i, w in enumerate(["alpha", "beta", "gamma", "delta", "eps"])]
    out = drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum("log entry" in r.text for r in out) == 1 and all("own text" in r.text for r in out)


def test_decontamination(spark, none):
    item = "Tom buys 5 kg of fresh apples at the old market and pays 12 dollars in total today"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, item)], "item_id long, text string")
    rows = [(10, "intro words " + item + " and more"), (11, "intro words " + item.replace("5 kg", "7 kg").replace("12", "40") + " and more"), (12, "a clean text about apples at the old market"), (13, None), (14, ""), (10, "intro words " + item + " and more")]
    got = contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(10, 1), (10, 1), (11, 1)]
    assert contaminated(none, bench).count() == 0
    assert contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench.where("false")).count() == 0


def test_token_counts_and_cache(spark, docs, none, tmp_path):
    enc = Encoder(JSON)
    want = sorted((str(r[0]), len((r[1] or "").encode()), len(enc.ids(r[1] or ""))) for r in ROWS)
    cache = f"file://{tmp_path}/cache"
    half = docs.where("text like '%same%' or text = ''")
    assert count_tokens(half, JSON, RANKS, cache).count() == half.count()  # a part of the digests is stored
    stored = spark.read.parquet(cache).count()
    for _ in range(2):
        got = count_tokens(docs, JSON, RANKS, cache).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert 0 < stored < spark.read.parquet(cache).count() == len({r[1] or "" for r in ROWS})
    spark.read.parquet(cache).withColumn("n_tokens", F.col("n_tokens") + 1000).write.parquet(f"{cache}-2")
    assert all(r.n_tokens >= 1000 for r in count_tokens(docs, JSON, RANKS, f"{cache}-2").collect())  # read, not encoded
    assert count_tokens(none, JSON, RANKS).count() == 0


def test_fast_ids_equal_the_tokenizers():
    fast, slow = Encoder(JSON, RANKS), Encoder(JSON)
    g = random.Random(1)
    for _ in range(300):
        t = "".join(g.choice("ab Z9.,'s\n\t éñß$—“”<|endoftext|>") for _ in range(g.randint(0, 60)))
        assert fast.ids(t) == slow.ids(t)


def test_packing(docs, none):
    enc = Encoder(JSON)
    rows = pack(docs, JSON, RANKS, capacity=256).collect()
    want = Counter()
    for r in ROWS:
        ids = np.array([*enc.ids(r[1] or ""), 0], "<u4")
        cuts = [0, *range(len(ids) % 256 or 256, len(ids), 256), len(ids)]  # only the first piece may be shorter
        want.update((r[0], p, a, b - a, zlib.crc32(ids[a:b].tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    seqs: dict = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 256
    assert pack(none, JSON, RANKS).count() == 0


def test_local_search_packs_by_itself():
    g = random.Random(3)
    for lo, hi, n in ((1, 100, 200), (15, 45, 400), (30, 50, 300), (1, 3, 300), (100, 100, 5), (1, 1, 0)):
        sizes = [g.randint(lo, hi) for _ in range(n)]
        for bins in (in_order(sizes, 100), [[i] for i in range(n)]):
            out = improve(sizes, bins, 100)
            assert sorted(i for b in out for i in b) == list(range(n)) and all(sum(sizes[i] for i in b) <= 100 for b in out)
            assert sum(sum(sizes[i] for i in b) ** 2 for b in out) >= sum(sum(sizes[i] for i in b) ** 2 for b in bins)
        if hi < 50 and n:  # pieces that can fill bins up: within 1 % of the bound
            assert len(search(sizes, 100)) <= 1.01 * sum(sizes) / 100 + 1


def test_each_step_of_the_search():
    for sizes, bins, kind in (([6, 4], [[0], [1]], "move"), ([6, 3, 4, 5], [[0, 1], [2, 3]], "one for one"), ([6, 3, 2, 2, 5], [[0, 1], [2, 3, 4]], "two for one")):
        made = Counter()
        out = improve(sizes, bins, 10, made)
        assert made[kind] and sum(sizes[i] for i in out[0]) == 10, kind


def test_e8_decodes_to_the_nearest():
    x = np.random.default_rng(2).normal(size=(300, 8)) * 2
    p = e8.decode(x)
    d = ((x - p / 2) ** 2).sum(axis=1)
    assert (p.sum(axis=1) % 4 == 0).all() and d.max() <= 1 + 1e-9
    assert (((x[:, None] - (p[:, None] + e8.ROOTS[None]) / 2) ** 2).sum(axis=2).min(axis=1) >= d - 1e-9).all()


def test_embedding_dedup(spark):
    g = np.random.default_rng(3)
    base = g.normal(size=(40, 64))
    v = np.concatenate([base + g.normal(size=base.shape) * s for s in (0, 0, 0.1, 0.2, 0.25, 0.28)])
    rows = [(i, [float(c) for c in x], int(i % 3), "x", 1) for i, x in enumerate(v)]
    rows += [(i, x, y, "x", 1) for i, x, y in [(900, None, 1), (901, [0.0] * 64, 1), (902, rows[0][1], None), (903, [float("nan")] * 64, 1), (904, [1.0, 2.0], 1), (905, [], 1), (3, rows[3][1], 0)]]
    got = near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, vec string, n int")).collect()
    x = v.astype(np.float32).astype(float)
    x = np.concatenate([x, x[3:4]])
    label = np.array([i % 3 for i in range(len(v))] + [0])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    ids = [*range(len(v)), 3]
    low = list(ids)
    while (after := [min(low[j] for j in [i, *np.flatnonzero(near[i])]) for i in range(len(ids))]) != low:
        low = after
    want = sorted((ids[i], int(near[i].sum()), low[i], ids[i] == low[i]) for i in range(len(ids)))
    assert len(got) == len(rows) and near.sum() > 200
    assert sorted(tuple(r) for r in got if r.vec_id < 900) == want  # every link, though the index may miss 0.2 % at the threshold
    assert all(r.n_links == 0 and r.kept for r in got if r.vec_id >= 900)
    assert near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("most", [url_filters.MAX_RULES, 1])
def test_url_filter(spark, monkeypatch, most):
    monkeypatch.setattr(url_filters, "MAX_RULES", most)
    rules = [site_rule("allow", "org/"), site_rule("block", "example.org/es/"), word_rule("block", "spam")]
    urls = ["http://A.Example.ORG/es/1", "http://x.org/es/", "http://x.org", "http://spam.net/a", "no scheme", "", None, "http://notexample.org/es/1", "http://h.com/p?spam#x", "http://sorg/es/"]
    out = [(r.host, r.rule, r.verdict) for r in filter_urls(spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string"), rules).orderBy("page_id").collect()]
    assert out[0] == ("a.example.org", "example.org/es/", "block") and out[1][1:] == ("org/", "allow") and out[2][1:] == (None, "allow") and out[3][1:] == (None, "block")
    assert out[4] == ("", None, "allow") == out[5] == out[6] and out[7][1:] == ("org/", "allow") and out[8][1:] == (None, "allow") and out[9][1:] == (None, "allow")
    assert filter_urls(spark.createDataFrame([(1, "http://a.b/")], "page_id long, url string"), []).first().verdict == "allow"


def test_forward_backward_is_exact():
    g = np.random.default_rng(4)
    loff, moves = np.array([0, 3, 4, 8]), g.normal(size=(2, 2))
    score = g.normal(size=8)
    p, pairs, log_z = forward_backward(score, loff, moves)
    want, total = np.zeros(8), np.zeros((2, 2))
    for c in range(3):
        a, b = loff[c], loff[c + 1]
        z = 0.0
        own, both = np.zeros(b - a), np.zeros((2, 2))
        for s in np.ndindex(*(2,) * (b - a)):
            e = np.exp(sum(score[a + i] * s[i] for i in range(b - a)) + sum(moves[s[i], s[i + 1]] for i in range(b - a - 1)))
            z += e
            own += e * np.array(s)
            for i in range(b - a - 1):
                both[s[i], s[i + 1]] += e
        want[a:b], total = own / z, total + both / z
        assert abs(np.log(z) - log_z[c]) < 1e-9
    assert np.allclose(p, want) and np.allclose(pairs, total)


def test_trees_and_calibration():
    g = np.random.default_rng(5)
    x = g.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    assert ((fit_trees(x, y).probability(x) > 0.5) == y).mean() > 0.95
    knots = isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0, 1, 0, 1]))
    values = calibrated(np.linspace(0, 1, 20), knots)
    assert (np.diff(values) >= 0).all()


@pytest.mark.parametrize("score, label", [(score_toxicity, "toxic"), (score_quality, "quality")])
def test_classifiers_on_odd_rows(spark, docs, none, score, label):
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(3, 0), (None, 1), (4, None)], f"doc_id long, {label} int")
    rows = score(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    assert score(none, labels).count() == 0
    assert all(r.score is not None for r in score(docs, labels.where("false")).collect())


def test_a_very_long_text(spark):
    """A text of 1.3 MB beside a copy of its middle and an empty one, through every operator on whole texts."""
    long = " ".join(f"w{i * 7919 % 60_013}" for i in range(200_000))
    w = long.split(" ")
    rows = [(1, long), (2, " ".join(w[90_000:90_100])), (3, None), (4, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    enc = Encoder(JSON)
    ids = np.array([*enc.ids(long), 0], "<u4")
    windows = Counter(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    windows.update(tuple(w[i : i + 35]) for i in range(90_000, 90_066))
    gone = set()
    for i in range(len(w) - 34):
        if windows[tuple(w[i : i + 35])] > 1:
            gone.update(range(i, i + 35))
    cut = {r.doc_id: r for r in remove_repeated_windows(docs).collect()}
    assert cut[1].n_removed == len(gone) > 100_000 and cut[2].n_removed == 100 and cut[4].n_removed == 0
    counts = {r.doc_id: r for r in count_tokens(docs, JSON, RANKS).collect()}
    assert counts[1].n_tokens == len(ids) - 1 and counts[1].n_bytes == len(long) and counts[1].over_limit and counts[3].n_tokens == 0
    pieces = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in pack(docs, JSON, RANKS).collect() if r.doc_id == 1)
    first = len(ids) % 2048 or 2048
    assert pieces[0] == (0, 0, first, zlib.crc32(ids[:first].tobytes())) and pieces[1] == (1, first, 2048, zlib.crc32(ids[first : first + 2048].tobytes()))
    assert sum(p[2] for p in pieces) == len(ids) and all(p[2] == 2048 for p in pieces[1:])
    prints = {r.doc_id: r.fingerprint for r in sim.near_duplicates(docs).collect()}
    assert prints[1] == f"{sim.fingerprint(long.encode()):016x}" and prints[3] == "0" * 16
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, quality int").withColumn("toxic", F.col("quality"))
    assert score_toxicity(docs, labels).count() == score_quality(docs, labels).count() == 4


def test_ties_in_packing(spark):
    docs = spark.createDataFrame([(i, "same words") for i in range(9)], "doc_id long, text string")
    n = len(Encoder(JSON).ids("same words")) + 1
    rows = pack(docs, JSON, RANKS, capacity=2 * n).collect()
    assert Counter(Counter(r.sequence_id for r in rows).values()) == {2: 4, 1: 1} and {r.offset for r in rows} == {0, n}
    assert sorted(r.length for r in pack(docs, JSON, RANKS, capacity=n).collect()) == [n] * 9
