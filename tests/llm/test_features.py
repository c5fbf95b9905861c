"""The classifiers' features and scores against plain versions, and the other queries' SQL on the smallest tables."""

import math
import os
import random
import re

import duckdb
import numpy as np
import pytest

from meridian.llm import quality_crf as q
from meridian.llm import queries, toxicity
from meridian.llm.textcore import word_hashes, words

g = random.Random(9)
PARTS = ["you", "YOU", "idiot", "1d10t", "st*pid", "stup1d", "scum!!", "Hello", "World.", "a1b", "x", "É漢ñ", "12", "||", "??", "ok,", "dumm", "-", "no-body", "AAAA", "\n", "\n\n", "\t", "same same", "****"]
TEXTS = ["", "\n", " ", "a", "word\n", "\nword", "1\n2\n\n"] + [" ".join(g.choice(PARTS) for _ in range(g.randint(1, 40))) for _ in range(40)] + ["".join(g.choice("abc1230$@ \n!") for _ in range(300)) for _ in range(10)]


def columns(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


LETTERS = re.compile(rb"[A-Za-z\x80-\xff]+")


def plain_toxicity(text, stems):
    raw = text.encode()
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    found = [(m.start(), m.end(), m.group()) for m in LETTERS.finditer(low)]
    ws = [w for _, _, w in found]
    n, size = max(1, len(ws)), max(1, len(raw))
    lexicon, person = {w.encode() for w in toxicity.LEXICON}, {w.encode() for w in toxicity.SECOND_PERSON}
    best = [max([0.0, stems.get((w, True), 0.0), *[stems.get((w[:k], False), 0.0) for k in toxicity.STEM_BYTES if len(w) > k]]) for w in ws]
    strong = [b > 2 for b in best]
    lexical = [w in lexicon for w in ws]
    hit = [a or b for a, b in zip(lexical, strong, strict=True)]
    near = [any(ws[j] in person for j in range(max(0, i - toxicity.NEAR), min(len(ws), i + toxicity.NEAR + 1))) for i in range(len(ws))]
    letter = lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128
    digit = lambda b: 48 <= b <= 57
    sign = [not letter(b) and not digit(b) and b not in b"\t\n\v\f\r " for b in raw]
    swap = [0 < i < len(raw) - 1 and b in b"013457@$*!" and letter(raw[i - 1]) and letter(raw[i + 1]) for i, b in enumerate(raw)]
    spelled = 0
    for m in re.finditer(rb"[A-Za-z\x80-\xff013457@$*!]+", raw):
        if m.end() - m.start() <= 24 and m.group().lower().translate(toxicity._LEET).decode("utf-8", "ignore").strip("*") in toxicity.LEXICON:
            spelled += sum(swap[m.start() : m.end()])
    shouted = sum(1 for a, b, _ in found if b - a > 1 and all(65 <= c <= 90 for c in raw[a:b]))
    hits = sum(hit)
    return [
        math.log1p(len(ws)), sum(lexical), sum(lexical) / n, sum(strong), sum(strong) / n, sum(b > 0.7 for b in best) / n, sum(best) / n, max(best, default=0.0),
        len({w for w, s in zip(ws, strong, strict=True) if s}), sum(w in person for w in ws) / n, sum(a and b for a, b in zip(hit, near, strict=True)) / max(1, hits), hits,
        sum(65 <= b <= 90 for b in raw) / size, shouted / n, raw.count(b"!") / size, raw.count(b"?") / size, sum(sign) / size,
        sum(sign[i] and raw[i] == raw[i - 1] for i in range(1, len(raw))) / size, sum(map(digit, raw)) / size, sum(swap) / n, spelled, sum(b >= 128 for b in raw) / size,
    ]


def test_toxicity_features():
    stems = {(b"hel", False): 1.5, (b"scum", True): 2.5, (b"idi", False): 3.0, (b"same", True): 0.9}
    hashed = {}
    for (w, whole), weight in stems.items():
        h = word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]
        hashed[~h if whole else h] = weight
    keys = np.sort(np.array(list(hashed), np.uint64))
    table = (keys, np.array([hashed[k] for k in keys]))
    want = [plain_toxicity(t, stems) for t in TEXTS]
    assert np.allclose(toxicity.features(*columns(TEXTS), table), want)
    assert all(np.allclose(toxicity.features(*columns([t]), table), [w]) for t, w in zip(TEXTS, want, strict=True))


def plain_lines(text):
    out = []
    for line in text.encode().split(b"\n"):
        n = max(1, len(line))
        ws = re.findall(rb"[^\x20\x09-\x0D]+", line)
        count = max(1, len(ws))
        letter = [65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in line]
        white = [b in b"\t\n\v\f\r " for b in line]
        digit = [48 <= b <= 57 for b in line]
        usual = [b in b".,;:'\"!?()-" for b in line]
        sign = sum(not (x or y or z or u) for x, y, z, u in zip(letter, white, digit, usual, strict=True))
        out.append([
            math.log1p(len(line)) / 5, math.log1p(len(ws)) / 4, sum(letter) / n, sum(65 <= b <= 90 for b in line) / max(1, sum(letter)), sum(digit) / n, sign / n, sign / count / 3,
            line.count(b"|") / count, line.count(b"!") / count, sum(usual) / n, sum(a == b for a, b in zip(ws, ws[1:], strict=False)) / count, float(line[-1:] in (b".", b"!", b"?", b";")),
            sum(white) / n, math.log1p(max(map(len, ws), default=0)) / 5,
        ])
    zero = [0.0] * q.OWN
    return [[*x, *(out[i - 1] if i else zero), *(out[i + 1] if i + 1 < len(out) else zero), float(i == 0), float(i + 1 == len(out))] for i, x in enumerate(out)], [max(1, len(x)) for x in text.encode().split(b"\n")]


@pytest.mark.parametrize("piece, span, halo", [(1 << 16, 1 << 15, 1 << 10), (3, 4, 60)])
def test_quality_features_and_scores(monkeypatch, piece, span, halo):
    monkeypatch.setattr(q, "PIECE", piece)
    monkeypatch.setattr(q, "SPAN", span)
    monkeypatch.setattr(q, "HALO", halo)
    texts = [*TEXTS, "\n".join(g.choice(PARTS) for _ in range(300))]
    x, loff, size = q.line_features(*columns(texts))
    want = [plain_lines(t) for t in texts]
    assert np.allclose(x, [f for rows, _ in want for f in rows]) and size.tolist() == [n for _, own in want for n in own]
    assert np.diff(loff).tolist() == [len(own) for _, own in want]
    r = np.random.default_rng(1)
    field = q.Field(r.normal(size=x.shape[1] + 1) / 3, np.clip(r.normal(size=(2, 2)), -2, 2), x.mean(axis=0), x.std(axis=0) + 0.1)
    score, at, sizes = q.emissions(field, *columns(texts))
    assert np.allclose(score, field.emissions(x)) and (at == loff).all() and (sizes == size).all()
    got = q.document_quality(field, score, loff, size)
    for k, t in enumerate(texts):  # each chain by itself
        s = score[loff[k] : loff[k + 1]]
        alpha, beta = [np.array([0, s[0]])], [np.zeros(2)]
        for e in s[1:]:
            alpha.append(np.array([0, e]) + np.logaddexp(alpha[-1][0] + field.moves[0], alpha[-1][1] + field.moves[1]))
        for e in s[:0:-1]:
            nxt = np.array([0, e]) + beta[0]
            beta.insert(0, np.logaddexp(field.moves[:, 0] + nxt[0], field.moves[:, 1] + nxt[1]))
        p = np.array([math.exp(a[1] + b[1] - np.logaddexp(*(a + b))) for a, b in zip(alpha, beta, strict=True)])
        own = size[loff[k] : loff[k + 1]]
        assert abs(got[k] - (p * own).sum() / own.sum()) < 1e-6, t[:40]


def test_a_text_of_newlines_is_scored():
    n = 300_000
    data = np.full(n, 10, np.uint8)
    field = q.Field(np.linspace(-1, 1, 3 * q.OWN + 3), np.array([[1.0, -1.0], [-1.0, 1.0]]), np.zeros(3 * q.OWN + 2), np.ones(3 * q.OWN + 2))
    whole = q.document_quality(field, *q.emissions(field, data, np.array([0, n])))
    part = q.document_quality(field, *q.emissions(field, data[:3000], np.array([0, 3000])))
    assert abs(whole[0] - part[0]) < 1e-3


def test_words_end_with_their_text():
    starts, ends, at = words(*columns(["ab", "cd e", "", " f"]))
    assert (ends - starts).tolist() == [2, 2, 1, 1] and at.tolist() == [0, 1, 3, 3, 4]


D = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(D), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    df, want = queries.QUERIES[name](spark, D), con.sql(queries.ORACLE[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    rows = [tuple(r[want.columns.index(c)] for c in cols) for r in want.fetchall()]
    assert sorted(map(str, (tuple(r[c] for c in cols) for r in df.collect()))) == sorted(map(str, rows))
