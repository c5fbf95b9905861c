"""Stages of the pipeline against brute force."""

import random

import pytest

import corpus_pipeline as cp


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(texts, least=0.8):
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or (a and len(a & sets[j]) >= least * len(a | sets[j]) - 1e-9):
                x, y = label[i], label[j]
                label = [min(x, y) if v in (x, y) else v for v in label]
    return label


def test_near_dedup_is_brute_force(spark):
    g = random.Random(5)
    texts = [None, "", " \n", "one", "ONE", "one two", "a b c d e", "a b c d e f"]
    for _ in range(40):  # copies with a few words changed: similarities on either side of 0.8
        base = [f"w{g.randint(0, 900)}" for _ in range(g.randint(60, 200))]
        texts.append(" ".join(base))
        for changed in (1, 2, 3, 4):
            w = list(base)
            for at in g.sample(range(len(w)), changed):
                w[at] = "new"
            texts.append(" ".join(w))
    chain = [f"c{i}" for i in range(150)]
    texts += [" ".join(chain[6 * i : 6 * i + 60]) for i in range(10)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted(r.doc_id for r in cp.near_dedup(spark, docs, "").collect())
    label = brute(texts)
    assert got == sorted(set(label)) and 48 < len(got) < len(texts) - 40
    assert cp.near_dedup(spark, docs.where("false"), "").count() == 0


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, dk string, row string"
PROSE = "The quick brown fox jumps over the lazy dog near the old river bank, and nobody saw it at all."
ITEM = "Which of the seven old bridges of the town crosses the river at the market place near the mill"
LONG = " ".join(f"word{i * 7919 % 10_007}" for i in range(60_000))
TEXTS = [None, None, "", "", " \n\t", PROSE, PROSE, PROSE + "\nA line of its own stands here.", LONG, LONG, "See this: " + ITEM + "?", "\n" * 5_000, "short line here now\nanother one, all alone"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('tables')}"
    spark.createDataFrame([(i, i % 2) for i in range(12)] + [(3, 0), (None, 1)], "doc_id long, quality int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    rows = [(i if i not in (1, 6) else None, t, "en", "s", len(t) if t is not None else None, "x", "y") for i, t in enumerate(TEXTS)]
    spark.createDataFrame([*rows, rows[5]], SCHEMA).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{root}/none.parquet")
    return root


@pytest.mark.parametrize("k", range(4))
def test_filtering_stages_on_odd_rows(spark, sf_dir, k):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = cp.STAGES[k][1](spark, docs, sf_dir)
    rows = out.collect()
    assert out.columns == cp.COLUMNS and out.schema["text"].dataType.simpleString() == "string"
    texts = [r.text for r in rows]
    if k == 0:  # nothing but whole rows, as they were
        assert set(map(tuple, rows)) <= {tuple(r) for r in docs.select(*cp.COLUMNS).collect()}
    if k == 1:  # all rows; the recurring lines once
        assert len(rows) == docs.count() and texts.count(None) == 2
        assert sum((t or "").count(PROSE) for t in texts) == 1 and sum((t or "").count(LONG) for t in texts) == 1
        assert all(r.n_chars == len(r.text) for r in rows if r.text is not None) and any("A line of its own" in (t or "") for t in texts)
    if k == 2:  # one of each group: blank ones, the prose, the long text, and what stands alone
        assert len(rows) == len(set(brute(TEXTS))) and sum(not (t or "").strip() for t in texts) == 1 and texts.count(LONG) == 1
        assert min(r.doc_id for r in rows if not (r.text or "").strip()) == 0
    if k == 3:
        assert len(rows) == docs.count() - 1 and not any(ITEM in (t or "") for t in texts)
    none = cp.STAGES[k][1](spark, spark.read.parquet(f"{sf_dir}/none.parquet"), sf_dir)
    assert none.columns == cp.COLUMNS and none.count() == 0


def test_the_whole_pipeline(spark, sf_dir):
    rows = cp.run(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} <= {None, *range(len(TEXTS))} and all(0 <= r.offset <= 2048 - r.length for r in rows)
    last = cp.STAGES[-1][1](spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    assert last.where("piece = 0").count() == len(TEXTS) + 1
    assert cp.STAGES[-1][1](spark, spark.read.parquet(f"{sf_dir}/none.parquet"), sf_dir).count() == 0
