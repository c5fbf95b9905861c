"""Repeated windows: hashes that no family of texts makes collide, and dealing in two steps."""

import random

import numpy as np
import pytest

from meridian.llm import repeats
from meridian.llm.substring_dedup import remove_repeated_windows
from meridian.llm.textcore import whole_hashes, window_hashes, word_hashes, words


def thue_morse(n, a, b):
    return [a if bin(i).count("1") % 2 == 0 else b for i in range(n)]


def removed(spark, texts, **options):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    return [r.n_removed for r in remove_repeated_windows(rows, **options).orderBy("doc_id").collect()]


def test_words_that_collide_in_polynomial_hashes(spark):
    p, q = "".join(thue_morse(2048, "a", "b")), "".join(thue_morse(2048, "b", "a"))
    around = [f"w{i}" for i in range(40)]
    texts = [" ".join([*around[:20], x, *around[20:]]) for x in (p, q)]
    assert removed(spark, texts) == [0, 0]
    assert removed(spark, [texts[0], "own " + texts[0]]) == [41, 41]


def test_runs_of_words_that_collide_in_polynomial_hashes(spark):
    texts = [" ".join(thue_morse(1024, *x)) for x in (("a", "b"), ("b", "a"))]
    assert removed(spark, texts, window=1024) == [0, 0]
    assert removed(spark, [texts[0], texts[0] + " c"], window=1024) == [1024, 1024]
    seen = set()
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        starts, ends, at = words(data, np.array([0, len(data)]))
        h = word_hashes(data, starts, ends)
        seen |= {int(window_hashes(h, 1024)[0]), int(whole_hashes(h, at)[0])}
    assert len(seen) == 4


def test_window_hashes_tell_place_from_content():
    h = word_hashes(np.frombuffer(b"abcabc" * 20, np.uint8), np.arange(120), np.arange(1, 121))
    for size in (1, 2, 3, 5, 7, 15, 35, 64, 100, 121):
        k = window_hashes(h, size)
        assert len(k) == max(0, 121 - size) and (k[3:] == k[:-3]).all() and len(set(k[:3].tolist())) == min(3, len(k))


@pytest.mark.parametrize("direct", [1, 2048])
def test_blocks_go_in_one_step_or_two(spark, monkeypatch, direct):
    monkeypatch.setattr(repeats, "DIRECT", direct)
    monkeypatch.setattr(repeats, "BLOCK_ROWS", 64)
    assert repeats.regions(10) == ((3, 4) if direct == 1 else (10, 1))
    g = random.Random(2)
    keys = [g.randint(0, 60) if g.random() < 0.6 else g.randint(0, 2**62) for _ in range(600)]
    rows = [(k, dk, pos) for (dk, pos), k in zip(((i // 30, i % 30) for i in range(600)), keys, strict=True)]

    def pack(batches):
        packer = repeats.Packer(10)
        for b in batches:
            c = [b.column(i).to_numpy() for i in range(3)]
            for at in range(0, len(c[0]), 40):
                part = [x[at : at + 40] for x in c]
                yield from packer.add(part[0].astype(np.uint64), np.zeros(len(part[0]), np.uint32), part[1], part[2])
        yield from packer.flush()

    blocks = spark.createDataFrame(rows, "k long, dk long, pos int").repartition(3).mapInArrow(pack, repeats.BLOCK_SCHEMA)
    got = sorted((r.dk, p) for r in repeats.positions_seen_again(blocks, 10).collect() for p in r.pos)
    assert got == sorted((dk, pos) for k, dk, pos in rows if keys.count(k) > 1)
