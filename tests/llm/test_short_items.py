"""Benchmark items that hold few words or few literal words."""

from meridian.llm.decontaminate import contaminated


def test_short_and_bare_items_are_found_verbatim(spark):
    items = [(1, "capital of France"), (2, "2 4 8 16 32 64 128"), (3, "12 km"), (4, "name the three primary colours of light")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [(i, f"some words before it {t} and some words after it") for i, t in items] + [(9, "a clean text with 3 5 7 11 13 17 19 and the 13 km of it")]
    got = contaminated(spark.createDataFrame(texts, "doc_id long, text string"), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (2, 2), (3, 3), (4, 4)]
