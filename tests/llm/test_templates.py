"""Benchmark items in other words: names, numbers and units changed, consistently or not; and the plain version."""

import random

import pytest
import regex

from meridian.llm import decontaminate
from meridian.llm.decontaminate import LITERALS, NAME, NUM, NUMBER_WORDS, TITLE, UNIT, UNITS, contaminated

ITEM = "Tom has 5 red apples in a box. Tom gives 2 of the apples to Lisa. Tom then buys 9 more at the shop. How many apples does he have?"


def found(spark, texts, items):
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id long, text string, dk string")
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, h string, item int")
    return sorted((r.doc_id, r.item_id, r.matched, r.n_windows) for r in contaminated(docs, bench).collect())


def test_names_that_begin_sentences(spark):
    anna = ITEM.replace("Tom", "Anna").replace("Lisa", "Ben").replace(" 5 ", " 8 ").replace(" 2 ", " 3 ").replace(" 9 ", " four ")
    mixed = "Anna has 8 red apples in a box. Carl gives 3 of the apples to Ben. Dora then buys 3 more at the shop. How many apples does he have?"
    clean = "Tom has a dog in a house. The dog gives us a lot to do. Lisa then goes to the shop. How many dogs do you have?"
    got = found(spark, [ITEM, "Some text first. " + anna + " And more.", mixed, clean], [ITEM])
    assert [x[:2] for x in got] == [(0, 0), (1, 0)]


def test_a_changed_word_leaves_numbers_alone(spark):
    item = "The box holds 12 eggs and 3 cups. The jar holds 5 cups. The tin holds 40 nuts and the bag holds 6 more of them now. Say how many cups there are in the box and in the jar when all of it is done."
    other = item.replace("12", "13").replace("The jar", "Every jar").replace("40", "41")
    assert [x[:2] for x in found(spark, [other], [item])] == [(0, 0)]


def test_numbers_in_every_form(spark):
    item = "add the sum 2+3 to 1/2 of the total cost of €5 and write down what you get"
    other = item.replace("2+3", "17+4").replace("1/2", "3/4").replace("€5", "€40")
    words = "a box holds twelve eggs and weighs three kg so how much does one box of six eggs weigh"
    digits = words.replace("twelve", "10").replace("three kg", "2 pounds").replace("one", "1").replace("six", "5")
    assert [x[:2] for x in found(spark, [other, digits, item, words], [item, words])] == [(0, 0), (1, 1), (2, 0), (3, 1)]


SPACE = r"[\x20\x09-\x0D]+"


def plain(texts, items, n=5, similarity=0.8):
    def read(text):
        flat = regex.sub(SPACE, " ", text).strip(" ")
        if not flat:
            return None
        marked = regex.sub(r"""(?<![^ "'(])(\p{Lu}\p{Ll}+)(?=$|[ .,;:!?'")])""", TITLE + r"\1", flat)
        low = "".join(c for c in marked.lower() if c not in ".,;:!?\"'()[]{}*#$%&|_-")
        low = regex.sub("[0-9]+", NUM, low)
        low = regex.sub(rf"(?<![^ ]){TITLE}?(?:{NUMBER_WORDS})(?![^ ])", NUM, low)
        low = regex.sub(rf"(?<={NUM})( ?)(?:{UNITS})(?= |$)", rf"\1{UNIT}", low)
        return flat.split(" "), low.replace(TITLE, "").split(" "), regex.sub(f"{TITLE}[^ ]*", NAME, low).split(" ")

    def cuts(r, n):
        raw, canon, named = r
        for at in range(max(1, len(raw) - n + 1)):
            yield at, 0, tuple(canon[at : at + n])
            if canon[at : at + n] != named[at : at + n]:
                yield at, 1, tuple(named[at : at + n])

    strip = lambda t: regex.sub(r"""^["'(]+|[.,;:!?"')]+$""", "", t).lower()
    slot = lambda t: any(c in t for c in (NUM, NAME, UNIT))
    first = {}
    for i, t in enumerate(items):
        first.setdefault(t, i)
    out = []
    for text, i in first.items():
        r = read(text) if text is not None else None
        if r is None:
            continue
        own = [(at, t) for at, _, t in cuts(r, n) if sum(not slot(x) and x != "" for x in t) >= min(len(r[0]), LITERALS)]
        size = min(n, len(r[0]))
        for d, doc in enumerate(texts):
            q = read(doc) if doc is not None else None
            if q is None:
                continue
            if own:
                met = [(a, b, k, t) for a, t in own for b, k, u in cuts(q, size) if t == u]
                total = len({a for a, _ in own})
            else:
                met = [(a, b, 0, ()) for a in range(max(1, len(r[0]) - n + 1)) for b in range(len(q[0]) - size + 1) if r[0][a : a + size] == q[0][b : b + size]]
                total = max(1, len(r[0]) - n + 1)
            pairs = {}
            for a, b, reading, t in met:
                pairs.setdefault((b - a, reading), set()).update((strip(r[0][a + k]), strip(q[0][b + k])) for k, x in enumerate(t) if slot(x))
            good = {s for s, p in pairs.items() if len({x for x, _ in p}) == len(p) == len({y for _, y in p})}
            matched = len({a for a, b, reading, t in met if (b - a, reading) in good or not any(map(slot, t))})
            if matched >= similarity * total and matched:
                out.append((d, i, matched, total))
    return sorted(out)


@pytest.mark.parametrize("most", [decontaminate.BROADCAST_WINDOWS, 0])
def test_the_plain_version(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", most)
    g = random.Random(4)
    words = ["the", "red", "Tom", "Anna", "buys", "5", "12", "km", "apples", "two", "and", "of", "box.", "She", "gives,", "1/2", "(Ben)", "shop?"]
    say = lambda n: " ".join(g.choice(words) for _ in range(n))
    items = [None, "", " \t", "shop", "5", "red box.", "2 4 8 16 32 64", say(9), say(9), say(20), ITEM, ITEM, "Say it. Then say it again, Tom."]
    texts = [None, "", " \n ", *items[3:], *[say(g.randint(1, 60)) for _ in range(15)]]
    for t in items[7:]:
        texts += [f"{say(4)} {t} {say(3)}", t.replace("Tom", "Eve").replace("5", "77").replace("Anna", "Tom"), t.replace("Tom", "Eve", 1), t.replace("red", "blue", 1)]
    want = plain(texts, items)
    assert found(spark, texts, items) == want and len(want) > 25


def test_a_very_long_text(spark):
    text = " ".join(["lorem ipsum dolor 5 sit"] * 20_000)
    assert [x[:2] for x in found(spark, [text, text + " " + ITEM, None], [ITEM])] == [(1, 0)]
    assert found(spark, [text], []) == [] == found(spark, [], [ITEM])
