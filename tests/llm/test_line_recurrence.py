"""Which recurring lines op1 drops."""

import random
import re
import time

from meridian.llm.line_dedup import drop_recurring_lines


def kept(spark, texts):
    rows = drop_recurring_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)).collect()
    return [r.text.split("\n") for r in sorted(rows, key=lambda r: r.doc_id)]


def test_short_lines_recur(spark):
    got = kept(spark, [f"Share\nRead more\n{2000 + i}\nown{'abcd'[i] * 3}" for i in range(4)])
    assert sum(x.count("Share") for x in got) == sum(x.count("Read more") for x in got) == 1
    assert all(f"{2000 + i}" in x and any(y.startswith("own") for y in x) for i, x in enumerate(got))


def test_a_leaf_holds_several_templates(spark):
    names = ["alpha", "beta", "gamma", "delta"]
    a = [f"the server is up and {w} has joined the cluster today" for w in names]
    b = [f"the server is down since {w} left a broken old disk" for w in names]
    other = ["the server is one two three four five six seven eight", "the server is nine ten large small red green blue grey"]
    got = kept(spark, [f"{x}\n{y}" for x, y in zip(a, b, strict=True)] + other)
    left = [y for x in got for y in x]
    assert sum(x in a for x in left) == sum(x in b for x in left) == 1 and set(other) <= set(left)


def test_a_common_value_is_still_a_field(spark):
    got = kept(spark, ["posted by admin on our own site"] * 30 + ["posted by admin in our own site", "posted by admin at our own site"])
    assert sum("posted" in y for x in got for y in x) == 1


def test_similar_forms_are_found_wherever_they_differ(spark):
    base = [f"t{chr(97 + i)}" for i in range(20)]
    for at in ([3, 4, 5, 6, 7, 8], [3, 6, 9, 12, 15, 18], [14, 15, 16, 17, 18, 19]):
        forms = [" ".join(f"{w}{x}" if i in at else w for i, w in enumerate(base)) for x in "pqr"]
        far = " ".join(f"{w}z" if i in [*at, 10, 11] else w for i, w in enumerate(base))
        left = [y for x in kept(spark, [*forms, far]) for y in x]
        assert sum(x in forms for x in left) == 1 and far in left


def test_two_documents_share_a_line(spark):
    passage = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    got = kept(spark, [f"first own text\n{passage}", f"{passage}\nanother own line here", "third"])
    assert got == [["first own text", passage], ["another own line here"], ["third"]]


def test_a_leading_token_with_many_values_is_a_field(spark):
    names = ["ann", "bob", "cid", "dan", "eve", "fay", "gus", "hal", "ida", "jim"]
    a = [f"user {w} logged in from the office network" for w in names]
    b = [f"user {w} logged out" for w in names[:5]]  # four tokens: too few to spare one
    c = [f"{w} is away until further notice today" for w in names[:3]]  # three values: too few
    got = [y for x in kept(spark, [f"{x}" for x in a + b + c]) for y in x]
    assert sum(y in a for y in got) == 1 and set(b + c) <= set(got)


def plain(texts, depth=3, similarity=0.7, children=4):
    """The lines that stay, by the rules of the module's docstring."""
    rows = []
    for d, text in enumerate(texts):
        for i, line in enumerate((text or "").split("\n") if text is not None else []):
            form = " ".join("<*>" if re.search("[0-9]", t) else t for t in re.split("[ \t\r\v\f]+", line.strip(" \t\r\v\f")))
            if form not in ("", "<*>"):
                rows.append((d, i, form))
    docs = {}
    for d, _, f in rows:
        docs.setdefault(f, set()).add(d)
    label = {f: f for f in docs}

    def link(a, b):
        a, b = label[a], label[b]
        if a != b:
            for f in label:
                label[f] = min(a, b) if label[f] in (a, b) else label[f]

    leaves, nodes = {}, {}
    for f in docs:
        t = f.split(" ")
        leaves.setdefault((len(t), *t[:depth]), []).append(f)
        if len(t) >= 5:
            for p in range(depth):
                nodes.setdefault((p, *t[:p], "", *t[p + 1 :]), []).append(f)
    for own in leaves.values():
        for x in own:
            for y in own:
                if sum(p != q for p, q in zip(x.split(" "), y.split(" "), strict=True)) <= int(len(x.split(" ")) * (1 - similarity) + 1e-9):
                    link(x, y)
    for own in nodes.values():
        if len(own) >= children:
            for x in own:
                link(own[0], x)
    where = {}
    for f, d in docs.items():
        where[label[f]] = where.get(label[f], set()) | d
    gone = {(d, i) for d, i, f in rows if len(where[label[f]]) > 1 and d != min(where[label[f]])}
    return [None if text is None else [x for i, x in enumerate(text.split("\n")) if (d, i) not in gone] for d, text in enumerate(texts)]


def test_the_tree_is_the_plain_one(spark):
    g = random.Random(11)
    words = ["the", "a", "server", "user", "disk", "7", "x9", "", "is", "up", "down", "in", "out"]
    texts = [None, "", "\n\n", "one line", "one line", "lone 5", "9\n9", "tab\tand  two\r\nspaces", "tab and two\nspaces ", "12 tab and two"]
    texts += ["\n".join(" ".join(g.choice(words) for _ in range(g.choice([1, 2, 4, 6, 9]))) for _ in range(g.randint(0, 6))) for _ in range(60)]
    texts += [f"{g.choice('pqrstuv')} {g.choice('ab')} has left {g.choice(['us', 'them'])} for {g.choice('xyz')} now" for _ in range(40)]
    rows = drop_recurring_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1).sortWithinPartitions("doc_id")).collect()
    got = [r.text for r in sorted(rows, key=lambda r: r.doc_id)]
    want = [x if x is None else "\n".join(x) for x in plain(texts)]
    assert got == want and sum(r.n_dropped for r in rows) > 30


def test_a_very_long_line_takes_time_in_proportion(spark):
    base = [f"t{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(20_000)]
    lines = [" ".join([*base[:-3], w, *base[-2:]]) for w in ("one", "two", "three")]
    began = time.perf_counter()
    got = [y for x in kept(spark, [*lines, "\n" * 50_000 + "x", "\n".join(["same"] * 50_000), "same"]) for y in x if y]
    assert got == [lines[0], "x", *["same"] * 50_000] and time.perf_counter() - began < 60
