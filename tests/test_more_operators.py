"""Operators that SQL can't express, against plain versions."""

import random

from meridian.functions.text import common_length
from meridian.operators import graph, reports, summary
from meridian.sources import roads


def _reports(n=60, seed=3):
    rng = random.Random(seed)
    words = "fire flood near bridge road people need help tower north south".split()
    out = []
    for i in range(n):
        base = rng.choice(out)[1].split() if out and rng.random() < 0.6 else ["inc1"] + [rng.choice(words) for _ in range(rng.randint(0, 9))]
        if rng.random() < 0.5 and len(base) > 1:
            base = list(base)
            base[rng.randrange(len(base))] = rng.choice(words)
        out.append((i, " ".join(base)))
    return [*out, (n, ""), (n + 1, None)]


def _tokens(t):
    return [w for w in (t or "").split() if not w.startswith("inc")]


def test_dedupe_reports(spark):
    rows = _reports()
    toks, want = [_tokens(t) for _, t in rows], {}
    for j, b in enumerate(toks):
        want[j] = next((i for i in range(j) if want[i] is None and toks[i] and b and common_length(toks[i], b) / max(len(toks[i]), len(b)) >= 0.75), None)
    got = reports.dedupe_reports(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    assert {r["id"]: r["dup_of"] for r in got.collect()} == want


def test_best_matches(spark):
    rows = _reports()
    toks, want = [_tokens(t) for _, t in rows], {}
    for j, b in enumerate(toks):
        best, sim = None, 0.0
        for i in range(j):
            a = toks[i]
            if a and b and min(len(a), len(b)) / max(len(a), len(b)) >= 0.5 and (s := common_length(a, b) / max(len(a), len(b))) > sim:
                best, sim = i, s
        want[j] = (best, round(sim, 9))
    got = reports.best_matches(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    assert {r["id"]: (r["best"], round(r["similarity"], 9)) for r in got.collect()} == want


def test_bfs_and_path(spark):
    rng = random.Random(5)
    pairs = sorted({(rng.randrange(30), rng.randrange(30)) for _ in range(70)})
    e = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, w double")
    order, k = [0], 12
    for u in order:
        for a, b in pairs:
            if a == u and b not in order and len(order) < k:
                order.append(b)
    nodes, inner = graph.bfs_subgraph(e, 0, k)
    assert [r["id"] for r in nodes.orderBy("rank").collect()] == order
    at = {v: i + 1 for i, v in enumerate(order)}
    assert sorted((r["src"], r["dst"]) for r in inner.collect()) == sorted((at[a], at[b]) for a, b in pairs if a in at and b in at)
    known = graph.shortest_paths(e, spark.createDataFrame([(0,)], "id long"))
    dist = {r["node"]: r["dist"] for r in known.collect()}
    far = max(dist, key=lambda v: (dist[v], v))
    targets = spark.createDataFrame([(v,) for v in [*dist, 999]], "id long")
    paths = {r["target"]: r["path"] for r in graph.paths_to(known, targets).collect()}
    assert paths[999] == [] and len(paths) == len(dist) + 1 and len(paths[far]) > 3
    for v in dist:
        assert paths[v][0] == 0 and paths[v][-1] == v and len(paths[v]) == dist[v] + 1
        assert all(p in pairs for p in zip(paths[v], paths[v][1:], strict=False))
    # neighbours in the order of their edges
    ranked = e.selectExpr("*", "-dst as eid")
    order = [0]
    for u in order:
        for a, b in sorted(pairs, key=lambda p: -p[1]):
            if a == u and b not in order and len(order) < k:
                order.append(b)
    assert [r["id"] for r in graph.bfs_subgraph(ranked, 0, k)[0].orderBy("rank").collect()] == order


def test_cycles_roads_and_spots(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 5), (6, 4), (4, 6)], "src long, dst long")
    assert dict(map(tuple, graph.strong_components(e).collect())) == {1: 1, 2: 1, 3: 1, 4: 4, 6: 4, 5: 5}
    stops = spark.createDataFrame([(1, 1, 10), (1, 2, 20), (1, 3, 30)], "tour int, place int, id long")
    dist = spark.createDataFrame([(10, 20, 1.0), (20, 30, 2.0), (30, 10, 4.0)], "a long, b long, dist double")
    assert summary.cycle_cost(stops, dist, "tour").first()["cost"] == 7.0
    ways = spark.createDataFrame([(1, 2, "-1", "roundabout"), (3, 4, "yes", None), (5, 6, None, None)], "src int, dst int, oneway string, junction string")
    assert sorted((r["src"], r["dst"]) for r in roads.directed(ways).collect()) == [(2, 1), (3, 4), (5, 6), (6, 5)]
    grid = roads.grid_roads(spark, 5).collect()
    assert len(grid) == 80 and all(80 <= r.w < 400 and 3 <= r.hw <= 7 for r in grid)
    assert all(abs(r.seconds - r.w / (roads.ROAD_CLASSES[r.hw - 1][2] / 3.6)) < 1e-9 and r.cap == roads.ROAD_CLASSES[r.hw - 1][3] for r in grid)
    assert {(r.src, r.dst, r.w) for r in grid} == {(r.dst, r.src, r.w) for r in grid}
    assert summary.spaced_top([(5, 1, 0, 0), (4, 2, 1, 0), (3, 3, 9, 0)], 2, 4.0) == [(5, 1, 0, 0), (3, 3, 9, 0)]
    calls = roads.incidents(spark, 2000)
    low, high = calls.agg({"minute": "min"}).first()[0], calls.agg({"minute": "max"}).first()[0]
    assert 0 <= low and high < 14400
    assert calls.where("minute >= 11520").count() > 600


def test_csv_gains_columns(spark, tmp_path):
    path = f"file://{tmp_path}/bench"
    roads.append_csv(spark.createDataFrame([(1, "a")], "n int, name string"), path)
    roads.append_csv(spark.createDataFrame([(2,)], "n int"), path)
    roads.append_csv(spark.createDataFrame([(3, 0.5)], "n int, sec double"), path)
    out = spark.read.option("header", True).csv(path).orderBy("n")
    assert [tuple(r) for r in out.select("n", "name", "sec").collect()] == [("1", "a", None), ("2", None, None), ("3", None, "0.5")]
