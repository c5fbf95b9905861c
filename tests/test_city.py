"""Roads, places, loads and policies: golden values and plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from meridian.functions import geometry as g
from meridian.functions import text
from meridian.operators import allocate, graph, kernels, load, ordered, spatial, summary
from meridian.operators.rounds import Labels
from meridian.sources import roads


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_hourly_counts(spark):
    count = lambda minutes, n: [r.n for r in load.hourly_counts(table(spark, [(float(m),) for m in minutes], "m double"), "m", n).orderBy("hour").collect()]
    assert count([0, 59, 60, 125, 5000], 3) == [2, 1, 1]
    assert count([59.5, 179.5, 179.999, 180.0, -0.5], 3) == [1, 0, 2]


def test_road_classes(spark):
    names = ["motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "service", "trunk_link", "footway", None]
    rows = table(spark, [(n,) for n in names], "n string").select("n", roads.road_class(F.col("n")).alias("c")).select("n", "c", roads.class_speed(F.col("c")).alias("s"), roads.class_capacity(F.col("c")).alias("v")).collect()
    got = {r.n: (r.c, r.s, r.v) for r in rows}
    assert [got[n][0] for n in names] == [1, 2, 3, 4, 5, 6, 7, 8, 2, 7, 7]
    assert got["service"] == (8, 15.0, 300.0) and got[None] == got["residential"] == (7, 20.0, 600.0)


def test_contracted_roads(spark):
    rng = random.Random(4)
    place = {v: (80 + rng.random() / 100, 13 + rng.random() / 100) for v in range(30)}
    place[29] = place[28]
    ways = [[rng.randrange(30) for _ in range(rng.randint(1, 9))] for _ in range(14)] + [[3, 28, 29, 28, 4], [40, 41, 42, 40]]
    place |= {40: (80.5, 13.0), 41: (80.5, 13.1), 42: (80.6, 13.1)}
    uses = {v: sum(w.count(v) for w in ways) for v in place}
    junction = {v: uses[v] >= 2 or any(v in (w[0], w[-1]) for w in ways) for v in place}

    def metres(a, b):
        (x1, y1), (x2, y2) = place[a], place[b]
        r = math.radians
        h = math.sin(r(y2 - y1) / 2) ** 2 + math.cos(r(y1)) * math.cos(r(y2)) * math.sin(r(x2 - x1) / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(h))

    want = []
    for k, w in enumerate(ways):
        since, length = w[0], 0.0
        for a, b in zip(w, w[1:], strict=False):
            length += metres(a, b)
            if junction[b]:
                if since != b and length > 0:
                    want.append((k, since, b, round(length, 4)))
                since, length = b, 0.0
    rows = [(k, i, v, *place[v]) for k, w in enumerate(ways) for i, v in enumerate(w)]
    vertices = table(spark, rows, "way int, seq int, vertex int, lon double, lat double")
    got = [(r.way, r.src, r.dst, round(r.len, 4)) for r in roads.contract_roads(vertices).collect()]
    assert sorted(got) == sorted(want) and len(want) > 20
    assert {r.vertex: (r.uses, r.junction) for r in roads.junctions(vertices).collect()} == {v: (uses[v], junction[v]) for v in place if uses[v]}


def test_city(spark):
    calls = roads.incidents(spark, 1000)
    logs = roads.call_logs(calls).collect()
    again = [r for r in logs if r.is_duplicate]
    assert len({r.id for r in logs}) == len(logs) and 100 < len(again) < 200 and all(r.dup_of == r.incident_id for r in again)
    assert len({r.text.split()[1] for r in calls.collect()}) == 3
    first = {r.incident_id: r.text for r in logs if not r.is_duplicate}
    assert sum(r.text != first[r.incident_id] for r in again) > 50 and all(r.text.split()[0] == first[r.incident_id].split()[0] for r in again)
    assert all(1 <= r.units <= 4 for r in roads.stations(spark).collect()) and all(50 <= r.beds <= 500 for r in roads.hospitals(spark).collect())


def test_lines_sink(spark, tmp_path):
    roads.write_lines(table(spark, [("one",), ("two",), (None,)], "t string"), "t", f"file://{tmp_path}/out")
    assert sorted(r.value for r in spark.read.text(f"file://{tmp_path}/out").collect()) == ["", "one", "two"]


def test_extract_reaches_the_scan(spark, tmp_path):
    path = f"file://{tmp_path}/ways"
    table(spark, [("road", 80.0, 13.0, "a"), ("road", 81.0, 13.0, "b"), ("path", 80.0, 13.0, "c")], "highway string, lon double, lat double, name string").write.parquet(path)
    out = roads.extract(spark.read.parquet(path), ["name"], ["road", "street"], (79.0, 12.0, 80.0, 13.0))
    assert [r.name for r in out.collect()] == ["a"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "In(highway" in plan and "GreaterThanOrEqual(lon" in plan


@pytest.mark.parametrize("spread", [1.0, 1000.0])
def test_nearest_nodes(spark, spread):
    rng = random.Random(8)
    nodes = [(i, rng.gauss(0, spread), rng.gauss(0, 1.0)) for i in range(60)] + [(i, 500.0 + rng.random(), 1.0) for i in range(60, 90)]
    nodes += [(100, *nodes[5][1:]), (-1, None, 0.0)]
    points = [(i, rng.gauss(0, spread * 3), rng.gauss(0, 20)) for i in range(80)] + [(80, 9000.0, -7000.0), (81, None, 1.0), (82, *nodes[5][1:])]
    want = {i: min(((x - a) ** 2 + (y - b) ** 2, n) for n, a, b in nodes if a is not None)[1] for i, x, y in points if x is not None}
    shape = "id long, x double, y double"
    got = spatial.nearest_nodes(table(spark, points, shape), table(spark, nodes, shape)).collect()
    assert {r.id: r.node for r in got} == want and len(got) == len(want)
    assert spatial.nearest_nodes(table(spark, points, shape), table(spark, [], shape)).count() == 0
    one = spatial.nearest_nodes(table(spark, points, shape), table(spark, [(7, 1.0, 1.0)], shape)).collect()
    assert len(one) == len(want) and all(r.node == 7 for r in one)


def test_polygons(spark):
    corners = [("square", 1, 0.0, 0.0), ("square", 2, 2.0, 0.0), ("square", 3, 2.0, 2.0), ("square", 4, 0.0, 2.0), ("dot", 1, 1.0, 1.0)]
    points = [(1, 1.0, 1.0), (2, 2.0, 1.0), (3, 2.1, 1.0), (4, 0.0, 0.0), (5, -1.0, 1.0)]
    got = spatial.inside_polygons(table(spark, points, "id int, x double, y double"), table(spark, corners, "polygon string, rank int, x double, y double")).collect()
    assert {r.id for r in got if r.inside and r.polygon == "square"} == {1, 2, 4} and {r.id for r in got if r.inside and r.polygon == "dot"} == {1}
    rings = table(spark, [("square", 4.0), ("dot", 0.0)], "polygon string, area double").collect()
    area = spatial.polygon_area(table(spark, corners, "polygon string, rank int, x double, y double"), "polygon").collect()
    assert {tuple(r) for r in area} == {tuple(r) for r in rings}


def test_crossings(spark):
    rng = random.Random(6)
    segs = [(i, i % 5, *(round(rng.uniform(0, 9), 1) for _ in range(4))) for i in range(60)]
    segs += [(60, 0, 0.0, 0.0, 4.0, 0.0), (61, 1, 4.0, 0.0, 8.0, 0.0), (62, 2, 2.0, 0.0, 2.0, 3.0), (63, 3, 1.0, 1.0, 1.0, 1.0), (64, 4, 5.0, -900.0, 5.0, 900.0)]

    def turn(a, b, c):
        z = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
        return (z > 1e-12) - (z < -1e-12)

    def on(a, b, p):
        return min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])

    def meet(s, t):
        a, b, c, d = s[2:4], s[4:6], t[2:4], t[4:6]
        o = turn(a, b, c), turn(a, b, d), turn(c, d, a), turn(c, d, b)
        return (o[0] != o[1] and o[2] != o[3]) or (not o[0] and on(a, b, c)) or (not o[1] and on(a, b, d)) or (not o[2] and on(c, d, a)) or (not o[3] and on(c, d, b))

    want = {(s[0], t[0]) for s in segs for t in segs if s[0] < t[0] and s[1] != t[1] and meet(s, t)}
    rows = table(spark, segs, "id int, g int, x1 double, y1 double, x2 double, y2 double")
    for cell in (None, (0.7, 1.9), (50.0, 0.5)):
        got = spatial.crossings(rows, cell).collect()
        assert {(r.a, r.b) for r in got} == want and len(got) == len(want)
    at = {(r.a, r.b): (r.x, r.y) for r in got}
    assert at[(60, 61)] == (4.0, 0.0) and at[(60, 62)] == (2.0, 0.0)  # parallel ones meet at the end that both have


def test_dispatch(spark):
    edges = table(spark, [(0, 1, 5.0), (1, 2, 5.0), (2, 3, 5.0)], "src long, dst long, w double")
    units, incidents = table(spark, [(1, 0), (2, 0), (3, 3)], "id long, node long"), table(spark, [(1, 1), (2, 2), (3, 3)], "id long, node long")
    got = graph.dispatch_feasibility(edges, units, incidents, 10.0)
    rows = sorted(map(tuple, got.collect()))
    assert rows == [(1, 1, 5.0), (1, 2, 10.0), (2, 1, 5.0), (2, 2, 10.0), (3, 3, 0.0)]
    pairs = table(spark, [(1, 2), (2, 1), (3, 3), (3, 1)], "unit long, incident long")
    assert graph.mean_arrival(pairs, got).first()["mean"] == 5.0 and graph.mean_arrival(pairs.limit(0), got).first()["mean"] is None


def test_long_chains_and_studies(spark, monkeypatch):
    monkeypatch.setattr(Labels, "MERGE", 3)
    chain = table(spark, [(i, i + 1, 1.0) for i in range(25)] + [(7, 7, 0.0)], "src long, dst long, w double")
    known = graph.shortest_paths(chain, table(spark, [(0,), (10,)], "id long"))
    assert {r.node: (r.dist, r.origin) for r in known.collect()} == {i: (i - (10 if i >= 10 else 0), 10 if i >= 10 else 0) for i in range(26)}
    assert len({r.component for r in graph.strong_components(chain.unionByName(table(spark, [(9, 2, 1.0)], "src long, dst long, w double"))).collect()}) == 26 - 7
    far = {(r.a, r.b): r.dist for r in graph.metric_closure(table(spark, [(1, 2, 1.0), (2, 1, 3.0), (2, 3, 1.0)], "src long, dst long, w double")).collect()}
    assert len(far) == 9 and far[(1, 2)] == far[(2, 1)] == 2.0 and far[(1, 3)] == math.inf and far[(3, 3)] == 0.0
    ring = table(spark, [(1, 2, 1.0), (2, 1, 1.0), (5, 6, 1.0), (6, 7, 2.0), (7, 5, 3.0)], "src long, dst long, w double")
    nodes, dist = graph.study_instance(ring, [1, 5], 3)
    assert nodes.count() == 3 and dist.count() == 9 and {r.id for r in nodes.collect()} == {5, 6, 7}
    with pytest.raises(ValueError):
        graph.study_instance(ring, [1], 3)
    two = table(spark, [(1,), (2,)], "id long")
    assert graph.edges_connected(ring.where("src < 3"), two) and not graph.edges_connected(ring, table(spark, [(i,) for i in (1, 2, 5, 6, 7)], "id long"))
    assert not graph.edges_connected(ring.where("src < 3"), two.union(table(spark, [(3,)], "id long")))


def test_weakest_cuts(spark):
    clique = lambda k, first: [(i, j) for i in range(first, first + k) for j in range(i + 1, first + k)]
    links = {1: [*clique(6, 0), *clique(6, 6), (0, 6), (1, 7)], 2: [(0, 1), (1, 2), (2, 3), (3, 4)], 3: [(0, 1), (2, 3)], 4: [(0, 1), (0, 1), (0, 1)]}
    rows = table(spark, [(k, u, v) for k, own in links.items() for u, v in own], "instance int, u int, v int")
    sizes = table(spark, [(1, 12), (2, 5), (3, 4), (4, 2)], "instance int, n int")
    got = {r.instance: r for r in graph.weakest_cuts(rows, sizes, 1e-6).collect()}
    assert {k: r.cut for k, r in got.items()} == {1: 2, 2: 1, 3: 0, 4: 3}
    assert got[1].side == list(range(6)) and got[1].trials == math.ceil(math.log(1e6) / (2 / (12 * 11))) and 0 in got[2].side


def test_covers(spark):
    dist = table(spark, [(a, b, float(abs(a - b))) for a in range(1, 4) for b in range(1, 4)], "a int, b int, dist double")
    sets = summary.coverage_sets(dist, 1.0)
    assert {s: {r.place for r in sets.collect() if r.station == s} for s in (1, 2, 3)} == {1: {1, 2}, 2: {1, 2, 3}, 3: {2, 3}}
    chosen = table(spark, [("x", 1), ("x", 3), ("y", 1)], "plan string, station int")
    assert {r.plan: r.covered for r in summary.covered(sets, chosen, "plan").collect()} == {"x": 3, "y": 2}
    links = table(spark, [(1, 2), (2, 3), (3, 3)], "u int, v int")
    assert {r.plan: r.watched for r in summary.watched(links, chosen.withColumnRenamed("station", "node"), "plan").collect()} == {"x": 3, "y": 1}
    items = table(spark, [(1, 2.0), (1, 3.0), (2, 5.0)], "k int, v double")
    assert summary.sum_over(items, table(spark, [(1,), (1,)], "k int"), "k", "v").first()["total"] == 5.0
    assert summary.sum_over(items, table(spark, [], "k int"), "k", "v").first()["total"] == 0.0
    assert {r.k: r.median for r in summary.medians(items, "k", "v").collect()} == {1: 2.5, 2: 5.0}
    assert summary.expand_units(table(spark, [(1, 3, 5.0), (2, 0, 1.0), (3, 2, 9.0)], "id int, units int, time double"), "units", "time", 5.0).count() == 3


def test_policies():
    sets, everything = {1: {1, 2, 3, 4}, 2: {1, 2, 5}, 3: {3, 4, 6}, 4: {5, 6}}, set(range(1, 7))
    assert kernels.place_stations(sets, everything) == {"chosen": [1, 4], "size": 2, "method": "exact"}
    assert kernels.place_stations(sets, everything, max_nodes=0)["method"] == "approximate"
    assert kernels.place_sensors([(0, i) for i in range(1, 7)]) == {"chosen": [0], "size": 1, "method": "exact"}
    assert kernels.place_sensors([(0, i) for i in range(1, 7)], max_nodes=0) == {"chosen": [0, 1], "size": 2, "method": "approximate"}
    rng = random.Random(3)
    at = [(rng.random(), rng.random()) for _ in range(7)]
    d = [[math.dist(a, b) for b in at] for a in at]
    exact, loose = kernels.plan_tour(d), kernels.plan_tour(d, max_nodes=1)
    assert exact["method"] == "exact" and loose["method"] == "approximate" and exact["cost"] <= loose["cost"] <= 2 * exact["cost"] and sorted(exact["order"]) == list(range(7))
    low = kernels.set_cover_greedy(sets, everything)[0]
    assert low[0] == 1 and set().union(*(sets[i] for i in low)) == everything


def test_branch_and_bound_reports_its_frontier():
    step = lambda x: [(*x, b) for b in (0, 1)]
    run = lambda **o: kernels.branch_and_bound((), step, sum, lambda x: len(x) == 4, lambda x: sum(x) + 1, **o)
    for strategy in ("lifo", "fifo", "lc"):
        out = run(strategy=strategy)
        assert out["cost"] == 1 and out["leaf"] == (0, 0, 0, 0) and out["complete"] and out["max_frontier"] >= 2
    assert not run(max_nodes=2)["complete"]
    with pytest.raises(OverflowError):
        run(strategy="fifo", frontier_cap=3)
    with pytest.raises(ValueError):
        run(strategy="best")


def test_fractional_knapsack(spark):
    def solve(values, weights, capacity):
        items = table(spark, [(i, float(v), float(w)) for i, (v, w) in enumerate(zip(values, weights, strict=True))], "id int, v double, w double")
        return [(r.id, r.fraction) for r in allocate.fractional_knapsack(items, "id", "v", "w", capacity).orderBy("id").collect()]

    got = solve((60, 100, 120), (10, 20, 30), 50)
    assert [f for _, f in got] == pytest.approx([1, 1, 2 / 3])
    assert solve((5, 7), (0, 2), 1) == [(1, 0.5)]
    rng = random.Random(1)
    for _ in range(4):
        v, w = [rng.uniform(0, 9) for _ in range(6)], [rng.choice([0, 1, 2, 3.5]) for _ in range(6)]
        assert sum(v[i] * f for i, f in solve(v, w, 5.0)) == pytest.approx(kernels.fractional_brute(v, w, 5.0))


@pytest.mark.parametrize("kind", ["random", "sorted", "reversed", "organ", "fewuniq"])
def test_ranks_and_running_sums(spark, kind):
    keys = kernels.sort_input(257, kind)
    assert len(keys) == 257 and kernels.sort_input(1, kind)
    rows = table(spark, [(i, k if i % 50 else None) for i, k in enumerate(keys)], "id int, k double").repartition(5)
    order = sorted(range(257), key=lambda i: (i % 50 == 0 and -math.inf or keys[i], i))
    got = {r.id: r.rank for r in ordered.sort_ranks(rows, "k", "id").collect()}
    assert got == {i: n + 1 for n, i in enumerate(order)}
    down = sorted(range(257), key=lambda i: (i % 50 == 0, 0 if i % 50 == 0 else -keys[i], i))
    before = {r.id: r.s for r in ordered.running_sum(rows, ["k", "id"], "id", "s", descending=True).collect()}
    assert before == {i: sum(down[:n]) for n, i in enumerate(down)}
    assert ordered.sort_ranks(rows.limit(0), "k", "id").count() == 0


def test_urgent_and_texts(spark):
    rows = table(spark, [(i + 1, s, d, 60.0 * i) for i, (s, d) in enumerate(zip((1, 5, 3, 5, 2), (1, 2, 9, 7, 3), strict=True))], "id int, sev int, dem int, minute double")
    assert [r.id for r in allocate.urgent_first(rows, "id", "sev", "dem", 2).collect()] == [4, 2]
    assert [r.id for r in allocate.urgent_in_window(rows, "id", "minute", 0, 180, "sev", "dem", 9).collect()] == [2, 3, 1]
    t = table(spark, [("ababaca",), ("aaaa",), ("",), (None,)], "p string")
    assert [r.b for r in t.select(text.pattern_borders("p").alias("b")).collect()] == [[0, 0, 1, 2, 3, 0, 1], [0, 1, 2, 3], [], None]
    assert [text.search("aaaaa", "aa")[0], text.search("abababab", "abab")[0], text.search("ab", ""), text.search("a", "ab")] == [[1, 2, 3, 4], [1, 3, 5], ([], 0), ([], 0)]
    assert all(text.search(x, "abab")[1] <= 2 * len(x) for x in ("abababab", "abaabaabaab", "bbbbb"))
    found = table(spark, [("xabab abab",), (None,)], "t string").select(text.search_effort("abab")("t").alias("f")).select("f.*").collect()
    assert found[0].starts == [2, 7] and found[0].compared >= 10 and found[1].starts is None
    both = table(spark, [(list("ABCBDAB"), list("BDCABA")), (list("12345"), list("345678")), ([], ["x"])], "a array<string>, b array<string>")
    assert ["".join(r.c) for r in both.select(text.lcs("a", "b").alias("c")).collect()] == ["BCBA", "345", ""]
    points = table(spark, [("aé漢😀",), ("",)], "t string").select(text.code_points(F.col("t")).alias("p")).collect()
    assert [r.p for r in points] == [[97, 233, 28450, 128512], []]
    said = table(spark, [(20.0, 1), (90.0, 1200), (150.0, 0), (60.0, 2)], "s double, n int").select(text.about_minutes(F.col("s")).alias("m"), text.count_noun(F.col("n"), "unit").alias("u")).collect()
    assert [tuple(r) for r in said] == [("less than a minute", "1 unit"), ("about 2 minutes", "1,200 units"), ("about 2 minutes", "0 units"), ("about 1 minute", "2 units")]
    cut = table(spark, [("x" * 50 + "KEY" + "y" * 50, 51), ("KEYend", 1)], "t string, at int").select(text.snippet(F.col("t"), F.col("at"), 3).alias("s")).collect()
    assert [r.s for r in cut] == ["x" * 35 + "KEY" + "y" * 35, "KEYend"]


def test_geometry_of_columns(spark):
    one = spark.range(1)
    lit = lambda *v: [F.lit(float(x)) for x in v]
    row = one.select(
        g.point_segment_distance(*lit(3, 4, 0, 0, 0, 0)).alias("dot"), g.point_segment_distance(*lit(5, 1, 0, 0, 4, 0)).alias("past"),
        g.segments_parallel(lit(0, 0, 2, 2), lit(1, 0, 3, 2)).alias("parallel"), g.harmonic(F.lit(3)).alias("h"), g.harmonic(F.lit(0)).alias("none"),
        g.min_cut_success(F.lit(10), F.lit(1)).alias("p"), g.min_cut_trials(F.lit(2), 0.5).alias("t"), g.haversine(*lit(0, 0, 90, 0)).alias("quarter"),
    ).first()
    assert row.dot == 5.0 and row.past == pytest.approx(math.sqrt(2)) and row.parallel and row.h == pytest.approx(11 / 6) and row.none == 0.0
    assert row.p == pytest.approx(2 / 90) and row.t == math.ceil(math.log(2)) and row.quarter == pytest.approx(math.pi * 6371000 / 2)
