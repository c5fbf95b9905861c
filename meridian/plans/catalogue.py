"""Named queries over the star schema, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text
from ..operators import allocate, discs, graph, kernels, load, ordered, reports, spatial, summary
from ..operators.rounds import Rounds
from ..sources import roads
from ..sources.tables import table
from ..streaming import load as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL where SQL can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


HOURLY = """
WITH s AS (SELECT date_trunc('hour', ts) AS h, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1),
hours AS (SELECT unnest(range(min(h), max(h) + INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS hour FROM s),
load AS (SELECT hours.hour, coalesce(n, 0)::BIGINT AS n FROM hours LEFT JOIN s ON s.h = hours.hour)
"""


@query(HOURLY + "SELECT hour, n FROM load")
def hourly_load(spark, d):
    return load.load_by_hour(table(spark, d, "events"), "ts")


@query("""WITH e AS (SELECT date_diff('second', TIMESTAMP '2024-01-01', ts) / 60.0::DOUBLE AS m FROM events WHERE ts IS NOT NULL)
SELECT h AS hour, count(m) AS n FROM range(1, 721) s(h) LEFT JOIN e ON m >= 0 AND m < 43200 AND floor(m / 60) + 1 = h GROUP BY h""")
def hourly_counts(spark, d):
    """Events by hour of January 2024's first 30 days, from minutes with their fractions."""
    return load.hourly_counts(table(spark, d, "events").select((F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01', ts)") / F.lit(60.0)).alias("minute")), "minute", 720)


@query(HOURLY + "SELECT quantile_cont(n, 0.65)::DOUBLE AS capacity FROM load")
def load_capacity(spark, d):
    return hourly_load(spark, d).agg(F.expr("percentile(n, 0.65)").alias("capacity"))


@query(HOURLY + """, c AS (SELECT quantile_cont(n, 0.65) AS cap FROM load),
p AS (SELECT hour, sum(n - cap) OVER (ORDER BY hour) AS p FROM load, c),
q AS (SELECT hour, p, coalesce(lag(p) OVER (ORDER BY hour), 0) AS q FROM p)
SELECT round(max(p - low), 6)::DOUBLE AS excess FROM (SELECT p, min(q) OVER (ORDER BY hour) AS low FROM q)""")
def worst_load_window(spark, d):
    hours = Rounds(spark).keep(hourly_load(spark, d))  # a row an hour, read for its quantile and for its sums
    capacity = hours.agg(F.expr("percentile(n, 0.65)").alias("capacity"))
    return load.max_subarray(hours.crossJoin(F.broadcast(capacity)), "hour", F.col("n") - F.col("capacity")).select(F.round("best", 6).alias("excess"))


# --- allocation and ranking ---------------------------------------------------------------------------------------


@query("""WITH b AS (SELECT min(p_size) x0, max(p_size) x1, min(p_retailprice) y0, max(p_retailprice) y1 FROM part)
SELECT ((least(3, 1 + floor(3 * (p_retailprice - y0) / (y1 - y0 + 1e-9))) - 1) * 3 + least(3, 1 + floor(3 * (p_size - x0) / (x1 - x0 + 1e-9))))::BIGINT AS zone,
count(*) AS parts, sum(p_size)::BIGINT AS demand, sum(p_size * (p_partkey % 5 + 1))::BIGINT AS urgency FROM part, b WHERE p_size > 0 GROUP BY 1""")
def zone_demand(spark, d):
    part = table(spark, d, "part")
    b = part.agg(F.min("p_size").alias("x0"), F.max("p_size").alias("x1"), F.min("p_retailprice").alias("y0"), F.max("p_retailprice").alias("y1"))
    zone = g.grid_zone(F.col("p_size"), F.col("p_retailprice"), F.col("x0"), F.col("x1"), F.col("y0"), F.col("y1")).cast("long")
    open_ = part.where("p_size > 0").crossJoin(F.broadcast(b))
    return open_.groupBy(zone.alias("zone")).agg(F.count("*").alias("parts"), F.sum("p_size").alias("demand"), F.sum(F.col("p_size") * (F.col("p_partkey") % 5 + 1)).alias("urgency"))


@query("""WITH c AS (SELECT 0.4::DOUBLE * sum(p_size) AS cap FROM part),
r AS (SELECT p_retailprice v, p_size w, coalesce(sum(p_size) OVER (ORDER BY p_retailprice / p_size DESC, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM part WHERE p_size > 0)
SELECT round(sum(v * least(1, greatest(0, (cap - before) / w))), 2) AS total FROM r, c""")
def fractional_supply(spark, d):
    part = table(spark, d, "part")
    room = F.broadcast(part.agg((F.sum("p_size") * F.lit(0.4)).alias("room")))
    filled = allocate.fractional_knapsack(part.crossJoin(room), "p_partkey", "p_retailprice", "p_size", F.col("room"))
    return filled.agg(F.round(F.sum(F.col("p_retailprice") * F.col("fraction")), 2).alias("total"))


@query("""WITH n AS (SELECT p_partkey // 10 AS instance, p_partkey % 10 AS i, p_size AS w, floor(p_retailprice / 10)::INT AS v FROM part), m AS (SELECT range AS m FROM range(0, 1024)),
x AS (SELECT instance, m, coalesce(sum(w) FILTER ((m >> i) & 1 = 1), 0) AS sw, coalesce(sum(v) FILTER ((m >> i) & 1 = 1), 0) AS sv FROM n, m GROUP BY ALL)
SELECT instance, max(sv)::DOUBLE AS value FROM x WHERE sw <= 100 GROUP BY instance""")
def upgrade_knapsack(spark, d):
    """Every ten neighbouring parts are an instance."""
    items = table(spark, d, "part").select(F.expr("p_partkey div 10").alias("instance"), F.col("p_partkey").alias("id"), F.col("p_size").alias("w"), F.floor(F.col("p_retailprice") / 10).cast("int").alias("v"))

    def kernel(pdf):
        pdf = pdf.sort_values("id")
        return {"value": kernels.knapsack01(pdf["w"].tolist(), pdf["v"].tolist(), 100)[0]}

    return kernels.solve(items, "instance", kernel, "value double")


@query("""SELECT event_id, value * 1000 + user_id AS urgency FROM events WHERE date_diff('second', TIMESTAMP '2024-01-01', ts) / 60.0 >= 8 * 1440 AND date_diff('second', TIMESTAMP '2024-01-01', ts) / 60.0 < 10 * 1440
ORDER BY urgency DESC, event_id LIMIT 25""")
def storm_batch(spark, d):
    """The 25 most urgent events of two days."""
    rows = table(spark, d, "events").withColumn("minute", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01', ts)") / F.lit(60.0))
    return allocate.urgent_in_window(rows, "event_id", "minute", 8 * 1440, 10 * 1440, "value", "user_id", 25).select("event_id", "urgency")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS rank FROM part")
def price_rank(spark, d):
    return ordered.sort_ranks(table(spark, d, "part"), "p_retailprice", "p_partkey").select("p_partkey", "rank")


@query("SELECT coalesce(round(sum(l_extendedprice), 2), 0)::DOUBLE AS total FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 10)")
def value_of_chosen(spark, d):
    chosen = table(spark, d, "part").where("p_size <= 10").select(F.col("p_partkey").alias("l_partkey"))
    return summary.sum_over(table(spark, d, "lineitem"), chosen, "l_partkey", "l_extendedprice").select(F.round("total", 2).alias("total"))


@query("SELECT l_quantity, median(l_extendedprice)::DOUBLE AS median FROM lineitem GROUP BY l_quantity")
def price_medians(spark, d):
    return summary.medians(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * 1000 + l_linenumber AS urgency FROM lineitem ORDER BY urgency DESC, l_orderkey, l_partkey, l_suppkey, l_extendedprice LIMIT 25")
def urgent_topk(spark, d):
    li = table(spark, d, "lineitem").withColumn("key", F.struct("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice"))
    return allocate.urgent_first(li, "key", "l_quantity", "l_linenumber", 25).select("l_orderkey", "l_linenumber", "l_partkey", "urgency")


# --- text ----------------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, len(list_filter(range(1, greatest(1, length(text) - 1)), lambda i: substr(text, i, 3) = 'the'))::INT AS hits
FROM documents WHERE text IS NOT NULL""")
def keyword_hits(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", text.overlapping_count(F.col("text"), "the").alias("hits"))


@query("""SELECT item_id, unnest(list_filter(range(1, greatest(1, length(text) - 1)), lambda i: substr(text, i, 3) = 'tht'))::INT AS start FROM benchmark WHERE text IS NOT NULL""")
def keyword_positions(spark, d):
    return table(spark, d, "benchmark").where("text is not null").select("item_id", F.explode(text.overlapping_positions("tht")("text")).alias("start"))


@query("""SELECT doc_id, len(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda t: t <> '' AND NOT regexp_full_match(t, 'inc[0-9]+')))::INT AS tokens FROM documents WHERE text IS NOT NULL""")
def report_tokens(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(text.strip_report_ids(text.report_tokens(F.col("text")))).alias("tokens"))


_COMMON = """list_reduce({a}, lambda prev, x: list_reduce(range(1, len({b}) + 1), lambda acc, j: list_append(acc, CASE WHEN x = {b}[j] THEN prev[j] + 1 ELSE greatest(prev[j + 1], acc[j]) END), [0::BIGINT]),
list_transform(range(0, len({b}) + 1), lambda k: 0::BIGINT))[len({b}) + 1]"""
_TOKENS = "list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda t: t <> '')"
_SIM = "CASE WHEN greatest(len({a}), len({b})) = 0 THEN 1.0 ELSE (" + _COMMON + ")::DOUBLE / greatest(len({a}), len({b})) END"


@query(f"""WITH c AS (SELECT conv_id, turn, {_TOKENS} AS ta, lead({_TOKENS}) OVER (PARTITION BY conv_id ORDER BY turn, role) AS tb FROM conversations)
SELECT conv_id, turn, round({_SIM.format(a='ta', b='tb')}, 6)::DOUBLE AS similarity FROM c WHERE ta IS NOT NULL AND tb IS NOT NULL""")
def lcs_similarity(spark, d):
    """Every turn against the next one of its conversation."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", text.report_tokens(F.col("text")).alias("ta"))
    pairs = turns.withColumn("tb", F.lead("ta").over(Window.partitionBy("conv_id").orderBy("turn", "role"))).where("ta is not null and tb is not null")
    return pairs.select("conv_id", "turn", F.round(text.similarity(F.col("ta"), F.col("tb")), 6).alias("similarity"))


@query("""WITH p AS (SELECT item_id, text, unnest(list_filter(range(1, greatest(1, length(text) - 1)), lambda i: substr(text, i, 3) = 'tht'))::INT AS start FROM benchmark WHERE text IS NOT NULL)
SELECT item_id, start, substr(text, greatest(1, start - 35), start + 38 - greatest(1, start - 35)) AS snippet FROM p""")
def snippets(spark, d):
    found = table(spark, d, "benchmark").where("text is not null").select("item_id", "text", F.explode(text.overlapping_positions("tht")("text")).alias("start"))
    return found.select("item_id", "start", text.snippet(F.col("text"), F.col("start"), 3).alias("snippet"))


@query("SELECT doc_id, length(text)::INT AS n, coalesce(list_sum(list_transform(string_split(text, ''), lambda c: unicode(c))), 0)::BIGINT AS total FROM documents WHERE text IS NOT NULL AND text <> ''")
def code_points(spark, d):
    points = text.code_points(F.col("text"))
    rows = table(spark, d, "documents").where("text is not null and text <> ''").select("doc_id", points.alias("p"))
    return rows.select("doc_id", F.size("p").alias("n"), F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("""SELECT p_partkey, i::INT AS at, coalesce(list_max(list_filter(range(1, i), lambda k: left(p_name, k::INT) = substr(p_name, (i - k + 1)::INT, k::INT))), 0)::INT AS border
FROM (SELECT p_partkey, p_name, unnest(range(1, length(p_name) + 1)) AS i FROM part)""")
def name_borders(spark, d):
    return table(spark, d, "part").select("p_partkey", F.posexplode(text.pattern_borders("p_name")).alias("at", "border")).select("p_partkey", (F.col("at") + 1).alias("at"), "border")


@query("""WITH m AS (SELECT p_partkey, round_even(p_retailprice / 60, 0)::BIGINT AS m, p_size AS n FROM part)
SELECT p_partkey, CASE WHEN m < 1 THEN 'less than a minute' ELSE 'about ' || format('{:,}', m) || CASE WHEN m = 1 THEN ' minute' ELSE ' minutes' END END AS eta,
format('{:,}', n * 100::BIGINT) || CASE WHEN n * 100 = 1 THEN ' unit' ELSE ' units' END AS units FROM m""")
def plain_words(spark, d):
    return table(spark, d, "part").select("p_partkey", text.about_minutes(F.col("p_retailprice")).alias("eta"), text.count_noun(F.col("p_size") * 100, "unit").alias("units"))


# --- graph -----------------------------------------------------------------------------------------------------------

_ADJ = """
WITH l AS (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS dst, l_quantity FROM lineitem),
e AS (SELECT src, dst, min(l_quantity) AS w FROM l WHERE dst IS NOT NULL AND src <> dst GROUP BY ALL)
"""


def part_edges(spark, d):
    """Consecutive parts of an order, with the least quantity as weight."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"), "l_quantity")
    return rows.where("dst is not null and src <> dst").groupBy("src", "dst").agg(F.min("l_quantity").alias("w"))


@query(_ADJ + "SELECT src, count(*) AS degree FROM e GROUP BY src")
def out_degree(spark, d):
    return graph.out_degree(part_edges(spark, d))


@query(_ADJ + """, g AS (SELECT p_partkey AS id, count(src) AS degree FROM part LEFT JOIN e ON src = p_partkey GROUP BY 1)
SELECT id, degree, coalesce(sum(degree) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM g""")
def edge_offsets(spark, d):
    return graph.edge_offsets(part_edges(spark, d), table(spark, d, "part").select(F.col("p_partkey").alias("id")))


@query(_ADJ + "SELECT e.src, e.dst, a.p_size::DOUBLE AS x1, a.p_retailprice AS y1, b.p_size::DOUBLE AS x2, b.p_retailprice AS y2 FROM e JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst")
def edge_lines(spark, d):
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return graph.edge_lines(part_edges(spark, d), nodes).drop("w")


@query(_ADJ + "SELECT dst AS src, src AS dst, w FROM e")
def reversed_edges(spark, d):
    return graph.reverse(part_edges(spark, d)).select("src", "dst", "w")


@query(_ADJ + "SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM e")
def undirected_links(spark, d):
    return graph.undirected(part_edges(spark, d))


@query(_ADJ + "SELECT src, dst, w FROM e WHERE src IN (SELECT p_partkey FROM part WHERE p_size <= 10) AND dst IN (SELECT p_partkey FROM part WHERE p_size <= 10)")
def induced_subgraph(spark, d):
    return graph.induced(part_edges(spark, d), table(spark, d, "part").where("p_size <= 10").select(F.col("p_partkey").alias("id"))).select("src", "dst", "w")


def _sssp(limit: str = "") -> str:
    return _ADJ.replace("WITH l", "WITH RECURSIVE l").rstrip() + f""", r(v, c) USING KEY (v) AS (SELECT DISTINCT src, 0::DOUBLE FROM e WHERE src = (SELECT min(src) FROM e)
UNION SELECT e.dst, min(r.c + e.w) FROM r JOIN e ON e.src = r.v LEFT JOIN recurring.r o ON o.v = e.dst WHERE (o.c IS NULL OR r.c + e.w < o.c) {limit} GROUP BY e.dst)
SELECT v AS node, c AS dist FROM r"""


@query(_sssp())
def nearest_facility(spark, d):
    e = part_edges(spark, d)
    return graph.shortest_paths(e, e.agg(F.min("src").alias("id"))).select("node", "dist")


@query(_sssp("AND r.c + e.w <= 5"))
def reachable_within(spark, d):
    e = part_edges(spark, d)
    return graph.shortest_paths(e, e.agg(F.min("src").alias("id")), limit=5.0).select("node", "dist")


@query(_ADJ.replace("WITH l", "WITH RECURSIVE l").rstrip() + """, s AS (SELECT src, dst FROM e WHERE w <= 2 UNION SELECT dst, src FROM e WHERE w <= 2),
r(v, c) USING KEY (v) AS (SELECT DISTINCT src, src FROM s UNION SELECT s.dst, min(r.c) FROM r JOIN s ON s.src = r.v LEFT JOIN recurring.r o ON o.v = s.dst WHERE r.c < o.c GROUP BY s.dst)
SELECT v AS node, c AS component FROM r""")
def connected_parts(spark, d):
    return graph.components(part_edges(spark, d).where("w <= 2"))


@query(_ADJ + "SELECT count(*) = 0 AS connected FROM part WHERE p_partkey NOT IN (SELECT src FROM e UNION SELECT dst FROM e)")
def parts_connected(spark, d):
    """The SQL asks for parts without an edge only, which is what tells here."""
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    return spark.range(1).select(F.lit(graph.edges_connected(part_edges(spark, d), nodes)).alias("connected"))


_DISPATCH = _ADJ.replace("WITH l", "WITH RECURSIVE l").rstrip() + """, unit AS (SELECT l_suppkey AS unit, min(l_partkey) AS node FROM lineitem GROUP BY 1), incident AS (SELECT l_orderkey AS incident, min(l_partkey) AS node FROM lineitem GROUP BY 1),
r(s, v, c) USING KEY (s, v) AS (SELECT DISTINCT node, node, 0::DOUBLE FROM unit UNION SELECT r.s, e.dst, min(r.c + e.w) FROM r JOIN e ON e.src = r.v
LEFT JOIN recurring.r o ON o.s = r.s AND o.v = e.dst WHERE r.c + e.w <= 4 AND (o.c IS NULL OR r.c + e.w < o.c) GROUP BY r.s, e.dst),
f AS (SELECT unit, incident, c AS time FROM r JOIN unit ON unit.node = r.s JOIN incident ON incident.node = r.v) """


def _feasible(spark, d):
    li = table(spark, d, "lineitem")
    at = lambda key: li.groupBy(F.col(key).alias("id")).agg(F.min("l_partkey").alias("node"))
    return graph.dispatch_feasibility(part_edges(spark, d), at("l_suppkey"), at("l_orderkey"), 4.0)


@query(_DISPATCH + "SELECT unit, incident, time FROM f")
def dispatch_feasibility(spark, d):
    return _feasible(spark, d)


@query(_DISPATCH + "SELECT round(avg(t), 6) AS mean FROM (SELECT min(time) AS t FROM f GROUP BY incident)")
def mean_arrival(spark, d):
    """Each incident's nearest unit goes to it."""
    times = Rounds(spark).keep(_feasible(spark, d))
    pairs = times.groupBy("incident").agg(F.min_by("unit", F.struct("time", "unit")).alias("unit"))
    return graph.mean_arrival(pairs, times).select(F.round("mean", 6).alias("mean"))


# --- solvers -----------------------------------------------------------------------------------------------------------
# Trade between nations, in instances of two regions (five nations each), so that all of it is solved and SQL can still
# look at every subset of an instance.

_TRADE = """
WITH trade AS (SELECT c_nationkey a, s_nationkey b, sum(l_quantity) AS cap FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL)
"""
_PLACED = """, place AS (SELECT n_nationkey AS k, n_regionkey AS r, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation),
t AS (SELECT x.r * 100 + y.r AS instance, x.i AS a, y.i AS b, cap FROM trade JOIN place x ON x.k = a JOIN place y ON y.k = b),
u AS (SELECT least(x.r, y.r) * 100 + greatest(x.r, y.r) AS instance, x.i + CASE WHEN x.r > y.r THEN 5 ELSE 0 END AS a, y.i + CASE WHEN y.r > x.r THEN 5 ELSE 0 END AS b, x.r = y.r AS one, cap
 FROM trade JOIN place x ON x.k = a JOIN place y ON y.k = b WHERE a <> b)"""


def trade(spark, d):
    t = lambda n: table(spark, d, n)
    joined = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    # some hundred rows, read for their quantiles and for themselves
    return Rounds(spark).keep(joined.groupBy(F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b")).agg(F.sum("l_quantity").alias("cap")))


def _above(rows, q, of=None):
    """Rows whose capacity is above its q quantile over ``of`` (the same rows if None)."""
    return rows.crossJoin(F.broadcast((of or rows).agg(F.expr(f"percentile(cap, {q})").alias("t")))).where("cap > t").drop("t")


def _places(spark, d):
    n = table(spark, d, "nation")
    return n.select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("r"), (F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1).alias("i"))


def _ends(spark, d, rows):
    place = _places(spark, d)
    end = lambda c: F.broadcast(place.select(F.col("k").alias(c), F.col("r").alias(f"r_{c}"), F.col("i").alias(f"i_{c}")))
    return rows.join(end("a"), "a").join(end("b"), "b")


def region_pairs(spark, d, rows):
    """(instance, a, b, cap): from the nations of one region to those of another, or its own, by their numbers there."""
    return _ends(spark, d, rows).select((F.col("r_a") * 100 + F.col("r_b")).alias("instance"), F.col("i_a").alias("a"), F.col("i_b").alias("b"), "cap")


def region_links(spark, d, rows):
    """(instance, u, v): undirected links among the nations of two regions, or of one, numbered from 0."""
    number = lambda x, y: F.col(f"i_{x}") + F.when(F.col(f"r_{x}") > F.col(f"r_{y}"), 5).otherwise(0)
    placed = _ends(spark, d, rows.where("a <> b")).select((F.least("r_a", "r_b") * 100 + F.greatest("r_a", "r_b")).alias("instance"), number("a", "b").alias("p"), number("b", "a").alias("q"))
    return placed.select("instance", F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).distinct()


@query(_TRADE + _PLACED + """, sup AS (SELECT instance, a, sum(cap) * 0.6 AS s FROM t GROUP BY ALL), dem AS (SELECT instance, b, sum(cap) * 0.7 AS d FROM t GROUP BY ALL), m AS (SELECT range AS m FROM range(0, 1024)),
x AS (SELECT instance, m, sum(s) FILTER ((m >> a) & 1 = 0) AS c FROM sup, m GROUP BY ALL), y AS (SELECT instance, m, sum(d) FILTER ((m >> (b + 5)) & 1 = 1) AS c FROM dem, m GROUP BY ALL),
z AS (SELECT instance, m, sum(cap) FILTER ((m >> a) & 1 = 1 AND (m >> (b + 5)) & 1 = 0) AS c FROM t, m GROUP BY ALL)
SELECT instance, round(min(coalesce(x.c, 0) + coalesce(y.c, 0) + coalesce(z.c, 0)), 4)::DOUBLE AS flow FROM x JOIN y USING (instance, m) JOIN z USING (instance, m) GROUP BY instance""")
def evacuation_flow_value(spark, d):
    def kernel(pdf):
        roads = [(("from", a), ("to", b), c) for a, b, c in zip(pdf["a"], pdf["b"], pdf["cap"], strict=True)]
        people = {("from", k): v * 0.6 for k, v in pdf["cap"].groupby(pdf["a"]).sum().items()}
        room = {("to", k): v * 0.7 for k, v in pdf["cap"].groupby(pdf["b"]).sum().items()}
        edges, s, t = kernels.evacuation_edges(roads, sorted(people), people, room, 1)
        return {"flow": round(kernels.max_flow(edges, s, t)[0], 4)}

    return kernels.solve(region_pairs(spark, d, trade(spark, d)), "instance", kernel, "flow double")


_SOME = _TRADE + _PLACED + ", thr AS (SELECT quantile_cont(cap, {q}::DOUBLE) AS t FROM trade), e AS (SELECT DISTINCT instance, a::INT AS a, b::INT AS b FROM t, thr WHERE cap > thr.t)"
_LINKS = _TRADE + _PLACED + ", thr AS (SELECT quantile_cont(cap, {q}::DOUBLE) AS t FROM trade), e AS (SELECT DISTINCT instance, least(a, b)::INT AS u, greatest(a, b)::INT AS v, one FROM u, thr WHERE cap > thr.t)"


def _some(spark, d, q):
    return region_pairs(spark, d, _above(trade(spark, d), q))


def _links(spark, d, q):
    return region_links(spark, d, _above(trade(spark, d), q))


@query(_SOME.format(q=0.6) + """, m AS (SELECT range AS m FROM range(0, 32)), have AS (SELECT instance, bit_or(1 << a) AS have, count(DISTINCT a) AS n FROM e GROUP BY instance),
x AS (SELECT instance, m, count(DISTINCT b) FILTER ((m >> a) & 1 = 1) AS near FROM e, m GROUP BY ALL)
SELECT instance, (n - max(bit_count(m) - near))::BIGINT AS size FROM x JOIN have USING (instance) WHERE m & have = m GROUP BY instance, n""")
def matching_size(spark, d):
    return kernels.solve(_some(spark, d, 0.6), "instance", lambda pdf: {"size": len(kernels.bipartite_matching(list(zip(pdf["a"], pdf["b"], strict=True))))}, "size long")


@query(_LINKS.format(q=0.3) + """, m AS (SELECT range AS m FROM range(1, 512)), x AS (SELECT instance, one, m, count(*) FILTER ((m >> u) & 1 <> (m >> v) & 1) AS c FROM e, m GROUP BY ALL)
SELECT instance, min(c)::BIGINT AS cut FROM x WHERE NOT one OR m < 16 GROUP BY instance""")
def weakest_link(spark, d):
    """Random contraction trials over the links of each instance, as many as miss a minimum cut with probability 1e-9 at most."""
    return graph.weakest_cuts(_links(spark, d, 0.3), _node_counts(spark, d), 1e-9).select("instance", "cut")


def _node_counts(spark, d):
    """(instance, n) of region_links: every pair of regions has the nations of both."""
    sizes = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r")).agg(F.count("*").cast("int").alias("n"))
    both = sizes.toDF("r", "n").join(sizes.toDF("q", "m"), F.col("r") <= F.col("q"))
    return both.select((F.col("r") * 100 + F.col("q")).alias("instance"), F.when(F.col("r") == F.col("q"), F.col("n")).otherwise(F.col("n") + F.col("m")).alias("n"))


@query(_LINKS.format(q=0.6) + """, m AS (SELECT range AS m FROM range(0, 1024)), x AS (SELECT instance, m, count(*) FILTER ((m >> u) & 1 = 0 AND (m >> v) & 1 = 0) AS open FROM e, m GROUP BY ALL)
SELECT instance, min(bit_count(m))::BIGINT AS size, 'exact' AS method FROM x WHERE open = 0 GROUP BY instance""")
def sensor_cover(spark, d):
    """Vertex covers by the exact search where it ends, which it does here."""
    kernel = lambda pdf: {k: v for k, v in kernels.place_sensors(list(zip(pdf["u"], pdf["v"], strict=True))).items() if k != "chosen"}
    return kernels.solve(_links(spark, d, 0.6), "instance", kernel, "size long, method string")


@query(_LINKS.format(q=0.6).replace("WITH trade", "WITH RECURSIVE trade") + """, o AS (SELECT instance, u, v, row_number() OVER (PARTITION BY instance ORDER BY u, v) AS k FROM e),
r(instance, k, taken) AS (SELECT DISTINCT instance, 0::BIGINT, 0::INT FROM o UNION ALL
SELECT r.instance, r.k + 1, CASE WHEN taken & ((1 << u) | (1 << v)) = 0 THEN taken | (1 << u) | (1 << v) ELSE taken END FROM r JOIN o ON o.instance = r.instance AND o.k = r.k + 1)
SELECT instance, bit_count(arg_max(taken, k))::BIGINT AS size FROM r GROUP BY instance""")
def sensor_cover_approx(spark, d):
    return kernels.solve(_links(spark, d, 0.6), "instance", lambda pdf: {"size": len(kernels.vertex_cover_approx(sorted(zip(pdf["u"], pdf["v"], strict=True))))}, "size long")


@query(_SOME.format(q=0.5) + """, m AS (SELECT range AS m FROM range(0, 32)), whole AS (SELECT instance, count(DISTINCT b) AS n FROM e GROUP BY instance),
x AS (SELECT instance, m, count(DISTINCT b) FILTER ((m >> a) & 1 = 1) AS near FROM e, m GROUP BY ALL)
SELECT instance, min(bit_count(m))::BIGINT AS size, 'exact' AS method FROM x JOIN whole USING (instance) WHERE near = n GROUP BY instance""")
def station_cover(spark, d):
    """Set covers by the exact search where it ends, which it does here."""

    def kernel(pdf):
        found = kernels.place_stations({k: set(v) for k, v in pdf.groupby("a")["b"]}, set(pdf["b"]))
        return {"size": found["size"], "method": found["method"]}

    return kernels.solve(_some(spark, d, 0.5), "instance", kernel, "size long, method string")


@query(_SOME.format(q=0.5).replace("WITH trade", "WITH RECURSIVE trade") + """, s AS (SELECT instance, a, bit_or(1 << b) AS own FROM e GROUP BY ALL), whole AS (SELECT instance, bit_or(own) AS w FROM s GROUP BY instance),
r(instance, got, k) AS (SELECT instance, 0::INT, 0 FROM whole UNION ALL
SELECT r.instance, got | arg_max(own, bit_count(own & ~got) * 10 - a), r.k + 1 FROM r JOIN s USING (instance) JOIN whole USING (instance) WHERE got <> w GROUP BY r.instance, got, r.k)
SELECT instance, max(k)::BIGINT AS size, true AS covered_all FROM r GROUP BY instance""")
def station_cover_greedy(spark, d):
    def kernel(pdf):
        chosen, done = kernels.set_cover_greedy({k: set(v) for k, v in pdf.groupby("a")["b"]}, set(pdf["b"]))
        return {"size": len(chosen), "covered_all": done}

    return kernels.solve(_some(spark, d, 0.5), "instance", kernel, "size long, covered_all boolean")


_REACHED = _TRADE + ", thr AS (SELECT quantile_cont(cap, 0.3) AS near, quantile_cont(cap, 0.8) AS far FROM trade), cover AS (SELECT a AS station, b AS place FROM trade, thr WHERE cap <= near)"


def _coverage(spark, d):
    t = trade(spark, d)
    near = t.crossJoin(F.broadcast(t.agg(F.expr("percentile(cap, 0.3)").alias("near"))))
    return summary.coverage_sets(near.withColumnRenamed("cap", "dist"), F.col("near"))


@query(_REACHED + "SELECT station, place FROM cover")
def coverage_sets(spark, d):
    return _coverage(spark, d)


@query(_REACHED + "SELECT n_regionkey AS region, count(DISTINCT place) AS covered FROM cover JOIN nation ON n_nationkey = station GROUP BY 1")
def covered_places(spark, d):
    return summary.covered(_coverage(spark, d), table(spark, d, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("station")), "region")


@query(_REACHED + """, l AS (SELECT DISTINCT least(a, b) AS u, greatest(a, b) AS v FROM trade, thr WHERE cap > far AND a <> b)
SELECT n_regionkey AS region, count(DISTINCT (u, v)) AS watched FROM l JOIN nation ON n_nationkey IN (u, v) GROUP BY 1""")
def watched_links(spark, d):
    links = graph.undirected(_above(trade(spark, d), 0.8).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return summary.watched(links, table(spark, d, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("node")), "region")


_DIST = """s AS (SELECT vec_id // {n} AS instance, row_number() OVER (PARTITION BY vec_id // {n} ORDER BY vec_id) - 1 AS i, embedding::DOUBLE[] AS x FROM embeddings),
d AS (SELECT p.instance, p.i AS i, q.i AS j, round(sqrt(list_sum(list_transform(range(1, len(p.x) + 1), lambda k: (p.x[k] - q.x[k]) * (p.x[k] - q.x[k])))), 6) AS w FROM s p JOIN s q ON q.instance = p.instance WHERE p.i <> q.i)"""


def _sites(spark, d, n):
    """All embeddings, n neighbouring ids an instance."""
    return table(spark, d, "embeddings").select(F.expr(f"vec_id div {n}").alias("instance"), "vec_id", F.col("embedding").cast("array<double>").alias("x"))


def _distances(pdf):
    import numpy as np

    x = np.array(pdf.sort_values("vec_id")["x"].tolist())
    return np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), 6).tolist()


@query("WITH RECURSIVE " + _DIST.format(n=7) + """, c AS (SELECT instance, count(*) AS n FROM s GROUP BY 1),
t(instance, last, mask, cost, n) AS (SELECT instance, 0::BIGINT, 1::BIGINT, 0::DOUBLE, 1 FROM c UNION ALL SELECT t.instance, d.j, t.mask | (1::BIGINT << d.j), t.cost + d.w, t.n + 1 FROM t JOIN d ON d.instance = t.instance AND d.i = t.last WHERE (t.mask >> d.j) & 1 = 0)
SELECT instance, round(min(t.cost + coalesce(d.w, 0)), 3) AS cost FROM t JOIN c USING (instance) LEFT JOIN d ON d.instance = t.instance AND d.i = t.last AND d.j = 0 WHERE t.n = c.n GROUP BY instance""")
def inspection_tour(spark, d):
    return kernels.solve(_sites(spark, d, 7), "instance", lambda pdf: {"cost": round(kernels.tour(_distances(pdf))["cost"], 3)}, "cost double")


@query("WITH " + _DIST.format(n=7) + """, b1 AS (SELECT instance, i, j, w FROM d UNION ALL SELECT instance, i, i, 0::DOUBLE FROM s),
b2 AS (SELECT x.instance, x.i, y.j, min(greatest(x.w, y.w)) AS w FROM b1 x JOIN b1 y ON y.instance = x.instance AND y.i = x.j GROUP BY ALL),
b4 AS (SELECT x.instance, x.i, y.j, min(greatest(x.w, y.w)) AS w FROM b2 x JOIN b2 y ON y.instance = x.instance AND y.i = x.j GROUP BY ALL),
b8 AS (SELECT x.instance, x.i, y.j, min(greatest(x.w, y.w)) AS w FROM b4 x JOIN b4 y ON y.instance = x.instance AND y.i = x.j GROUP BY ALL)
SELECT instance, round(coalesce(sum(d.w) FILTER (d.i < d.j AND d.w <= b8.w), 0), 3)::DOUBLE AS weight FROM b8 LEFT JOIN d USING (instance, i, j) GROUP BY instance""")
def mst_weight(spark, d):
    """A link belongs to the tree if no way round it has shorter links only, which is how the SQL finds it."""
    return kernels.solve(_sites(spark, d, 7), "instance", lambda pdf: {"weight": round(kernels.spanning_tree(_distances(pdf))[0], 3)}, "weight double")


@query()
def inspection_tour_approx(spark, d):
    def kernel(pdf):
        dist = _distances(pdf)
        return {"tree": round(kernels.spanning_tree(dist)[0], 5), "cost": round(kernels.tour_approx(dist)[0], 5)}

    return kernels.solve(_sites(spark, d, 20), "instance", kernel, "tree double, cost double")


# --- geometry ------------------------------------------------------------------------------------------------------------

_PTS = "WITH p AS (SELECT DISTINCT p_brand g, p_size::DOUBLE x, p_retailprice y FROM part), "


@query(_PTS + """c AS (SELECT a.g, a.x, a.y FROM p a WHERE EXISTS (SELECT 1 FROM p b WHERE b.g = a.g AND (b.x <> a.x OR b.y <> a.y) AND NOT EXISTS (
SELECT 1 FROM p r WHERE r.g = a.g AND ((b.x - a.x) * (r.y - a.y) - (b.y - a.y) * (r.x - a.x) < -1e-9
 OR (abs((b.x - a.x) * (r.y - a.y) - (b.y - a.y) * (r.x - a.x)) <= 1e-9 AND (r.x - a.x) * (b.x - a.x) + (r.y - a.y) * (b.y - a.y) < 0)))))
SELECT g AS p_brand, x, y FROM c""")
def hull_vertices(spark, d):
    return spatial.convex_hulls(table(spark, d, "part"), "p_brand", "p_partkey", "p_size", "p_retailprice").select("p_brand", "x", "y")


_HULL = _PTS + """c AS (SELECT a.g, a.x, a.y FROM p a WHERE EXISTS (SELECT 1 FROM p b WHERE b.g = a.g AND (b.x <> a.x OR b.y <> a.y) AND NOT EXISTS (
SELECT 1 FROM p r WHERE r.g = a.g AND ((b.x - a.x) * (r.y - a.y) - (b.y - a.y) * (r.x - a.x) < -1e-9
 OR (abs((b.x - a.x) * (r.y - a.y) - (b.y - a.y) * (r.x - a.x)) <= 1e-9 AND (r.x - a.x) * (b.x - a.x) + (r.y - a.y) * (b.y - a.y) < 0)))))"""


@query(_HULL + """, m AS (SELECT g, avg(x) AS mx, avg(y) AS my, count(*) AS n FROM c GROUP BY g), o AS (SELECT c.g, x, y, n, row_number() OVER (PARTITION BY c.g ORDER BY atan2(y - my, x - mx)) AS k FROM c JOIN m USING (g))
SELECT a.g AS p_brand, CASE WHEN max(a.n) < 3 THEN 0.0 ELSE round(abs(sum(a.x * b.y - b.x * a.y)) / 2, 4) END::DOUBLE AS area FROM o a JOIN o b ON b.g = a.g AND b.k = a.k % a.n + 1 GROUP BY a.g""")
def hull_area(spark, d):
    rings = spatial.convex_hulls(table(spark, d, "part"), "p_brand", "p_partkey", "p_size", "p_retailprice")
    return spatial.polygon_area(rings, "p_brand").withColumn("area", F.round("area", 4))


_RING = [("six", 1, 5.0, 1300.0), ("six", 2, 20.0, 1000.0), ("six", 3, 40.0, 1050.0), ("six", 4, 48.0, 1400.0), ("six", 5, 35.0, 1800.0), ("six", 6, 12.0, 1700.0), ("three", 1, 1.0, 900.0), ("three", 2, 50.0, 900.0), ("three", 3, 1.0, 2000.0)]


@query("WITH c(polygon, rank, x, y) AS (VALUES " + ", ".join(f"('{n}', {k}, {x}::DOUBLE, {y}::DOUBLE)" for n, k, x, y in _RING) + """), n AS (SELECT polygon, max(rank) AS n FROM c GROUP BY 1),
s AS (SELECT a.polygon, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM c a JOIN n USING (polygon) JOIN c b ON b.polygon = a.polygon AND b.rank = a.rank % n + 1)
SELECT p_partkey AS id, polygon, bool_and((bx - ax) * (p_retailprice - ay) - (b_y - ay) * (p_size - ax) >= -1e-12) AS inside FROM part, s GROUP BY ALL""")
def parts_in_polygons(spark, d):
    corners = spark.createDataFrame(_RING, "polygon string, rank int, x double, y double")
    points = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return spatial.inside_polygons(points, corners)


_GEO = "SELECT p_partkey, 80 + p_size / 100.0::DOUBLE AS lon, 13 + p_retailprice / 100000.0::DOUBLE AS lat FROM part"


@query(f"""WITH p AS ({_GEO}), m AS (SELECT p_partkey, (lon - 80.25) * 111320.0::DOUBLE * cos(radians(13.01::DOUBLE)) AS x, (lat - 13.01) * 110574.0::DOUBLE AS y,
pow(sin(radians(13.01 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(13.01::DOUBLE)) * pow(sin(radians(80.25 - lon) / 2), 2) AS h FROM p)
SELECT p_partkey, round(x, 3) AS x, round(y, 3) AS y, round(2 * 6371000.0 * asin(sqrt(h)), 3) AS metres, x * x + y * y <= 5000.0::DOUBLE * 5000.0 AS near FROM m""")
def geo_measures(spark, d):
    p = table(spark, d, "part").select("p_partkey", (80 + F.col("p_size") / 100.0).alias("lon"), (13 + F.col("p_retailprice") / 100000.0).alias("lat"))
    x, y = g.local_xy(F.col("lon"), F.col("lat"), 80.25, 13.01)
    metres = g.haversine(F.col("lon"), F.col("lat"), F.lit(80.25), F.lit(13.01))
    return p.select("p_partkey", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), F.round(metres, 3).alias("metres"), g.within(F.col("lon"), F.col("lat"), 80.25, 13.01, 5000.0).alias("near"))


_SCENARIOS = [(1, 80.1, 13.01, 4000.0), (2, 80.25, 13.015, 2000.0), (3, 80.45, 13.005, 6000.0)]


@query(f"WITH p AS ({_GEO}), s(scenario, lon0, lat0, radius) AS (VALUES " + ", ".join(f"({i}, {x}::DOUBLE, {y}::DOUBLE, {r}::DOUBLE)" for i, x, y, r in _SCENARIOS) + """),
m AS (SELECT scenario, radius, (lon - lon0) * 111320.0::DOUBLE * cos(radians(lat0)) AS x, (lat - lat0) * 110574.0::DOUBLE AS y FROM p, s)
SELECT scenario, count(*) AS incidents FROM m WHERE x * x + y * y <= 1.5 * radius * (1.5 * radius) GROUP BY scenario""")
def flood_incidents(spark, d):
    """Incidents within one and a half radii of each flood scenario."""
    p = table(spark, d, "part").select((80 + F.col("p_size") / 100.0).alias("lon"), (13 + F.col("p_retailprice") / 100000.0).alias("lat"))
    near = [p.where(g.within(F.col("lon"), F.col("lat"), x, y, 1.5 * r)).select(F.lit(i).alias("scenario")) for i, x, y, r in _SCENARIOS]
    return near[0].union(near[1]).union(near[2]).groupBy("scenario").agg(F.count("*").alias("incidents"))


@query("""WITH s AS (SELECT DISTINCT p_size AS n FROM part)
SELECT n, round(list_sum(list_transform(range(1, n + 1), lambda i: 1.0::DOUBLE / i)), 9) AS harmonic, ceil(ln(100.0::DOUBLE) / (2.0::DOUBLE / ((n + 1) * n)))::BIGINT AS trials, round(1 - pow(1 - 2.0::DOUBLE / ((n + 1) * n), 50), 9) AS success FROM s""")
def cut_bounds(spark, d):
    n, nodes = F.col("n"), F.col("n") + 1
    sizes = table(spark, d, "part").select(F.col("p_size").alias("n")).distinct()
    return sizes.select("n", F.round(g.harmonic(n), 9).alias("harmonic"), g.min_cut_trials(nodes, 0.01).alias("trials"), F.round(g.min_cut_success(nodes, F.lit(50)), 9).alias("success"))


_SEG = """WITH o AS (SELECT event_id, event_type, date_trunc('day', ts) AS day, date_diff('second', TIMESTAMP '2024-01-01', ts) / 3600.0::DOUBLE AS x, value AS y, ts FROM events),
s AS (SELECT event_id AS id, event_type AS g, round(x, 6) AS x1, round(y, 6) AS y1, round(lead(x) OVER w, 6) AS x2, round(lead(y) OVER w, 6) AS y2 FROM o WINDOW w AS (PARTITION BY event_type, day ORDER BY ts, event_id)), seg AS (SELECT * FROM s WHERE x2 IS NOT NULL)
"""


def event_segments(spark, d):
    """Each type's events of a day as a line through hours and values."""
    hours = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01', ts)") / F.lit(3600.0)
    w = Window.partitionBy("g", "day").orderBy("ts", "id")
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("g"), F.date_trunc("day", "ts").alias("day"), "ts", F.round(hours, 6).alias("x1"), F.round("value", 6).alias("y1"))
    return rows.select("id", "g", "x1", "y1", F.lead("x1").over(w).alias("x2"), F.lead("y1").over(w).alias("y2")).where("x2 is not null")


@query(_SEG + """, q AS (SELECT a.id a, b.id b, a.x1 ax, a.y1 ay, a.x2 bx, a.y2 b_y, b.x1 cx, b.y1 cy, b.x2 dx, b.y2 dy FROM seg a JOIN seg b ON a.x1 <= b.x2 AND b.x1 <= a.x2 WHERE a.id < b.id AND a.g <> b.g),
z AS (SELECT *, (bx-ax)*(cy-ay)-(b_y-ay)*(cx-ax) o1, (bx-ax)*(dy-ay)-(b_y-ay)*(dx-ax) o2, (dx-cx)*(ay-cy)-(dy-cy)*(ax-cx) o3, (dx-cx)*(b_y-cy)-(dy-cy)*(bx-cx) o4 FROM q),
t AS (SELECT *, ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / ((bx - ax) * (dy - cy) - (b_y - ay) * (dx - cx)) AS t FROM z WHERE sign(o1) <> sign(o2) AND sign(o3) <> sign(o4))
SELECT a, b, round(ax + t * (bx - ax), 4) AS x, round(ay + t * (b_y - ay), 4) AS y FROM t""")
def segment_crossings(spark, d):
    return spatial.crossings(event_segments(spark, d)).select("a", "b", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(_SEG + """, m AS (SELECT *, x2 - x1 AS dx, y2 - y1 AS dy, (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AS sq FROM seg),
t AS (SELECT *, CASE WHEN sq > 0 THEN least(1.0, greatest(0.0, ((360.0 - x1) * dx + (100.0 - y1) * dy) / sq)) ELSE 0 END AS t FROM m)
SELECT id, round(sqrt(sq), 5) AS length, round(atan2(dy, dx), 6) AS angle, round(sqrt((360.0 - (x1 + t * dx)) * (360.0 - (x1 + t * dx)) + (100.0 - (y1 + t * dy)) * (100.0 - (y1 + t * dy))), 5) AS far,
abs(dx * 0 - dy * 1) <= 1e-12 AS flat, CASE WHEN dx * (100.0 - y1) - dy * (360.0 - x1) > 1e-12 THEN 1 WHEN dx * (100.0 - y1) - dy * (360.0 - x1) < -1e-12 THEN -1 ELSE 0 END AS side,
360.0 BETWEEN least(x1, x2) - 1e-12 AND greatest(x1, x2) + 1e-12 AND 100.0 BETWEEN least(y1, y2) - 1e-12 AND greatest(y1, y2) + 1e-12 AS boxed FROM t""")
def segment_measures(spark, d):
    """Of each segment: length, angle, distance from a point, whether it is parallel to the x axis, on which side the point
    lies, and whether it lies in the segment's box (on it, if it is in line)."""
    s, px, py = [F.col(c) for c in ("x1", "y1", "x2", "y2")], F.lit(360.0), F.lit(100.0)
    measures = {
        "length": F.round(g.segment_length(*s), 5), "angle": F.round(g.segment_angle(*s), 6), "far": F.round(g.point_segment_distance(px, py, *s), 5),
        "flat": g.segments_parallel(s, [F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)]), "side": g.orientation(*s, px, py), "boxed": g.on_segment(*s, px, py),
    }
    return event_segments(spark, d).select("id", *[v.alias(k) for k, v in measures.items()])


@query("""WITH c AS (SELECT c_custkey, c_acctbal / 100.0::DOUBLE AS x, c_nationkey * 5.0::DOUBLE AS y FROM customer), s AS (SELECT s_suppkey, s_acctbal / 100.0::DOUBLE AS nx, s_nationkey * 5.0::DOUBLE AS ny FROM supplier)
SELECT c_custkey, arg_min(s_suppkey, ((x - nx) * (x - nx) + (y - ny) * (y - ny), s_suppkey)) AS nearest FROM c, s GROUP BY c_custkey""")
def nearest_node(spark, d):
    """Each customer's nearest supplier on a plane of balance and nation."""
    at = lambda t, k, b, n: table(spark, d, t).select(F.col(k).alias("id"), (F.col(b) / 100.0).alias("x"), (F.col(n) * 5.0).alias("y"))
    found = spatial.nearest_nodes(at("customer", "c_custkey", "c_acctbal", "c_nationkey"), at("supplier", "s_suppkey", "s_acctbal", "s_nationkey"))
    return found.select(F.col("id").alias("c_custkey"), F.col("node").alias("nearest"))


_WAYS = """WITH v AS (SELECT user_id AS way, event_id AS seq, (hour(ts) * 60 + minute(ts)) * 100000 + floor(value)::BIGINT AS vertex, 80 + (hour(ts) * 60 + minute(ts)) / 10000.0::DOUBLE AS lon, 12.9 + floor(value) / 10000.0::DOUBLE AS lat FROM events),
e AS (SELECT *, lag(seq) OVER w IS NULL OR lead(seq) OVER w IS NULL AS tip FROM v WINDOW w AS (PARTITION BY way ORDER BY seq)),
j AS (SELECT vertex, count(*) AS uses, bool_or(tip) OR count(*) >= 2 AS junction FROM e GROUP BY vertex)
"""


def event_ways(spark, d):
    """Each user's events as a way through places of minute and value."""
    minute = F.hour("ts") * 60 + F.minute("ts")
    step = F.floor("value")
    return table(spark, d, "events").select(F.col("user_id").alias("way"), F.col("event_id").alias("seq"), (minute * 100000 + step).cast("long").alias("vertex"), (80 + minute / 10000.0).alias("lon"), (12.9 + step / 10000.0).alias("lat"))


@query(_WAYS + "SELECT vertex, uses, junction FROM j")
def junctions(spark, d):
    return roads.junctions(event_ways(spark, d))


@query(_WAYS + """, c AS (SELECT v.*, junction, lag(lon) OVER w AS lon0, lag(lat) OVER w AS lat0 FROM v JOIN j USING (vertex) WINDOW w AS (PARTITION BY way ORDER BY seq)),
h AS (SELECT *, coalesce(2 * 6371000.0 * asin(sqrt(pow(sin(radians(lat - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(lat)) * pow(sin(radians(lon - lon0) / 2), 2))), 0) AS step FROM c),
r AS (SELECT *, sum(step) OVER (PARTITION BY way ORDER BY seq ROWS UNBOUNDED PRECEDING) AS dist FROM h),
s AS (SELECT *, last_value(CASE WHEN junction THEN {'vertex': vertex, 'dist': dist} END IGNORE NULLS) OVER (PARTITION BY way ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS since FROM r)
SELECT way, since.vertex AS src, vertex AS dst, round(dist - since.dist, 3) AS len FROM s WHERE junction AND since IS NOT NULL AND since.vertex <> vertex AND dist - since.dist > 0""")
def contracted_roads(spark, d):
    return roads.contract_roads(event_ways(spark, d)).withColumn("len", F.round("len", 3))


_ROAD_NAMES = ["motorway", "trunk_link", "primary", "secondary_link", "tertiary", "unclassified", "residential", "service", "living_street", "motorway_link_link"]


@query("WITH c(code, name, speed, cap) AS (VALUES (1, 'motorway', 60, 4000), (2, 'trunk', 50, 3600), (3, 'primary', 40, 2400), (4, 'secondary', 35, 1800), (5, 'tertiary', 30, 1200), (6, 'unclassified', 25, 800), (7, 'residential', 20, 600), (8, 'service', 15, 300)), "
       f"p AS (SELECT p_partkey, p_retailprice, regexp_replace(({_ROAD_NAMES!r})[(p_partkey % 11)::INT + 1], '_link$', '') AS name FROM part), "
       "k AS (SELECT p_partkey, p_retailprice, coalesce((SELECT code FROM c WHERE c.name = p.name), 7) AS hw FROM p) "
       "SELECT p_partkey, hw::INT AS hw, speed::DOUBLE AS speed, cap::DOUBLE AS cap, round(p_retailprice / (speed::DOUBLE / 3.6), 6) AS seconds FROM k JOIN c ON code = hw")  # fmt: skip
def road_classes(spark, d):
    name = F.get(F.array(*map(F.lit, _ROAD_NAMES)), (F.col("p_partkey") % 11).cast("int"))
    rows = table(spark, d, "part").select("p_partkey", "p_retailprice", roads.road_class(name).alias("hw"))
    return rows.select("p_partkey", "hw", roads.class_speed(F.col("hw")).alias("speed"), roads.class_capacity(F.col("hw")).alias("cap"), F.round(roads.travel_seconds(F.col("p_retailprice"), F.col("hw")), 6).alias("seconds"))


@query("SELECT event_id, user_id FROM events WHERE event_type IN ('purchase', 'click') AND value BETWEEN 10 AND 100 AND user_id BETWEEN 2 AND 90")
def extract_rows(spark, d):
    """Kinds, columns and a box of value and user, all pushed into the scan."""
    return roads.extract(table(spark, d, "events"), ["event_id", "user_id"], ["purchase", "click"], (10, 2, 100, 90), "event_type", "value", "user_id")


@query("""WITH e AS (SELECT user_id, event_id, value, ts, event_type = 'purchase' AS brk, abs(value - lag(value) OVER w) AS len FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, coalesce(sum(brk::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stretch FROM e)
SELECT user_id, stretch::BIGINT AS stretch, round(sum(coalesce(len, 0)), 4) AS length, count(*) AS vertices FROM b GROUP BY ALL""")
def road_contraction(spark, d):
    """Stretches between breaks: segment lengths by lag, breaks counted before each row, one row for each stretch."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").withColumn("len", F.coalesce(F.abs(F.col("value") - F.lag("value").over(w)), F.lit(0.0)))
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    cut = rows.withColumn("stretch", F.coalesce(F.sum((F.col("event_type") == "purchase").cast("int")).over(past), F.lit(0)).cast("long"))
    return cut.groupBy("user_id", "stretch").agg(F.round(F.sum("len"), 4).alias("length"), F.count("*").alias("vertices"))


# --- sources, ranges, reports and further graphs ----------------------------------------------------------------------

_NATIONS = _TRADE.replace("WITH trade", "WITH RECURSIVE trade") + ", thr AS (SELECT quantile_cont(cap, 0.8::DOUBLE) AS t FROM trade), e AS (SELECT a AS src, b AS dst, cap AS w FROM trade, thr WHERE cap > t), "


def _nation_edges(spark, d):
    return _above(trade(spark, d), 0.8).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("cap").alias("w"))


_REACH = "r(u, v) AS (SELECT src, src FROM e UNION SELECT dst, dst FROM e UNION SELECT r.u, e.dst FROM r JOIN e ON e.src = r.v), c AS (SELECT p.u AS node, min(p.v) AS component FROM r p JOIN r q ON q.u = p.v AND q.v = p.u GROUP BY p.u) "


@query(_NATIONS + _REACH + "SELECT node, component FROM c")
def strong_components(spark, d):
    return graph.strong_components(_nation_edges(spark, d))


@query(_NATIONS + _REACH + "SELECT node FROM c WHERE component = (SELECT component FROM c GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)")
def largest_strong_component(spark, d):
    return graph.largest_component(graph.strong_components(_nation_edges(spark, d)))


@query(_NATIONS + """r(s, v, c) USING KEY (s, v) AS (SELECT DISTINCT src, src, 0::DOUBLE FROM e UNION SELECT r.s, e.dst, min(r.c + e.w) FROM r JOIN e ON e.src = r.v
LEFT JOIN recurring.r o ON o.s = r.s AND o.v = e.dst WHERE o.c IS NULL OR r.c + e.w < o.c GROUP BY r.s, e.dst),
k AS (SELECT s, v, c FROM r UNION SELECT DISTINCT dst, dst, 0::DOUBLE FROM e),
n AS (SELECT src AS s FROM e UNION SELECT dst FROM e)
SELECT x.s AS a, y.s AS b, coalesce(round((p.c + q.c) / 2, 4), -1)::DOUBLE AS dist FROM n x, n y LEFT JOIN k p ON p.s = x.s AND p.v = y.s LEFT JOIN k q ON q.s = y.s AND q.v = x.s""")
def metric_closure(spark, d):
    """Pairs without a way both ways have -1 here; the operator gives them infinity."""
    far = graph.metric_closure(_nation_edges(spark, d))
    return far.select("a", "b", F.when(F.col("dist") == float("inf"), -1.0).otherwise(F.round("dist", 4)).alias("dist"))


@query(_ADJ.replace("WITH l", "WITH RECURSIVE l").rstrip() + """, r(id, level, rank) USING KEY (id) AS (SELECT min(src), 0, 1::BIGINT FROM e UNION
SELECT dst, level + 1, base + row_number() OVER (ORDER BY near, dst) FROM (SELECT e.dst, r.level, min(r.rank) AS near, (SELECT max(rank) FROM recurring.r) AS base FROM r JOIN e ON e.src = r.id
LEFT JOIN recurring.r o ON o.id = e.dst WHERE o.id IS NULL GROUP BY e.dst, r.level))
SELECT rank::INT AS rank, id FROM r WHERE rank <= 100""")
def bfs_subgraph(spark, d):
    e = part_edges(spark, d)
    root = e.agg(F.min("src")).first()[0]
    return graph.bfs_subgraph(e, root, 100)[0] if root is not None else e.select(F.col("w").alias("rank"), F.col("src").alias("id")).limit(0)


@query("SELECT event_id, event_type AS kind, nullif(user_id::VARCHAR, '') AS owner FROM events")
def tag_values(spark, d):
    e = table(spark, d, "events")
    tags = F.concat(F.lit('"kind"=>"'), "event_type", F.lit('","owner"=>"'), F.col("user_id").cast("string"), F.lit('"'))
    return e.select("event_id", tags.alias("tags")).select("event_id", roads.tag(F.col("tags"), "kind").alias("kind"), roads.tag(F.col("tags"), "owner").alias("owner"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def first_event(spark, d):
    return roads.first_per_key(table(spark, d, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT p.p_partkey AS id, count(*) AS n FROM part p JOIN part q ON (p.p_size - q.p_size) * (p.p_size - q.p_size)::DOUBLE + (p.p_retailprice - q.p_retailprice)::DOUBLE * (p.p_retailprice - q.p_retailprice)::DOUBLE <= 25.0 GROUP BY 1")
def incident_density(spark, d):
    return summary.density(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").cast("double").alias("y")), 5.0)


@query("""WITH RECURSIVE n AS (SELECT p.p_partkey AS id, p.p_size::DOUBLE AS x, p.p_retailprice AS y, count(*) AS n FROM part p JOIN part q ON (p.p_size - q.p_size) * (p.p_size - q.p_size)::DOUBLE + (p.p_retailprice - q.p_retailprice)::DOUBLE * (p.p_retailprice - q.p_retailprice)::DOUBLE <= 25.0 GROUP BY ALL),
o AS (SELECT *, row_number() OVER (ORDER BY n DESC, id) AS k FROM n QUALIFY k <= 50),
r(k, kept) AS (SELECT 0::BIGINT, []::STRUCT(id BIGINT, x DOUBLE, y DOUBLE, n BIGINT)[] UNION ALL
SELECT r.k + 1, CASE WHEN len(kept) < 3 AND len(list_filter(kept, lambda p: (p.x - o.x) * (p.x - o.x) + (p.y - o.y) * (p.y - o.y) < 100.0)) = 0 THEN list_append(kept, {'id': o.id, 'x': o.x, 'y': o.y, 'n': o.n}) ELSE kept END FROM r JOIN o ON o.k = r.k + 1)
SELECT u.p.id AS id, u.p.n AS n FROM (SELECT unnest(kept) AS p FROM (SELECT arg_max(kept, k) AS kept FROM r)) u""")
def hot_spots(spark, d):
    """Of the 50 densest places the first three that are 10 apart; the rest of the work is on that bounded list."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").cast("double").alias("y"))
    dense = part.join(discs.place_density(part, 5.0), ["x", "y"]).groupBy("id", "x", "y").agg(F.sum("n").alias("n"))
    top = dense.orderBy(F.desc("n"), "id").limit(50).collect()
    kept = summary.spaced_top([(r["n"], r["id"], r["x"], r["y"]) for r in top], 3, 10.0)
    return spark.createDataFrame([(i, n) for n, i, _, _ in kept], "id long, n long")


@query(_TRADE + """, c AS (SELECT quantile_cont(cap, [0.5, 0.85]) AS q FROM trade) SELECT a, b, (1 + (cap >= q[1])::INT + (cap >= q[2])::INT)::INT AS bin FROM trade, c""")
def flow_bins(spark, d):
    return summary.quantile_bins(trade(spark, d), "cap", [0.0, 0.5, 0.85, 1.0]).select("a", "b", "bin")


@query("SELECT round(regr_slope(ln(l_extendedprice), ln(l_quantity)), 6) AS slope FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0")
def price_slope(spark, d):
    return summary.loglog_slope(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice").select(F.round("slope", 6).alias("slope"))


@query("""SELECT t::DOUBLE AS threshold, sum((l_quantity >= t)::INT)::BIGINT AS flagged,
round(sum((l_quantity >= t AND l_returnflag = 'R')::INT) / greatest(1, sum((l_quantity >= t)::INT)), 9)::DOUBLE AS precision,
round(sum((l_quantity >= t AND l_returnflag = 'R')::INT) / greatest(1, sum((l_returnflag = 'R')::INT)), 9)::DOUBLE AS recall
FROM lineitem, (SELECT unnest([10, 20, 30, 40]) AS t) GROUP BY t""")
def threshold_sweep(spark, d):
    rows = table(spark, d, "lineitem").select("l_quantity", (F.col("l_returnflag") == "R").alias("truth"))
    return reports.precision_recall(rows, "l_quantity", "truth", [10, 20, 30, 40]).select("threshold", "flagged", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query("SELECT p_partkey, unit::INT AS unit FROM (SELECT p_partkey, unnest(range(1, p_size + 1)) AS unit FROM part WHERE p_retailprice <= 1500)")
def unit_expansion(spark, d):
    return summary.expand_units(table(spark, d, "part"), "p_size", "p_retailprice", 1500).select("p_partkey", "unit")


_REPORTS = f"""WITH RECURSIVE t AS (SELECT item_id AS i, list_filter({_TOKENS}, lambda t: NOT regexp_full_match(t, 'inc[0-9]+')) AS t FROM (SELECT item_id, coalesce(text, '') AS text FROM benchmark)),
p AS (SELECT a.i AS i, b.i AS j, {_SIM.format(a='a.t', b='b.t')} AS sim FROM t a JOIN t b ON a.i < b.i WHERE len(a.t) > 0 AND len(b.t) > 0 AND least(len(a.t), len(b.t)) >= greatest(len(a.t), len(b.t)) * 0.5)"""


@query(_REPORTS + """, o AS (SELECT i, row_number() OVER (ORDER BY i) AS k FROM t), l AS (SELECT j, list(i) AS near FROM p WHERE sim >= 0.75 GROUP BY j),
r(k, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT r.k + 1, CASE WHEN near IS NOT NULL AND list_has_any(near, kept) THEN kept ELSE list_append(kept, o.i) END FROM r JOIN o ON o.k = r.k + 1 LEFT JOIN l ON l.j = o.i)
SELECT i AS item_id, (SELECT min(x.i) FROM p x WHERE x.j = o.i AND sim >= 0.75 AND list_contains((SELECT arg_max(kept, k) FROM r), x.i)) AS dup_of FROM o""")
def duplicate_reports(spark, d):
    return reports.dedupe_reports(table(spark, d, "benchmark"), "item_id", "text")


@query(_REPORTS + """, b AS (SELECT j, max(sim) AS sim, arg_min(i, (-sim, i)) AS best FROM p WHERE sim > 0 GROUP BY j)
SELECT i AS item_id, best, coalesce(round(sim, 6), 0)::DOUBLE AS similarity FROM t LEFT JOIN b ON j = i""")
def best_matches(spark, d):
    return reports.best_matches(table(spark, d, "benchmark"), "item_id", "text").withColumn("similarity", F.round("similarity", 6))


@query(_REPORTS + """, b AS (SELECT j, round(max(sim), 6) AS sim FROM p WHERE sim > 0 GROUP BY j)
SELECT j AS item_id, sim::DOUBLE AS similarity FROM b WHERE sim >= 0.05 ORDER BY sim DESC, j LIMIT 6""")
def likely_duplicates(spark, d):
    """The six reports most like an earlier one."""
    return reports.flagged_top(best_matches(spark, d), 0.05).select("item_id", "similarity")


@query("""SELECT h AS hour, n FROM (SELECT date_trunc('hour', ts) AS h, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1)
WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def closed_hours(spark, d):
    return streaming.closed_hours(spark, f"{d}/events.parquet", "ts").select(F.col("hour").cast("timestamp_ntz").alias("hour"), "n")
