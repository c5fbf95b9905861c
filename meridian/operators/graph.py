"""Graph operators on edges(src, dst, w): relational ones, and fixpoint loops over tables in the shared folder."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import kernels
from .ordered import running_sum
from .rounds import Labels, Rounds


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("degree"))


def edge_offsets(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, degree, offset): where each node's edges begin if edges lie in the order of their source, from 0."""
    degree = nodes.select("id").join(out_degree(edges).withColumnRenamed("src", "id"), "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))
    return running_sum(degree, ["id"], "degree", "offset")


def edge_lines(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges`` with the coordinates of both ends from nodes(id, x, y): x1, y1, x2, y2."""
    end = lambda name, k: nodes.select(F.col("id").alias(name), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
    return edges.join(end("src", 1), "src").join(end("dst", 2), "dst")


def reverse(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"src": F.col("dst"), "dst": F.col("src")})


def undirected(edges: DataFrame) -> DataFrame:
    """(u, v), u < v: one row for each link; loops go."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in nodes(id)."""
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")


def shortest_paths(edges: DataFrame, sources: DataFrame, limit: float | None = None) -> DataFrame:
    """(node, dist, origin, parent): the least distance from any of sources(id), within ``limit`` (closed) if given.

    Weights are not negative. Rounds relax the edges of nodes that got nearer, until none does; ties go to the smallest
    origin, then the smallest parent. Unreachable nodes have no row.
    """
    rounds = Rounds(edges.sparkSession)
    edges = rounds.keep(edges.groupBy("src", "dst").agg(F.min("w").cast("double").alias("w")))
    first = sources.select(F.col("id").alias("node"), F.lit(0.0).alias("dist"), F.col("id").alias("origin"), F.lit(None).cast(edges.schema["src"].dataType).alias("parent")).distinct()
    labels = Labels(rounds, first, ["node"])
    while True:
        step = labels.front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("dist") + F.col("w")).alias("dist"), "origin", F.col("src").alias("parent"))
        if limit is not None:
            step = step.where(F.col("dist") <= limit)
        best = step.groupBy("node").agg(F.min(F.struct("dist", "origin", "parent")).alias("s")).select("node", "s.*")
        old = labels.now().select("node", F.col("dist").alias("old_dist"), F.col("origin").alias("old_origin"))
        nearer = best.join(old, "node", "left").where("old_dist is null or dist < old_dist or (dist = old_dist and origin < old_origin)").drop("old_dist", "old_origin")
        if not labels.change(nearer):
            return labels.now()


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): the smallest node reachable over undirected links; isolated nodes if nodes(id) are given."""
    rounds = Rounds(edges.sparkSession)
    both = rounds.keep(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    every = both.select(F.col("src").alias("node"))
    if nodes is not None:
        every = every.union(nodes.select(F.col("id").alias("node")))
    label = rounds.keep(every.distinct().withColumn("component", F.col("node")))
    while True:
        near = both.join(label, F.col("src") == F.col("node")).groupBy("dst").agg(F.min("component").alias("near"))
        after = label.join(near, F.col("node") == F.col("dst"), "left").select("node", F.least("component", F.coalesce("near", "component")).alias("component"), F.col("component").alias("was"))
        # jump to the label of the label: chains halve each round
        jump = label.select(F.col("node").alias("at"), F.col("component").alias("to"))
        now = rounds.keep(after.join(jump, F.col("component") == F.col("at")).select("node", F.least("component", "to").alias("component"), "was"))
        rounds.drop(label)
        if now.where("component <> was").isEmpty():
            return now.select("node", "component")
        label = rounds.keep(now.select("node", "component"))
        rounds.drop(now)


def edges_connected(edges: DataFrame, nodes: DataFrame) -> bool:
    """Whether nodes(id) hang together; none and one do."""
    return components(edges, nodes).select("component").distinct().limit(2).count() <= 1


def closure(edges: DataFrame, nodes: DataFrame | None = None, limit: float | None = None) -> DataFrame:
    """(source, node, dist): shortest paths from every source in nodes(id), or from all ends of edges, in common rounds."""
    rounds = Rounds(edges.sparkSession)
    edges = rounds.keep(edges.groupBy("src", "dst").agg(F.min("w").cast("double").alias("w")))
    if nodes is None:
        nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst"))
    labels = Labels(rounds, nodes.select(F.col("id").alias("source"), F.col("id").alias("node")).distinct().withColumn("dist", F.lit(0.0)), ["source", "node"])
    while True:
        step = labels.front.join(edges, F.col("node") == F.col("src")).groupBy("source", F.col("dst").alias("node")).agg(F.min(F.col("dist") + F.col("w")).alias("dist"))
        if limit is not None:
            step = step.where(F.col("dist") <= limit)
        old = labels.now().select("source", "node", F.col("dist").alias("old"))
        if not labels.change(step.join(old, ["source", "node"], "left").where("old is null or dist < old").drop("old")):
            return labels.now()


def metric_closure(edges: DataFrame) -> DataFrame:
    """(a, b, dist): the mean of both directions for every ordered pair of ends; infinite where either has no way."""
    d = Rounds(edges.sparkSession).keep(closure(edges))
    ends = d.select(F.col("source").alias("a")).distinct()
    every = ends.join(ends.select(F.col("a").alias("b")), how="cross")  # one row a pair is the result's size
    there, back = d.toDF("a", "b", "there"), d.select(F.col("node").alias("a"), F.col("source").alias("b"), F.col("dist").alias("back"))
    far = lambda c: F.coalesce(c, F.lit(float("inf")))
    return every.join(there, ["a", "b"], "left").join(back, ["a", "b"], "left").select("a", "b", ((far("there") + far("back")) / 2).alias("dist"))


def dispatch_feasibility(edges: DataFrame, units: DataFrame, incidents: DataFrame, limit: float) -> DataFrame:
    """(unit, incident, time): which of units(id, node) reach which of incidents(id, node) within ``limit`` (closed).

    Units at one node share its search, so the searches are as many as there are such nodes.
    """
    reach = closure(edges, units.select(F.col("node").alias("id")).distinct(), limit)
    unit = units.select(F.col("id").alias("unit"), F.col("node").alias("source"))
    incident = incidents.select(F.col("id").alias("incident"), "node")
    return reach.join(incident, "node").join(unit, "source").select("unit", "incident", F.col("dist").alias("time"))


def mean_arrival(pairs: DataFrame, times: DataFrame) -> DataFrame:
    """(mean) time of the matched pairs(unit, incident) by times(unit, incident, time); null where there are none."""
    return pairs.join(times, ["unit", "incident"]).agg(F.avg("time").alias("mean"))


def bfs_subgraph(edges: DataFrame, root, k: int) -> tuple[DataFrame, DataFrame]:
    """(nodes(rank, id), edges(src, dst, w) in ranks): the first k nodes in breadth-first order.

    A node's neighbours come in the order of its edges: by column ``eid`` if there is one, else by id. A level is cut to the
    places still free before it is numbered, so the numbering sees at most k rows.
    """
    rounds = Rounds(edges.sparkSession)
    place = "eid" if "eid" in edges.columns else "dst"
    edges = rounds.keep(edges)
    seen = rounds.keep(edges.sparkSession.range(1).select(F.lit(1).alias("rank"), F.lit(root).cast(edges.schema["src"].dataType).alias("id")))
    front, count = seen, 1
    while count < k:
        near = front.join(edges, F.col("id") == F.col("src")).groupBy("dst").agg(F.min(F.struct("rank", F.col(place).alias("place"))).alias("by")).join(seen.select(F.col("id").alias("dst")), "dst", "left_anti")
        level = near.orderBy("by", "dst").limit(k - count)
        front = rounds.keep(level.select((F.row_number().over(Window.orderBy("by", "dst")) + count).alias("rank"), F.col("dst").alias("id")))
        found = front.count()
        if not found:
            break
        seen, count = rounds.keep(seen.union(front)), count + found
    ends = lambda name, rank: seen.select(F.col("id").alias(name), F.col("rank").alias(rank))
    inner = edges.join(ends("src", "u"), "src").join(ends("dst", "v"), "dst").select(F.col("u").alias("src"), F.col("v").alias("dst"), "w")
    return seen, inner


def study_instance(edges: DataFrame, roots: list, k: int) -> tuple[DataFrame, DataFrame]:
    """(nodes(rank, id), distances(a, b, dist) in ranks) of the first of ``roots`` whose breadth-first subgraph has k nodes
    that all reach each other."""
    rounds = Rounds(edges.sparkSession)
    edges = rounds.keep(edges)
    for root in roots:
        nodes, inner = bfs_subgraph(edges, root, k)
        if nodes.count() < k:
            continue
        if k == 1:
            return nodes, nodes.select(F.col("rank").alias("a"), F.col("rank").alias("b"), F.lit(0.0).alias("dist"))
        far = rounds.keep(metric_closure(inner))
        if far.where("dist < double('infinity')").count() == k * k:
            return nodes, far
    raise ValueError(f"no root has {k} nodes that reach each other")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each node's strongly connected component.

    Each pass labels a node with the smallest node that reaches it; what leads back to that node within the label is one
    component and leaves the graph. Nodes without a way in or out are components of their own and leave first.
    """
    rounds = Rounds(edges.sparkSession)
    ends = edges.select("src", "dst")
    nodes = rounds.keep(ends.select(F.col("src").alias("node")).union(ends.select("dst")).distinct())
    rest = rounds.keep(ends.where("src <> dst").distinct())
    done: DataFrame | None = None
    while not nodes.isEmpty():
        through = rest.select(F.col("src").alias("node")).intersect(rest.select("dst"))
        single = rounds.keep(nodes.join(through, "node", "left_anti"))
        if single.isEmpty():
            labels = Labels(rounds, nodes.withColumn("label", F.col("node")), ["node"])
            while True:
                low = rest.join(labels.front, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("to")).agg(F.min("label").alias("low"))
                if not labels.change(labels.now().join(low, F.col("node") == F.col("to")).where("low < label").select("node", F.col("low").alias("label"))):
                    break
            label = rounds.keep(labels.now())
            inside = rounds.keep(rest.join(label.toDF("src", "label"), "src").join(label.toDF("dst", "other"), "dst").where("label = other").select("src", "dst", "label"))
            parts = [rounds.keep(label.where("node = label"))]
            while True:
                found = parts[0]
                for p in parts[1:]:
                    found = found.union(p)
                back = inside.join(parts[-1].select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node"), "label").distinct()
                parts.append(rounds.keep(back.join(found.select("node"), "node", "left_anti")))
                if parts[-1].isEmpty():
                    break
                if len(parts) > Labels.MERGE:
                    parts = [rounds.keep(found), parts[-1]]
            gone = found.select("node", F.col("label").alias("component"))
        else:
            gone = single.select("node", F.col("node").alias("component"))
        gone = rounds.keep(gone)
        done = gone if done is None else rounds.keep(done.union(gone))
        nodes = rounds.keep(nodes.join(gone, "node", "left_anti"))
        rest = rounds.keep(rest.join(nodes.toDF("src"), "src", "left_semi").join(nodes.toDF("dst"), "dst", "left_semi"))
    return done if done is not None else nodes.select("node", F.col("node").alias("component"))


def weakest_cuts(links: DataFrame, sizes: DataFrame, delta: float, each: int = 64) -> DataFrame:
    """(instance, cut, side, trials): a minimum cut of every instance of links(instance, u, v) over nodes 0 to n - 1 by
    sizes(instance, n): the number of links cut and the nodes on the side of node 0.

    Random contraction, as many trials as miss a minimum cut with probability ``delta`` at most; they are dealt out
    ``each`` a row over all tasks. An instance's links ride with its rows, so instances are small by definition.
    """
    kind = links.schema["instance"].dataType.simpleString()
    held = links.where("u <> v").groupBy("instance").agg(F.sort_array(F.collect_list(F.array(F.col("u").cast("int"), F.col("v").cast("int")))).alias("links")).join(sizes, "instance")
    counted = held.select("instance", F.col("n").cast("int").alias("n"), "links", F.when(F.col("n") < 2, 0).otherwise(g.min_cut_trials(F.col("n"), delta)).cast("int").alias("trials"))
    dealt = counted.withColumn("first", F.explode(F.sequence(F.lit(1), F.col("trials"), F.lit(each)))).repartition("instance", "first")

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                pairs = [(int(u), int(v)) for u, v in row.links]
                cut, side, _ = kernels.min_cut(list(range(row.n)), pairs, range(row.first, min(row.first + each, row.trials + 1)))
                out.append((row.instance, cut, sorted(side), row.trials))
            yield pd.DataFrame(out, columns=["instance", "cut", "side", "trials"])

    tried = dealt.mapInPandas(run, f"instance {kind}, cut long, side array<int>, trials int")
    return tried.groupBy("instance").agg(F.min(F.struct("cut", "side")).alias("m"), F.first("trials").alias("trials")).select("instance", "m.cut", "m.side", "trials")


def largest_component(components: DataFrame) -> DataFrame:
    """The nodes of the largest component, the smallest label on ties."""
    top = components.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1)
    return components.join(F.broadcast(top.select("component")), "component", "left_semi").select("node")


def paths_to(known: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, path): nodes from the origin to each of targets(id) by the parents of shortest_paths; empty if not reached.

    All targets walk back together, a round a hop; the parents are read, never gathered.
    """
    rounds = Rounds(known.sparkSession)
    up = rounds.keep(known.select(F.col("node").alias("at"), "parent"))
    walk = targets.select(F.col("id").alias("target")).distinct()
    walk = rounds.keep(walk.join(up, F.col("target") == F.col("at"), "left").select("target", F.when(F.col("at").isNull(), F.array().cast(f"array<{up.schema['at'].dataType.simpleString()}>")).otherwise(F.array("at")).alias("path"), "parent"))
    done = walk.where("parent is null").select("target", "path")
    open_ = walk.where("parent is not null")
    while not open_.isEmpty():
        step = open_.join(up.withColumnRenamed("parent", "next"), F.col("parent") == F.col("at")).select("target", F.concat(F.array("at"), "path").alias("path"), F.col("next").alias("parent"))
        step = rounds.keep(step)
        done = done.union(step.where("parent is null").select("target", "path"))
        open_ = step.where("parent is not null")
    return done
