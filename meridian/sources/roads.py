"""Road ways: extracts, tag text, first row of a key, classes, directions, contraction to edges, a grid, a city, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions import geometry as g

#: Fixed values: (class, road, free-flow speed in km/h, vehicles an hour and direction).
ROAD_CLASSES = [
    (1, "motorway", 60.0, 4000.0),
    (2, "trunk", 50.0, 3600.0),
    (3, "primary", 40.0, 2400.0),
    (4, "secondary", 35.0, 1800.0),
    (5, "tertiary", 30.0, 1200.0),
    (6, "unclassified", 25.0, 800.0),
    (7, "residential", 20.0, 600.0),
    (8, "service", 15.0, 300.0),
]
UNKNOWN_CLASS = 7


def extract(rows: DataFrame, columns: list[str], kinds: list[str], box: tuple[float, float, float, float], kind: str = "highway", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Rows of an extract of the given kinds within a closed box (lon0, lat0, lon1, lat1); Catalyst pushes all three into the scan."""
    return rows.where(F.col(kind).isin(kinds) & F.col(lon).between(box[0], box[2]) & F.col(lat).between(box[1], box[3])).select(*columns)


def tag(tags: Column, key: str) -> Column:
    """The value of ``"key"=>"value"`` in a tag text, null where it is missing or empty."""
    name = "".join(c if c.isalnum() or c == "_" else "\\" + c for c in key)
    found = F.regexp_extract(tags, f'"{name}"=>"([^"]*)"', 1)
    return F.when(found != "", found)


def first_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key by ``order``."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def _of_class(code: Column, at: int) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for row in ROAD_CLASSES for x in (row[0], row[at])]), code)


def road_class(highway: Column) -> Column:
    """The class of a road's name, links as their roads; unknown and missing names as residential."""
    known = F.create_map(*[F.lit(x) for code, name, _, _ in ROAD_CLASSES for x in (name, code)])
    return F.coalesce(F.element_at(known, F.regexp_replace(highway, "_link$", "")), F.lit(UNKNOWN_CLASS))


def class_speed(code: Column) -> Column:
    """Kilometres an hour."""
    return _of_class(code, 2)


def class_capacity(code: Column) -> Column:
    """Vehicles an hour."""
    return _of_class(code, 3)


def travel_seconds(metres: Column, code: Column) -> Column:
    return metres / (class_speed(code) / 3.6)


def vertex_key(lon: Column, lat: Column) -> Column:
    """One number for each place of a 1e-6 degree grid."""
    return (F.round((lon + 180) * 1e6) * 400_000_000 + F.round((lat + 90) * 1e6)).cast("long")


def junctions(vertices: DataFrame) -> DataFrame:
    """(vertex, uses, junction) of vertices(way, seq, vertex): used twice or more, or at an end of a way."""
    w = Window.partitionBy("way").orderBy("seq")
    ends = vertices.select("vertex", (F.lag("seq").over(w).isNull() | F.lead("seq").over(w).isNull()).alias("end"))
    return ends.groupBy("vertex").agg(F.count("*").alias("uses"), F.bool_or("end").alias("end")).select("vertex", "uses", (F.col("end") | (F.col("uses") >= 2)).alias("junction"))


def contract_roads(vertices: DataFrame) -> DataFrame:
    """(way, src, dst, len) of vertices(way, seq, vertex, lon, lat): ways cut at junctions, an edge for each stretch between.

    Loops and stretches without length go. Vertices of a way are ordered by ``seq``, which is unique within it.
    """
    w = Window.partitionBy("way").orderBy("seq")
    cut = vertices.join(junctions(vertices).select("vertex", "junction"), "vertex")
    step = g.haversine(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat"))
    run = cut.select("way", "seq", "vertex", "junction", F.coalesce(step, F.lit(0.0)).alias("step")).withColumn("at", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.last(F.when(F.col("junction"), F.struct("vertex", "at")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    edges = run.withColumn("since", before).where("junction and since is not null").select("way", F.col("since.vertex").alias("src"), F.col("vertex").alias("dst"), (F.col("at") - F.col("since.at")).alias("len"))
    return edges.where("src <> dst and len > 0")


def directed(ways: DataFrame) -> DataFrame:
    """Each row of ways(src, dst, oneway, junction, ...) as one or two directed rows; ``-1`` means backward only and wins."""
    back = F.coalesce(F.col("oneway") == "-1", F.lit(False))
    ahead = F.coalesce(F.col("oneway").isin("yes", "1", "true"), F.lit(False)) | F.coalesce(F.col("junction") == "roundabout", F.lit(False))
    sides = F.when(back, F.array(F.lit(False))).when(ahead, F.array(F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False)))
    rows = ways.withColumn("_ahead", F.explode(sides))
    return rows.withColumns({"src": F.when(F.col("_ahead"), F.col("src")).otherwise(F.col("dst")), "dst": F.when(F.col("_ahead"), F.col("dst")).otherwise(F.col("src"))}).drop("_ahead")


def _hashed(seed: int, k: int, *columns: str) -> Column:
    """A number in [0, 1) of the seed and a row's columns, the same however rows are partitioned."""
    return F.pmod(F.xxhash64(*columns, F.lit(seed * 100 + k)), F.lit(1_000_003)) / 1_000_003.0


def grid_roads(spark: SparkSession, side: int, seed: int = 1) -> DataFrame:
    """(src, dst, w, hw, seconds, cap) of a side x side grid: two-way streets of 80 to 400 metres and classes 3 to 7, the
    lesser ones more often, with their travel time and capacity; all by a hash of the seed and the street."""
    cells = spark.range(side * side).withColumns({"x": F.col("id") % side, "y": F.floor(F.col("id") / side)})
    east = cells.where(f"x < {side - 1}").select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    north = cells.where(f"y < {side - 1}").select(F.col("id").alias("u"), (F.col("id") + side).alias("v"))
    kind = F.aggregate(F.array(*map(F.lit, (0.1, 0.25, 0.45, 0.7))), F.lit(3), lambda a, e: a + (_hashed(seed, 2, "u", "v") >= e).cast("int"))
    streets = east.union(north).select("u", "v", (80 + 320 * _hashed(seed, 1, "u", "v")).alias("w"), kind.alias("hw"))
    streets = streets.withColumns({"seconds": travel_seconds(F.col("w"), F.col("hw")), "cap": class_capacity(F.col("hw"))})
    rest = ["w", "hw", "seconds", "cap"]
    return streets.select(F.col("u").alias("src"), F.col("v").alias("dst"), *rest).union(streets.select("v", "u", *rest))


def stations(spark: SparkSession, n: int = 30, seed: int = 1, extent: float = 18_000) -> DataFrame:
    """(id, x, y, type, units): fire, ambulance and police stations in turn, with one to four units."""
    kind = F.element_at(F.array(*map(F.lit, ("fire", "ambulance", "police"))), (F.col("id") % 3 + 1).cast("int"))
    return spark.range(n).select("id", (_hashed(seed, 31, "id") * extent).alias("x"), (_hashed(seed, 32, "id") * extent).alias("y"), kind.alias("type"), (1 + F.floor(_hashed(seed, 33, "id") * 4)).cast("int").alias("units"))


def hospitals(spark: SparkSession, n: int = 20, seed: int = 1, extent: float = 18_000) -> DataFrame:
    """(id, x, y, beds) with 50 to 500 beds."""
    return spark.range(n).select("id", (_hashed(seed, 41, "id") * extent).alias("x"), (_hashed(seed, 42, "id") * extent).alias("y"), (50 + F.floor(_hashed(seed, 43, "id") * 451)).cast("int").alias("beds"))


def incidents(spark: SparkSession, n: int, days: int = 10, seed: int = 1, spots: int = 6, storm: tuple[int, int] = (8, 9)) -> DataFrame:
    """(id, minute, x, y, severity, demand, text): incidents around ``spots`` hot spots, rarer at night and thrice as dense on storm days.

    Every value is a hash of the seed and the row, so a row is the same however the range is partitioned.
    """
    u = lambda k: _hashed(seed, k, "id")
    gauss = lambda k: F.sqrt(-2 * F.ln(1 - u(k))) * F.cos(6.283185307179586 * u(k + 1))
    weights = [(d, h, (3.0 if storm[0] <= d <= storm[1] else 1.0) * (0.4 if h < 6 else 1.0)) for d in range(days) for h in range(24)]
    total, edges = 0.0, []
    for _, _, w in weights:
        edges.append(total)
        total += w
    slot = F.aggregate(F.array(*map(F.lit, edges)), F.lit(-1), lambda a, e: a + (u(1) * total >= e).cast("int"))
    spot = F.floor(u(2) * spots)
    rows = spark.range(n).withColumns({"minute": (slot * 60 + F.floor(u(3) * 60)).cast("long"), "x": spot * 3000 + 400 * gauss(4), "y": F.pmod(spot * 5, F.lit(spots)) * 3000 + 400 * gauss(6), "severity": (1 + F.floor(u(8) * 5)).cast("int"), "demand": (1 + F.floor(u(9) * 40)).cast("int")})
    calls = [
        "INC%1$d flooding reported near spot %2$d, %3$d people need help, severity %4$d",
        "INC%1$d caller at spot %2$d says water is rising, %3$d people on the roof, severity %4$d",
        "INC%1$d severity %4$d fire close to spot %2$d with about %3$d people inside",
    ]
    said = [F.format_string(c, F.col("id"), spot, F.col("demand"), F.col("severity")) for c in calls]
    return rows.withColumn("text", F.element_at(F.array(*said), (1 + F.floor(u(10) * len(calls))).cast("int")))


def call_logs(calls: DataFrame, share: float = 0.15, seed: int = 1) -> DataFrame:
    """(id, incident_id, text, is_duplicate, dup_of): every incident's call, and for about ``share`` of them a second one under
    a number of its own in which words have been left out or written twice."""
    first = calls.select(F.col("id").alias("incident_id"), "text", F.lit(False).alias("is_duplicate"), F.lit(None).cast("long").alias("dup_of"))
    word = lambda w, k: F.when(F.pmod(F.xxhash64("id", k, F.lit(seed * 100 + 52)), F.lit(10)) == 0, F.lit("")).when(F.pmod(F.xxhash64("id", k, F.lit(seed * 100 + 53)), F.lit(12)) == 0, F.concat(w, F.lit(" "), w)).otherwise(w)
    noisy = F.array_join(F.filter(F.transform(F.split("text", " "), lambda w, k: F.when(k == 0, w).otherwise(word(w, k))), lambda w: w != ""), " ")
    again = calls.where(_hashed(seed, 51, "id") < share).select(F.col("id").alias("incident_id"), noisy.alias("text"), F.lit(True).alias("is_duplicate"), F.col("id").alias("dup_of"))
    both = first.union(again)
    return both.select((F.col("incident_id") * 2 + F.col("is_duplicate").cast("long")).alias("id"), *both.columns)


def append_csv(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """Adds rows to a CSV folder; its columns become the union of old and new, with nulls where either has none."""
    spark = rows.sparkSession
    whole = rows.select([F.col(f"`{c}`").cast("string").alias(c) for c in rows.columns])
    if not overwrite:
        try:
            old = spark.read.option("header", True).csv(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        else:
            if set(rows.columns) <= set(old.columns):  # the files' columns stay, so new files do
                whole.select([F.col(f"`{c}`") if c in rows.columns else F.lit(None).cast("string").alias(c) for c in old.columns]).write.mode("append").option("header", True).csv(path)
                return
            # the new table is written in full beside the old one before it takes its place
            old.unionByName(whole, allowMissingColumns=True).write.mode("overwrite").option("header", True).csv(path + ".next")
            whole = spark.read.option("header", True).csv(path + ".next")
    whole.write.mode("overwrite").option("header", True).csv(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)
