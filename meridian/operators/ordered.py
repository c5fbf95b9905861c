"""Running sums and ranks over one order of a whole table, in two levels: no window runs over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of the leading key at most: rows of the second level's window, which is one task.
BUCKETS = 10_000


def _bucketed(df: DataFrame, lead: str, descending: bool) -> DataFrame:
    """``df`` with _rs_b: the bucket of ``lead`` by approximate quantiles, in the direction of the order; nulls come first
    (last if descending). Equal leads share a bucket, so a bucket may be larger than others by its commonest lead."""
    spark = df.sparkSession
    n = min(BUCKETS, max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * 4))
    at = [k / n for k in range(1, n)]
    cuts = df.agg(F.array_sort(F.array_distinct(F.coalesce(F.percentile_approx(F.col(lead).cast("double"), at, 20 * n) if at else F.array().cast("array<double>"), F.array().cast("array<double>")))).alias("_rs_cuts"))
    # the number of cuts below, by halving
    place = F.expr(f"""aggregate(sequence(0, 14), named_struct('lo', 0, 'hi', size(_rs_cuts)),
      (s, k) -> if(s.lo >= s.hi, s, if(get(_rs_cuts, cast((s.lo + s.hi) div 2 as int)) < cast({lead} as double),
        named_struct('lo', cast((s.lo + s.hi) div 2 + 1 as int), 'hi', s.hi), named_struct('lo', s.lo, 'hi', cast((s.lo + s.hi) div 2 as int)))), s -> s.lo)""")
    place = F.when(F.col(lead).isNull(), -1).otherwise(place)
    return df.crossJoin(F.broadcast(cuts)).withColumn("_rs_b", -place if descending else place).drop("_rs_cuts")


def running_sum(df: DataFrame, order: list[str], value: str, name: str, descending: bool = False, inclusive: bool = False) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows before (and with ``inclusive`` the row itself) by ``order``.

    The first column of ``order`` is numeric; ``descending`` turns that one only. The order must tell rows apart.
    """
    cut = _bucketed(df, order[0], descending)
    keys = [F.desc(order[0]) if descending else F.asc(order[0]), *map(F.asc, order[1:])]
    own = Window.partitionBy("_rs_b").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    inner = cut.withColumn("_rs_in", F.coalesce(F.sum(value).over(own), F.lit(0)))
    sums = cut.groupBy("_rs_b").agg(F.sum(value).alias("_rs_sum"))
    before = sums.select("_rs_b", F.coalesce(F.sum("_rs_sum").over(Window.orderBy("_rs_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_rs_before"))
    return inner.join(F.broadcast(before), "_rs_b").withColumn(name, F.col("_rs_before") + F.col("_rs_in")).drop("_rs_b", "_rs_in", "_rs_before")


def sort_ranks(df: DataFrame, key: str, id_col: str, name: str = "rank") -> DataFrame:
    """``df`` with its place, from 1, in the stable ascending order of a numeric ``key``: ties go by ``id_col``."""
    counted = running_sum(df.withColumn("_one", F.lit(1).cast("long")), [key, id_col], "_one", name, inclusive=True)
    return counted.drop("_one")
