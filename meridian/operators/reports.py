"""Near-equal reports by common subsequences of their tokens: candidates by rare tokens, then exact similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .rounds import Rounds


#: Similarities down to which best matches are looked for in turn; the last takes every pair that shares a token.
LEVELS = (0.75, 0.5, 0.25, 0.0)


def _tokens(reports: DataFrame, id_col: str, text_col: str, bucket: str | None) -> DataFrame:
    """(i, bucket, t, first): token lists without report ids; ``first`` is the smallest id of the same list and bucket."""
    own = F.col(bucket).cast("string") if bucket else F.lit("")
    rows = reports.select(F.col(id_col).alias("i"), F.coalesce(own, F.lit("")).alias("bucket"), text.strip_report_ids(text.report_tokens(F.coalesce(F.col(text_col), F.lit("")))).alias("t"))
    return Rounds(reports.sparkSession).keep(rows.withColumn("first", F.min("i").over(Window.partitionBy("bucket", "t"))))


def _ranked(lists: DataFrame, rounds: Rounds) -> DataFrame:
    """(i, bucket, w, nth, n, rank): each list's tokens, an nth copy of its own, by their number over all lists, rarest first."""
    w = Window.partitionBy("i", "w").orderBy("p")
    words = lists.select("i", "bucket", F.size("t").alias("n"), F.posexplode("t").alias("p", "w")).withColumn("nth", F.row_number().over(w))
    often = words.groupBy("bucket", "w", "nth").agg(F.count("*").alias("often"))
    rank = F.row_number().over(Window.partitionBy("i").orderBy("often", "w", "nth"))
    return rounds.keep(words.join(often, ["bucket", "w", "nth"]).select("i", "bucket", "w", "nth", "n", rank.alias("rank")))


def _pairs(lists: DataFrame, ranked: DataFrame, rounds: Rounds, shared: float, ratio: float, of: DataFrame | None = None) -> DataFrame:
    """(i, j, sim): pairs i < j of one bucket, all of those whose similarity is ``shared`` or more (more than 0 if that is 0)
    and whose lengths' ratio is ``ratio`` or more; of(j) restricts the later ones.

    A pair of similarity ``shared`` shares a token within each list's first n - ceil(shared n) + 1 tokens, rarest first.
    """
    keys = ranked.where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * shared - 1e-9) + 1)
    keys = rounds.keep(keys.select("i", "bucket", "w", "nth", "n"))
    other = keys.select(F.col("i").alias("j"), "bucket", "w", "nth", F.col("n").alias("m"))
    if of is not None:
        other = other.join(of, "j", "left_semi")
    near = keys.join(other, ["bucket", "w", "nth"]).where("i < j").where(F.least("n", "m") >= F.greatest("n", "m") * ratio).select("i", "j").distinct()
    tokens = lists.select("i", "t")
    both = near.join(tokens.toDF("i", "ti"), "i").join(tokens.toDF("j", "tj"), "j")
    return both.select("i", "j", text.similarity(F.col("ti"), F.col("tj")).alias("sim")).where(F.col("sim") >= shared if shared else F.col("sim") > 0)


def dedupe_reports(reports: DataFrame, id_col: str, text_col: str, threshold: float = 0.75, bucket: str | None = None) -> DataFrame:
    """(id, dup_of): the earliest original report of the same bucket with similarity ``threshold`` or more; null for originals.

    Reports go by id. Equal token lists are one report until the end: only the first of them can be an original. The
    others are settled in rounds, each from reports all of whose earlier links are settled. Empty reports are originals.
    """
    lists = _tokens(reports, id_col, text_col, bucket)
    full = lists.where(F.size("t") > 0)
    rounds, firsts = Rounds(reports.sparkSession), full.where("i = first")
    links = rounds.keep(_pairs(firsts, _ranked(firsts, rounds), rounds, threshold, threshold).select("i", "j"))
    state = rounds.keep(firsts.select("i", F.lit(None).cast("boolean").alias("dup")))
    while True:
        before = links.join(state.toDF("i", "d"), "i").groupBy("j").agg(F.bool_or(~F.col("d")).alias("hit"), F.bool_and(F.coalesce("d", F.lit(False))).alias("free"))
        after = state.join(before.withColumnRenamed("j", "i"), "i", "left")
        now = F.when(F.col("hit"), True).when(F.coalesce("free", F.lit(True)), False)
        state = rounds.keep(after.select("i", F.coalesce("dup", now).alias("dup")))
        if state.where("dup is null").isEmpty():
            break
    original = links.join(state.where("not dup").select("i"), "i", "left_semi").groupBy("j").agg(F.min("i").alias("o"))
    firsts = state.join(original.withColumnRenamed("j", "i"), "i", "left").select(F.col("i").alias("first"), "o", F.lit(True).alias("full"))
    out = lists.select("i", "first").join(firsts, "first", "left").join(full.select("i", F.lit(True).alias("words")), "i", "left")
    copy = F.when(F.col("words") & (F.col("i") != F.col("first")), F.col("first"))
    return out.select(F.col("i").alias(id_col), F.when(F.col("words"), F.coalesce("o", copy)).alias("dup_of"))


def best_matches(reports: DataFrame, id_col: str, text_col: str, min_ratio: float = 0.5) -> DataFrame:
    """(id, best, similarity): the most similar earlier report whose length is within ``min_ratio``; the earliest on ties, null and 0 if none."""
    lists = _tokens(reports, id_col, text_col, None)
    rounds, firsts = Rounds(reports.sparkSession), lists.where(F.size("t") > 0).where("i = first")
    ranked = _ranked(firsts, rounds)
    # from high similarities down: who has found a match at a level has its best one among them
    open_, found = rounds.keep(firsts.select(F.col("i").alias("j"))), []
    for level in LEVELS:
        pairs = _pairs(firsts, ranked, rounds, level, min_ratio, open_)
        own = rounds.keep(pairs.groupBy("j").agg(F.min(F.struct((-F.col("sim")).alias("s"), "i")).alias("m")))
        found.append(own)
        open_ = rounds.keep(open_.join(own, "j", "left_anti"))
        if open_.isEmpty():
            break
    top = found[0]
    for x in found[1:]:
        top = top.union(x)
    top = top.select(F.col("j").alias("i"), F.col("m.i").alias("best"), (-F.col("m.s")).alias("similarity"))
    copy = (F.col("i") != F.col("first")) & (F.size("t") > 0)
    out = lists.join(top, "i", "left")
    return out.select(F.col("i").alias(id_col), F.when(copy, F.col("first")).otherwise(F.col("best")).alias("best"), F.when(copy, 1.0).otherwise(F.coalesce("similarity", F.lit(0.0))).alias("similarity"))


def precision_recall(flagged: DataFrame, score: str, truth: str, thresholds: list[float]) -> DataFrame:
    """(threshold, flagged, precision, recall) in one pass, one pair of sums for each threshold."""
    sums = [F.sum(F.when(F.col(score) >= t, 1).otherwise(0)).alias(f"f{k}") for k, t in enumerate(thresholds)]
    hits = [F.sum(F.when((F.col(score) >= t) & F.col(truth), 1).otherwise(0)).alias(f"h{k}") for k, t in enumerate(thresholds)]
    one = flagged.agg(F.sum(F.when(F.col(truth), 1).otherwise(0)).alias("all"), *sums, *hits)
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.coalesce(f"f{k}", F.lit(0)).alias("flagged"), F.coalesce(f"h{k}", F.lit(0)).alias("hits")) for k, t in enumerate(thresholds)])
    each = one.select("all", F.explode(rows).alias("r")).select("r.*", "all")
    return each.select("threshold", "flagged", (F.col("hits") / F.greatest(F.lit(1), "flagged")).alias("precision"), (F.col("hits") / F.greatest(F.lit(1), F.coalesce("all", F.lit(0)))).alias("recall"))


def flagged_top(matches: DataFrame, threshold: float, k: int = 6) -> DataFrame:
    """The k reports of greatest similarity of ``best_matches`` that reach ``threshold``, by id on ties of it."""
    id_col = matches.columns[0]
    return matches.where(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), id_col).limit(k)
