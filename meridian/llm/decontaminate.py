"""Benchmark decontamination by template canonicalisation. DataFrame functions only.

Numbers (words, fractions and sums such as 2+3 too), names and units become typed placeholders, so that a question with
other parameters keeps its template. A capitalised word may be a name or not (it may just begin a sentence), so windows that hold
one are looked up both ways, by the word and by a placeholder. Windows of ``words_each`` canonical tokens of benchmark and documents meet in a hash join; a
document holds an item if at least ``similarity`` of the item's windows occur in it. Where windows hold placeholders, their
slots must agree: within one alignment and reading an item's value stands for one value of the document throughout, and values that
differ in the item differ in the document; an alignment that fails counts only by its windows without placeholders.

Windows with fewer than ``LITERALS`` literal tokens (one, for an item of one token) fit anything and aren't looked up or
counted; an item that has no other is found by its raw tokens. An item of fewer than ``words_each`` words is one window of
what it has, and documents are cut at that length as well.

The benchmark's side is broadcast only when its windows were counted and are at most ``BROADCAST_WINDOWS``; a larger one
joins by shuffle, in which a document's window is three numbers. Document windows are hashed inside generated code; the
tokens are fetched for hits only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, stable

BROADCAST_WINDOWS = 200_000
LITERALS = 2
#: Unit words that follow a number, and number words.
UNITS = "km|m|cm|mm|mi|miles|meters|metres|kilometers|kg|g|mg|lb|lbs|pounds|ounces|oz|grams|l|ml|liters|litres|gallons|s|sec|seconds|min|minutes|h|hours|hrs|days|weeks|months|years|dollars|euros|cents|percent|mph|kmh|degrees"
NUMBER_WORDS = "zero|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|million|billion|half|third|quarter|dozen"
NUM, NAME, UNIT, TITLE = "\u0001", "\u0002", "\u0003", "\u0004"
_KINDS = f"[{NUM}{NAME}{UNIT}]"


def _word_pattern(words: str) -> str:
    """Any of the words, by their first letters, so that few are tried at each place."""
    by_first: dict[str, list[str]] = {}
    for w in words.split("|"):
        by_first.setdefault(w[0], []).append(w[1:])
    return "(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in sorted(by_first.items())) + ")"


def _with(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with ``value`` worked out once a row, however often it is read: a projection, then a generated column."""
    keep = [c for c in rows.columns if c != name]
    return rows.select(*keep, value.alias("_v")).select(*keep, F.explode(F.array("_v")).alias(name))


def _flat(text: Column) -> Column:
    """Words by single spaces; only what isn't so already is replaced."""
    clean = F.when(text.rlike(f"[{NUM}-{TITLE}]"), F.regexp_replace(text, f"[{NUM}-{TITLE}]", " ")).otherwise(text)
    return F.trim(F.regexp_replace(clean, r" ?[\x09-\x0D][\x20\x09-\x0D]*| {2,}[\x20\x09-\x0D]*", " "))


def _canonical(flat: Column) -> Column:
    """The canonical tokens of a flat text by single spaces, one for each raw token: lower case without punctuation,
    placeholders for numbers and units, and TITLE before a capitalised word."""
    marked = F.regexp_replace(flat, r"""(?=\p{Lu})(?<![^ "'(])(\p{Lu}\p{Ll}+)(?=$|[ .,;:!?'")])""", TITLE + "$1")
    plain = F.regexp_replace(F.lower(marked), r"""[.,;:!?"'()\[\]{}*#$%&|_-]+""", "")
    numbers = F.when(plain.rlike("[0-9]"), F.regexp_replace(plain, "[0-9]+", NUM)).otherwise(plain)
    words = F.regexp_replace(numbers, rf"(?<![^ ]){TITLE}?{_word_pattern(NUMBER_WORDS)}(?![^ ])", NUM)
    return F.when(words.contains(NUM), F.regexp_replace(words, rf"(?<={NUM})( ?)(?:{UNITS})(?= |$)", f"$1{UNIT}")).otherwise(words)


def tokens(rows: DataFrame, key: str) -> DataFrame:
    """(key, raw, canon, named): the raw tokens, and the canonical ones with capitalised words as words and as names."""
    flat = _with(rows.select(key, "text"), "flat", _flat(F.col("text"))).where("flat <> ''")
    both = _with(flat, "c", _canonical(F.col("flat")))
    return both.select(key, F.split("flat", " ").alias("raw"), F.split(F.replace("c", F.lit(TITLE), F.lit("")), " ").alias("canon"), F.split(F.regexp_replace("c", f"{TITLE}[^ ]*", NAME), " ").alias("named"))


def windows(cut: DataFrame, key: str, words_each: int) -> DataFrame:
    """(key, raw, canon, named, at, as_name, h) for every window and reading of ``cut``; a shorter text is one window."""
    at = cut.select(key, "raw", "canon", "named", F.explode(F.sequence(F.lit(0), F.greatest(F.size("canon") - words_each, F.lit(0)))).alias("at"))
    hashed = lambda name: F.xxhash64(*[F.get(name, F.col("at") + k) for k in range(words_each)])
    both = at.select(key, "raw", "canon", "named", "at", hashed("canon").alias("h"), hashed("named").alias("n"))
    each = F.posexplode(F.when(F.col("h") == F.col("n"), F.array("h")).otherwise(F.array("h", "n"))).alias("as_name", "h")
    return both.select(key, "raw", "canon", "named", "at", each)


def _reading(n: int) -> Column:
    """The canonical tokens of a window in its reading."""
    return F.slice(F.when(F.col("as_name") == 1, F.col("named")).otherwise(F.col("canon")), F.col("at") + 1, n)


def _raw_hash(words_each: int) -> Column:
    return F.xxhash64(*[F.get("raw", F.col("at") + k) for k in range(words_each)])


def _slots(n: int) -> Column:
    """(a, b) of the places of a window that are placeholders in the document's reading: the item's and the document's token."""
    end = r"^[\"'(]+|[.,;:!?\"')]+$"
    pair = lambda c, k: F.struct(c.rlike(_KINDS).alias("slot"), F.lower(F.regexp_replace(F.get("item_raw", k), end, "")).alias("a"), F.lower(F.regexp_replace(F.get("raw", F.col("at") + k), end, "")).alias("b"))
    held = F.filter(F.transform(_reading(n), pair), lambda s: s["slot"] & s["a"].isNotNull())
    return F.transform(held, lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b")))


def _hits(docs: DataFrame, side: DataFrame, n: int, raw: bool, few: bool) -> DataFrame:
    """(dk, item, item_at, shift, as_name, slots) of windows of ``n`` tokens that documents share with ``side``; ``few``: broadcast it."""
    cut = windows(tokens(docs, "dk"), "dk", n)
    if raw:
        met = cut.where("as_name = 0").withColumn("h", _raw_hash(n)).select("dk", "at", "h").join(F.broadcast(side) if few else side, "h")
        return met.select("dk", "item", "item_at", (F.col("at") - F.col("item_at")).alias("shift"), F.lit(0).alias("as_name"), F.expr("cast(array() as array<struct<a: string, b: string>>)").alias("slots"))
    if few:
        met = cut.join(F.broadcast(side), "h")
    else:
        found = cut.select("dk", "at", "as_name", "h").join(side, "h").groupBy("dk").agg(F.collect_list(F.struct("at", "as_name", "item", "item_at", "item_raw")).alias("found"))
        met = tokens(docs.join(found.select("dk"), "dk", "left_semi"), "dk").join(found, "dk").select("dk", "raw", "canon", "named", F.explode("found").alias("f")).select("dk", "raw", "canon", "named", "f.*")
    return met.select("dk", "item", "item_at", (F.col("at") - F.col("item_at")).alias("shift"), "as_name", _slots(n).alias("slots"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, words_each: int = 5, similarity: float = 0.8, scratch: Scratch | None = None) -> DataFrame:
    """(dk, item, matched, n_windows, consistent): the items that ``docs(dk, text)`` hold, of ``benchmark(item, text)``.

    Null texts and blank ones hold nothing and aren't items. Items of equal text are one, the smallest; a row of
    ``docs`` holds an item once, however often its text does. ``docs`` has a ``dk`` of its own for each row.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    texts = benchmark.where("text is not null").groupBy("text").agg(F.min("item").alias("item"))
    every = windows(tokens(texts, "item"), "item", words_each)
    own = F.slice("raw", F.col("at") + 1, words_each).alias("item_raw")
    literals = F.size(F.filter(_reading(words_each), lambda t: ~t.rlike(_KINDS) & (t != "")))
    bench = scratch.write(every.where(literals >= F.least(F.size("canon"), F.lit(LITERALS))).dropDuplicates(["item", "at", "h"]).select("item", F.col("at").alias("item_at"), "h", own), "bench")
    # items whose windows hold too few literals are found by their raw tokens
    bare = every.where("as_name = 0").join(bench.select("item").distinct(), "item", "left_anti").withColumn("h", _raw_hash(words_each))
    bare = scratch.write(bare.select("item", F.col("at").alias("item_at"), "h", own), "bare")
    sizes = scratch.write(bench.union(bare).groupBy("item").agg(F.countDistinct("item_at").alias("n_windows")), "sizes")
    hits = None
    for side, raw in ((bench, False), (bare, True)):
        rows = side.count()
        if not rows and raw:
            continue
        # an item of fewer words is one shorter window, so documents are cut at its length too
        short = [r[0] for r in side.select(F.size("item_raw")).distinct().collect() if r[0] < words_each]
        for n in [words_each, *sorted(short)]:
            found = _hits(docs, side if n == words_each else side.where(F.size("item_raw") == n), n, raw, rows <= BROADCAST_WINDOWS)
            hits = found if hits is None else hits.unionByName(found)
    hits = scratch.write(hits.distinct(), "hits")
    # slots of one alignment and reading: as many values on either side as pairs of values
    pairs = hits.select("dk", "item", "shift", "as_name", F.explode("slots").alias("s")).distinct()
    agreed = pairs.groupBy("dk", "item", "shift", "as_name").agg((F.greatest(F.count("*") - F.countDistinct("s.a"), F.count("*") - F.countDistinct("s.b")) == 0).alias("agrees"))
    judged = hits.join(agreed, ["dk", "item", "shift", "as_name"], "left").withColumn("ok", (F.size("slots") == 0) | F.coalesce("agrees", F.lit(True)))
    found = judged.groupBy("dk", "item").agg(F.countDistinct(F.when(F.col("ok"), F.col("item_at"))).alias("matched"), F.min("ok").alias("consistent"))
    return found.join(sizes, "item").where(F.col("matched") >= similarity * F.col("n_windows")).select("dk", "item", "matched", "n_windows", "consistent")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", **options) -> DataFrame:
    """(id, item, matched, n_windows): a row for each document and benchmark item that it holds; none for clean documents.

    Null, empty and blank texts hold nothing and are no items; equal benchmark texts are one item (the smallest id).
    Repeated document rows repeat theirs. Other columns of either table are ignored; an empty one gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    rows = stable(docs.select(F.col(id_col).alias("id"), F.col("text").cast("string").alias("text")), scratch).withColumn("dk", F.monotonically_increasing_id())
    bench = benchmark.select(F.col(item_col).alias("item"), F.col("text").cast("string").alias("text"))
    found = find_contamination(rows.where("text is not null").select("dk", "text"), bench, scratch=scratch, **options)
    return rows.select("dk", "id").join(found, "dk").select(F.col("id").alias(id_col), F.col("item").alias(item_col), "matched", "n_windows")
