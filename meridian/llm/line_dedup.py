"""Line dedup by a log-template tree of fixed depth. DataFrame functions only.

A line's tokens lead it down the tree: token count, then its first ``depth`` tokens, with tokens that hold a digit already
generalised to ``<*>``. A leaf holds any number of templates: forms that agree in at least ``similarity`` of their
positions are one, over any chain of such forms, and the positions in which they differ are its variable fields, however
common one value is. A leading token is generalised too where its node has ``children`` or more children that lead to
lines equal in all else (lines of ``WILD_TOKENS`` tokens and more). A template found in two documents recurs: its lines
are dropped from every document but the first.

A leaf's tokens are looked at only where the leaf holds several forms. Minima and maxima are taken before any shuffle; a line that all documents share is one row for each task, and its lines come back by a join
that may be split. Every step takes time in proportion to a line's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linking import linked_groups
from .scratch import Scratch, stable

FIELD = "<*>"
#: Leaves (8 bytes each) that are broadcast at most; more of them join by shuffle.
BROADCAST_LEAVES = 1_000_000
#: Lines of fewer tokens keep their leading tokens: one field would leave too little that is fixed.
WILD_TOKENS = 5


def _flat(text: Column) -> Column:
    """Tokens by single spaces; texts that are so already, as most are, are only looked through."""
    return F.when(text.rlike(r"[\t\r\u000b\f]|  "), F.regexp_replace(text, r"[\t\r\u000b\f ]+", " ")).otherwise(text)


def _masked(line: Column) -> Column:
    """A line with the tokens that hold a digit generalised."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", FIELD)).otherwise(line)


def _once(value: Column) -> Column:
    """``value`` as a generated column: worked out once a row, however often it is read, and not again below a filter."""
    return F.explode(F.array(value))


def _wild(depth: int) -> list[Column]:
    """For each leading place, a key of the form without its token there; ``t`` holds the leading tokens and the rest."""
    return [F.xxhash64(F.lit(p), "size", *[F.get("t", F.lit(k)) for k in range(depth + 1) if k != p]) for p in range(depth)]


def tag_lines(docs: DataFrame, scratch: Scratch, depth: int = 3, similarity: float = 0.7, min_tokens: int = 1, children: int = 4) -> DataFrame:
    """(dk, i): the lines to drop of ``docs(dk, text)``; i counts from 0."""
    lines = docs.select("dk", F.posexplode(F.split(_flat(F.col("text")), "\n")).alias("i", "line")).select("dk", "i", _once(_masked(F.trim("line"))).alias("form"))
    lines = lines.where(f"form not in ('', '{FIELD}')").select("dk", "i", "form", _once(F.split("form", " ", depth + 1)).alias("t"))
    rest = F.get("t", F.lit(depth))
    size = F.size("t") + F.when(F.size("t") <= depth, 0).otherwise(F.length(rest) - F.length(F.replace(rest, F.lit(" "), F.lit(""))))
    lines = lines.select("dk", "i", "form", "t", size.alias("size")).where(f"size >= {int(min_tokens)}")
    even = lambda c: F.shiftleft(c, 1)  # noqa: E731 - leaves have even keys, nodes without one token odd ones
    leaf = even(F.xxhash64("size", *[F.get("t", F.lit(k)) for k in range(depth)]))
    wild = F.when(F.col("size") >= max(WILD_TOKENS, depth + 1), F.array(leaf, *[even(w) + 1 for w in _wild(depth)])).otherwise(F.array(leaf))
    lines = scratch.write(lines.select("dk", "i", wild.alias("keys"), F.xxhash64("form").alias("tmpl"), "form"), "lines")
    digests = lines.select("dk", "i", "tmpl")
    # leaves, and nodes without one leading token, that hold several forms
    keyed = lines.select("tmpl", F.explode("keys").alias("key"))
    held = scratch.write(keyed.groupBy("key").agg(F.min("tmpl").alias("u"), F.max("tmpl").alias("last")).where("u <> last").select("key", "u"), "nodes")
    leaves, nodes = held.where("key & 1 = 0").select(F.col("key").alias("leaf")), held.where("key & 1 = 1")
    leaves = F.broadcast(leaves) if leaves.count() <= BROADCAST_LEAVES else leaves
    # one line of each form of such a leaf: which are alike?
    spread = lines.select(F.get("keys", F.lit(0)).alias("leaf"), "tmpl", "form").join(leaves, "leaf", "left_semi").groupBy("tmpl").agg(F.first("leaf").alias("leaf"), F.first("form").alias("form"))
    spread = scratch.write(spread.select("leaf", "tmpl", F.split("form", " ").alias("t")).withColumn("size", F.size("t")), "spread")
    # forms that differ in one leading token only, where that token has many values
    members = scratch.write(keyed.where("key & 1 = 1").join(nodes, "key").distinct(), "members")
    many = scratch.write(members.groupBy("key").count().where(f"count >= {int(children)}").select("key"), "many")
    fields = scratch.write(members.join(many, "key", "left_semi").where("tmpl <> u").select("u", F.col("tmpl").alias("v")).distinct(), "fields")
    segments = scratch.write(_segments(spread, depth, similarity), "segments")
    merged = linked_groups(segments, lambda pairs: _alike(pairs, spread, similarity), scratch, fields)
    merged = scratch.write(merged.select(F.col("node").alias("tmpl"), "component"), "merged")
    shared = digests.join(merged.hint("shuffle_merge"), "tmpl", "left").select("dk", "i", F.when(F.col("component").isNotNull(), F.xxhash64("component", F.lit(FIELD))).otherwise(F.col("tmpl")).alias("tmpl"))
    shared = scratch.write(shared, "shared")  # read twice below
    recurring = shared.groupBy("tmpl").agg(F.min("dk").alias("keeper"), F.max("dk").alias("last")).where("last <> keeper").select("tmpl", "keeper")
    recurring = scratch.write(recurring, "recurring")  # a scan: a hot template's partition may be split in the join
    return shared.join(recurring.hint("shuffle_merge"), "tmpl").where("dk <> keeper").select("dk", "i")  # alike at every size, as above


def _segments(spread: DataFrame, depth: int, similarity: float) -> DataFrame:
    """(key, node): two forms of a leaf that differ in at most ``most`` tokens share one of ``most + 1`` segments of the rest."""
    rows = spread.select("leaf", F.col("tmpl").alias("node"), "t", _most("size", similarity).alias("most"), F.greatest(F.col("size") - depth, F.lit(0)).alias("rest"))
    rows = rows.withColumn("parts", F.when(F.col("rest") <= F.col("most"), 1).otherwise(F.col("most") + 1))  # 1: any two forms of the leaf are alike

    def key(s: Column) -> Column:
        start, stop = (F.floor(x * F.col("rest") / F.col("parts")).cast("int") for x in (s, s + 1))
        return F.xxhash64("leaf", s, F.when(F.col("parts") > 1, F.slice("t", start + (depth + 1), stop - start)))

    # hashed before they are dealt out, so that a row holds a hash and not the line
    return rows.select("node", F.transform(F.sequence(F.lit(0), F.col("parts") - 1), key).alias("keys")).select(F.explode("keys").alias("key"), "node")


def _most(size: str, similarity: float) -> Column:
    """Tokens in which two forms of ``size`` tokens may differ."""
    return F.floor(F.col(size) * (1 - similarity) + 1e-9).cast("int")


def _alike(pairs: DataFrame, spread: DataFrame, similarity: float) -> DataFrame:
    u, v = spread.select(F.col("tmpl").alias("u"), F.col("t").alias("a"), "size"), spread.select(F.col("tmpl").alias("v"), F.col("t").alias("b"), F.col("size").alias("other"))
    differ = F.size(F.filter(F.zip_with("a", "b", lambda x, y: ~x.eqNullSafe(y)), lambda x: x))
    # alike at every size: a small table of pairs would be broadcast and a larger one wouldn't
    return pairs.join(u.hint("shuffle_merge"), "u").join(v.hint("shuffle_merge"), "v").where((F.col("size") == F.col("other")) & (differ <= _most("size", similarity))).select("u", "v")


def drop_recurring_lines(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with recurring lines gone from ``text_col``, and n_lines, n_dropped.

    Lines end at newlines and keep their bytes and order. A line that is one lone number
    (a placeholder by itself) always stays, and so do lines of under ``min_tokens`` tokens. The first
    document of a template (by row order) keeps all its lines of it; repeated rows are documents of their own. A null text
    stays null with no lines, an empty one is one empty line. All columns stay, whatever their names.
    """
    scratch = Scratch(docs.sparkSession)
    docs = stable(docs, scratch)
    packed = docs.select(F.struct(F.lit(0).alias(text_col), *[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("dk", F.monotonically_increasing_id())
    gone = scratch.write(tag_lines(packed.where("text is not null").select("dk", "text"), scratch, **options), "gone").groupBy("dk").agg(F.collect_list("i").alias("gone"))
    out = packed.join(gone.hint("shuffle_merge"), "dk", "left")  # alike at every size: texts are shuffled once
    # the lines become a column once, and those that stay are picked by number
    out = out.withColumn("lines", F.explode(F.array(F.when(F.col("gone").isNotNull(), F.split("text", "\n")))))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone"), lambda i: F.get("lines", i))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    names = [text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns]
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    return out.select(*names, n_lines.alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).alias("n_dropped"))
