"""URL filters: rules indexed by their rarest literal token; only fetched rules run their regular expression.

DataFrame functions only. Up to ``MAX_RULES`` rules the table's tokens are counted in one aggregate that is filtered to the
rules' own tokens first, and the index becomes a literal map, so a URL's verdict needs no shuffle: its tokens fetch
candidate rules from the map and each candidate's pattern is tried. More rules are a table: URLs and rules meet by token
in a join, to the same verdicts.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Rules that are a literal of the plan at most.
MAX_RULES = 20_000


@dataclass(frozen=True)
class Rule:
    """A verdict for URLs whose ``host + path`` part matches ``pattern``.

    ``tokens`` are lower-case runs of letters and digits that every matching URL holds as whole tokens. Of several
    matching rules the one with the greatest ``weight`` wins, then the earlier one.
    """

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...] = field(default=())
    weight: int = 0
    site: bool = True


def site_rule(verdict: str, site: str) -> Rule:
    """A rule ``host/path`` for a host, its subdomains and all paths that begin with the path; longer ones win."""
    host, slash, path = site.partition("/")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    full = host + slash + path
    # a run at the end of the path may go on in the URL, so it is no whole token
    runs = [m for m in re.finditer(r"[A-Za-z0-9]+", full) if m.end() < len(full)]
    lowered = tuple(dict.fromkeys(m[0].lower() for m in runs))
    if not lowered:
        raise ValueError(f"no literal token in {site!r}")
    return Rule(host + slash + path, verdict, rf"^(?:[^/?#]*\.)?{_quoted(host)}{_quoted(slash + path)}", lowered, len(full))


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in text)


def word_rule(verdict: str, word: str) -> Rule:
    """A rule of the method itself: a token anywhere in host or path; it ranks below every site rule and is not reported."""
    return Rule(word, verdict, rf"(?i)(?:^|[^A-Za-z0-9]){word}(?:$|[^A-Za-z0-9])", (word.lower(),), -1, False)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lowered) and path (then up to ``?`` or ``#``)."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _tokens() -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.concat("host", "path")), "[^a-z0-9]+"), lambda t: t != ""))


def filter_urls(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict, n_candidates), one row for each row of ``pages(id, url)``.

    A null URL, or one without ``://``, has empty host and path and gets the default verdict; so does a URL that no rule
    fits. Ids may be null or repeated; other columns are ignored; an empty table gives an empty result.
    """
    host, path = url_parts(F.col("url"))
    base = pages.select(F.col(id_col), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url")).select(id_col, host.alias("host"), path.alias("path"))
    if not rules:
        return base.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"), F.lit(0).alias("n_candidates"))
    ranked = sorted(range(len(rules)), key=lambda i: (-rules[i].weight, i))
    if len(rules) > MAX_RULES:
        return _by_table(base, [rules[i] for i in ranked], id_col, default)
    wanted = sorted({t for r in rules for t in r.tokens})
    # how many URLs hold each token of a rule: at most one row for each of the rules' tokens reaches the driver
    seen = dict(map(tuple, base.select(F.explode(_tokens()).alias("t")).where(F.col("t").isin(wanted)).groupBy("t").count().collect()))
    index: dict[str, list[int]] = {}
    for place, i in enumerate(ranked):
        index.setdefault(min(rules[i].tokens, key=lambda t: (seen.get(t, 0), t)), []).append(place)
    ordered = [rules[i] for i in ranked]
    literal = F.create_map(*[x for t, places in index.items() for x in (F.lit(t), F.array(*map(F.lit, places)))])
    row = base.withColumn("found", F.array_sort(F.flatten(F.filter(F.transform(F.filter(_tokens(), lambda t: t.isin(list(index))), lambda t: F.element_at(literal, t)), lambda x: x.isNotNull()))))
    patterns = F.array(*[F.lit(r.pattern) for r in ordered])
    # rules are in order of rank, so the first candidate whose pattern matches decides
    hit = F.filter("found", lambda i: F.regexp_like(F.concat("host", "path"), F.element_at(patterns, i + 1)))
    row = row.withColumn("hit", F.when(F.size("found") > 0, F.get(hit, F.lit(0))))
    at = lambda xs: F.element_at(F.array(*map(F.lit, xs)), F.col("hit") + 1)
    return row.select(
        id_col,
        "host",
        "path",
        F.when(F.col("hit").isNotNull(), F.element_at(F.array(*[F.lit(r.name if r.site else None).cast("string") for r in ordered]), F.col("hit") + 1)).alias("rule"),
        F.coalesce(F.when(F.col("hit").isNotNull(), at([r.verdict for r in ordered])), F.lit(default)).alias("verdict"),
        F.size("found").alias("n_candidates"),
    )


def _by_table(base: DataFrame, ranked: Sequence[Rule], id_col: str, default: str) -> DataFrame:
    """``filter_urls`` with the rules, in order of rank, as a table."""
    spark, scratch = base.sparkSession, Scratch(base.sparkSession)
    rows = scratch.write(base.withColumn("dk", F.monotonically_increasing_id()), "urls")
    given = [(k, r.name if r.site else None, r.verdict, r.pattern, list(r.tokens)) for k, r in enumerate(ranked)]
    rules = scratch.write(spark.createDataFrame(given, "place int, rule string, verdict string, pattern string, tokens array<string>"), "rules")
    words = scratch.write(rows.select("dk", F.explode(_tokens()).alias("t")), "words")
    own = rules.select("place", F.explode("tokens").alias("t"))
    seen = words.join(own.select("t").distinct(), "t", "left_semi").groupBy("t").count()
    rarest = own.join(seen, "t", "left").groupBy("place").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "t")).alias("m"))
    index = scratch.write(rarest.select("place", F.col("m.t").alias("t")), "index")
    found = words.join(index, "t").select("dk", "place").join(rules.select("place", "pattern"), "place")
    tried = rows.select("dk", F.concat("host", "path").alias("full")).join(found, "dk")
    hits = tried.groupBy("dk").agg(F.min(F.when(F.regexp_like("full", F.col("pattern")), F.col("place"))).alias("place"), F.count("*").cast("int").alias("n"))
    out = rows.join(hits, "dk", "left").join(rules.select("place", "rule", "verdict"), "place", "left")
    return out.select(id_col, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"), F.coalesce("n", F.lit(0)).alias("n_candidates"))
