"""Text functions: tokens, code points, overlapping search, snippets, common subsequences, and words for numbers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def report_tokens(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9; every other character separates."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def strip_report_ids(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.rlike("^inc[0-9]+$"))


def overlapping_count(text: Column, pattern: str) -> Column:
    """Occurrences of a literal, overlapping ones too; none for the empty pattern."""
    if not pattern:
        return F.when(text.isNotNull(), F.lit(0))
    return F.regexp_count(text, F.lit("(?=" + "".join(c if c.isalnum() else "\\" + c for c in pattern) + ")"))


def code_points(text: Column) -> Column:
    """The Unicode number of every character."""
    return F.transform(F.regexp_extract_all(F.hex(F.encode(text, "UTF-32")), F.lit("(.{8})")), lambda c: F.conv(c, 16, 10).cast("int"))


def snippet(text: Column, start: Column, length: int, around: int = 35) -> Column:
    """The characters from ``around`` before a 1-based start to ``around`` after what is ``length`` long."""
    first = F.greatest(F.lit(1), start - around)
    return F.substring(text, first, start + F.lit(length + around) - first)


def about_minutes(seconds: Column) -> Column:
    """``about 5 minutes``: half a minute rounds to the even number."""
    minutes = F.bround(seconds / 60, 0).cast("long")
    return F.when(minutes < 1, "less than a minute").otherwise(F.concat(F.lit("about "), count_noun(minutes, "minute")))


def count_noun(n: Column, one: str, many: str | None = None) -> Column:
    """``1 unit``, ``2 units``, ``1,200 units``."""
    return F.concat(F.format_number(n, 0), F.lit(" "), F.when(n == 1, one).otherwise(many or one + "s"))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def pattern_borders(patterns: pd.Series) -> pd.Series:
    """``border_lengths`` of a text column."""
    return patterns.map(lambda p: None if p is None else border_lengths(p))


def search(text: str, pattern: str) -> tuple[list[int], int]:
    """(1-based starts of a literal, overlapping ones too; characters compared), by the pattern's borders."""
    if not pattern or len(pattern) > len(text):
        return [], 0
    borders, starts, compared, k = border_lengths(pattern), [], 0, 0
    for i, c in enumerate(text):
        while True:
            compared += 1
            if pattern[k] == c:
                k += 1
                break
            if not k:
                break
            k = borders[k - 1]
        if k == len(pattern):
            starts.append(i - k + 2)
            k = borders[k - 1]
    return starts, compared


def search_effort(pattern: str):
    """A function of a text column: struct<starts array<int>, compared int> of ``search``."""

    @F.pandas_udf("starts array<int>, compared int")
    def find(texts: pd.Series) -> pd.DataFrame:
        out = [(None, None) if t is None else search(t, pattern) for t in texts]
        return pd.DataFrame({"starts": [x[0] for x in out], "compared": pd.array([x[1] for x in out], dtype="Int32")})

    return find


def border_lengths(pattern: str) -> list[int]:
    """For each prefix, the length of its longest proper border."""
    out: list[int] = []
    for i, c in enumerate(pattern):
        k = out[-1] if out else 0
        while k and pattern[k] != c:
            k = out[k - 1]
        out.append(k + 1 if i and pattern[k] == c else 0)
    return out


def overlapping_positions(pattern: str):
    """A function of a text column: the 1-based starts of a literal, overlapping ones too."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def find(texts: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            out, at = [], text.find(pattern) if pattern else -1
            while at >= 0:
                out.append(at + 1)
                at = text.find(pattern, at + 1)
            return out

        return texts.map(one)

    return find


def common_length(a, b) -> int:
    """Length of a longest common subsequence, by rows of the dynamic programme."""
    if len(a) < len(b):
        a, b = b, a
    row = [0] * (len(b) + 1)
    for x in a:
        corner = 0
        for j, y in enumerate(b, 1):
            up = row[j]
            row[j] = corner + 1 if x == y else max(up, row[j - 1])
            corner = up
    return row[-1]


def common_subsequence(a, b) -> list:
    """One longest common subsequence; going back, up is preferred on ties."""
    table = [[0] * (len(b) + 1)]
    for x in a:
        above = table[-1]
        row = [0]
        for j, y in enumerate(b, 1):
            row.append(above[j - 1] + 1 if x == y else max(above[j], row[-1]))
        table.append(row)
    i, j, out = len(a), len(b), []
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.append(a[i - 1])
            i, j = i - 1, j - 1
        elif table[i - 1][j] >= table[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


@F.pandas_udf(T.IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([common_length(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="int32")


@F.pandas_udf(T.ArrayType(T.StringType()))
def lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    """``common_subsequence`` of two array columns."""
    return pd.Series([common_subsequence(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype=object)


def similarity(a: Column, b: Column) -> Column:
    """Common subsequence over the longer list; two empty lists are equal."""
    longer = F.greatest(F.size(a), F.size(b))
    return F.when(longer == 0, 1.0).otherwise(lcs_length(a, b) / longer)
