"""Native text expressions with the semantics of UTF-16 strings and their white space."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: fixed values: white space as the engine's texts define it
WHITE = r"\t\n\x0B\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
BLANK = r"\t\x0B\f \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
S, N, D = f"[{WHITE}]", f"[^{WHITE}]", r"[^\n\r\x{2028}\x{2029}]"
START, END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
MARKED = r"\[repeated \d+ times\]\z"
HIGH_SIGNAL = rf"(?i){START}(?:error|warning|failed?|lost|closed|dead-letter|retrying|acknowledged|status){END}"


def size16(t: Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.length(t) + F.regexp_count(t, F.lit(r"[\x{10000}-\x{10FFFF}]"))).cast("int")


def trim_white(t: Column) -> Column:
    return F.regexp_replace(t, rf"\A{S}++|{S}++\z", "")


def lines_of(t: Column) -> Column:
    return F.split(t, r"\r?\n", -1)


def eol_of(t: Column) -> Column:
    return F.when(F.contains(t, F.lit("\r\n")), F.lit("\r\n")).otherwise(F.lit("\n"))


def join_lines(parts: Column, eol: Column) -> Column:
    return F.when(eol == "\r\n", F.array_join(parts, "\r\n")).otherwise(F.array_join(parts, "\n"))


def percentage(removed: Column, total: Column, digits: int = 1) -> Column:
    """Share in percent, halves rounded up; 0 where the total is not positive."""
    scale = 10.0**digits
    # one product: 23 / 80 * 100 * 10 is just below a half that 23 / 80 * 1000 reaches
    return F.when(total <= 0, F.lit(0.0)).otherwise(F.floor(removed / total * (100 * scale) + 0.5) / scale)


def estimate_tokens(t: Column) -> Column:
    """Mean of characters / 4 and words, at least 1; 0 for an empty text."""
    # the wide class of white space is slow, and few texts have any beyond ASCII
    words = F.when(t.rlike(r"[\x{a0}\x{1680}-\x{feff}]"), F.regexp_count(t, F.lit(f"{N}++"))).otherwise(F.regexp_count(t, F.lit(r"[^\t-\r ]++")))
    raw = (size16(t) / 4 + words) / 2
    return F.when(t == "", F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(raw + 0.5))).cast("long")


#: what ``estimate_tokens`` is called where its figures are shown
ESTIMATE_NAME = "estimate from characters and words"


def counter(count: Callable[[str], int]) -> Callable[[Column], Column]:
    """A token counter over columns from one over strings, in Arrow batches; a null text has no count."""

    @F.pandas_udf(T.LongType())
    def counts(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else count(t) for t in texts], dtype="Int64")

    return counts


def from_encoder(encoder) -> Callable[[Column], Column]:
    """The counter of an object whose ``encode(text)`` gives the tokens."""
    return counter(lambda t: len(encoder.encode(t)))


def from_tokenizer(tokenizer) -> Callable[[Column], Column]:
    """The counter of an object whose ``tokenize(text)`` gives the tokens."""
    return counter(lambda t: len(tokenizer.tokenize(t)))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its scan has few splits (one small file); a large table stays as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < 2 * n else df


def run_bounds(n: Column, same) -> Column:
    """Runs of neighbours as array<struct<s, n>>; ``same(i)`` says whether item i continues the run of i - 1."""
    starts = F.when(n <= 0, F.array().cast("array<int>")).otherwise(F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | ~same(i)))
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.array(n))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("s"), (b - a).alias("n")))
