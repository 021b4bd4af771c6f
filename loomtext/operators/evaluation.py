"""Measuring reductions: detection quality, medians, paired differences, recalled facts, intervals."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .context import folded

#: fixed values: the generator of the resampling and of the job order
MULTIPLIER, INCREMENT, START = 1664525, 1013904223, 0xB00757A9


def confusion(df: DataFrame, actual: Column, expected: Column) -> DataFrame:
    """One row: counts of (true, false) x (positive, negative), recall and specificity; a share of nothing is 0."""
    a, e = F.coalesce(actual, F.lit(False)), F.coalesce(expected, F.lit(False))
    out = df.agg(F.count_if(a & e).alias("true_positive"), F.count_if(~a & ~e).alias("true_negative"), F.count_if(a & ~e).alias("false_positive"), F.count_if(~a & e).alias("false_negative"))
    part = lambda x, y: F.when(F.col(x) + F.col(y) == 0, 0.0).otherwise(F.col(x) / (F.col(x) + F.col(y)))
    return out.withColumns({"recall": part("true_positive", "false_negative"), "specificity": part("true_negative", "false_positive")})


def upper_median(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, median): the middle value of each group's trials, the upper one of an even number. Groups are sorted one to a task, as trials are few."""
    w = Window.partitionBy(group)
    rows = df.where(F.col(value).isNotNull()).withColumn("__i", F.row_number().over(w.orderBy(value))).withColumn("__n", F.count("*").over(w))
    return rows.where(F.col("__i") == F.floor(F.col("__n") / 2) + 1).select(group, F.col(value).alias("median"))


def paired_differences(runs: DataFrame, trial: str, task: str, variant: str, value: str) -> DataFrame:
    """(trial, task, difference) optimized minus original, for pairs that have both; of repeated runs the smallest value counts."""
    both = runs.groupBy(trial, task).pivot(variant, ["original", "optimized"]).agg(F.min(value))
    return both.where("original IS NOT NULL AND optimized IS NOT NULL").select(trial, task, (F.col("optimized") - F.col("original")).alias("difference"))


def fact_recall(df: DataFrame, facts: Sequence[Sequence[str]], text: str = "text") -> DataFrame:
    """Adds ``found``, ``required``, ``recall`` and ``missing``: which facts a text states, each in one of its wordings.

    Texts are compared in NFKC and lower case, all but letters, numbers and ``:.-`` being one space; no facts are a recall of 1.
    """
    plain = F.regexp_replace(F.coalesce(folded(F.col(text)), F.lit("")), r"[^\p{L}\p{N}:.-]+", " ")
    stated = [reduce(Column.__or__, (F.contains("__plain", F.lower(F.lit(f))) for f in ways)) for ways in facts]
    missing = F.array_compact(F.array(*(F.when(~s, F.lit("|".join(ways))) for s, ways in zip(stated, facts)))) if facts else F.array().cast("array<string>")
    df = df.withColumn("__plain", plain).withColumn("missing", missing).withColumn("required", F.lit(len(facts))).drop("__plain")
    df = df.withColumn("found", F.col("required") - F.size("missing"))
    return df.withColumn("recall", F.lit(1.0) if not facts else F.col("found") / len(facts))


def occurrences(text: Column, value: str) -> Column:
    """How often ``value`` stands in a text, not counting overlaps."""
    return F.when(text.isNotNull(), ((F.length(text) - F.length(F.replace(text, F.lit(value), F.lit("")))) / len(value)).cast("int"))


def verified(df: DataFrame, text: str = "text", must: Sequence[str] = (), must_not: Sequence[str] = (), counts: dict[str, int] | None = None) -> DataFrame:
    """Adds ``success`` and ``faults``: strings that are missing, left over, or do not occur as often as they should."""
    t = F.coalesce(F.col(text), F.lit(""))
    checks = [F.when(~F.contains(t, F.lit(x)), F.lit(f"missing: {x}")) for x in must] + [F.when(F.contains(t, F.lit(x)), F.lit(f"left over: {x}")) for x in must_not]
    checks += [F.when(occurrences(t, x) != n, F.concat(F.lit(f"{x}: {n} expected, found "), occurrences(t, x).cast("string"))) for x, n in (counts or {}).items()]
    faults = F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")
    return df.withColumn("faults", faults).withColumn("success", F.size("faults") == 0)


def with_workload(df: DataFrame, tasks: DataFrame, key: str, workload: str = "workload") -> DataFrame:
    """``df`` with the workload of its task, or ``unclassified``; of tasks with one key the first name by code point counts."""
    named = tasks.groupBy(F.col(key).alias("__k")).agg(F.min(workload).alias("__w"))
    return df.join(named, F.col(key) == F.col("__k"), "left").withColumn(workload, F.coalesce("__w", F.lit("unclassified"))).drop("__k", "__w")


def bootstrap_interval(values: Sequence[float], rounds: int = 10_000) -> tuple[float, float]:
    """The 2.5 % and 97.5 % points of the means of resampled values (task means: few, on the driver); always the same for the same values."""
    if not values:
        return 0.0, 0.0
    state, means = START, []
    for _ in range(rounds):
        total = 0.0
        for _ in values:
            state = (state * MULTIPLIER + INCREMENT) % 2**32
            total += values[state % len(values)]
        means.append(total / len(values))
    means.sort()
    return means[int(rounds * 0.025)], means[int(rounds * 0.975)]


def shuffled(items: Sequence, seed: int) -> list:
    """A fixed random order of a few jobs for each seed."""
    out, state = list(items), seed % 2**32
    for i in reversed(range(1, len(out))):
        state = (state * MULTIPLIER + INCREMENT) % 2**32
        out[i], out[state % (i + 1)] = out[state % (i + 1)], out[i]
    return out
