"""Sources and sinks: whole-text files, JSON envelopes, workload reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import percentage


def read_texts(spark: SparkSession, path: str, max_bytes: int = 16 << 20) -> DataFrame:
    """(path, length, text): one row per file, invalid UTF-8 replaced; a file beyond ``max_bytes`` fails the query."""
    files = spark.read.format("binaryFile").load(path)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return files.select("path", "length", F.when(F.col("length") > max_bytes, F.raise_error(F.lit(f"input-limit: more than {max_bytes} bytes")).cast("string")).otherwise(text).alias("text"))


def write_texts(df: DataFrame, path: str, text: str = "optimized_text") -> None:
    """One line-free text per row as Parquet; refuses a path that is there."""
    df.select(text).write.mode("errorifexists").parquet(path)


def envelope(original: str = "text", optimized: str = "optimized_text", include_text: bool = True, version: int = 2, preset: str = "safe", checked: bool = False) -> Column:
    """The JSON report of one row of ``optimize``; fields without a value are left out.

    Version 1 has the text at the top; version 2 has it in ``output``, and the result of ``policy`` (with ``checked``: its ``passed`` and ``failures``).
    """
    if version not in (1, 2):
        raise ValueError("version must be 1 or 2")
    a, b = F.octet_length(original), F.octet_length(optimized)
    size = F.struct(a.alias("original"), b.alias("optimized"), (a - b).alias("removed"), percentage(a - b, a, 2).alias("reductionPercentage"))
    stats = F.struct(*(F.col(f"stats.{x}").alias(x.split("_")[0] + "".join(w.title() for w in x.split("_")[1:])) for x in ("original_characters", "optimized_characters", "characters_removed", "reduction_percentage")), "transformations", "detection", "decisions")
    shown = F.when(F.lit(include_text), F.col(optimized))
    parts = [F.lit(version).alias("schemaVersion"), F.lit(preset).alias("preset"), size.alias("bytes"), stats.alias("stats")]
    if version == 1:
        return F.to_json(F.struct(*parts, shown.alias("text")))
    result = [F.col("passed").alias("passed"), F.col("failures").alias("failures")] if checked else [F.lit(True).alias("passed"), F.array().cast("array<string>").alias("failures")]
    return F.to_json(F.struct(*parts, F.struct(F.lit(include_text).alias("included"), shown.alias("text")).alias("output"), F.struct(F.lit(checked).alias("checked"), *result).alias("policy")))


def workload_report(df: DataFrame, workload: str = "workload", preset: str = "preset") -> DataFrame:
    """Sums by workload and preset, by preset, and over all; null marks a total."""
    keys = [F.col(workload), F.col(preset)]
    g = df.groupingSets([keys, [F.col(preset)], []], *keys).agg(F.sum("original_characters").alias("original_characters"), F.sum("optimized_characters").alias("optimized_characters"))
    return g.withColumn("reduction_percentage", percentage(F.col("original_characters") - F.col("optimized_characters"), F.col("original_characters")))


def rendered(report: DataFrame, workload: str = "workload", preset: str = "preset", most: int = 10_000) -> str:
    """The report's rows (one per workload and preset: few) as a Markdown table, in the order of their names, totals last."""
    rows = report.select(workload, preset, "original_characters", "optimized_characters", "reduction_percentage").orderBy(F.col(workload).asc_nulls_last(), F.col(preset).asc_nulls_last()).limit(most).collect()
    lines = ["| Workload | Preset | Before | After | Reduction |", "| --- | --- | ---: | ---: | ---: |"]
    return "\n".join(lines + [f"| {r[0] or 'all'} | {r[1] or 'all'} | {r[2]:,} | {r[3]:,} | {r[4]:.1f}% |" for r in rows])
