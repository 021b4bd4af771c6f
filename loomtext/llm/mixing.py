"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MOST = 2


def source_targets(sizes: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, target): shares by weight under a ceiling.

    A source's target is ``weight * level``, but at most ``most`` times its size; the level is such that
    all targets make ``share_percent`` of all sizes. Sorted by the level at which they reach
    their ceiling, the sources that stop there are a prefix, found with running sums of integers.
    One row per source is all that this orders; a null source comes last.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    # rows with a number: the sort below is over the list of sources, never over documents
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(named) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    t = sizes.withColumn("w", w).withColumn("ratio", F.lit(most) * F.col("source_size") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    t = t.withColumn("full", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most).withColumn("used", F.coalesce(F.sum("w").over(before), F.lit(0)))
    t = t.withColumn("level", (F.lit(share_percent) * F.sum("source_size").over(everything) - 100 * F.col("full")) / (100 * (F.sum("w").over(everything) - F.col("used"))))
    # the level that holds is the first that does not exceed its own source's ceiling
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("source").isNull(), "source", "level"))).over(everything)["level"]
    t = t.withColumn("held", level)
    return t.select("source", "source_size", F.least(F.col("held") * F.col("w"), (F.lit(most) * F.col("source_size")).cast("double")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST, row_col: str | None = None) -> DataFrame:
    """(id, source, size, source_size, target, epochs, taken) for every row, and ``row_col`` if named.

    Sizes count the words ``[^\\x20\\x09-\\x0D]+`` (null: 0). Rows get the key md5(seed:id) and are range-sorted by
    (source, key, id); running sums within a range, plus the sums of the ranges before it, give each row's
    place in its source, so a source of any size is dealt over many tasks. A source takes whole epochs
    of its rows, then the rows, in key order, whose middle lies before what is left of its
    target; rows are never split, so a source is off by half a row at most. Reruns agree; equal ids are
    ordered by size, and rows that are equal in both take what their place gives them.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), key.alias("key"), *([row_col] if row_col else []))
    rows = saved(rows, "sizes")
    rows = saved(rows.repartitionByRange(F.col("source").asc_nulls_last(), "key", "id", "size").withColumn("range", F.spark_partition_id()), "ranges")
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    mine = Window.partitionBy("source")
    ranges = ranges.withColumn("before", F.sum("range_size").over(mine.orderBy("range")) - F.col("range_size")).withColumn("source_size", F.sum("range_size").over(mine))
    targets = source_targets(ranges.groupBy("source").agg(F.max("source_size").alias("source_size")), weights, share_percent, most)
    ranges = ranges.join(targets.select(F.col("source").alias("s"), "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    ranges = ranges.select(F.col("source").alias("s"), F.col("range").alias("r"), "before", "source_size", "target")
    inner = Window.partitionBy("source", "range").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("until", F.sum("size").over(inner))
    rows = rows.join(ranges, (F.col("range") == F.col("r")) & F.col("source").eqNullSafe(F.col("s")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    left = F.col("target") - whole * F.col("source_size")
    middle = F.col("before") + F.col("until") - F.col("size") / 2
    epochs = whole + F.when(middle <= left, 1).otherwise(0)
    epochs = F.least(epochs, F.lit(most)).cast("long")
    return rows.select(*([row_col] if row_col else []), "id", "source", "size", "source_size", "target", epochs.alias("epochs"), (F.col("size") * epochs).alias("taken"))


def mixed_rows(docs: DataFrame, **about) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it. Rows are numbered in a written copy, so repeated ids stay apart."""
    numbered = saved(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    epochs = mix(numbered, row_col="__row", **about).where("epochs > 0").select("__row", F.explode(F.sequence(F.lit(1), F.col("epochs").cast("int"))).alias("__epoch"))
    return numbered.join(epochs, "__row").select(*docs.columns)


def op5_mix(spark, sf_dir: str) -> DataFrame:
    """One row per row of ``documents``, also of those that the mix does not take; for odd rows see ``mix``."""
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def mixing_sql(table: str = "documents", seed: int = 17) -> str:
    """CTEs ending in ``mixed`` (doc_id, size, source_size, target, epochs, taken) over ``table``."""
    return rf"""
sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('{seed}:' || doc_id) AS key FROM {table}),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM per),
ratios AS (SELECT *, (2 * source_size)::DOUBLE / w AS ratio FROM weighed),
runs AS (SELECT *, coalesce(sum(2 * source_size) OVER b, 0) AS fulls, coalesce(sum(w) OVER b, 0) AS used, sum(source_size) OVER () AS s, sum(w) OVER () AS ws
  FROM ratios WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, (150 * s - 100 * fulls)::DOUBLE / (100 * (ws - used))::DOUBLE AS level FROM runs),
held AS (SELECT level AS held FROM levels WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1),
targets AS (SELECT source, source_size, least(held * w, (2 * source_size)::DOUBLE) AS target FROM levels LEFT JOIN held ON true),
placed AS (SELECT z.doc_id, z.size, t.source_size, t.target, sum(z.size) OVER (PARTITION BY z.source ORDER BY z.key, z.doc_id, z.size ROWS UNBOUNDED PRECEDING)::BIGINT AS until,
  CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS whole FROM sized z JOIN targets t ON z.source IS NOT DISTINCT FROM t.source),
mixed AS (SELECT doc_id, size, source_size, target, least(whole + CASE WHEN until - size::DOUBLE / 2 <= target - whole * source_size THEN 1 ELSE 0 END, 2)::BIGINT AS epochs FROM placed)"""


SQL = {"op5_mix": f"WITH {mixing_sql()} SELECT doc_id, size, source_size, target, size * epochs AS taken FROM mixed"}
