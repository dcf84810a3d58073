"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyworks.llm.common import WORD, checkpointed, table

#: Sources up to this number are broadcast with their rates (some MB); more are joined with salted keys.
BROADCAST_SOURCES = 50_000
SALTS = 32


def size_of(text: Column) -> Column:
    """Words of a text; 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_totals_before(rows: DataFrame, order: list[Column], values: dict[str, Column]) -> DataFrame:
    """rows with the totals of values over all rows that come before in an order.

    Rows are dealt by ranges of the order; within a range a window sums up, and what the ranges
    before hold is one row for each range. So no task orders more than its range.
    """
    ranged = checkpointed(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.groupBy("_range").agg(*[F.sum(value).alias(name) for name, value in values.items()])
    offsets = own.select("_range", *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"_to_{name}") for name in values])
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(F.broadcast(offsets), "_range")
    return placed.select(*rows.columns, *[(F.col(f"_to_{name}") + F.coalesce(F.sum(value).over(within), F.lit(0))).cast("long").alias(name) for name, value in values.items()])


def source_targets(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """source, source_size, target, rate: one row for each source, a null source included.

    Sources in the order of their code points, the null last, take the weights in turn. Together
    the targets are as large as all sources are. With level = (all - caps below) / (weights not
    below), over the sources in the order of cap / weight, the largest level is the one at which
    no target exceeds its cap (most * source_size) after the excess has gone to the others.
    """
    by_name = F.col("source").asc_nulls_last()
    totals = checkpointed(docs.select("source", size_of(F.col("text")).alias("_size")).groupBy("source").agg(F.sum("_size").alias("source_size")))
    placed = with_totals_before(totals, [by_name], {"_place": F.lit(1)})
    weighed = placed.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("_place") % len(weights) + 1).cast("int")).cast("long"))
    capped = weighed.withColumn("_cap", F.col("source_size") * most)
    filled = with_totals_before(capped, [F.col("_cap") / F.col("_weight"), by_name], {"_caps": F.col("_cap"), "_weights": F.col("_weight")})
    every = capped.agg(F.sum("source_size").alias("_all"), F.sum("_weight").alias("_all_weights"))
    levels = filled.crossJoin(F.broadcast(every)).withColumn("_level", (F.col("_all") - F.col("_caps")).cast("double") / (F.col("_all_weights") - F.col("_weights")).cast("double"))
    highest = levels.agg(F.max("_level").alias("_highest"))
    target = F.least(F.col("_highest") * F.col("_weight"), F.col("_cap").cast("double"))
    rate = F.least(F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0)), F.lit(float(most)))
    return filled.crossJoin(F.broadcast(highest)).withColumn("target", target).withColumn("rate", rate).select("source", "source_size", "target", "rate")


def draw(seed: int) -> Column:
    """A number in [0, 1) from the seed and doc_id, the same in every run."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long").cast("double") / float(16**13)


def with_copies(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3, seed: int = 42) -> DataFrame:
    """row (all columns of docs), doc_id, size, source_size, target, copies: one row for each document.

    A document comes floor(rate) times, and once more if its draw is below the rest of the rate.
    Cases: a null or empty text has size 0; a null source is one of its own; a null doc_id draws as
    the text "null"; rows with one doc_id draw alike; no documents give no rows; other columns stay
    inside row, so their names can't clash. A source's rows are summed before they are shuffled,
    so a hot source is no more work than another.
    """
    targets = checkpointed(source_targets(docs, weights, most))
    sized = docs.select(F.struct("*").alias("row"), "doc_id", F.col("source").alias("_source"), size_of(F.col("text")).alias("size"))
    rates = targets.withColumnRenamed("source", "_of")
    if targets.count() <= BROADCAST_SOURCES:
        joined = sized.join(F.broadcast(rates), F.col("_source").eqNullSafe(F.col("_of")))
    else:
        salted = rates.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        own = sized.withColumn("_own", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)).cast("int"))
        joined = own.join(salted, F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_own") == F.col("_salt")))
    whole = F.floor("rate")
    copies = (whole + F.when(draw(seed) < F.col("rate") - whole, 1).otherwise(0)).cast("int")
    return joined.select("row", "doc_id", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: each row of docs as often as the mix takes it, with the columns of docs."""
    taken = with_copies(docs, **options).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    mixed = with_copies(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, 3 * source_size AS cap, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight FROM totals),
levels AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(weight) OVER (ORDER BY cap / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM weighed),
targets AS (SELECT source, source_size, least((max(level) OVER ()) * weight, CAST(cap AS DOUBLE)) AS target FROM levels),
rates AS (SELECT *, CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE least(target / CAST(source_size AS DOUBLE), 3.0::DOUBLE) END AS rate FROM targets)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN CAST(CAST('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized JOIN rates ON sized.source IS NOT DISTINCT FROM rates.source
"""
