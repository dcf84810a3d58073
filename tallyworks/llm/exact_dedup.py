"""Exact deduplication with a split of the heavy hitters."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyworks.llm.common import checkpointed, table

#: Counters of a Misra-Gries summary, and so the most digests whose winners are broadcast.
COUNTERS = 256


def normalised(text: Column) -> Column:
    """The text without white space of ASCII; a null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\f\r", "")


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def _trimmed(counts: Counter, counters: int) -> Counter:
    """At most that many counters: what the next larger one holds is taken from all."""
    if len(counts) <= counters:
        return counts
    ranked = counts.most_common(counters + 1)
    least = ranked[-1][1]
    return Counter({key: n - least for key, n in ranked if n > least})


def summaries(batches: Iterator[pa.RecordBatch], counters: int) -> Iterator[pa.RecordBatch]:
    """The Misra-Gries summary of a partition's digests: every digest with more than 1 / (counters + 1) of the rows is in it."""
    counts: Counter = Counter()
    for batch in batches:
        found = pc.value_counts(batch.column(0))
        counts.update(dict(zip(found.field("values").to_pylist(), found.field("counts").to_pylist(), strict=True)))
        counts = _trimmed(counts, counters)
    yield pa.RecordBatch.from_pydict({"digest": pa.array(list(counts), pa.binary()), "weight": pa.array(list(counts.values()), pa.int64())})


def heavy_winners(digests: DataFrame, order: Column, counters: int) -> DataFrame:
    """digest, best (the least value of order) and group_size of every digest with more than 1 / (counters + 1) of all rows.

    The summaries of the partitions are summed and trimmed again, which keeps each such digest,
    so at most counters of them come to the driver. Their counts and winners are then taken
    from all rows, and those that aren't so frequent after all are left out.
    """
    spark = digests.sparkSession
    parts = digests.select("digest").mapInArrow(lambda batches: summaries(batches, counters), "digest binary, weight long")
    top = parts.groupBy("digest").agg(F.sum("weight").alias("weight")).orderBy(F.desc("weight"), "digest").limit(counters + 1).collect()
    candidates = [(bytes(key),) for key, n in _trimmed(Counter({bytes(r.digest): r.weight for r in top}), counters).items()]
    found = F.broadcast(spark.createDataFrame(candidates, "digest binary"))
    verified = digests.join(found, "digest", "left_semi").groupBy("digest").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("group_size"))
    return checkpointed(verified.filter(F.col("group_size") * (counters + 1) > digests.count()))


def order_of() -> Column:
    """What the row that stays has least of: the most code points, then the smallest doc_id, a null last."""
    return F.struct((-F.col("n_points")).alias("n"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"))


def decisions(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest: one row for each row of docs.

    Rows are equal when their texts are without the white space of ASCII; null and empty texts
    are equal. Of equal rows the one with the most code points, then the smallest doc_id (a null
    last) stays; of rows that are alike in these too, any one. No documents give no rows; no other
    column is read. Digests of more than 1 / (counters + 1) of all rows get their winner from a
    broadcast of at most counters rows and aren't shuffled; groups of others are smaller than that.
    """
    own = docs.select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).alias("n_points"), digest_of(F.col("text")).alias("digest"), F.monotonically_increasing_id().alias("row"))
    rows = checkpointed(own)
    order = F.struct(order_of().alias("first"), F.col("row"))
    marked = rows.join(F.broadcast(heavy_winners(rows, order, counters)), "digest", "left")
    heavy = marked.filter("best is not null").select("doc_id", F.col("best.first.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "digest")
    group = Window.partitionBy("digest")
    light = marked.filter("best is null").select("doc_id", "digest", "row", order.alias("own")).withColumns({"least": F.min("own").over(group), "n": F.count(F.lit(1)).over(group)})
    return heavy.unionByName(light.select("doc_id", F.col("least.first.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("least.row")).alias("kept"), "digest"))


def drop_copies(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The rows of docs that stay, with their columns; the cases are those of decisions().

    Copies of a heavy digest's winner go where they are read; other rows are shuffled once, and
    only the first of each digest in a task (Spark limits the groups before the exchange).
    """
    keyed = docs.select(F.struct("*").alias("row"), "doc_id", F.char_length(F.coalesce("text", F.lit(""))).alias("n_points"), digest_of(F.col("text")).alias("digest")).withColumn("own", order_of())
    winners = heavy_winners(checkpointed(keyed.select("digest", "own")), F.col("own"), counters).select("digest", "best")
    left = keyed.join(F.broadcast(winners), "digest", "left").filter("best is null or best = own")
    first = F.row_number().over(Window.partitionBy("digest").orderBy("own"))
    return left.withColumn("place", first).filter("place = 1").select("row.*")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which row of its group of equal texts stays, for every document."""
    return decisions(table(spark, sf_dir, "documents")).withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


ORACLE = r"""
WITH own AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents),
ranked AS (
  SELECT *, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM own WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id ASC NULLS LAST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM ranked
"""
