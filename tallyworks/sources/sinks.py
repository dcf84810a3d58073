"""Writing tables: replacing and merging by key, appending, and going on where a run has stopped.

Parquet has no MERGE: the merged table is a new DataFrame, which write_table puts beside the old
table before it takes its place. What is read must therefore not be what is overwritten.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyworks.sources.tables import table


def replaced(target: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """target with the rows of updates in the place of those with the same keys."""
    return updates.unionByName(target.join(updates.select(*keys), keys, "left_anti"))


def merged(target: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Like replaced(), but a NULL in updates leaves what target has."""
    others = [c for c in target.columns if c not in keys]
    new = updates.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in others])
    return target.join(new, keys, "full").select(*keys, *[F.coalesce(f"_new_{c}", c).alias(c) for c in others])


def replaced_groups(target: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """target without any row of the groups that updates has, and the rows of updates."""
    return target.join(updates.select(*keys).distinct(), keys, "left_anti").unionByName(updates)


def pending(work: DataFrame, done: DataFrame, keys: list[str], again: bool = False, order: list[str] | None = None, most: int | None = None) -> DataFrame:
    """The work that isn't done yet, or all of it; with a limit, the first `most` rows in that order."""
    left = work if again else work.join(done.select(*keys).distinct(), keys, "left_anti")
    return left if most is None else left.orderBy(*(order or keys)).limit(most)


def changed(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files (path, content) whose content differs from what known (path, digest) has of them."""
    return files.withColumn("digest", F.sha2("content", 256)).join(known, ["path", "digest"], "left_anti")


def content_name(content, letters: int = 12):
    """A short name for a content: the beginning of its sha256."""
    return F.substring(F.sha2(content, 256), 1, letters)


def surrogate_key(*natural: str):
    """The same key for the same natural key, in every run; parts are hashed apart, so that they can't run into one another, and NULL is no text."""
    return F.sha2(F.concat_ws(",", *[F.coalesce(F.sha2(F.col(c).cast("string").cast("binary"), 256), F.lit("-")) for c in natural]).cast("binary"), 256)


def with_status(rows: DataFrame, reasons: str) -> DataFrame:
    """Rows go to be read again where there are reasons, and are finished otherwise."""
    return rows.withColumn("status", F.when(F.size(reasons) > 0, "NEEDS_OCR").otherwise("COMPLETED"))


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def write_table(rows: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """rows as the new content of the folder at path: written beside it, then renamed.

    Between two renames readers find nothing for a moment; if the second one fails, the old content
    is put back. Tables of sources.versions are never without content.
    """
    if keys and repeated_keys(rows, keys).limit(1).count():
        raise ValueError(f"rows with the same {keys}")
    spark = rows.sparkSession
    staging, old = f"{path}.{uuid.uuid4().hex}", f"{path}.{uuid.uuid4().hex}"
    rows.write.parquet(staging)
    files = spark._jvm.org.apache.hadoop.fs
    target = files.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    there = system.exists(target)
    if there and not system.rename(target, files.Path(old)):
        raise OSError(f"{path} can't be moved away")
    if not system.rename(files.Path(staging), target):
        if there:
            system.rename(files.Path(old), target)
        raise OSError(f"{staging} can't be moved to {path}")
    if there:
        system.delete(files.Path(old), True)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def _customers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select("c_custkey", "c_mktsegment", F.col("c_acctbal").cast("decimal(18,2)").alias("balance"))


def _updates(rows: DataFrame) -> DataFrame:
    changed = rows.filter("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, F.lit("NEW")).alias("c_mktsegment"), (F.col("balance") + 1).cast("decimal(18,2)").alias("balance"))
    return changed.unionByName(changed.filter("c_custkey % 8 = 0").withColumn("c_custkey", -F.col("c_custkey") - 1))


def upsert_replace(spark: SparkSession, folder: str) -> DataFrame:
    rows = _customers(spark, folder)
    return replaced(rows, _updates(rows), ["c_custkey"])


def upsert_coalesce(spark: SparkSession, folder: str) -> DataFrame:
    rows = _customers(spark, folder)
    return merged(rows, _updates(rows), ["c_custkey"])


def replace_partition(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of some orders replaced by their first."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey"))
    updates = lines.filter("l_orderkey % 5 = 0").withColumn("place", place).filter("place = 1").drop("place")
    return replaced_groups(lines, updates, ["l_orderkey"])


def resume_antijoin(spark: SparkSession, folder: str) -> DataFrame:
    work = table(spark, folder, "orders").select("o_orderkey")
    return pending(work, work.filter("o_orderkey % 3 = 0"), ["o_orderkey"])


def resume_limited(spark: SparkSession, folder: str) -> DataFrame:
    """The first hundred orders, by date, that are still to be done, with a short name of each one's priority."""
    work = table(spark, folder, "orders").select("o_orderkey", "o_orderdate", content_name(F.col("o_orderpriority").cast("binary")).alias("name"))
    return pending(work, work.filter("o_orderkey % 3 = 0"), ["o_orderkey"], order=["o_orderdate", "o_orderkey"], most=100)


def document_status(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents of each source would be read again for being short or full of marks."""
    text = F.col("text")
    reasons = F.array_compact(F.array(F.when(F.char_length(text) < 40, "NO_TEXT_LAYER"), F.when(F.regexp_count(text, F.lit("[#*$&%!|]")) > F.char_length(text) / 20, "MARKS")))
    docs = with_status(table(spark, folder, "documents").select("doc_id", "source", reasons.alias("reasons")), "reasons")
    return docs.groupBy("source", "status").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (upsert_replace, upsert_coalesce, replace_partition, resume_antijoin, resume_limited, document_status)}

_ROWS = """
WITH old AS (SELECT c_custkey, c_mktsegment, CAST(c_acctbal AS DECIMAL(18,2)) AS balance FROM customer),
changed AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'NEW' END AS c_mktsegment, CAST(balance + 1 AS DECIMAL(18,2)) AS balance FROM old WHERE c_custkey % 2 = 0),
new AS (SELECT * FROM changed UNION ALL SELECT -c_custkey - 1, c_mktsegment, balance FROM changed WHERE c_custkey % 8 = 0)
"""
ORACLE = {
    "upsert_replace": _ROWS + "SELECT * FROM new UNION ALL SELECT * FROM old WHERE c_custkey NOT IN (SELECT c_custkey FROM new)",
    "upsert_coalesce": _ROWS + "SELECT c_custkey, coalesce(new.c_mktsegment, old.c_mktsegment) AS c_mktsegment, coalesce(new.balance, old.balance) AS balance FROM old FULL JOIN new USING (c_custkey)",
    "replace_partition": """SELECT l_orderkey, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey) AS place FROM lineitem) WHERE l_orderkey % 5 <> 0 OR place = 1""",
    "resume_antijoin": "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0",
    "resume_limited": "SELECT o_orderkey, o_orderdate, left(sha256(o_orderpriority), 12) AS name FROM orders WHERE o_orderkey % 3 <> 0 ORDER BY o_orderdate, o_orderkey LIMIT 100",
    "document_status": """SELECT source, CASE WHEN length(text) < 40 OR len(regexp_extract_all(text, '[#*$&%!|]')) > length(text) / 20.0::DOUBLE THEN 'NEEDS_OCR' ELSE 'COMPLETED' END AS status, count(*) AS n FROM documents GROUP BY 1, 2""",
}
