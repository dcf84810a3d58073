"""Tables with versions: each write is a numbered snapshot, and a merge rewrites only the ranges of keys that it falls in.

A table is a folder. data/ has Parquet files, never changed once written; snapshots/ has one small
file for each version, put there whole or not at all, and only if there is none of that number. A
snapshot lists the ranges of keys with their files. Readers take the highest number. A writer that
is stopped leaves files that no snapshot lists; one that finds its number taken reads anew and
tries again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Ranges of a table at most, and how often a writer tries again.
MOST_RANGES, TRIES = 1000, 20
RANGE = "_range"


class Conflict(Exception):
    """Another writer was first."""


class Folder:
    """Small files of a folder in whatever file system its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path
        self.configuration = spark._jsc.hadoopConfiguration()
        self.root = self.jvm.org.apache.hadoop.fs.Path(path)
        self.system = self.root.getFileSystem(self.configuration)

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.root, name)

    def names(self, name: str) -> list[str]:
        """The files of a folder below; none if it isn't there."""
        place = self.at(name)
        return [f.getPath().getName() for f in self.system.listStatus(place)] if self.system.exists(place) else []

    def read(self, name: str) -> str:
        stream = self.system.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """The file whole, under a name that nothing has yet; Conflict if something has."""
        draft = self.at(f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}")
        stream = self.system.create(draft, True)
        stream.write(text.encode())
        stream.close()
        try:
            if self.system.getUri().getScheme() == "file":  # renaming would take the place of a file; a link doesn't
                place = lambda p: self.jvm.java.nio.file.Paths.get(p.toUri())
                self.jvm.java.nio.file.Files.createLink(place(self.system.makeQualified(self.at(name))), place(self.system.makeQualified(draft)))
            else:
                context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.system.getUri(), self.configuration)
                context.rename(draft, self.at(name), [])
        except Exception as error:
            if self.system.exists(self.at(name)):
                raise Conflict(name) from error
            raise
        finally:
            if self.system.exists(draft):
                self.system.delete(draft, False)


def _number(name: str) -> int:
    return int(name) if name.isdecimal() else -1


def latest(spark: SparkSession, path: str) -> int:
    """The number of the newest version; -1 without one."""
    return max(map(_number, Folder(spark, path).names("snapshots")), default=-1)


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """version, key, schema, bounds and files (a list for each range) of a version, the newest one if none is given."""
    number = latest(spark, path) if version is None else version
    if number < 0:
        raise FileNotFoundError(f"no version at {path}")
    return json.loads(Folder(spark, path).read(f"snapshots/{number:010d}"))


def _files(spark: SparkSession, path: str, found: dict, ranges: list[int] | None = None) -> DataFrame:
    schema = StructType.fromJson(found["schema"])
    names = [f"{path}/{f}" for i, own in enumerate(found["files"]) if ranges is None or i in ranges for f in own]
    return spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version; files that a later one replaces stay, so what has been read doesn't change."""
    return _files(spark, path, snapshot(spark, path, version))


def _range_of(key: Column, bounds: list, kind: str) -> Column:
    """The place of a key among ascending bounds; NULL is below all."""
    if not bounds:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.lit(bounds).cast(f"array<{kind}>"), lambda b: b <= key)), F.lit(0))


def _written(rows: DataFrame, path: str, key: str, bounds: list, kind: str, count: int) -> list[list[str]]:
    """The files of each range of rows, relative to the table's folder; Spark gathers small ranges and splits large ones among tasks."""
    spark, name = rows.sparkSession, f"data/{uuid.uuid4().hex}"
    dealt = rows.withColumn(RANGE, _range_of(F.col(key), bounds, kind))
    dealt.hint("rebalance", RANGE).write.partitionBy(RANGE).parquet(f"{path}/{name}")
    folder, out = Folder(spark, path), [[] for _ in range(count)]
    for part in folder.names(name):
        if part.startswith(f"{RANGE}="):
            out[int(part.partition("=")[2])] = sorted(f"{name}/{part}/{f}" for f in folder.names(f"{name}/{part}") if f.endswith(".parquet"))
    return out


def _publish(spark: SparkSession, path: str, number: int, key: str, schema: StructType, bounds: list, files: list[list[str]]) -> int:
    folder = Folder(spark, path)
    folder.system.mkdirs(folder.at("snapshots"))
    folder.put(f"snapshots/{number:010d}", json.dumps({"version": number, "key": key, "schema": json.loads(schema.json()), "bounds": bounds, "files": files}))
    return number


def _bounds(rows: DataFrame, key: str, ranges: int) -> list[str]:
    """Where ranges of about as many keys begin, as strings; at most ranges - 1."""
    keys = rows.select(key).filter(F.col(key).isNotNull()).repartitionByRange(ranges, key)
    first = keys.groupBy(F.spark_partition_id()).agg(F.min(key).alias("least")).select(F.col("least").cast("string")).distinct().collect()
    ordered = rows.sparkSession.createDataFrame(first, "least string").select(F.col("least").cast(rows.schema[key].dataType).alias("k")).orderBy("k").select(F.col("k").cast("string")).collect() if first else []
    return [r[0] for r in ordered][1:]


def write(rows: DataFrame, path: str, key: str, ranges: int = 16) -> int:
    """rows as the whole content of a new version, laid out by ranges of key; gives its number.

    A table that isn't there yet is made. Rows with one key are in one range.
    """
    spark = rows.sparkSession
    if not 1 <= ranges <= MOST_RANGES:
        raise ValueError(f"1 to {MOST_RANGES} ranges")
    bounds, kind = _bounds(rows, key, ranges), rows.schema[key].dataType.simpleString()
    files = _written(rows, path, key, bounds, kind, len(bounds) + 1)
    for _ in range(TRIES):
        try:
            return _publish(spark, path, latest(spark, path) + 1, key, rows.schema, bounds, files)
        except Conflict:
            continue
    raise Conflict(f"{path}: {TRIES} times another writer was first")


def change(spark: SparkSession, path: str, updates: DataFrame, keys: list[str], combine: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
    """A new version in which the rows of the ranges that updates fall in are combine(rows, updates); other ranges keep their files.

    The table's key must be one of keys. If another writer was first, all is done again on what it
    has left. Without updates there is no new version.
    """
    for _ in range(TRIES):
        found = snapshot(spark, path)
        key, bounds, kind = found["key"], found["bounds"], StructType.fromJson(found["schema"])[found["key"]].dataType.simpleString()
        if key not in keys:
            raise ValueError(f"the table is laid out by {key}")
        touched = sorted(r[0] for r in updates.select(_range_of(F.col(key), bounds, kind).alias("r")).distinct().collect())
        if not touched:
            return found["version"]
        old = _files(spark, path, found, touched)
        new = _written(combine(old, updates).select(*old.columns), path, key, bounds, kind, len(bounds) + 1)
        files = [new[i] if i in touched else own for i, own in enumerate(found["files"])]
        try:
            return _publish(spark, path, found["version"] + 1, key, StructType.fromJson(found["schema"]), bounds, files)
        except Conflict:
            continue
    raise Conflict(f"{path}: {TRIES} times another writer was first")


def merge(updates: DataFrame, path: str, keys: list[str], now: Column | None = None, stamp: str = "updated_at", fill: bool = True) -> int:
    """updates put into the table by keys; gives the new version.

    A row with the same keys takes what updates has; with fill, a NULL in updates leaves what is
    there. With now, the column `stamp` (which updates needn't have) is set to it in all rows that
    updates has, and in no other. Keys are equal as in a join, so rows with a NULL key are added.
    """
    from tallyworks.sources import sinks

    def combine(old: DataFrame, new: DataFrame) -> DataFrame:
        stamped = new if now is None else new.withColumn(stamp, now)
        return (sinks.merged if fill else sinks.replaced)(old, stamped.select(*old.columns), keys)

    return change(updates.sparkSession, path, updates, keys, combine)


def versioned_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as a table in eight ranges, and updates of the lower keys merged into it, with the time of the run."""
    from tallyworks.sources.shared import shared_folder
    from tallyworks.sources.tables import table

    rows = table(spark, folder, "customer").select("c_custkey", "c_mktsegment", F.col("c_acctbal").cast("decimal(18,2)").alias("balance"), F.lit("2020-01-01").cast("timestamp").alias("updated_at"))
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    write(rows, path, "c_custkey", ranges=8)
    low = rows.filter("c_custkey % 3 = 0").join(rows.agg((F.max("c_custkey") / 4).alias("most"))).filter("c_custkey < most")
    merge(low.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "NEW").alias("c_mktsegment"), (F.col("balance") + 1).cast("decimal(18,2)").alias("balance")), path, ["c_custkey"], now=F.lit("2021-06-01").cast("timestamp"))
    return read(spark, path)


QUERIES = {"versioned_merge": versioned_merge}
ORACLE = {
    "versioned_merge": """
WITH rows AS (SELECT c_custkey, c_mktsegment, CAST(c_acctbal AS DECIMAL(18,2)) AS balance, c_custkey % 3 = 0 AND c_custkey < (SELECT max(c_custkey) / 4 FROM customer) AS hit FROM customer)
SELECT c_custkey, CASE WHEN hit AND c_custkey % 2 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment, CAST(balance + CASE WHEN hit THEN 1 ELSE 0 END AS DECIMAL(18,2)) AS balance,
  CASE WHEN hit THEN TIMESTAMP '2021-06-01' ELSE TIMESTAMP '2020-01-01' END AS updated_at FROM rows"""
}
