"""Counters from scrapes: how much each one has grown since the scrape before, as a stream and as a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyworks.functions.numbers import money
from tallyworks.sources.tables import table
from tallyworks.streaming.gate import run_once

CHANGES = "source string, labels string, at long, change double"


def changes(scrapes: DataFrame) -> DataFrame:
    """source, labels, at and change from scrapes (source, labels, at, value) of counters.

    A counter is a source and its labels. A value that is lower than the one before tells that the
    counter began anew, so all of it is growth; the first value has none. Of scrapes with one `at`
    the highest value counts; NULLs in any column are left out. A stream takes the scrapes of a
    micro-batch in order of at, and leaves out those that come after a later one.
    """
    whole = scrapes.select(F.col("source").cast("string").alias("source"), F.col("labels").cast("string").alias("labels"), F.col("at").cast("long").alias("at"), F.col("value").cast("double").alias("value")).dropna()
    if not whole.isStreaming:
        order = Window.partitionBy("source", "labels").orderBy("at")
        before = F.lag("value").over(order)
        change = F.when(F.col("value") >= before, F.col("value") - before).otherwise(F.col("value"))
        once = whole.groupBy("source", "labels", "at").agg(F.max("value").alias("value"))
        return once.select("source", "labels", "at", F.when(before.isNotNull(), change).alias("change")).filter("change is not null")

    def grown(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # Plain arrays, as there are many counters with few scrapes each.
        at, value = (np.concatenate(x) for x in zip(*((f["at"].to_numpy(), f["value"].to_numpy()) for f in frames), strict=True))
        order = np.lexsort((value, at))
        at, value = at[order], value[order]
        once = np.append(at[1:] != at[:-1], True)
        at, value = at[once], value[once]
        if state.exists:
            last, before = state.get
            later = at > last
            at, value = np.append(last, at[later]), np.append(before, value[later])
            if len(at) == 1:
                return
        state.update((int(at[-1]), float(value[-1])))
        if len(at) > 1:
            yield pd.DataFrame({"source": key[0], "labels": key[1], "at": at[1:], "change": np.where(value[1:] < value[:-1], value[1:], value[1:] - value[:-1])})

    return whole.groupBy("source", "labels").applyInPandasWithState(grown, CHANGES, "at long, value double", "append", GroupStateTimeout.NoTimeout)


def _scrapes(events: DataFrame) -> DataFrame:
    """Events as scrapes of a counter of each type and user, in whole hundredths."""
    return events.select(F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("labels"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), (money("value") * 100).cast("long").alias("value"))


def _totals(found: DataFrame) -> DataFrame:
    return found.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("change").cast("long")).alias("grown"))


def counter_growth(spark: SparkSession, folder: str) -> DataFrame:
    return _totals(changes(_scrapes(table(spark, folder, "events"))))


def stream_counter_growth(spark: SparkSession, folder: str) -> DataFrame:
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    return _totals(run_once(changes(_scrapes(spark.readStream.schema(schema).parquet(f"{folder}/event[s].parquet")))))


QUERIES = {f.__name__: f for f in (counter_growth, stream_counter_growth)}
_GROWTH = """
WITH scrapes AS (SELECT event_type AS source, user_id, ts, max(CAST(CAST(value AS DECIMAL(18,2)) * 100 AS BIGINT)) AS value FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL GROUP BY ALL),
placed AS (SELECT *, lag(value) OVER (PARTITION BY source, user_id ORDER BY ts) AS before FROM scrapes)
SELECT source, count(*) AS n, CAST(sum(CASE WHEN value >= before THEN value - before ELSE value END) AS BIGINT) AS grown FROM placed WHERE before IS NOT NULL GROUP BY source"""
ORACLE = {"counter_growth": _GROWTH, "stream_counter_growth": _GROWTH}
