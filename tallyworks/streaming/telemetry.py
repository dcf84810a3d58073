"""Timings of streamed requests, parsing of event lines, and windows over event time."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyworks.functions.numbers import money
from tallyworks.sources.shared import shared_folder
from tallyworks.sources.tables import table


def sse_deltas(lines: DataFrame) -> DataFrame:
    """request_id, seq, delta and last from lines (request_id, seq, line) of server-sent events; lines without data are left out."""
    data = F.regexp_extract("line", r"^data:\s*(.*)$", 1)
    parsed = F.from_json(data, "choices array<struct<delta:struct<content:string>>>")
    rows = lines.filter(F.col("line").startswith("data:")).select("request_id", "seq", data.alias("data"), F.get(parsed["choices"], F.lit(0))["delta"]["content"].alias("delta"))
    return rows.filter("data = '[DONE]' or delta is not null").select("request_id", "seq", F.coalesce("delta", F.lit("")).alias("delta"), (F.col("data") == "[DONE]").alias("last"))


def micros_of(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def gaps(marks: DataFrame, key: str, at: str) -> DataFrame:
    """Milliseconds between one mark of a key and the next."""
    order = Window.partitionBy(key).orderBy(at)
    micros = micros_of(F.col(at)) - micros_of(F.lag(at).over(order))
    return marks.withColumn("gap_ms", F.floor(micros / 1000).cast("long")).filter("gap_ms is not null")


def ranked(values: DataFrame, key: str, value: str, percents: dict[str, float]) -> DataFrame:
    """For each key the values at the ranks nearest to percentiles, the rank being rounded half to even.

    Values are counted before the shuffle, so a key with very many of them is as many rows as it has
    different values.
    """
    counts = values.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(key).orderBy(value))
    every = F.sum("n").over(Window.partitionBy(key))
    placed = counts.withColumns({"upto": upto, "every": every})
    at = lambda percent: F.bround(F.lit(percent / 100) * (F.col("every") - 1)).cast("long")
    return placed.groupBy(key).agg(*[F.min(F.when(F.col("upto") > at(percent), F.col(value))).alias(name) for name, percent in percents.items()])


def medians(values: DataFrame, key: str, value: str) -> DataFrame:
    """For each key the median of whole numbers: the mean of the two in the middle if there are as many above as below."""
    counts = values.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    placed = counts.withColumns({"upto": F.sum("n").over(Window.partitionBy(key).orderBy(value)), "every": F.sum("n").over(Window.partitionBy(key))})
    at = lambda place: F.min(F.when(F.col("upto") > F.floor(place), F.col(value)))
    return placed.groupBy(key).agg(((at((F.col("every") - 1) / 2) + at(F.col("every") / 2)) / 2).alias("median"))


def telemetry(marks: DataFrame, key: str, at: str) -> DataFrame:
    """For each key when its marks begin and end, how many there are, and the gaps' percentiles at the nearest rank."""
    ends = marks.groupBy(key).agg(F.count(F.lit(1)).alias("n_marks"), F.floor((micros_of(F.max(at)) - micros_of(F.min(at))) / 1000).cast("long").alias("total_ms"))
    values = ranked(gaps(marks, key, at), key, "gap_ms", {"p50_ms": 50, "p95_ms": 95})
    return ends.join(values, key, "left").select(key, "n_marks", "total_ms", "p50_ms", "p95_ms")


def request_state(marks: DataFrame) -> DataFrame:
    """What is known of each request (request_id) from its marks (at, kind) so far: sent, first and last token, done, and how many tokens there are.

    Of marks of one kind the first counts, of tokens the last one too. These are sums and extremes, so a
    stream keeps them as state, and late marks change what they must.
    """
    first = lambda kind: F.min(F.when(F.col("kind") == kind, F.unix_micros("at")))
    return marks.groupBy("request_id").agg(first("sent").alias("sent"), first("token").alias("first"), F.max(F.when(F.col("kind") == "token", F.unix_micros("at"))).alias("last"), first("done").alias("done"), F.count_if(F.col("kind") == "token").alias("n_tokens"))


def request_telemetry(state: DataFrame) -> DataFrame:
    """Milliseconds to the first token and to the end, and tokens a second (of a decimal each); NULL where a mark is missing or no time went by."""
    ms = lambda a, b: F.round((F.col(b) - F.col(a)) / F.lit(1000).cast("decimal(10,0)"), 1).cast("decimal(18,1)")
    rate = F.round(F.try_divide((F.col("n_tokens") * 1_000_000).cast("decimal(24,0)"), (F.col("last") - F.col("first")).cast("decimal(18,0)")), 1).cast("decimal(18,1)")
    return state.select("request_id", "n_tokens", ms("sent", "first").alias("ttft_ms"), ms("sent", "done").alias("e2e_ms"), F.when(F.col("last") > F.col("first"), rate).alias("tokens_per_sec"))


def stage_times(stages: DataFrame) -> DataFrame:
    """request_id, stage and the sum of its times, as a stage may be entered more than once."""
    return stages.groupBy("request_id", "stage").agg(F.sum("micros").alias("micros"))


KINDS = {"signup": "sent", "view": "token", "click": "token", "purchase": "done"}


def event_marks(events: DataFrame) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("event_type")]
    return events.select(F.col("user_id").alias("request_id"), F.col("ts").cast("timestamp").alias("at"), kind.alias("kind")).filter("kind is not null")


def request_timings(spark: SparkSession, folder: str) -> DataFrame:
    """Users as requests and event types as marks."""
    return request_telemetry(request_state(event_marks(table(spark, folder, "events"))))


def stream_request_timings(spark: SparkSession, folder: str) -> DataFrame:
    """The same from a stream: what is there is read in parts, and the state after the last one is what counts."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{folder}/event[s].parquet")  # a pattern, as the table may be one file or a folder
    return request_telemetry(last_state(request_state(event_marks(events))))


def last_state(totals: DataFrame) -> DataFrame:
    """The totals of a stream after all that is there now, from files in the shared folder: each batch writes those of the keys that it changed, and the newest of a key stays."""
    folder = f"{shared_folder(totals.sparkSession)}/{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    query = totals.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    key, *others = totals.columns
    rows = totals.sparkSession.read.schema(f"{totals.schema.toDDL()}, _batch int").parquet(f"{folder}/rows")
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), "_batch").alias("own")).select(key, "own.*")


def gap_medians(spark: SparkSession, folder: str) -> DataFrame:
    return medians(gaps(table(spark, folder, "events").select("user_id", "ts"), "user_id", "ts"), "user_id", "gap_ms")


def stage_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Events as times that were spent on stages."""
    stages = table(spark, folder, "events").select(F.col("user_id").alias("request_id"), F.col("event_type").alias("stage"), (money("value") * 100).cast("long").alias("micros"))
    return stage_times(stages)


def stream_telemetry(spark: SparkSession, folder: str) -> DataFrame:
    """Events of a user as the tokens of a request."""
    return telemetry(table(spark, folder, "events").select("user_id", "ts"), "user_id", "ts")


def outcomes(requests: DataFrame) -> DataFrame:
    """How each request (request_id, n_context, failed, n_tokens) ended: refused without context, failed on the way, empty, or complete."""
    ended = F.when(F.col("n_context") == 0, "refused").when(F.col("failed"), "degraded").when(F.col("n_tokens") == 0, "empty").otherwise("done")
    return requests.withColumn("outcome", ended)


def windowed(events: DataFrame, late: str = "1 hour", width: str = "6 hours") -> DataFrame:
    """An extension: counts and sums of events (ts, event_type, value) by windows of event time, for streams and batches."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def ext_tumbling_windows(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("ts", "event_type", money("value").alias("value"))
    return windowed(events).select(F.col("window.start").cast("timestamp_ntz").cast("string").alias("start"), "event_type", "n", F.col("total").cast("decimal(24,2)").alias("total"))


def ext_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """An extension: sessions of users that end after two days without an event."""
    sessions = table(spark, folder, "events").groupBy("user_id", F.session_window("ts", "2 days")).agg(F.count(F.lit(1)).alias("n"))
    return sessions.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.max("n").alias("longest"))


def ext_grouping_sets(spark: SparkSession, folder: str) -> DataFrame:
    """An extension: totals by status and priority, by each, and of all."""
    orders = table(spark, folder, "orders").select("o_orderstatus", "o_orderpriority", money("o_totalprice").alias("amount"))
    return orders.cube("o_orderstatus", "o_orderpriority").agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n"), F.sum("amount").cast("decimal(24,2)").alias("total"))


QUERIES = {f.__name__: f for f in (stream_telemetry, request_timings, stream_request_timings, gap_medians, stage_totals, ext_tumbling_windows, ext_sessions, ext_grouping_sets)}
_TIMINGS = """
WITH marks AS (SELECT user_id AS request_id, epoch_us(ts) AS moment, CASE event_type WHEN 'signup' THEN 'sent' WHEN 'view' THEN 'token' WHEN 'click' THEN 'token' WHEN 'purchase' THEN 'done' END AS kind FROM events),
states AS (
  SELECT request_id, min(moment) FILTER (WHERE kind = 'sent') AS sent, min(moment) FILTER (WHERE kind = 'token') AS first, max(moment) FILTER (WHERE kind = 'token') AS last, min(moment) FILTER (WHERE kind = 'done') AS done,
    count(*) FILTER (WHERE kind = 'token') AS n_tokens FROM marks WHERE kind IS NOT NULL GROUP BY 1),
tenths AS (SELECT *, first - sent AS a, done - sent AS b, CASE WHEN last > first THEN (2 * 10000000 * CAST(n_tokens AS HUGEINT) + (last - first)) // (2 * (last - first)) END AS r FROM states)
SELECT request_id, n_tokens, CAST(CAST(sign(a) * ((abs(a) + 50) // 100) AS DECIMAL(18,0)) * 0.1::DECIMAL(2,1) AS DECIMAL(18,1)) AS ttft_ms,
  CAST(CAST(sign(b) * ((abs(b) + 50) // 100) AS DECIMAL(18,0)) * 0.1::DECIMAL(2,1) AS DECIMAL(18,1)) AS e2e_ms, CAST(CAST(r AS DECIMAL(18,0)) * 0.1::DECIMAL(2,1) AS DECIMAL(18,1)) AS tokens_per_sec FROM tenths"""
ORACLE = {
    "request_timings": _TIMINGS,
    "stream_request_timings": _TIMINGS,
    "gap_medians": """
WITH gaps AS (SELECT user_id, CAST(floor((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) / 1000) AS BIGINT) AS gap FROM events)
SELECT user_id, median(gap) AS median FROM gaps WHERE gap IS NOT NULL GROUP BY 1""",
    "stage_totals": "SELECT user_id AS request_id, event_type AS stage, CAST(sum(CAST(CAST(value AS DECIMAL(18,2)) * 100 AS BIGINT)) AS BIGINT) AS micros FROM events GROUP BY 1, 2",
    "stream_telemetry": """
WITH gaps AS (SELECT user_id, CAST(floor((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) / 1000) AS BIGINT) AS gap FROM events),
lists AS (SELECT user_id, list_sort(list(gap)) AS v FROM gaps WHERE gap IS NOT NULL GROUP BY 1),
ends AS (SELECT user_id, count(*) AS n_marks, CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000) AS BIGINT) AS total_ms FROM events GROUP BY 1)
SELECT user_id, n_marks, total_ms, v[CAST(round_even(0.5 * (len(v) - 1), 0) AS INTEGER) + 1] AS p50_ms, v[CAST(round_even(0.95 * (len(v) - 1), 0) AS INTEGER) + 1] AS p95_ms FROM ends LEFT JOIN lists USING (user_id)""",
    "ext_tumbling_windows": """SELECT strftime(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(24,2)) AS total FROM events GROUP BY 1, 2""",
    "ext_sessions": """
WITH marked AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 DAYS THEN 0 ELSE 1 END AS opens FROM events),
numbered AS (SELECT user_id, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM marked),
sessions AS (SELECT user_id, session, count(*) AS n FROM numbered GROUP BY 1, 2)
SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM sessions GROUP BY 1""",
    "ext_grouping_sets": """SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus, o_orderpriority) AS INTEGER) AS level, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(24,2)) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""",
}
