"""Risk scores from weighted factors, evidence blocks, and validation of results before they are written."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from tallyworks.functions.numbers import money, risk_band
from tallyworks.functions.text import BANNED, banned_terms
from tallyworks.sources.shared import shared_folder
from tallyworks.sources.tables import table

#: Factors in their fixed order, all of one weight; the driver's event types stand for them.
FACTORS = ("signup", "purchase", "error", "view", "click")
#: How far weights may miss a sum of 1.
TOLERANCE = 1e-6


def assessed(factors: DataFrame, key: str, flags: Column) -> DataFrame:
    """Overall score, level and the two highest factors of each key.

    factors: key, factor, score (a decimal of two digits). Weights are shared among the factors
    that are there, so one that is missing changes nothing but the number of shares. Rounding is
    half to even; of equal factors the first in order comes first. flags says of a group whether a
    high finding calls for an investigation.
    """
    order = F.array_position(F.array(*map(F.lit, FACTORS)), F.col("factor"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), order.alias("place"), F.col("factor"))))
    grouped = factors.groupBy(key).agg(F.count(F.lit(1)).alias("n_factors"), F.sum("score").alias("_sum"), ranked.alias("_ranked"), flags.alias("has_high"))
    score = F.bround(F.col("_sum").cast("decimal(24,10)") / F.col("n_factors"), 2).cast("decimal(5,2)")
    top = F.array_join(F.transform(F.slice("_ranked", 1, 2), lambda f: f["factor"]), ",")
    scored = grouped.select(key, "n_factors", score.alias("overall_score"), "has_high", top.alias("top_factors"))
    return scored.withColumn("risk_level", risk_band(F.col("overall_score"), F.col("has_high")))


def event_factors(spark: SparkSession, folder: str) -> DataFrame:
    """A score for each user and event type: the mean of its values, 100 at most."""
    events = table(spark, folder, "events").select("user_id", "event_type", money("value").alias("value"))
    mean = F.sum("value").cast("double") / F.count("value")
    return events.groupBy("user_id", F.col("event_type").alias("factor")).agg(F.least(mean * 3, F.lit(100.0)).cast("decimal(38,10)").cast("decimal(5,2)").alias("score"))


def event_assessments(factors: DataFrame) -> DataFrame:
    """assessed() of event_factors(); a high score of errors calls for an investigation."""
    return assessed(factors, "user_id", F.max(F.when(F.col("factor") == "error", F.col("score") > 90).otherwise(False)))


def risk_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    return event_assessments(event_factors(spark, folder)).drop("has_high")


LEVELS = ("LOW", "MEDIUM", "HIGH", "REQUIRES_INVESTIGATION")


def told(rules: dict[str, Column]) -> Column:
    """The names of the rules that a row breaks; a rule is what must hold, and NULL doesn't."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items()]))


def broken_rules(results: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key and rule of every rule that a row breaks. All rules are tried on all rows in one pass."""
    return results.select(key, F.explode(told(rules)).alias("rule"))


def validated(results: DataFrame, known: DataFrame, cited: str, words: str, phrases: tuple[str, ...] = (), terms: tuple[str, ...] = BANNED) -> DataFrame:
    """results and violations, the names of the rules that each one breaks.

    The score lies within 0 to 100, the level is of the closed set, what is cited is known, and the
    words hold none of the banned terms. A NULL score, level, reference or text breaks its rule.
    """
    there = known.select(F.col(known.columns[0]).alias(cited)).distinct().withColumn("_known", F.lit(True))
    rules = {"score_range": F.col("score").between(0, 100), "level": F.col("level").isin(*LEVELS), "citation": F.col("_known"), "lexicon": F.when(F.col(words).isNotNull(), F.size(banned_terms(F.col(words), phrases, terms)) == 0)}
    return results.join(there, cited, "left").withColumn("violations", told(rules)).select(*results.columns, "violations")


def broken(results: DataFrame, key: str, known: DataFrame, cited: str, words: str, phrases: tuple[str, ...] = (), terms: tuple[str, ...] = BANNED) -> DataFrame:
    """key and rule of every rule of validated() that a result breaks."""
    return validated(results, known, cited, words, phrases, terms).select(key, F.explode("violations").alias("rule"))


def accepted(found: DataFrame) -> DataFrame:
    """The results of validated() that break no rule; others are turned away whole."""
    return found.filter(F.size("violations") == 0).drop("violations")


def accept_and_refuse(found: DataFrame, key: str, folder: str) -> dict[str, int]:
    """Write the results of validated() once, those that are accepted and the others apart, and count both and the broken rules as they pass.

    folder/accepted=true and folder/accepted=false are the two tables; see outcomes().
    """
    seen = Observation()
    clean = F.size("violations") == 0
    counted = found.observe(seen, F.count(F.lit(1)).alias("results"), F.coalesce(F.sum(clean.cast("long")), F.lit(0)).alias("accepted"), F.coalesce(F.sum(F.size("violations").cast("long")), F.lit(0)).alias("broken"))
    counted.withColumn("accepted", clean).write.partitionBy("accepted").mode("errorifexists").parquet(folder)
    return seen.get


def outcomes(spark: SparkSession, folder: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """Both tables that accept_and_refuse() has written of rows of that schema: accepted results, and those with violations."""
    rows = spark.read.schema(StructType([*schema.fields, StructField("accepted", BooleanType())])).parquet(folder)
    return rows.filter("accepted").drop("accepted", "violations"), rows.filter("not accepted").drop("accepted")


def order_results(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as results: a score from the price, a level from the priority, a supplier as citation; some lack one or another."""
    orders = table(spark, folder, "orders")
    level = F.when(F.col("o_orderpriority").startswith("1"), "HIGH").when(F.col("o_orderpriority").startswith("2"), "MEDIUM").when(F.col("o_orderpriority").startswith("3"), "LOW").otherwise(F.col("o_orderpriority"))
    return orders.select(F.col("o_orderkey").alias("result_id"), F.when(F.col("o_orderkey") % 11 > 0, F.floor(F.col("o_totalprice") / 4000).cast("long")).alias("score"), level.alias("level"), F.when(F.col("o_orderkey") % 17 > 0, F.col("o_orderkey") % 120).alias("cited"), F.when(F.col("o_orderkey") % 13 > 0, F.col("o_orderpriority")).alias("words"))


def _validated(spark: SparkSession, folder: str) -> DataFrame:
    return validated(order_results(spark, folder), table(spark, folder, "supplier").select("s_suppkey"), "cited", "words", terms=("low",))


def risk_validate(spark: SparkSession, folder: str) -> DataFrame:
    return _validated(spark, folder).select("result_id", F.explode("violations").alias("rule"))


def risk_accepted(spark: SparkSession, folder: str) -> DataFrame:
    return accepted(_validated(spark, folder)).select("result_id", "score", "level")


def risk_written(spark: SparkSession, folder: str) -> DataFrame:
    """Both tables of a run that validates and writes, by rule, beside what the run counted."""
    found = _validated(spark, folder)
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    counts = accept_and_refuse(found, "result_id", path)
    good, bad = outcomes(spark, path, found.schema)
    rows = bad.select(F.explode("violations").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.unionByName(good.agg(F.lit("-").alias("rule"), F.count(F.lit(1)).alias("n")))
    return rows.select("rule", "n", *[F.lit(counts[c]).cast("long").alias(c) for c in ("results", "accepted", "broken")])


def unordered_weights(results: DataFrame, key: str) -> DataFrame:
    """Keys whose factors' weights (key, weight) don't sum to 1."""
    return results.groupBy(key).agg(F.sum("weight").alias("total")).filter(F.abs(F.col("total") - 1) > TOLERANCE)


def evidence_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The text block of each source: its first documents, each clamped to 60 characters, in order."""
    docs = table(spark, folder, "documents").select("source", "doc_id", "text")
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    first = docs.withColumn("place", place).filter("place <= 3")
    lines = F.array_sort(F.collect_list(F.struct("place", F.concat(F.lit("["), F.col("doc_id"), F.lit("] "), F.substring("text", 1, 60)).alias("line"))))
    return first.groupBy("source").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("block"))


QUERIES = {"risk_aggregate": risk_aggregate, "risk_validate": risk_validate, "risk_accepted": risk_accepted, "risk_written": risk_written, "evidence_blocks": evidence_blocks}

_RESULTS = """
WITH results AS (
  SELECT o_orderkey AS result_id, CASE WHEN o_orderkey % 11 > 0 THEN CAST(floor(o_totalprice / 4000) AS BIGINT) END AS score,
    CASE left(o_orderpriority, 1) WHEN '1' THEN 'HIGH' WHEN '2' THEN 'MEDIUM' WHEN '3' THEN 'LOW' ELSE o_orderpriority END AS level, CASE WHEN o_orderkey % 17 > 0 THEN o_orderkey % 120 END AS cited, CASE WHEN o_orderkey % 13 > 0 THEN o_orderpriority END AS words FROM orders),
broken AS (
  SELECT result_id, 'score_range' AS rule FROM results WHERE score IS NULL OR score NOT BETWEEN 0 AND 100
  UNION ALL SELECT result_id, 'level' FROM results WHERE level NOT IN ('LOW', 'MEDIUM', 'HIGH', 'REQUIRES_INVESTIGATION')
  UNION ALL SELECT result_id, 'citation' FROM results WHERE cited IS NULL OR cited NOT IN (SELECT s_suppkey FROM supplier)
  UNION ALL SELECT result_id, 'lexicon' FROM results WHERE words IS NULL OR contains(lower(words), 'low'))
"""
ORACLE = {
    "risk_aggregate": """
WITH factors AS (
  SELECT user_id, event_type AS factor, CAST(CAST(least(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(value) * 3, 100.0::DOUBLE) AS DECIMAL(38,10)) AS DECIMAL(5,2)) AS score FROM events GROUP BY 1, 2),
sums AS (
  SELECT user_id, count(*) AS n_factors, CAST(sum(score) * 100 AS BIGINT) AS s, coalesce(bool_or(factor = 'error' AND score > 90), false) AS high,
    array_to_string((list(factor ORDER BY score DESC, list_position(['signup', 'purchase', 'error', 'view', 'click'], factor)))[1:2], ',') AS top_factors FROM factors GROUP BY 1),
scored AS (
  SELECT *, CAST((s // n_factors + CASE WHEN 2 * (s % n_factors) > n_factors OR (2 * (s % n_factors) = n_factors AND (s // n_factors) % 2 = 1) THEN 1 ELSE 0 END) AS DECIMAL(18,0)) * 0.01::DECIMAL(3,2) AS score FROM sums)
SELECT user_id, n_factors, CAST(score AS DECIMAL(5,2)) AS overall_score, top_factors,
  CASE WHEN high OR score >= 75 THEN 'REQUIRES_INVESTIGATION' WHEN score >= 55 THEN 'HIGH' WHEN score >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM scored""",
    "risk_validate": _RESULTS + "SELECT * FROM broken",
    "risk_accepted": _RESULTS + "SELECT result_id, score, level FROM results WHERE result_id NOT IN (SELECT result_id FROM broken)",
    "risk_written": _RESULTS + """, totals AS (SELECT (SELECT count(*) FROM results) AS results, (SELECT count(*) FROM results WHERE result_id NOT IN (SELECT result_id FROM broken)) AS accepted, (SELECT count(*) FROM broken) AS broken)
SELECT rule, count(*) AS n, any_value(totals.results) AS results, any_value(accepted) AS accepted, any_value(totals.broken) AS broken FROM broken AS b, totals GROUP BY rule
UNION ALL SELECT '-', accepted, results, accepted, broken FROM totals""",
    "evidence_blocks": """
SELECT source, string_agg('[' || doc_id || '] ' || left(text, 60), chr(10) ORDER BY place) AS block
FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents) WHERE place <= 3 GROUP BY 1""",
}
