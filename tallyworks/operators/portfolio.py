"""Portfolio views: totals, latest results, heat map, lists and details of projects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyworks.functions.numbers import level_rank, money, rank_level, rounded
from tallyworks.operators.trends import project_years
from tallyworks.sources.tables import table

#: The analogue of the risk levels, the mildest first.
LEVELS = ("view", "click", "signup", "error")


def latest(rows: DataFrame, key: str, newest: list) -> DataFrame:
    """The first row of each key in the order newest, which decides ties too."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*newest))
    return rows.withColumn("_place", place).filter("_place = 1").drop("_place")


def latest_results(spark: SparkSession, folder: str) -> DataFrame:
    """The last event of each user stands for the last result of each project."""
    events = table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return latest(events, "user_id", [F.desc("ts"), F.desc("event_id")])


def latest_per_key(spark: SparkSession, folder: str) -> DataFrame:
    return latest_results(spark, folder).select("user_id", "event_id", "event_type", money("value", "decimal(18,4)").alias("score"))


def overview_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Five totals in one row; each is an aggregate of its own."""
    counts = [table(spark, folder, t).agg(F.count(F.lit(1)).alias(name)) for t, name in (("orders", "project_count"), ("nation", "sub_district_count"), ("documents", "document_count"))]
    budget = table(spark, folder, "orders").agg(F.coalesce(F.sum(F.coalesce(money("o_totalprice"), F.lit(0).cast("decimal(18,2)"))), F.lit(0)).cast("decimal(24,2)").alias("budget_total_sum"))
    scored = table(spark, folder, "events").agg(F.countDistinct("user_id").alias("scored_project_count"))
    out = counts[0]
    for row in (*counts[1:], budget, scored):
        out = out.join(F.broadcast(row), F.lit(True))
    return out


def overview_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return latest_results(spark, folder).groupBy(F.col("event_type").alias("risk_level")).agg(F.count(F.lit(1)).alias("n"))


def scored_projects(spark: SparkSession, folder: str) -> DataFrame:
    """Projects with the latest result, if there is any, of their customer."""
    results = latest_results(spark, folder).select("user_id", F.col("event_type").alias("risk_level"), money("value", "decimal(18,4)").alias("score"))
    return project_years(spark, folder).join(results, F.col("o_custkey") == F.col("user_id"), "left").withColumn("rank", level_rank(F.col("risk_level"), LEVELS))


def overview_heatmap(spark: SparkSession, folder: str) -> DataFrame:
    average = rounded(F.sum("score").cast("double") / F.nullif(F.count("score"), F.lit(0)).cast("double"))
    grouped = scored_projects(spark, folder).groupBy(F.col("n_name").alias("sub_district"), "fiscal_year").agg(F.count(F.lit(1)).alias("project_count"), F.sum("amount").cast("decimal(18,2)").alias("budget_total"), average.alias("avg_score"), F.max("rank").alias("worst_rank"))
    return grouped.withColumn("worst_level", rank_level(F.col("worst_rank"), LEVELS))


def overview_top5(spark: SparkSession, folder: str) -> DataFrame:
    """The five worst of all projects; Spark keeps five rows of each task."""
    found = scored_projects(spark, folder).filter("risk_level is not null")
    return found.orderBy(F.desc_nulls_last("rank"), F.desc("score"), "o_orderkey").limit(5).select(F.col("o_orderkey").alias("project_id"), F.col("n_name").alias("sub_district"), "fiscal_year", "risk_level", "score")


def listed(projects: DataFrame, year: int | None = None, area: str | None = None, level: str | None = None, text: str | None = None) -> DataFrame:
    """Projects under those filters that are given; text matches any part of the name, in either case."""
    for column, value in (("fiscal_year", year), ("n_name", area), ("risk_level", level)):
        if value is not None:
            projects = projects.filter(F.col(column) == value)
    return projects if text is None else projects.filter(F.col("name").ilike(f"%{text}%"))


def projects_filtered(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("name"))
    projects = scored_projects(spark, folder).join(names, F.col("o_orderkey") == F.col("key"))
    return listed(projects, year=1997, text="urg").select(F.col("o_orderkey").alias("project_id"), "n_name", "fiscal_year", "name", "risk_level")


def projects_ranked(spark: SparkSession, folder: str) -> DataFrame:
    """Projects with their findings' number of flags, the worst first; what is missing counts as 0."""
    flags = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_returnflag")).alias("checks"))
    projects = scored_projects(spark, folder).join(flags, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    flagged = F.coalesce(F.size(F.filter("checks", lambda c: c == "R")), F.lit(0))
    zero = F.lit(0)
    return projects.select(F.col("o_orderkey").alias("project_id"), "fiscal_year", F.coalesce("rank", zero).alias("rank"), F.coalesce("score", zero.cast("decimal(18,4)")).alias("score"), F.when(F.col("checks").isNull(), zero).otherwise(flagged).alias("flag_count")).orderBy(F.desc("rank"), F.desc("score"), F.desc("fiscal_year"), "project_id")


def project_detail(spark: SparkSession, folder: str, project: int = 7) -> DataFrame:
    """The bids of one project, winners first and then by amount; the filter reaches the scan."""
    lines = table(spark, folder, "lineitem").filter(F.col("l_orderkey") == project)
    return lines.select(F.col("l_suppkey").alias("bidder"), money("l_extendedprice").alias("amount"), (F.col("l_linenumber") == 1).alias("is_winner")).orderBy(F.desc("is_winner"), "amount", "bidder")


def pivot_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Totals with a column for each of three years."""
    years = [1996, 1997, 1998]
    wide = project_years(spark, folder).groupBy(F.col("n_name").alias("sub_district")).pivot("fiscal_year", years).agg(F.sum("amount").cast("decimal(18,2)"))
    return wide.select("sub_district", *[F.col(str(y)).alias(f"budget_{y}") for y in years])


QUERIES = {f.__name__: f for f in (latest_per_key, overview_totals, overview_distribution, overview_heatmap, overview_top5, projects_filtered, projects_ranked, project_detail, pivot_lookup)}

_SCORED = """
WITH latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place = 1),
results AS (SELECT user_id, event_id, event_type AS risk_level, CAST(value AS DECIMAL(18,4)) AS score FROM latest),
projects AS (
  SELECT o_orderkey, n_name, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, o_orderpriority AS name, risk_level, score,
    CASE risk_level WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'error' THEN 4 END AS rank
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN results ON user_id = o_custkey)
"""
ORACLE = {
    "latest_per_key": _SCORED + "SELECT user_id, event_id, risk_level AS event_type, score FROM results",
    "overview_totals": """
SELECT (SELECT count(*) FROM orders) AS project_count, (SELECT count(*) FROM nation) AS sub_district_count, (SELECT count(*) FROM documents) AS document_count,
  CAST((SELECT coalesce(sum(coalesce(CAST(o_totalprice AS DECIMAL(18,2)), 0)), 0) FROM orders) AS DECIMAL(24,2)) AS budget_total_sum,
  (SELECT count(DISTINCT user_id) FROM events) AS scored_project_count""",
    "overview_distribution": _SCORED + "SELECT risk_level, count(*) AS n FROM results GROUP BY 1",
    "overview_heatmap": _SCORED
    + """, grouped AS (
  SELECT n_name AS sub_district, fiscal_year, count(*) AS project_count, CAST(sum(amount) AS DECIMAL(18,2)) AS budget_total,
    CAST(round(CAST(CAST(sum(score) AS DOUBLE) / nullif(count(score), 0) AS DECIMAL(38,10)), 1) AS DECIMAL(18,1)) AS avg_score, max(rank) AS worst_rank
  FROM projects GROUP BY 1, 2)
SELECT *, CASE worst_rank WHEN 1 THEN 'view' WHEN 2 THEN 'click' WHEN 3 THEN 'signup' WHEN 4 THEN 'error' END AS worst_level FROM grouped""",
    "overview_top5": _SCORED + "SELECT o_orderkey AS project_id, n_name AS sub_district, fiscal_year, risk_level, score FROM projects WHERE risk_level IS NOT NULL ORDER BY rank DESC NULLS LAST, score DESC, o_orderkey LIMIT 5",
    "projects_filtered": _SCORED + "SELECT o_orderkey AS project_id, n_name, fiscal_year, name, risk_level FROM projects WHERE fiscal_year = 1997 AND name ILIKE '%urg%'",
    "projects_ranked": _SCORED
    + """, flags AS (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'R') AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey AS project_id, fiscal_year, coalesce(rank, 0) AS rank, CAST(coalesce(score, 0) AS DECIMAL(18,4)) AS score, CAST(coalesce(n, 0) AS INTEGER) AS flag_count
FROM projects LEFT JOIN flags ON l_orderkey = o_orderkey""",
    "project_detail": "SELECT l_suppkey AS bidder, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, l_linenumber = 1 AS is_winner FROM lineitem WHERE l_orderkey = 7",
    "pivot_lookup": _SCORED
    + "SELECT n_name AS sub_district, "
    + ", ".join(f"CAST(sum(amount) FILTER (WHERE fiscal_year = {y}) AS DECIMAL(18,2)) AS budget_{y}" for y in (1996, 1997, 1998))
    + " FROM projects GROUP BY 1",
}
