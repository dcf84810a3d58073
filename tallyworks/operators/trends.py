"""Year-over-year trends and contractor concentration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyworks.functions.numbers import money, percent_change, rounded
from tallyworks.sources.tables import table


def project_years(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each order: its nation (the sub-district), year and amount."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("fiscal_year"), money("o_totalprice").alias("amount"))
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))


def budget_trend(projects: DataFrame, area: str = "n_name", year: str = "fiscal_year", amount: str = "amount") -> DataFrame:
    """Totals by area and year, with the change on the last year recorded before, whichever that is."""
    yearly = projects.groupBy(area, year).agg(F.count(F.lit(1)).alias("project_count"), F.sum(amount).cast("decimal(18,2)").alias("budget_total"))
    before = F.lag("budget_total").over(Window.partitionBy(area).orderBy(year))
    return yearly.withColumn("yoy_pct", percent_change(F.col("budget_total"), before))


def trends_budget_yoy(spark: SparkSession, folder: str) -> DataFrame:
    return budget_trend(project_years(spark, folder)).withColumnRenamed("n_name", "sub_district")


def concentration(bids: DataFrame) -> DataFrame:
    """For each bidder its bids, what it won, its share of all that was awarded, and the years.

    bids: bidder, year, amount, is_winner. The share divides by a sum over the bidders' sums, so
    only one row for each bidder meets in one place.
    """
    won = F.when(F.col("is_winner"), F.col("amount"))
    each = bids.groupBy("bidder").agg(F.count(F.lit(1)).alias("bids_submitted"), F.count(F.when(F.col("is_winner"), 1)).alias("contracts_won"), F.sum(won).cast("decimal(18,2)").alias("total_awarded"), F.array_sort(F.collect_set("year")).alias("years"))
    whole = each.agg(F.sum("total_awarded").cast("double").alias("whole"))
    share = rounded(F.lit(100.0) * F.col("total_awarded").cast("double") / F.nullif(F.col("whole"), F.lit(0.0)))
    return each.join(F.broadcast(whole), F.lit(True)).withColumn("awarded_share_pct", share).drop("whole")


def trends_contractor_concentration(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", money("l_extendedprice").alias("amount"), (F.col("l_linenumber") == 1).alias("is_winner"))
    orders = table(spark, folder, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    bids = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_suppkey").alias("bidder"), "year", "amount", "is_winner")
    return concentration(bids).withColumn("fiscal_years", F.array_join(F.col("years").cast("array<string>"), ",")).drop("years").orderBy(F.desc_nulls_last("total_awarded"), F.desc("contracts_won"), "bidder")


def report_trend(spark: SparkSession, folder: str) -> DataFrame:
    """Yearly report totals by area with their change, and the three largest items of each report."""
    projects = project_years(spark, folder)
    place = F.row_number().over(Window.partitionBy("n_name", "fiscal_year").orderBy(F.desc("amount"), "o_orderkey"))
    top = projects.withColumn("place", place).filter("place <= 3").groupBy("n_name", "fiscal_year").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "o_orderkey", "amount"))), lambda s: F.concat_ws(":", s["o_orderkey"], s["amount"])), ",").alias("top_items"))
    return budget_trend(projects).join(top, ["n_name", "fiscal_year"]).withColumnRenamed("n_name", "sub_district")


QUERIES = {"trends_budget_yoy": trends_budget_yoy, "trends_contractor_concentration": trends_contractor_concentration, "report_trends": report_trend}

_YEARLY = """
WITH projects AS (
  SELECT n_name, o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year, CAST(o_totalprice AS DECIMAL(18,2)) AS amount
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
yearly AS (
  SELECT n_name, fiscal_year, count(*) AS project_count, CAST(sum(amount) AS DECIMAL(18,2)) AS budget_total FROM projects GROUP BY 1, 2),
lagged AS (SELECT *, lag(budget_total) OVER (PARTITION BY n_name ORDER BY fiscal_year) AS before FROM yearly),
trend AS (
  SELECT n_name AS sub_district, fiscal_year, project_count, budget_total,
         CAST(round(CAST(100.0::DOUBLE * CAST(budget_total - before AS DOUBLE) / nullif(CAST(before AS DOUBLE), 0) AS DECIMAL(38,10)), 1) AS DECIMAL(18,1)) AS yoy_pct
  FROM lagged)
"""
ORACLE = {
    "trends_budget_yoy": _YEARLY + "SELECT * FROM trend",
    "report_trends": _YEARLY
    + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY n_name, fiscal_year ORDER BY amount DESC, o_orderkey) AS place FROM projects),
top AS (
  SELECT n_name, fiscal_year, string_agg(CAST(o_orderkey AS VARCHAR) || ':' || CAST(amount AS VARCHAR), ',' ORDER BY place) AS top_items
  FROM ranked WHERE place <= 3 GROUP BY 1, 2)
SELECT trend.*, top_items FROM trend JOIN top ON top.n_name = sub_district AND top.fiscal_year = trend.fiscal_year""",
    "trends_contractor_concentration": """
WITH each AS (
  SELECT l_suppkey AS bidder, count(*) AS bids_submitted, count(*) FILTER (WHERE l_linenumber = 1) AS contracts_won,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (WHERE l_linenumber = 1) AS DECIMAL(18,2)) AS total_awarded,
         array_to_string(list_sort(list(DISTINCT year(o_orderdate))), ',') AS fiscal_years
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
SELECT *, CAST(round(CAST(100.0::DOUBLE * CAST(total_awarded AS DOUBLE) / nullif(CAST(sum(total_awarded) OVER () AS DOUBLE), 0) AS DECIMAL(38,10)), 1) AS DECIMAL(18,1)) AS awarded_share_pct
FROM each""",
}
