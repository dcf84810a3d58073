"""Unit prices of tracked items: series, standards, spikes, vendor lock, findings, and matching of lines to projects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyworks.functions.numbers import money, percent_change
from tallyworks.sources.tables import table

SPIKE = 0.3


def item_facts(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each area, item and year: quantity, total, unit price, the winner and the number of bids.

    Lines of an order are its bids; the one with the least supplier among the winners stands for them.
    """
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", money("l_quantity").alias("quantity"), money("l_extendedprice").alias("total"))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("fiscal_year"))
    areas = table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("area"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(areas, F.col("o_custkey") == F.col("c_custkey"))
    sums = joined.groupBy("area", F.col("l_partkey").alias("item"), "fiscal_year").agg(
        F.sum("quantity").cast("decimal(18,2)").alias("quantity"), F.sum("total").cast("decimal(18,2)").alias("total"), F.min(F.when(F.col("l_linenumber") == 1, F.col("l_suppkey"))).alias("winner"), F.count(F.lit(1)).alias("bid_count")
    )
    return sums.withColumn("unit_price", (F.col("total").cast("double") / F.nullif(F.col("quantity").cast("double"), F.lit(0.0))).cast("decimal(38,10)").cast("decimal(14,2)"))


def by_year() -> Window:
    return Window.partitionBy("area", "item").orderBy("fiscal_year")


def item_price_series(spark: SparkSession, folder: str) -> DataFrame:
    """Unit prices by area and item with the change on the year recorded before."""
    before = F.lag("unit_price").over(by_year())
    return item_facts(spark, folder).select("area", "item", "fiscal_year", "quantity", "total", "unit_price", percent_change(F.col("unit_price"), before).alias("unit_price_yoy_pct"))


def item_bid_count(spark: SparkSession, folder: str) -> DataFrame:
    """How many bids each project had, 0 without any; the count is taken before the join."""
    bids = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    orders = table(spark, folder, "orders").select("o_orderkey")
    return orders.join(bids, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("project_id"), F.coalesce("n", F.lit(0)).alias("bid_count"))


def against_standard(facts: DataFrame, standards: DataFrame) -> DataFrame:
    """FLAG for a unit price over the item's standard price, OK for others, NA without a standard."""
    joined = facts.join(standards, "item", "left")
    status = F.when(F.col("standard").isNull(), "NA").when(F.col("unit_price") > F.col("standard"), "FLAG").otherwise("OK")
    percent = F.floor(F.lit(1000) * F.col("unit_price").cast("double") / F.nullif(F.col("standard").cast("double"), F.lit(0.0)))
    return joined.select("area", "item", "fiscal_year", "unit_price", "standard", status.alias("status"), percent.cast("long").alias("permille"))


def item_vs_standard(spark: SparkSession, folder: str) -> DataFrame:
    """Items of one brand in three have a standard price."""
    standards = table(spark, folder, "part").filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("item"), money("p_retailprice", "decimal(14,2)").alias("standard"))
    return against_standard(item_facts(spark, folder), standards)


def spikes(facts: DataFrame, least: float = SPIKE) -> DataFrame:
    """Both years of each rise by at least that part on the year recorded before; HIGH when the vendor is the same.

    A year is in the result once for each rise that it is part of, as start or as end.
    """
    price, year, winner = (F.lag(c).over(by_year()) for c in ("unit_price", "fiscal_year", "winner"))
    lagged = facts.select("area", "item", "fiscal_year", "unit_price", "winner", price.alias("from_price"), year.alias("from_year"), winner.alias("from_winner"))
    found = lagged.filter((F.col("from_price") > 0) & ((F.col("unit_price") - F.col("from_price")) >= F.col("from_price") * F.lit(least).cast("decimal(4,2)")))
    severity = F.when(F.col("winner") == F.col("from_winner"), "HIGH").otherwise("MEDIUM")
    both = found.withColumn("severity", severity).withColumn("member_year", F.explode(F.array("from_year", "fiscal_year")))
    return both.select("area", "item", "member_year", "from_year", F.col("fiscal_year").alias("to_year"), percent_change(F.col("unit_price"), F.col("from_price")).alias("growth_pct"), "severity")


def item_price_spike(spark: SparkSession, folder: str) -> DataFrame:
    return spikes(item_facts(spark, folder))


def vendor_lock(facts: DataFrame) -> DataFrame:
    """Items that one vendor has won in all their years, two at least: the years, those with one bid, and the sum."""
    grouped = facts.groupBy("area", "item").agg(
        F.count(F.lit(1)).alias("recorded"), F.count("winner").alias("won"), F.min("winner").alias("vendor"), F.max("winner").alias("other"), F.array_sort(F.collect_list("fiscal_year")).alias("years"), F.array_sort(F.collect_list(F.when(F.col("bid_count") <= 1, F.col("fiscal_year")))).alias("single"), F.sum("total").cast("decimal(18,2)").alias("cumulative_amount")
    )
    locked = grouped.filter("recorded >= 2 and won = recorded and vendor = other")
    return locked.select("area", "item", "vendor", F.array_join(F.col("years").cast("array<string>"), ",").alias("fiscal_years"), F.array_join(F.col("single").cast("array<string>"), ",").alias("single_bid_years"), "cumulative_amount")


def item_vendor_lock(spark: SparkSession, folder: str) -> DataFrame:
    return vendor_lock(item_facts(spark, folder))


def findings_lateral_distinct(spark: SparkSession, folder: str) -> DataFrame:
    """Findings held as JSON, a row for each, and of those with the same name and detail the one of the least event."""
    events = table(spark, folder, "events").select("event_id", "event_type", "props")
    each = events.select("event_id", "event_type", F.explode(F.from_json("props", "map<string,int>")).alias("name", "detail"))
    place = F.row_number().over(Window.partitionBy("event_type", "name", "detail").orderBy("event_id"))
    return each.withColumn("place", place).filter("place = 1").select("event_type", "name", "detail", "event_id")


def exactly_one(lines: DataFrame, candidates: DataFrame, keys: list[str], line: str, candidate: str) -> DataFrame:
    """Each line with its one candidate that has the same keys, or NULL if it has none or several.

    Candidates are counted by key before the join, so no line meets more than one.
    """
    single = candidates.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(candidate).alias(candidate)).filter("_n = 1").drop("_n")
    return lines.join(single, keys, "left").select(line, candidate)


def exactly_one_match(spark: SparkSession, folder: str) -> DataFrame:
    """Orders and the supplier of the same nation with the same whole balance, if there is one only."""
    customers = table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("area"), F.floor(F.col("c_acctbal") / 100).cast("long").alias("amount"))
    suppliers = table(spark, folder, "supplier").select("s_suppkey", F.col("s_nationkey").alias("area"), F.floor(F.col("s_acctbal") / 100).cast("long").alias("amount"))
    return exactly_one(customers, suppliers, ["area", "amount"], "c_custkey", "s_suppkey")


def project_item_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Items of projects with area, winners and bids: a project with several winners has its items several times."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", money("l_extendedprice").alias("total"))
    winners = lines.filter("l_linenumber = 1").select(F.col("l_orderkey").alias("project"), F.col("l_suppkey").alias("winner"))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("fiscal_year"))
    areas = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    names = table(spark, folder, "nation").select("n_nationkey", "n_name")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(areas, F.col("o_custkey") == F.col("c_custkey")).join(names, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.join(winners, F.col("l_orderkey") == F.col("project"), "left").groupBy("n_name", "fiscal_year").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("winner").alias("n_winners"), F.sum("total").cast("decimal(24,2)").alias("total"))


QUERIES = {f.__name__: f for f in (item_price_series, item_bid_count, item_vs_standard, item_price_spike, item_vendor_lock, findings_lateral_distinct, exactly_one_match, project_item_rows)}

_FACTS = """
WITH sums AS (
  SELECT c_nationkey AS area, l_partkey AS item, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year,
    CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS quantity, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS total,
    min(l_suppkey) FILTER (WHERE l_linenumber = 1) AS winner, count(*) AS bid_count
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
facts AS (SELECT *, CAST(CAST(CAST(total AS DOUBLE) / nullif(CAST(quantity AS DOUBLE), 0) AS DECIMAL(38,10)) AS DECIMAL(14,2)) AS unit_price FROM sums),
lagged AS (
  SELECT *, lag(unit_price) OVER w AS from_price, lag(fiscal_year) OVER w AS from_year, lag(winner) OVER w AS from_winner
  FROM facts WINDOW w AS (PARTITION BY area, item ORDER BY fiscal_year)),
changes AS (
  SELECT *, CAST(round(CAST(100.0::DOUBLE * CAST(unit_price - from_price AS DOUBLE) / nullif(CAST(from_price AS DOUBLE), 0) AS DECIMAL(38,10)), 1) AS DECIMAL(18,1)) AS pct FROM lagged)
"""
ORACLE = {
    "item_price_series": _FACTS + "SELECT area, item, fiscal_year, quantity, total, unit_price, pct AS unit_price_yoy_pct FROM changes",
    "item_bid_count": "SELECT o_orderkey AS project_id, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS bid_count FROM orders",
    "item_vs_standard": _FACTS
    + """SELECT area, item, fiscal_year, unit_price, standard,
  CASE WHEN standard IS NULL THEN 'NA' WHEN unit_price > standard THEN 'FLAG' ELSE 'OK' END AS status,
  CAST(floor(1000 * CAST(unit_price AS DOUBLE) / nullif(CAST(standard AS DOUBLE), 0)) AS BIGINT) AS permille
FROM facts LEFT JOIN (SELECT p_partkey, CAST(p_retailprice AS DECIMAL(14,2)) AS standard FROM part WHERE p_partkey % 3 <> 0) ON p_partkey = item""",
    "item_price_spike": _FACTS
    + """, found AS (
  SELECT *, CASE WHEN winner = from_winner THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM changes
  WHERE from_price > 0 AND unit_price - from_price >= from_price * CAST(0.3 AS DECIMAL(4,2)))
SELECT area, item, unnest([from_year, fiscal_year]) AS member_year, from_year, fiscal_year AS to_year, pct AS growth_pct, severity FROM found""",
    "item_vendor_lock": _FACTS
    + """SELECT area, item, min(winner) AS vendor, array_to_string(list_sort(list(fiscal_year)), ',') AS fiscal_years,
  coalesce(array_to_string(list_sort(list(fiscal_year) FILTER (WHERE bid_count <= 1)), ','), '') AS single_bid_years, CAST(sum(total) AS DECIMAL(18,2)) AS cumulative_amount
FROM facts GROUP BY area, item HAVING count(*) >= 2 AND count(winner) = count(*) AND min(winner) = max(winner)""",
    "findings_lateral_distinct": """
WITH each AS (SELECT event_id, event_type, props, unnest(json_keys(props)) AS name FROM events),
named AS (SELECT event_id, event_type, name, CAST(json_extract_string(props, '$.' || name) AS INTEGER) AS detail FROM each)
SELECT event_type, name, detail, min(event_id) AS event_id FROM named GROUP BY 1, 2, 3""",
    "exactly_one_match": """
WITH c AS (SELECT c_custkey, c_nationkey AS area, CAST(floor(c_acctbal / 100) AS BIGINT) AS amount FROM customer),
s AS (SELECT s_suppkey, s_nationkey AS area, CAST(floor(s_acctbal / 100) AS BIGINT) AS amount FROM supplier),
hits AS (SELECT c_custkey, count(*) AS n, min(s_suppkey) AS hit FROM c JOIN s USING (area, amount) GROUP BY 1)
SELECT c_custkey, CASE WHEN n = 1 THEN hit END AS s_suppkey FROM c LEFT JOIN hits USING (c_custkey)""",
    "project_item_rows": """
WITH lines AS (SELECT l_orderkey, l_linenumber, l_suppkey, CAST(l_extendedprice AS DECIMAL(18,2)) AS total FROM lineitem)
SELECT n_name, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year, count(*) AS n_rows, count(DISTINCT w.l_suppkey) AS n_winners, CAST(sum(i.total) AS DECIMAL(24,2)) AS total
FROM lines i JOIN orders ON i.l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN lines w ON w.l_orderkey = o_orderkey AND w.l_linenumber = 1 GROUP BY 1, 2""",
}
