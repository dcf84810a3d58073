"""Recurring works: projects of one area and kind at the same place, and their budgets over the years."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyworks.functions.numbers import money, ratio
from tallyworks.functions.text import moo_numbers, village_names, work_type
from tallyworks.operators.graph import components
from tallyworks.sources.tables import table

#: A budget that grows by this part of itself, and the part of the years that one contractor won.
GROWTH, SHARE = 1, 0.5


def placed(projects: DataFrame, name: str = "name") -> DataFrame:
    """projects with the kind of work and the places that their names tell."""
    return projects.withColumns({"work": work_type(F.col(name)), "villages": village_names(F.col(name)), "moos": moo_numbers(F.col(name))})


def recurring_links(projects: DataFrame) -> DataFrame:
    """Links (a, b) that connect the projects of one area and work at the same place.

    If both projects tell villages these must meet, otherwise their numbers must. Projects that
    share a village are linked to the first of them. For a number the centre is the first project
    that tells no village, as it goes with all others; without such a project the number links
    nothing. So there are as many links as projects and places, not as pairs.
    """
    known = projects.filter("work is not null").select("id", "area", "work", "villages", "moos")
    village = known.select("id", "area", "work", F.explode("villages").alias("place"))
    centre = village.groupBy("area", "work", "place").agg(F.min("id").alias("centre"))
    stars = village.join(centre, ["area", "work", "place"]).select(F.col("centre").alias("a"), F.col("id").alias("b"))
    moo = known.select("id", "area", "work", (F.size("villages") == 0).alias("bare"), F.explode("moos").alias("place"))
    bare = moo.filter("bare").groupBy("area", "work", "place").agg(F.min("id").alias("centre"))
    return stars.unionByName(moo.join(bare, ["area", "work", "place"]).select(F.col("centre").alias("a"), F.col("id").alias("b")))


def clusters(projects: DataFrame) -> DataFrame:
    """projects with the least id of their cluster; a project without links is one of its own."""
    found = components(recurring_links(projects)).withColumnRenamed("node", "id")
    return projects.join(found, "id", "left").withColumn("cluster", F.coalesce("component", "id")).drop("component")


def anomalies(clustered: DataFrame) -> DataFrame:
    """Clusters of two years or more whose budget at least doubled from one recorded year to the next.

    Of equal growths the first counts. A contractor that won in the most years (the first by name
    of several), in two at least and in half of all, makes the finding HIGH.
    """
    yearly = clustered.groupBy("cluster", "year").agg(F.sum("budget").cast("decimal(18,2)").alias("budget"))
    order = Window.partitionBy("cluster").orderBy("year")
    steps = yearly.withColumns({"before": F.lag("budget").over(order), "from_year": F.lag("year").over(order), "n_years": F.count(F.lit(1)).over(Window.partitionBy("cluster"))})
    growth = ratio(F.col("budget") - F.col("before"), F.col("before"))
    grown = steps.filter("before > 0 and budget <> 0").withColumn("growth", growth).filter(F.col("growth") >= GROWTH)
    first = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("growth"), "year"))
    spikes = grown.withColumn("place", first).filter("place = 1").select("cluster", "n_years", "growth", "from_year", F.col("year").alias("to_year"))
    wins = clustered.filter("winner is not null").groupBy("cluster", "winner").agg(F.countDistinct("year").alias("won_years"), F.coalesce(F.sum("budget"), F.lit(0)).cast("decimal(18,2)").alias("cumulative"))
    most = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("won_years"), "winner"))
    top = wins.withColumn("place", most).filter("place = 1").drop("place")
    joined = spikes.join(top, "cluster", "left")
    repeat = F.coalesce((F.col("won_years") >= 2) & (F.col("won_years") >= F.col("n_years") * SHARE), F.lit(False))
    return joined.select("cluster", "n_years", F.col("growth").cast("decimal(18,4)").alias("growth"), "from_year", "to_year", F.when(repeat, "HIGH").otherwise("MEDIUM").alias("severity"), F.when(repeat, F.col("winner")).alias("repeat_contractor"), F.when(repeat, F.col("cumulative")).alias("cumulative_budget"))


def yoy_findings(projects: DataFrame) -> DataFrame:
    """The finding of its cluster for each project: FLAG with the cluster's values, or OK."""
    clustered = clusters(projects)
    found = clustered.select("id", "cluster").join(anomalies(clustered), "cluster", "left")
    return found.withColumn("status", F.when(F.col("growth").isNull(), "OK").otherwise("FLAG"))


def part_projects(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as projects: the brand is the area, the type the work, the first word of every second name its village."""
    key = F.col("p_partkey")
    words = F.split("p_name", " ")
    return table(spark, folder, "part").select(
        key.alias("id"), F.col("p_brand").alias("area"), F.col("p_type").alias("work"), F.when(key % 3 != 0, F.array(words[0])).otherwise(F.array().cast("array<string>")).alias("villages"), F.array((F.col("p_size") % 40).cast("string")).alias("moos"),
        (2565 + key % 3).cast("int").alias("year"), (money("p_retailprice") * (1 + key % 7)).cast("decimal(18,2)").alias("budget"), F.concat(F.lit("V"), (key % 4).cast("string")).alias("winner"),
    )


def recurring_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return clusters(part_projects(spark, folder)).select("id", "cluster")


def yoy_anomaly(spark: SparkSession, folder: str) -> DataFrame:
    return yoy_findings(part_projects(spark, folder))


QUERIES = {"recurring_clusters": recurring_clusters, "yoy_anomaly": yoy_anomaly}

_CLUSTERS = """
WITH RECURSIVE projects AS (
  SELECT p_partkey AS id, p_brand AS area, p_type AS work, CASE WHEN p_partkey % 3 <> 0 THEN split_part(p_name, ' ', 1) END AS village, p_size % 40 AS moo,
    CAST(2565 + p_partkey % 3 AS INTEGER) AS year, CAST(CAST(p_retailprice AS DECIMAL(18,2)) * (1 + p_partkey % 7) AS DECIMAL(18,2)) AS budget, 'V' || CAST(p_partkey % 4 AS VARCHAR) AS winner FROM part),
links AS (
  SELECT a.id AS a, b.id AS b FROM projects a JOIN projects b ON a.area = b.area AND a.work = b.work AND a.id <> b.id
    AND (CASE WHEN a.village IS NOT NULL AND b.village IS NOT NULL THEN a.village = b.village ELSE a.moo = b.moo END)),
reach AS (SELECT id, id AS other FROM projects UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.other),
clustered AS (SELECT projects.*, cluster FROM projects JOIN (SELECT id, min(other) AS cluster FROM reach GROUP BY 1) USING (id))
"""
ORACLE = {
    "recurring_clusters": _CLUSTERS + "SELECT id, cluster FROM clustered",
    "yoy_anomaly": _CLUSTERS
    + """, yearly AS (SELECT cluster, year, CAST(sum(budget) AS DECIMAL(18,2)) AS budget FROM clustered GROUP BY 1, 2),
steps AS (SELECT *, lag(budget) OVER w AS before, lag(year) OVER w AS from_year, count(*) OVER (PARTITION BY cluster) AS n_years FROM yearly WINDOW w AS (PARTITION BY cluster ORDER BY year)),
grown AS (
  SELECT *, n * 10000 // d AS q, n * 10000 % d AS r FROM (SELECT *, CAST((budget - before) * 100 AS HUGEINT) AS n, CAST(before * 100 AS HUGEINT) AS d FROM steps WHERE before > 0 AND budget <> 0)),
spikes AS (
  SELECT cluster, n_years, CAST(CAST(g AS VARCHAR) AS DECIMAL(18,4)) * 0.0001::DECIMAL(5,4) AS growth, from_year, year AS to_year FROM (
    SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY g DESC, year) AS place FROM (SELECT *, q + CASE WHEN 2 * r > d OR (2 * r = d AND q % 2 = 1) THEN 1 ELSE 0 END AS g FROM grown) WHERE g >= 10000) WHERE place = 1),
top AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY won_years DESC, winner) AS place FROM (
    SELECT cluster, winner, count(DISTINCT year) AS won_years, CAST(sum(budget) AS DECIMAL(18,2)) AS cumulative FROM clustered GROUP BY 1, 2)) WHERE place = 1),
found AS (SELECT spikes.*, winner, cumulative, won_years >= 2 AND won_years >= n_years * 0.5 AS again FROM spikes LEFT JOIN top USING (cluster))
SELECT id, clustered.cluster, n_years, CAST(growth AS DECIMAL(18,4)) AS growth, from_year, to_year, CASE WHEN growth IS NOT NULL THEN CASE WHEN again THEN 'HIGH' ELSE 'MEDIUM' END END AS severity,
  CASE WHEN again THEN found.winner END AS repeat_contractor, CASE WHEN again THEN cumulative END AS cumulative_budget, CASE WHEN growth IS NULL THEN 'OK' ELSE 'FLAG' END AS status
FROM clustered LEFT JOIN found USING (cluster)""",
}
