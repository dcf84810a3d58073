"""Rule checks on single projects: one finding of fixed name, status and values for each rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.functions.numbers import money, ratio
from tallyworks.sources.tables import table

# Fixed values of the rules.
CEILING = 500_000
NEAR = 475_000
TOLERANCE = "0.01"
EXPECTED = {
    "E_BIDDING": ("contract_summary", "reference_form", "tor", "winner_announcement"),
    "SELECTION": ("contract_summary", "reference_form", "tor"),
    None: ("contract_summary",),
}


def finding(name: str, status: Column, **values: Column) -> Column:
    """name, status and the rule's values as text; values that are NULL are kept as such."""
    pairs = [x for key, value in values.items() for x in (F.lit(key), value.cast("string"))]
    return F.struct(F.lit(name).alias("name"), status.alias("status"), F.create_map(*pairs).alias("values"))


def agreement(name: str, a: str, b: str, otherwise: str) -> Column:
    """Whether two amounts agree within TOLERANCE of the second; a second amount of 0 counts as agreement."""
    difference = F.abs(F.col(a) - F.col(b))
    relative = F.when(F.col(b) == 0, F.lit(0).cast("decimal(38,4)")).otherwise(ratio(difference, F.col(b)).cast("decimal(38,4)"))
    status = F.when(F.col(a).isNull() | F.col(b).isNull(), "NA").when(relative <= F.lit(TOLERANCE).cast("decimal(4,2)"), "OK").otherwise(otherwise)
    return finding(name, status, relative_delta=relative, abs_delta=difference)


def reference_price_cross_check() -> Column:
    return agreement("reference_price_cross_check", "reference_price", "form_reference_price", "FLAG")


def boq_vs_bk01_total() -> Column:
    return agreement("boq_vs_bk01_total", "boq_total", "form_reference_price", "WARN")


def within(name: str, part: str, whole: str, **values: Column) -> Column:
    """FLAG where part exceeds whole; NA where either is missing or whole is 0."""
    missing = F.col(part).isNull() | F.col(whole).isNull() | (F.col(whole) == 0)
    return finding(name, F.when(missing, "NA").when(F.col(part) > F.col(whole), "FLAG").otherwise("OK"), relative=F.when(~missing, ratio(F.col(part), F.col(whole))), **values)


def reference_within_budget() -> Column:
    return within("reference_within_budget", "reference_price", "budget")


def contract_within_reference() -> Column:
    return within("contract_within_reference", "contract_price", "reference_price", savings=ratio(F.col("reference_price") - F.col("contract_price"), F.col("reference_price")))


def bid_competition() -> Column:
    """One bid on a route with competition, or a winner above the lowest of several bids, calls for a review."""
    n, several = F.col("n_bids"), F.col("n_bids") >= 2
    competitive = F.coalesce(F.col("method").isin("E_BIDDING", "SELECTION"), F.lit(False))
    above = several & F.coalesce(F.col("winning_bid") > F.col("lowest_bid"), F.lit(False))
    status = F.when(n == 0, "NA").when((competitive & (n <= 1)) | above, "WARN").otherwise("OK")
    spread = F.when(several, ratio(F.col("highest_bid") - F.col("lowest_bid"), F.col("lowest_bid")))
    return finding("bid_competition", status, bidder_count=n, bid_spread_ratio=spread)


def procurement_threshold() -> Column:
    """A direct purchase above the ceiling is a flag, one just below a warning; an amount of 0 counts as missing."""
    amount = F.coalesce(F.nullif(F.col("reference_price"), F.lit(0).cast("decimal(18,2)")), F.col("budget"))
    direct = F.col("method") == "SPECIFIC"
    status = F.when(amount.isNull() | F.col("method").isNull(), "NA").when(direct & (amount > CEILING), "FLAG").when(direct & amount.between(NEAR, CEILING), "WARN").otherwise("OK")
    return finding("procurement_threshold", status, amount=amount)


def expected_documents() -> Column:
    """The documents that the route asks for and that are missing; either of two forms will do as reference form."""
    forms = F.array_contains("doc_types", "bk01") | F.array_contains("doc_types", "bk06")
    present = F.when(forms, F.array_append("doc_types", F.lit("reference_form"))).otherwise(F.col("doc_types"))
    wanted = F.when(F.col("method") == "E_BIDDING", F.array(*map(F.lit, EXPECTED["E_BIDDING"]))).when(F.col("method") == "SELECTION", F.array(*map(F.lit, EXPECTED["SELECTION"]))).otherwise(F.array(*map(F.lit, EXPECTED[None])))
    missing = F.transform(F.array_except(wanted, present), lambda d: F.when(d == "reference_form", "bk01/bk06").otherwise(d))
    return finding("expected_documents", F.when(F.size(missing) > 0, "WARN").otherwise("OK"), missing=F.array_join(missing, ","))


#: In the order in which findings are listed.
CHECKS = (reference_price_cross_check, boq_vs_bk01_total, reference_within_budget, contract_within_reference, bid_competition, procurement_threshold, expected_documents)


def with_findings(facts: DataFrame) -> DataFrame:
    """facts with the findings of all checks in their fixed order, and the default of the check across projects last."""
    last = finding("yoy_budget_anomaly", F.lit("OK"), severity=F.lit(None))
    return facts.withColumn("findings", F.array(*[check() for check in CHECKS], last))


def project_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as projects: lines are bids, those numbered 1 winners; amounts that stand for those of forms are sums of lines."""
    price = money("l_extendedprice")
    kinds = F.when(F.col("l_returnflag") == "A", "contract_summary").when(F.col("l_returnflag") == "N", "bk01").otherwise("tor")
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.min(price).alias("lowest_bid"), F.max(price).alias("highest_bid"), F.min(F.when(F.col("l_linenumber") == 1, price)).alias("winning_bid"), F.sum(price).cast("decimal(18,2)").alias("form_reference_price"),
        F.sum(F.when(F.col("l_returnflag") != "R", price)).cast("decimal(18,2)").alias("boq_total"), F.collect_set(kinds).alias("kinds"),
    )
    method = F.when(F.col("o_orderpriority").startswith("1"), "SPECIFIC").when(F.col("o_orderpriority").startswith("2"), "SELECTION").when(F.col("o_orderpriority").startswith("3"), "E_BIDDING")
    orders = table(spark, folder, "orders").select("o_orderkey", method.alias("method"), money("o_totalprice").alias("reference_price"), F.when(F.col("o_orderstatus") != "P", money("o_totalprice") + F.when(F.col("o_orderkey") % 2 == 0, 1000).otherwise(-1000)).cast("decimal(18,2)").alias("budget"))
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select(F.col("o_orderkey").alias("project_id"), "method", "reference_price", "budget", "form_reference_price", "boq_total", F.col("winning_bid").alias("contract_price"), "winning_bid", "lowest_bid", "highest_bid", F.coalesce("n", F.lit(0)).alias("n_bids"), F.coalesce("kinds", F.array().cast("array<string>")).alias("doc_types"))


def check_query(check):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        found = project_facts(spark, folder).select("project_id", check().alias("f"))
        values = [F.col("f.values")[key].alias(key) for key in VALUES[check.__name__]]
        return found.select("project_id", F.col("f.status").alias("status"), *values)

    return query


VALUES = {
    "reference_price_cross_check": ("relative_delta", "abs_delta"), "boq_vs_bk01_total": ("relative_delta", "abs_delta"), "reference_within_budget": ("relative",), "contract_within_reference": ("relative", "savings"),
    "bid_competition": ("bidder_count", "bid_spread_ratio"), "procurement_threshold": ("amount",), "expected_documents": ("missing",),
}


def check_tally(spark: SparkSession, folder: str) -> DataFrame:
    """How many projects have each status under each check."""
    told = [F.struct(found["name"].alias("name"), found["status"].alias("status")) for found in (check() for check in CHECKS)]
    last = F.struct(F.lit("yoy_budget_anomaly").alias("name"), F.lit("OK").alias("status"))
    rows = project_facts(spark, folder).select(F.inline(F.array(*told, last)))
    return rows.groupBy("name", "status").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f"check_{c.__name__}": check_query(c) for c in CHECKS} | {"check_tally": check_tally}

_FACTS = """
WITH lines AS (
  SELECT l_orderkey, count(*) AS n, min(CAST(l_extendedprice AS DECIMAL(18,2))) AS lowest_bid, max(CAST(l_extendedprice AS DECIMAL(18,2))) AS highest_bid,
    min(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (WHERE l_linenumber = 1) AS winning_bid, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS form_reference_price,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (WHERE l_returnflag <> 'R') AS DECIMAL(18,2)) AS boq_total,
    bool_or(l_returnflag = 'A') AS has_summary, bool_or(l_returnflag = 'N') AS has_form, bool_or(l_returnflag NOT IN ('A', 'N')) AS has_tor
  FROM lineitem GROUP BY 1),
facts AS (
  SELECT o_orderkey AS project_id, CASE left(o_orderpriority, 1) WHEN '1' THEN 'SPECIFIC' WHEN '2' THEN 'SELECTION' WHEN '3' THEN 'E_BIDDING' END AS method,
    CAST(o_totalprice AS DECIMAL(18,2)) AS reference_price, CASE WHEN o_orderstatus <> 'P' THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) + CASE WHEN o_orderkey % 2 = 0 THEN 1000 ELSE -1000 END AS DECIMAL(18,2)) END AS budget,
    form_reference_price, boq_total, winning_bid AS contract_price, winning_bid, lowest_bid, highest_bid, coalesce(n, 0) AS n_bids,
    coalesce(has_summary, false) AS has_summary, coalesce(has_form, false) AS has_form, coalesce(has_tor, false) AS has_tor
  FROM orders LEFT JOIN lines ON l_orderkey = o_orderkey)
"""


def _ratio_sql(part: str, whole: str) -> str:
    """Ten-thousandths of part / whole by whole numbers, half to even, written with four decimals."""
    n, d = f"(CAST(({part}) * 100 AS HUGEINT) * 10000)", f"CAST(({whole}) * 100 AS HUGEINT)"
    q, r = f"(abs({n}) // abs({d}))", f"(abs({n}) % abs({d}))"
    even = f"({q} + CASE WHEN 2 * {r} > abs({d}) OR (2 * {r} = abs({d}) AND {q} % 2 = 1) THEN 1 ELSE 0 END)"
    sign = f"CASE WHEN ({part} < 0) <> ({whole} < 0) AND {even} <> 0 THEN '-' ELSE '' END"
    return f"({sign} || CAST({even} // 10000 AS VARCHAR) || '.' || lpad(CAST({even} % 10000 AS VARCHAR), 4, '0'))"


def _agreement_sql(a: str, b: str, otherwise: str) -> str:
    text = f"CASE WHEN {b} = 0 THEN '0.0000' ELSE {_ratio_sql(f'abs({a} - {b})', b)} END"
    return f"""SELECT project_id, CASE WHEN {a} IS NULL OR {b} IS NULL THEN 'NA' WHEN CAST({text} AS DECIMAL(18,4)) <= 0.01 THEN 'OK' ELSE '{otherwise}' END AS status,
  {text} AS relative_delta, CAST(abs({a} - {b}) AS VARCHAR) AS abs_delta FROM facts"""


def _within_sql(part: str, whole: str) -> str:
    missing = f"({part} IS NULL OR {whole} IS NULL OR {whole} = 0)"
    return f"CASE WHEN {missing} THEN 'NA' WHEN {part} > {whole} THEN 'FLAG' ELSE 'OK' END AS status, CASE WHEN NOT {missing} THEN {_ratio_sql(part, whole)} END AS relative"


_STATUS = {
    "reference_price_cross_check": _agreement_sql("reference_price", "form_reference_price", "FLAG"),
    "boq_vs_bk01_total": _agreement_sql("boq_total", "form_reference_price", "WARN"),
    "reference_within_budget": f"SELECT project_id, {_within_sql('reference_price', 'budget')} FROM facts",
    "contract_within_reference": f"SELECT project_id, {_within_sql('contract_price', 'reference_price')}, {_ratio_sql('reference_price - contract_price', 'reference_price')} AS savings FROM facts",
    "bid_competition": f"""SELECT project_id, CASE WHEN n_bids = 0 THEN 'NA' WHEN (coalesce(method IN ('E_BIDDING', 'SELECTION'), false) AND n_bids <= 1) OR (n_bids >= 2 AND coalesce(winning_bid > lowest_bid, false)) THEN 'WARN' ELSE 'OK' END AS status,
  CAST(n_bids AS VARCHAR) AS bidder_count, CASE WHEN n_bids >= 2 THEN {_ratio_sql("highest_bid - lowest_bid", "lowest_bid")} END AS bid_spread_ratio FROM facts""",
    "procurement_threshold": """SELECT project_id, CASE WHEN amount IS NULL OR method IS NULL THEN 'NA' WHEN method = 'SPECIFIC' AND amount > 500000 THEN 'FLAG' WHEN method = 'SPECIFIC' AND amount BETWEEN 475000 AND 500000 THEN 'WARN' ELSE 'OK' END AS status, CAST(amount AS VARCHAR) AS amount
FROM (SELECT *, coalesce(nullif(reference_price, 0), budget) AS amount FROM facts)""",
    "expected_documents": """SELECT project_id, CASE WHEN missing <> '' THEN 'WARN' ELSE 'OK' END AS status, missing FROM (
  SELECT project_id, array_to_string(list_filter([
    CASE WHEN NOT has_summary THEN 'contract_summary' END, CASE WHEN method IN ('E_BIDDING', 'SELECTION') AND NOT has_form THEN 'bk01/bk06' END,
    CASE WHEN method IN ('E_BIDDING', 'SELECTION') AND NOT has_tor THEN 'tor' END, CASE WHEN method = 'E_BIDDING' THEN 'winner_announcement' END], lambda x: x IS NOT NULL), ',') AS missing FROM facts)""",
}
ORACLE = {f"check_{name}": _FACTS + sql for name, sql in _STATUS.items()}
ORACLE["check_tally"] = _FACTS + "SELECT name, status, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{name}' AS name, status FROM ({sql})" for name, sql in _STATUS.items()) + " UNION ALL SELECT 'yoy_budget_anomaly', 'OK' FROM facts) GROUP BY 1, 2"
