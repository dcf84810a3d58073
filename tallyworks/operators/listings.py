"""Lists as users see them, nested payloads, and the routing of documents that come in."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyworks.functions.numbers import money
from tallyworks.functions.text import match_key
from tallyworks.operators.documents import page_quality
from tallyworks.sources.tables import table

#: In which order documents are worked on (fixed values).
SCOPES = ("PROJECT", "SUB_DISTRICT", "REFERENCE")
OTHER_DOCUMENT = "เอกสารโครงการ"


def searched(rows: DataFrame, column: str, part: str, **wanted: list) -> DataFrame:
    """Rows whose column holds a part, in that case, and whose other columns have one of the values wanted; an empty list wants all."""
    out = rows.filter(F.contains(column, F.lit(part)))
    for name, values in wanted.items():
        out = out.filter(F.col(name).isin(values)) if values else out
    return out


def project_search(spark: SparkSession, folder: str) -> DataFrame:
    return searched(table(spark, folder, "orders"), "o_orderpriority", "IGH", o_orderstatus=["F", "P"]).select("o_orderkey", "o_orderstatus")


def distinct_years(spark: SparkSession, folder: str) -> DataFrame:
    """The years that there are, each once, with its place among them."""
    years = table(spark, folder, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    return years.withColumn("place", F.row_number().over(Window.orderBy("year")))


def top_ten(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select("o_orderkey", money("o_totalprice").alias("amount")).orderBy(F.desc("amount"), "o_orderkey").limit(10)


def newest_first(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's events, the newest first; of equal times those with the larger id."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return table(spark, folder, "events").select("user_id", "event_id", place.alias("place"))


def factors_by_score(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's event types by their largest value, the largest first, with their places."""
    factors = table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.max(money("value")).alias("score"))
    return factors.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), "event_type")))


def first_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of the rows that share keys the one that is least in order."""
    return rows.groupBy(*keys).agg(F.min(order).alias(order))


def first_document_of_kind(spark: SparkSession, folder: str) -> DataFrame:
    return first_of(table(spark, folder, "documents").select("source", "lang", "doc_id"), ["source", "lang"], "doc_id")


def representative(rows: DataFrame, key: str, amount: str, year: str, order: str) -> DataFrame:
    """Of each key the row with the largest amount (a missing one counts as 0), then the latest year; of equal ones the first in order."""
    worth = F.coalesce(amount, F.lit(0).cast("decimal(18,2)"))
    return rows.groupBy(key).agg(F.max_by(order, F.struct(worth, year, -F.col(order))).alias(order))


def representative_order(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") != "P", money("o_totalprice")).alias("amount"), F.year("o_orderdate").alias("year"))
    return representative(orders, "o_custkey", "amount", "year", "o_orderkey")


def won(bids: DataFrame, winners: DataFrame, key: str) -> DataFrame:
    """bids (key, bidder, ...) with is_winner: whether the bidder is the key's winner (key, winner), whatever the white space in either name."""
    named = winners.select(key, match_key(F.col("winner")).alias("_winner"))
    return bids.join(named, key, "left").withColumn("is_winner", F.coalesce(match_key(F.col("bidder")) == F.col("_winner"), F.lit(False))).drop("_winner")


def winner_bidders(spark: SparkSession, folder: str) -> DataFrame:
    """Lines as bids of suppliers, whose names have blanks in them; the winner is the supplier of the first line."""
    names = table(spark, folder, "supplier").select("s_suppkey", "s_name")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("s_suppkey")).join(names, "s_suppkey")
    bids = lines.select("l_orderkey", "l_linenumber", F.replace("s_name", F.lit("#"), F.lit(" #  ")).alias("bidder"))
    winners = lines.filter("l_linenumber = 1").select("l_orderkey", F.col("s_name").alias("winner"))
    return won(bids, winners, "l_orderkey").select("l_orderkey", "l_linenumber", "is_winner")


def nested(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """keys and name: the other columns of each key's rows as an array of structs, by order."""
    others = [c for c in rows.columns if c not in keys and c not in order]
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *others))).alias(name))


def yearly_totals(spark: SparkSession, folder: str) -> DataFrame:
    cents = F.sum((money("o_totalprice") * 100).cast("long"))
    return table(spark, folder, "orders").groupBy("o_orderstatus", F.year("o_orderdate").alias("year")).agg(cents.alias("cents"), F.count(F.lit(1)).alias("n"))


def nested_years(spark: SparkSession, folder: str) -> DataFrame:
    """The payload of a dashboard: each status with its years inside, in JSON."""
    return nested(yearly_totals(spark, folder), ["o_orderstatus"], ["year"], "years").select("o_orderstatus", F.to_json("years").alias("years"))


def budget_by_year(spark: SparkSession, folder: str) -> DataFrame:
    """A map of years to amounts for each status, in JSON; NULL amounts stay as such."""
    pairs = F.array_sort(F.collect_list(F.struct("year", F.when(F.col("n") > 5, F.col("cents")).alias("cents"))))
    return yearly_totals(spark, folder).groupBy("o_orderstatus").agg(F.to_json(F.map_from_entries(pairs), {"ignoreNullFields": "false"}).alias("budgets"))


def justification(years: Column, growth: Column, cumulative: Column) -> Column:
    """Years, growth in whole percent (half to even) and an amount with thousands commas and two decimals, as a sentence."""
    return F.concat(F.lit("in "), F.array_join(years.cast("array<string>"), ", "), F.lit(": up to "), F.bround(growth * 100, 0).cast("int").cast("string"), F.lit("%, in all "), F.format_number(cumulative, 2))


def whole_percent(part: Column, whole: Column) -> Column:
    """A decimal's percents of another one (both of two digits), whole and half to even; exact, as the remainder decides. NULL for parts of nothing."""
    hundredfold, of = (part * 100).cast("decimal(22,2)"), F.nullif(whole.cast("decimal(22,2)"), F.lit(0).cast("decimal(22,2)"))
    rest = hundredfold % of
    floor = ((hundredfold - rest) / of).cast("decimal(22,0)")
    return floor + F.when((2 * rest > of) | ((2 * rest == of) & (floor % 2 == 1)), 1).otherwise(0)


def justifications(spark: SparkSession, folder: str) -> DataFrame:
    """For each customer the years of its orders, the growth from its smallest to its largest one, and their sum."""
    orders = table(spark, folder, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), money("o_totalprice").alias("amount"))
    own = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_set("year")).alias("years"), F.min("amount").alias("low"), F.max("amount").alias("high"), F.sum("amount").alias("total"))
    growth = (whole_percent(F.col("high") - F.col("low"), F.col("low")).cast("decimal(24,0)") * F.lit(Decimal("0.01"))).cast("decimal(26,2)")
    return own.select("o_custkey", justification(F.col("years"), growth, F.col("total").cast("decimal(24,2)")).alias("text"))


def source_label(kind: Column, act: Column, section: Column, title: Column, filename: Column, page: Column) -> Column:
    """How a source is named to a reader: a section of an act, or a file with its page if it has one."""
    regulation = F.trim(F.concat(act, F.lit(" มาตรา/ข้อ "), section, F.lit(" "), F.coalesce(title, F.lit(""))))
    return F.when(kind == "regulation", regulation).otherwise(F.concat(F.coalesce(filename, F.lit(OTHER_DOCUMENT)), F.when(F.coalesce(page, F.lit(0)) > 0, F.concat(F.lit(" หน้า "), page.cast("string"))).otherwise("")))


def source_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as sources: those with an even id are sections of acts, which are named after languages."""
    docs = table(spark, folder, "documents")
    kind = F.when(F.col("doc_id") % 2 == 0, "regulation").otherwise("document")
    title = F.when(F.col("doc_id") % 4 == 0, F.col("source"))
    return docs.select("doc_id", source_label(kind, F.coalesce("lang", F.lit("?")), F.col("doc_id").cast("string"), title, F.col("source"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 10)).alias("label"))


def routed(pages: DataFrame, read: DataFrame, known: DataFrame) -> DataFrame:
    """What becomes of each document: document, scope, digest, source, unread (pages that must be read again), status, and rank: work goes by rank and document.

    pages: document, scope, digest, page, reasons. read: document, page of results that are there
    already. known: document, digest of documents that were finished. A document that hasn't
    changed is skipped; one whose pages with reasons have all been read is finished; others wait. A
    document is scanned if half of its pages, and one at least, have no text.
    """
    # One row for each page: whether it is to be read and hasn't been is what "needed is a subset of what is there" asks.
    results = read.select("document", "page").distinct().withColumn("is_read", F.lit(True))
    own = pages.join(results, ["document", "page"], "left")
    waits = (F.size("reasons") > 0) & F.col("is_read").isNull()
    documents = own.groupBy("document", "scope", "digest").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.array_contains("reasons", "NO_TEXT_LAYER")).alias("blank"), F.array_sort(F.collect_list(F.when(waits, F.col("page")))).alias("unread"),
    )
    same = known.select("document", "digest").distinct().withColumn("same", F.lit(True))
    scanned = F.col("blank") >= F.greatest(F.lit(1), F.floor(F.col("n") / 2))
    status = F.when(F.col("same"), "skipped").when(F.size("unread") > 0, "needs_ocr").otherwise("completed")
    rank = F.array_position(F.array(*map(F.lit, SCOPES)), F.col("scope"))
    found = documents.join(same, ["document", "digest"], "left")
    return found.select("document", "scope", "digest", F.when(scanned, "SCANNED").otherwise("BORN_DIGITAL").alias("source"), "unread", status.alias("status"), rank.alias("rank"))


def document_routing(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as pages of eight to a document; every third has been read, and every ninth document is known."""
    docs = table(spark, folder, "documents").filter("doc_id is not null")
    document = F.floor(F.col("doc_id") / 8).cast("long")
    pages = docs.select(document.alias("document"), F.element_at(F.array(*map(F.lit, SCOPES)), (document % 3 + 1).cast("int")).alias("scope"), document.cast("string").alias("digest"), F.col("doc_id").alias("page"), F.coalesce(page_quality(F.col("text")), F.array().cast("array<string>")).alias("reasons"))
    found = routed(pages, pages.filter("page % 3 = 0"), pages.filter("document % 9 = 0"))
    return found.select("document", "scope", "source", F.array_join(F.col("unread").cast("array<string>"), ",").alias("unread"), "status", "rank")


def keyed_update(known: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """A small keyed manifest (key, entry) with the entries of changes put in; an entry that is NULL takes its key out."""
    both = known.join(changes.select(key, F.col("entry").alias("_new"), F.lit(True).alias("_there")), key, "full")
    return both.select(key, F.when(F.col("_there"), F.col("_new")).otherwise(F.col("entry")).alias("entry")).filter("entry is not null")


def manifest_update(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as entries, of which every fifth changes, every seventh goes, and some are new."""
    own = table(spark, folder, "supplier")
    known = own.select(F.col("s_suppkey").alias("id"), F.to_json(F.struct(F.col("s_name").alias("name"))).alias("entry"))
    changes = own.filter("s_suppkey % 5 = 0 or s_suppkey % 7 = 0").select(F.when(F.col("s_suppkey") % 35 == 0, F.col("s_suppkey") + 1_000_000).otherwise(F.col("s_suppkey")).alias("id"), F.when((F.col("s_suppkey") % 7 != 0) | (F.col("s_suppkey") % 35 == 0), F.to_json(F.struct(F.lit("changed").alias("name")))).alias("entry"))
    return keyed_update(known, changes, "id")


QUERIES = {
    f.__name__: f
    for f in (project_search, distinct_years, top_ten, newest_first, factors_by_score, first_document_of_kind, representative_order, winner_bidders, nested_years, budget_by_year, justifications, source_labels, document_routing, manifest_update)
}
_TOTALS = "WITH totals AS (SELECT o_orderstatus, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(sum(CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT)) AS BIGINT) AS cents, count(*) AS n FROM orders GROUP BY 1, 2)\n"
ORACLE = {
    "project_search": "SELECT o_orderkey, o_orderstatus FROM orders WHERE contains(o_orderpriority, 'IGH') AND o_orderstatus IN ('F', 'P')",
    "distinct_years": "SELECT year, CAST(row_number() OVER (ORDER BY year) AS INTEGER) AS place FROM (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year FROM orders)",
    "top_ten": "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders ORDER BY amount DESC, o_orderkey LIMIT 10",
    "newest_first": "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS place FROM events",
    "factors_by_score": "SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_type) AS INTEGER) AS place FROM (SELECT user_id, event_type, max(CAST(value AS DECIMAL(18,2))) AS score FROM events GROUP BY 1, 2)",
    "first_document_of_kind": "SELECT source, lang, min(doc_id) AS doc_id FROM documents GROUP BY 1, 2",
    "representative_order": """SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus <> 'P' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END DESC, year(o_orderdate) DESC, o_orderkey) = 1""",
    "winner_bidders": """
WITH lines AS (SELECT l_orderkey, l_linenumber, s_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
winners AS (SELECT l_orderkey, s_name AS winner FROM lines WHERE l_linenumber = 1)
SELECT l_orderkey, l_linenumber, coalesce(s_name = winner, false) AS is_winner FROM lines LEFT JOIN winners USING (l_orderkey)""",
    "nested_years": _TOTALS + """SELECT o_orderstatus, '[' || string_agg('{"year":' || year || ',"cents":' || cents || ',"n":' || n || '}', ',' ORDER BY year) || ']' AS years FROM totals GROUP BY 1""",
    "budget_by_year": _TOTALS + """SELECT o_orderstatus, '{' || string_agg('"' || year || '":' || CASE WHEN n > 5 THEN CAST(cents AS VARCHAR) ELSE 'null' END, ',' ORDER BY year) || '}' AS budgets FROM totals GROUP BY 1""",
    "justifications": """
WITH own AS (SELECT o_custkey, list_sort(list(DISTINCT year(o_orderdate))) AS years, CAST(min(CAST(o_totalprice AS DECIMAL(18,2))) * 100 AS HUGEINT) AS low, CAST(max(CAST(o_totalprice AS DECIMAL(18,2))) * 100 AS HUGEINT) AS high, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM orders GROUP BY 1),
parts AS (SELECT *, (high - low) * 100 // low AS q, (high - low) * 100 % low AS r FROM own)
SELECT o_custkey, 'in ' || array_to_string(years, ', ') || ': up to ' || (q + CASE WHEN 2 * r > low OR (2 * r = low AND q % 2 = 1) THEN 1 ELSE 0 END) || '%, in all ' || format('{:,}', CAST(floor(total) AS BIGINT)) || '.' || lpad(CAST(CAST((total - floor(total)) * 100 AS INTEGER) AS VARCHAR), 2, '0') AS text FROM parts""",
    "source_labels": """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN trim(coalesce(lang, '?') || ' มาตรา/ข้อ ' || doc_id || ' ' || CASE WHEN doc_id % 4 = 0 THEN coalesce(source, '') ELSE '' END)
  ELSE coalesce(source, 'เอกสารโครงการ') || CASE WHEN doc_id % 3 = 0 AND doc_id % 10 > 0 THEN ' หน้า ' || doc_id % 10 ELSE '' END END AS label FROM documents""",
    "document_routing": """
WITH quality AS (
  SELECT doc_id, CASE WHEN n < 40 THEN ['NO_TEXT_LAYER'] ELSE list_filter([
    CASE WHEN contains(s, chr(65533)) THEN 'REPLACEMENT_CHARS' END, CASE WHEN len(regexp_extract_all(s, '[À-ÿ]')) * 20 > n THEN 'MOJIBAKE' END,
    CASE WHEN thai + latin >= 30 AND thai * 5 < thai + latin THEN 'LOW_THAI_RATIO' END], lambda x: x IS NOT NULL) END AS reasons
  FROM (SELECT doc_id, s, length(s) AS n, len(regexp_extract_all(s, '[ก-๛]')) AS thai, len(regexp_extract_all(s, '[A-Za-zÀ-ÿ]')) AS latin FROM (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS s FROM documents))),
pages AS (SELECT doc_id // 8 AS document, doc_id AS page, coalesce(reasons, []) AS reasons FROM quality WHERE doc_id IS NOT NULL),
found AS (
  SELECT document, count(*) AS n, count(*) FILTER (WHERE list_contains(reasons, 'NO_TEXT_LAYER')) AS blank, coalesce(string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) FILTER (WHERE len(reasons) > 0 AND page % 3 <> 0), '') AS unread FROM pages GROUP BY 1)
SELECT document, ['PROJECT', 'SUB_DISTRICT', 'REFERENCE'][document % 3 + 1] AS scope, CASE WHEN blank >= greatest(1, n // 2) THEN 'SCANNED' ELSE 'BORN_DIGITAL' END AS source, unread,
  CASE WHEN document % 9 = 0 THEN 'skipped' WHEN unread <> '' THEN 'needs_ocr' ELSE 'completed' END AS status, document % 3 + 1 AS rank FROM found""",
    "manifest_update": """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 AND s_suppkey % 35 <> 0 THEN '{"name":"changed"}' ELSE '{"name":"' || s_name || '"}' END AS entry FROM supplier WHERE s_suppkey % 7 <> 0 OR s_suppkey % 35 = 0
UNION ALL SELECT s_suppkey + 1000000, '{"name":"changed"}' FROM supplier WHERE s_suppkey % 35 = 0""",
}
