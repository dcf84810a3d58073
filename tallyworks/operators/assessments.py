"""Assessments as a whole: summaries, findings in their place, references that were offered, attempts, and rules as violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyworks.functions.numbers import money
from tallyworks.functions.text import banned_terms
from tallyworks.operators import checks, risk
from tallyworks.sources.tables import table

# Fixed values of the domain: levels as they are shown, and the sentences of a summary.
LEVELS = {"LOW": "ต่ำ", "MEDIUM": "ปานกลาง", "HIGH": "สูง", "REQUIRES_INVESTIGATION": "ควรตรวจสอบเพิ่มเติม"}
AND = " และ "
SUMMARY = (
    "การประเมินความเสี่ยงรวมได้ ", " คะแนน จัดอยู่ในระดับ", " ปัจจัยที่ควรให้ความสำคัญในการตรวจสอบ ได้แก่ ",
    " ผลนี้เป็นการชี้จุดที่ควรตรวจสอบเพิ่มเติมเท่านั้น การวินิจฉัยขั้นสุดท้ายเป็นของผู้ตรวจสอบ",
)
ATTEMPTS = 5
REGULATION = r"`([a-z0-9-]+/[a-z0-9.]+)`"


def summary(score: Column, level: Column, top: Column) -> Column:
    """The sentence that goes with an assessment: its score as a whole number (half to even), its level and its highest factors."""
    shown = reduce(lambda out, item: out.when(level == item[0], item[1]), LEVELS.items(), F.when(F.lit(False), ""))
    return F.concat(F.lit(SUMMARY[0]), F.bround(score, 0).cast("int").cast("string"), F.lit(SUMMARY[1]), shown, F.lit(SUMMARY[2]), F.array_join(top, AND), F.lit(SUMMARY[3]))


def each_once(factors: DataFrame, key: str, place: Column, regulations: str) -> DataFrame:
    """key and regulations: what all factors of a key refer to, each once, as first met in the order of the factors."""
    ordered = F.array_sort(F.collect_list(F.struct(place.alias("place"), F.col(regulations).alias("own"))))
    return factors.groupBy(key).agg(F.array_distinct(F.flatten(F.transform(ordered, lambda f: f["own"]))).alias(regulations))


def risk_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Users' assessments with their summary, and the regulations of all their factors; numbers made of ids stand for those."""
    factors = risk.event_factors(spark, folder)
    place = F.array_position(F.array(*map(F.lit, risk.FACTORS)), F.col("factor"))
    cited = factors.withColumn("regulations", F.array(F.concat(F.lit("act/s."), F.col("user_id") % 7), F.concat(F.lit("act/s."), (F.col("user_id") + place) % 3)))
    scored = risk.event_assessments(factors)
    regulations = each_once(cited, "user_id", place, "regulations").select("user_id", F.array_join("regulations", ",").alias("regulations"))
    text = summary(F.col("overall_score"), F.col("risk_level"), F.split("top_factors", ","))
    return scored.select("user_id", text.alias("summary")).join(regulations, "user_id")


def in_place(facts: DataFrame, yearly: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """key and findings: each project's checks in their fixed order, then that of years (OK where yearly has none), then items' findings by item and name.

    yearly: key, status, severity, one row for each project at most. items: key, item, name, status.
    """
    default = checks.finding("yoy_budget_anomaly", F.coalesce("yearly_status", F.lit("OK")), severity=F.col("yearly_severity"))
    years = yearly.select(key, F.col("status").alias("yearly_status"), F.col("severity").alias("yearly_severity"))
    ordered = F.array_sort(F.collect_list(F.struct("item", "name", "status")))
    more = items.groupBy(key).agg(F.transform(ordered, lambda f: F.struct(f["name"].alias("name"), f["status"].alias("status"), F.create_map(F.lit("item"), f["item"].cast("string")).alias("values"))).alias("more"))
    own = facts.join(years, key, "left").join(more, key, "left")
    fixed = F.array(*[check() for check in checks.CHECKS], default)
    return own.select(key, F.when(F.col("more").isNull(), fixed).otherwise(F.concat(fixed, "more")).alias("findings"))


def findings_in_place(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as projects: every tenth has a finding of years, lines of 49 pieces or more one of items."""
    facts = checks.project_facts(spark, folder)
    yearly = table(spark, folder, "orders").filter("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("project_id"), F.lit("FLAG").alias("status"), F.when(F.col("o_orderkey") % 20 == 0, "HIGH").otherwise("MEDIUM").alias("severity"))
    lines = table(spark, folder, "lineitem").filter("l_quantity >= 49").select(F.col("l_orderkey").alias("project_id"), F.col("l_linenumber").alias("item"), F.when(F.col("l_returnflag") == "R", "item_vendor_lock").otherwise("item_price_spike").alias("name"), F.lit("WARN").alias("status"))
    found = in_place(facts, yearly, lines, "project_id")
    return found.select("project_id", F.posexplode("findings").alias("place", "f")).select("project_id", "place", F.col("f.name").alias("name"), F.when(F.col("place") >= len(checks.CHECKS), F.col("f.status")).alias("status"), F.coalesce(F.col("f.values")["severity"], F.col("f.values")["item"]).alias("told"))


def offered_only(found: DataFrame, column: str, offered: str) -> DataFrame:
    """found with only those references of a column that its evidence offered; the rest of a row stays."""
    return found.withColumn(column, F.filter(column, lambda ref: F.array_contains(offered, ref)))


def offered_references(spark: SparkSession, folder: str) -> DataFrame:
    """Turns that refer to three of a conversation's turns, of which the even ones were offered."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda i: F.col("turn") + i).alias("refs"), F.array(F.lit(0), F.lit(2), F.lit(4)).cast("array<bigint>").alias("offered"))
    return offered_only(turns, "refs", "offered").select("conv_id", "turn", F.array_join(F.col("refs").cast("array<string>"), ",").alias("refs"))


def first_valid(attempts: DataFrame, keys: list[str], number: str, valid: Column, most: int = ATTEMPTS) -> DataFrame:
    """Of each key's first attempts the first that is valid; a key without one is dropped, so that others' weights are shared anew."""
    good = attempts.filter((F.col(number) <= most) & F.coalesce(valid, F.lit(False)))
    others = [c for c in attempts.columns if c not in keys]
    return good.groupBy(*keys).agg(F.min_by(F.struct(*others), number).alias("own")).select(*keys, "own.*")


def factor_attempts(spark: SparkSession, folder: str) -> DataFrame:
    """Events of a user and type as attempts at a score, of which those from 5 to 20 are valid."""
    number = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    attempts = table(spark, folder, "events").select("user_id", "event_type", "event_id", money("value").alias("score"), number.alias("attempt"))
    return first_valid(attempts, ["user_id", "event_type"], "attempt", F.col("score").between(5, 20))


def contract_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Lines as factors of orders: closed sets, ranges, least lengths, references, keys that are there once, and weights that sum to 1."""
    lines = table(spark, folder, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_orderkey", "l_suppkey", "l_returnflag", money("l_quantity").alias("quantity"), money("l_discount").alias("discount"))
    parts = table(spark, folder, "supplier").filter("s_suppkey % 9 <> 0").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(True).alias("known"))
    weights = lines.groupBy("l_orderkey").agg(F.sum("quantity").alias("total"), F.count(F.lit(1)).alias("n"))
    rows = lines.join(parts, "l_suppkey", "left").join(weights, "l_orderkey")
    rules = {"level": F.col("l_returnflag").isin("A", "N"), "score_range": F.col("quantity").between(0, 45), "least_length": F.char_length(F.rtrim("l_returnflag")) >= 1, "reference": F.col("known"), "weights": F.abs(F.try_divide(F.col("total"), F.col("n")) - 25) <= 20}
    broken = risk.broken_rules(rows, "id", rules)
    twice = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_suppkey").alias("d")).filter("n > d").select("id", F.lit("unique").alias("rule"))
    return broken.unionByName(twice)


def lexicon_locations(spark: SparkSession, folder: str) -> DataFrame:
    """Where conversations hold a term of the lexicon: turns as steps of an assessment."""
    turns = table(spark, folder, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    each = turns.select("conv_id", F.posexplode("turns").alias("at", "own"))
    terms = each.select("conv_id", "at", F.explode(banned_terms(F.col("own.text"), (), ("the", "of"))).alias("term"))
    return terms.select("conv_id", F.format_string("factors[%d].text", "at").alias("location"), "term")


def template_regulations(templates: DataFrame) -> DataFrame:
    """code: what the templates (text) refer to between backticks, each once."""
    return templates.select(F.explode(F.regexp_extract_all("text", F.lit(REGULATION), F.lit(1))).alias("code")).distinct()


def evidence(facts: DataFrame, excerpts: DataFrame, regulations: DataFrame, key: str) -> DataFrame:
    """key and three blocks of text: the facts' lines, the excerpts in order, and the regulations (the same for all).

    facts: key, lines (an array). excerpts: key, place, id, text. regulations: code, text.
    """
    told = F.transform(F.array_sort(F.collect_list(F.struct("place", "id", "text"))), lambda e: F.concat(F.lit("[chunk_id: "), e["id"].cast("string"), F.lit("]\n"), F.trim(e["text"])))
    texts = excerpts.groupBy(key).agg(F.array_join(told, "\n\n").alias("document_excerpts"))
    acts = F.transform(F.array_sort(F.collect_list(F.struct("code", "text"))), lambda r: F.concat(F.lit("[regulation_id: "), r["code"], F.lit("]\n"), F.substring(F.trim(r["text"]), 1, 60)))
    context = regulations.agg(F.array_join(acts, "\n\n").alias("regulation_context"))
    lines = facts.select(key, F.array_join("lines", "\n").alias("budget_lines"))
    return lines.join(texts, key, "left").join(F.broadcast(context)).withColumn("document_excerpts", F.coalesce("document_excerpts", F.lit("(ไม่มีข้อความเอกสารที่สกัดได้)")))


def evidence_whole(spark: SparkSession, folder: str) -> DataFrame:
    """Sources as projects: sizes by language are the facts, their first documents the excerpts, and items of the benchmark the regulations that a template names."""
    docs = table(spark, folder, "documents").filter("source is not null")
    facts = docs.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n")).groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("lang", "n"))), lambda f: F.concat(F.lit("- "), F.coalesce(f["lang"], F.lit("—")), F.lit(": "), f["n"].cast("string"))).alias("lines"))
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    first = docs.select("source", place.alias("place"), F.col("doc_id").alias("id"), F.substring("text", 1, 40).alias("text")).filter("place <= 3")
    named = template_regulations(spark.createDataFrame([("see `item/s.1` and `item/s.3`",), ("or `item/s.3` but not item/s.2",)], "text string"))
    acts = table(spark, folder, "benchmark").select(F.concat(F.lit("item/s."), "item_id").alias("code"), "text").join(F.broadcast(named), "code")
    return evidence(facts, first, acts, "source")


QUERIES = {f.__name__: f for f in (risk_summary, findings_in_place, offered_references, factor_attempts, contract_rules, lexicon_locations, evidence_whole)}


def _level_sql() -> str:
    return "CASE risk_level " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LEVELS.items()) + " END"


ORACLE = {
    "risk_summary": f"""
WITH scored AS ({risk.ORACLE["risk_aggregate"]}),
factors AS (SELECT DISTINCT user_id, event_type, list_position(['signup', 'purchase', 'error', 'view', 'click'], event_type) AS place FROM events),
refs AS (SELECT user_id, place * 2 + i AS pos, 'act/s.' || CASE i WHEN 0 THEN user_id % 7 ELSE (user_id + place) % 3 END AS ref FROM factors, (VALUES (0), (1)) t(i)),
firsts AS (SELECT user_id, ref, min(pos) AS pos FROM refs GROUP BY 1, 2),
regulations AS (SELECT user_id, string_agg(ref, ',' ORDER BY pos) AS regulations FROM firsts GROUP BY 1)
SELECT user_id, '{SUMMARY[0]}' || CAST(round_even(CAST(overall_score AS DOUBLE), 0) AS INTEGER) || '{SUMMARY[1]}' || {_level_sql()} || '{SUMMARY[2]}' || replace(top_factors, ',', '{AND}') || '{SUMMARY[3]}' AS summary, regulations
FROM scored JOIN regulations USING (user_id)""",
    "findings_in_place": """
WITH names AS (SELECT unnest(['reference_price_cross_check', 'boq_vs_bk01_total', 'reference_within_budget', 'contract_within_reference', 'bid_competition', 'procurement_threshold', 'expected_documents']) AS name, unnest(range(7)) AS place),
items AS (SELECT l_orderkey AS project_id, CAST(7 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag = 'R') AS INTEGER) AS place, CASE l_returnflag WHEN 'R' THEN 'item_vendor_lock' ELSE 'item_price_spike' END AS name, l_linenumber FROM lineitem WHERE l_quantity >= 49)
SELECT o_orderkey AS project_id, CAST(place AS INTEGER) AS place, name, NULL::VARCHAR AS status, NULL::VARCHAR AS told FROM orders, names
UNION ALL SELECT o_orderkey, 7, 'yoy_budget_anomaly', CASE WHEN o_orderkey % 10 = 0 THEN 'FLAG' ELSE 'OK' END, CASE WHEN o_orderkey % 20 = 0 THEN 'HIGH' WHEN o_orderkey % 10 = 0 THEN 'MEDIUM' END FROM orders
UNION ALL SELECT project_id, place, name, 'WARN', CAST(l_linenumber AS VARCHAR) FROM items WHERE project_id IN (SELECT o_orderkey FROM orders)""",
    "offered_references": "SELECT conv_id, turn, array_to_string(list_filter([turn, turn + 1, turn + 2], lambda x: x IN (0, 2, 4)), ',') AS refs FROM conversations",
    "factor_attempts": """
WITH attempts AS (SELECT user_id, event_type, event_id, CAST(value AS DECIMAL(18,2)) AS score, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS INTEGER) AS attempt FROM events)
SELECT * FROM attempts WHERE attempt <= 5 AND score BETWEEN 5 AND 20 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY attempt) = 1""",
    "contract_rules": """
WITH lines AS (SELECT l_orderkey * 10 + l_linenumber AS id, *, CAST(l_quantity AS DECIMAL(18,2)) AS quantity FROM lineitem),
weights AS (SELECT l_orderkey, sum(quantity) AS total, count(*) AS n FROM lines GROUP BY 1)
SELECT id, 'level' AS rule FROM lines WHERE l_returnflag NOT IN ('A', 'N')
UNION ALL SELECT id, 'score_range' FROM lines WHERE quantity NOT BETWEEN 0 AND 45
UNION ALL SELECT id, 'reference' FROM lines WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 9 <> 0)
UNION ALL SELECT id, 'weights' FROM lines JOIN weights USING (l_orderkey) WHERE abs(total - 25 * n) > 20 * n
UNION ALL SELECT l_orderkey, 'unique' FROM lines GROUP BY 1 HAVING count(*) > count(DISTINCT l_suppkey)""",
    "lexicon_locations": """
WITH placed AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS place FROM conversations)
SELECT conv_id, 'factors[' || place || '].text' AS location, term FROM placed, (VALUES ('the'), ('of')) t(term) WHERE contains(lower(text), term)""",
    "evidence_whole": """
WITH docs AS (SELECT * FROM documents WHERE source IS NOT NULL),
facts AS (SELECT source, string_agg('- ' || coalesce(lang, '—') || ': ' || n, chr(10) ORDER BY lang NULLS FIRST) AS budget_lines FROM (SELECT source, lang, count(*) AS n FROM docs GROUP BY 1, 2) GROUP BY 1),
placed AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM docs),
texts AS (SELECT source, string_agg('[chunk_id: ' || doc_id || ']' || chr(10) || trim(coalesce(left(text, 40), ''), ' '), chr(10) || chr(10) ORDER BY place) AS document_excerpts FROM placed WHERE place <= 3 AND text IS NOT NULL GROUP BY 1),
acts AS (SELECT string_agg('[regulation_id: item/s.' || item_id || ']' || chr(10) || left(trim(text, ' '), 60), chr(10) || chr(10) ORDER BY 'item/s.' || item_id) AS regulation_context FROM benchmark WHERE item_id IN (1, 3))
SELECT facts.source, budget_lines, coalesce(document_excerpts, '(ไม่มีข้อความเอกสารที่สกัดได้)') AS document_excerpts, regulation_context FROM facts LEFT JOIN texts USING (source), acts""",
}
