"""Ingestion of documents as a flow that can be stopped anywhere and started again.

Each micro-batch goes through stages: what must be read again is put into an outbox, documents
that are ready are cut into chunks, and last of all each document's status is written. Every stage
replaces what its tables hold of the batch's documents, and a document counts as done only by its
status, so a batch that comes a second time leaves what it would have left the first time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.operators.documents import chunked, page_quality
from tallyworks.operators.listings import SCOPES, routed
from tallyworks.sources import versions
from tallyworks.sources.shared import shared_folder
from tallyworks.sources.tables import table

#: The tables of a flow, each a folder with versions, laid out by document.
TABLES = {
    "outbox": "document long, page int, reasons array<string>",
    "chunks": "document long, page int, chunk_index int, text string",
    "documents": "document long, scope string, digest string, source string, unread array<int>, status string",
}


def table_of(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The newest version of a table of the flow; empty before the first one."""
    path = f"{root}/{name}"
    return versions.read(spark, path) if versions.latest(spark, path) >= 0 else spark.createDataFrame([], TABLES[name])


def put(spark: SparkSession, root: str, name: str, rows: DataFrame, documents: DataFrame) -> None:
    """rows in the place of all that a table has of these documents (document)."""
    path = f"{root}/{name}"
    if versions.latest(spark, path) < 0:
        versions.write(spark.createDataFrame([], TABLES[name]), path, "document")
    marked = documents.select("document").distinct().withColumn("_marked", F.lit(True))
    there = rows.withColumn("_there", F.lit(True))
    updates = marked.join(there, "document", "left")

    def combine(old: DataFrame, new: DataFrame) -> DataFrame:
        kept = old.join(new.select("document").distinct(), "document", "left_anti")
        return kept.unionByName(new.filter("_there").select(*old.columns).to(old.schema))

    versions.change(spark, path, updates, ["document"], combine)


def stages(pages: DataFrame, results: DataFrame, root: str) -> None:
    """One batch of whole documents (document, scope, digest, page, text); results (document, page, text) are pages that have been read again.

    Documents that were finished with the same digest are left alone. Pages with a reason to be read
    again wait in the outbox until there is a result for them; a document without such pages is cut
    into chunks, with results in the place of its pages. A NULL text is a page without a text.
    """
    spark = pages.sparkSession
    done = table_of(spark, root, "documents").filter("status = 'completed'").select("document", "digest")
    fresh = pages.join(done, ["document", "digest"], "left_anti").withColumn("reasons", F.coalesce(page_quality(F.coalesce("text", F.lit(""))), F.array().cast("array<string>")))
    fresh = fresh.persist()
    try:
        status = routed(fresh, results, done).select("document", "scope", "digest", "source", "unread", "status")
        documents = fresh.select("document").distinct()
        waiting = fresh.filter(F.size("reasons") > 0).join(results.select("document", "page").distinct(), ["document", "page"], "left_anti").select("document", F.col("page").cast("int").alias("page"), "reasons")
        put(spark, root, "outbox", waiting, documents)
        ready = fresh.join(status.filter("status = 'completed'").select("document"), "document", "left_semi")
        again = results.groupBy("document", "page").agg(F.max("text").alias("_again"), F.lit(True).alias("_read"))
        texts = ready.join(again, ["document", "page"], "left").select("document", F.col("page").cast("int").alias("page"), F.when(F.col("_read") & (F.size("reasons") > 0), F.col("_again")).otherwise(F.col("text")).alias("text"))
        put(spark, root, "chunks", chunked(texts), documents)
        put(spark, root, "documents", status, documents)
    finally:
        fresh.unpersist()


def run(pages: DataFrame, results: DataFrame, root: str) -> None:
    """All that a stream of pages has now, batch by batch; a run that was stopped goes on with the batch that it was in."""
    query = pages.writeStream.foreachBatch(lambda batch, _: stages(batch, results, root)).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
    query.awaitTermination()


def ingested(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as pages of eight to a document, streamed from their table; every third page has been read again."""
    schema = spark.read.parquet(f"{folder}/documents.parquet").schema
    docs = spark.readStream.schema(schema).parquet(f"{folder}/document[s].parquet").filter("doc_id is not null")
    document = F.floor(F.col("doc_id") / 8).cast("long")
    pages = docs.select(document.alias("document"), F.element_at(F.array(*map(F.lit, SCOPES)), (document % 3 + 1).cast("int")).alias("scope"), document.cast("string").alias("digest"), F.col("doc_id").cast("int").alias("page"), "text")
    results = table(spark, folder, "documents").filter("doc_id % 3 = 0").select(document.alias("document"), F.col("doc_id").cast("int").alias("page"), F.lit("read again").alias("text"))
    root = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    run(pages, results, root)
    waiting, cut = table_of(spark, root, "outbox").groupBy("document").agg(F.count(F.lit(1)).alias("waiting")), table_of(spark, root, "chunks").groupBy("document").agg(F.countDistinct("page").alias("cut"))
    found = table_of(spark, root, "documents").join(waiting, "document", "left").join(cut, "document", "left")
    return found.select("document", "source", F.array_join(F.col("unread").cast("array<string>"), ",").alias("unread"), "status", F.coalesce("waiting", F.lit(0)).alias("waiting"), F.coalesce("cut", F.lit(0)).alias("cut"))


QUERIES = {"ingested": ingested}
ORACLE = {
    "ingested": """
WITH quality AS (
  SELECT doc_id, s, CASE WHEN n < 40 THEN ['NO_TEXT_LAYER'] ELSE list_filter([
    CASE WHEN contains(s, chr(65533)) THEN 'REPLACEMENT_CHARS' END, CASE WHEN len(regexp_extract_all(s, '[À-ÿ]')) * 20 > n THEN 'MOJIBAKE' END,
    CASE WHEN thai + latin >= 30 AND thai * 5 < thai + latin THEN 'LOW_THAI_RATIO' END], lambda x: x IS NOT NULL) END AS reasons
  FROM (SELECT doc_id, s, length(s) AS n, len(regexp_extract_all(s, '[ก-๛]')) AS thai, len(regexp_extract_all(s, '[A-Za-zÀ-ÿ]')) AS latin FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS s FROM documents))),
pages AS (SELECT doc_id // 8 AS document, doc_id AS page, coalesce(reasons, []) AS reasons, s <> '' OR doc_id % 3 = 0 AS has_text FROM quality WHERE doc_id IS NOT NULL),
found AS (
  SELECT document, count(*) AS n, count(*) FILTER (WHERE list_contains(reasons, 'NO_TEXT_LAYER')) AS blank, count(*) FILTER (WHERE has_text) AS cut, count(*) FILTER (WHERE len(reasons) > 0 AND page % 3 <> 0) AS waiting,
    coalesce(string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) FILTER (WHERE len(reasons) > 0 AND page % 3 <> 0), '') AS unread FROM pages GROUP BY 1)
SELECT document, CASE WHEN blank >= greatest(1, n // 2) THEN 'SCANNED' ELSE 'BORN_DIGITAL' END AS source, unread, CASE WHEN waiting > 0 THEN 'needs_ocr' ELSE 'completed' END AS status, waiting, CASE WHEN waiting > 0 THEN 0 ELSE cut END AS cut FROM found"""
}
