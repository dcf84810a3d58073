"""Retrieval: vector top-k, candidate lists, reranked labels, excerpts under a budget, citations."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyworks.functions.numbers import cosine
from tallyworks.functions.text import banned_terms, cited_labels
from tallyworks.sources.tables import table

#: Candidates of each list, and how many of them the reranker leaves.
K, TOP = 10, 6
#: Questions and rows of a pair of blocks, and what stands for no score.
QUESTIONS, ROWS, NONE = 256, 20_000, -(10**15)
#: Texts and characters of each that the reranker takes at once (fixed values).
BATCH, CLAMP = 12, 512
#: Words that stand for banned terms in the driver's documents.
TERMS = ("trash", "worthless", "pathetic", "stupid", "disgusting")


def nearest(vectors: DataFrame, query: list[float] | None, k: int = K) -> DataFrame:
    """The k rows of largest cosine with a query, ties to the smaller id; Spark keeps k rows of each task. Without a query there are none."""
    if query is None:
        return vectors.filter(F.lit(False)).withColumn("score", F.lit(None).cast("decimal(18,6)"))
    score = cosine(F.col("embedding"), F.array(*map(F.lit, query)))
    return vectors.withColumn("score", F.round(score.cast("decimal(38,12)"), 6).cast("decimal(18,6)")).orderBy(F.desc_nulls_last("score"), "vec_id").limit(k)


def millionths(rows: np.ndarray, questions: np.ndarray) -> np.ndarray:
    """The cosine of each question with each row in millionths, rounded half up as the decimals of nearest() are; NONE without a length."""
    lengths = np.linalg.norm(questions, axis=1)[:, None] * np.linalg.norm(rows, axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.round(questions @ rows.T / lengths, 12)
        return np.where(lengths > 0, np.sign(score) * np.floor(np.abs(score) * 1e6 + 0.5), NONE).astype(np.int64)


def best_of_blocks(k: int) -> Callable:
    """A function of a block of questions and a block of rows that gives the k best rows of the block for each question."""

    def best(questions: pa.Table, rows: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int]] = []
        ids = rows["vec_id"].to_numpy()
        of = lambda t, some, n: t["embedding"].take(some).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(some), n)
        lengths = [pc.list_value_length(t["embedding"]).to_numpy() for t in (questions, rows)]
        for n in np.intersect1d(*lengths):
            mine, theirs = (np.flatnonzero(x == n) for x in lengths)
            scores = millionths(of(rows, theirs, n), of(questions, mine, n))
            # Only what reaches the score of place k is put in order, all ties with it too.
            least = np.partition(scores, -k, axis=1)[:, -k] if k < len(theirs) else np.full(len(mine), NONE)
            for question, score, bound in zip(questions["question"].to_numpy()[mine], scores, least, strict=True):
                some = np.flatnonzero(score >= bound)
                order = some[np.lexsort((ids[theirs[some]], -score[some]))[:k]]
                found += [(int(question), int(ids[theirs[i]]), int(score[i])) for i in order]
        return pa.table([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], names=["question", "vec_id", "score"])

    return best


def nearest_each(vectors: DataFrame, questions: DataFrame, k: int = K) -> DataFrame:
    """question, vec_id, score and place of the k rows of largest cosine with each question (question, embedding), as nearest() gives them.

    Questions and rows are dealt into blocks by their ids; each pair of blocks is one group of a
    cogroup, which keeps k rows for each question, so that neither ever meets whole in one task or
    on the driver. vec_id and question are unique numbers; vectors that are NULL or hold NULL take no
    part, and those of another length than a question's aren't compared with it.
    """
    usable = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull())
    rows, asked = (df.select(F.col(c).cast("long").alias(c), F.col("embedding").cast("array<double>").alias("embedding")).filter(usable & F.col(c).isNotNull()) for df, c in ((vectors, "vec_id"), (questions, "question")))
    blocks = [max(1, -(-df.count() // most)) for df, most in ((asked, QUESTIONS), (rows, ROWS))]
    dealt = lambda c, i: F.pmod(F.xxhash64(c), F.lit(blocks[i])).cast("int")
    every = lambda i: F.explode(F.sequence(F.lit(0), F.lit(blocks[i] - 1)))
    mine = asked.withColumn("a", dealt("question", 0)).withColumn("b", every(1)).groupBy("a", "b")
    own = rows.withColumn("b", dealt("vec_id", 1)).withColumn("a", every(0)).groupBy("a", "b")
    best = mine.cogroup(own).applyInArrow(best_of_blocks(k), "question long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "vec_id"))
    score = F.when(F.col("score") != NONE, (F.col("score").cast("decimal(18,0)") * F.lit(Decimal("0.000001"))).cast("decimal(18,6)"))
    return best.withColumn("place", place).filter(F.col("place") <= k).select("question", "vec_id", score.alias("score"), "place")


def query_vector(spark: SparkSession, folder: str) -> list[float] | None:
    row = table(spark, folder, "embeddings").filter("vec_id = 0").first()
    return row and [float(x) for x in row.embedding]


def knn_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"), query_vector(spark, folder)).select("vec_id", "score")


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest of two collections in one list; each has columns of its own for where a row is from."""
    vectors, query = table(spark, folder, "embeddings"), query_vector(spark, folder)
    chunks = nearest(vectors.filter("label < 5"), query).select("vec_id", "score", F.col("label").alias("document"))
    sections = nearest(vectors.filter("label >= 5"), query).select("vec_id", "score", F.col("label").alias("regulation"))
    return chunks.unionByName(sections, allowMissingColumns=True)


def candidates_each(spark: SparkSession, folder: str) -> DataFrame:
    """candidates() for every tenth vector as a question."""
    vectors = table(spark, folder, "embeddings")
    questions = vectors.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("question"), "embedding")
    of = lambda some, name: nearest_each(vectors.filter(some), questions).join(vectors.select("vec_id", F.col("label").alias(name)), "vec_id").select("question", "vec_id", "score", name)
    return of("label < 5", "document").unionByName(of("label >= 5", "regulation"), allowMissingColumns=True)


def reranked(found: DataFrame, scores: DataFrame, top: int = TOP, by: tuple[str, ...] = ()) -> DataFrame:
    """The best of a list, or of each list of `by`, by the reranker's scores, with labels from C1 on; a candidate without a score comes last."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc_nulls_last("rerank"), "vec_id"))
    return found.join(scores, [*by, "vec_id"], "left").withColumn("place", place).filter(F.col("place") <= top).withColumn("label", F.concat(F.lit("C"), F.col("place")))


def rerank_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The reranker is a service; a number made of the id stands for its score here."""
    found = candidates(spark, folder)
    return reranked(found, found.select("vec_id", (F.col("vec_id") * 7919 % 101).alias("rerank"))).select("vec_id", "rerank", "label", "document", "regulation")


def batched_scores(passages: DataFrame, score: Callable[[list[str]], list[tuple[int, float]]], size: int = BATCH, most: int = CLAMP, by: tuple[str, ...] = ()) -> DataFrame:
    """vec_id and rerank of passages (vec_id, text): the reranker gets the first characters of size texts at a time and gives (place, score) in its own order; each score goes back to its passage.

    The passages are lists of candidates, one for each value of `by` (whole numbers), of at most 2 * K each.
    """

    def batch(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id").reset_index(drop=True)
        found = dict(score([t[:most] for t in rows["text"].fillna("")]))
        return rows[[*by, "vec_id"]].assign(rerank=[float(found[i]) for i in range(len(rows))])

    place = F.row_number().over(Window.partitionBy(*by).orderBy("vec_id")) - 1
    numbered = passages.select(*by, "vec_id", "text", F.floor(place / size).alias("batch"))
    return numbered.groupBy(*by, "batch").applyInPandas(batch, ", ".join([*(f"{c} long" for c in by), "vec_id long", "rerank double"]))


def by_length(texts: list[str]) -> list[tuple[int, float]]:
    """Stands for the reranker, which is a service: scores from the texts' lengths, the best first."""
    return sorted(((i, float(len(t) * 31 % 101)) for i, t in enumerate(texts)), key=lambda x: -x[1])


def context_of(found: DataFrame, texts: DataFrame, score: Callable[[list[str]], list[tuple[int, float]]], top: int = TOP, by: tuple[str, ...] = ()) -> DataFrame:
    """The context of an answer, or of one for each value of `by`: what was found, with its texts, reranked and labelled; without candidates there is none, and the answer is a refusal."""
    passages = found.join(texts, "vec_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    return reranked(passages, batched_scores(passages, score, by=by), top, by)


def citation_payload(context: DataFrame, valid: list[int], most: int = 400) -> DataFrame:
    """label, kind, quote and source of the passages of a context that an answer really cites."""
    kind = F.when(F.col("regulation").isNotNull(), "regulation").otherwise("document")
    return context.filter(F.col("place").isin(valid)).select("label", kind.alias("kind"), F.substring("text", 1, most).alias("quote"), F.coalesce("regulation", "document").alias("source_id"))


def retrieval_context(spark: SparkSession, folder: str) -> DataFrame:
    """Embed (the vector of id 0), retrieve, rerank and assemble; documents of the same ids are the passages."""
    texts = table(spark, folder, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    return context_of(candidates(spark, folder), texts, by_length)


def retrieval_plan(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval_context(spark, folder).select("label", "vec_id", "rerank", "document", "regulation", F.substring("text", 1, 60).alias("passage"))


def retrieval_plans(spark: SparkSession, folder: str) -> DataFrame:
    """retrieval_plan() for every tenth vector as a question."""
    texts = table(spark, folder, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    context = context_of(candidates_each(spark, folder), texts, by_length, by=("question",))
    return context.select("question", "label", "vec_id", "score", "rerank", "document", "regulation", F.sha2("text", 256).alias("text_sha256"))


def cited_sources(spark: SparkSession, folder: str) -> DataFrame:
    """What an answer that cites the first, the third and a passage that was never offered shows."""
    return citation_payload(retrieval_context(spark, folder), [1, 3, 9], 40)


def excerpts(chunks: DataFrame, group: str, kind: str, order: str, size: str, per_kind: int = 2, most: int = 8, budget: int = 3000) -> DataFrame:
    """For each group the first chunks of each kind, the kinds in order, until the first that breaks the budget.

    The first chunk of a group always stays. What comes after a chunk that breaks the budget goes,
    even if it would fit.
    """
    first = F.row_number().over(Window.partitionBy(group, kind).orderBy(order))
    kept = chunks.withColumn("_n", first).filter(F.col("_n") <= per_kind)
    ordered = Window.partitionBy(group).orderBy(kind, order)
    kept = kept.withColumn("place", F.row_number().over(ordered)).filter(F.col("place") <= most)
    running = F.sum(size).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    return kept.withColumn("running", running).filter((F.col("place") == 1) | (F.col("running") <= budget)).drop("_n")


def prefix_budget(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", F.char_length("text").cast("long").alias("size"))
    return excerpts(docs, "source", "lang", "doc_id", "size", budget=6000).select("source", "lang", "doc_id", "place", "running")


def dedupe_first_seen(spark: SparkSession, folder: str) -> DataFrame:
    """Of the documents with the same text the one seen first."""
    docs = table(spark, folder, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    return docs.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


def top_n_per_group(spark: SparkSession, folder: str) -> DataFrame:
    """The three dearest lines of each order, of equal ones those seen first."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"))
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("amount"), "l_partkey"))
    return lines.withColumn("place", place).filter("place <= 3")


def citation_check(spark: SparkSession, folder: str) -> DataFrame:
    """Of the labels that each turn cites, those that it was offered and those that it was not."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", F.concat("text", F.lit(" [C"), F.col("turn"), F.lit("] [C"), F.col("turn") * 2, F.lit("]")).alias("text"))
    offered = F.sequence(F.lit(1), F.lit(TOP))
    used = cited_labels(F.col("text"))
    shown = lambda labels: F.array_join(labels.cast("array<string>"), ",")
    return turns.select("conv_id", "turn", shown(F.array_intersect(used, offered)).alias("verified"), shown(F.array_except(used, offered)).alias("unknown"))


def banned_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", F.array_join(banned_terms(F.col("text"), ("stupid thing",), TERMS), ",").alias("terms"))
    return docs.filter("terms <> ''")


def history(spark: SparkSession, folder: str, turns: int = 4) -> DataFrame:
    """The last turns of each conversation, two messages for each."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return table(spark, folder, "conversations").select("conv_id", "turn", "role").withColumn("place", place).filter(F.col("place") <= 2 * turns)


QUERIES = {"knn_chunks": knn_chunks, "knn_union": candidates, "rerank_labels": rerank_labels, "prefix_budget": prefix_budget, "dedupe_first_seen": dedupe_first_seen, "top_n_per_group": top_n_per_group, "citation_check": citation_check, "banned_terms": banned_documents, "chat_history": history, "retrieval_plan": retrieval_plan, "retrieval_plans": retrieval_plans, "cited_sources": cited_sources}

_SCORES = """
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT e AS q FROM v WHERE vec_id = 0),
scores AS (SELECT vec_id, label, CAST(round(CAST(list_inner_product(e, q) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(q, q))) AS DECIMAL(38,12)), 6) AS DECIMAL(18,6)) AS score FROM v, q),
candidates AS (
  (SELECT vec_id, score, label AS document, NULL::INTEGER AS regulation FROM scores WHERE label < 5 ORDER BY score DESC, vec_id LIMIT 10)
  UNION ALL (SELECT vec_id, score, NULL, label FROM scores WHERE label >= 5 ORDER BY score DESC, vec_id LIMIT 10))
"""
_CONTEXT = _SCORES + """, passages AS (SELECT c.*, coalesce(text, '') AS text FROM candidates c LEFT JOIN documents ON doc_id = vec_id),
ranked AS (SELECT *, CAST(length(left(text, 512)) * 31 % 101 AS DOUBLE) AS rerank FROM passages),
context AS (SELECT *, row_number() OVER (ORDER BY rerank DESC, vec_id) AS place FROM ranked QUALIFY place <= 6)
"""
ORACLE = {
    "retrieval_plans": """
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT vec_id AS question, e AS q FROM v WHERE vec_id % 10 = 0),
scores AS (SELECT question, vec_id, label, CAST(round(CAST(list_inner_product(e, q) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(q, q))) AS DECIMAL(38,12)), 6) AS DECIMAL(18,6)) AS score FROM v, q),
candidates AS (SELECT *, CASE WHEN label < 5 THEN label END AS document, CASE WHEN label >= 5 THEN label END AS regulation FROM scores QUALIFY row_number() OVER (PARTITION BY question, label < 5 ORDER BY score DESC, vec_id) <= 10),
ranked AS (SELECT c.*, coalesce(text, '') AS text, CAST(length(left(coalesce(text, ''), 512)) * 31 % 101 AS DOUBLE) AS rerank FROM candidates c LEFT JOIN documents ON doc_id = vec_id)
SELECT question, 'C' || row_number() OVER (PARTITION BY question ORDER BY rerank DESC, vec_id) AS label, vec_id, score, rerank, document, regulation, sha256(text) AS text_sha256
FROM ranked QUALIFY row_number() OVER (PARTITION BY question ORDER BY rerank DESC, vec_id) <= 6""",
    "retrieval_plan": _CONTEXT + "SELECT 'C' || place AS label, vec_id, rerank, document, regulation, left(text, 60) AS passage FROM context",
    "cited_sources": _CONTEXT + "SELECT 'C' || place AS label, CASE WHEN regulation IS NOT NULL THEN 'regulation' ELSE 'document' END AS kind, left(text, 40) AS quote, coalesce(regulation, document) AS source_id FROM context WHERE place IN (1, 3)",
    "knn_chunks": _SCORES + "SELECT vec_id, score FROM scores ORDER BY score DESC, vec_id LIMIT 10",
    "knn_union": _SCORES + "SELECT * FROM candidates",
    "rerank_labels": _SCORES
    + """SELECT vec_id, rerank, 'C' || place AS label, document, regulation FROM (
  SELECT *, row_number() OVER (ORDER BY rerank DESC, vec_id) AS place FROM (SELECT *, vec_id * 7919 % 101 AS rerank FROM candidates)) WHERE place <= 6""",
    "prefix_budget": """
WITH firsts AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS n FROM documents),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY lang, doc_id) AS INTEGER) AS place FROM firsts WHERE n <= 2),
summed AS (SELECT *, CAST(sum(length(text)) OVER (PARTITION BY source ORDER BY lang, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM placed WHERE place <= 8)
SELECT source, lang, doc_id, place, running FROM summed WHERE place = 1 OR running <= 6000""",
    "dedupe_first_seen": "SELECT md5(text) AS digest, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1",
    "top_n_per_group": """SELECT * FROM (
  SELECT l_orderkey, l_partkey, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(l_extendedprice AS DECIMAL(18,2)) DESC, l_partkey) AS INTEGER) AS place FROM lineitem)
WHERE place <= 3""",
    "citation_check": """SELECT conv_id, turn, array_to_string(list_filter(used, lambda x: x BETWEEN 1 AND 6), ',') AS verified, array_to_string(list_filter(used, lambda x: x NOT BETWEEN 1 AND 6), ',') AS unknown
FROM (SELECT conv_id, turn, list_sort(list_distinct(list_transform(regexp_extract_all(text || ' [C' || turn || '] [C' || turn * 2 || ']', '\\[C([0-9]+)\\]', 1), lambda x: CAST(x AS INTEGER)))) AS used FROM conversations)""",
    "banned_terms": """
WITH scrubbed AS (SELECT doc_id, replace(text, 'stupid thing', ' ') AS t FROM documents),
found AS (SELECT doc_id, array_to_string(list_filter(['trash', 'worthless', 'pathetic', 'stupid', 'disgusting'], lambda x: contains(t, x) OR contains(lower(t), x)), ',') AS terms FROM scrubbed)
SELECT * FROM found WHERE terms <> ''""",
    "chat_history": "SELECT * FROM (SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS INTEGER) AS place FROM conversations) WHERE place <= 8",
}
