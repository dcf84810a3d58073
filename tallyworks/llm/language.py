"""Language identification by n-gram filters that hold a bit for each language."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.llm.common import checkpointed, giving_back, in_arrow, pieces, python_batches, remainder, table

#: Slots of a filter for each n-gram of a language, and the least and most slots, as powers of two.
SLOTS_A_GRAM, LEAST_BITS, MOST_BITS = 4, 14, 22
#: Odd factors below 2**31, one for each hash of an n-gram: a product with 32 bits stays below 2**63.
FACTORS = (0x2545F491, 0x61C88647)
#: For each of these shares a filter tells which languages have an n-gram at least so often among
#: theirs; the first one holds every n-gram of each language, so that none is left out.
SHARES = (0.0, 2.0**-16, 2.0**-12)
PIECE = 400_000
#: Other ASCII than letters becomes a space; bytes of other letters stay.
LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
UNDETERMINED = "und"
#: Entries of (language, n-gram) that a training task holds before it hands them on.
HELD = 1_000_000


def cleaned(text: str | None) -> bytes:
    """Lower-case words in UTF-8, with one space before, between and after them; without words nothing."""
    words = (text or "").lower().encode("utf-8", "replace").translate(LETTERS).split()
    return b" " + b" ".join(words) + b" " if words else b""


def has_letter(text: str | None) -> bool:
    return bool(text) and (re.search("[A-Za-z]", text) is not None or any(map(str.isalpha, text)))


def grams(raw: bytes) -> np.ndarray:
    """The n-grams of four bytes, as numbers; of three bytes those texts that have no more."""
    if 0 < len(raw) < 4:
        raw = raw.ljust(4)
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    return b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:] if len(b) else b


def _tally(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, back = np.unique(keys, return_inverse=True)
    return found, np.bincount(back, weights, len(found)).astype(np.int64)


def gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, gram, n: the n-grams of a partition's texts by language, summed as far as memory allows."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def rows(lang: str) -> pa.RecordBatch:
        found, n = _tally(*(np.concatenate(x) for x in zip(*held.pop(lang), strict=True)))
        return pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(found), pa.string()), "gram": pa.array(found.astype(np.int64)), "n": pa.array(n)})

    def add(lang: str, raw: list[bytes]) -> None:
        found, n = np.unique(np.concatenate([grams(x) for x in raw]), return_counts=True)
        parts = held.setdefault(lang, [])
        parts.append((found, n))
        if len(parts) > 8:
            held[lang] = [_tally(*(np.concatenate(x) for x in zip(*parts, strict=True)))]

    for batch in batches:
        for lang, part in batch.to_pandas().groupby("lang"):
            for texts in pieces(part["text"], PIECE):
                add(lang, [cleaned(t) for t in texts])
        while sum(len(n) for parts in held.values() for _, n in parts) > HELD:
            yield rows(max(held, key=lambda x: sum(len(n) for _, n in held[x])))
    for lang in list(held):
        yield rows(lang)


@dataclass
class Model:
    """languages in the order of their bits; masks: for each word of 64 languages and each share the slots' bits; rates: how often a language's bit is set by chance, for each share."""

    languages: list[str]
    masks: np.ndarray
    rates: np.ndarray
    commonest: int

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text and its part of all languages' shares of n-grams, corrected for chance.

        Without any n-gram that a language contains it is the commonest language, with score 0.
        """
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        found = [grams(cleaned(t)) for t in texts]
        sizes = np.array([len(g) for g in found])
        full = np.flatnonzero(sizes)
        shares = np.zeros((len(texts), len(self.languages)))
        if len(full):
            keys = np.concatenate([found[i] for i in full]).astype(np.uint64)
            places = 32 - int(self.masks.shape[2]).bit_length() + 1
            slots = [(keys * np.uint64(f) & np.uint64(0xFFFFFFFF)) >> np.uint64(places) for f in FACTORS]
            starts = np.append(0, np.cumsum(sizes[full])[:-1])
            for first in range(0, len(self.languages), 64):
                for tier, masks in enumerate(self.masks[first // 64]):
                    within = masks[slots[0]]
                    for s in slots[1:]:
                        within &= masks[s]
                    for k in range(first, min(first + 64, len(self.languages))):
                        hits = np.add.reduceat(within >> np.uint64(k % 64) & np.uint64(1), starts) / sizes[full]
                        chance = self.rates[tier, k]
                        if chance < 1:  # a filter that is full tells nothing
                            shares[full, k] += np.clip((hits - chance) / (1 - chance), 0, 1) / len(SHARES)
        total = shares.sum(axis=1)
        best = np.where(total > 0, shares.argmax(axis=1), self.commonest)
        score = np.divide(shares.max(axis=1), total, out=np.zeros(len(texts)), where=total > 0)
        letters = np.array([has_letter(t) for t in texts], bool)
        names = [self.languages[k] if ok else UNDETERMINED for k, ok in zip(best, letters, strict=True)]
        return names, np.where(letters, score, 0.0)


def learn(docs: DataFrame) -> Model:
    """The filters from text and lang of docs; rows with a null in either are left out.

    Counts cover every n-gram, and every n-gram of a language is in its first filter. Filters have
    as many slots as the n-grams need, 2**MOST_BITS at most; those slots (for each 64 languages and
    share) are all that comes to the driver. Beyond that they fill, and the correction for chance
    grows: they never lose an n-gram.
    """
    spark = docs.sparkSession
    python_batches(spark)
    counted = in_arrow(docs.filter("lang is not null and text is not null").select("lang", "text"), gram_counts, "lang string, gram long, n long")
    counts = checkpointed(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    totals = {r.lang: (r.n, r.grams) for r in counts.groupBy("lang").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("grams")).collect()}
    languages = sorted(totals)
    needed = SLOTS_A_GRAM * max((grams for _, grams in totals.values()), default=1)
    bits = min(max(LEAST_BITS, (needed - 1).bit_length()), MOST_BITS)
    masks = np.zeros((max(1, (len(languages) + 63) // 64), len(SHARES), 1 << bits), np.uint64)
    if not languages:
        return Model([], masks, np.zeros((len(SHARES), 0)), 0)
    sizes = spark.createDataFrame([(x, i, totals[x][0]) for i, x in enumerate(languages)], "lang string, bit int, total long")
    shares = counts.join(F.broadcast(sizes), "lang").withColumn("share", F.col("n") / F.col("total"))
    tiers = F.explode(F.array_compact(F.array(*[F.when(F.col("share") >= least, F.lit(i)) for i, least in enumerate(SHARES)]))).alias("tier")
    slots = F.explode(F.array(*[F.shiftrightunsigned(F.col("gram") * F.lit(f) % F.lit(1 << 32), 32 - bits) for f in FACTORS])).alias("slot")
    member = shares.select("gram", "bit", tiers).select("bit", "tier", slots)
    words = member.groupBy(F.floor(F.col("bit") / 64).alias("word"), "tier", "slot").agg(F.bit_or(F.expr("shiftleft(1L, bit % 64)")).alias("mask")).toArrow()
    masks[tuple(words[c].to_numpy() for c in ("word", "tier", "slot"))] = words["mask"].to_numpy().view(np.uint64)
    full = np.array([[(masks[k // 64, tier] >> np.uint64(k % 64) & np.uint64(1)).mean() for k in range(len(languages))] for tier in range(len(SHARES))])
    return Model(languages, masks, full ** len(FACTORS), max(range(len(languages)), key=lambda k: totals[languages[k]][0]))


def predictor(spark: SparkSession, model: Model) -> Callable:
    """A function of a text column that gives struct<lang_pred, score>."""
    shared = spark.sparkContext.broadcast((model.languages, model.masks, model.rates, model.commonest))

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Model(*shared.value)
        for batch in batches:
            names, scores = [], [np.zeros(0)]
            for texts in pieces(batch.to_pylist(), PIECE):
                found, score = own.predict(texts)
                names += found
                scores.append(score)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores))], ["lang_pred", "score"])

    return F.arrow_udf(giving_back(predict), "struct<lang_pred string, score double>")


def identified(docs: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """row (all columns of docs), doc_id, lang_pred, score for each row of docs; learned from train or docs.

    A null text, or one without a letter, is und with score 0, as is every text if nothing was
    learned. Ties go to the language that comes first by code point. Rows that repeat get the
    same result; no documents give no rows; columns of docs stay inside row.
    """
    predict = predictor(docs.sparkSession, learn(docs if train is None else train))
    python_batches(docs.sparkSession)
    return docs.select(F.struct("*").alias("row"), "doc_id", predict(F.col("text")).alias("_found")).select("row", "doc_id", "_found.*")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of docs whose text has a language, with the columns of docs; the filters are learned from docs.

    Rows with a null text or one without a letter go, as do all rows if none has a lang. Null ids and
    rows that repeat stay as they are; no documents give no rows.
    """
    return identified(docs).filter(F.col("lang_pred") != UNDETERMINED).select("row.*")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = remainder("doc_id", 4) == 2
    found = identified(docs, docs.filter(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
