"""Toxicity by a weighted lexicon: folded texts, terms found by Aho-Corasick, exception phrases, sums normalised by length."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.llm.common import checkpointed, giving_back, in_arrow, python_batches, remainder, table

#: Labelled texts that lexicon and weights are fitted on at most, and terms of the lexicon.
LABELLED, TERMS = 20_000, 5_000
#: Letters of a term: beginnings of words from SHORT on; longer words are cut there.
SHORT, LONG = 3, 12
#: Twice the log likelihood ratio from which on a term's share of toxic texts isn't chance, and a phrase's share of others.
SURE, SURE_EXCEPTION = 24.0, 16.0
#: Toxic texts that a term is in, at least; one of fewer may come from a few copies of one text.
LEAST = 3
#: Terms that a task counts before it hands the counts on.
HELD = 300_000
#: Least hashes by which near copies among the labelled texts are found.
SKETCHES = 4
PENALTY = 0.1

#: Letters of other alphabets that look like Latin ones, by the Latin letter (a fixed table of lookalikes).
LOOKALIKES = {
    "a": "аαɑ", "b": "вЬβ", "c": "сϲ", "d": "ԁ", "e": "еεєҽ", "g": "ɡ", "h": "һнη", "i": "іιıɩ", "j": "јϳ", "k": "кκ", "l": "ӏǀ", "m": "мμ", "n": "ոпν", "o": "оοσօ",
    "p": "рρ", "q": "ԛ", "r": "гʀ", "s": "ѕꜱ", "t": "тτ", "u": "υսц", "v": "ѵ", "w": "ԝшω", "x": "хχ", "y": "уγү", "z": "ᴢʐ",
}
#: What digits and signs within words stand for; i, l and 1 are one letter.
SUBSTITUTES = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "l": "i"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "+": "t"}
FOLD = str.maketrans({other: SUBSTITUTES.get(latin, latin) for latin, others in LOOKALIKES.items() for other in others.lower()} | SUBSTITUTES)
SIGN = re.compile(r"(?<=[^\W_])[@$!|€+](?=[^\W_])")
WORDS = re.compile(r"[^\W_]+")


def folded(text: str | None) -> list[str]:
    """The words of a text in one spelling: lower case, no compatibility forms, lookalikes and substitutes as letters; numbers stay."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = SIGN.sub(lambda m: SIGNS[m.group()], text.lower())
    return [w if w.isdecimal() else w.translate(FOLD) for w in WORDS.findall(text)]


def terms_of(words: set[str]) -> set[str]:
    """Candidates for the lexicon in the words of a text: a blank and the beginning of a word, or a whole word between blanks."""
    return {f" {w[:k]}" for w in words for k in range(SHORT, min(len(w), LONG) + 1)} | {f" {w[:LONG]}" if len(w) > LONG else f" {w} " for w in words if not w.isdecimal()}


def counting(of: Callable) -> Callable:
    """A function over batches of text and label that gives term, positive, negative: how many texts with either label hold it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, find = (Counter(), Counter()), of()
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                own[label].update(find(text))
                if len(own[0]) + len(own[1]) > HELD:
                    yield counted(own)
                    own = (Counter(), Counter())
        yield counted(own)

    return count


def counted(own: tuple[Counter, Counter]) -> pa.RecordBatch:
    names = list(own[0] | own[1])
    return pa.RecordBatch.from_pydict({"term": pa.array(names, pa.string()), "positive": pa.array([own[1][n] for n in names], pa.int64()), "negative": pa.array([own[0][n] for n in names], pa.int64())})


def likelihood(positive: np.ndarray, negative: np.ndarray, all_positive: int, all_negative: int) -> np.ndarray:
    """Twice the log ratio of the likelihoods of two shares and of one; negative where the share of positives is the smaller one."""

    def part(k, n, p):
        return k * np.log(np.maximum(p, 1e-300)) + (n - k) * np.log(np.maximum(1 - p, 1e-300))

    p, n = np.asarray(positive, float), np.asarray(negative, float)
    a, b, c = p / all_positive, n / all_negative, (p + n) / (all_positive + all_negative)
    ratio = 2 * (part(p, all_positive, a) + part(n, all_negative, b) - part(p, all_positive, c) - part(n, all_negative, c))
    return np.where(a >= b, 1, -1) * np.maximum(ratio, 0)


def log_odds(positive: np.ndarray, negative: np.ndarray, all_positive: int, all_negative: int) -> np.ndarray:
    """The log of how much likelier a toxic text is to hold the term, with half a text added to each count."""
    return np.log((np.asarray(positive) + 0.5) / (all_positive + 1)) - np.log((np.asarray(negative) + 0.5) / (all_negative + 1))


@dataclass
class Lexicon:
    """Weights by term, phrases in which a term doesn't count, and a logistic function of a text's sums."""

    weights: dict[str, float]
    exceptions: frozenset[str]
    model: np.ndarray


class Matcher:
    """Finds the terms of a lexicon in a text; one for each task."""

    def __init__(self, weights: dict[str, float], exceptions: frozenset[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for term in weights.keys() | exceptions:
            self.automaton.add_word(term, (len(term), weights.get(term), term in exceptions))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.any = len(self.automaton) > 0

    def found(self, words: list[str]) -> list[tuple[int, int, float]]:
        """Beginning, end and weight of the terms in the folded text: the longest one at a place, and none that lies within an exception."""
        if not self.any or not words:
            return []
        terms, spared = {}, []
        for end, (size, weight, exception) in self.automaton.iter(f" {' '.join(words)} "):
            begin = end + 1 - size
            if exception:
                spared.append((begin, end + 1))
            if weight is not None and (begin not in terms or size > terms[begin][1] - begin):
                terms[begin] = (begin, end + 1, weight)
        return [t for t in terms.values() if not any(a <= t[0] and t[1] <= b for a, b in spared)]


FEATURES = 5


def features(words: list[str], matcher: Matcher) -> tuple[float, ...]:
    """One, then the terms' weights by the length of the text: their sum, for each word, for the root of words; and how many different terms."""
    found = matcher.found(words)
    total, n = sum(w for _, _, w in found), len(words)
    return 1.0, np.log1p(total), 100 * total / (n + 20), total / (n + 20) ** 0.5, np.log1p(len({w for _, _, w in found}))


def phrases_of(terms: dict[str, float]) -> Callable:
    """A function of a text that gives the phrases around its terms: the whole word, and with the one before or after it."""
    matcher = Matcher(terms, frozenset())

    def of(text: str | None) -> set[str]:
        words = folded(text)
        begins = np.cumsum([0] + [len(w) + 1 for w in words])
        out = set()
        for begin, _, _ in matcher.found(words):
            i = int(np.searchsorted(begins, begin))
            out |= {f" {' '.join(words[a:b])} " for a, b in ((i, i + 1), (i - 1, i + 1), (i, i + 2)) if 0 <= a and b <= len(words)}
        return out

    return of


def chosen(rows: list, positives: int, negatives: int) -> dict[str, float]:
    """Weights of the terms that tell most; of terms that begin with one another the one that tells more, then the longer one."""
    rows = sorted(rows, key=lambda r: r.term)
    p, n = (np.array([r[c] for r in rows]) for c in ("positive", "negative"))
    sure, weight = likelihood(p, n, positives, negatives), log_odds(p, n, positives, negatives)
    out: dict[str, float] = {}
    begun: set[str] = set()
    for i in sorted(range(len(rows)), key=lambda i: (-round(sure[i], 6), rows[i].term.endswith(" "), -len(rows[i].term), rows[i].term)):
        term = rows[i].term
        beginnings = {term[:k] for k in range(2, len(term) + 1)}
        if term not in begun and not beginnings & out.keys():
            out[term] = float(weight[i])
            begun |= beginnings
    return out


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the logistic function by Newton steps, with a penalty on all but the first."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    z, w = x / scale, np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [PENALTY] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += step * min(1.0, 3 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, label, digest, and the smallest of SKETCHES hashes over runs of five words: near copies have most of them in common."""
    salts = np.random.default_rng(5).integers(1, 2**63, SKETCHES, dtype=np.uint64) | np.uint64(1)
    for batch in batches:
        texts, out = batch.column("text").to_pylist(), []
        for text in texts:
            words = np.array([xxhash.xxh3_64_intdigest(w) for w in folded(text)] or [0], np.uint64)
            runs = sum(np.roll(words, -k) * np.uint64(2 * k + 3) for k in range(5))[: max(1, len(words) - 4)]
            mixed = (runs ^ runs >> np.uint64(29)) * salts[:, None]
            out.append((mixed ^ mixed >> np.uint64(32)).min(axis=1).view(np.int64))
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([x[i] for x in out], pa.int64()) for i in range(SKETCHES))], names=[*batch.schema.names, *(f"s{i}" for i in range(SKETCHES))])


def sample_of(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """text and label of at most `most` labelled texts, those with the smallest hashes of ids, and of near copies with one label one.

    Labels other than 0 and 1, null ids, and ids with different labels are left out.
    """
    one = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("label"), F.max("toxic").alias("other"))
    ids = one.filter("label = other").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(F.col("doc_id").alias("_id"), F.col("label").cast("int"))
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
    kinds = ", ".join(f"s{i} long" for i in range(SKETCHES))
    texts = checkpointed(in_arrow(rows.select("text", "label", F.sha2(F.col("text").cast("binary"), 256).alias("digest")), signatures, f"text string, label int, digest string, {kinds}"))
    left = texts.drop("text")
    for i in range(SKETCHES):
        rest = [c for c in left.columns if c not in (f"s{i}", "label")]
        left = left.groupBy(f"s{i}", "label").agg(F.min(F.struct("digest", *[c for c in rest if c != "digest"])).alias("one")).select("label", "one.*")
    return texts.join(left.select("digest", "label"), ["digest", "label"], "left_semi").groupBy("digest", "label").agg(F.first("text").alias("text")).select("text", "label")


def learn(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> Lexicon:
    """A lexicon from the labelled texts of docs (labels: doc_id, toxic), and the function that turns sums into probabilities.

    A term is in it if at least LEAST toxic texts hold it and its share among them isn't chance. A
    phrase around a term is an exception if it is surely commoner in texts that aren't toxic.
    Without labels of both kinds there are no terms, and every text gets the share of label 1.
    """
    python_batches(docs.sparkSession)
    sample = checkpointed(sample_of(docs, labels, most))
    by_label = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    positives, negatives = by_label.get(1, 0), by_label.get(0, 0)
    if not positives or not negatives:
        share = min(max(float(positives > 0) if positives + negatives else 0.5, 0.01), 0.99)
        return Lexicon({}, frozenset(), np.array([np.log(share / (1 - share))] + [0.0] * (FEATURES - 1)))

    def counts_of(of: Callable) -> DataFrame:
        return in_arrow(sample, counting(of), "term string, positive long, negative long").groupBy("term").agg(F.sum("positive").alias("positive"), F.sum("negative").alias("negative"))

    some = counts_of(lambda: lambda text: terms_of(set(folded(text)))).filter(f"positive >= {LEAST} and positive * {negatives} > 2 * negative * {positives}")
    rows = some.orderBy(F.desc(F.col("positive") / positives - F.col("negative") / negatives), "term").limit(20 * TERMS).collect()
    sure = likelihood([r.positive for r in rows], [r.negative for r in rows], positives, negatives)
    weights = dict(list(chosen([r for r, s in zip(rows, sure, strict=True) if s >= SURE], positives, negatives).items())[:TERMS])
    around = counts_of(lambda: phrases_of(weights)).filter(f"negative >= {LEAST}").orderBy(F.desc(F.col("negative") / negatives - F.col("positive") / positives), "term").limit(TERMS).collect()
    spare = likelihood([r.positive for r in around], [r.negative for r in around], positives, negatives)
    exceptions = frozenset(r.term for r, s in zip(around, spare, strict=True) if s <= -SURE_EXCEPTION)
    found = sample.select("label", summing(weights, exceptions)(F.col("text")).alias("x")).toArrow()
    x = found["x"].combine_chunks().flatten().to_numpy().reshape(-1, FEATURES)
    y = found["label"].to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # sums don't depend on the order in which rows come
    return Lexicon(weights, exceptions, logistic(x[order], y[order]))


def summing(weights: dict[str, float], exceptions: frozenset[str]) -> Callable:
    """A function of a text column that gives its features."""

    def sums(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = Matcher(weights, exceptions)
        for batch in batches:
            yield pa.array([features(folded(t), matcher) for t in batch.to_pylist()], pa.list_(pa.float64()))

    return F.arrow_udf(giving_back(sums), "array<double>")


FOUND = pa.struct([("score", pa.float64()), ("spans", pa.list_(pa.string()))])


def scoring(lexicon: Lexicon) -> Callable:
    """A function of a text column that gives its score and the terms that it holds, folded."""

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = Matcher(lexicon.weights, lexicon.exceptions)
        for batch in batches:
            out = []
            for text in batch.to_pylist():
                words = folded(text)
                x = np.dot(features(words, matcher), lexicon.model)
                joined = f" {' '.join(words)} "
                out.append({"score": float(1 / (1 + np.exp(-np.clip(x, -40, 40)))), "spans": sorted({joined[a:b].strip() for a, b, _ in matcher.found(words)})})
            yield pa.array(out, FOUND)

    return F.arrow_udf(giving_back(score), "struct<score:double,spans:array<string>>")


def scored(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 is likelier) and terms (those found, folded), one row for each row of docs.

    Texts are scanned whole, however long. A null or empty text, or one without words, has no terms
    and the score of such texts; rows that repeat get the same score; no documents give no rows;
    without labels of both kinds every score is the same. No other column of docs is read.
    """
    lexicon = learn(docs, labels, most)
    found = docs.select("doc_id", scoring(lexicon)(F.col("text")).alias("found"))
    return found.select("doc_id", "found.score", F.col("found.spans").alias("terms"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, by a lexicon learned from two thirds of the labels."""
    held_out = remainder("doc_id", 3) == 1
    found = scored(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").filter(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
