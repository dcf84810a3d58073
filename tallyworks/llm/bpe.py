"""Byte-level BPE: encoding in batched merge rounds over numpy arrays, and decoding."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.llm.common import giving_back, pieces, python_batches, table

#: Words whose ids a task remembers; beyond that it forgets all and starts anew.
REMEMBERED = 100_000
#: Characters that are encoded at once.
PIECE = 300_000
#: How the vocabulary's pattern splits a text (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_RANK = np.iinfo(np.int32).max


def byte_letters() -> dict[str, int]:
    """The byte that each letter of the vocabulary's file stands for: printable ones for themselves, others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """The vocabulary of a tokenizer file: merges as sorted pair keys, tokens as bytes, special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            read = json.load(file)
        ids, letters = read["model"]["vocab"], byte_letters()
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in read["model"]["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)[order]
        self.of_byte = np.zeros(256, np.int64)
        for letter, byte in letters.items():
            self.of_byte[byte] = ids[letter]
        self.special = {x["content"]: x["id"] for x in read.get("added_tokens", [])}
        tokens = {i: bytes(letters[c] for c in token) for token, i in ids.items() if token not in self.special}
        tokens |= {i: content.encode() for content, i in self.special.items()}
        known = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.bytes = np.frombuffer(b"".join(known), np.uint8)
        self.lengths = np.array([len(x) for x in known], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i], ..., starts[i] + lengths[i] - 1 for each i, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def merge(words: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words in one array, and how many each word has.

    All symbols lie in one array. In a round every word has the pairs of its lowest rank merged,
    from left to right; a word without a pair that the vocabulary knows is finished and leaves.
    """
    symbols = vocabulary.of_byte[np.frombuffer(b"".join(words), np.uint8)]
    word = np.repeat(np.arange(len(words)), [len(w) for w in words])
    finished = []
    while len(symbols):
        at = np.searchsorted(vocabulary.keys, symbols[:-1] << 32 | symbols[1:])
        at[at == len(vocabulary.keys)] = 0
        known = (vocabulary.keys[at] == (symbols[:-1] << 32 | symbols[1:])) & (word[:-1] == word[1:])
        rank = np.append(np.where(known, vocabulary.ranks[at], NO_RANK), NO_RANK)
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        sizes = np.diff(np.append(first, len(word)))
        least = np.minimum.reduceat(rank, first)
        over = np.repeat(least == NO_RANK, sizes)
        if over.any():
            finished.append((word[over], symbols[over]))
        chosen = np.flatnonzero((rank == np.repeat(least, sizes)) & ~over)
        if not len(chosen):
            break
        # Pairs that overlap, as in "aaa", stand one after the other: of such a run every second one is merged.
        opens = np.append(True, np.diff(chosen) > 1)
        within = np.arange(len(chosen)) - np.flatnonzero(opens)[np.cumsum(opens) - 1]
        chosen = chosen[within % 2 == 0]
        symbols[chosen] = vocabulary.merged[at[chosen]]
        stays = ~over
        stays[chosen + 1] = False
        symbols, word = symbols[stays], word[stays]
    if not finished:
        return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
    word, symbols = (np.concatenate(x) for x in zip(*finished, strict=True))
    return symbols[np.argsort(word, kind="stable")].astype(np.int32), np.bincount(word, minlength=len(words))


class Encoder:
    """Encodes texts; ids of words it has met are remembered."""

    def __init__(self, vocabulary: Vocabulary, remembered: int = REMEMBERED):
        self.vocabulary, self.remembered = vocabulary, remembered
        self.split = regex.compile(PATTERN).findall
        self.specials = regex.compile("|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True)))) if vocabulary.special else None
        self.forget()

    def forget(self) -> None:
        """Only the special tokens are known then; they can't be words of a text, as they hold more than one kind of character."""
        self.known = {(content,): k for k, content in enumerate(self.vocabulary.special)}
        self.ids = np.array(list(self.vocabulary.special.values()), np.int32)
        self.lengths = np.ones(len(self.ids), np.int64)
        self.starts = np.arange(len(self.ids))

    def words(self, text: str) -> list:
        """The words of a text; a special token is a tuple of its string."""
        if self.specials is None or not self.specials.search(text):
            return self.split(text)
        out, at = [], 0
        for found in self.specials.finditer(text):
            out += self.split(text[at : found.start()])
            out.append((found.group(),))
            at = found.end()
        return out + self.split(text[at:])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and how many each text has."""
        split = [self.words(text) if text else [] for text in texts]
        if len(self.known) > self.remembered:
            self.forget()
        new = list({w for words in split for w in words} - self.known.keys())
        if new:
            ids, lengths = merge([w.encode() for w in new], self.vocabulary)
            self.known |= dict(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.starts = np.append(self.starts, len(self.ids) + np.cumsum(lengths) - lengths)
            self.ids, self.lengths = np.append(self.ids, ids), np.append(self.lengths, lengths)
        counts = np.array([len(words) for words in split], np.int64)
        at = np.fromiter((self.known[w] for words in split for w in words), np.int64, counts.sum())
        lengths = self.lengths[at]
        ends = np.append(0, np.cumsum(lengths))[np.append(0, np.cumsum(counts))]
        return self.ids[spread(self.starts[at], lengths)], np.diff(ends)


def decode(ids: np.ndarray, counts: np.ndarray, vocabulary: Vocabulary) -> list[str]:
    """The texts of the ids; ids that the vocabulary lacks are left out, and bytes that aren't UTF-8 replaced."""
    there = (ids >= 0) & (ids < len(vocabulary.lengths))
    at = np.where(there, ids, 0)
    lengths = np.where(there, vocabulary.lengths[at], 0)
    raw = vocabulary.bytes[spread(vocabulary.starts[at], lengths)].tobytes()
    ends = np.append(0, np.cumsum(lengths))[np.append(0, np.cumsum(counts))]
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]


def encoder(path: str) -> Callable:
    """A function of a text column that gives array<int>, by the tokenizer file at path on every worker.

    The ids are those of the tokenizers library without special tokens of its own; strings of
    special tokens in a text become their ids. A null or empty text gives an empty array; texts
    of any length are encoded whole.
    """

    def encode_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Encoder(Vocabulary(path))
        for batch in batches:
            parts = [own.encode(texts) for texts in pieces(batch.to_pylist(), PIECE)] or [(np.zeros(0, np.int32), np.zeros(0, np.int64))]
            ids, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(ids, pa.int32()))

    return F.arrow_udf(giving_back(encode_texts), "array<int>")


def decoder(path: str) -> Callable:
    """A function of a column of ids that gives their text; null ids or a null array give an empty text."""

    def decode_ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = Vocabulary(path)
        for batch in batches:
            counts = np.array([len(x) if x.is_valid else 0 for x in batch], np.int64) if batch.null_count else np.diff(batch.offsets.to_numpy())
            ids = batch.flatten().fill_null(-1).to_numpy()
            yield pa.array(decode(ids, counts, vocabulary), pa.string())

    return F.arrow_udf(giving_back(decode_ids), "string")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenised(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and decoded (the text of the ids), one row for each row of docs; other columns aren't read.

    Null and empty texts have no ids and an empty decoded text; repeated rows and null ids of
    documents stay as they are; no documents give no rows.
    """
    python_batches(docs.sparkSession)
    path = path or tokenizer_path()
    return docs.select("doc_id", encoder(path)(F.col("text")).alias("ids")).withColumn("decoded", decoder(path)(F.col("ids")))


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and what they decode to."""
    return digests(tokenised(table(spark, sf_dir, "documents")))
