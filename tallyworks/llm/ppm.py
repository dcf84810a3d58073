"""Scores of texts under a byte model with partial matching, beside a word model.

The trie of contexts is learned from all training texts: windows of ORDER + 1 bytes are counted in
Spark, and shorter ones come from them by summing. Every (context, symbol) that occurs is an entry,
however rare. Symbols without an entry share the escape probability; they take the probabilities of
the context that is one byte shorter, without the symbols that have an entry, so each context's
probabilities sum to 1. How often a context escapes is estimated for each order from all contexts
with about as many symbols and as many different ones: by how many of their symbols would be new
if each were left out once.

Windows are dealt by the last LOCAL bytes of their contexts, so a partition holds all that contexts
of this length and longer need; shorter ones have few different entries, which all tasks get. The
most frequent windows are broadcast with their scores, and the others meet theirs in a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.llm.common import checkpointed, in_arrow, pieces, python_batches, remainder_of, table

ORDER = 6
#: Windows are dealt by this many bytes; entries of shorter contexts, 2**24 at most, go to all tasks.
LOCAL = 3
#: The most windows that are broadcast with their scores, and steps of a count's doubling to find them by.
FREQUENT, STEPS = 2**20, 8
#: A word that is broadcast with its count is at least this part of all.
SHARE = 2.0**-20
#: Words with fewer training tokens than this are looked up by a shuffle even in small inputs.
LEAST_HEAVY = 16
#: Contexts are alike in escaping by their number of symbols (beyond EXACT by its doublings) and of different ones.
EXACT, DOUBLINGS, TYPES_APART = 8, 8, 6
PIECE = 250_000
#: Rows that a task holds before it sums them or deals them out, and words whose hashes it remembers.
HELD, REMEMBERED = 900_000, 150_000
#: Buckets for each partition of a shuffle, and bytes of texts for which there is a partition at least.
BUCKETS, PART_BYTES = 4, 1 << 24
#: Texts of one remainder of crc32 are held out.
DIVISOR, HELD_OUT = 10, 0
U = np.uint64
COUNT = np.dtype([("key", "<u8"), ("n", "<i8")])
USE = np.dtype([("word", "<u8"), ("row", "<i8"), ("n", "<u4"), ("train", "u1")])


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


#: The end of a text as a token; no word holds a line break.
END = b"\n"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def token_hashes(texts: list[list[bytes]], hashes: _Hashes) -> np.ndarray:
    """The hashes of each text's words and of its end, one text after the other."""
    every = chain.from_iterable(chain.from_iterable((words, (END,)) for words in texts))
    return np.fromiter(map(hashes.__getitem__, every), np.uint64, sum(map(len, texts)) + len(texts))


def windows(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol of each text its context and itself as one number, and how many symbols each text has.

    The symbols are the words' bytes, a space between words and a line break at the end; the first
    contexts are filled up with line breaks.
    """
    raw = [b"\n" * ORDER + b" ".join(words) + b"\n" for words in texts]
    b = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
    if not len(b):
        return b, b
    lengths = np.array([len(x) for x in raw])
    out = b[: len(b) - ORDER].copy()
    for i in range(1, ORDER + 1):
        out <<= 8
        out |= b[i : len(b) - ORDER + i]
    whole = np.ones(len(b), bool)
    ends = np.cumsum(lengths)
    for i in range(1, ORDER + 1):
        whole[ends - i] = False
    return out[whole[: len(out)]], lengths - ORDER


def firsts(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sums of runs that begin there."""
    return np.add.reduceat(values, first) if len(first) else values[:0]


def tally(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    keys = keys[order]
    first = firsts(keys)
    out = np.empty(len(first), COUNT)
    out["key"], out["n"] = keys[first], sums(n[order], first)
    return out


class Tallies:
    """Sums by key of what comes in, kept small."""

    def __init__(self) -> None:
        self.parts: list[np.ndarray] = []
        self.rows = self.summed = 0

    def add(self, part: np.ndarray) -> None:
        self.parts.append(part)
        self.rows += len(part)
        if self.rows > 2 * self.summed + HELD // 4:
            self.parts = [self.sum()]
            self.rows = self.summed = len(self.parts[0])

    def sum(self) -> np.ndarray:
        """The sums of all that came in; the parts are given up before they are sorted."""
        rows = np.concatenate([np.empty(0, COUNT), *self.parts])
        self.parts = []
        keys, n = rows["key"].copy(), rows["n"].copy()
        del rows
        return tally(keys, n)

    def clear(self) -> np.ndarray:
        out = self.sum()
        self.__init__()
        return out


def wired(rows: np.ndarray) -> bytes:
    """Counts as bytes: all keys, then all counts; those of one task fit into 32 bits."""
    return rows["key"].tobytes() + rows["n"].astype(np.uint32).tobytes()


def unwired(packed: bytes) -> np.ndarray:
    n = len(packed) // 12
    out = np.empty(n, COUNT)
    out["key"], out["n"] = np.frombuffer(packed, np.uint64, n), np.frombuffer(packed, np.uint32, offset=8 * n)
    return out


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys * U(0x9E3779B97F4A7C15) >> U(32)) % U(buckets)).astype(np.int64)


def local(keys: np.ndarray) -> np.ndarray:
    """The last bytes of windows' contexts, by which windows are dealt."""
    return keys >> U(8) & U((1 << 8 * LOCAL) - 1)


def dealt(rows: np.ndarray, bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """rows by their bucket, as bytes."""
    rows = rows[np.argsort(bucket, kind="stable")]
    ends = np.append(0, np.cumsum(np.bincount(bucket, minlength=buckets)))
    for b in np.flatnonzero(np.diff(ends)):
        yield int(b), rows[ends[b] : ends[b + 1]].tobytes()


WINDOW, WORD, TYPES, TOKENS, SHORT, LEVEL, SCORE, LEFT_OUT, NEW = range(9)


def training_counts(buckets: int):
    """A function over batches of (doc_id, text) that gives the counts of windows and words of training texts by bucket.

    Windows of other texts are there too, with a count of 0 if no training text has them.
    """

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        held = {WINDOW: Tallies(), WORD: Tallies()}

        def out(kind: int) -> pa.RecordBatch:
            rows = held[kind].clear()
            parts = list(dealt(rows, bucket_of(local(rows["key"]) if kind == WINDOW else rows["key"], buckets), buckets))
            return pa.RecordBatch.from_pydict({"bucket": pa.array([b for b, _ in parts], pa.int32()), "kind": pa.array([kind] * len(parts), pa.int32()), "packed": pa.array([wired(np.frombuffer(x, COUNT)) for _, x in parts], pa.binary())})

        for batch in batches:
            ids = batch.column(0).to_pylist()
            train, other = [], []
            for i, t in zip(ids, batch.column(1).to_pylist(), strict=True):
                (other if remainder_of(i, DIVISOR) == HELD_OUT else train).append(t)
            for texts in pieces(other, PIECE):
                keys = np.unique(windows([words_of(t) for t in texts])[0])
                held[WINDOW].add(np.rec.fromarrays([keys.astype(np.uint64), np.zeros(len(keys), np.int64)], COUNT))
                if held[WINDOW].summed > HELD:
                    yield out(WINDOW)
            for texts in pieces(train, PIECE):
                words = [words_of(t) for t in texts]
                found, _ = windows(words)
                keys, n = np.unique(found, return_counts=True)
                held[WINDOW].add(np.rec.fromarrays([keys.astype(np.uint64), n], COUNT))
                keys, n = np.unique(token_hashes(words, hashes), return_counts=True)
                held[WORD].add(np.rec.fromarrays([keys, n], COUNT))
                for kind, tallies in held.items():
                    if tallies.summed > HELD:
                        yield out(kind)
        yield from map(out, held)

    return counts


SUMMED = "kind int, key long, n long, packed binary"


def count_level(n: np.ndarray) -> np.ndarray:
    """A number that is higher for larger counts, for fewer numbers than counts; 0 and 1 have the least."""
    return np.floor(STEPS * np.log2(np.maximum(n, 1))).astype(np.int64)


def summed_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind, key, n, packed: all windows (packed), the partition's counts of those without the first bytes, how many of
    them have a level of counts, the more frequent words, and how many different words and tokens the partition has."""
    tallies = {WINDOW: Tallies(), WORD: Tallies()}

    def rows_of(kind: int, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(keys), 100_000):
            some = keys[at : at + 100_000].astype(np.int64)
            yield pa.RecordBatch.from_pydict({"kind": pa.array([kind] * len(some), pa.int32()), "key": pa.array(some), "n": pa.array(n[at : at + 100_000].astype(np.int64)), "packed": pa.nulls(len(some), pa.binary())})

    for batch in batches:
        for kind, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            tallies[kind].add(unwired(packed))
    words = tallies.pop(WORD).clear()
    yield from rows_of(TYPES, np.zeros(1), np.array([len(words)]))
    yield from rows_of(TOKENS, np.zeros(1), np.array([words["n"].sum()]))
    words = words[words["n"] >= LEAST_HEAVY]
    yield from rows_of(WORD, words["key"].view(np.int64) if len(words) else np.zeros(0), words["n"])
    found = tallies.pop(WINDOW).clear()
    for at in range(0, len(found), 500_000):
        yield pa.RecordBatch.from_pydict({"kind": pa.array([WINDOW], pa.int32()), "key": pa.nulls(1, pa.int64()), "n": pa.nulls(1, pa.int64()), "packed": pa.array([found[at : at + 500_000].tobytes()], pa.binary())})
    found = found[found["n"] > 0]
    short = tally(found["key"] & U((1 << 8 * LOCAL) - 1), found["n"])
    yield from rows_of(SHORT, short["key"], short["n"])
    levels, n = np.unique(count_level(found["n"]), return_counts=True)
    yield from rows_of(LEVEL, levels, n)
    for order, level in enumerate(levels_of(found["key"], found["n"], range(LOCAL, ORDER + 1)), LOCAL):
        for kind, n in zip((LEFT_OUT, NEW), left_out(level), strict=True):
            at = np.flatnonzero(n)
            yield from rows_of(kind, order * CLASSES + at, n[at])


def place(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the sorted keys hold what is wanted, and whether they do."""
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


CLASSES = (EXACT + DOUBLINGS) * TYPES_APART


def alike(total: np.ndarray, types: np.ndarray) -> np.ndarray:
    """The class of contexts with so many symbols, so many of them different."""
    doublings = np.floor(np.log2(np.maximum(total, 1) / EXACT)).astype(np.int64)
    size = np.where(total <= EXACT, total - 1, EXACT + np.clip(doublings, 0, DOUBLINGS - 1))
    return size * TYPES_APART + np.minimum(types, TYPES_APART) - 1


def contexts_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted keys the contexts, where each begins, and the place of each key's context."""
    first = firsts(keys >> 8)
    types = np.diff(np.append(first, len(keys)))
    return (keys >> 8)[first], first, np.repeat(np.arange(len(first)), types)


def left_out(level: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each class how many symbols of an order's contexts leave a context of that class if they are left out once, and how many of these it doesn't have then."""
    keys, n, total = level
    _, first, back = contexts_of(keys)
    types = np.bincount(back, minlength=len(first))[back]
    several = total > 1
    classes = alike(total - 1, types - (n == 1))[several]
    n, single = n[several], (n == 1)[several]
    return np.bincount(classes, n, CLASSES).astype(np.int64), np.bincount(classes, single, CLASSES).astype(np.int64)


def escapes_of(left: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The probability to escape of each class; half where nothing tells."""
    return (new + 0.5) / (left + 1)


def entry_probabilities(level: tuple[np.ndarray, np.ndarray, np.ndarray], escapes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The probability of each entry, and that of the escape of each context."""
    keys, n, total = level
    _, first, back = contexts_of(keys)
    escape = escapes[alike(total[first], np.bincount(back, minlength=len(first)))]
    return n / total * (1 - escape[back]), escape


class Trie:
    """Contexts of each order with their entries' probabilities and weights of escape, as decimal logarithms."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], shorter: Trie | None = None, escapes: np.ndarray | None = None):
        """levels: for orders 0, 1, ..., or those after a trie of shorter contexts: keys (context and symbol) of the entries, their counts, their contexts' totals.

        escapes: for each order and class the probability to escape; without it, it is estimated from the levels.
        """
        self.levels = list(shorter.levels) if shorter else []
        lower = (self.levels[-1][0], 10 ** self.levels[-1][1]) if shorter else None
        for order, (keys, n, total) in enumerate(levels, len(self.levels)):
            by_key = np.argsort(keys)
            level = keys, n, total = keys[by_key], n[by_key], total[by_key]
            contexts, _, back = contexts_of(keys)
            p, escape = entry_probabilities(level, escapes_of(*left_out(level)) if escapes is None else escapes[order])
            below = np.full(len(keys), 1 / 256) if lower is None else lower[1][np.searchsorted(lower[0], keys & ((1 << 8 * order) - 1))]
            left = 1 - np.bincount(back, below, len(contexts))
            weight = np.where(left > 1e-12, escape / np.maximum(left, 1e-12), 1.0)
            self.levels.append((keys, np.log10(p), contexts, np.log10(weight)))
            lower = (keys, p)

    def scores(self, found: np.ndarray) -> np.ndarray:
        """The logarithms of the probabilities of windows."""
        out = np.zeros(len(found))
        rest = np.arange(len(found))
        for order in range(len(self.levels) - 1, -1, -1):
            keys, p, contexts, weight = self.levels[order]
            wanted = found[rest] & ((1 << 8 * (order + 1)) - 1)
            at, known = place(keys, wanted)
            out[rest[known]] += p[at[known]]
            rest, wanted = rest[~known], wanted[~known]
            at, known = place(contexts, wanted >> 8)
            out[rest[known]] += weight[at[known]]
        out[rest] += np.log10(1 / 256)
        return out

    def text_scores(self, texts: list[list[bytes]]) -> np.ndarray:
        found, lengths = windows(texts)
        different, back = np.unique(found, return_inverse=True)
        each = self.scores(different)[back]
        return np.add.reduceat(each, np.append(0, np.cumsum(lengths)[:-1])) if len(texts) else np.zeros(0)


def levels_of(keys: np.ndarray, n: np.ndarray, orders: range) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """What Trie takes for these orders, from all windows that occur, or those of the contexts that it is for."""
    out = []
    for order in orders:
        entries = tally(keys & U((1 << 8 * (order + 1)) - 1), n)
        first = firsts(entries["key"] >> U(8))
        total = np.repeat(sums(entries["n"], first), np.diff(np.append(first, len(entries))))
        out.append((entries["key"].astype(np.int64), entries["n"], total))
    return out


def packed_windows(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    return np.concatenate([np.empty(0, COUNT), *(np.frombuffer(x, COUNT) for batch in batches for x in batch.column(0).to_pylist())])


def frequent_windows(least: int, escapes: np.ndarray):
    """A function over a partition's packed windows that gives the key and score of those whose level of counts is at least this."""

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = packed_windows(batches)
        own = found[found["n"] > 0]
        [level] = levels_of(own["key"], own["n"], range(ORDER, ORDER + 1))
        some = count_level(level[1]) >= least
        p, _ = entry_probabilities(level, escapes[ORDER])
        yield pa.RecordBatch.from_pydict({"key": pa.array(level[0][some]), "score": pa.array(np.log10(p[some]))})

    return frequent


SCORES = np.dtype([("key", "<u8"), ("score", "<f8")])


def other_windows(shorter, escapes: np.ndarray, least: int, buckets: int):
    """A function over a partition's packed windows that gives those that aren't frequent, with their scores, by bucket."""

    def other(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = packed_windows(batches)
        own = found[found["n"] > 0]
        trie = Trie(levels_of(own["key"], own["n"], range(LOCAL, ORDER + 1)), shorter.value, escapes)
        found = found[(found["n"] == 0) | (count_level(found["n"]) < least)]
        for at in range(0, len(found), HELD // 2):
            keys = found["key"][at : at + HELD // 2]
            rows = np.empty(len(keys), SCORES)
            rows["key"], rows["score"] = keys, trie.scores(keys.astype(np.int64))
            parts = list(dealt(rows, bucket_of(keys, buckets), buckets))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([b for b, _ in parts], pa.int32()), "kind": pa.array([SCORE] * len(parts), pa.int32()), "packed": pa.array([x for _, x in parts], pa.binary())})

    return other


SCORED = "bucket int, kind int, packed binary, row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"


WINDOW_USE = np.dtype([("key", "<u8"), ("row", "<u4")])


def split_windows(found: np.ndarray, text: np.ndarray, texts: int, common: np.ndarray, common_score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What common windows add to each text's score, and the uses of others."""
    order = np.argsort(found)
    found, text = found[order], text[order]
    first = firsts(found)
    at, known = place(common, found[first])
    times = np.diff(np.append(first, len(found)))
    frequent = np.repeat(known, times)
    added = np.bincount(text[frequent], np.repeat(common_score[at[known]], times[known]), texts)
    rare = np.empty(int((~frequent).sum()), WINDOW_USE)
    rare["key"], rare["row"] = found[~frequent], text[~frequent]
    return added, rare


def packed_uses(low: int, rows: np.ndarray) -> bytes:
    """A task's uses of windows: its first row, how many windows, the different keys, how often each is there, and the rows after the first."""
    first = firsts(rows["key"])
    times = np.diff(np.append(first, len(rows))).astype(np.uint32)
    return np.array([low, len(first)], np.int64).tobytes() + rows["key"][first].tobytes() + times.tobytes() + rows["row"].tobytes()


def unpacked_uses(packed: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    low, n = np.frombuffer(packed, np.int64, 2).tolist()
    return low, np.frombuffer(packed, np.uint64, n, 16), np.frombuffer(packed, np.uint32, n, 16 + 8 * n), np.frombuffer(packed, np.uint32, offset=16 + 12 * n)


def scored_texts(shared, buckets: int):
    """A function over batches of (doc_id, text) that gives what frequent windows and words add to each text's scores, and the uses of others by bucket."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, common_score, heavy, heavy_n = shared.value
        logs = np.log10(heavy_n + 0.1)
        hashes = _Hashes()
        kinds = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("packed", pa.binary()), ("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])
        low = row = TaskContext.get().partitionId() << 33
        held: dict[int, list[np.ndarray]] = {WORD: [], WINDOW: []}

        def uses(kind: int) -> pa.RecordBatch:
            rows = np.concatenate(held[kind])
            held[kind].clear()
            if kind == WORD:
                parts = list(dealt(rows, bucket_of(rows["word"], buckets), buckets))
            else:
                rows = rows[np.argsort(rows["key"])]
                parts = [(b, packed_uses(low, np.frombuffer(x, WINDOW_USE))) for b, x in dealt(rows, bucket_of(rows["key"], buckets), buckets)]
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in parts], pa.int32()), pa.array([kind] * len(parts), pa.int32()), pa.array([x for _, x in parts], pa.binary()), *(pa.nulls(len(parts), f.type) for f in list(kinds)[3:])], schema=kinds)

        for batch in batches:
            ids = iter(batch.column(0).to_pylist())
            for texts in pieces(batch.column(1).to_pylist(), PIECE):
                own = [next(ids) for _ in texts]
                out_of = np.array([remainder_of(i, DIVISOR) == HELD_OUT for i in own])
                words = [words_of(t) for t in texts]
                sizes = np.array([len(x) for x in words]) + 1
                tokens = token_hashes(words, hashes)
                text = np.repeat(np.arange(len(texts)), sizes)
                at, frequent = place(heavy, tokens)
                known = np.bincount(text[frequent], minlength=len(texts))
                base = np.bincount(text[frequent], logs[at[frequent]] if len(heavy) else None, len(texts))
                rare = np.empty((~frequent).sum(), USE)
                rare["word"], rare["row"], rare["n"], rare["train"] = tokens[~frequent], row + text[~frequent], 1, ~out_of[text[~frequent]]
                held[WORD].append(rare)
                found, lengths = windows(words)
                known_score, rare = split_windows(found, np.repeat(np.arange(len(texts)), lengths), len(texts), common, common_score)
                rare["row"] += np.uint32(row - low)
                held[WINDOW].append(rare)
                rows = np.arange(row, row + len(texts))
                yield pa.RecordBatch.from_arrays([pa.array((rows % buckets).astype(np.int32)), pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary()), pa.array(rows), pa.array(own, pa.int64()), pa.array(out_of), pa.array(sizes.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base.astype(np.float64)), pa.array(known_score)], schema=kinds)
                row += len(texts)
                for kind, parts in held.items():
                    if sum(map(len, parts)) > HELD:
                        yield uses(kind)
        yield from (uses(kind) for kind, parts in held.items() if parts)

    return score


WHOLE = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"
PARTS = f"bucket int, kind int, packed binary, row long, {WHOLE}"
PART = np.dtype([("row", "<i8"), ("n_known", "<i8"), ("base", "<f8"), ("score", "<f8")])


def counted_uses(buckets: int):
    """A function over batches of scored_texts and other_windows that gives the texts' rows as they come, and by bucket of texts what the partition's words and windows add to them."""

    def of_words(rows: np.ndarray) -> np.ndarray:
        words, back = np.unique(rows["word"], return_inverse=True)
        c = np.bincount(back, rows["n"] * rows["train"], len(words))
        texts, at = np.unique(rows["row"], return_inverse=True)
        out = np.zeros(len(texts), PART)
        out["row"] = texts
        out["n_known"] = np.bincount(at, rows["n"] * (c > 0)[back], len(texts))
        out["base"] = np.bincount(at, rows["n"] * np.log10(c + 0.1)[back], len(texts))
        return out

    def of_windows(packed: bytes, scores: dict[str, np.ndarray]) -> np.ndarray:
        low, keys, times, rows = unpacked_uses(packed)
        at, known = place(scores["key"], keys)
        if not known.all():
            raise ValueError("a window without a score")
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        first = firsts(rows)
        out = np.zeros(len(first), PART)
        out["row"], out["score"] = low + rows[first].astype(np.int64), sums(np.repeat(scores["score"][at], times)[order], first)
        return out

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {WORD: [], WINDOW: [], SCORE: []}
        kinds = None
        for batch in batches:
            yield batch.filter(pc.is_valid(batch.column("row")))
            kinds = batch.schema
            for kind, packed in zip(batch.column("kind").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                if packed is not None:
                    held[kind].append(packed)

        def out(parts: list[np.ndarray]) -> pa.RecordBatch:
            rows = np.concatenate(parts)
            full = list(dealt(rows, rows["row"] % buckets, buckets))
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in full], pa.int32()), pa.nulls(len(full), pa.int32()), pa.array([x for _, x in full], pa.binary()), *(pa.nulls(len(full), f.type) for f in list(kinds)[3:])], schema=kinds)

        if held[WORD]:
            yield out([of_words(np.concatenate([np.frombuffer(x, USE) for x in held.pop(WORD)]))])
        scores = np.concatenate([np.empty(0, SCORES), *(np.frombuffer(x, SCORES) for x in held.pop(SCORE))])
        scores = scores[np.argsort(scores["key"])]
        scores = {name: np.ascontiguousarray(scores[name]) for name in ("key", "score")}
        parts: list[np.ndarray] = []
        for packed in held.pop(WINDOW):
            parts.append(of_windows(packed, scores))
            if sum(map(len, parts)) > HELD:
                yield out(parts)
                parts = []
        if parts:
            yield out(parts)

    return counted


def added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a partition's texts with what all words add to them."""
    texts, parts = [], []
    for batch in batches:
        texts.append(batch.filter(pc.is_valid(batch.column("row"))))
        parts += [np.frombuffer(x, PART) for x in batch.column("packed").to_pylist() if x is not None]
    if not texts:
        return
    rows = pa.Table.from_batches(texts).combine_chunks().sort_by("row")
    added = np.concatenate([np.empty(0, PART), *parts])
    at = np.searchsorted(rows["row"].to_numpy(), added["row"])
    known = rows["n_known"].to_numpy() + np.bincount(at, added["n_known"], len(rows)).astype(np.int64)
    base = rows["base"].to_numpy() + np.bincount(at, added["base"], len(rows))
    names = [x.split()[0] for x in WHOLE.split(", ")]
    score = rows["score"].to_numpy() + np.bincount(at, added["score"], len(rows))
    found = {n: rows[n] for n in names} | {"n_known": pa.array(known), "base": pa.array(base), "score": pa.array(score)}
    yield from pa.table(found).to_batches(max_chunksize=100_000)


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each row of docs.

    Both models learn from texts whose crc32(doc_id as text) mod 10 isn't 0; a null doc_id counts as
    an empty text there. Tokens are words after A-Z are lower-cased, and one end; a null or empty
    text is the end only. Scores are decimal logarithms of the probability of a text's tokens. Rows
    that repeat are scored and learned from each time. Without training texts each token has
    probability 1 in the word model and each byte 1/256 in the other. No documents give no rows;
    other columns aren't read; texts are scored whole, in pieces of many texts or one long one. docs
    should be a table or a checkpoint, as texts are numbered by their place when they are read.
    """
    spark = docs.sparkSession
    python_batches(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))  # what a task holds doesn't grow with the input
    buckets = BUCKETS * parts
    gathered = in_arrow(own, training_counts(buckets), "bucket int, kind int, packed binary")
    counts = checkpointed(in_arrow(gathered.repartition(parts, "bucket").select("kind", "packed"), summed_counts, SUMMED))
    sums = {r.kind: r.n for r in counts.filter(F.col("kind").isin(TYPES, TOKENS)).groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    types, tokens = sums.get(TYPES, 0), sums.get(TOKENS, 0)
    frequent = counts.filter((F.col("kind") == WORD) & (F.col("n") >= tokens * SHARE)).select("key", "n").toArrow()
    heavy, heavy_n = frequent["key"].to_numpy().view(np.uint64), frequent["n"].to_numpy()
    order = np.argsort(heavy)
    at_level = counts.filter(F.col("kind") == LEVEL).groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("key")).collect()
    numbers = np.cumsum([r.n for r in at_level])
    least = min((r.key for r, n in zip(at_level, numbers, strict=True) if n <= FREQUENT), default=1 << 30)
    all_windows = counts.filter(F.col("kind") == WINDOW).select("packed")
    short = counts.filter(F.col("kind") == SHORT).groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    short_levels = levels_of(short["key"].to_numpy().astype(np.uint64), short["n"].to_numpy(), range(LOCAL))
    found = np.zeros((2, (ORDER + 1) * CLASSES), np.int64)
    for length, level in enumerate(short_levels):
        found[:, length * CLASSES : (length + 1) * CLASSES] = left_out(level)
    for r in counts.filter(F.col("kind").isin(LEFT_OUT, NEW)).groupBy("kind", "key").agg(F.sum("n").alias("n")).collect():
        found[0 if r.kind == LEFT_OUT else 1, r.key] = r.n
    escapes = escapes_of(*found).reshape(ORDER + 1, CLASSES)
    common = in_arrow(all_windows, frequent_windows(least, escapes), "key long, score double").toArrow().sort_by("key")
    trie = Trie(short_levels, escapes=escapes)
    shared = spark.sparkContext.broadcast((common["key"].to_numpy(), common["score"].to_numpy(), heavy[order], heavy_n[order]))
    others = in_arrow(all_windows, other_windows(spark.sparkContext.broadcast(trie), escapes, least, buckets), "bucket int, kind int, packed binary")
    dealt_out = in_arrow(own, scored_texts(shared, buckets), SCORED).unionByName(others, allowMissingColumns=True).repartition(parts, "bucket")
    summed = in_arrow(in_arrow(dealt_out, counted_uses(buckets), PARTS).repartition(parts, "bucket"), added_up, WHOLE)
    each = float(np.log10(tokens + 0.1 * (types + 1)))
    return summed.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * each).alias("base_score"), "score")


def op6_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document under both models."""
    return scored(table(spark, sf_dir, "documents"))
