"""Text quality by random-indexing word vectors and a small network with calibrated probabilities."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.llm.common import checkpointed, giving_back, in_arrow, pieces, python_batches, remainder, table

#: Components of a vector, neighbours on each side that give a word its vector, and components that each neighbour changes.
DIMS, REACH, MARKS = 64, 2, 2
#: A word that is at least this part of all has a vector of its own (so at most 1 / SHARE words are broadcast);
#: others share one with words of the same shape and the same last bits of their hashes.
SHARE, SHAPE_BITS, REST_BITS = 2.0**-17, 3, 8
SHARED = 1 << SHAPE_BITS + REST_BITS
PIECE, REMEMBERED = 2_000_000, 500_000
#: Rows of contexts that are packed together, and different words that a task counts before it hands them on.
HELD, COUNTED = 40_000, 2_000_000
#: Tokens whose neighbours' marks are summed at once, so that long texts take little more memory.
PLACES = 500_000
#: Parts that the contexts are summed in at most.
SLOTS = 512
#: Characters whose fingerprints are made at once, the longest token that gets one this way, and the number whose powers tell places apart.
WINDOW, LONGEST, FACTOR = 1 << 16, 256, 0x9E3779B97F4A7C15
#: Labelled texts that the network is fitted on at most; the vectors come from all texts.
LABELLED = 20_000
HIDDEN, EPOCHS, PATIENCE, BATCH, RATE, DECAY = 32, 60, 6, 256, 3e-3, 3e-3
#: The parts of the labelled texts that tell when to stop, and that the temperature is calibrated on.
STOPPING, CALIBRATION = 0.15, 0.15
TOKEN = re.compile(r"\w+|[^\w\s]+")
U = np.uint64
CONTEXT = np.dtype([("word", "<u8"), ("uses", "<i8"), ("vector", "<i4", (DIMS,))])


def shape(token: str) -> int:
    """Lower case, capitalised, upper case, digits, one mark, several marks, or a mixture."""
    if token.isalpha():
        return 0 if token.islower() else 2 if token.isupper() and len(token) > 1 else 1
    if token.isdigit():
        return 3
    if not any(c.isalnum() for c in token):
        return 4 if len(token) == 1 else 5
    return 6


def number_of(token: str) -> int:
    """A hash whose last bits are the token's shape."""
    return xxhash.xxh3_64_intdigest(token.encode("utf-8", "replace")) >> SHAPE_BITS << SHAPE_BITS | shape(token)


def spread(values: np.ndarray) -> np.ndarray:
    """Other 64-bit numbers for whole numbers, all bits mixed."""
    values = (values + U(1)) * U(0xBF58476D1CE4E5B9)
    values = (values ^ values >> U(30)) * U(0x94D049BB133111EB)
    return values ^ values >> U(31)


class _Tokens(dict):
    """Numbers of tokens by their fingerprints: sums over characters, each times a power by its place, so that all tokens of a text are found at once."""

    def __init__(self) -> None:
        self.kinds, self.spread = np.zeros(0, np.uint8), np.zeros(0, np.uint64)
        self.powers, self.inverse = (np.multiply.accumulate(np.append(U(1), np.full(WINDOW + LONGEST, f, np.uint64))) for f in (FACTOR, pow(FACTOR, -1, 1 << 64)))

    def __missing__(self, token: str) -> int:
        return number_of(token)

    def know(self, characters: int) -> None:
        """Kinds of so many characters at least, as TOKEN has them: 0 between tokens, 1 in words, 2 in other tokens."""
        if characters > len(self.kinds):
            size = 1 << (characters - 1).bit_length()
            every = "".join(map(chr, range(min(size, 0x110000))))
            self.kinds, self.spread = np.full(len(every), 2, np.uint8), spread(np.arange(len(every), dtype=np.uint64))
            for kind, pattern in ((0, r"\s+"), (1, r"\w+")):
                for found in re.finditer(pattern, every):
                    self.kinds[found.start() : found.end()] = kind

    def fingerprints(self, text: str, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), np.uint64)
        short = np.flatnonzero(ends - starts <= LONGEST)
        for i in np.flatnonzero(ends - starts > LONGEST).tolist():
            out[i] = xxhash.xxh3_64_intdigest(text[starts[i] : ends[i]].encode("utf-8", "replace"))
        cuts = np.searchsorted(starts[short], np.arange(0, len(codes) + WINDOW, WINDOW))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a < b:
                some, at = short[a:b], starts[short[a]]
                place, end = starts[some] - at, ends[some] - at
                sums = np.zeros(end[-1] + 1, np.uint64)
                np.cumsum(self.spread[codes[at : at + end[-1]]] * self.powers[: end[-1]], out=sums[1:])
                out[some] = (sums[end] - sums[place]) * self.inverse[place]
        return out

    def tokens(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, Callable[[int], str]]:
        """The different fingerprints, each token's place in them, how many tokens each text has, and a function of such a place that gives the token."""
        text = "".join(t for t in texts if t)
        bounds = np.cumsum([0, *(len(t) if t else 0 for t in texts)])
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        self.know(int(codes.max(initial=0)) + 1)
        kinds = self.kinds[codes]
        begins = np.append(True, kinds[1:] != kinds[:-1])[: len(codes)]
        begins[bounds[:-1][bounds[:-1] < len(codes)]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(codes))[: len(starts)]
        inside = kinds[starts] > 0
        starts, ends = starts[inside], ends[inside]
        found = pa.array(self.fingerprints(text, codes, starts, ends)).dictionary_encode()
        own, prints = found.indices.to_numpy(), found.dictionary.to_numpy()
        any_of = np.empty(len(prints), np.int64)
        any_of[own] = np.arange(len(own))
        return prints, own, np.diff(np.searchsorted(starts, bounds)), lambda i: text[starts[any_of[i]] : ends[any_of[i]]]

    def numbers(self, prints: np.ndarray, token: Callable[[int], str]) -> np.ndarray:
        """The numbers of what tokens() gives."""
        if len(self) > REMEMBERED:
            self.clear()
        keys = prints.tolist()
        numbers = [self.get(k) for k in keys]
        for i, number in enumerate(numbers):
            if number is None:
                numbers[i] = self[keys[i]] = number_of(token(i))
        return np.fromiter(numbers, np.uint64, len(numbers))


def token_numbers(texts: list[str | None], tokens: _Tokens) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all texts' tokens, and how many each text has."""
    prints, own, counts, token = tokens.tokens(texts)
    return tokens.numbers(prints, token)[own], counts


def contexts_of(numbers: np.ndarray, counts: np.ndarray, names: np.ndarray | None = None) -> np.ndarray:
    """For each different token how often it is there, and the sum of the marks of its neighbours in the same texts.

    Tokens with the same of names, if given, count as one; as neighbours they keep their numbers.
    """
    found = pa.array(numbers if names is None else names).dictionary_encode()
    words, own = found.dictionary.to_numpy(), found.indices.to_numpy()
    out = np.zeros(len(words), CONTEXT)
    out["word"], out["uses"] = words, np.bincount(own, minlength=len(words))
    # Around each text are empty places, which have no marks and whose own sums are left out.
    place = REACH + np.arange(len(own)) + np.repeat(REACH * np.arange(len(counts)), counts)
    size = len(own) + REACH * (len(counts) + 1)
    row = np.full(size, len(words) * DIMS)
    row[place] = own.astype(np.int64) * DIMS
    sums = np.zeros((len(words) + 1) * DIMS)
    for mark in range(MARKS):
        bits = (numbers >> U(8 + 8 * mark)).astype(np.int64)
        at, sign = np.zeros(size, np.int64), np.zeros(size)
        at[place], sign[place] = bits & DIMS - 1, 1.0 - 2.0 * (bits >> 6 & 1)
        for low in range(REACH, size - REACH, PLACES):
            high = min(low + PLACES, size - REACH)
            near = [slice(low + by, high + by) for by in range(-REACH, REACH + 1) if by]
            sums += np.bincount(np.concatenate([row[low:high] + at[x] for x in near]), np.concatenate([sign[x] for x in near]), len(sums))
    out["vector"] = sums[: len(words) * DIMS].reshape(-1, DIMS)
    return out


def added(rows: np.ndarray) -> np.ndarray:
    """The sums of the rows of each word, by words; whole numbers, so that no order of adding changes them."""
    rows = rows[np.argsort(rows["word"], kind="stable")]
    first = np.flatnonzero(np.append(True, rows["word"][1:] != rows["word"][:-1])) if len(rows) else np.zeros(0, np.int64)
    out = rows[first]
    if len(first):
        out["uses"], out["vector"] = np.add.reduceat(rows["uses"], first), np.add.reduceat(rows["vector"], first, axis=0)
    return out


class Sums:
    """Rows of contexts, added up whenever they have doubled."""

    def __init__(self) -> None:
        self.parts: list[np.ndarray] = []
        self.rows = self.summed = 0

    def add(self, rows: np.ndarray) -> None:
        self.parts.append(rows)
        self.rows += len(rows)
        if self.rows > 2 * self.summed + HELD // 4:
            self.parts = [added(np.concatenate(self.parts))]
            self.rows = self.summed = len(self.parts[0])

    def clear(self) -> np.ndarray:
        out = added(np.concatenate([np.zeros(0, CONTEXT), *self.parts]))
        self.__init__()
        return out


def wired(rows: np.ndarray) -> bytes:
    """Rows of contexts as bytes: numbers small whatever their sign, the first bytes of all, then the second ones and so on, compressed.

    The vectors of rare words are mostly zeros, and their other numbers take one byte.
    """
    vector = rows["vector"]
    planes = lambda values: values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()
    raw = rows["word"].tobytes() + planes(rows["uses"].ravel().copy()) + planes((vector << 1 ^ vector >> 31).ravel())
    return len(rows).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unwired(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    raw = np.frombuffer(pa.decompress(packed[8:], n * CONTEXT.itemsize, "zstd", asbytes=True), np.uint8)
    out = np.empty(n, CONTEXT)
    out["word"] = raw[: 8 * n].view(np.uint64)
    out["uses"] = raw[8 * n : 16 * n].reshape(8, -1).T.copy().view(np.int64).ravel()
    vector = raw[16 * n :].reshape(4, -1).T.copy().view(np.uint32).ravel()
    out["vector"] = (vector >> 1 ^ -(vector & 1).astype(np.int64)).astype(np.int32).reshape(n, DIMS)
    return out


def in_slots(rows: np.ndarray, slots: int) -> pa.RecordBatch:
    """Rows by the slot that their words fall in."""
    slot = (rows["word"] >> U(SHAPE_BITS)) % U(slots)
    order = np.argsort(slot, kind="stable")
    rows, slot = rows[order], slot[order]
    cuts = np.append(np.flatnonzero(np.append(True, slot[1:] != slot[:-1])), len(rows)) if len(rows) else np.zeros(1, np.int64)
    return pa.RecordBatch.from_pydict({"slot": pa.array(slot[cuts[:-1]].astype(np.int32)), "packed": pa.array([wired(rows[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for packed in batch.column("packed").to_pylist():
            yield unwired(packed)


def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[str | None]]:
    return pieces((text for batch in batches for text in batch.column(0).to_pylist()), PIECE)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, uses: the tokens of texts by their fingerprints; a word comes once, or again when a task has very many."""
    tokens = _Tokens()
    parts, rows, kept = [], 0, 0
    once = lambda: pa.concat_tables(parts).group_by("word", use_threads=False).aggregate([("uses", "sum")]).rename_columns(["word", "uses"])
    for texts in texts_of(batches):
        prints, own, _, _ = tokens.tokens(texts)
        parts.append(pa.table({"word": prints.view(np.int64), "uses": np.bincount(own, minlength=len(prints)).astype(np.int64)}))
        rows += len(prints)
        if rows > 2 * kept + HELD:
            parts = [once()]
            rows = kept = len(parts[0])
        if kept > COUNTED:
            yield from parts[0].to_batches(HELD)
            parts, rows, kept = [], 0, 0
    if parts:
        yield from once().to_batches(HELD)


def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, uses: the words that are at least SHARE of a partition's tokens so far, so all that are of all tokens; and a row without a word for its tokens."""
    total = 0
    for batch in batches:
        uses = batch.column("uses").to_numpy()
        total += int(uses.sum())
        yield batch.filter(pa.array(uses >= total * SHARE))
    yield pa.RecordBatch.from_pydict({"word": pa.array([None], pa.int64()), "uses": pa.array([total], pa.int64())})


def contexts(own: Callable[[], np.ndarray], slots: int) -> Callable:
    """A function over batches of texts that gives, by slot, the contexts of words with own()'s fingerprints, and of others by the vector that they share."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, sums, frequent = _Tokens(), Sums(), own()
        for texts in texts_of(batches):
            prints, at, counts, token = tokens.tokens(texts)
            words = tokens.numbers(prints, token)
            names = np.where(among(frequent, prints)[0] & (words >= SHARED), words, rest_of(words))
            sums.add(contexts_of(words[at], counts, names[at]))
        yield in_slots(sums.clear(), slots)

    return of


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """packed: the sums of a partition's words."""
    sums = Sums()
    for rows in unpacked(batches):
        sums.add(rows)
    rows = sums.clear()
    for at in range(0, len(rows), HELD):
        yield pa.RecordBatch.from_pydict({"packed": pa.array([wired(rows[at : at + HELD])], pa.binary())})


def rest_of(words: np.ndarray) -> np.ndarray:
    """The vector that words without one of their own share, as a number below SHARED."""
    return words & U(SHARED - 1)


def among(some: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the values are among some, which are in order, and where."""
    at = np.minimum(np.searchsorted(some, values), max(len(some) - 1, 0))
    return some[at] == values if len(some) else np.zeros(len(values), bool), at


@dataclass
class Vectors:
    """The numbers of the words with vectors of their own in order, and all vectors: theirs, then those that others share."""

    words: np.ndarray
    rows: np.ndarray

    def of(self, numbers: np.ndarray) -> np.ndarray:
        """The vector of each number, as a row."""
        own, at = among(self.words, numbers)
        return np.where(own, at, len(self.words) + rest_of(numbers).astype(np.int64))


def frequent_words(docs: DataFrame) -> tuple[np.ndarray, int]:
    """The fingerprints of the words with vectors of their own in order, and how many tokens there are."""
    uses = in_arrow(docs.select("text"), counted, "word long, uses long").groupBy("word").agg(F.sum("uses").alias("uses"))
    parts = checkpointed(in_arrow(uses, candidates, "word long, uses long"))
    total = parts.filter("word is null").agg(F.sum("uses")).first()[0] or 0
    own = parts.filter("word is not null").filter(F.col("uses") >= total * SHARE).select("word").toArrow()["word"].to_numpy()
    return np.sort(own.astype(np.int64).view(np.uint64)), total


def word_vectors(docs: DataFrame) -> Vectors:
    """A vector for each word, from all texts: the direction of its contexts beside that of all contexts.

    Texts are read twice: words are counted before their contexts are summed, so that those of rare words never leave a task one by one.
    """
    spark = docs.sparkSession
    python_batches(spark)
    frequent, total = frequent_words(docs)
    shared = spark.sparkContext.broadcast(frequent)
    slots = min(SLOTS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = in_arrow(docs.select("text"), contexts(lambda: shared.value, slots), "slot int, packed binary").repartition("slot")
    sums = added(np.concatenate([np.zeros(0, CONTEXT), *unpacked(in_arrow(dealt, summed, "packed binary").toArrow().to_batches())]))
    rest = sums["word"] < SHARED
    words = sums["word"][~rest]
    every = np.zeros(len(words) + SHARED, CONTEXT)
    every[: len(words)] = sums[~rest]
    every[len(words) + sums["word"][rest].astype(np.int64)] = sums[rest]
    usual = every["vector"].sum(axis=0) / max(total, 1)
    mean = every["vector"] / np.maximum(every["uses"], 1)[:, None] - np.where(every["uses"] > 0, 1, 0)[:, None] * usual
    return Vectors(words, (mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-9)).astype(np.float32))


#: Different words of texts whose vectors are summed at once.
BLOCK = 1024
FEATURES = 2 * DIMS + 3 + (1 << SHAPE_BITS)


def pooled(texts: list[str | None], tokens: _Tokens, vectors: Vectors) -> np.ndarray:
    """For each text the mean and deviation of its words' vectors, its length, and how its words and their shapes vary and repeat."""
    prints, own, counts, token = tokens.tokens(texts)
    words, places = np.unique(tokens.numbers(prints, token), return_inverse=True)
    number = places[own]
    out = np.zeros((len(texts), FEATURES), np.float32)
    full = np.flatnonzero(counts)
    if len(full):
        n = counts[full, None].astype(np.float32)
        text = np.repeat(np.arange(len(full)), counts[full])
        # Each word of a text once, in the order of numbers, so that a text's sums don't depend on its neighbours.
        each = np.sort(text * len(words) + number)
        first = np.flatnonzero(np.append(True, each[1:] != each[:-1]))
        uses, each = np.diff(np.append(first, len(each))).astype(np.float32), each[first]
        of, word = np.divmod(each, len(words))
        different = np.bincount(of, minlength=len(full))
        starts, rows = np.append(0, np.cumsum(different)), vectors.of(words)[word]
        mean, square = np.zeros((2, len(full), DIMS), np.float32)
        at = 0
        while at < len(full):
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + BLOCK, "right")) - 1)
            own, times = vectors.rows[rows[starts[at] : starts[to]]], uses[starts[at] : starts[to], None]
            once = own * times
            mean[at:to] = np.add.reduceat(once, starts[at:to] - starts[at], axis=0)
            once *= own
            square[at:to] = np.add.reduceat(once, starts[at:to] - starts[at], axis=0)
            at = to
        mean, square = mean / n, square / n
        shapes = np.bincount(of << SHAPE_BITS | (words & U((1 << SHAPE_BITS) - 1)).astype(np.int64)[word], uses, len(full) << SHAPE_BITS).reshape(len(full), -1)
        varied = different[:, None] / n
        repeats = np.bincount(text[1:][(number[1:] == number[:-1]) & (text[1:] == text[:-1])], minlength=len(full))[:, None] / n
        out[full] = np.hstack([mean, np.sqrt(np.maximum(square - mean * mean, 0)), np.log1p(n), varied, repeats, shapes / n])
    return out


@dataclass
class Network:
    """Two layers on scaled inputs, and the temperature that divides their output."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def constant(size: int, positive: float) -> Network:
    """Gives every text the same score."""
    p = min(max(positive, 0.01), 0.99)
    return Network(np.zeros(size), np.ones(size), np.zeros((size, 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))))


def loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Network:
    """Adam on the logistic loss of most rows until that of a second part no longer falls; a third part gives the best temperature.

    A constant if a label is missing or rows are few.
    """
    if len(y) < 20 or y.min() == y.max():
        return constant(x.shape[1], float(y.mean()) if len(y) else 0.5)
    draw = np.random.default_rng(seed)
    order = draw.permutation(len(y))
    later, stopping, now = np.split(order, np.cumsum([max(1, int(part * len(y))) for part in (CALIBRATION, STOPPING)]))
    net = Network(x[now].mean(axis=0), x[now].std(axis=0) + 1e-3, draw.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, 0.3 * HIDDEN**-0.5, HIDDEN), 0.0)
    z, names = (x - net.mean) / net.scale, ("w1", "b1", "w2", "b2")
    first, second = ({k: np.zeros_like(getattr(net, k)) for k in names} for _ in range(2))
    steps, worse, least, best = 0, 0, np.inf, {}
    for _ in range(EPOCHS):
        for at in np.array_split(draw.permutation(now), max(1, len(now) // BATCH)):
            hidden = np.tanh(z[at] @ net.w1 + net.b1)
            error = (1 / (1 + np.exp(-np.clip(hidden @ net.w2 + net.b2, -40, 40))) - y[at]) / len(at)
            back = np.outer(error, net.w2) * (1 - hidden * hidden)
            step = {"w1": z[at].T @ back + DECAY * net.w1, "b1": back.sum(axis=0), "w2": hidden.T @ error + DECAY * net.w2, "b2": error.sum()}
            steps += 1
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * step[k]
                second[k] = 0.999 * second[k] + 0.001 * step[k] ** 2
                setattr(net, k, getattr(net, k) - RATE * first[k] / (1 - 0.9**steps) / (np.sqrt(second[k] / (1 - 0.999**steps)) + 1e-8))
        now_lost = loss(net.logits(x[stopping]), y[stopping])
        worse = 0 if now_lost < least else worse + 1
        if not worse:
            least, best = now_lost, {k: np.copy(getattr(net, k)) for k in names}
        if worse == PATIENCE:
            break
    for k, value in best.items():
        setattr(net, k, value)
    logits = net.logits(x[later])
    net.temperature = float(min(np.geomspace(0.25, 8, 101), key=lambda t: loss(logits / t, y[later])))
    return net


def pooling(spark: SparkSession, vectors: Vectors) -> Callable:
    """A function of a text column that gives its pooled vector."""
    shared = spark.sparkContext.broadcast((vectors.words, vectors.rows))

    def pool(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens, words = _Tokens(), Vectors(*shared.value)
        for batch in batches:
            parts = [pooled(texts, tokens, words) for texts in pieces(batch.to_pylist(), PIECE)]
            yield pa.array([row for part in parts for row in part], pa.list_(pa.float32()))

    return F.arrow_udf(giving_back(pool), "array<float>")


def scoring(spark: SparkSession, vectors: Vectors, net: Network) -> Callable:
    """A function of a text column that gives its score."""
    shared = spark.sparkContext.broadcast(((vectors.words, vectors.rows), tuple(vars(net).values())))

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words, own = Vectors(*shared.value[0]), Network(*shared.value[1])
        tokens = _Tokens()
        for batch in batches:
            parts = [own.scores(pooled(texts, tokens, words)) for texts in pieces(batch.to_pylist(), PIECE)]
            yield pa.array(np.concatenate([np.zeros(0), *parts]), pa.float64())

    return F.arrow_udf(giving_back(score), "double")


def learn(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> tuple[Vectors, Network]:
    """Word vectors from all texts of docs, and the network from those that labels (doc_id, quality) has.

    At most `most` labelled ids take part: those with the smallest hashes. Labels other than 0
    and 1, null ids and ids with different labels are left out. With fewer than 20 labelled texts,
    or one label only, every text gets the same score.
    """
    vectors = word_vectors(docs)
    one = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
    sample = one.filter("quality = other").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(F.col("doc_id").alias("_id"), "quality")
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("doc_id", F.xxhash64("text").alias("text_hash"), "quality", pooling(docs.sparkSession, vectors)(F.col("text")).alias("x"))
    found = rows.toArrow().sort_by([("doc_id", "ascending"), ("text_hash", "ascending")])
    return vectors, fit(found["x"].combine_chunks().flatten().to_numpy().reshape(-1, FEATURES).astype(np.float64), found["quality"].to_numpy().astype(np.float64))


def scored(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 is likelier), one row for each row of docs.

    Texts are pooled whole. A null or empty text is pooled to zeros and scored like others; rows
    that repeat get the same score; no documents give no rows; without labels of both kinds every
    score is the same. No other column of docs is read.
    """
    vectors, net = learn(docs, labels, most)
    return docs.select("doc_id", scoring(docs.sparkSession, vectors, net)(F.col("text")).alias("score"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from two thirds of the labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder("doc_id", 3) == 1
    found = scored(docs, table(spark, sf_dir, "labels").filter(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
