"""Near duplicates by the Jaccard similarity of word n-grams, with adaptive prefixes.

A text's set holds its distinct 5-word shingles. Texts with equal sets form a class, and one of
each class goes on. All sets are put in one order, rare shingles first. If two sets overlap in t,
the first |x| - t + l of each share at least l: so a set is found by l shared tokens of a prefix of
that length, and each set takes the l that makes its own search cheapest, a small part of its size
at least. Pairs that share as many tokens as the prefixes' lengths demand are verified on whole sets.

What many texts share is spared the search: of l tokens that two sets share in their prefixes, the
rarest one is never among the l - 1 most frequent ones of either. So each set leaves out about as
many of its prefix's most frequent tokens, by how many classes really have them, and passages that
thousands of texts share make no pairs.

Near copies come in groups of thousands, whose pairs must not all be made. Components only need
enough links to hold together, so every class is first verified against a few others that its
tokens draw, and then the pairs between components that are still apart are made: all of them,
so that no link between components is lost. Of those, bitmaps of the sets rule out most before
whole sets are moved.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyworks.llm.common import checkpointed, giving_back, in_arrow, pieces, python_batches, table
from tallyworks.operators.graph import components

WORDS = 5
#: Texts link when NUMERATOR * intersection >= ... of DENOMINATOR: at 75 of 100.
NUMERATOR, DENOMINATOR = 75, 100
#: Buckets of the sketch of shingle frequencies, and the rows in which a partition hands on its part.
SKETCH_BITS, SLICES = 22, 16
#: Codes for each doubling of a frequency, and the frequencies that codes stand for.
STEPS = 8
LEVELS = (2 ** (np.arange(256) / STEPS) - 1).astype(np.float32)
#: A set asks for this part of its shingles as shared tokens, and for so many MORE. Still more would lengthen
#: prefixes of copies that differ in many words into what all of them share, which makes all their pairs.
PART, MORE = 16, (1, 2, 3)
#: How many of the tokens that a pair must share are left for the search, the rarest ones.
LEFT = 1
#: Verifying a pair costs as much as reading this part of a set's postings.
VERIFY = 1 / 16
#: Shingles that are this much more frequent than their bucket's share skip the search for shared ones.
HOT = 200
#: Bytes of tokens that a task looks through at once, and tokens that it gathers before it deals them out.
TASK_BYTES, GATHERED = 8_000_000, 150_000
#: Bits of the filter of classes whose sets are needed.
FILTER_BITS = 24
#: Bits of a set's bitmap for each shingle, rounded up to a power of two in all.
BITMAP_BITS = 4
#: Other classes that each class is verified against first; the last step is exact however many there are.
TURNS = 3
#: Characters whose shingles are made at once.
PIECE = 250_000

U = np.uint64


#: Shingles are hashed as polynomials in FACTOR over a number for each byte, modulo 2**64.
FACTOR = 0x9E3779B97F4A7C15
LETTERS = np.random.default_rng(5).integers(0, 2**64, 256, np.uint64)


class Shingler:
    """Sets of shingles as sorted arrays of 64-bit hashes."""

    def __init__(self) -> None:
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, size: int) -> None:
        if len(self.powers) < size:
            self.powers, self.inverses = (np.cumprod(np.append(np.ones(1, np.uint64), np.full(size, x, np.uint64))) for x in (FACTOR, pow(FACTOR, -1, 2**64)))

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """For each text the hashes of its 5-word shingles; of all words if there are fewer, and none without words."""
        raw = [b" ".join((t or "").encode("utf-8", "replace").lower().split()) for t in texts]
        b = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        self._grow(len(b))
        sums = np.append(np.zeros(1, np.uint64), np.cumsum(LETTERS[b] * self.powers[: len(b)]))
        ends = np.flatnonzero((b == 32) | (b == 10))
        starts = np.append(0, ends[:-1] + 1)
        closes = b[ends] == 10
        text = np.cumsum(closes) - closes
        real = ends > starts
        starts, ends, text = starts[real], ends[real], text[real]

        def hashed(first: np.ndarray, last: np.ndarray) -> np.ndarray:
            h = (sums[last] - sums[first]) * self.inverses[first]
            h ^= h >> U(30)
            h *= U(0xBF58476D1CE4E5B9)
            return h ^ h >> U(31)

        counts = np.bincount(text, minlength=len(texts))
        n = len(starts) - WORDS + 1
        whole = np.flatnonzero(text[:n] == text[WORDS - 1 :]) if n > 0 else np.zeros(0, int)
        shingles = hashed(starts[whole], ends[whole + WORDS - 1])
        cuts = np.append(0, np.cumsum(np.maximum(counts - WORDS + 1, 0)))
        firsts = np.append(0, np.cumsum(counts))
        out = []
        for i in range(len(texts)):
            if 0 < counts[i] < WORDS:
                out.append(~hashed(starts[firsts[i] : firsts[i] + 1], ends[firsts[i + 1] - 1 : firsts[i + 1]]))
            else:
                out.append(distinct(shingles[cuts[i] : cuts[i + 1]]))
        return out


def sets_of(shingler: Shingler, texts: list[str | None]) -> Iterator[np.ndarray]:
    for part in pieces(texts, PIECE):
        yield from shingler(part)


def distinct(values: np.ndarray) -> np.ndarray:
    """The different values, in order."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def class_of(shingles: np.ndarray) -> int:
    """A signed 64-bit number that stands for the set."""
    return int(np.array(xxhash.xxh3_64_intdigest(shingles.tobytes(), seed=len(shingles)), np.uint64).view(np.int64))


def _record(schema: str, **columns) -> pa.RecordBatch:
    """A batch with the columns of a Spark schema; those not given are null."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names = [x.split() for x in schema.split(", ")]
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_pydict({n: pa.array(columns[n], kinds[k]) if n in columns else pa.nulls(size, kinds[k]) for n, k in names})


SIZES = "doc_id long, n long, cls long, slice int, counts binary"


def sizes_and_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's set size and class, and the partition's counts of shingles by bucket, in slices."""
    shingles_of = Shingler()
    sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
    for batch in batches:
        sizes, classes = [], []
        for texts in pieces(batch.column(1).to_pylist(), PIECE):
            sets = shingles_of(texts)
            sizes += map(len, sets)
            classes += [class_of(own) if len(own) else None for own in sets]
            np.add.at(sketch, np.concatenate(sets) >> U(64 - SKETCH_BITS), np.uint32(1))
        yield _record(SIZES, doc_id=batch.column(0), n=sizes, cls=classes)
    parts = np.split(sketch, SLICES)
    used = [i for i in range(SLICES) if parts[i].any()]
    yield _record(SIZES, slice=used, counts=[zlib.compress(parts[i].tobytes(), 1) for i in used])


def frequency_codes(counts: np.ndarray) -> np.ndarray:
    """By how much the counts of buckets exceed what chance explains, as a byte that LEVELS turns into numbers.

    It estimates how often a frequent shingle is there. The median of a slice stands for chance: hashes deal
    shingles to slices alike.
    """
    usual = float(np.median(counts))
    excess = np.where(counts > usual + 4 * math.sqrt(usual) + 1, counts - usual, 0.0)
    return np.minimum(np.rint(STEPS * np.log2(1 + excess)), 255).astype(np.uint8)


def sum_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The codes of a partition's slices, of their sums; each slice is in one partition."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts = np.frombuffer(zlib.decompress(raw), np.uint32)
            sums[i] = sums[i] + counts if i in sums else counts.astype(np.int64)
    yield _record("slice int, codes binary", slice=list(sums), codes=[frequency_codes(x).tobytes() for x in sums.values()])


def spare(n: int) -> int:
    """How many shared tokens a set of that size asks for before those that it searches for."""
    return n // PART


def spared(n: Column) -> Column:
    """How many of its most frequent tokens a set needs with no set that it may link with: the smallest of those asks for this many and MORE."""
    return F.greatest(F.floor(F.floor((n * NUMERATOR + DENOMINATOR - 1) / DENOMINATOR) / PART) + MORE[0] - MORE[-1], F.lit(0))


def least_overlap(n: int) -> int:
    """The smallest overlap of a set of that size with any that it links with."""
    return -(-NUMERATOR * n // DENOMINATOR)


def excess_of(codes: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """How much more frequent the shingles are than chance explains."""
    return LEVELS[codes[(shingles >> U(64 - SKETCH_BITS)).astype(np.int64)]]


def prefix_of(shingles: np.ndarray, expected: np.ndarray) -> tuple[np.ndarray, int]:
    """The prefix of a set, and how many of its tokens a partner must share.

    The order is by the power of two of the estimated frequency, then by hash. With l matches the
    postings of what the set doesn't leave out are read, and about a part 1 / l of them, without
    those left out, become pairs to verify.
    """
    order = np.lexsort((shingles, np.ceil(np.log2(expected + 1))))
    n = len(shingles)
    need = least_overlap(n)
    read = np.cumsum(expected[order])
    choices = sorted({min(spare(n) + more, need) for more in MORE})
    lengths = [n - need + m for m in choices]
    costs = [length + read[length - max(m - MORE[-1], 0) - 1] * (1 + VERIFY * n / min(m, MORE[-1])) for m, length in zip(choices, lengths, strict=True)]
    best = int(np.argmin(costs))
    return shingles[order[: lengths[best]]], choices[best]


TOKENS = "bucket int, packed binary, token long, cls long, n long, matches int, place int"
PACKED = np.dtype([("token", "<u8"), ("cls", "<i8"), ("n", "<u4"), ("matches", "<u4"), ("place", "<u4")])


def tokens_of(codes: np.ndarray, buckets: int):
    """A function over batches of texts that gives their prefix tokens, dealt to buckets; hot ones as rows."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles_of = Shingler()
        seen: set[int] = set()
        held: list[np.ndarray] = []

        def dealt() -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(held)
            held.clear()
            hot = excess_of(codes, rows["token"]) > HOT
            if hot.any():
                some = rows[hot]
                spread = (some["cls"] % buckets).astype(np.int32)
                yield _record(TOKENS, bucket=spread, **posting_columns(some))
            rows = rows[~hot]
            bucket = (rows["token"] % U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            rows, bucket = rows[order], bucket[order]
            if len(rows):
                cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(rows))
                yield _record(TOKENS, bucket=bucket[cuts[:-1]].astype(np.int32), packed=[rows[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)])

        for batch in batches:
            for own in sets_of(shingles_of, batch.column(0).to_pylist()):
                if not len(own) or (cls := class_of(own)) in seen:
                    continue
                seen.add(cls)
                prefix, matches = prefix_of(own, excess_of(codes, own))
                rows = np.empty(len(prefix), PACKED)
                rows["token"], rows["cls"], rows["n"], rows["matches"], rows["place"] = prefix, cls, len(own), matches, np.arange(len(prefix))
                held.append(rows)
                if sum(map(len, held)) > GATHERED:
                    yield from dealt()
        if held:
            yield from dealt()

    return tokens


POSTINGS = "token long, cls long, n long, matches int, place int, classes int"
#: Stands for the number of classes of hot tokens, which no task sees as a whole.
MANY = 2**31 - 1


def posting_columns(rows: np.ndarray) -> dict:
    return {"token": rows["token"].copy().view(np.int64), "cls": rows["cls"], "n": rows["n"].astype(np.int64), "matches": rows["matches"].astype(np.int32), "place": rows["place"].astype(np.int32)}


def shared_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tokens of a partition that more than one class has, a row for each class, with the number of classes; hot tokens as they come."""
    parts = []
    for batch in batches:
        packed = pc.is_valid(batch.column(0))
        parts += [np.frombuffer(x, PACKED) for x in batch.column(0).filter(packed).to_pylist()]
        hot = batch.filter(pc.invert(packed)).drop_columns(["packed"])
        yield hot.append_column("classes", pa.array(np.full(len(hot), MANY, np.int32)))
    if not parts:
        return
    rows = np.concatenate(parts)
    rows = rows[np.lexsort((rows["cls"], rows["token"]))]
    new = np.append(True, (rows["token"][1:] != rows["token"][:-1]) | (rows["cls"][1:] != rows["cls"][:-1]))
    rows = rows[new]
    first = np.append(True, rows["token"][1:] != rows["token"][:-1])
    runs = np.diff(np.append(np.flatnonzero(first), len(rows)))
    classes = np.repeat(runs, runs).astype(np.int32)
    rows, classes = rows[classes > 1], classes[classes > 1]
    for at in range(0, len(rows), 100_000):
        yield _record(POSTINGS, **posting_columns(rows[at : at + 100_000]), classes=classes[at : at + 100_000])


def searched(postings: DataFrame) -> DataFrame:
    """The postings with the rank of each token in its set, the most frequent first, without those that the set needs with no other."""
    order = Window.partitionBy("cls").orderBy(F.desc("classes"), F.desc("token"))
    ranked = postings.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") > spared(F.col("n")))
    return ranked.drop("classes")


def filter_slots(cls) -> list:
    """Two positions of a class in the filter, from different bits of its number."""
    mask = (1 << FILTER_BITS) - 1
    return [F.shiftrightunsigned(cls, 0).bitwiseAND(F.lit(mask)), F.shiftrightunsigned(cls, FILTER_BITS).bitwiseAND(F.lit(mask))]


def class_filter(classes: DataFrame) -> np.ndarray:
    """A Bloom filter of classes: its words of 64 bits are made by Spark, and 2 MB come to the driver."""
    bit = classes.select(F.explode(F.array(*filter_slots(F.col("cls")))).alias("bit"))
    words = bit.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def whole(own: np.ndarray) -> bytes:
    return own.tobytes()


def bitmap(own: np.ndarray) -> bytes:
    """A set's size, and a bit for each of its shingles at their hashes' low bits; an eighth of the set or less."""
    width = max(64, 1 << (BITMAP_BITS * len(own) - 1).bit_length())
    bits = np.zeros(width, bool)
    bits[(own & U(width - 1)).astype(np.int64)] = True
    return len(own).to_bytes(8, "little") + np.packbits(bits, bitorder="little").tobytes()


def may_link(own: bytes, other: bytes) -> bool:
    """False only if two sets can't link: each bit that one bitmap lacks is at least a shingle that its set lacks."""
    sizes = [int.from_bytes(x[:8], "little") for x in (own, other)]
    maps = [np.frombuffer(x, np.uint64, offset=8) for x in (own, other)]
    width = min(map(len, maps))
    x, y = (np.bitwise_or.reduce(m.reshape(-1, width), axis=0) for m in maps)
    most = min(n - int(np.bitwise_count(lacks).sum()) for n, lacks in zip(sizes, (x & ~y, y & ~x), strict=True))
    return (NUMERATOR + DENOMINATOR) * most >= NUMERATOR * sum(sizes)


def similar(own: bytes, other: bytes) -> bool:
    """Whether two whole sets link."""
    x, y = np.frombuffer(own, np.uint64), np.frombuffer(other, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return DENOMINATOR * both >= NUMERATOR * (len(x) + len(y) - both)


def needed_sets(words: np.ndarray, form: Callable[[np.ndarray], bytes]):
    """A function over batches of texts that gives cls and set, in this form, of those that the filter holds."""

    def there(cls: int) -> bool:
        mask = (1 << FILTER_BITS) - 1
        return all(int(words[slot >> 6]) >> (slot & 63) & 1 for slot in (cls & mask, cls >> FILTER_BITS & mask))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles_of = Shingler()
        seen: set[int] = set()
        for batch in batches:
            found = []
            for own in sets_of(shingles_of, batch.column(0).to_pylist()):
                if len(own) and (cls := class_of(own)) not in seen and there(cls):
                    seen.add(cls)
                    found.append((cls, form(own)))
            if found:
                yield _record("cls long, members binary", cls=[x[0] for x in found], members=[x[1] for x in found])

    return sets


def chosen(test: Callable[[bytes, bytes], bool]):
    """A function over batches of a, b and their sets that gives a and b of the pairs that pass the test."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passed = [(a, b) for a, b, own, other in zip(*(c.to_pylist() for c in batch.columns), strict=True) if test(own, other)]
            yield _record("a long, b long", a=[x[0] for x in passed], b=[x[1] for x in passed])

    return pairs


def apart(postings: DataFrame, links: DataFrame | None) -> DataFrame:
    """The postings with their class's component, of tokens whose classes are in more than one."""
    if links is None:
        labelled = postings.withColumn("component", F.col("cls"))
    else:
        labels = components(links).select(F.col("node").alias("cls"), "component")
        labelled = postings.drop("component").join(labels, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    several = labelled.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("token")
    return checkpointed(labelled.join(several, "token", "left_semi"))


def overlap_of(n: Column, n2: Column) -> Column:
    """What two sets of these sizes must share at least to link."""
    return F.floor(((n + n2) * NUMERATOR + NUMERATOR + DENOMINATOR - 1) / (NUMERATOR + DENOMINATOR))


def must_share(a: Column, b: Column) -> Column:
    """How many tokens of their prefixes two sets that link share at least.

    Of what they share, as many as a set has tokens beyond its prefix may lie there.
    """
    t = overlap_of(a["n"], b["n"])
    need = lambda n: F.floor((n * NUMERATOR + DENOMINATOR - 1) / DENOMINATOR)
    return F.least(t - need(a["n"]) + a["matches"], t - need(b["n"]) + b["matches"])


def must_meet(a: Column, b: Column) -> Column:
    """How many of those are left at least when both leave out all but so many of them, the most frequent ones."""
    return F.least(must_share(a, b), F.lit(LEFT))


def meet(a: Column, b: Column) -> Column:
    """Whether a token that two sets share is not among the most frequent ones that this pair leaves out.

    Of m tokens that are shared, the rarest k are never among the m - k most frequent ones of
    either prefix, as the other shared ones are above them in both.
    """
    close = F.least(a["n"], b["n"]) * DENOMINATOR >= F.greatest(a["n"], b["n"]) * NUMERATOR
    out = must_share(a, b) - must_meet(a, b)
    return close & (a["rank"] > out) & (b["rank"] > out)


def packed(*more: str) -> Column:
    return F.struct("cls", "n", "matches", "place", "rank", *more)


def star_pairs(postings: DataFrame, turn: int) -> DataFrame:
    """For each class the one, among the classes that its tokens have drawn for this turn, with which it shares most of them.

    In the first turn a token draws the class in whose order it comes first: that has the fewest
    tokens of its own, as what others were copied from. As not every token has drawn the same
    class, half of what the two must share is enough here.
    """
    draw = F.col("place") / F.col("n") if turn == 0 else F.xxhash64("cls", F.lit(turn)).cast("double")
    drawn = postings.groupBy("token").agg(F.min(F.struct(draw.alias("draw"), packed().alias("row"))).alias("first")).select("token", F.col("first.row").alias("hub"))
    met = postings.select("token", packed().alias("own")).join(drawn, "token").filter((F.col("own.cls") != F.col("hub.cls")) & meet(F.col("own"), F.col("hub")))
    counts = met.groupBy("own.cls", F.col("hub.cls").alias("other")).agg(F.count(F.lit(1)).alias("shared"), F.first(must_meet(F.col("own"), F.col("hub"))).alias("least"))
    best = counts.filter("2 * shared >= least").groupBy("cls").agg(F.max(F.struct("shared", "other")).alias("best"))
    return best.select(F.least("cls", "best.other").alias("a"), F.greatest("cls", "best.other").alias("b"))


def rest_pairs(postings: DataFrame) -> DataFrame:
    """All pairs of classes in different components that share enough tokens."""
    own, other = (postings.select("token", packed("component").alias(name)) for name in ("own", "other"))
    different = (F.col("own.cls") < F.col("other.cls")) & (F.col("own.component") != F.col("other.component"))
    met = own.join(other, (own["token"] == other["token"]) & different & meet(F.col("own"), F.col("other")))
    counts = met.groupBy(F.col("own.cls").alias("a"), F.col("other.cls").alias("b")).agg(F.count(F.lit(1)).alias("shared"), F.first(must_meet(F.col("own"), F.col("other"))).alias("least"))
    return counts.filter("shared >= least").select("a", "b")


def passing(texts: DataFrame, pairs: DataFrame, form: Callable[[np.ndarray], bytes], test: Callable[[bytes, bytes], bool]) -> DataFrame:
    """The pairs (a, b) that pass the test on the sets of the classes that they name, in this form."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("cls"))
    sets = in_arrow(texts, needed_sets(class_filter(named), form), "cls long, members binary").dropDuplicates(["cls"])
    own = sets.select(F.col("cls").alias("a"), F.col("members").alias("own"))
    other = sets.select(F.col("cls").alias("b"), F.col("members").alias("other"))
    both = pairs.select("a", "b").join(own, "a").join(other, "b").select("a", "b", "own", "other")
    return checkpointed(in_arrow(both, chosen(test), "a long, b long"))


def class_links(docs: DataFrame, total: int, codes: np.ndarray) -> DataFrame | None:
    """Links (a, b) between classes that hold together the components of all links; None if no token is shared."""
    texts = docs.select("text")
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(0.3 * total * PACKED.itemsize / TASK_BYTES))
    tokens = in_arrow(texts, tokens_of(codes, buckets), TOKENS)
    postings = apart(searched(in_arrow(tokens.repartition(buckets, "bucket").drop("bucket"), shared_tokens, POSTINGS).distinct()), None)
    if not postings.limit(1).count():
        return None
    stars = reduce(DataFrame.unionByName, [star_pairs(postings, turn) for turn in range(TURNS)]).distinct()
    links = passing(texts, checkpointed(stars), whole, similar)
    rest = passing(texts, checkpointed(rest_pairs(apart(postings, links))), bitmap, may_link)
    return links.unionByName(passing(texts, rest, whole, similar))


def linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, n and cls of each row of docs, and component and least (its smallest doc_id) of each class."""
    python_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = checkpointed(in_arrow(own, sizes_and_sketch, SIZES))
    members = first.filter("slice is null").select("doc_id", "n", "cls")
    total = members.agg(F.sum("n")).first()[0] or 0
    codes = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), np.uint8)
    slices = first.filter("slice is not null").select("slice", "counts").repartition(SLICES, "slice")
    for row in in_arrow(slices, sum_slices, "slice int, codes binary").collect():
        codes[row["slice"]] = np.frombuffer(row["codes"], np.uint8)
    classes = members.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least")).withColumn("component", F.col("cls"))
    links = class_links(own, total, codes.ravel())
    if links is not None:
        labels = components(links).select(F.col("node").alias("cls"), "component")
        labelled = checkpointed(classes.drop("component").join(labels, "cls", "left").withColumn("component", F.coalesce("component", "cls")))
        classes = labelled.drop("least").join(labelled.groupBy("component").agg(F.min("least").alias("least")), "component")
    return members, classes


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach), one row for each row of docs.

    A null or empty text, or one of white space only, has no shingles and links with nothing: it is
    its own component. Rows that share a doc_id are one document with several sets. A null doc_id
    gives a row with a null component unless the text links. Texts are compared whole, however long;
    no documents give no rows; other columns aren't read. Shingles and sets stand as 64-bit hashes.
    """
    members, classes = linked(docs)
    found = members.filter("n > 0").join(classes, "cls").select("doc_id", F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))
    return found.unionByName(members.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def classes_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The class of each text; null without words."""
    shingles_of = Shingler()
    for batch in batches:
        yield pa.array([class_of(own) if len(own) else None for own in sets_of(shingles_of, batch.to_pylist())], pa.int64())


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that are the first of their component, and all rows without shingles.

    First is the row with the smallest doc_id, a null last; of rows alike in this the one with the
    smallest class, and of rows alike in both any one.
    """
    members, classes = linked(docs)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "cls")
    rows = members.filter("n > 0").join(classes.select("cls", "component"), "cls")
    kept = rows.groupBy("component").agg(F.min(order).alias("best")).select(F.col("best.cls").alias("_cls"), F.col("best.no_id").alias("_no_id"), F.col("best.id").alias("_id"))
    own_class = F.arrow_udf(giving_back(classes_of), "long")(F.col("text"))
    own = docs.select(F.struct("*").alias("row"), own_class.alias("cls"), F.col("doc_id").cast("long").alias("id"))
    found = own.filter("cls is not null").join(kept, (F.col("cls") == F.col("_cls")) & (F.col("id").isNull() == F.col("_no_id")) & (F.coalesce("id", F.lit(0)) == F.col("_id")))
    first = F.row_number().over(Window.partitionBy("cls").orderBy("id"))
    one = found.withColumn("place", first).filter("place = 1").select("row.*")
    return one.unionByName(own.filter("cls is null").select("row.*"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under links of similar texts."""
    return grouped(table(spark, sf_dir, "documents"))
