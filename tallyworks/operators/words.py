"""Words of Thai by a given dictionary: cutting texts, how much of them is known, and repairing the order of their letters.

The dictionary is a trie in sorted arrays. All places of a batch of texts go down the trie at once,
a letter at a time; of the words found, those that leave the fewest letters unknown, and then
the fewest words, make the cut. Runs are Thai, Latin letters, digits, white space, or one other character.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.functions.text import ORDER, normalised
from tallyworks.operators.documents import LONGEST, TARGET, packed, page_quality
from tallyworks.sources.tables import table

#: Words that a dictionary may have at most, as all tasks get it, and letters of the longest one.
MOST_WORDS, LONGEST_WORD = 500_000, 100
#: Characters that go down the trie at once.
PIECE = 400_000
#: Letters that go together (fixed classes of the script): a vowel before its consonant, and all that stands after, above or below one.
LEADING, DEPENDENT = "เ-ไ", "ะ-ฺๅ็-๎"
CLUSTER = rf"[{LEADING}]?[ก-ฮ][{DEPENDENT}]*|[ก-๛]"
CLUSTERS = re.compile(CLUSTER)


class Trie:
    """The words of a dictionary as edges: the number of a node and a letter, in one sorted key, lead to the next node."""

    def __init__(self, words: list[str]):
        words = sorted({w for w in words if w and len(w) <= LONGEST_WORD})
        nodes: dict[tuple[int, int], int] = {}
        ends = [False]
        for word in words:
            at = 0
            for letter in map(ord, word):
                if (at, letter) not in nodes:
                    nodes[at, letter] = len(ends)
                    ends.append(False)
                at = nodes[at, letter]
            ends[at] = True
        keys = np.fromiter((a << 21 | b for a, b in nodes), np.int64, len(nodes))
        order = np.argsort(keys)
        self.keys, self.next, self.ends = keys[order], np.fromiter(nodes.values(), np.int64, len(nodes))[order], np.array(ends)

    def matches(self, letters: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of every word that begins at one of the starts."""
        begin, node, found = starts, np.zeros(len(starts), np.int64), []
        for length in range(LONGEST_WORD):
            inside = begin + length < len(letters)
            if not inside.all():
                begin, node = begin[inside], node[inside]
            if not len(begin) or not len(self.keys):
                break
            key = node << 21 | letters[begin + length]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = np.flatnonzero(self.keys[at] == key)
            begin, node = begin[there], self.next[at[there]]
            whole = self.ends[node]
            found.append(np.stack([begin[whole], begin[whole] + length + 1]))
        both = np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1)
        return both[0], both[1]


def cheapest(bounds: list[int], words: dict[int, list[int]]) -> list[tuple[int, int, bool]]:
    """Begin, end and whether it is a word of the pieces from the first to the last bound: fewest unknown letters, then fewest words, then the longest word first.

    bounds are where clusters begin, and the end; words has the ends of the words that begin there.
    Unknown letters that follow one another are one piece.
    """
    best: dict[int, tuple[int, int]] = {bounds[-1]: (0, 0)}
    choice: dict[int, tuple[int, bool]] = {}
    for low, high in zip(bounds[-2::-1], bounds[:0:-1], strict=True):
        unknown, count = best[high]
        found = (unknown + high - low, count, 1, -high)
        for end in words.get(low, ()):
            if end in best:
                found = min(found, (best[end][0], best[end][1] + 1, 0, -end))
        best[low], choice[low] = found[:2], (-found[3], found[2] == 0)
    out: list[tuple[int, int, bool]] = []
    at = bounds[0]
    while at < bounds[-1]:
        end, known = choice[at]
        if out and not known and not out[-1][2]:
            out[-1] = (out[-1][0], end, False)
        else:
            out.append((at, end, known))
        at = end
    return out


def _kinds() -> np.ndarray:
    """The kind of each character up to the last that has one: other, Latin, digit, white space, then those of Thai."""
    kinds = np.zeros(0x3002, np.uint8)
    kinds[[c for c in range(len(kinds)) if chr(c).isspace()]] = SPACE
    for kind, pattern in ((LATIN, "A-Za-zÀ-ÿ"), (DIGIT, "0-9"), (THAI, "ก-๛"), (THAI + 1, LEADING), (THAI + 2, "ก-ฮ"), (THAI + 3, DEPENDENT)):
        kinds[[c for c in range(len(kinds)) if re.match(f"[{pattern}]", chr(c))]] = kind
    return kinds


LATIN, DIGIT, SPACE, THAI = 1, 2, 3, 4
KINDS = _kinds()


@dataclass
class Tokens:
    """The tokens of some texts, which lie in one row of characters, one zero after each: begin, end and whether it is a word of the dictionary, and the begins of the texts."""

    begin: np.ndarray
    end: np.ndarray
    known: np.ndarray
    texts: np.ndarray

    def of_texts(self) -> np.ndarray:
        """Where the tokens of each text begin among all, and their number at the end."""
        return np.append(np.searchsorted(self.begin, self.texts), len(self.begin))


def tokens_of(texts: list[str | None], trie: Trie) -> Tokens:
    """The tokens of all texts, the zeros after them too.

    All places of all texts are worked on together. Where no word reaches across a bound, what is
    to the left and to the right of it can be cut apart; if a word fills all that lies between two
    such bounds nothing is cheaper, and without any word there is but one cluster. Only what is left
    goes through cheapest().
    """
    some = [t or "" for t in texts]
    letters = np.frombuffer(("\0".join(some) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    size = len(letters)
    offsets = np.cumsum([0, *(len(t) + 1 for t in some[:-1])])
    kind = KINDS[np.minimum(letters, len(KINDS) - 1)]
    run = np.minimum(kind, THAI)
    first = np.ones(size, bool)
    first[1:] = (run[1:] != run[:-1]) | (run[1:] == 0)
    # Within Thai a cluster begins at every letter, but at a consonant after its vowel and at what depends on a consonant.
    stem = np.maximum.accumulate(np.where(kind != THAI + 3, np.arange(size), 0))
    joined = (kind == THAI + 3) & (kind[stem] == THAI + 2)
    joined[1:] |= (kind[1:] == THAI + 2) & (kind[:-1] == THAI + 1)
    bound = np.append(first | ((run == THAI) & ~joined), True)
    a, b = trie.matches(letters, np.flatnonzero(bound[:-1] & (run == THAI)))
    of_run = np.cumsum(first)
    fits = bound[b] & (of_run[a] == of_run[b - 1])
    a, b = a[fits], b[fits]
    crossed = np.cumsum(np.bincount(a + 1, minlength=size + 2)[: size + 1] - np.bincount(b, minlength=size + 2)[: size + 1])
    uncrossed = bound & (crossed <= 0)
    free, part = np.flatnonzero(uncrossed), np.cumsum(uncrossed)[a] - 1
    known = np.zeros(len(free) - 1, bool)
    known[part[(free[part] == a) & (free[part + 1] == b)]] = True
    begin, end = free[:-1], free[1:]
    left = np.zeros(len(known), bool)
    left[part] = True
    left &= ~known
    if left.any():
        words: dict[int, list[int]] = {}
        own = left[part]
        for x, y in zip(a[own].tolist(), b[own].tolist(), strict=True):
            words.setdefault(x, []).append(y)
        bounds = np.flatnonzero(bound)
        low, high = np.searchsorted(bounds, begin[left]), np.searchsorted(bounds, end[left])
        cuts = [piece for x, y in zip(low.tolist(), high.tolist(), strict=True) for piece in cheapest(bounds[x : y + 1].tolist(), words)]
        more = np.array(cuts, np.int64).T
        begin, end, known = (np.concatenate([x[~left], y]) for x, y in zip((begin, end, known), (more[0], more[1], more[2].astype(bool)), strict=True))
        order = np.argsort(begin)
        begin, end, known = begin[order], end[order], known[order]
    # Unknown letters that follow one another in a run are one token.
    same = (of_run[begin[1:]] == of_run[begin[:-1]]) & ~known[1:] & ~known[:-1]
    starts = np.flatnonzero(np.append(True, ~same))
    return Tokens(begin[starts], np.append(end[starts[1:] - 1], end[-1]), known[starts], offsets)


def cut(texts: list[str | None], trie: Trie) -> list[list[tuple[str, bool]]]:
    """The tokens of each text and whether each is a word of the dictionary; nothing of a text is left out."""
    out: list[list[tuple[str, bool]]] = []
    for first, last in _pieces(texts):
        found = tokens_of(texts[first:last], trie)
        places = found.of_texts()
        for text, offset, low, high in zip(texts[first:last], found.texts.tolist(), places[:-1], places[1:] - 1, strict=True):
            own = zip((found.begin[low:high] - offset).tolist(), (found.end[low:high] - offset).tolist(), found.known[low:high].tolist(), strict=True)
            out.append([(text[a:b], known) for a, b, known in own])
    return out


def covered_of(texts: list[str | None], trie: Trie) -> list[int]:
    """How many letters of each text are in words of two letters or more."""
    out: list[int] = []
    for first, last in _pieces(texts):
        found = tokens_of(texts[first:last], trie)
        sizes = found.end - found.begin
        totals = np.append(0, np.cumsum(np.where(found.known & (sizes > 1), sizes, 0)))
        out += np.diff(totals[found.of_texts()]).tolist()
    return out


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text or "") > PIECE:
            yield begin, i
            begin, size = i, 0
        size += len(text or "")
    if begin < len(texts):
        yield begin, len(texts)


def dictionary(words: DataFrame, most: int = MOST_WORDS) -> list[str]:
    """The words (a first column of strings) of a dictionary of the caller; more than `most` are an error, as all tasks get them."""
    column = F.col(words.columns[0])
    found = [r[0] for r in words.select(column).filter(column.isNotNull() & (column != "")).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"a dictionary of more than {most} words")
    return sorted(found)


def _with_trie(spark: SparkSession, words: DataFrame, use: Callable, kind: str) -> Callable:
    """A function of a text column that applies use(texts, trie) to batches."""
    shared = spark.sparkContext.broadcast(dictionary(words))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trie = Trie(shared.value)
        for batch in batches:
            yield use(batch.to_pylist(), trie)

    return F.arrow_udf(run, kind)


def tokens(text: Column, words: DataFrame) -> Column:
    """array<struct<token, known>> of a text; NULL and empty texts have none."""
    kind = pa.list_(pa.struct([("token", pa.string()), ("known", pa.bool_())]))
    return _with_trie(words.sparkSession, words, lambda texts, trie: pa.array([[{"token": t, "known": k} for t, k in own] for own in cut(texts, trie)], kind), "array<struct<token:string,known:boolean>>")(text)


def covered(text: Column, words: DataFrame) -> Column:
    """How many letters of a text are in words of the dictionary of two letters or more; 0 for NULL."""
    return _with_trie(words.sparkSession, words, lambda texts, trie: pa.array(covered_of(texts, trie), pa.int64()), "bigint")(text)


def at_words(line: str, ends: np.ndarray, target: int) -> list[str]:
    """A line, whose tokens end there, in pieces of target characters at most, without blanks at their ends; a token that is longer stays whole."""
    out: list[str] = []
    begin = at = 0
    while at < len(ends):
        if begin and line[begin].isspace():
            begin, at = int(ends[at]), at + 1
            if at == len(ends):
                break
        at = max(at + 1, int(np.searchsorted(ends, begin + target, "right")))
        out.append(line[begin : ends[at - 1]].strip())
        begin = int(ends[at - 1])
    return [x for x in out if x]


def lines_of(texts: list[str | None], trie: Trie, target: int, longest: int) -> list[list[str]]:
    """The lines of each text without blank ones; those of more than `longest` characters are cut at words into pieces of target characters at most."""
    lines = [[s.strip() for s in (t or "").splitlines() if s.strip()] for t in texts]
    long = [s for own in lines for s in own if len(s) > longest]
    cuts: list[list[str]] = []
    for first, last in _pieces(long):
        found = tokens_of(long[first:last], trie)
        places = found.of_texts()
        cuts += [at_words(s, found.end[low:high] - offset, target) for s, offset, low, high in zip(long[first:last], found.texts, places[:-1], places[1:] - 1, strict=True)]
    ready = iter(cuts)
    return [[p for s in own for p in (next(ready) if len(s) > longest else [s])] for own in lines]


def broken_lines(text: Column, words: DataFrame, target: int = TARGET, longest: int = LONGEST) -> Column:
    """lines_of() as an array<string> column; NULL and blank texts have none."""
    return _with_trie(words.sparkSession, words, lambda texts, trie: pa.array(lines_of(texts, trie, target, longest), pa.list_(pa.string())), "array<string>")(text)


def chunks(text: Column, words: DataFrame, target: int = TARGET, longest: int = LONGEST, overlap: int = 1) -> Column:
    """The chunks of a page as documents.chunks_of() gives them, but for long lines, which are cut at words of the dictionary."""
    return _with_trie(words.sparkSession, words, lambda texts, trie: pa.array([packed(own, target, overlap) for own in lines_of(texts, trie, target, longest)], pa.list_(pa.string())), "array<string>")(text)


# What the queries work on: each Latin letter of a document becomes a word of four Thai letters,
# those from U on one that the dictionary lacks; so SQL knows what a right cut gives.
KNOWN, LETTERS = "abcdefghijklmnopqrst", "abcdefghijklmnopqrstuvwxyz"
LACKING = "ฮฮฮฮ"


def word_of(letter: str) -> str:
    consonant = chr(ord("ก") + KNOWN.index(letter)) if letter in KNOWN else ""
    return f"{consonant}า{consonant}ม" if consonant else LACKING


def sample_dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(word_of(c),) for c in KNOWN], "word string")


#: For each byte the twelve bytes of its word.
WORDS = np.zeros((256, 12), np.uint8)
for _letter in LETTERS:
    WORDS[ord(_letter)] = np.frombuffer(word_of(_letter).encode(), np.uint8)


def spelt(letters: pa.Array) -> pa.Array:
    """Texts of small Latin letters, each letter as its word."""
    _, places, values = letters.buffers()
    ends = np.frombuffer(places, np.int32)[letters.offset : letters.offset + len(letters) + 1]
    own = np.frombuffer(values, np.uint8)[ends[0] : ends[-1]] if values else np.zeros(0, np.uint8)
    sizes = (ends - ends[0]).astype(np.int64) * WORDS.shape[1]
    return pa.LargeStringArray.from_buffers(len(letters), pa.py_buffer(sizes), pa.py_buffer(np.take(WORDS, own, axis=0)))


def in_thai(text: Column, of: str = LETTERS) -> Column:
    """The Latin letters of a text that are among these, each as its word."""

    def spell(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # Words take twelve times the room of letters.
        for batch in batches:
            for i in range(0, len(batch), 200):
                own = batch.slice(i, 200)
                yield pc.if_else(own.is_null(), None, spelt(own.fill_null(""))).cast(pa.string())

    return F.arrow_udf(spell, "string")(F.regexp_replace(F.lower(text), f"[^{of[0]}-{of[-1]}]+", ""))


def repaired(text: Column) -> Column:
    """normalised() of whole texts."""
    patterns = [(re.compile(pattern), instead.replace("$", "\\")) for pattern, instead in ORDER]

    def repair(texts: pa.Array) -> pa.Array:
        out = texts.to_pylist()
        for i, own in enumerate(out):
            if own is not None:
                for pattern, instead in patterns:
                    own = pattern.sub(instead, own)
                out[i] = own
        return pa.array(out, pa.string())

    return F.arrow_udf(repair, "string")(text)


def thai_quality(spark: SparkSession, folder: str) -> DataFrame:
    """How many letters of each document, put into Thai, a dictionary knows, and what its quality is."""
    docs = table(spark, folder, "documents").filter("text is not null").select("doc_id", in_thai(F.col("text")).alias("thai"))
    known = docs.withColumn("covered", covered(F.col("thai"), sample_dictionary(spark)))
    return known.select("doc_id", "covered", F.array_join(page_quality(F.col("thai"), F.col("covered")), ",").alias("reasons"))


def thai_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces that each document, put into one line of known words, is cut into."""
    docs = table(spark, folder, "documents").filter("text is not null").select("doc_id", in_thai(F.col("text"), KNOWN).alias("thai"))
    return docs.select("doc_id", F.posexplode(broken_lines(F.col("thai"), sample_dictionary(spark))).alias("place", "text")).select("doc_id", "place", F.sha2("text", 256).alias("text_sha256"), F.char_length("text").cast("long").alias("n_chars"))


def thai_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """Documents put into Thai with a mark typed in the wrong place, and repaired."""
    docs = table(spark, folder, "documents").filter("text is not null")
    thai = in_thai(F.col("text"))
    return docs.select("doc_id", F.sha2(repaired(F.replace(thai, F.lit("าก"), F.lit("เเก่้ิ\u200b"))), 256).alias("text_sha256"))


QUERIES = {f.__name__: f for f in (thai_quality, thai_lines, thai_repaired)}
_PLAIN = "WITH plain AS (SELECT doc_id, regexp_replace(lower(text), '[^a-z]+', '', 'g') AS letters FROM documents WHERE text IS NOT NULL)"
_THAI = "letters"
for _letter in LETTERS:
    _THAI = f"replace({_THAI}, '{_letter}', '{word_of(_letter)}')"
ORACLE = {
    "thai_quality": f"""{_PLAIN}, counts AS (SELECT doc_id, 4 * length(regexp_replace(letters, '[u-z]+', '', 'g')) AS covered, 4 * length(letters) AS n FROM plain)
SELECT doc_id, CAST(covered AS BIGINT) AS covered, CASE WHEN n < 40 THEN 'NO_TEXT_LAYER' WHEN n >= 30 AND 2 * covered < n THEN 'UNRECOGNIZED_THAI' ELSE '' END AS reasons FROM counts""",
    "thai_lines": f"""{_PLAIN.replace("a-z", "a-t")}, thai AS (SELECT doc_id, {_THAI} AS text FROM plain WHERE letters <> ''),
pieces AS (SELECT doc_id, text, unnest(range(CASE WHEN length(text) > {LONGEST} THEN (length(text) + {TARGET} - 1) // {TARGET} ELSE 1 END)) AS place FROM thai)
SELECT doc_id, CAST(place AS INTEGER) AS place, sha256(piece) AS text_sha256, length(piece) AS n_chars
FROM (SELECT doc_id, place, CASE WHEN length(text) > {LONGEST} THEN substring(text, place * {TARGET} + 1, {TARGET}) ELSE text END AS piece FROM pieces)""",
    "thai_repaired": f"{_PLAIN} SELECT doc_id, sha256(replace({_THAI}, 'าก', 'แกิ้')) AS text_sha256 FROM plain",
}
