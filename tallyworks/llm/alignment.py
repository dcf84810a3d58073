"""Alignment of two tokenizers: which tokens overlap, in groups that both cut alike, and how often pairs of ids are linked."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.llm.bpe import Encoder, Vocabulary, spread, tokenizer_path
from tallyworks.llm.common import checkpointed, in_arrow, pieces, python_batches, table

#: Characters that are encoded at once, tokens that go to DuckDB at once (more if no place comes where both cut), rows
#: of a partition's pair counts that are added up anew, and segments that a task remembers before it starts anew.
PIECE, WINDOW, HELD, REMEMBERED = 1_000_000, 600_000, 2_000_000, 300_000
#: A text with a blank before it falls into segments that begin with a blank after a character that is none: there both tokenizers cut.
SEGMENT = re.compile(r" \s*\S*(?:[^\S ]\s*\S*|\s+\Z)*")
#: Pairs whose counts are broadcast: the most frequent ones, 17 bytes each. Others meet theirs in a shuffle.
FREQUENT = 1 << 21
#: Pairs of one row of packed counts.
PACKED = 1 << 16
TOKENS = [("doc", pa.int32()), ("id", pa.int32()), ("s", pa.int64()), ("e", pa.int64())]

#: An A token is linked with the B token that holds its first byte,
FIRST = "CREATE OR REPLACE TEMP TABLE first AS SELECT a.doc, a.id AS a, b.id AS b, a.e, b.e AS reached FROM a ASOF JOIN b ON a.s >= b.s"
#: and with those that begin within it, if that one doesn't reach its end.
LINKS = """
CREATE OR REPLACE TEMP TABLE links AS
SELECT doc, a, b FROM first
UNION ALL
SELECT wide.doc, wide.a, inner_b.id
FROM (SELECT * FROM first WHERE reached < e) AS wide JOIN (SELECT b.id, b.s FROM b ANTI JOIN a ON b.s = a.s) AS inner_b ON wide.reached <= inner_b.s AND inner_b.s < wide.e
"""
LINKED = "SELECT doc, (a::BIGINT << 32) | b AS key, count(*) AS n FROM links GROUP BY ALL ORDER BY doc, key"
#: The same of texts, from the links of their segments.
PAIRS = "CREATE OR REPLACE TEMP TABLE pairs AS SELECT doc, key, sum(n)::BIGINT AS n FROM held GROUP BY ALL"
#: The group of a token: how many ends before its own are ends of both kinds. Segments end with both.
GROUPS = """
SELECT own.e, (sum(CASE WHEN other.e IS NULL THEN 0 ELSE 1 END) OVER (ORDER BY own.e) - CASE WHEN other.e IS NULL THEN 0 ELSE 1 END)::BIGINT AS g
FROM {} AS own LEFT JOIN (SELECT e FROM {}) AS other ON own.e = other.e
"""


def packed(keys: np.ndarray, uses: np.ndarray) -> bytes:
    """Pairs in order of their keys and their counts, compressed."""
    if (keys[1:] < keys[:-1]).any():
        order = np.argsort(keys)
        keys, uses = keys[order], uses[order]
    raw = np.concatenate([np.diff(keys, prepend=0), uses]).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    both = np.frombuffer(raw, np.uint8).reshape(8, -1).T.copy().view("<i8").ravel()
    return np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]


class Pieces:
    """A sentencepiece model and the bytes of its tokens."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        known = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.model.id_to_piece, range(self.model.get_piece_size())))]
        self.bytes = np.frombuffer(b"".join(known), np.uint8)
        self.lengths = np.array([len(x) for x in known], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and how many each text has."""
        ids = self.model.encode(texts, num_threads=1)
        counts = np.array([len(x) for x in ids], np.int64)
        return np.fromiter((i for x in ids for i in x), np.int64, counts.sum()), counts


def token_bytes(ids: np.ndarray, of) -> bytes:
    """The bytes of all ids, by the table of a Vocabulary or of Pieces."""
    return of.bytes[spread(of.starts[ids], of.lengths[ids])].tobytes()


class Aligner:
    """Tokens of texts by both tokenizers, and what DuckDB finds of them; one for each task."""

    def __init__(self, path_a: str, path_b: str):
        import duckdb

        self.vocabulary, self.b = Vocabulary(path_a), Pieces(path_b)
        self.a = Encoder(self.vocabulary)
        self.a.specials = None  # their strings are plain text here
        self.db = duckdb.connect(config={"threads": 1, "temp_directory": "", "preserve_insertion_order": False})
        self.db.execute("CREATE TEMP TABLE counts (key BIGINT, n BIGINT)")
        self.rows = self.summed = 0
        most = max(len(self.vocabulary.lengths), len(self.b.lengths))
        self.forget()
        crossing = any("▁" in self.b.model.id_to_piece(i).lstrip("▁") for i in range(len(self.b.lengths)))
        self.segments = (lambda text: [text]) if crossing else SEGMENT.findall  # a piece that goes on over a blank would cross segments
        self.names = [[f"{mark}{i}" for i in range(most)] for mark in ("", ";", "|", ",")]

    def forget(self) -> None:
        """Segments by number, with what was found of each: tokens of both kinds, groups as text, and links in one array of all."""
        self.known: dict[str, int] = {}
        self.text: list[str] = []
        self.sizes = np.zeros((4, 0), np.int64)  # n_a, n_b, n_groups and n_links; -1 for segments whose bytes don't come back
        self.starts, self.lengths, self.keys, self.uses = (np.zeros(0, np.int64) for _ in range(4))

    def tokens(self, segments: list[str]) -> tuple[dict, dict, np.ndarray]:
        """Intervals of both kinds in one row of bytes, segment after segment, and which segments' bytes come back; others have none."""
        ids_a, counts_a = self.a.encode(segments)
        ids_b, counts_b = self.b.encode([s[1:] for s in segments])
        raw = [s.encode() for s in segments]
        whole = np.ones(len(segments), bool)
        if token_bytes(ids_a, self.vocabulary) != b"".join(raw) or token_bytes(ids_b, self.b) != b"".join(raw):
            for i, (a, b) in enumerate(zip(np.split(ids_a, np.cumsum(counts_a)[:-1]), np.split(ids_b, np.cumsum(counts_b)[:-1]), strict=True)):
                whole[i] = token_bytes(a, self.vocabulary) == raw[i] == token_bytes(b, self.b)
        out = []
        for ids, counts, of in ((ids_a, counts_a, self.vocabulary), (ids_b, counts_b, self.b)):
            doc = np.repeat(np.arange(len(segments), dtype=np.int32), counts)
            ids, doc = ids[whole[doc]], doc[whole[doc]]
            long = of.lengths[ids]
            end = np.cumsum(long)
            out.append({"doc": doc, "id": ids.astype(np.int32), "s": end - long, "e": end})
        return out[0], out[1], whole

    def windows(self, a: dict, b: dict) -> Iterator[tuple[dict, dict]]:
        """Both kinds of intervals, cut where both end, after WINDOW tokens each."""
        both = np.flatnonzero(np.isin(a["e"], b["e"], assume_unique=True)) + 1
        begin_a = begin_b = 0
        while begin_a < len(a["e"]):
            at = np.searchsorted(both, begin_a + WINDOW)
            end_a = int(both[min(at, len(both) - 1)])
            end_b = int(np.searchsorted(b["e"], a["e"][end_a - 1], "right"))
            yield ({k: v[begin_a:end_a] for k, v in a.items()}, {k: v[begin_b:end_b] for k, v in b.items()})
            begin_a, begin_b = end_a, end_b

    def found(self, a: dict, b: dict) -> tuple[Iterator[tuple[int, int, str]], pa.Table]:
        """The groups of each segment in a window, and the pairs that are linked in it with how often."""
        for name, columns in (("a", a), ("b", b)):
            self.db.register(name, pa.table([pa.array(columns[c], kind) for c, kind in TOKENS], names=[c for c, _ in TOKENS]))
        self.db.execute(FIRST)
        self.db.execute(LINKS)
        groups = []
        for names in ("ab", "ba"):
            cut = self.db.sql(GROUPS.format(*names)).to_arrow_table()
            groups.append(cut.column("g").to_numpy()[np.argsort(cut.column("e").to_numpy(), kind="stable")])
        return self.shown(a, b, *groups), self.db.sql(LINKED).to_arrow_table()

    def shown(self, a: dict, b: dict, groups_a: np.ndarray, groups_b: np.ndarray) -> Iterator[tuple[int, int, str]]:
        """Each segment with how many groups it has and what they are, as a1,a2|b1;a3|b2."""
        number, doc, group = np.append(a["id"], b["id"]), np.append(a["doc"], b["doc"]), np.append(groups_a, groups_b)
        kind = np.repeat([0, 1], [len(groups_a), len(groups_b)])
        order = np.argsort(2 * group + kind, kind="stable")
        number, doc, group, kind = number[order], doc[order], group[order], kind[order]
        first = np.append(True, doc[1:] != doc[:-1])[: len(doc)]
        opens = np.append(True, group[1:] != group[:-1])[: len(doc)]
        turns = np.append(False, kind[1:] != kind[:-1])[: len(doc)] & ~opens
        mark = np.where(first, 0, np.where(opens, 1, np.where(turns, 2, 3)))
        names = self.names
        words = [names[m][i] for m, i in zip(mark.tolist(), number.tolist(), strict=True)]
        bounds = np.append(np.flatnonzero(first), len(doc))
        groups = np.add.reduceat(opens, bounds[:-1], dtype=np.int64) if len(doc) else []
        for i, j, n in zip(bounds[:-1], bounds[1:], groups, strict=True):
            yield int(doc[i]), int(n), "".join(words[i:j])

    def learn(self, segments: list[str]) -> None:
        """Remember what is found of segments that aren't known."""
        a, b, whole = self.tokens(segments)
        count_a, count_b = (np.bincount(x["doc"], minlength=len(segments)) for x in (a, b))
        groups, texts, parts = np.zeros(len(segments), np.int64), [[] for _ in segments], []
        for window in self.windows(a, b):
            cut, pairs = self.found(*window)
            for doc, n, text in cut:
                texts[doc].append(text)
                groups[doc] += n
            parts.append([pairs.column(c).to_numpy() for c in ("doc", "key", "n")])
        doc, key, n = (np.concatenate([np.zeros(0, np.int64), *(p[i] for p in parts)]) for i in range(3))
        rows, links = np.bincount(doc, minlength=len(segments)), np.bincount(doc, n, len(segments)).astype(np.int64)
        self.known |= {s: len(self.text) + i for i, s in enumerate(segments)}
        self.text += [";".join(t) for t in texts]
        self.sizes = np.append(self.sizes, np.where(whole, [count_a, count_b, groups, links], -1), axis=1)
        self.starts = np.append(self.starts, len(self.keys) + np.cumsum(rows) - rows)
        self.lengths = np.append(self.lengths, rows)
        self.keys, self.uses = np.append(self.keys, key), np.append(self.uses, n)

    def aligned(self, texts: list[str | None]) -> list[tuple]:
        """n_a, n_b, n_groups, n_links, groups_sha256 and packed pairs of each text; the pairs are counted for the partition as well."""
        split = [self.segments(" " + t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.forget()
        for new in pieces(list(dict.fromkeys(s for own in split for s in own if s not in self.known)), PIECE):
            self.learn(new)
        number = [np.array([self.known[s] for s in own], np.int64) for own in split]
        number = [n if (self.sizes[0, n] >= 0).all() else n[:0] for n in number]
        doc, own, times = [], [], []
        for i, n in enumerate(number):
            different, uses = np.unique(n, return_counts=True)
            doc.append(np.full(len(different), i))
            own.append(different)
            times.append(uses)
        doc, own, times = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (doc, own, times))
        at, long = spread(self.starts[own], self.lengths[own]), self.lengths[own]
        self.db.register("held", pa.table({"doc": np.repeat(doc, long), "key": self.keys[at], "n": self.uses[at] * np.repeat(times, long)}))
        self.db.execute(PAIRS)
        self.rows += self.db.execute("INSERT INTO counts SELECT key, sum(n) FROM pairs GROUP BY key").fetchall()[0][0]
        if self.rows > 2 * self.summed + HELD:
            self.db.execute("CREATE OR REPLACE TEMP TABLE counts AS SELECT key, sum(n)::BIGINT AS n FROM counts GROUP BY key")
            self.rows = self.summed = self.db.execute("SELECT count(*) FROM counts").fetchall()[0][0]
        pairs = self.db.sql("SELECT doc, key, n FROM pairs ORDER BY doc, key").to_arrow_table()
        doc, key, n = (pairs.column(c).to_numpy() for c in ("doc", "key", "n"))
        ends = np.searchsorted(doc, np.arange(len(texts) + 1))
        out = []
        for i, segments in enumerate(number):
            digest = hashlib.sha256(";".join([self.text[s] for s in segments.tolist()]).encode()).hexdigest() if len(segments) else ""
            out.append((*map(int, self.sizes[:, segments].sum(axis=1)), digest, packed(key[ends[i] : ends[i + 1]], n[ends[i] : ends[i + 1]])))
        return out

    def counts(self) -> Iterator[bytes]:
        """The partition's pair counts, packed."""
        found = self.db.sql("SELECT key, sum(n)::BIGINT AS n FROM counts GROUP BY key").to_arrow_table()
        keys, uses = (found.column(c).to_numpy() for c in ("key", "n"))
        for at in range(0, len(keys), PACKED):
            yield packed(keys[at : at + PACKED], uses[at : at + PACKED])


FOUND = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("counts", pa.binary())])
FOUND_DDL = "doc_id long, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, counts binary"


def aligning(path_a: str, path_b: str) -> Callable:
    """A function over batches of doc_id and text: a row of FOUND for each text, and some with the partition's counts alone."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, row = Aligner(path_a, path_b), TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, at = batch.column(0), 0
            for texts in pieces(batch.column(1).to_pylist(), PIECE):
                found = own.aligned(texts)
                numbers = pa.array(np.arange(row, row + len(texts)))
                yield pa.RecordBatch.from_arrays([ids[at : at + len(texts)], numbers, *(pa.array(c, t) for c, t in zip(zip(*found, strict=True), FOUND.types[2:8], strict=True)), pa.nulls(len(texts), pa.binary())], schema=FOUND)
                at, row = at + len(texts), row + len(texts)
        for counts in own.counts():
            yield pa.RecordBatch.from_arrays([pa.array([None if f.name != "counts" else counts], f.type) for f in FOUND], schema=FOUND)

    return align


def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, n: packed counts as rows."""
    for batch in batches:
        for data in batch.column(0).to_pylist():
            keys, uses = unpacked(data)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(uses)], names=["key", "n"])


RESULT = FOUND_DDL.replace(", pairs binary, counts binary", ", n_best long, count_sum long, missing array<struct<key:bigint,uses:bigint>>")


def summing(known) -> Callable:
    """A function over batches of FOUND: n_best and count_sum of the pairs that are known, and the other pairs."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = known.value
        missing = pa.struct([("key", pa.int64()), ("uses", pa.int64())])
        for batch in batches:
            totals, others = [], []
            for data in batch.column(7).to_pylist():
                own, uses = unpacked(data)
                at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
                there = keys[at] == own if len(keys) else np.zeros(len(own), bool)
                at, there_uses = at[there], uses[there]
                totals.append((int((best[at] * there_uses).sum()), int((n[at] * there_uses).sum())))
                others.append(np.stack([own[~there], uses[~there]]))
            long = np.cumsum([0] + [x.shape[1] for x in others])
            flat = np.concatenate([np.zeros((2, 0), np.int64), *others], axis=1)
            rest = pa.ListArray.from_arrays(pa.array(long, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[0]), pa.array(flat[1])], fields=list(missing)))
            n_best, count_sum = (pa.array([t[k] for t in totals], pa.int64()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], n_best, count_sum, rest], names=[*FOUND.names[:7], "n_best", "count_sum", "missing"])

    return sums


def pair_counts(found: DataFrame) -> DataFrame:
    """key, n, best: how many links hold each pair of ids, and whether no other pair of its B id has more."""
    summed = checkpointed(in_arrow(found.filter("counts is not null").select("counts"), single, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    most = summed.groupBy(F.col("key").bitwiseAND(0xFFFFFFFF).alias("b")).agg(F.max("n").alias("most"))  # a row for each id of B at most
    return summed.join(F.broadcast(most), F.col("key").bitwiseAND(0xFFFFFFFF) == F.col("b")).select("key", "n", (F.col("n") == F.col("most")).alias("best"))


def threshold(counts: DataFrame, most: int) -> int:
    """The least count from which on there are no more than most pairs; by classes of counts, 16 to each power of two."""
    step = F.greatest(F.lit(0), F.floor(16 * F.log2("n"))).cast("int")
    total, least = 0, None
    for row in counts.groupBy(step.alias("step")).agg(F.count("*").alias("pairs"), F.min("n").alias("least")).orderBy(F.desc("step")).collect():
        total += row.pairs
        if total > most:
            break
        least = row.least
    return least if least is not None else np.iinfo(np.int64).max


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best and count_sum, one row for each row of docs.

    A is a byte-level tokenizer file over a blank and the text, B a sentencepiece model that adds the
    blank; neither adds or knows special tokens. The bytes of a text are cut into groups where both
    have a token that ends; an A and a B token are linked if their bytes overlap. How often a pair
    of ids is linked in all of docs gives n_best (links whose pair is the commonest one of its B id,
    ties included) and count_sum. Counts of at most `frequent` pairs are broadcast, those of others
    come by a join. In a task, texts fall into segments where both tokenizers cut, and each
    different segment is encoded and aligned once.

    Null and empty texts, and those whose tokens don't give their bytes back, have no tokens: zeros
    and an empty groups_sha256. Rows that repeat count each time; null ids stay; texts are worked on
    whole; long segments are aligned in windows that end where both tokenizers cut. No documents give no rows; no
    other column of docs is read. doc_id is returned as a long.
    """
    spark = docs.sparkSession
    python_batches(spark)
    path_a, path_b = path_a or tokenizer_path(), path_b or tokenizer_path("piece_bpe_32k.model")
    found = checkpointed(in_arrow(docs.select(F.col("doc_id").cast("long"), "text"), aligning(path_a, path_b), FOUND_DDL))
    counts = checkpointed(pair_counts(found))
    least = threshold(counts, frequent)
    top = counts.filter(F.col("n") >= least).toArrow().sort_by("key")
    known = spark.sparkContext.broadcast(tuple(top.column(c).to_numpy() for c in ("key", "n", "best")))
    rows = in_arrow(found.filter("row is not null"), summing(known), RESULT)
    rest = counts.filter(F.col("n") < least)
    if rest.isEmpty():
        return rows.drop("row", "missing")
    rows = checkpointed(rows)
    late = rows.select("row", F.inline("missing")).join(rest, "key").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("uses")).otherwise(0)).alias("late_best"), F.sum(F.col("n") * F.col("uses")).alias("late_sum"))
    both = rows.join(late, "row", "left")
    return both.select(*FOUND.names[:1], *FOUND.names[2:7], *((F.col(c) + F.coalesce(F.col(other), F.lit(0))).alias(c) for c, other in (("n_best", "late_best"), ("count_sum", "late_sum"))))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups and links of every document by the two public tokenizers."""
    return align(table(spark, sf_dir, "documents"))
