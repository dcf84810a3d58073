"""Fill in the middle: texts cut into three parts at unit boundaries, the middle moved to the end, by a table-driven byte DFA."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.llm.common import giving_back, pieces, python_batches, table

#: What stands before prefix, suffix and middle of a rearranged text.
SENTINELS = ("<P>", "<S>", "<M>")
#: Characters whose bytes are scanned at once, and bytes of the stripes that are scanned side by side.
PIECE, STRIPE = 1_000_000, 512
#: Stands between texts in the scanned bytes; no byte of UTF-8.
END = 0xFF
#: What a transition may tell: a character began, a unit ended with this byte or before it, sentinel i ended with this byte.
CHAR, AFTER, BEFORE, SENTINEL = 1, 2, 4, 8


@dataclass
class Machine:
    """Tables by state * 256 + byte: the next state, and what the transition tells."""

    after: np.ndarray
    told: np.ndarray


def machine(sentinels: tuple[str, ...] = SENTINELS, unit: bytes = b"\n") -> Machine:
    """The automaton of UTF-8 texts with these sentinels, in units that end with one of the bytes of unit.

    States: the beginning of a unit; within a unit; one, two or three bytes of a character still to
    come; each beginning of a sentinel. Sentinels are up to five strings of ASCII characters without
    bytes of unit; none begins with another one, and none holds the first character of one further
    on, so that text and sentinels can't make up another one between them.
    """
    words = [s.encode("ascii") for s in sentinels]
    if len(words) > 5 or any(len(w) < 2 or set(w) & set(unit) or any(o[0] in w[1:] or w.startswith(o) and w is not o for o in words) for w in words):
        raise ValueError(f"sentinels that may be mistaken: {sentinels}")
    first, within = 0, 1
    number = {s: 5 + i for i, s in enumerate(dict.fromkeys(w[:k] for w in words for k in range(1, len(w))))}
    seen = {v: k for k, v in number.items()}
    after, told = np.full((5 + len(number), 256), within, np.uint8), np.zeros((5 + len(number), 256), np.uint8)
    for state in range(len(after)):
        for byte in range(256):
            if byte == END:
                after[state, byte], told[state, byte] = first, 0 if state == first else BEFORE
            elif 0x80 <= byte < 0xC0:
                after[state, byte] = state - 1 if state in (3, 4) else within
            elif byte >= 0xC0:
                after[state, byte], told[state, byte] = 2 + (byte >= 0xE0) + (byte >= 0xF0), CHAR
            elif byte in unit:
                after[state, byte], told[state, byte] = first, CHAR | AFTER
            else:
                text = seen.get(state, b"") + bytes([byte])
                told[state, byte] = CHAR | sum(SENTINEL << i for i, w in enumerate(words) if text.endswith(w))
                after[state, byte] = next((number[text[k:]] for k in range(len(text)) if text[k:] in number), within)
    return Machine(after.ravel(), told.ravel())


def transitions(raw: np.ndarray, m: Machine) -> np.ndarray:
    """What each byte's transition tells, from the beginning of a unit on.

    The bytes are cut into stripes that are scanned side by side, a column of all stripes at a
    time. The state in which a stripe begins isn't known at first: it is what the last bytes of the
    stripe before make of every state, as soon as they make the same of all (in UTF-8 a few do);
    if no number of bytes does, the stripes are gone through one after the other.
    """
    states, rows = len(m.after) // 256, max(1, -(-len(raw) // STRIPE))
    padded = np.full(rows * STRIPE, END, np.uint8)
    padded[: len(raw)] = raw
    columns = np.ascontiguousarray(padded.reshape(rows, STRIPE).T)
    begin, reach = np.zeros(rows, np.uint8), 4
    while True:
        reach = min(2 * reach, STRIPE)
        end = np.repeat(np.arange(states, dtype=np.uint8)[:, None], rows, axis=1)
        for byte in columns[STRIPE - reach :]:
            end = m.after[end.astype(np.uint16) << 8 | byte]
        begin[1:] = end[0, :-1]
        if (end[:, :-1] == end[0, :-1]).all():
            break
        if reach == STRIPE:
            for i in range(1, rows):
                begin[i] = end[begin[i - 1], i - 1]
            break
    told, state = np.empty((STRIPE, rows), np.uint8), begin
    for j, byte in enumerate(columns):
        at = state.astype(np.uint16) << 8 | byte
        told[j] = m.told[at]
        state = m.after[at]
    return told.T.ravel()[: len(raw)]


@dataclass
class Scanned:
    """Bytes of several texts with END after each, what their transitions tell, and where each text begins and ends."""

    raw: np.ndarray
    told: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def count(self, mask: int) -> np.ndarray:
        """How many transitions of each text tell one of these; that of its END counts too."""
        at = np.flatnonzero(self.told & mask)
        return np.searchsorted(at, self.ends, "right") - np.searchsorted(at, self.starts)

    def chars(self, a: int, b: int) -> int:
        return int(np.count_nonzero(self.told[a:b] & CHAR))


def scanned(texts: list[str | None], m: Machine) -> Scanned:
    encoded = [(t or "").encode() for t in texts]
    raw = np.frombuffer(b"".join(x for e in encoded for x in (e, b"\xff")), np.uint8)
    ends = np.cumsum([len(e) + 1 for e in encoded], dtype=np.int64) - 1
    return Scanned(raw, transitions(raw, m), np.append(0, ends[:-1] + 1)[: len(ends)], ends)


def cuts(s: Scanned, units: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The byte at which unit `number` of each text begins (its end, if number is how many units it has)."""
    at = np.flatnonzero(s.told & (AFTER | BEFORE))
    past = at + ((s.told[at] & AFTER) != 0)
    before = np.cumsum(units) - units
    return np.where(number > 0, past[np.minimum(before + np.maximum(number, 1) - 1, max(len(past) - 1, 0))] if len(past) else s.starts, s.starts)


PART = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
PART_DDL = "struct<n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,output:string>"


def rearranged(texts: list[str | None], draws: np.ndarray, m: Machine, sentinels: tuple[str, ...] = SENTINELS, rate: int = 100, spm: int = 50) -> list[dict]:
    """For each text its units, form, characters of prefix and middle, and what it becomes.

    draws has four whole numbers for each text: two that choose the cuts, one that is compared with
    rate to leave the text plain, one that is compared with spm for the order of the parts.
    """
    p, q, x = sentinels
    s = scanned(texts, m)
    sizes, units = s.ends - s.starts, s.count(AFTER | BEFORE)
    first, second = draws[:, 0] % (units + 1), draws[:, 1] % (units + 1)
    a, b = cuts(s, units, np.minimum(first, second)), cuts(s, units, np.maximum(first, second))
    plain = (sizes == 0) | (s.count(SENTINEL * 7) > 0) | (draws[:, 2] % 100 >= rate)
    out, raw = [], s.raw.tobytes()
    for i, text in enumerate(texts):
        if plain[i]:
            out.append({"n": int(units[i]), "form": "plain", "prefix_chars": None, "middle_chars": None, "output": text or ""})
            continue
        prefix, middle, suffix = (raw[c:d].decode() for c, d in ((s.starts[i], a[i]), (a[i], b[i]), (b[i], s.ends[i])))
        form = "spm" if draws[i, 3] % 100 < spm else "psm"
        output = f"{q}{suffix}{p}{prefix}{x}{middle}" if form == "spm" else f"{p}{prefix}{q}{suffix}{x}{middle}"
        out.append({"n": int(units[i]), "form": form, "prefix_chars": s.chars(s.starts[i], a[i]), "middle_chars": s.chars(a[i], b[i]), "output": output})
    return out


def restored(outputs: list[str | None], forms: list[str | None], m: Machine, sentinels: tuple[str, ...] = SENTINELS) -> list[str]:
    """The texts that were rearranged: the parts lie between the sentinels, which the same automaton recognises."""
    s = scanned(outputs, m)
    behind = [np.flatnonzero(s.told & SENTINEL << i) + 1 for i in range(3)]
    place = [np.searchsorted(b, s.starts, "right") for b in behind]
    long, raw, out = [len(w) for w in sentinels], s.raw.tobytes(), []
    for i, form in enumerate(forms):
        if form not in ("psm", "spm"):
            out.append(outputs[i] or "")
            continue
        p, q, x = (int(b[k[i]]) for b, k in zip(behind, place, strict=True))
        prefix, suffix = (raw[p : q - long[1]], raw[q : x - long[2]]) if form == "psm" else (raw[p : x - long[2]], raw[q : p - long[0]])
        out.append((prefix + raw[x : s.ends[i]] + suffix).decode())
    return out


def cutter(sentinels: tuple[str, ...] = SENTINELS, unit: bytes = b"\n", rate: int = 100, spm: int = 50) -> Callable:
    """A function of a text column and four columns of draws that gives rearranged() as a struct."""

    def cut(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        m = machine(sentinels, unit)
        for text, *draws in batches:
            numbers, at, out = np.stack([d.to_numpy() for d in draws], axis=1), 0, []
            for texts in pieces(text.to_pylist(), PIECE):
                out += rearranged(texts, numbers[at : at + len(texts)], m, sentinels, rate, spm)
                at += len(texts)
            yield pa.array(out, PART)

    return F.arrow_udf(giving_back(cut), PART_DDL)


def restorer(sentinels: tuple[str, ...] = SENTINELS, unit: bytes = b"\n") -> Callable:
    """A function of columns of outputs and forms that gives the texts they come from."""

    def restore(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        m = machine(sentinels, unit)
        for output, form in batches:
            forms, at, out = form.to_pylist(), 0, []
            for texts in pieces(output.to_pylist(), PIECE):
                out += restored(texts, forms[at : at + len(texts)], m, sentinels)
                at += len(texts)
            yield pa.array(out, pa.string())

    return F.arrow_udf(giving_back(restore), "string")


def draws(key: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the sha256 of seed:key; a null key counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, sentinels: tuple[str, ...] = SENTINELS, unit: bytes = b"\n") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output, one row for each row of docs; other columns aren't read.

    n is how many units the text has (runs up to and with a byte of unit; a last one may lack it).
    `rate` of 100 texts are rearranged, `spm` of 100 of those with the suffix first; which ones, and
    where they are cut, depends on seed and doc_id alone, so that rows with one id are treated
    alike if their texts are. Null and empty texts, and those that hold a sentinel, stay plain:
    the output is the text (empty for null), and the two counts are null. Parts may be empty. Texts
    are scanned whole, however long; a null doc_id counts as an empty one; no documents give no rows.
    """
    python_batches(docs.sparkSession)
    found = docs.select("doc_id", cutter(sentinels, unit, rate, spm)(F.col("text"), *draws(F.col("doc_id"), seed)).alias("cut"))
    return found.select("doc_id", "cut.*")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its middle moved to the end, and the text that comes back from it."""
    found = fill_in_middle(table(spark, sf_dir, "documents"))
    text = restorer()(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(text.cast("binary"), 256).alias("restored_sha256"))


ORACLE = r"""
WITH lines AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), drawn AS (
    SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM lines
), formed AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM drawn
), parts AS (
    SELECT doc_id, text, n, form, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix FROM formed
)
SELECT doc_id, n, form,
    CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM parts
"""
