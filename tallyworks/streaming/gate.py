"""A gate that lets a streamed answer through in checked segments, as a stateful stream and as a batch."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyworks.functions.text import BANNED
from tallyworks.sources.shared import shared_folder

# What ends a sentence, how long the first and the other segments get, and how much
# of what has been shown is checked again with the next segment, as terms may be split.
ENDS = "\n।.!?…"
FIRST, OTHERS, TAIL = 48, 160, 12
NOTICE = "[ระบบระงับการแสดงผลบางส่วน]"

SEGMENTS = "request_id long, segment int, text string, blocked boolean"
#: What let_through() needs, the number that is expected next, deltas that came early by their numbers (in JSON), and whether the request is over.
STATE = "text string, shown int, sent int, blocked boolean, expected int, early string, over boolean"


def piece(longest: int) -> re.Pattern:
    """What may be shown next of a text: up to its first end of a sentence; without one, if the text is that long, up to the last space past half of the length, or the whole length."""
    return re.compile(rf"[^{ENDS}]*[{ENDS}]|(?=.{{{longest}}})(?:.{{{longest // 2 + 1},{longest - 1}}}[ ]|.{{{longest}}})", re.DOTALL)


PIECES = (piece(FIRST), piece(OTHERS))


def let_through(state: tuple, deltas: Iterable[tuple[str | None, bool]], terms: tuple[str, ...]) -> tuple[list[tuple[int, str, bool]], tuple]:
    """The segments (number, text, blocked) that deltas (text, last) complete, and the state after them.

    The state is a text, how much of it has been shown, how many segments that were, and whether
    the request is blocked. Of what has been shown only the end is kept, which is checked again with
    the next segment. A segment with a banned term is replaced by the notice, and nothing follows it.
    """
    text, shown, sent, blocked = state
    segments: list[tuple[int, str, bool]] = []
    for delta, last in deltas:
        text += delta or ""
        while not blocked and shown < len(text):
            found = PIECES[min(sent, 1)].match(text, shown)
            end = found.end() if found else len(text) if last else shown
            if end == shown:
                break
            checked = text[max(shown - TAIL, 0) : end]
            blocked = any(term in form for term in terms for form in (checked, checked.lower()))
            segments.append((sent, NOTICE if blocked else text[shown:end], blocked))
            shown, sent = end, sent + 1
        behind = len(text) if blocked else max(shown - TAIL, 0)
        text, shown = text[behind:], shown - behind if not blocked else 0
    return segments, (text, shown, sent, blocked)


START = ("", 0, 0, False)


def in_order(early: dict[int, tuple[str | None, bool]], expected: int, rows: Iterable[tuple[int, str | None, bool]]) -> tuple[list[tuple[str | None, bool]], int, bool]:
    """The deltas (text, last) whose turn it is, what number is expected next, and whether the last one was among them.

    rows: seq, delta, last, in any order. Those that come early are put into `early` and taken out
    when their turn comes; of those with the same number the first one counts, and what comes after
    the last one doesn't.
    """
    for seq, delta, last in rows:
        if seq >= expected:
            early.setdefault(seq, (delta, last))
    turn, over = [], False
    while not over and expected in early:
        turn.append(early.pop(expected))
        expected, over = expected + 1, turn[-1][1]
    if over:
        early.clear()
    return turn, expected, over


def gated(deltas: DataFrame, terms: tuple[str, ...] = BANNED, first: int = 0, silence: int | None = None) -> DataFrame:
    """request_id, segment, text and blocked from deltas (request_id, seq, delta, last).

    Deltas are taken one at a time by seq, from `first` on without a gap, so neither where a batch
    ends nor the order in which deltas come changes anything. A request's rest comes out with its
    last delta. In a batch all deltas of a request are there at once; what comes after a missing
    number isn't shown. In a stream, state holds the number that is expected next and the deltas that
    came early, and knows of a request that it is over, so that late or repeated deltas don't start
    it anew. With `silence`, a request without a delta for so many milliseconds is ended: what it has
    in order is let through, and its state goes. A stream with timers goes on for as long as it
    isn't stopped, so one that shall end with its input has none.
    """

    def frame(request: int, segments: list[tuple[int, str, bool]]) -> pd.DataFrame:
        found = pd.DataFrame([(request, *x) for x in segments], columns=["request_id", "segment", "text", "blocked"])
        return found.astype({"request_id": "int64", "segment": "int32", "blocked": "bool"})

    def rows_of(rows: pd.DataFrame) -> Iterator[tuple[int, str | None, bool]]:
        return ((int(s), d, bool(x)) for s, d, x in rows.sort_values("seq", kind="stable")[["seq", "delta", "last"]].itertuples(index=False))

    def batch(requests: pa.Array) -> pa.Array:
        out = []
        for rows in requests.to_pylist():
            turn, _, over = in_order({}, first, sorted(((r["seq"], r["delta"], bool(r["last"])) for r in rows), key=lambda r: r[0]))
            segments = let_through(START, turn if over else [*turn, ("", True)], terms)[0]
            out.append([{"segment": n, "text": t, "blocked": x} for n, t, x in segments])
        return pa.array(out, pa.list_(pa.struct([("segment", pa.int32()), ("text", pa.string()), ("blocked", pa.bool_())])))

    def stream(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *so_far, expected, early, over = state.get if state.exists else (*START, first, "{}", False)
        if state.hasTimedOut:
            state.remove()
            yield frame(key[0], [] if over else let_through(tuple(so_far), [("", True)], terms)[0])
            return
        segments: list[tuple[int, str, bool]] = []
        if not over:
            waiting = {int(k): (d, x) for k, (d, x) in json.loads(early).items()}
            turn, expected, over = in_order(waiting, expected, (row for own in frames for row in rows_of(own)))
            segments, after = let_through(tuple(so_far), turn, terms)
            so_far, early = (list(START), "{}") if over else (list(after), json.dumps(waiting))
        state.update((*so_far, expected, early, over))
        if silence:
            state.setTimeoutDuration(silence)
        yield frame(key[0], segments)

    grouped = deltas.groupBy("request_id")
    if deltas.isStreaming:
        return grouped.applyInPandasWithState(stream, SEGMENTS, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if silence else GroupStateTimeout.NoTimeout)
    # Many requests go to a task's Python at once, as most of them have few deltas.
    whole = grouped.agg(F.collect_list(F.struct("seq", "delta", "last")).alias("rows"))
    shown = F.arrow_udf(batch, "array<struct<segment: int, text: string, blocked: boolean>>")
    return whole.select(F.col("request_id").cast("long").alias("request_id"), F.inline(shown("rows")))


def conversation_deltas(turns: DataFrame, size: int = 40) -> DataFrame:
    """The assistant's turns as requests, in deltas of that many characters."""
    own = turns.filter("role = 'assistant' and text <> ''").withColumn("n", F.ceil(F.char_length("text") / size).cast("int"))
    each = own.select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), "text", "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("seq"))
    return each.select("request_id", "seq", F.substring("text", (F.col("seq") - 1) * size + 1, F.lit(size)).alias("delta"), (F.col("seq") == F.col("n")).alias("last"))


def run_once(stream: DataFrame) -> DataFrame:
    """All that a stream gives for what is there now, read from files in the shared folder."""
    folder = f"{shared_folder(stream.sparkSession)}/{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/rows")
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def stream_gate(spark: SparkSession, folder: str) -> DataFrame:
    schema = spark.read.parquet(f"{folder}/conversations.parquet").schema
    turns = spark.readStream.schema(schema).parquet(f"{folder}/conversation[s].parquet")  # a pattern, as the table may be one file or a folder
    return run_once(gated(conversation_deltas(turns), first=1))


def batch_gate(spark: SparkSession, folder: str) -> DataFrame:
    return gated(conversation_deltas(spark.read.parquet(f"{folder}/conversations.parquet")), first=1)


def whole_answers(segments: DataFrame) -> DataFrame:
    """request_id, blocked, and the text that was shown of requests that aren't blocked, from their segments."""
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", "text"))), lambda s: s["text"]), "")
    return segments.groupBy("request_id").agg(F.max("blocked").alias("blocked"), shown.alias("text")).withColumn("text", F.when(~F.col("blocked"), F.col("text")))


def batch_gate_whole(spark: SparkSession, folder: str) -> DataFrame:
    return whole_answers(batch_gate(spark, folder))


def stream_gate_whole(spark: SparkSession, folder: str) -> DataFrame:
    return whole_answers(stream_gate(spark, folder))


QUERIES = {f.__name__: f for f in (stream_gate, batch_gate, stream_gate_whole, batch_gate_whole)}
_TERMS = " OR ".join(f"contains(lower(text), '{term}')" for term in BANNED)
#: What the gate shows is the whole text, unless a banned term is anywhere in it, as the end of what has been shown is checked again.
_WHOLE = f"SELECT conv_id * 1000 + turn AS request_id, ({_TERMS}) AS blocked, CASE WHEN NOT ({_TERMS}) THEN text END AS text FROM conversations WHERE role = 'assistant' AND text <> ''"
ORACLE = {"stream_gate_whole": _WHOLE, "batch_gate_whole": _WHOLE}
