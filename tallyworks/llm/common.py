"""What the operators of this subpackage share: reading tables, cutting lineage, batch sizes, words."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.sources.shared import checkpointed
from tallyworks.sources.tables import table

#: Characters between words, in regular expressions of both Java and DuckDB.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a batch that goes to Python: texts of 100 kB each then stay below 50 MB.
BATCH_ROWS = 512


__all__ = ["WORD", "checkpointed", "giving_back", "in_arrow", "pieces", "python_batches", "remainder", "remainder_of", "table"]


def python_batches(spark: SparkSession) -> None:
    """Keep batches for Python small enough for long texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def giving_back(function: Callable) -> Callable:
    """The function of an iterator; when a task is through with it, memory it no longer uses goes back to the system.

    Spark uses Python workers again for other stages, which would otherwise keep what the largest one took.
    """

    @functools.wraps(function)
    def run(batches: Iterator) -> Iterator:
        yield from function(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other systems than Linux with glibc have no such call
            ctypes.CDLL(None).malloc_trim(0)

    return run


def in_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """mapInArrow, with memory given back at the end of each task."""
    return df.mapInArrow(giving_back(function), schema)


def remainder(column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo divisor; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


def remainder_of(value: int | None, divisor: int) -> int:
    """The same in Python."""
    return zlib.crc32(b"" if value is None else str(value).encode()) % divisor


def pieces(values: Iterable[str | None], most: int) -> Iterator[list[str | None]]:
    """values in lists of about most characters at most, but at least one value each."""
    out: list[str | None] = []
    total = 0
    for value in values:
        if out and total + len(value or "") > most:
            yield out
            out, total = [], 0
        out.append(value)
        total += len(value or "")
    if out:
        yield out
