"""What the operators share: shared storage, thinned joins, Arrow buffers as numpy arrays, word splitting."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize, release, shared_dir  # noqa: F401  the other modules take them from here

#: White space of the word rule; bytes.split() and bytes.lower() of Python cut and fold by the same ASCII rule.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """Read one table of the folder; with cols, only those columns reach the scan."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


#: Settings that bound Python workers: rows of a batch, and what keeps SQL and RDD stages in one pool of workers.
_BATCH, _TRACEBACK = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.pyspark.udf.simplifiedTraceback.enabled"


def lean_python(spark: SparkSession, rows: int = 512) -> None:
    """Bound the memory of Python workers. Batches have at most so many rows: whole texts make the default of 10,000 large
    buffers. Pools of workers are kept apart by their environment; without short tracebacks, which only SQL sets there,
    one pool can serve SQL and RDD stages."""
    if not 0 < int(spark.conf.get(_BATCH)) <= rows:
        spark.conf.set(_BATCH, rows)
    spark.conf.set(_TRACEBACK, False)


@contextlib.contextmanager
def carried(spark: SparkSession) -> Iterator[None]:
    """Within, jobs over the RDD of a DataFrame run its stages with these settings too. Spark sends a session's settings along
    with SQL jobs only; in others all stages before the last have the defaults, batches of 10,000 whole texts in workers of
    a second pool."""
    sc = spark.sparkContext
    before = {name: sc.getLocalProperty(name) for name in (_BATCH, _TRACEBACK)}
    for name in before:
        sc.setLocalProperty(name, spark.conf.get(name))
    try:
        yield
    finally:
        for name, value in before.items():
            sc.setLocalProperty(name, value)


def trim() -> None:
    """Give memory that a task has freed back to the system, since workers are used again."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """f over a partition, and then trim(), once all that f held is free."""

    def run(rows: Iterator) -> Iterator:
        yield from f(rows)
        trim()

    return run


#: Words of 64 bits of the bit map that thins out joins.
MARKS = 1 << 19


def parted(d: DataFrame, cols: Sequence[str], keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of d whose cols may be among keys' columns of the same names, rows whose cols are not), by a bit map of hashes
    of fixed size that is broadcast. A join of the first part with keys of any number then shuffles little more than the rows
    it meets. Keys beyond the map's capacity only make the first part larger; rows never go missing."""
    place = F.pmod(F.xxhash64(*cols), F.lit(MARKS * 64))
    bit = (place % 64).cast("int")
    marks = keys.groupBy(F.shiftright(place, 6).alias("_mark")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("_bits"))
    seen = d.withColumn("_mark", F.shiftright(place, 6)).join(F.broadcast(marks), "_mark", "left")
    maybe = F.coalesce(F.call_function("shiftright", F.col("_bits"), bit).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    own = [F.col(f"`{c}`") for c in d.columns]
    return seen.where(maybe).select(own), seen.where(~maybe).select(own)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def doc_keys(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two join keys of a row, never null: rows with equal doc_id and equal text are one document."""
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63)).cast("long")).alias("_k1"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_k2")]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and n + 1 offsets into them, without copies; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def texts_of(column: pa.Array) -> list[bytes]:
    """The texts as bytes; nulls are empty."""
    raw, offsets = text_buffers(column)
    view = raw.tobytes()
    at = offsets.tolist()
    return [view[a:b] for a, b in zip(at, at[1:])]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 8 << 20, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the text of each has about `most` bytes, or is one row; every row is kept."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_buffers(batch.column(batch.schema.get_field_index(text)))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
            end = min(max(end, start + 1), start + rows, batch.num_rows)
            yield batch.slice(start, end - start)
            start = end
