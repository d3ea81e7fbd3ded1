"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeprint.scratch import materialize, scratch_root  # noqa: F401

#: Rows and bytes of one Arrow batch (a single longer row is a batch of its own), and the bytes of
#: text that a worker takes at once.
ARROW_ROWS, ARROW_BYTES, TEXT_BYTES = 1000, 2 << 20, 1 << 19
#: A side is broadcast only after a count has shown that it has no more rows than this.
BROADCAST_ROWS = 1_000_000


def prepare(spark: SparkSession) -> None:
    """Lower the bounds of Arrow batches, unless they are lower already."""
    for key, bound in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = spark.conf.get(key, str(bound + 1)).lower().rstrip("b")
        if not now.isdecimal() or not 0 < int(now) <= bound:
            spark.conf.set(key, str(bound))


def bounded(batches: Iterator[pa.RecordBatch], column: int, most: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of at most ``most`` bytes of text in ``column``, or of one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < len(sizes):
            done = ends[at] - sizes[at]
            to = max(int(np.searchsorted(ends, done + most, side="right")), at + 1)
            yield batch.slice(at, to - at)
            at = to
    give_back()


def give_back() -> None:
    """Hand freed memory back to the system, so that a worker that waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint, given only when the counted number of rows is below the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def repeats_ids(df: DataFrame, id_col: str) -> bool:
    """Whether two rows share an id, or one has none."""
    ids = df.groupBy(F.col(id_col).alias("_id")).agg(F.count(F.lit(1)).alias("_n"))
    return not ids.where("_n > 1 OR _id IS NULL").isEmpty()


def dataset(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranked(df: DataFrame, key: str, bucket: str, order: list[Column], out: str) -> DataFrame:
    """Zero-based gapless rank inside ``key`` in the order (bucket, order), as column ``out``.

    Only rows of one (key, bucket) are sorted together; the buckets' offsets come from their
    counts, so a key that holds a third of all rows is still spread over its buckets.
    ``key`` and ``bucket`` hold no nulls."""
    counts = df.groupBy(key, bucket).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(key, bucket).orderBy(*order))
    return df.join(offsets, [key, bucket]).withColumn(out, (F.col("_before") + inside - 1).cast("long")).drop("_before")
