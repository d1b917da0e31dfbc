"""Shared pieces of the text operators: scratch tables, batches, bounded samples."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import settled

#: Rows of one Arrow batch that goes to a Python worker. Texts may be long, so
#: far fewer than Spark's default of 10,000; Spark bounds a batch's bytes besides.
ARROW_ROWS = 256

#: A set of ids may be broadcast up to this many rows (8 bytes each, some 30 MB
#: as a hash table); larger sets go through a shuffled join.
BROADCAST_IDS = 500_000


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the folder that driver and executors share and read it back: lineage ends here."""
    return settled(df, name)


def release(spark: SparkSession) -> None:
    """Let go of what finished jobs have left: shuffle files and broadcasts stay until the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Plans made within let go of their shuffle files when their job ends, however seldom the driver collects garbage.

    For tables that are written. A plan that is run twice makes its shuffles anew,
    so that what is returned unwritten is better made outside.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def small_batches(spark: SparkSession) -> None:
    """Lower the rows of an Arrow batch for the texts' sake, never raise them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def map_rows(
    df: DataFrame,
    inputs: list[str],
    outputs: T.StructType,
    fn: Callable[[], Callable[[list[list]], list[pa.Array]]],
    keep: list[str] | None = None,
) -> DataFrame:
    """Add columns that Python computes from ``inputs``, row by row of ``df``.

    ``fn`` runs once in each task and returns the function for a batch: it gets
    the input columns as Python lists and returns one Arrow array for each
    field of ``outputs``. ``keep`` names the input columns that stay (default:
    all); an input column whose name an output has is replaced by it.
    """
    small_batches(df.sparkSession)
    new = [f.name for f in outputs.fields]
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    read = [*kept, *[c for c in inputs if c not in kept]]
    source = df.select(*[F.col(f"`{c}`") for c in read])
    schema = T.StructType([*[source.schema[c] for c in kept], *outputs.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = fn()
        for b in batches:
            cols = work([b.column(read.index(c)).to_pylist() for c in inputs])
            yield pa.RecordBatch.from_arrays(
                [*[b.column(read.index(c)) for c in kept], *cols], names=[*kept, *new]
            )

    return source.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Rows that no classifier learns from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample_ids(df: DataFrame, most: int, *columns: str) -> DataFrame:
    """At most ``most`` rows of the narrow columns, the same ones on every run.

    Rows are taken by the hash of ``doc_id``; the result has a proven bound, so
    that it may be collected or broadcast.
    """
    return (
        df.where(F.col("doc_id").isNotNull())
        .select("doc_id", *columns)
        .dropDuplicates(["doc_id"])
        .orderBy(F.xxhash64(F.col("doc_id"), F.lit(7)), "doc_id")
        .limit(most)
    )


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` whose ``doc_id`` is not in ``ids`` (one column, materialized, distinct).

    The set is counted first: a small one is broadcast, a larger one shuffled.
    Rows of ``docs`` without an id stay.
    """
    ids = ids.where(F.col("doc_id").isNotNull())
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])


def chunks(lengths: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose lengths sum to about ``most``."""
    start = total = 0
    i = -1
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if i >= start:
        yield start, i + 1


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
