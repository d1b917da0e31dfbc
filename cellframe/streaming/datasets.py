"""Reading built datasets cell by cell, and operators on streams of cells."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators import encoding
from ..sources import tables


#: Rows that are fetched together.
AHEAD = 256


def open_split(spark: SparkSession, path: str, split: str = "train", dtype: str | None = None) -> DataFrame:
    """The rows of a split, wherever it lies (``path/split`` before ``path``), counts cast on demand."""
    place = f"{path}/{split}" if tables.exists(spark, f"{path}/{split}") else path
    rows = spark.read.parquet(place)
    return rows if dtype is None else rows.withColumn("counts", F.col("counts").cast(f"array<{dtype}>"))


class HeldDataset:
    """A split held in the executors' memory (and disks), with rows by position."""

    def __init__(self, spark: SparkSession, path: str, split: str = "train", dtype: str | None = None):
        self.rows = open_split(spark, path, split, dtype).persist(StorageLevel.MEMORY_AND_DISK)
        self._n = self.rows.count()
        self._near: dict[int, Row] = {}

    def __len__(self) -> int:
        return self._n

    def __getitem__(self, pos: int) -> Row:
        """A row; its neighbours by position come along, as the next ones asked for."""
        if pos not in self._near:
            low = pos - pos % AHEAD
            self._near = {r.cell_pos: r for r in self.rows.where(F.col("cell_pos").between(low, low + AHEAD - 1)).collect()}
        if pos not in self._near:
            raise IndexError(pos)
        return self._near[pos]

    def __getitems__(self, positions: list[int]) -> list[Row]:
        """The rows of a batch, in its order, by one job."""
        wanted = self.rows.sparkSession.createDataFrame([(int(p),) for p in set(positions)], "cell_pos long")
        found = {r.cell_pos: r for r in self.rows.join(F.broadcast(wanted), "cell_pos", "left_semi").collect()}
        missing = [p for p in positions if p not in found]
        if missing:
            raise IndexError(missing[0])
        return [found[p] for p in positions]


class StreamedDataset:
    """Rows of a split, one after another, in an order that each epoch deals anew.

    Rows of a chunked split stay with their chunk: chunks are shuffled, then the
    rows of each. The order is a hash of seed, epoch and place, so any engine and
    any number of partitions give the same.
    """

    def __init__(self, spark: SparkSession, path: str, split: str = "train", shuffle: bool = True, seed: int = 42, dtype: str | None = None):
        self.rows, self.shuffle, self.seed, self.epoch = open_split(spark, path, split, dtype), shuffle, seed, 0

    def set_epoch(self, epoch: int) -> None:
        self.epoch = epoch

    def __len__(self) -> int:
        return self.rows.count()

    def ordered(self) -> DataFrame:
        key = F.lit(self.seed + self.epoch)
        if not self.shuffle:
            return self.rows.orderBy(*(["chunk"] if "chunk" in self.rows.columns else []), "cell_id")
        chunk = [F.xxhash64(F.col("chunk"), key), F.col("chunk")] if "chunk" in self.rows.columns else []
        return self.rows.orderBy(*chunk, F.xxhash64(F.col("cell_id"), key), "cell_id")

    def __iter__(self) -> Iterator[Row]:
        return self.ordered().toLocalIterator(prefetchPartitions=True)


def encode_stream(cells: DataFrame, schema: encoding.ConditionSchema) -> DataFrame:
    """(cell_id, condition) of a stream of cells: the fitted vector is stateless."""
    return cells.select("cell_id", encoding.condition_vector(schema).alias("condition"))
