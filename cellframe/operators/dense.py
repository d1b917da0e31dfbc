"""Dense rows of sparse values, where an operator's meaning is dense."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values of the dense block that a task makes at a time (8 bytes each).
_BLOCK = 4_000_000


def dense_rows(cells: DataFrame, values: DataFrame, column: DataFrame, width: int) -> DataFrame:
    """(cell_id, row): an array of ``width`` values for every cell, zeros filled in.

    ``column`` (gene_id, column from 0) is the table of chosen genes, which is small by
    nature and broadcast. Only nonzero values are shuffled, by cell; each task scatters
    them into rows, in time linear in width and values.
    """
    at = F.struct(F.col("column").cast("int").alias("c"), F.col("value").cast("double").alias("x"))
    lists = values.join(F.broadcast(column.select("gene_id", "column")), "gene_id").groupBy("cell_id").agg(F.collect_list(at).alias("e"))
    rows = cells.select("cell_id").join(lists, "cell_id", "left")
    step = max(1, _BLOCK // max(width, 1))

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                b = whole.slice(start, step)
                n = b.num_rows
                lengths = np.nan_to_num(b.column(1).value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                flat = b.column(1).flatten()
                out = np.zeros((n, width))
                np.add.at(out, (np.repeat(np.arange(n), lengths), flat.field("c").to_numpy(zero_copy_only=False)), flat.field("x").to_numpy(zero_copy_only=False))
                edges = pa.array(np.arange(0, n * width + 1, width) if width else np.zeros(n + 1), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(edges, pa.array(out.ravel()))], names=["cell_id", "row"])

    kind = rows.schema["cell_id"].dataType.simpleString()
    return rows.mapInArrow(scatter, f"cell_id {kind}, row array<double>")
