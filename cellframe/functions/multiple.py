"""Multiple testing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bh_adjust(rows: DataFrame, p: str, by: list[str] | None = None, name: str = "padj") -> DataFrame:
    """Benjamini-Hochberg: ``min`` over larger p of ``p * m / rank``, at most 1.

    A family is a group of ``by`` (all rows without it), a row a gene: families
    have the size of the gene table, whatever the number of cells.
    """
    keys: list[Column] = [F.col(c) for c in by or []] or [F.lit(0)]
    up = Window.partitionBy(*keys).orderBy(p)
    size = F.count(p).over(Window.partitionBy(*keys))
    raw = rows.withColumn("_q", F.col(p) * size / F.row_number().over(up))
    # of equal p the last rank counts, which the minimum over the range frame takes in
    down = Window.partitionBy(*keys).orderBy(F.col(p).desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return raw.withColumn(name, F.least(F.min("_q").over(down), F.lit(1.0))).drop("_q")
