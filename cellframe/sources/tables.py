"""Annotated matrices in a folder of Parquet tables, and small files beside them.

A folder holds ``cells``, ``genes`` (and ``raw_genes``), ``counts`` partitioned by
``layer``, and ``embeddings`` partitioned by ``key``. Filters on layer, key and cell
position reach the scan.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import AnnotatedMatrix


def write_matrix(
    path: str, m: AnnotatedMatrix, layers: dict[str, DataFrame] | None = None, embeddings: DataFrame | None = None, raw_genes: DataFrame | None = None
) -> None:
    """Write a matrix; ``counts`` is layer ``X``, others (``raw.X``, ``layers/<name>``) go beside it."""
    m.cells.write.mode("overwrite").parquet(f"{path}/cells")
    m.genes.write.mode("overwrite").parquet(f"{path}/genes")
    if raw_genes is not None:
        raw_genes.write.mode("overwrite").parquet(f"{path}/raw_genes")
    found = m.counts.withColumn("layer", F.lit("X"))
    for name, values in (layers or {}).items():
        found = found.unionByName(values.withColumn("layer", F.lit(name)))
    found.write.mode("overwrite").partitionBy("layer").parquet(f"{path}/counts")
    if embeddings is not None:
        embeddings.write.mode("overwrite").partitionBy("key").parquet(f"{path}/embeddings")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/cells")


def read_genes(spark: SparkSession, path: str, group: str = "var") -> DataFrame:
    """The genes; ``raw/var`` are those of the raw layer, which default to the others."""
    if group == "raw/var" and exists(spark, f"{path}/raw_genes"):
        return spark.read.parquet(f"{path}/raw_genes")
    return spark.read.parquet(f"{path}/genes")


def read_counts(spark: SparkSession, path: str, layer: str = "X") -> DataFrame:
    """The values of a layer; an unknown one raises."""
    found = spark.read.parquet(f"{path}/counts")
    if found.where(F.col("layer") == layer).isEmpty():
        names = [r.layer for r in found.select("layer").distinct().orderBy("layer").collect()]
        if layer not in names:
            raise ValueError(f"no layer {layer!r}; there are {names}")
    return found.where(F.col("layer") == layer).drop("layer")


def read_matrix(spark: SparkSession, path: str, layer: str = "X") -> AnnotatedMatrix:
    genes = read_genes(spark, path, "raw/var" if layer == "raw.X" else "var")
    return AnnotatedMatrix(read_cells(spark, path), genes, read_counts(spark, path, layer))


def read_embedding(spark: SparkSession, path: str, key: str) -> DataFrame:
    found = spark.read.parquet(f"{path}/embeddings").where(F.col("key") == key).select("cell_id", "vec")
    if found.isEmpty():
        raise KeyError(f"no embedding {key!r}")
    return found


def decode_categories(cells: DataFrame, column: str, categories: DataFrame) -> DataFrame:
    """A column of codes as its labels; ``categories`` has code and label, unknown codes are null."""
    names = categories.select(F.col("code").alias(column), F.col("label").cast("string").alias("_label"))
    joined = cells.join(F.broadcast(names), column, "left")
    return joined.select(*[F.col("_label").alias(c) if c == column else F.col(c) for c in cells.columns])


def decode_text(column: str):
    """A column of bytes or anything else as text."""
    return F.decode(F.col(column).cast("binary"), "UTF-8")


def take_rows(m: AnnotatedMatrix, cell_ids: list[int]) -> DataFrame:
    """(row, cell_id, gene_id, value): the values of cells in the caller's order, a cell as often as it is named."""
    spark = m.cells.sparkSession
    wanted = spark.createDataFrame([(i, int(c)) for i, c in enumerate(cell_ids)], "row int, cell_id long")
    return F.broadcast(wanted).join(m.counts, "cell_id").select("row", "cell_id", "gene_id", "value")


def row_range(m: AnnotatedMatrix, start: int, end: int, pos: str = "cell_pos") -> DataFrame:
    """(cell_id, gene_id, value) of the cells at positions from ``start`` up to ``end``."""
    cells = m.cells.where((F.col(pos) >= start) & (F.col(pos) < end)).select("cell_id")
    return m.counts.join(cells, "cell_id", "left_semi")


# Names under which a run's embedding may lie, the first found wins.
LATENTS = ("benchmark_qz_mean", "analysis_qz_mean", "qz_mean")
LATENT_PAIRS = (("train_qz_mean", "val_qz_mean"), ("train_latent", "val_latent"))


def _latent(spark: SparkSession, path: str) -> DataFrame | None:
    """(cell_id, vec) of a Parquet table, or of an array file whose rows are numbered from 0; None if neither is there."""
    for place in (path, f"{path}.parquet"):
        if exists(spark, place):
            return spark.read.parquet(place)
    if not exists(spark, f"{path}.npy"):
        return None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0).to_pylist():
                x = np.load(io.BytesIO(content), allow_pickle=False).astype(float)
                for at in range(0, len(x), 10_000):
                    part = x[at : at + 10_000]
                    edges = pa.array(np.arange(0, part.size + 1, x.shape[1]), pa.int32())
                    vec = pa.ListArray.from_arrays(edges, pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part))), vec], names=["cell_id", "vec"])

    return spark.read.format("binaryFile").load(f"{path}.npy").select("content").mapInArrow(rows, "cell_id long, vec array<double>")


def load_latent(spark: SparkSession, run_dir: str, eval_subdir: str = "eval") -> DataFrame:
    """(cell_id, vec) of a run: its evaluation's, else those of train and val together.

    Rows of array files have no ids; those of val are numbered on behind those of train.
    """
    for name in LATENTS:
        found = _latent(spark, f"{run_dir}/{eval_subdir}/{name}")
        if found is not None:
            return found
    for names in LATENT_PAIRS:
        parts = [_latent(spark, f"{run_dir}/{n}") for n in names]
        if all(p is not None for p in parts):
            if exists(spark, f"{run_dir}/{names[1]}.npy"):
                parts[1] = parts[1].withColumn("cell_id", F.col("cell_id") + parts[0].count())
            return parts[0].unionByName(parts[1])
    raise FileNotFoundError(f"no embedding in {run_dir}")


def size_mb(spark: SparkSession, path: str) -> float:
    """The files below a path, in MB (0 if there are none)."""
    if not exists(spark, path):
        return 0.0
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength() / (1024 * 1024)


def load_split_cells(spark: SparkSession, path: str, splits: tuple[str, ...] = ("train", "val")) -> DataFrame:
    """The cells of the splits that are there; none at all raises."""
    found = [spark.read.parquet(p) for s in splits if exists(spark, p := f"{path}/{s}/cells")]
    if not found:
        raise FileNotFoundError(f"none of the splits {splits} in {path}")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def load_gene_list(path: str | Path) -> list[str]:
    """Names of a text file (a line each) or a JSON file (a list, or ``genes`` or ``hvg_genes`` of an object)."""
    text = Path(path).read_text()
    if str(path).endswith(".json"):
        data = json.loads(text)
        if isinstance(data, dict):
            key = next((k for k in ("genes", "hvg_genes") if k in data), None)
            if key is None:
                raise ValueError(f"neither 'genes' nor 'hvg_genes' in {path}")
            data = data[key]
        return [str(g) for g in data]
    return [line.strip() for line in text.splitlines() if line.strip()]
