"""Jobs that write: standardized matrices by split, and training datasets."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import AnnotatedMatrix
from ..operators import encoding, preprocess
from ..operators.pearson import library_depth
from ..sources import tables


#: The greatest number of types that hold whole counts.
WHOLE = {"byte": 2**7 - 1, "short": 2**15 - 1, "int": 2**31 - 1}


def build_standardized(
    m: AnnotatedMatrix, splits: DataFrame, output: str, cell_type: str, batch: str, dataset: str,
    variable: DataFrame | None = None, target_sum: float = 1e4, extra: dict[str, str] | None = None,
    embeddings: DataFrame | None = None,
) -> DataFrame:
    """Write counts, normalized values, cells, genes and embeddings by split; return the splits' stats.

    One plan for any size: Spark streams and spills where a single process would
    choose between holding all and passing over the file once a split.
    """
    cells = preprocess.standardize_cells(m.cells, library_depth(m), cell_type, batch, dataset, extra).join(splits, "cell_id")
    of = cells.select("cell_id", "split")
    normalized = preprocess.normalize(m, target_sum)
    genes = preprocess.build_genes(m.genes, variable)
    for name, rows in (("cells", cells), ("counts", m.counts.join(of, "cell_id")), ("normalized", normalized.join(of, "cell_id"))):
        rows.write.mode("overwrite").partitionBy("split").parquet(f"{output}/{name}")
    genes.write.mode("overwrite").parquet(f"{output}/genes")
    if embeddings is not None:
        embeddings.join(of, "cell_id").write.mode("overwrite").partitionBy("split").parquet(f"{output}/embeddings")
    names = ("cells", "counts", "normalized", "embeddings")
    sizes = [(s, sum(tables.size_mb(cells.sparkSession, f"{output}/{n}/split={s}") for n in names)) for s in ("train", "val", "test")]
    files = cells.sparkSession.createDataFrame(sizes, "split string, file_size_mb double")
    return preprocess.split_stats(cells, m.counts, normalized).join(files, "split")


def dataset_rows(
    m: AnnotatedMatrix, genes: DataFrame, schema: encoding.ConditionSchema | None = None, label: str | None = None, dtype: str = "float"
) -> DataFrame:
    """(cell_id, counts, condition, label): dense counts over ``genes`` (with ``column``), vector and label number.

    Without a label column the label is 0. Labels are numbered in their order. A
    ``dtype`` of whole numbers (``short`` halves the space) takes counts that it can hold;
    others raise.
    """
    if dtype in WHOLE:
        limit = WHOLE[dtype]
        x = F.col("value").cast("double")
        bad = m.counts.where((x != F.round(x)) | (x < -limit - 1) | (x > limit)).limit(1).count()
        if bad:
            raise ValueError(f"counts that {dtype} can't hold")
    width = genes.count()
    dense = preprocess.dense_rows(m.cells, m.counts, genes, width).select("cell_id", F.col("row").cast(f"array<{dtype}>").alias("counts"))
    vector = encoding.condition_vector(schema) if schema is not None else F.array().cast("array<float>")
    named = m.cells.select("cell_id", vector.alias("condition"), (F.col(f"`{label}`").cast("string") if label else F.lit(None).cast("string")).alias("_label"))
    if label:
        index = encoding.label_index(m.cells, label)
        named = named.join(F.broadcast(index), F.col("_label") == F.col("label"), "left").select("cell_id", "condition", F.col("idx").alias("label"))
    else:
        named = named.select("cell_id", "condition", F.lit(0).cast("long").alias("label"))
    return dense.join(named, "cell_id")


def chunked(rows: DataFrame, positions: DataFrame, chunk_size: int) -> DataFrame:
    """``rows`` with ``chunk``: the number of the run of ``chunk_size`` positions that a cell is in."""
    return rows.join(positions.select("cell_id", F.floor(F.col("cell_pos") / chunk_size).cast("int").alias("chunk")), "cell_id")


def chunk_sizes(positions: DataFrame, chunk_size: int) -> DataFrame:
    """(chunk, n_cells)."""
    return positions.groupBy(F.floor(F.col("cell_pos") / chunk_size).cast("int").alias("chunk")).agg(F.count("*").alias("n_cells"))


def build_dataset(
    spark: SparkSession, input_path: str, output: str, gene_list: list[str] | None = None, gene_col: str | None = None,
    label: str | None = None, numerical: list[str] | None = None, categorical: list[str] | None = None,
    chunk_size: int = 50_000, save_schema: str | None = None, load_schema: str | None = None,
    output_format: str = "split", split: str = "train", counts_dtype: str = "float", layer: str = "X", batch_key: str | None = None,
) -> bool:
    """Write a training dataset and its metadata; False where the input isn't there.

    ``split`` writes one folder for the split, ``chunks`` one for each run of cells.
    A loaded schema stands for the specifications. Each split has metadata of its own.
    """
    if not tables.exists(spark, input_path):
        return False
    if output_format not in ("split", "chunks"):
        raise ValueError(f"unknown format {output_format!r}")
    m = tables.read_matrix(spark, input_path, layer)
    genes = preprocess.resolve_genes(m.genes, gene_list, gene_col)
    if load_schema:
        schema = encoding.ConditionSchema.load(load_schema)
    else:
        specs = [s for c in categorical or [] for s in encoding.parse_categorical(c)]
        schema = encoding.build_schema(m.cells, [encoding.parse_numerical(n) for n in numerical or []], specs, batch_key=batch_key)
    encoding.check_categories(m.cells, schema)
    if save_schema:
        schema.save(save_schema)
    rows = dataset_rows(m, genes, schema, label, counts_dtype)
    positions = m.cells.select("cell_id", "cell_pos")
    target = f"{output}/{split}"
    if output_format == "chunks":
        chunked(rows, positions, chunk_size).write.mode("overwrite").partitionBy("chunk").parquet(target)
    else:
        rows.join(positions, "cell_id").write.mode("overwrite").parquet(target)
    sizes = {r.chunk: r.n_cells for r in chunk_sizes(positions, chunk_size).collect()} if output_format == "chunks" else {}
    names = [r.gene_name for r in genes.orderBy("column").select("gene_name").collect()]
    labels = {r.label: r.idx for r in encoding.label_index(m.cells, label).collect()} if label else {}
    metadata = {
        "format": output_format, "counts_dtype": counts_dtype, "n_genes": len(names), "gene_names": names, "n_cond": schema.n_cond,
        "condition_columns": [c.name for c in schema.columns], "labels": labels, "n_cells": m.cells.count(),
        **({"n_chunks": len(sizes), "chunk_sizes": [sizes[k] for k in sorted(sizes)]} if sizes else {}),
    }
    spark.createDataFrame([(json.dumps(metadata),)], "value string").coalesce(1).write.mode("overwrite").text(f"{output}/metadata/{split}")
    return True


def load_metadata(spark: SparkSession, output: str, split: str = "train") -> dict:
    """Metadata of a split, else that of the whole dataset."""
    for place in (f"{output}/metadata/{split}", f"{output}/metadata"):
        if tables.exists(spark, place):
            return json.loads(spark.read.text(place).first().value)
    raise FileNotFoundError(f"no metadata in {output}")


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description="Build a training dataset from an annotated matrix")
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    which = p.add_mutually_exclusive_group()
    which.add_argument("--gene-list")
    which.add_argument("--gene-col")
    p.add_argument("--cell-type-label-col")
    p.add_argument("--numerical-cond", action="append", default=[])
    p.add_argument("--cat-cond", action="append", default=[])
    p.add_argument("--batch-key")
    p.add_argument("--save-schema")
    p.add_argument("--load-schema")
    p.add_argument("--format", choices=("split", "chunks"), default="split")
    p.add_argument("--split", default="train")
    p.add_argument("--layer", default="X")
    p.add_argument("--counts-dtype", choices=("float", "double", *WHOLE), default="float")
    p.add_argument("--chunk-size", type=int, default=50_000)
    a = p.parse_args(args)
    done = build_dataset(
        SparkSession.builder.getOrCreate(), a.input, a.output, tables.load_gene_list(Path(a.gene_list)) if a.gene_list else None, a.gene_col,
        a.cell_type_label_col, a.numerical_cond, a.cat_cond, a.chunk_size, a.save_schema, a.load_schema, a.format, a.split, a.counts_dtype,
        a.layer, a.batch_key,
    )
    return 0 if done else 1


if __name__ == "__main__":
    raise SystemExit(main())
