"""The driver tables as an annotated matrix, and the same views in SQL.

Orders are cells, parts (or their brands) genes, quantities counts, embeddings latents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import AnnotatedMatrix

CELLS = """cells AS (SELECT o_orderkey AS cell_id, o_orderkey AS cell_pos, o_orderpriority AS cell_type, o_orderstatus AS batch,
    c_mktsegment AS tissue, o_totalprice AS total FROM orders JOIN customer ON o_custkey = c_custkey)"""
FINE = """counts AS (SELECT l_orderkey AS cell_id, l_partkey AS gene_id, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2),
    genes AS (SELECT p_partkey AS gene_id, p_name AS gene_name, p_partkey AS gene_pos FROM part)"""
COARSE = """counts AS (SELECT l_orderkey AS cell_id, p_brand AS gene_id, sum(l_quantity) AS value
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), genes AS (SELECT DISTINCT p_brand AS gene_id FROM part)"""
LATENT = """latent AS (SELECT vec_id AS cell_id, CAST(embedding AS DOUBLE[]) AS vec, CAST(label AS VARCHAR) AS cell_type,
    CAST(vec_id % 3 AS VARCHAR) AS batch FROM embeddings)"""
POINTS = """points AS (SELECT cell_id, vec[1] AS x, vec[2] AS y, vec[3] AS z, 1 + CAST(cell_type AS DOUBLE) AS w, cell_type FROM latent)"""

# A few gene symbols for the patterns to meet.
SYMBOLS = (
    "MT-CO1 MT-ND1 RPS6 RPL13 RPLP0 RPSA HBA1 HBB MT1X MT2A HSPA1A DNAJB1 FOS JUN EGR1 MKI67 TOP2A PCNA HIST1H4C "
    "AC012345.1 AL1234 LOC100 LINC00511 MIR21 SNORD3A GAS5 MALAT1 XIST RPS4Y1 IGKC IGHV1-2 IGLC2 TRBV GAPDH ACTB B2M "
    "CD3E CD8A FOXP1-AS1 Gm1234 Rps6 Hbb mt-Nd1 Mt1 Igkv1 RGD1560 Hist1h4c CD8A CD3E CD8A"
).split()


def cells(spark: SparkSession, d: str) -> DataFrame:
    orders = spark.read.parquet(f"{d}/orders.parquet")
    customer = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_mktsegment")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey").alias("cell_id"), F.col("o_orderkey").alias("cell_pos"), F.col("o_orderpriority").alias("cell_type"),
        F.col("o_orderstatus").alias("batch"), F.col("c_mktsegment").alias("tissue"), F.col("o_totalprice").alias("total"),
    )


def matrix(spark: SparkSession, d: str, coarse: bool = False) -> AnnotatedMatrix:
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_quantity")
    part = spark.read.parquet(f"{d}/part.parquet")
    if coarse:
        lines = lines.join(part.select("p_partkey", "p_brand"), lines.l_partkey == part.p_partkey)
        gene, genes = "p_brand", part.select(F.col("p_brand").alias("gene_id")).distinct()
    else:
        gene = "l_partkey"
        genes = part.select(F.col("p_partkey").alias("gene_id"), F.col("p_name").alias("gene_name"), F.col("p_partkey").alias("gene_pos"))
    counts = lines.groupBy(F.col("l_orderkey").alias("cell_id"), F.col(gene).alias("gene_id")).agg(F.sum("l_quantity").alias("value"))
    return AnnotatedMatrix(cells(spark, d), genes, counts)


def latent(spark: SparkSession, d: str) -> DataFrame:
    """(cell_id, vec, cell_type, batch)."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select(
        F.col("vec_id").alias("cell_id"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("string").alias("cell_type"),
        (F.col("vec_id") % 3).cast("string").alias("batch"),
    )


def latent_many(spark: SparkSession, d: str, times: int) -> DataFrame:
    """``latent`` with ``times`` cells for each, moved a little by a hash: for measuring at larger sizes."""
    rows = latent(spark, d).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    moved = F.transform("vec", lambda x, i: x + (F.pmod(F.xxhash64("cell_id", "copy", i), F.lit(1000)) / 1000.0 - 0.5) * 0.1)
    return rows.select((F.col("cell_id") * times + F.col("copy")).alias("cell_id"), moved.alias("vec"), "cell_type", "batch")


def points(spark: SparkSession, d: str) -> DataFrame:
    v = latent(spark, d)
    return v.select(
        "cell_id", F.get("vec", F.lit(0)).alias("x"), F.get("vec", F.lit(1)).alias("y"), F.get("vec", F.lit(2)).alias("z"),
        (1 + F.col("cell_type").cast("double")).alias("w"), "cell_type",
    )


def symbols(spark: SparkSession) -> DataFrame:
    rows = [(i, s, i % 2 == 0) for i, s in enumerate(SYMBOLS)]
    return spark.createDataFrame(rows, "gene_pos long, gene_name string, highly_variable boolean")


def symbols_sql() -> str:
    rows = ", ".join(f"({i}, '{s}', {str(i % 2 == 0).lower()})" for i, s in enumerate(SYMBOLS))
    return f"symbols AS (SELECT CAST(gene_pos AS BIGINT) AS gene_pos, gene_name, highly_variable FROM (VALUES {rows}) t(gene_pos, gene_name, highly_variable))"
