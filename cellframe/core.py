"""The annotated matrix as DataFrames, and rules that all operators share.

Counts are held long: a row for each nonzero value of a cell and a gene. Absent
rows are zeros, so that means divide by the cells of a group, taken from the cells
table, never by the rows found.
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def no_column(name: str, table: str, df: DataFrame) -> ValueError:
    return ValueError(f"{table} have no {name!r}, only {', '.join(df.columns)}")


@dataclass(frozen=True)
class AnnotatedMatrix:
    """``cells`` (cell_id, ...), ``genes`` (gene_id, ...) and ``counts`` (cell_id, gene_id, value)."""

    cells: DataFrame
    genes: DataFrame
    counts: DataFrame

    def require(self, *columns: str) -> None:
        missing = [c for c in columns if c not in self.cells.columns]
        if missing:
            raise no_column(missing[0], "cells", self.cells)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    A local session (tests) without that setting gets a temporary one; on a cluster
    no folder of one machine would do, so that its absence is an error there.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if base:
        return base
    made = sc._jsc.sc().getCheckpointDir()
    if not made.isDefined():
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="cellframe-"))
        made = sc._jsc.sc().getCheckpointDir()
    return made.get()


def settled(df: DataFrame, name: str, with_path: bool = False) -> DataFrame | tuple[DataFrame, str]:
    """``df`` written to the shared folder and read back, where it is used repeatedly; and its path, if asked."""
    path = f"{shared_dir(df.sparkSession)}/cellframe/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    return (found, path) if with_path else found


def discard(spark: SparkSession, path: str) -> None:
    """Delete what ``settled`` wrote, once nothing reads it any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, null where ``b`` is 0 (division raises in ANSI mode)."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def rounded(column: Column, digits: int = 6) -> Column:
    """Rounded, with one zero only."""
    return F.round(column, digits) + F.lit(0.0)


def hash_key(id_col: str, seed: int) -> Column:
    """Stands for a random order that any engine can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def ranked_by_hash(rows: DataFrame, id_col: str, seed: int, stratum: str | None = None, name: str = "rank") -> DataFrame:
    """``rows`` with their rank, from 1, in the hash order of their stratum.

    A stratum may hold most of the rows, so it is never sorted as a whole: rows are
    ranked within the 4096 ranges of the hash, and each range is moved by the rows
    of those before it, which are counted beforehand.
    """
    by = [stratum] if stratum else []
    keyed = rows.withColumn("_hash", hash_key(id_col, seed)).withColumn("_range", F.substring("_hash", 1, 3))
    sizes = keyed.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(*by, "_range").orderBy("_hash", id_col))
    joined = keyed.withColumn("_within", within)
    on = [joined["_range"] == sizes["_range"], *[joined[c].eqNullSafe(sizes[c]) for c in by]]
    return joined.join(F.broadcast(sizes), on).select(
        *[joined[c] for c in rows.columns], (F.col("_within") + F.col("_before")).cast("long").alias(name)
    )


def largest_remainder(strata: DataFrame, size: Column, total: Column, name: str = "quota") -> DataFrame:
    """``strata`` (a small table with ``stratum``) with whole quotas that sum to ``total``.

    Each gets the floor of its proportional share; the rest goes, one each, to the
    largest remainders, ties to the later name.
    """
    whole = Window.partitionBy(F.lit(0))
    share = size * total / F.sum(size).over(whole)
    with_floor = strata.withColumn("_share", share.cast("double"))
    with_floor = with_floor.withColumn("_floor", F.floor("_share")).withColumn(
        "_left", F.round(total).cast("long") - F.sum("_floor").over(whole)
    )
    order = F.row_number().over(
        Window.partitionBy(F.lit(0)).orderBy((F.col("_share") - F.col("_floor")).desc(), F.col("stratum").desc())
    )
    return with_floor.withColumn(name, (F.col("_floor") + (order <= F.col("_left")).cast("long")).cast("long")).drop(
        "_share", "_floor", "_left"
    )


#: Of percentiles that only bracket the exact ones.
_ACCURACY = 10_000


def order_statistics(rows: DataFrame, by: list[str], value: str, ranks: dict[str, tuple[Column, float]]) -> DataFrame:
    """(by, n, one column for each of ``ranks``): exact order statistics of every group, none of which is sorted.

    ``ranks`` gives for each name the rank, from 1, as an expression in the group's
    number ``n`` of values that aren't null, and about which share of them it is. A
    sketch brackets each one; what lies below a bracket is counted, and only the few
    values inside are ordered. Where a sketch misses, its group's whole range is the bracket.
    """
    x = F.col(value).cast("double")
    keyed = rows.select(*by, x.alias("x")).where("x is not null and not isnan(x)")
    names = list(ranks)
    ends = []
    for name in names:
        share = ranks[name][1]
        for side, p in (("low", max(share - 3 / _ACCURACY, 0.0)), ("high", min(share + 3 / _ACCURACY, 1.0))):
            ends.append(F.percentile_approx("x", p, _ACCURACY).alias(f"{side}_{name}"))
    groups = keyed.groupBy(*by).agg(F.count("*").alias("n"), *ends)
    groups = groups.withColumns({f"rank_{name}": ranks[name][0].cast("long") for name in names})
    on = [F.col(f"g.{c}").eqNullSafe(F.col(f"k.{c}")) for c in by]
    both = keyed.alias("k").join(F.broadcast(groups.alias("g")), on) if by else keyed.alias("k").crossJoin(F.broadcast(groups.alias("g")))
    counts = both.groupBy(*[F.col(f"g.{c}").alias(c) for c in by]).agg(
        *[F.count(F.when(F.col("x") < F.col(f"low_{name}"), 1)).alias(f"under_{name}") for name in names],
        *[F.count(F.when(F.col("x") <= F.col(f"high_{name}"), 1)).alias(f"upto_{name}") for name in names],
    )
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    known = groups.alias("a").join(counts.alias("b"), same) if by else groups.alias("a").crossJoin(counts.alias("b"))
    whole = float("inf")
    stacked = []
    for name in names:
        hit = (F.col(f"under_{name}") < F.col(f"rank_{name}")) & (F.col(f"rank_{name}") <= F.col(f"upto_{name}"))
        stacked.append(
            F.struct(
                F.lit(name).alias("name"), F.col(f"rank_{name}").alias("rank"), F.when(hit, F.col(f"low_{name}")).otherwise(-whole).alias("low"),
                F.when(hit, F.col(f"high_{name}")).otherwise(whole).alias("high"), F.when(hit, F.col(f"under_{name}")).otherwise(0).alias("under"),
            )
        )
    brackets = settled(known.select(*[F.col(f"a.{c}").alias(c) for c in by], "n", F.explode(F.array(*stacked)).alias("s")).select(*by, "n", "s.*"), "brackets")
    inside = keyed.alias("k").join(F.broadcast(brackets.alias("g")), [*on, F.col("x") >= F.col("low"), F.col("x") <= F.col("high")])
    few = inside.groupBy(*[F.col(f"g.{c}").alias(c) for c in by], "n", "name", "rank", "under", "x").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*by, "name").orderBy("x")) + F.col("under")
    found = few.withColumn("upto", upto).where("upto >= rank").groupBy(*by, "n").pivot("name", names).agg(F.min("x"))
    return found


def percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by, n, one column for each of ``shares``): exact percentiles, linear between the two nearest values."""
    ranks = {}
    for name, p in shares.items():
        place = (F.col("n") - 1) * F.lit(float(p))
        ranks[f"{name}_low"], ranks[f"{name}_high"] = (F.floor(place) + 1, p), (F.ceil(place) + 1, p)
    found = order_statistics(rows, by, value, ranks)
    between = {name: (F.col("n") - 1) * F.lit(float(p)) - F.floor((F.col("n") - 1) * F.lit(float(p))) for name, p in shares.items()}
    return found.select(*by, "n", *[(F.col(f"{k}_low") + w * (F.col(f"{k}_high") - F.col(f"{k}_low"))).alias(k) for k, w in between.items()])
