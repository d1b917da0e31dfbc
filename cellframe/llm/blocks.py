"""Dealing the members of buckets to tasks, hot buckets in pairs of shards.

A bucket holds rows that have to be compared with one another. Most hold a few.
One with very many would go to a single task; it is cut in shards, and each pair
of shards is a group of its own, so that every two members still meet, in one
group exactly (two members of one shard: in the group of that shard alone).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS

#: A bucket stays whole up to this many rows, however small the partitions are.
LEAST_SHARD = 128


def deal(
    rows: DataFrame, id_col: str, least: int = LEAST_SHARD, most: int | None = None, times: float = 4, carry: DataFrame | None = None
) -> DataFrame:
    """``rows`` (with a ``bucket`` column), as groups of rows to compare.

    Adds ``i``, ``j`` (a group is bucket, i, j) and ``shard`` (equal to i or j),
    drops buckets of one row, and leaves each group whole and sorted in one
    partition. A bucket is hot beyond ``times`` the rows of an even partition, so
    that there are few hot ones; ``most`` lowers that, for comparisons that cost
    more. The list of hot buckets is broadcast if it is short. ``carry`` has a row
    for each ``id_col``, with columns that are joined once it is known which rows
    have others to meet: what is large doesn't move with the rest.
    """
    spark = rows.sparkSession
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    total = counts.agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / 200_000))
    shard = max(least, math.ceil(times * total / parts))
    if most is not None:
        shard = min(shard, most)
    hot = counts.where(F.col("n") > shard).select(
        "bucket", F.ceil(F.col("n") / F.lit(shard)).cast("int").alias("r")
    )
    single = counts.where("n > 1").select("bucket")
    live = rows.join(single, "bucket", "left_semi")
    short = most is None or total <= BROADCAST_IDS * most
    live = live.join(F.broadcast(hot) if short else hot, "bucket", "left")
    own = F.when(
        F.col("r").isNull(), F.lit(0)
    ).otherwise(F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.col("r")).cast("int"))
    live = live.withColumn("shard", own)
    other = F.when(F.col("r").isNull(), F.array(F.lit(0))).otherwise(
        F.sequence(F.lit(0), F.col("r") - 1)
    )
    live = live.withColumn("other", F.explode(other))
    live = live.withColumn("i", F.least("shard", "other")).withColumn("j", F.greatest("shard", "other"))
    live = live.drop("r", "other")
    if carry is not None:
        live = live.join(carry, id_col)
    return (
        live
        .repartition(parts, "bucket", "i", "j")
        .sortWithinPartitions("bucket", "i", "j")
    )


def group_starts(*keys: np.ndarray) -> np.ndarray:
    """Where the groups of equal keys begin in sorted columns."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)
