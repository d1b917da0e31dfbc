"""Connected components and joins with hot keys against plain definitions."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from cellframe import core, links


def roots(pairs):
    parent = {n: n for p in pairs for n in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in parent}


@pytest.mark.parametrize("most_in_task", [0, 200_000])
def test_components_of_hubs_and_chains(spark, most_in_task):
    order = random.Random(4).sample(range(10_000, 11_000), 40)
    pairs = [(1, k) for k in range(2, 800)] + [(k, k + 1) for k in range(5000, 5060)] + [(5060, 799)] + list(itertools.pairwise(order))
    rows = spark.createDataFrame([*pairs, (7777, 7777), (None, 3), (4, None)], "src long, dst long").repartition(5)
    got = {r.node: r.root for r in links.components(rows, most_in_task=most_in_task).collect()}
    assert got == roots(pairs)
    assert links.components(rows.where("false"), most_in_task=most_in_task).count() == 0


def test_scratch_tables_go(spark):
    found, path = core.settled(spark.range(3).toDF("x"), "gone", True)
    assert found.count() == 3
    core.discard(spark, path)
    with pytest.raises(Exception, match="(?i)not.?found|does not exist"):
        spark.read.parquet(path)


def test_hot_keys_join_like_any_other(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("long").alias("k"))
    rows = rows.unionByName(spark.createDataFrame([(9999, None)], "id long, k long"))
    one = rows.where("k % 5 != 1 and k is not null").groupBy("k").agg(F.min("id").alias("m"), F.count("*").alias("n"))
    want = sorted(map(tuple, rows.join(one.drop("n"), "k").collect()))
    for total, least in ((3000, 128), (3000, 1), (10, 128), (0, 0)):
        assert sorted(map(tuple, links.join_hot(rows, one, "k", total, least).select("k", "id", "m").collect())) == want
