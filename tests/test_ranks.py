import hashlib
import random

import pytest
from pyspark.sql import functions as F

from netloom.operators import ranks


@pytest.fixture()
def rows():
    rnd = random.Random(1)
    out = [(1, x) for x in rnd.sample(range(10_000), 700)] + [(g, x) for g in range(2, 40) for x in rnd.sample(range(10_000), 5)]
    rnd.shuffle(out)
    return out


def _want(rows):
    return {(g, x): sorted(y for h, y in rows if h == g).index(x) + 1 for g, x in rows}


def test_hot_and_cold_groups(spark, rows):
    df = spark.createDataFrame(rows, "g long, x long")
    guard = ranks.SkewGuard(df, ["g"], limit=100)
    got = ranks.row_number(df, ["g"], ["x"], "n", guard=guard)
    assert guard.hot.count() == 1
    assert {(r.g, r.x): r.n for r in got.collect()} == _want(rows)
    plain = ranks.row_number(df, ["g"], ["x"], "n", start=0)
    assert {(r.g, r.x): r.n + 1 for r in plain.collect()} == _want(rows)


def test_hot_group_is_spread(spark, rows):
    df = spark.createDataFrame(rows, "g long, x long").where("g = 1")
    laid = df.repartitionByRange(4, "g", "x").groupBy(F.spark_partition_id()).count().collect()
    assert len(laid) > 1 and max(r[1] for r in laid) < 700


def test_global_number(spark, rows):
    got = ranks.global_number(spark.createDataFrame(rows, "g long, x long"), ["g", "x"], "n", start=0)
    order = sorted(rows)
    assert {(r.g, r.x): r.n for r in got.collect()} == {v: i for i, v in enumerate(order)}


def test_cutoff(spark):
    digests = sorted(hashlib.md5(str(i).encode()).hexdigest() for i in range(3000))
    df = spark.range(3000).select(F.md5(F.col("id").cast("string")).alias("h"))
    for k in (1, 17, 2550, 3000):
        assert ranks.cutoff_value(df, F.col("h"), k) == digests[k - 1]
    assert ranks.cutoff_value(df, F.col("h"), 0) is None


def test_renamed_guard(spark):
    df = spark.range(300).select(F.when(F.col("id") < 250, 1).otherwise(F.col("id")).alias("g"))
    guard = ranks.SkewGuard(df, ["g"], limit=100)
    assert [r[0] for r in guard.renamed("h").hot.select("h").collect()] == [1]
