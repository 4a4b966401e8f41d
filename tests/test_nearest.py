import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.functions import geom
from netloom.operators import nearest, segments

LEFT = "image_id bigint, p bigint, lx bigint, ly bigint, ci bigint"
RIGHT = "image_id bigint, q bigint, rx bigint, ry bigint, cq bigint"


def plain(left, right, d, owned):
    out = {}
    for i, p, x, y, c in left:
        best = min(((d(x - rx, y - ry), q) for j, q, rx, ry, o in right if i == j and not (owned and c == o)), default=None)
        if best:
            out[p] = best
    return out


@pytest.mark.parametrize("seed,owned,size", [(1, False, 60), (2, True, 60), (3, True, 4000), (4, False, 100_000), (5, True, 12)])
def test_equals_all_pairs(spark, monkeypatch, seed, owned, size):
    monkeypatch.setattr(nearest, "DIRECT", 3)
    rng = random.Random(seed)
    place = lambda: (rng.randrange(-size, size), rng.choice([0, rng.randrange(size)]))
    left = [(rng.randrange(3), p, *place(), rng.randrange(4)) for p in range(250)]
    right = [(rng.randrange(2), q, *place(), rng.randrange(4) if seed != 5 else 1) for q in range(200)]
    metric, d = (geom.dist, math.hypot) if owned else (geom.manhattan, lambda x, y: abs(x) + abs(y))
    found = nearest.nearest(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["image_id"], ["p"], ["q"], metric, owners=("ci", "cq") if owned else None)
    got = {r.p: (r.best.d, r.best.q) for r in found.collect()}
    want = plain(left, right, d, owned)
    assert got.keys() == want.keys() and len(want) > 50
    assert all(got[p][0] == pytest.approx(want[p][0]) and got[p][1] == want[p][1] for p in want)


def test_two_crowds_far_apart(spark):
    """A far crowd is not met as a whole: the pairs compared are few beside all pairs."""
    rng = np.random.default_rng(1)
    at = lambda n, x: rng.integers(0, 1500, (n, 2)) + [x, 0]
    a, b = at(8000, 0), at(2000, 50_000)
    left = spark.createDataFrame([(1, i, int(x), int(y), 0) for i, (x, y) in enumerate(a)], LEFT)
    right = spark.createDataFrame([(1, i, int(x), int(y), 0) for i, (x, y) in enumerate(b)], RIGHT)
    sides = left.selectExpr("image_id", "lx AS lpx", "ly AS lpy", "0 AS lowner").distinct(), right.selectExpr("image_id", "rx AS rpx", "ry AS rpy", "0 AS rowner").distinct()
    pairs = sum(p.count() for p in nearest.compared_places(*sides, ["image_id"], geom.manhattan))
    assert pairs < 0.02 * len(a) * len(b)
    got = {r.p: r.best.d for r in nearest.nearest(left, right, ["image_id"], ["p"], ["q"], geom.manhattan).collect()}
    for i in range(0, 8000, 97):
        assert got[i] == np.abs(b - a[i]).sum(1).min()


def test_one_far_text_and_many_components(spark):
    left = spark.range(100_000).select(F.lit(1).cast("bigint").alias("image_id"), F.col("id").alias("p"), (F.col("id") % 1000).alias("lx"), F.floor(F.col("id") / 1000).alias("ly"), F.col("id").alias("ci"))
    right = spark.createDataFrame([(1, 7, 900_000, 900_000, 0)], RIGHT)
    got = nearest.nearest(left, right, ["image_id"], ["p"], ["q"], geom.manhattan)
    assert got.where("best.q = 7").count() == 100_000
    assert nearest.nearest(left.limit(0), right, ["image_id"], ["p"], ["q"], geom.manhattan).count() == 0
    assert nearest.nearest(left, right.limit(0), ["image_id"], ["p"], ["q"], geom.manhattan).count() == 0


def test_many_in_one_spot_give_few_edges(spark):
    """A star of segments, and copies of one spot on both sides of a search."""
    rng = random.Random(3)
    rows = [(1, s, 500 + rng.randrange(6), 500 + rng.randrange(6), rng.randrange(1000), rng.randrange(1000)) for s in range(400)] + [(1, 900, 0, 2000, 0, 2100), (2, 5, 500, 500, 1, 1)]
    segs = spark.createDataFrame(rows, "image_id bigint, seg bigint, x1 bigint, y1 bigint, x2 bigint, y2 bigint")
    got = {(r.image_id, r.seg): r.g for r in segments.wire_groups(segs).collect()}
    assert got == {(i, s): (900 if s == 900 else 5 if i == 2 else 0) for i, s, *_ in rows}


@pytest.mark.parametrize("seed,threshold", [(1, 12), (2, 5), (3, 1)])
def test_wires_equal_all_pairs(spark, seed, threshold):
    rng = random.Random(seed)
    segs = [(1, s, *(rng.randrange(-90, 90) for _ in range(4))) for s in range(60)]
    ends = {s: [(a, b), (c, d)] for _, s, a, b, c, d in segs}
    root = {s: s for s in ends}
    for s in ends:
        for t in ends:
            if any(math.dist(p, q) <= threshold for p in ends[s] for q in ends[t]) and root[s] != root[t]:
                low, high = sorted((root[s], root[t]))
                root = {k: low if v == high else v for k, v in root.items()}
    frame = spark.createDataFrame(segs, "image_id bigint, seg bigint, x1 bigint, y1 bigint, x2 bigint, y2 bigint")
    assert {r.seg: r.g for r in segments.wire_groups(frame, threshold).collect()} == root
