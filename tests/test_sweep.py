import math
import random

import pytest
from pyspark.sql import functions as F

from netloom.operators import sweep

PORTS = "image_id bigint, ci bigint, pi int, px bigint, py bigint, gnd boolean, on boolean"
BOXES = "image_id bigint, idx bigint, x1 bigint, y1 bigint, x2 bigint, y2 bigint"
POINTS = "image_id bigint, x bigint, y bigint, jord struct<s:int,a:bigint>, align double, most double, pins array<struct<ci:bigint,pins:array<int>>>, live boolean"


def in_sight(ports, boxes, band):
    out = set()
    for a in ports:
        for b in ports:
            if a[0] != b[0] or a[1] >= b[1] or (a[5] and b[5]) or (a[6] and b[6]):
                continue
            dx, dy = abs(a[3] - b[3]), abs(a[4] - b[4])
            level = dy < band and dx > 5
            if not level and not (dx < band and dy > 5):
                continue
            (p, q, m), cols = ((a[3], b[3], a[4]), (2, 4, 3, 5)) if level else ((a[4], b[4], a[3]), (3, 5, 2, 4))
            if any(k[0] == a[0] and k[1] not in (a[1], b[1]) and k[cols[1]] > min(p, q) + 5 and k[cols[0]] < max(p, q) - 5
                   and k[cols[2]] < m + band and k[cols[3]] > m - band for k in boxes):
                continue
            out.add((a[0], a[1], a[2], b[1], b[2], a[3], a[4], b[3], b[4]))
    return out


@pytest.mark.parametrize("seed,size", [(1, 300), (2, 120), (3, 800)])
def test_sight_equals_all_pairs(spark, seed, size):
    rng = random.Random(seed)
    ports, boxes = [], []
    for image in range(2):
        for c in range(45):
            x, y = rng.randrange(-40, size), rng.randrange(-40, size)
            boxes.append((image, c, x, y, x + rng.randrange(60), y + rng.randrange(60)))
            for p in range(rng.randrange(4)):
                ports.append((image, c, p, x + rng.randrange(-8, 60), y + rng.randrange(-8, 60), rng.random() < 0.2, rng.random() < 0.5))
    got = sweep.ports_in_sight(spark.createDataFrame(ports, PORTS), spark.createDataFrame(boxes, BOXES), 25).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == in_sight(ports, boxes, 25) != set()


def test_a_lane_of_ten_thousand_ports(spark):
    """Each port sees the next component only: work and rows stay in proportion to the ports."""
    n = 5000
    ports = spark.range(2 * n).select(F.lit(1).cast("bigint").alias("image_id"), F.floor(F.col("id") / 2).alias("ci"), (F.col("id") % 2).cast("int").alias("pi"),
                                      (F.floor(F.col("id") / 2) * 100 + (F.col("id") % 2) * 40).alias("px"), F.lit(10).cast("bigint").alias("py"),
                                      F.lit(False).alias("gnd"), F.lit(False).alias("on"))
    boxes = spark.range(n).select(F.lit(1).cast("bigint").alias("image_id"), F.col("id").alias("idx"), (F.col("id") * 100).alias("x1"), F.lit(0).cast("bigint").alias("y1"),
                                  (F.col("id") * 100 + 40).alias("x2"), F.lit(20).cast("bigint").alias("y2"))
    got = sweep.ports_in_sight(ports, boxes, 25)
    assert got.count() == 4 * (n - 1) and got.where("ib <> ia + 1").isEmpty()


def nearest(points):
    out = set()
    for a in points:
        for way, (sx, sy) in enumerate([(-1, 0), (1, 0), (0, -1), (0, 1)]):
            best = None
            for b in points:
                dx, dy = b[1] - a[1], b[2] - a[2]
                if a[0] != b[0] or a[3] == b[3] or (abs(dy) >= a[4] or dx * sx <= 0 if sx else abs(dx) >= a[4] or dy * sy <= 0):
                    continue
                d = math.hypot(dx, dy)
                line = ((abs(dy) < a[4] and abs(dx) > 10) or (abs(dx) < a[4] and abs(dy) > 10)) and d < a[5]
                p, q = dict(a[6]), dict(b[6])
                refused = any(p[c] != q[c] for c in p.keys() & q.keys()) or (p and p.keys() == q.keys()) or not (a[7] or b[7])
                rank = (d, min(a[3], b[3]), max(a[3], b[3]))
                if (d < 12 or line) and not refused and (best is None or rank < best[0]):
                    best = rank, b[1], b[2]
            if best:
                out.add((a[0], a[1], a[2], best[1], best[2], way))
    return out


@pytest.mark.parametrize("seed,align,size", [(1, 20.0, 200), (2, 7.5, 60), (3, 25.0, 900)])
def test_nearest_equals_all_pairs(spark, seed, align, size):
    rng = random.Random(seed)
    spots = rng.sample([(i, x, y) for i in range(2) for x in range(0, size, 3) for y in range(0, size, 4)], 140)
    points = [(i, x, y, (k % 3, k), align, 150.0, [(c, sorted(rng.sample(range(3), rng.randrange(1, 3)))) for c in rng.sample(range(6), rng.randrange(3))], rng.random() < 0.7)
              for k, (i, x, y) in enumerate(spots)]
    got = sweep.nearest_valid(spark.createDataFrame(points, POINTS)).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == nearest(points) != set()


def test_no_points(spark):
    assert sweep.nearest_valid(spark.createDataFrame([], POINTS)).collect() == []
    assert sweep.ports_in_sight(spark.createDataFrame([], PORTS), spark.createDataFrame([], BOXES), 25).collect() == []
