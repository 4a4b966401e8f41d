"""The test of a segment against a box: exact, and small enough to be compiled."""

import random
import re

from pyspark.sql import functions as F

from netloom.functions import geom
from netloom.operators import wiring

S, R = ("ax", "ay", "bx", "by"), ("x1", "y1", "x2", "y2")


def meets(s, r) -> bool:
    """Does a point of the closed segment lie in the closed box? Exact clipping of the segment's parameter."""
    from fractions import Fraction
    low, high = Fraction(0), Fraction(1)
    for a, b, near, far in ((s[0], s[2], r[0], r[2]), (s[1], s[3], r[1], r[3])):
        if a == b:
            if not near <= a <= far:
                return False
            continue
        t = sorted((Fraction(near - a, b - a), Fraction(far - a, b - a)))
        low, high = max(low, t[0]), min(high, t[1])
    return low <= high


def test_segment_against_box(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(20_000):
        x, y = rng.randrange(6), rng.randrange(6)
        rows.append((*(rng.randrange(9) for _ in S), x, y, x + rng.randrange(4), y + rng.randrange(4)))
    df = spark.createDataFrame(rows, ", ".join(f"{c} bigint" for c in (*S, *R)))
    got = df.withColumn("hit", geom.segment_meets_box(tuple(F.col(c) for c in S), geom.box(""))).collect()
    assert {r.hit for r in got} == {True, False}
    assert [r.hit for r in got] == [meets(r[:4], r[4:8]) for r in got]


def test_joins_with_the_test_are_compiled(spark, capsys):
    """The JVM only interprets methods of more than 8000 bytes."""
    name = "spark.sql.adaptive.enabled"
    comps = spark.createDataFrame([(1, 0, "Diode", 0, 0, 9, 9)], "image_id bigint, idx bigint, name string, x1 bigint, y1 bigint, x2 bigint, y2 bigint")
    legs = [("px", "py", "mx", "my"), ("mx", "my", "qx", "qy")]
    lines = spark.createDataFrame([(1, 7, 1, 1, 2, 2, 30, 30)], "image_id bigint, own bigint, px bigint, py bigint, mx bigint, my bigint, qx bigint, qy bigint")
    spark.conf.set(name, "false")
    try:
        wiring._unmet(lines.hint("merge"), comps, F.col("own"), legs).explain("codegen")
    finally:
        spark.conf.set(name, "true")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) <= 8000
