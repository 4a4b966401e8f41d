"""Nearest partner at any distance, by bounds between the cells of a pyramid.

Both sides lie in square cells whose side falls by FACTOR from level to level. A pair of cells has a least and a greatest
distance of its points; a cell of the left side keeps only those cells of the right side whose least distance is at most
the smallest greatest one. Where few right places are left, left and right places are compared; the other cells are split.
Places that hold several points count once, so the work depends on how places lie, neither on the number of points nor on
how far apart the two sides are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from netloom.lineage import count_all, cut, cut_counting

FACTOR, DIRECT = 4, 64
NOBODY = 0


def _cell(v: str, size: int) -> Column:
    return F.floor(F.col(v) / size).cast("bigint")


def _stats(places: DataFrame, keys: list[str], p: str, size: int) -> DataFrame:
    """Occupied cells (p_x, p_y) with the box of their places, the places and the range of owners."""
    ends = [f(c).alias(f"{p}{n}") for c, names in ((f"{p}px", ("x1", "x2")), (f"{p}py", ("y1", "y2")), (f"{p}owner", ("o1", "o2"))) for f, n in zip((F.min, F.max), names)]
    return places.groupBy(*keys, _cell(f"{p}px", size).alias(f"{p}x"), _cell(f"{p}py", size).alias(f"{p}y")).agg(*ends, count_all().alias(f"{p}n"))


def _bounds(metric: Callable) -> tuple[Column, Column]:
    zero = F.lit(0)
    gap = lambda a: F.greatest(zero, F.col(f"r{a}1") - F.col(f"l{a}2"), F.col(f"l{a}1") - F.col(f"r{a}2"))
    far = lambda a: F.greatest(F.abs(F.col(f"r{a}2") - F.col(f"l{a}1")), F.abs(F.col(f"l{a}2") - F.col(f"r{a}1")))
    return metric(zero, zero, gap("x"), gap("y")), metric(zero, zero, far("x"), far("y"))


def compared_places(left: DataFrame, right: DataFrame, keys: list[str], metric: Callable, owned: bool = False, direct: int = DIRECT) -> list[DataFrame]:
    """Pairs of places to compare, (*keys, lpx, lpy, lowner, rpx, rpy), one table a level.

    left(*keys, lpx, lpy, lowner), right(*keys, rpx, rpy, rowner) hold each place and owner once. With `owned`, partners
    have another owner; a cell then bounds a distance only if it surely holds one.
    """
    both = [left.select(F.greatest(F.abs("lpx"), F.abs("lpy")).alias("m")), right.select(F.greatest(F.abs("rpx"), F.abs("rpy")).alias("m"))]
    span, size = both[0].unionByName(both[1]).agg(F.max("m")).first()[0], 1
    if span is None:
        return []
    while size <= span:
        size *= FACTOR
    cells = _stats(left, keys, "l", size).join(_stats(right, keys, "r", size), keys)  # four cells of a key on each side at most
    out = []
    while True:
        low, high = _bounds(metric)
        if owned:
            sure = (F.col("ro1") != F.col("ro2")) | (F.col("ro1") < F.col("lo1")) | (F.col("ro1") > F.col("lo2"))
            high = F.when(sure, high)
        at = [*keys, "lx", "ly"]
        cells = cut(cells.withColumn("low", low).withColumn("high", high), "cells")
        best = cells.groupBy(*at).agg(F.min("high").alias("best"))
        kept = cells.join(best, at).where((F.col("low") <= F.col("best")) | F.col("best").isNull())
        work = kept.groupBy(*at).agg(F.sum("rn").alias("work"))
        few = F.lit(True) if size == 1 else F.col("work") <= direct
        kept, seen = cut_counting(kept.join(work, at).withColumn("few", few).select(*at, "rx", "ry", "few"), "kept", split=F.sum((~F.col("few")).cast("bigint")))
        pairs = (kept.where("few").join(left.withColumns({"lx": _cell("lpx", size), "ly": _cell("lpy", size)}), at)
                 .join(right.withColumns({"rx": _cell("rpx", size), "ry": _cell("rpy", size)}), [*keys, "rx", "ry"]))
        out.append(pairs.select(*keys, "lpx", "lpy", "lowner", "rpx", "rpy", "rowner"))
        if not seen["split"]:
            return out
        size //= FACTOR
        parents = lambda p: [F.floor(F.col(f"{p}{a}") / FACTOR).cast("bigint").alias(f"{p}p{a}") for a in "xy"]
        more = kept.where("not few").select(*keys, *(F.col(f"{p}{a}").alias(f"{p}p{a}") for p in "lr" for a in "xy"))
        lower = [_stats(side, keys, p, size).select("*", *parents(p)) for side, p in ((left, "l"), (right, "r"))]
        cells = more.join(lower[0], [*keys, "lpx", "lpy"]).join(lower[1], [*keys, "rpx", "rpy"]).drop("lpx", "lpy", "rpx", "rpy")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], ids: list[str], ties: list[str], metric: Callable, owners: tuple[str, str] | None = None) -> DataFrame:
    """For each left row the best right row of the same keys by (distance, ties), however far away.

    left(*keys, *ids, lx, ly), right(*keys, rx, ry, *ties) with whole coordinates; `owners` names a column of each side
    that partners must differ in. Returns (*keys, *ids, best) with best = struct(d, *ties); rows without partner are left out.
    """
    lo, ro = (F.col(o) for o in owners) if owners else (F.lit(NOBODY), F.lit(NOBODY))
    whole = lambda c: F.col(c).cast("bigint")
    asked = left.select(*keys, *ids, whole("lx").alias("lpx"), whole("ly").alias("lpy"), lo.alias("lowner"))
    given = right.select(*keys, whole("rx").alias("rpx"), whole("ry").alias("rpy"), ro.alias("rowner"), F.struct(*ties).alias("t"))
    spot = [*keys, "rpx", "rpy"]
    # of one place and owner the least tie can win, and of one place two owners at most
    first = given.groupBy(*spot).agg(F.min(F.struct("t", "rowner")).alias("f")).select(*spot, "f.t", "f.rowner")
    if owners:
        first = cut(first, "first")
        others = given.join(first.select(*spot, F.col("rowner").alias("o")), spot).where(F.col("rowner") != F.col("o"))
        first = first.unionByName(others.groupBy(*spot).agg(F.min(F.struct("t", "rowner")).alias("f")).select(*spot, "f.t", "f.rowner"))
    points = cut(first, "right")
    places = cut(asked.select(*keys, "lpx", "lpy", "lowner").distinct().join(points.select(*keys).distinct(), keys, "left_semi"), "left")
    own = [*keys, "lpx", "lpy", "lowner"]
    found = None
    for pairs in compared_places(places, points.select(*spot, "rowner"), keys, metric, owners is not None):
        if owners:
            pairs = pairs.where("lowner <> rowner")
        d = metric(F.col("lpx"), F.col("lpy"), F.col("rpx"), F.col("rpy"))
        best = pairs.join(points, [*spot, "rowner"]).groupBy(*own).agg(F.min(F.struct(d.alias("d"), "t")).alias("b"))
        found = best if found is None else found.unionByName(best)
    if found is None:
        found = places.select(*own, F.lit(None).cast(f"struct<d:double,t:{points.schema['t'].dataType.simpleString()}>").alias("b")).limit(0)
    out = asked.join(found, own)
    return out.select(*keys, *ids, F.struct(F.col("b.d").alias("d"), *[F.col("b.t")[t].alias(t) for t in ties]).alias("best"))
