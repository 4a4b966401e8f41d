"""Plane sweeps over ordered lanes.

A lane is a strip of a picture, a little wider than the tolerance of a relation, so that everything related to a point of
the lane lies in it or next to it. The rows of a lane come sorted along the strip and are read once. Only what is still
open is held: points that look for partners, and boxes that have not ended. A point leaves as soon as nothing farther on
can concern it, so rows and work stay in proportion to the points and boxes of the lane, and no lane meets itself.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

RIGHT, LEFT, DOWN, UP = range(4)


def directions(px: Column, py: Column) -> list[tuple[int, Column, Column]]:
    """(direction, place along the sweep, place across it) of a point; a sweep to the left runs over negated places."""
    return [(RIGHT, px, py), (LEFT, -px, py), (DOWN, py, px), (UP, -py, px)]


def spread(df: DataFrame, kind: int, at: list[tuple[int, Column, Column, Column, Column]]) -> DataFrame:
    """A row for each (direction, pos, across, first lane, last lane) and lane."""
    ways = F.array(*[F.struct(F.lit(w).alias("way"), p.cast("bigint").alias("pos"), c.cast("bigint").alias("across"), F.sequence(a, b).alias("lanes")) for w, p, c, a, b in at])
    return df.select("*", F.inline(ways)).withColumn("lane", F.explode("lanes")).withColumn("kind", F.lit(kind)).drop("lanes")


def swept(rows: DataFrame, start: Callable, columns: str) -> DataFrame:
    """Read every lane in order of (pos, kind). `start(names)` gives a function of a row (a tuple) that returns result
    rows; it is called anew for each lane."""
    key = ["image_id", "way", "lane"]
    laid = rows.repartition(*key).sortWithinPartitions(*key, "pos", "kind")
    names = laid.columns
    at = [names.index(k) for k in key]
    kind = T.StructType.fromDDL(f"image_id {rows.schema['image_id'].dataType.simpleString()}, {columns}")
    out = to_arrow_schema(kind)

    def run(batches):
        name, step = None, None
        for b in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if (own := tuple(row[i] for i in at)) != name:
                    name, step = own, start(names)
                found += step(row)
                if len(found) > 20_000:
                    yield _batch(found, out)
                    found = []
            if found:
                yield _batch(found, out)

    return laid.mapInArrow(run, kind)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


# ---- ports in sight of each other ---------------------------------------------------------------------------
PORT_SEEN, BOX, PORT_LOOKS = range(3)


def ports_in_sight(ports: DataFrame, comps: DataFrame, band: int) -> DataFrame:
    """Pairs of ports (`ia` below `ib`) on one line with no third box between.

    ports(image_id, ci, pi, px, py, gnd, on), comps(image_id, idx, x1, y1, x2, y2). The port of the lower component
    looks along the line; the first box that stands in the way leaves only the ports of that box in view, the second
    one ends the search. Pairs of two grounds, or of two ports that are `on`, do not count.
    """
    lane = lambda v: F.floor(v / band).cast("bigint")
    none = F.lit(None).cast("bigint")
    p = ports.select("image_id", F.col("ci").cast("bigint").alias("c"), F.col("pi").cast("bigint").alias("p"), F.col("px").cast("bigint").alias("x"), F.col("py").cast("bigint").alias("y"),
                     "gnd", "on", none.alias("far"), none.alias("low"), none.alias("high"))
    ways = directions(F.col("x"), F.col("y"))
    looks = spread(p, PORT_LOOKS, [(w, a, c, lane(c), lane(c)) for w, a, c in ways])
    seen = spread(p, PORT_SEEN, [(w, a, c, lane(c) - 1, lane(c) + 1) for w, a, c in ways])
    sides = [("x1", "x2", "y1", "y2", RIGHT), ("x2", "x1", "y1", "y2", LEFT), ("y1", "y2", "x1", "x2", DOWN), ("y2", "y1", "x1", "x2", UP)]
    boxes = comps.select("image_id", F.col("idx").cast("bigint").alias("c"), none.alias("p"), none.alias("x"), none.alias("y"), F.lit(False).alias("gnd"), F.lit(False).alias("on"),
                         *(F.col(v).cast("bigint").alias(v) for v in ("x1", "y1", "x2", "y2")))
    parts = []
    for near, far, low, high, w in sides:
        sign = -1 if w in (LEFT, UP) else 1
        one = boxes.select("image_id", "c", "p", "x", "y", "gnd", "on", (sign * F.col(far)).alias("far"), F.col(low).alias("low"), F.col(high).alias("high"), (sign * F.col(near)).alias("near"))
        # a box stands in the way of what lies more than 5 behind its near side
        parts.append(spread(one, BOX, [(w, F.col("near") + 5, F.col("low"), lane(F.col("low") - band), lane(F.col("high") + band))]).drop("near"))
    rows = looks.unionByName(seen)
    for part in parts:
        rows = rows.unionByName(part)

    def start(names):
        image, way, pos, across, kind, c, p, x, y, gnd, on, far, low, high = (names.index(n) for n in (
            "image_id", "way", "pos", "across", "kind", "c", "p", "x", "y", "gnd", "on", "far", "low", "high"))
        open_: list[list] = []   # [row, component that stands in the way or None]
        boxes_: list[tuple] = []  # boxes that may still reach beyond the sweep

        def step(row):
            nonlocal open_, boxes_
            at = row[pos]
            if row[kind] == BOX:
                boxes_.append(row)
                for o in open_:
                    blocked(o, row)
                open_ = [o for o in open_ if o is not None and o[1] != -1]
                return ()
            if row[kind] == PORT_LOOKS:
                boxes_ = [b for b in boxes_ if b[far] > at + 5]
                o = [row, None]
                for b in boxes_:
                    blocked(o, b)
                if o[1] != -1:
                    open_.append(o)
                return ()
            out = []
            for a, wall in open_:
                if (row[c] > a[c] and (wall is None or wall == row[c]) and abs(row[across] - a[across]) < band and at - a[pos] > 5
                        and not (row[gnd] and a[gnd]) and not (row[on] and a[on])
                        and (way_is_h(row) or not (abs(row[y] - a[y]) < band and abs(row[x] - a[x]) > 5))):
                    out.append((row[image], a[c], a[p], row[c], row[p], a[x], a[y], row[x], row[y]))
            return out

        def way_is_h(row):
            return row[way] in (RIGHT, LEFT)

        def blocked(o, b):
            a, wall = o
            if wall == -1 or b[c] == a[c] or b[c] == wall or b[far] <= a[pos] + 5 or b[low] >= a[across] + band or b[high] <= a[across] - band:
                return
            o[1] = b[c] if wall is None else -1

        return step

    return swept(rows, start, "ia bigint, pa bigint, ib bigint, pb bigint, ax bigint, ay bigint, bx bigint, by bigint")


# ---- nearest partner in each direction -----------------------------------------------------------------------
def nearest_valid(points: DataFrame, near: int = 12, apart: int = 10) -> DataFrame:
    """The closest partner of each point to the left (way 0), right (1), above (2) and below (3).

    points(image_id, x, y, jord, align, most, pins, live): `jord` a struct that orders the points of a picture, `pins` an
    array of (ci, pins) of the ports that hang on the point, `live` whether one of them is no ground. Partners lie within
    `near`, or on one line (`align`) more than `apart` and less than `most` away; two points with the same components, or
    with different pins of one component, or with grounds only, are no partners, and the search goes on behind them.
    """
    lane = lambda v: F.floor(v / F.col("align")).cast("bigint")
    p = points.select("image_id", F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y"), "jord", F.col("align").cast("double").alias("align"),
                      F.col("most").cast("double").alias("most"), "pins", "live")
    ways = directions(F.col("x"), F.col("y"))
    looks = spread(p, 1, [(w, a, c, lane(c), lane(c)) for w, a, c in ways])
    seen = spread(p, 0, [(w, a, c, lane(c) - 1, lane(c) + 1) for w, a, c in ways])
    numbers = {LEFT: 0, RIGHT: 1, UP: 2, DOWN: 3}
    # a point that found its partner, or looked far enough, is done; the others are done behind the last row
    last = looks.groupBy("image_id", "way", "lane").agg(F.lit(2).alias("kind"))
    rows = looks.unionByName(seen).unionByName(last.withColumn("pos", F.lit((1 << 62)).cast("bigint")), allowMissingColumns=True)

    def start(names):
        image, way, pos, across, kind, x, y, jord, align, most, pins, live = (names.index(n) for n in (
            "image_id", "way", "pos", "across", "kind", "x", "y", "jord", "align", "most", "pins", "live"))
        open_: list[list] = []  # [row, pins by component, order, best partner]

        def step(row):
            nonlocal open_
            out, still, at = [], [], row[pos]
            for o in open_:
                reach = at - o[0][pos]
                if (o[3] is not None and reach > o[3][0]) or reach >= max(o[0][most], near):
                    out += done(o)
                else:
                    still.append(o)
            open_ = still
            if row[kind] == 2:
                return out
            own, order = {r["ci"]: r["pins"] for r in row[pins] or ()}, tuple(row[jord].values())
            if row[kind] == 1:
                open_.append([row, own, order, None])
                return out
            for o in open_:
                a = o[0]
                dx, dy = abs(row[x] - a[x]), abs(row[y] - a[y])
                if abs(row[across] - a[across]) >= a[align] or at <= a[pos]:
                    continue
                d = math.sqrt(dx * dx + dy * dy)
                line = ((dy < a[align] and dx > apart) or (dx < a[align] and dy > apart)) and d < a[most]
                rank = (d, min(o[2], order), max(o[2], order))
                if (d < near or line) and (o[3] is None or rank < o[3][:3]) and (row[live] or a[live]) and partners(o[1], own):
                    o[3] = (*rank, row[x], row[y])
            return out

        def partners(a: dict, b: dict) -> bool:
            common = a.keys() & b.keys()
            return all(a[c] == b[c] for c in common) and not (common and len(common) == len(a) == len(b))

        def done(o):
            a, best = o[0], o[3]
            return [(a[image], a[x], a[y], best[3], best[4], numbers[a[way]])] if best else []

        return step

    return swept(rows, start, "ax bigint, ay bigint, bx bigint, by bigint, way int")
