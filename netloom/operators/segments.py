"""Wire segments to nodes: de-duplication, wire groups, and node numbers for ports.

segments(image_id, seg, x1, y1, x2, y2), ports(image_id, ci, pi, px, py, n_ports, name).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from netloom.functions import geom
from netloom.lineage import count_all, cut
from netloom.operators import graph, ranks, spatial
from netloom.operators.nearest import nearest
from netloom.operators.wiring import packed, port_id


def ends_of(x1: str, y1: str, x2: str, y2: str) -> Column:
    return F.array(*[F.struct(F.col(x).alias("ux"), F.col(y).alias("uy")) for x, y in ((x1, y1), (x2, y2))])


def drop_repeats(segs: DataFrame, threshold: int = 8) -> DataFrame:
    """Segments without an earlier one, kept or not, whose ends lie closer than `threshold` in sum."""
    size, segs = F.lit(threshold), cut(segs, "segments")
    crowd = spatial.crowded(segs)
    b = segs.select("image_id", F.col("seg").alias("earlier"), *[F.col(c).alias("e" + c) for c in ("x1", "y1", "x2", "y2")])
    def d(p, q):
        return geom.dist(F.col("x" + p), F.col("y" + p), F.col("ex" + q), F.col("ey" + q))
    close = F.least(d("1", "1") + d("2", "2"), d("1", "2") + d("2", "1")) < threshold
    repeat = (F.col("earlier") < F.col("seg")) & close

    def by_cell(many):
        at = spatial.with_cell(b.join(crowd, "image_id", "left_semi").select("*", F.inline(ends_of("ex1", "ey1", "ex2", "ey2"))), F.col("ux"), F.col("uy"), size)
        hit = spatial.with_near_cells(many, F.col("x1"), F.col("y1"), size).join(at, ["image_id", *spatial.CELL]).where(repeat)
        return many.join(hit.select("image_id", "seg").distinct(), ["image_id", "seg"], "left_anti")

    def by_image(few):
        first = b.withColumnRenamed("image_id", "e_image")
        return few.join(first, (few["image_id"] == first["e_image"]) & repeat, "left_anti")
    return spatial.split(segs, crowd, by_image, by_cell)


def _ends(segs: DataFrame) -> DataFrame:
    pts = F.array(F.struct(F.lit(0).alias("end"), F.col("x1").alias("ex"), F.col("y1").alias("ey")),
                  F.struct(F.lit(1).alias("end"), F.col("x2").alias("ex"), F.col("y2").alias("ey")))
    return segs.select("*", F.inline(pts))


def adjacent(segs: DataFrame, threshold: int = 12) -> DataFrame:
    """Edges (image_id, a, b) between segments with ends at most `threshold` apart.

    Cells four times the threshold wide: an end reaches about two of them instead of nine.
    """
    size, reach = F.lit(4 * threshold), F.lit(threshold)
    e = _ends(segs)
    a = spatial.with_cell(e.select("image_id", F.col("seg").alias("a"), F.col("ex").alias("ax"), F.col("ey").alias("ay")), F.col("ax"), F.col("ay"), size)
    b = spatial.with_near_cells(e.select("image_id", F.col("seg").alias("b"), F.col("ex").alias("bx"), F.col("ey").alias("by")), F.col("bx"), F.col("by"), size, reach)
    return a.join(b, ["image_id", *spatial.CELL]).where(
        (F.col("a") < F.col("b")) & (geom.dist(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")) <= threshold)).select("image_id", "a", "b").distinct()


def wire_groups(segs: DataFrame, threshold: int = 12) -> DataFrame:
    """segments with `g`, the smallest segment of their wire.

    The nodes are square cells so small that any two ends in one are adjacent. A segment ties the cells of its ends;
    cells next to each other are tied if two of their places are adjacent. However many segments meet in a spot, they
    give one tie each. In pictures with few segments these are the nodes, and pairs of them that are adjacent the edges;
    they meet in one list for each picture, so no pair is shuffled and `segs` is read once.
    """
    crowd = spatial.crowded(segs)
    if crowd is None:
        return spatial.settled(_groups_by_image(segs, threshold), segs)
    own = cut(segs.join(crowd, "image_id", "left_semi").select("image_id", "seg", "x1", "y1", "x2", "y2"), "segments")
    many = segs.join(_groups_by_cells(own, threshold), ["image_id", "seg"])
    return spatial.settled(_groups_by_image(segs.join(crowd, "image_id", "left_anti"), threshold).unionByName(many), segs)


PAIRS = 4_000_000  # pairs of segments that are looked at together


def _groups_by_image(segs: DataFrame, threshold: int) -> DataFrame:
    """segments with `g`, from one list for each picture."""
    rest = [c for c in segs.columns if c not in ("image_id", "seg")]
    lists = segs.where("image_id is not null").groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("seg", *rest))).alias("s"))
    found = lists.withColumn("g", _wires_of_lists(threshold)(*[F.col(f"s.{c}") for c in ("seg", "x1", "y1", "x2", "y2")]))
    rows = found.select("image_id", F.inline(F.zip_with("s", "g", lambda s, g: F.struct(s.alias("s"), g.alias("g")))))
    return rows.select("image_id", *[F.col(f"s.{c}") for c in segs.columns if c != "image_id"], "g")


def _wires_of_lists(threshold: int):
    most = PAIRS

    def wires(seg: pa.Array, x1: pa.Array, y1: pa.Array, x2: pa.Array, y2: pa.Array) -> pa.Array:
        (row, own), places = graph.flat(seg), [graph.flat(c)[1] for c in (x1, y1, x2, y2)]
        after = np.searchsorted(row, row, "right") - np.arange(len(row)) - 1  # later segments of the same picture
        a, b, done, sums = [], [], 0, np.cumsum(after)
        while done < len(row):
            till = max(done + 1, int(np.searchsorted(sums, (sums[done - 1] if done else 0) + most, "right")))
            n = after[done:till]
            u = np.repeat(np.arange(done, till), n)
            v = u + 1 + np.arange(len(u)) - np.repeat(np.cumsum(n) - n, n)
            near = own[u] == own[v]
            for x, y in (places[:2], places[2:]):
                for fx, fy in (places[:2], places[2:]):
                    dx, dy = x[u] - fx[v], y[u] - fy[v]
                    near |= np.sqrt((dx * dx + dy * dy).astype(np.float64)) <= threshold
            a.append(u[near])
            b.append(v[near])
            done = till
        none = np.zeros(0, np.int64)
        label = graph.least_labels(len(row), np.concatenate([none, *a]), np.concatenate([none, *b]))
        return graph.lists_like(seg, own[label])

    return F.arrow_udf(wires, T.ArrayType(T.LongType()))


def _groups_by_cells(segs: DataFrame, threshold: int) -> DataFrame:
    """(image_id, seg, g) of crowded pictures."""
    side, size = max(1, int(threshold / 2 ** 0.5)), F.lit(max(1, int(threshold / 2 ** 0.5)))
    def at(x, y):
        return packed(spatial.cell(F.col(x), size), spatial.cell(F.col(y), size))
    own = segs.select("image_id", "seg", at("x1", "y1").alias("a"), at("x2", "y2").alias("b"))
    spots = cut(_ends(segs).select("image_id", "ex", "ey").distinct(), "spots")
    here = spatial.with_cell(spots, F.col("ex"), F.col("ey"), size)
    near = spatial.with_near_cells(spots.select("image_id", F.col("ex").alias("fx"), F.col("ey").alias("fy")), F.col("fx"), F.col("fy"), size, F.lit(max(threshold, side)))
    ties = here.join(near, ["image_id", *spatial.CELL]).where(geom.dist(F.col("ex"), F.col("ey"), F.col("fx"), F.col("fy")) <= threshold)
    edges = own.select("image_id", "a", "b").unionByName(ties.select("image_id", at("ex", "ey").alias("a"), at("fx", "fy").alias("b")))
    edges = cut(edges.select("image_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "ties")
    comp = cut(graph.connected_components(own.select("image_id", F.col("a").alias("node")).distinct(), edges), "cells")
    placed = own.select("image_id", "seg", F.col("a").alias("node")).join(comp, ["image_id", "node"])
    least = placed.groupBy("image_id", "comp").agg(F.min("seg").alias("g"))
    return placed.join(least, ["image_id", "comp"]).select("image_id", "seg", "g")


def leaf_ends(grouped: DataFrame) -> DataFrame:
    """(image_id, g, ex, ey): ends whose place on a three-pixel grid occurs once in the wire."""
    def grid(c):
        return (F.bround(F.col(c) / 3.0) * 3).cast("bigint")
    few = spatial.is_settled(grouped) and spatial.crowded(grouped) is None
    leaves = (_ends(spatial.laid(grouped, None) if few else grouped).groupBy("image_id", "g", grid("ex").alias("rx"), grid("ey").alias("ry"))
              .agg(count_all().alias("n"), F.min("ex").alias("ex"), F.min("ey").alias("ey")).where("n = 1").select("image_id", "g", "ex", "ey"))
    return spatial.settled(leaves, grouped)


def ports_on_wires(ports: DataFrame, leaves: DataFrame, max_dist: int = 25) -> DataFrame:
    """(image_id, ci, pi, g): wires with a leaf end closer than `max_dist` to the port; all matches."""
    size, leaves = F.lit(max_dist), spatial.counted(leaves, "leaves")
    ports = spatial.counted(spatial.settled(ports.select("image_id", "ci", "pi", "px", "py"), ports), "ports")
    found = spatial.met(ports, leaves, spatial.crowded(ports, leaves), lambda a: spatial.with_near_cells(a, F.col("px"), F.col("py"), size),
                       lambda b: spatial.with_cell(b, F.col("ex"), F.col("ey"), size)).where(
        geom.dist(F.col("px"), F.col("py"), F.col("ex"), F.col("ey")) < max_dist).select("image_id", "ci", "pi", "g").distinct()
    return spatial.settled(found, ports, leaves)


def merge_wires(on_wire: DataFrame) -> DataFrame:
    """(image_id, ci, pi, m, first): ports with their merged wire; wires that are the last match of ports of
    one component become one. `first` is the first wire of the port inside the merged one."""
    on_wire = spatial.counted(on_wire, "on")
    merged = spatial.split(on_wire, spatial.crowded(on_wire), _merged_by_image, _merged_by_ties)
    return spatial.settled(merged.groupBy("image_id", "ci", "pi", "m").agg(F.min("g").alias("first")), on_wire)


def _merged_by_image(on_wire: DataFrame) -> DataFrame:
    """(image_id, ci, pi, g, m), from one list for each picture."""
    own = on_wire.where("image_id is not null").withColumn("own", F.max("g").over(W.partitionBy("image_id", "ci", "pi")))
    led = own.withColumn("lead", F.min("own").over(W.partitionBy("image_id", "ci")))
    lists = led.groupBy("image_id").agg(F.collect_list(F.struct("ci", "pi", "g", "lead", "own")).alias("s"))
    found = lists.withColumn("m", graph.components_in_lists(F.col("s.g"), F.col("s.lead"), F.col("s.own")))
    rows = found.select("image_id", F.inline(F.zip_with("s", "m", lambda s, m: F.struct(s.alias("s"), m.alias("m")))))
    return spatial.laid(rows.select("image_id", "s.ci", "s.pi", "s.g", "m"), None)


def _merged_by_ties(on_wire: DataFrame) -> DataFrame:
    own = on_wire.groupBy("image_id", "ci", "pi").agg(F.max("g").alias("own"))
    lead = own.groupBy("image_id", "ci").agg(F.min("own").alias("a"))
    edges = own.join(lead, ["image_id", "ci"]).select("image_id", "a", F.col("own").alias("b")).where("a <> b").distinct()
    comp = graph.connected_components(on_wire.select("image_id", F.col("g").alias("node")).distinct(), edges)
    return on_wire.join(comp.withColumnsRenamed({"node": "g", "comp": "m"}), ["image_id", "g"]).select("image_id", "ci", "pi", "g", "m")


def proximity(ports: DataFrame, reach: int = 35) -> DataFrame:
    """(image_id, ci, pi, cj, pj, d): ports of different components closer than `reach`."""
    size = F.lit(reach)
    a = cut(ports.select("image_id", "ci", "pi", "px", "py"), "ports")
    b = a.select("image_id", F.col("ci").alias("cj"), F.col("pi").alias("pj"), F.col("px").alias("qx"), F.col("py").alias("qy"))
    d = geom.dist(F.col("px"), F.col("py"), F.col("qx"), F.col("qy"))
    pairs = spatial.met(a, b, spatial.crowded(a), lambda a: spatial.with_cell(a, F.col("px"), F.col("py"), size), lambda b: spatial.with_near_cells(b, F.col("qx"), F.col("qy"), size))
    return pairs.where(F.col("ci") < F.col("cj")).withColumn("d", d).where(F.col("d") < reach).select(
        "image_id", "ci", "pi", "cj", "pj", "d")


def nearest_on_wire(ports: DataFrame, merged: DataFrame) -> DataFrame:
    """(image_id, p, q, ord): for each port its first connection inside its merged wires.

    Connections go by distance, then wire, then the places of both ports in the wire's list. Only the
    first connection of a port can give it a node, so the other pairs of a wire are never formed.
    """
    # a wire of one component offers no partner; without those the search below always ends early
    if spatial.is_settled(merged) and spatial.crowded(merged) is None:
        wire = W.partitionBy("image_id", "m")
        joint = merged.withColumn("ok", F.min("ci").over(wire) != F.max("ci").over(wire)).where("ok").drop("ok")
    else:
        joint = merged.join(merged.groupBy("image_id", "m").agg((F.min("ci") != F.max("ci")).alias("ok")).where("ok").select("image_id", "m"), ["image_id", "m"])
    at = cut(joint.join(ports.select("image_id", "ci", "pi", "px", "py"), ["image_id", "ci", "pi"])
             .withColumn("p", port_id()), "at")
    crowd = spatial.crowded(at)
    at = spatial.laid(at, crowd)
    left = at.select("image_id", "m", "p", "ci", F.col("first").alias("lf"), F.col("px").alias("lx"), F.col("py").alias("ly"))
    right = at.select("image_id", "m", F.col("p").alias("q"), F.col("ci").alias("cq"), F.col("first").alias("rf"), F.col("px").alias("rx"), F.col("py").alias("ry"))
    # the tie is the pair in list order: which of both comes first depends on the partner
    def by_image(few):
        d = geom.dist(F.col("lx"), F.col("ly"), F.col("rx"), F.col("ry")).alias("d")
        return few.join(right, ["image_id", "m"]).where(F.col("ci") != F.col("cq")).groupBy("image_id", "m", "p", "lf").agg(F.min(F.struct(d, "rf", "q")).alias("best"))
    best = spatial.split(left, crowd, by_image, lambda many: nearest(
        many, right.join(crowd, "image_id", "left_semi"), ["image_id", "m"], ["p", "lf"], ["rf", "q"], geom.dist, owners=("ci", "cq")))
    here, there = F.struct(F.col("lf").alias("f"), F.col("p").alias("n")), F.struct(F.col("best.rf").alias("f"), F.col("best.q").alias("n"))
    return best.select("image_id", "p", F.col("best.q").alias("q"), F.struct(
        F.col("best.d").alias("d"), F.lit(0).alias("src"), F.col("m"), F.least(here, there).alias("u"), F.greatest(here, there).alias("v")).alias("ord"))


def assign_nodes(ports: DataFrame, merged: DataFrame, guard: ranks.SkewGuard | None = None) -> DataFrame:
    """(image_id, ci, pi, node): node numbers of all ports, ground 0.

    Walking connections by distance, a port gets its node from its very first connection; so nodes are
    the connected components of first connections, where ground ports hold node 0 and choose nothing.
    Numbers go by those first connections, then fresh nodes for two-port components shorted to
    themselves, then ports without connection.
    """
    near = proximity(ports)
    def far_end(df, a, b, x, y):
        return df.select("image_id", F.col(a).alias("p"), F.col(b).alias("q"), F.struct(
            "d", F.lit(1).alias("src"), F.lit(0).cast("bigint").alias("m"),
            F.struct(F.lit(0).cast("bigint").alias("f"), F.col(x).alias("n")).alias("u"),
            F.struct(F.lit(0).cast("bigint").alias("f"), F.col(y).alias("n")).alias("v")).alias("ord"))
    near = near.withColumn("a", port_id()).withColumn("b", port_id("cj", "pj"))
    cand = nearest_on_wire(ports, merged).unionByName(far_end(near, "a", "b", "a", "b")).unionByName(far_end(near, "b", "a", "a", "b"))
    p = cut(ports.select("image_id", "ci", "pi", "n_ports", (F.col("name") == "GND").alias("gnd"), port_id().alias("p")), "ports")
    first = cut(cand.join(p.select("image_id", "p", "gnd"), ["image_id", "p"]).where("not gnd").groupBy("image_id", "p").agg(
        F.min(F.struct("ord", "q")).alias("w")).select("image_id", "p", F.col("w.q").alias("q"), F.col("w.ord").alias("ord")), "first")
    comp = graph.connected_components(p.select("image_id", F.col("p").alias("node")), first.select("image_id", F.col("p").alias("a"), F.col("q").alias("b")))
    at = p.join(comp.withColumnRenamed("node", "p"), ["image_id", "p"]).join(first.select("image_id", "p", "ord"), ["image_id", "p"], "left")
    at = cut(at, "nodes")
    nets = at.groupBy("image_id", "comp").agg(F.bool_or("gnd").alias("ground"), F.min("ord").alias("lead"))
    at = at.drop("ord").join(nets, ["image_id", "comp"])
    linked = F.col("ground") | F.col("lead").isNotNull()
    pair = at.where(linked & (F.col("n_ports") == 2)).groupBy("image_id", "ci").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), count_all().alias("k"),
                                                                                    F.min("ground").alias("g0"))
    # both ports in one net, or both on ground though in different nets
    shorted = pair.where("k = 2 and (c0 = c1 or g0)").select("image_id", "ci", F.lit(1).alias("pi"), F.lit(True).alias("fresh"))
    at = cut(at.join(shorted, ["image_id", "ci", "pi"], "left").withColumn("fresh", F.coalesce("fresh", F.lit(False))), "nodes")
    zero = F.lit(0).cast("bigint")
    def slot(df, phase, d, src, m, u, v):
        return df.select("image_id", "key", F.struct(F.lit(phase).alias("phase"), d.alias("d"), src.alias("src"), m.alias("m"), u.alias("u"), v.alias("v")).alias("slot"))
    nil = F.struct(zero.alias("f"), zero.alias("n"))
    lead = F.col("lead")
    new = slot(nets.where("not ground and lead is not null").withColumn("key", F.col("comp")), 0, lead["d"], lead["src"], lead["m"], lead["u"], lead["v"])
    # the keys of fresh and single ports are kept apart from those of nets by their sign
    fresh = slot(at.where("fresh").withColumn("key", -F.col("p") - 1), 1, F.lit(0.0), F.lit(0), F.col("p"), nil, nil)
    solo = slot(at.where(~linked).withColumn("key", -F.col("p") - 1), 2, F.lit(0.0), F.lit(0), F.col("p"), nil, nil)
    numbers = ranks.row_number(new.unionByName(fresh).unionByName(solo), ["image_id"], ["slot"], "node", guard=guard)
    key = F.when(F.col("fresh") | ~linked, -F.col("p") - 1).when(~F.col("ground"), F.col("comp"))
    return at.withColumn("key", key).join(numbers.select("image_id", "key", "node"), ["image_id", "key"], "left").select(
        "image_id", "ci", "pi", F.coalesce("node", zero).alias("node"))


