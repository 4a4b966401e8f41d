"""Wiring inference: which ports of a picture hang on one net (vector-only path).

Tables: comps(image_id, idx, name, x1..y2), ports(image_id, ci, pi, px, py, n_ports, name),
junctions(image_id, jx, jy, jord), links(image_id, ci, pi, jx, jy, ord),
limits(image_id, pjr, pjf, ...). `jord` and `ord` are structs giving the place in the list the
published procedure would build, so ties fall the same way. All joins carry the picture and a cell.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from netloom.functions import dims, geom
from netloom.lineage import count_all, cut, cut_counting, drop_table
from netloom.operators import graph, lists, spatial, sweep

CELL_SIZE = 128
WIDE_CELL = 256
LOW_HALF = 0xFFFFFFFF
CAP = 10


def packed(high: Column, low: Column) -> Column:
    """Two 32-bit numbers as one id that sorts by the first, then the second."""
    return F.shiftleft(high.cast("bigint"), 32).bitwiseOR(low.cast("bigint").bitwiseAND(F.lit(LOW_HALF)))


def point_id(x, y) -> Column:
    return packed(x, y)


def port_id(ci="ci", pi="pi") -> Column:
    return packed(F.col(ci), F.col(pi))


def component_of(port: Column) -> Column:
    return F.shiftright(port, 32)


def place_of(port: Column) -> Column:
    return port.bitwiseAND(F.lit(LOW_HALF)).cast("int")


def order(stage: int, *keys) -> Column:
    ks = [k if isinstance(k, Column) else F.lit(k) for k in keys] + [F.lit(0)] * (4 - len(keys))
    return F.struct(F.lit(stage).alias("s"), *[k.cast("bigint").alias(n) for k, n in zip(ks, "abcd")])


def config_grid(images: DataFrame) -> DataFrame:
    """(image_id, config, flags): every picture with every setting, own switches over the defaults."""
    rows = [(n, {**dims.DEFAULT_SWITCHES, **c}) for n, c in dims.ABLATIONS.items()]
    grid = images.sparkSession.createDataFrame(rows, "config string, flags map<string,boolean>")
    return images.crossJoin(F.broadcast(grid))  # five fixed settings


# ---- snapping and merging points ---------------------------------------------------------------
def snap_axis(points: DataFrame, col: str, tol: Column) -> DataFrame:
    """Coordinate moved to the truncated median of its cluster of distinct values.

    A cluster ends where the gap to the next value exceeds `tol` (a column of `points`, one value per
    picture). The windows run over distinct coordinates, at most one per pixel row or column.
    """
    vals = points.select("image_id", F.col(col).alias("v"), tol.alias("tol")).distinct()
    by = W.partitionBy("image_id").orderBy("v")
    gap = F.col("v") - F.lag("v").over(by)
    runs = vals.withColumn("new", F.when(gap > F.col("tol"), 1).otherwise(0)).withColumn(
        "run", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    mids = runs.groupBy("image_id", "run").agg(F.percentile("v", F.lit(0.5)).cast("bigint").alias("mid"))
    moved = runs.join(mids, ["image_id", "run"]).select("image_id", F.col("v").alias(col), "mid")
    return points.join(moved, ["image_id", col]).drop(col).withColumnRenamed("mid", col)


def snap(points: DataFrame, x: str, y: str, tol: Column) -> DataFrame:
    points = spatial.counted(points, "points")
    return spatial.split(points, spatial.crowded(points), lambda few: _by_list(few, x, y, [(_snapped, tol)], x, y),
                         lambda many: snap_axis(snap_axis(many, x, tol), y, tol))


def _snapped(x: Column, y: Column, tol: Column) -> tuple[Column, Column]:
    return lists.snapped(x, tol), lists.snapped(y, tol)


def _merged(round_metric: bool):
    def step(x, y, tol):
        to = lists.merged(x, y, tol, round_metric)
        return to["x"], to["y"]
    return step


def _by_list(points: DataFrame, x: str, y: str, steps: list[tuple], to_x: str, to_y: str) -> DataFrame:
    """Points with their place after `steps`, pairs of a function of the lists of x, y and a limit, and that limit (a column
    of `points`, one value per picture). The points of a picture meet in one list."""
    limits = [F.max(tol).alias(f"_{i}") for i, (_, tol) in enumerate(steps)]
    found = lists.gathered(points.where(F.col(x).isNotNull() & F.col(y).isNotNull()), "_p", *limits).withColumns(
        {f"_{c}": F.col(f"_p.{c}").cast("array<bigint>") for c in (x, y)})
    for i, (step, _) in enumerate(steps):
        found = found.withColumns(dict(zip((f"_{x}", f"_{y}"), step(F.col(f"_{x}"), F.col(f"_{y}"), F.col(f"_{i}")))))
    rows = found.select("image_id", F.inline(F.arrays_zip("_p", F.col(f"_{x}").alias("_x"), F.col(f"_{y}").alias("_y"))))
    rest = [c for c in points.columns if c not in ("image_id", to_x, to_y)]
    return rows.select("image_id", *[F.col(f"_p.{c}") for c in rest], F.col("_x").alias(to_x), F.col("_y").alias(to_y))


def merge_points(points: DataFrame, x: str, y: str, tol: Column, round_metric: bool = True) -> DataFrame:
    """Adds mx, my: truncated mean of all points joined by steps of at most `tol`.

    Euclidean steps when `round_metric`, else the larger coordinate difference counts. Equal points
    weigh by their number.
    """
    points = spatial.counted(points, "points")
    return spatial.split(points, spatial.crowded(points), lambda few: _by_list(few, x, y, [(_merged(round_metric), tol)], "mx", "my"),
                         lambda many: _merged_in_rounds(many, x, y, tol, round_metric))


def _merged_in_rounds(points: DataFrame, x: str, y: str, tol: Column, round_metric: bool) -> DataFrame:
    spots = cut(points.groupBy("image_id", F.col(x).alias("x"), F.col(y).alias("y")).agg(
        count_all().alias("w"), F.max(tol).alias("tol")).withColumn("node", point_id(F.col("x"), F.col("y"))), "spots")
    a = spots.select("image_id", F.col("node").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), "tol")
    b = spots.select("image_id", F.col("node").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("tol").alias("reach"))
    metric = geom.dist if round_metric else geom.chebyshev
    near = metric(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")) <= F.col("tol")
    pairs = spatial.met(a, b, spatial.crowded(spots), lambda a: spatial.with_cell(a, F.col("ax"), F.col("ay"), F.col("tol") * 4),
                        lambda b: spatial.with_near_cells(b, F.col("bx"), F.col("by"), F.col("reach") * 4, F.col("reach")))
    edges = pairs.where((F.col("a") < F.col("b")) & near).select("image_id", "a", "b")
    comp = graph.connected_components(spots, edges)
    means = spots.join(comp, ["image_id", "node"]).groupBy("image_id", "comp").agg(
        (F.sum(F.col("x") * F.col("w")) / F.sum("w")).cast("bigint").alias("mx"),
        (F.sum(F.col("y") * F.col("w")) / F.sum("w")).cast("bigint").alias("my"))
    to = spots.join(comp, ["image_id", "node"]).join(means, ["image_id", "comp"]).select(
        "image_id", F.col("x").alias(x), F.col("y").alias(y), "mx", "my")
    return points.join(to, ["image_id", x, y])


def prepare_junctions(raw: DataFrame, limits: DataFrame) -> DataFrame:
    """Raw junction centres (image_id, jx, jy), repeats included, to the ordered junction list."""
    raw = spatial.counted(raw, "raw")
    steps = [(_snapped, F.col("grid_snap")), (_merged(True), F.col("uf_merge")), (_snapped, F.lit(8))]

    def many(points):
        # every snap reads its points several times, so they are written in between
        snapped = cut(snap(cut(points, "raw"), "jx", "jy", F.col("grid_snap")), "snapped")
        merged = merge_points(snapped, "jx", "jy", F.col("uf_merge"))
        once = cut(merged.select("image_id", F.col("mx").alias("jx"), F.col("my").alias("jy")).distinct(), "once")
        return snap(once, "jx", "jy", F.lit(8)).select("image_id", "jx", "jy")
    placed = raw.join(limits.select("image_id", "grid_snap", "uf_merge"), "image_id")
    return base_junctions(spatial.split(placed, spatial.crowded(raw), lambda few: _by_list(few, "jx", "jy", steps, "jx", "jy").select(
        "image_id", "jx", "jy"), many))


def base_junctions(points: DataFrame) -> DataFrame:
    return points.select("image_id", "jx", "jy").distinct().withColumn("jord", order(0, F.col("jy"), F.col("jx")))


def prepare_ports(ports: DataFrame) -> DataFrame:
    """Ports on common grid lines, near ports merged to their mean."""
    ports = spatial.counted(ports, "placed")

    def many(points):
        snapped = cut(snap(cut(points, "placed"), "px", "py", F.lit(5)), "snapped")
        return merge_points(snapped, "px", "py", F.lit(8), round_metric=False).drop("px", "py").withColumnsRenamed({"mx": "px", "my": "py"})
    return spatial.split(ports, spatial.crowded(ports), lambda few: _by_list(
        few, "px", "py", [(_snapped, F.lit(5)), (_merged(False), F.lit(8))], "px", "py"), many)


# ---- crossings ------------------------------------------------------------------------------------
ZONE = ("zx1", "zy1", "zx2", "zy2")


def _grown(comps: DataFrame) -> DataFrame:
    return comps.select("image_id", F.col("idx").alias("z"), *[c.alias(n) for c, n in zip(geom.grow(geom.box(""), 8), ZONE)])


def crossing(segs: DataFrame, comps: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of segments (image_id, *keys, own, sx1, sy1, sx2, sy2) meeting the box, grown by 8, of a
    component other than `own`."""
    size, boxes, zb = F.lit(CELL_SIZE), _grown(comps), tuple(F.col(n) for n in ZONE)
    s = tuple(F.col(n) for n in ("sx1", "sy1", "sx2", "sy2"))
    a = spatial.with_cells(segs, F.least(s[0], s[2]), F.least(s[1], s[3]), F.greatest(s[0], s[2]), F.greatest(s[1], s[3]), size)
    b = spatial.with_cells(boxes, *zb, size)
    return a.join(b, ["image_id", *spatial.CELL]).where((F.col("own") != F.col("z")) & geom.segment_meets_box(s, zb)).select(
        "image_id", *keys).distinct()


def _clear(cand: DataFrame, comps: DataFrame, keys: list[str], crowd: DataFrame | None, waived: Column | None = None) -> DataFrame:
    """Candidates with a free line of sight from (px, py) to (qx, qy); `waived` ones are not tested."""
    def by_cell(many):
        tested = many if waived is None else many.where(~waived)
        segs = tested.select("image_id", *keys, F.col("ci").alias("own"), F.col("px").alias("sx1"), F.col("py").alias("sy1"),
                             F.col("qx").alias("sx2"), F.col("qy").alias("sy2"))
        return many.join(crossing(segs, comps, keys), ["image_id", *keys], "left_anti")

    return spatial.split(cand, crowd, lambda few: _unmet(few, comps, F.col("ci"), [("px", "py", "qx", "qy")], waived), by_cell)


def _unmet(rows: DataFrame, comps: DataFrame, own: Column, legs: list[tuple], waived: Column | None = None) -> DataFrame:
    """Rows none of whose legs meets a grown box of their picture, but for that of component `own`."""
    boxes, zone = _grown(comps).withColumnRenamed("image_id", "z_image"), tuple(F.col(n) for n in ZONE)
    for leg in legs:
        hit = (own != F.col("z")) & geom.segment_meets_box(tuple(F.col(n) for n in leg), zone)
        rows = rows.join(boxes, (rows["image_id"] == boxes["z_image"]) & (hit if waived is None else hit & ~waived), "left_anti")
    return rows


def _open_ports(ports: DataFrame, links: DataFrame, crowd: DataFrame | None) -> DataFrame:
    return spatial.laid(ports, crowd).join(links.select("image_id", "ci", "pi"), ["image_id", "ci", "pi"], "left_anti")


# ---- ports to junctions -----------------------------------------------------------------------------
def _junctions_near(ports: DataFrame, junctions: DataFrame, reach: DataFrame, col: str, crowd: DataFrame | None) -> DataFrame:
    """Ports with junctions closer than limit `col` of the picture."""
    size, r = F.lit(WIDE_CELL), F.col("reach").cast("bigint")
    p = ports.join(reach.select("image_id", F.col(col).alias("reach")), "image_id")
    b = junctions.select("image_id", F.col("jx").alias("qx"), F.col("jy").alias("qy"), "jord")
    d = geom.dist(F.col("px"), F.col("py"), F.col("qx"), F.col("qy"))
    pairs = spatial.met(p, b, crowd, lambda a: spatial.with_near_cells(a, F.col("px"), F.col("py"), size, r),
                        lambda b: spatial.with_cell(b, F.col("qx"), F.col("qy"), size))
    return pairs.withColumn("d", d).where(F.col("d") < F.col("reach")).drop("reach")


def _nearest_junction(cand: DataFrame, stage: int, carried: tuple = ()) -> DataFrame:
    return cand.groupBy("image_id", "ci", "pi", *carried).agg(F.min(F.struct("d", "jord", "qx", "qy")).alias("b")).select(
        "image_id", "ci", "pi", F.col("b.qx").alias("jx"), F.col("b.qy").alias("jy"), order(stage, F.col("ci"), F.col("pi")).alias("ord"), *carried)


PORT = ("px", "py", "n_ports")


def nearest_junctions(ports: DataFrame, junctions: DataFrame, comps: DataFrame, limits: DataFrame, carried: tuple = ()) -> DataFrame:
    """Each port to the nearest junction in reach with a free line; `carried` columns of the port come along."""
    crowd = spatial.crowded(ports, junctions, comps)
    cand = _junctions_near(ports, junctions, limits, "pjr", crowd)
    return _nearest_junction(_clear(cand, comps, ["ci", "pi", "qx", "qy"], crowd), 0, carried)


def drop_own_shorts(links: DataFrame, ports: DataFrame) -> DataFrame:
    """Two-port components keep their nearest link to a junction; larger ones with all ports on one keep two.

    The window runs inside one component and junction: at most as many rows as the component has ports. Links may carry
    PORT, the columns of their port, which then need no join and go.
    """
    at = links if set(PORT) <= set(links.columns) else links.join(ports.select("image_id", "ci", "pi", *PORT), ["image_id", "ci", "pi"])
    at = at.withColumn("d", geom.dist(F.col("px"), F.col("py"), F.col("jx"), F.col("jy")))
    here = W.partitionBy("image_id", "ci", "jx", "jy")
    at = at.withColumn("k", count_all().over(here)).withColumn("r", F.row_number().over(here.orderBy("d", "ord")))
    bad = ((F.col("n_ports") == 2) & (F.col("r") > 1)) | ((F.col("n_ports") >= 3) & (F.col("k") == F.col("n_ports")) & (F.col("r") > 2))
    return at.where(~bad).select(*[c for c in links.columns if c not in PORT])


def second_junctions(ports: DataFrame, junctions: DataFrame, comps: DataFrame, limits: DataFrame, links: DataFrame,
                     stage: int = 2) -> DataFrame:
    """Links for still open ports to the nearest junction in the smaller reach.

    The two ports of a two-port component may not meet at one junction. Only there does one choice
    bear on another, so first ports go first and second ports see the result.
    """
    crowd = spatial.crowded(ports, junctions, comps)
    cand = _clear(_junctions_near(_open_ports(ports, links, crowd), junctions, limits, "pjf", crowd), comps, ["ci", "pi", "qx", "qy"], crowd)
    cand = cut(cand.drop("px", "py", "name"), "second")
    pair = F.col("n_ports") == 2

    def without_other(c, held):
        taken = held.select("image_id", "ci", (1 - F.col("pi")).alias("pi"), F.col("jx").alias("qx"), F.col("jy").alias("qy")).distinct()
        return c.where(~pair).unionByName(c.where(pair).join(taken, ["image_id", "ci", "pi", "qx", "qy"], "left_anti"))
    first = cut(_nearest_junction(without_other(cand.where(~pair | (F.col("pi") == 0)), links), stage), "second")
    rest = _nearest_junction(without_other(cand.where(pair & (F.col("pi") == 1)), links.select(
        "image_id", "ci", "pi", "jx", "jy").unionByName(first.select("image_id", "ci", "pi", "jx", "jy"))), stage)
    return first.unionByName(rest)


# ---- ports to ports -----------------------------------------------------------------------------------
def _partners(left: DataFrame, right: DataFrame, reach: Column | int, crowd: DataFrame | None, drop: str | None = None) -> DataFrame:
    """Ports of different components closer than `reach`: left columns plus cj, pj, qx, qy, nameq, d."""
    size = F.lit(WIDE_CELL)
    r = reach if isinstance(reach, Column) else F.lit(reach)
    b = right.select("image_id", F.col("ci").alias("cj"), F.col("pi").alias("pj"), F.col("px").alias("qx"), F.col("py").alias("qy"), F.col("name").alias("nameq"))
    d = geom.dist(F.col("px"), F.col("py"), F.col("qx"), F.col("qy"))
    pairs = spatial.met(left, b, crowd, lambda a: spatial.with_near_cells(a, F.col("px"), F.col("py"), size, r.cast("bigint")),
                        lambda b: spatial.with_cell(b, F.col("qx"), F.col("qy"), size))
    return pairs.where(F.col("ci") != F.col("cj")).withColumn("d", d).where(F.col("d") < r).drop(*([drop] if drop else []))


def settle_choices(choices: DataFrame) -> DataFrame:
    """Which of choices(image_id, p, t) act when ports go in order of p and a port already chosen by an
    earlier acting one stays still. Returns the acting rows.

    """
    walk = choices.withColumn("a", F.col("p")).withColumn("b", F.col("p")).withColumn("ord", F.col("p"))
    return graph.walked(walk, F.array("p", "t"), "image_id", 1, _settle_in_rounds).drop("a", "b", "ord")


def _settle_in_rounds(choices: DataFrame) -> DataFrame:
    """A port waits only for earlier ports that chose it; every round settles all ports whose choosers
    are settled or one of whose choosers acts.
    """
    made = cut(choices, "choices")
    waits = cut(made.select("image_id", F.col("p").alias("q"), F.col("t").alias("p")).where("q < p").join(
        made.select("image_id", "p"), ["image_id", "p"]), "waits")
    state = cut(made.join(waits.select("image_id", "p").distinct().withColumn("w", F.lit(True)), ["image_id", "p"], "left")
                .select("image_id", "p", F.when(F.col("w").isNull(), F.lit(True)).alias("acts")), "acts")
    while True:
        seen = (waits.join(state.select("image_id", F.col("p").alias("q"), F.col("acts").alias("q_acts")), ["image_id", "q"])
                .groupBy("image_id", "p").agg(F.coalesce(F.bool_or("q_acts"), F.lit(False)).alias("beaten"),
                                              F.bool_or(F.col("q_acts").isNull()).alias("pending")))
        nxt, metrics = cut_counting(
            state.join(seen, ["image_id", "p"], "left").select("image_id", "p", F.when(F.col("acts").isNotNull(), F.col("acts")).when(
                F.col("beaten"), F.lit(False)).when(~F.col("pending"), F.lit(True)).alias("acts")), "acts",
            open=F.sum(F.col("acts").isNull().cast("int")))
        drop_table(state)
        state = nxt
        if not metrics["open"]:
            return made.join(state.where("acts"), ["image_id", "p"]).drop("acts")


def _midpoint_links(pairs: DataFrame, stage: int) -> DataFrame:
    """Both ports of pairs(ci, pi, cj, pj, px, py, qx, qy) linked to their midpoint."""
    m = pairs.withColumn("jx", geom.half(F.col("px"), F.col("qx"))).withColumn("jy", geom.half(F.col("py"), F.col("qy")))
    ends = F.array(F.struct(F.col("ci").alias("c"), F.col("pi").alias("p"), F.lit(0).alias("side")),
                   F.struct(F.col("cj").alias("c"), F.col("pj").alias("p"), F.lit(1).alias("side")))
    return m.select("image_id", "ci", "pi", "jx", "jy", F.inline(ends)).select(
        "image_id", F.col("c").alias("ci"), F.col("p").alias("pi"), "jx", "jy",
        order(stage, F.col("ci"), F.col("pi"), F.lit(0), F.col("side")).alias("ord"))


def add_junctions(junctions: DataFrame, links: DataFrame) -> DataFrame:
    """Junction list with the new link targets behind it, in the order of their first link."""
    new = links.groupBy("image_id", "jx", "jy").agg(F.min("ord").alias("jord")).join(
        junctions.select("image_id", "jx", "jy"), ["image_id", "jx", "jy"], "left_anti")
    return junctions.unionByName(new.select("image_id", "jx", "jy", F.struct(
        F.col("jord.s").alias("s"), *[F.col(f"jord.{n}").alias(n) for n in "abcd"]).alias("jord")))


def port_fallback(ports: DataFrame, comps: DataFrame, limits: DataFrame, links: DataFrame, limit: str, stage: int) -> DataFrame:
    """Links for open ports to the nearest port of another component below limit column `limit`.

    Aligned pairs (a coordinate within 15) need no free line. A port chosen by an earlier one stays still.
    """
    crowd = spatial.crowded(ports, comps)
    left = _open_ports(ports, links, crowd).join(limits.select("image_id", F.col(limit).alias("reach")), "image_id")
    cand = _partners(left, ports, F.col("reach"), crowd, drop="reach")
    aligned = (F.abs(F.col("px") - F.col("qx")) < 15) | (F.abs(F.col("py") - F.col("qy")) < 15)
    ok = _clear(cand, comps, ["ci", "pi", "cj", "pj"], crowd, waived=aligned)
    best = ok.groupBy("image_id", "ci", "pi", "px", "py").agg(F.min(F.struct("d", "cj", "pj", "qx", "qy")).alias("b")).select(
        "image_id", "ci", "pi", "px", "py", F.col("b.cj").alias("cj"), F.col("b.pj").alias("pj"), F.col("b.qx").alias("qx"),
        F.col("b.qy").alias("qy"), port_id().alias("p")).withColumn("t", port_id("cj", "pj"))
    return _midpoint_links(settle_choices(best), stage)


def close_ports(ports: DataFrame, links: DataFrame, stage: int = 6, reach: int = 50) -> DataFrame:
    """Open ports of different components within reach, paired greedily in index order; never two grounds."""
    crowd = spatial.crowded(ports)
    free = cut(_open_ports(ports, links, crowd), "free")
    cand = _partners(free, free, reach, crowd).where((F.col("ci") < F.col("cj")) & ~((F.col("name") == "GND") & (F.col("nameq") == "GND")))
    pairs = cand.withColumn("a", port_id()).withColumn("b", port_id("cj", "pj")).withColumn("ord", F.struct("a", "b")).select(
        "image_id", "a", "b", "ord", "ci", "pi", "cj", "pj", "px", "py", "qx", "qy")
    return _midpoint_links(graph.greedy_matching(pairs), stage)


def sight_lines(ports: DataFrame, comps: DataFrame, links: DataFrame, stage: int = 4, band: int = 25) -> DataFrame:
    """Ports on one line with no third box between, not both linked; the closest pair of each two components."""
    crowd = spatial.crowded(ports, comps)
    linked = links.select("image_id", "ci", "pi").distinct().withColumn("on", F.lit(True))
    p = spatial.laid(ports, crowd).join(linked, ["image_id", "ci", "pi"], "left").select(
        "image_id", "ci", "pi", "px", "py", (F.col("name") == "GND").alias("gnd"), F.coalesce("on", F.lit(False)).alias("on"))
    cand = spatial.split(p, crowd, lambda few: _in_sight(few, comps, band), lambda many: sweep.ports_in_sight(
        cut(many, "sight"), comps.join(crowd, "image_id", "left_semi"), band))
    d = geom.dist(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    best = cand.groupBy("image_id", "ia", "ib").agg(
        F.min(F.struct(d.alias("d"), "pa", "pb", "ax", "ay", "bx", "by")).alias("w"), F.min("pa").alias("first"))
    ends = F.array(F.struct(F.col("ia").alias("ci"), F.col("w.pa").cast("int").alias("pi"), F.lit(0).alias("side")),
                   F.struct(F.col("ib").alias("ci"), F.col("w.pb").cast("int").alias("pi"), F.lit(1).alias("side")))
    return best.select("image_id", "ia", "ib", "first", geom.half(F.col("w.ax"), F.col("w.bx")).alias("jx"),
                       geom.half(F.col("w.ay"), F.col("w.by")).alias("jy"), F.inline(ends)).select(
        "image_id", "ci", "pi", "jx", "jy", order(stage, F.col("ia"), F.col("first"), F.col("ib"), F.col("side")).alias("ord"))


def _in_sight(ports: DataFrame, comps: DataFrame, band: int) -> DataFrame:
    """As `sweep.ports_in_sight`, by the pairs of a picture."""
    ports = cut(ports, "sight")
    side = lambda s: ports.select("image_id", F.col("ci").cast("bigint").alias(f"i{s}"), F.col("pi").cast("bigint").alias(f"p{s}"), F.col("px").cast("bigint").alias(f"{s}x"),
                                     F.col("py").cast("bigint").alias(f"{s}y"), F.col("gnd").alias(f"gnd{s}"), F.col("on").alias(f"on{s}"))
    dx, dy = F.abs(F.col("ax") - F.col("bx")), F.abs(F.col("ay") - F.col("by"))
    across, down = (dy < band) & (dx > 5), (dx < band) & (dy > 5)
    pairs = side("a").join(side("b"), "image_id").where(
        (F.col("ia") < F.col("ib")) & (across | down) & ~(F.col("gnda") & F.col("gndb")) & ~(F.col("ona") & F.col("onb"))).withColumn("h", across)
    k = comps.select(F.col("image_id").alias("k_image"), F.col("idx").alias("k"), *[F.col(c).alias("k" + c) for c in ("x1", "y1", "x2", "y2")])

    def between(u, v):
        near, far = F.least(f"a{u}", f"b{u}"), F.greatest(f"a{u}", f"b{u}")
        return (F.col(f"k{u}2") > near + 5) & (F.col(f"k{u}1") < far - 5) & (F.col(f"k{v}1") < F.col(f"a{v}") + band) & (F.col(f"k{v}2") > F.col(f"a{v}") - band)
    wall = (F.col("k") != F.col("ia")) & (F.col("k") != F.col("ib")) & F.when(F.col("h"), between("x", "y")).otherwise(between("y", "x"))
    return pairs.join(k, (pairs["image_id"] == k["k_image"]) & wall, "left_anti").select("image_id", "ia", "pa", "ib", "pb", "ax", "ay", "bx", "by")


def force_last(ports: DataFrame, junctions: DataFrame, comps: DataFrame, links: DataFrame, stage: int = 5, reach: int = 500) -> DataFrame:
    """Components with one open port: to the nearest junction in reach that holds none of their other ports."""
    crowd = spatial.crowded(ports, junctions, comps)
    open_ = cut(_open_ports(ports, links, crowd), "open")
    lonely = spatial.laid(open_, crowd).join(open_.groupBy("image_id", "ci").agg(count_all().alias("k")).where("k = 1").select("image_id", "ci"), ["image_id", "ci"])
    cand = _junctions_near(lonely, junctions, open_.select("image_id").distinct().withColumn("r", F.lit(reach)), "r", crowd)
    held = links.select("image_id", "ci", F.col("jx").alias("qx"), F.col("jy").alias("qy")).distinct()
    return _nearest_junction(_clear(cand.join(held, ["image_id", "ci", "qx", "qy"], "left_anti"), comps, ["ci", "pi", "qx", "qy"], crowd), stage)


# ---- junctions to junctions -----------------------------------------------------------------------------
EVERY = "every"


def _pins_at(links: DataFrame, comps: DataFrame) -> DataFrame:
    """Ports of each component on a junction, and whether it is no ground."""
    at = links.groupBy("image_id", "jx", "jy", "ci").agg(F.sort_array(F.collect_set("pi")).alias("pins"))
    return at.join(comps.select("image_id", F.col("idx").alias("ci"), (F.col("name") != "GND").alias("live")), ["image_id", "ci"])


def junction_pairs(junctions: DataFrame, links: DataFrame, comps: DataFrame, limits: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """Candidate pairs (image_id, ax, ay, bx, by, d, oa, ob), a before b in the junction list.

    Near (12) or aligned within limits; not sharing all components, not shorting one, not grounds only. With `ends`
    (image_id, ax, ay), only pairs of these junctions, each with the end first, whatever the order.
    """
    crowd = spatial.crowded(junctions, links)
    j = junctions.join(limits.select("image_id", "jj_align", "jj_max"), "image_id")
    if crowd is None:
        return _few_pairs(j, links, comps, ends)
    few = _few_pairs(j.join(crowd, "image_id", "left_anti"), links, comps, ends)
    return few.unionByName(_many_pairs(j.join(crowd, "image_id", "left_semi"), links.join(crowd, "image_id", "left_semi"), comps, ends))


def _hung(links: DataFrame, comps: DataFrame) -> DataFrame:
    """(image_id, jx, jy, pins, live): the ports on each junction, by component, and whether one is no ground."""
    return _pins_at(links, comps).groupBy("image_id", "jx", "jy").agg(F.collect_list(F.struct("ci", "pins")).alias("pins"), F.bool_or("live").alias("live"))


def _few_pairs(j: DataFrame, links: DataFrame, comps: DataFrame, ends: DataFrame | None) -> DataFrame:
    """`junction_pairs` by the pairs of a picture; with `ends`, or if that is EVERY junction, both ways."""
    own = F.transform(F.array_sort("pins"), lambda p: p["ci"])
    at = cut(j.join(_hung(links, comps), ["image_id", "jx", "jy"], "left").select("*", own.alias("cs")), "jj")
    side = lambda s, *more: at.select("image_id", *[F.col(c).alias(n) for c, n in (
        ("jx", f"{s}x"), ("jy", f"{s}y"), ("jord", f"o{s}"), ("pins", f"pins{s}"), ("live", f"live{s}"), ("cs", f"cs{s}"))], *more)
    a, ordered = side("a", "jj_align", "jj_max"), F.col("oa") < F.col("ob")
    if ends is not None:
        a, ordered = a if ends is EVERY else a.join(ends, ["image_id", "ax", "ay"], "left_semi"), F.col("oa") != F.col("ob")
    d = geom.dist(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    dx, dy = F.abs(F.col("ax") - F.col("bx")), F.abs(F.col("ay") - F.col("by"))
    line = (((dy < F.col("jj_align")) & (dx > 10)) | ((dx < F.col("jj_align")) & (dy > 10))) & (d < F.col("jj_max"))
    short = F.exists("pinsa", lambda p: F.exists("pinsb", lambda q: (p["ci"] == q["ci"]) & (p["pins"] != q["pins"])))
    pairs = a.join(side("b"), "image_id").where(ordered & ((d < 12) | line) & (F.coalesce("livea", F.lit(False)) | F.coalesce("liveb", F.lit(False))))
    return pairs.where(~F.coalesce((F.size("csa") > 0) & (F.col("csa") == F.col("csb")), F.lit(False)) & ~F.coalesce(short, F.lit(False))).select(
        "image_id", "ax", "ay", "bx", "by", d.alias("d"), "oa", "ob", *(["jj_align"] if ends is EVERY else []))


def _many_pairs(j: DataFrame, links: DataFrame, comps: DataFrame, ends: DataFrame | None) -> DataFrame:
    """`junction_pairs` by cells."""
    j = cut(j, "jj")
    a = j.select("image_id", F.col("jx").alias("ax"), F.col("jy").alias("ay"), F.col("jord").alias("oa"), "jj_align", "jj_max")
    b = j.select("image_id", F.col("jx").alias("bx"), F.col("jy").alias("by"), F.col("jord").alias("ob"), "jj_align", "jj_max")
    ordered = F.col("oa") < F.col("ob")
    if ends is not None:
        a, ordered = a.join(ends, ["image_id", "ax", "ay"], "left_semi"), F.col("oa") != F.col("ob")
    def keys(x, y):
        f = lambda v, s: F.floor(v / s).cast("bigint")
        al, mx = F.col("jj_align"), F.col("jj_max")
        return [("n", f(x, F.lit(12)), f(y, F.lit(12))), ("h", f(x, mx), f(y, al)), ("v", f(x, al), f(y, mx))]
    one = F.array(*[F.struct(F.lit(w).alias("way"), u.alias("u"), v.alias("v")) for w, u, v in keys(F.col("ax"), F.col("ay"))])
    nine = F.array(*[F.struct(F.lit(w).alias("way"), (u + i).alias("u"), (v + k).alias("v"))
                     for w, u, v in keys(F.col("bx"), F.col("by")) for i in (-1, 0, 1) for k in (-1, 0, 1)])
    d = geom.dist(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    dx, dy = F.abs(F.col("ax") - F.col("bx")), F.abs(F.col("ay") - F.col("by"))
    line = (((dy < F.col("jj_align")) & (dx > 10)) | ((dx < F.col("jj_align")) & (dy > 10))) & (d < F.col("jj_max"))
    pairs = (a.select("*", F.inline(one)).join(b.drop("jj_align", "jj_max").join(j.select("image_id", "jj_align", "jj_max").distinct(), "image_id")
                                              .select("image_id", "bx", "by", "ob", F.inline(nine)), ["image_id", "way", "u", "v"])
             .where(ordered & ((d < 12) | line)).withColumn("d", d)
             .select("image_id", "ax", "ay", "bx", "by", "d", "oa", "ob").distinct())
    at = cut(_pins_at(links, comps), "at")
    stat = at.groupBy("image_id", "jx", "jy").agg(count_all().alias("n"), F.count_if("live").alias("live"))
    def side(df, x, y, s):
        return df.select("image_id", F.col("jx").alias(x), F.col("jy").alias(y), *[F.col(c).alias(c + s) for c in df.columns if c not in ("image_id", "jx", "jy")])
    pairs = cut(pairs, "jj")
    both = (pairs.select("image_id", "ax", "ay", "bx", "by").join(side(at.drop("live"), "ax", "ay", "1").withColumnRenamed("ci1", "ci"), ["image_id", "ax", "ay"])
            .join(side(at.drop("live"), "bx", "by", "2").withColumnRenamed("ci2", "ci"), ["image_id", "bx", "by", "ci"])
            .groupBy("image_id", "ax", "ay", "bx", "by").agg(count_all().alias("shared"), F.bool_or(F.col("pins1") != F.col("pins2")).alias("short")))
    out = (pairs.join(side(stat, "ax", "ay", "1"), ["image_id", "ax", "ay"], "left").join(side(stat, "bx", "by", "2"), ["image_id", "bx", "by"], "left")
           .join(both, ["image_id", "ax", "ay", "bx", "by"], "left").na.fill(0, ["n1", "n2", "live1", "live2", "shared"]))
    same = (F.col("shared") > 0) & (F.col("shared") == F.col("n1")) & (F.col("shared") == F.col("n2"))
    return out.where(~same & ~F.coalesce("short", F.lit(False)) & ((F.col("live1") > 0) | (F.col("live2") > 0))).select(
        "image_id", "ax", "ay", "bx", "by", "d", "oa", "ob")


def nearest_by_direction(junctions: DataFrame, links: DataFrame, comps: DataFrame, limits: DataFrame) -> DataFrame:
    """Directed links (ax, ay) -> (bx, by): the closest partner, as of `junction_pairs`, to the left, right, above and
    below, found by a sweep over sorted lanes; no pairs are formed."""
    crowd = spatial.crowded(junctions, links)
    placed = junctions.join(limits.select("image_id", "jj_align", "jj_max"), "image_id")

    def by_lane(many):
        points = many.join(_hung(links.join(crowd, "image_id", "left_semi"), comps), ["image_id", "jx", "jy"], "left").select(
            "image_id", F.col("jx").alias("x"), F.col("jy").alias("y"), "jord", F.col("jj_align").alias("align"), F.col("jj_max").alias("most"), "pins",
            F.coalesce("live", F.lit(False)).alias("live"))
        return sweep.nearest_valid(points)

    def by_pair(few):
        x, y, align = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("jj_align")
        ways = [(F.abs(y) < align) & (x < 0), (F.abs(y) < align) & (x > 0), (F.abs(x) < align) & (y < 0), (F.abs(x) < align) & (y > 0)]
        found = _few_pairs(few, links, comps, EVERY).withColumn("way", F.explode(F.filter(F.array(*[F.when(w, i) for i, w in enumerate(ways)]), lambda w: w.isNotNull())))
        best = F.min(F.struct("d", F.least("oa", "ob").alias("lo"), F.greatest("oa", "ob").alias("hi"), "bx", "by")).alias("b")
        return found.groupBy("image_id", "ax", "ay", "way").agg(best).select(
            "image_id", *[F.col(c).cast("bigint").alias(n) for c, n in (("ax", "ax"), ("ay", "ay"), ("b.bx", "bx"), ("b.by", "by"))], "way")

    return spatial.split(placed, crowd, by_pair, by_lane)


def in_list_order(jj: DataFrame, junctions: DataFrame, links: DataFrame, comps: DataFrame, limits: DataFrame, cap: int = CAP) -> DataFrame:
    """Links with `ord`, the place at which the published walk meets them: by the first pair of the starting junction,
    then by direction. Only links with an end of more than `cap` links need it; the others get a null place."""
    at = lambda e: jj.select("image_id", F.col(f"{e}x").alias("ex"), F.col(f"{e}y").alias("ey"))
    busy = cut(at("a").unionByName(at("b")).groupBy("image_id", "ex", "ey").agg(count_all().alias("n")).where(F.col("n") > cap).select("image_id", "ex", "ey"), "busy")
    touch = [jj.join(busy.withColumnsRenamed({"ex": f"{e}x", "ey": f"{e}y"}), ["image_id", f"{e}x", f"{e}y"], "left_semi").select("image_id", "ax", "ay") for e in "ab"]
    ends = cut(touch[0].unionByName(touch[1]).distinct(), "ends")
    found = junction_pairs(junctions, links, comps, limits, ends)
    seen = found.groupBy("image_id", "ax", "ay").agg(F.min(F.struct(
        F.least("oa", "ob").alias("oa"), F.greatest("oa", "ob").alias("ob"), (F.col("oa") > F.col("ob")).cast("int").alias("side"))).alias("seen"))
    return jj.join(seen, ["image_id", "ax", "ay"], "left").withColumn("ord", F.struct("seen", "way")).drop("seen")


def degree_cap(jj: DataFrame, limit: int = CAP) -> DataFrame:
    """Links kept while both junctions have fewer than `limit` (eight branches assumed, plus two)."""
    p = spatial.settled(jj.withColumn("a", point_id(F.col("ax"), F.col("ay"))).withColumn("b", point_id(F.col("bx"), F.col("by"))), jj)
    return graph.capped_pairs(p, limit).drop("a", "b")


def same_wire(junctions: DataFrame, wires: DataFrame, margin: int = 5) -> DataFrame:
    """(image_id, wire, n): junctions inside each wire box grown by `margin`; two of one wire are joined."""
    size = F.lit(CELL_SIZE)
    w = wires.select("image_id", "wire", *[c.alias(n) for c, n in zip(geom.grow(geom.box(""), margin), ("wx1", "wy1", "wx2", "wy2"))])
    a = spatial.with_cells(w, F.col("wx1"), F.col("wy1"), F.col("wx2"), F.col("wy2"), size)
    b = spatial.with_cell(junctions.select("image_id", "jx", "jy"), F.col("jx"), F.col("jy"), size)
    return a.join(b, ["image_id", *spatial.CELL]).where(
        F.col("jx").between(F.col("wx1"), F.col("wx2")) & F.col("jy").between(F.col("wy1"), F.col("wy2"))).select("image_id", "wire", "jx", "jy")


# ---- groups -------------------------------------------------------------------------------------------------
def reverse_pairs(links: DataFrame, ports: DataFrame) -> DataFrame:
    """Edges (image_id, a, b) between ports that are each other's link target."""
    here = ports.groupBy("image_id", F.col("px").alias("jx"), F.col("py").alias("jy")).agg(F.max(port_id()).alias("b"))
    at = ports.select("image_id", port_id().alias("a"), "px", "py")
    out = links.select("image_id", port_id().alias("a"), "jx", "jy").join(here, ["image_id", "jx", "jy"]).join(at, ["image_id", "a"])
    back = links.select("image_id", port_id().alias("b"), F.col("jx").alias("px"), F.col("jy").alias("py"))
    return out.join(back, ["image_id", "b", "px", "py"], "left_semi").select("image_id", "a", "b").distinct()


def _group_edges(links: DataFrame, jj: DataFrame, between_comps: bool) -> DataFrame:
    at = links.select("image_id", "jx", "jy", port_id().alias("p"), "ord")
    lead = at.groupBy("image_id", "jx", "jy").agg(F.min_by("p", "ord").alias("lead"))
    star = at.join(lead, ["image_id", "jx", "jy"]).where("p <> lead")
    if between_comps:
        star = star.where(component_of(F.col("p")) != component_of(F.col("lead")))
    la = lead.select("image_id", F.col("jx").alias("ax"), F.col("jy").alias("ay"), F.col("lead").alias("a"))
    lb = lead.select("image_id", F.col("jx").alias("bx"), F.col("jy").alias("by"), F.col("lead").alias("b"))
    ties = jj.select("image_id", "ax", "ay", "bx", "by").join(la, ["image_id", "ax", "ay"]).join(lb, ["image_id", "bx", "by"])
    return star.select("image_id", F.col("lead").alias("a"), F.col("p").alias("b")).unionByName(ties.select("image_id", "a", "b"))


def _listed(ports: DataFrame, links: DataFrame, jj: DataFrame, *more: str) -> DataFrame:
    """(image_id, p, l, t): the ports, their links in order and the junction links of each picture as lists."""
    p = lists.gathered(ports.select("image_id", port_id().alias("id"), "px", "py", *more), "p")
    at = links.select("image_id", "ord", port_id().alias("id"), "jx", "jy", *[c for c in links.columns if c not in ("image_id", "ord", "jx", "jy")])
    return (p.join(lists.gathered(at, "l", ordered=True), "image_id", "left")
            .join(lists.gathered(jj.select("image_id", "ax", "ay", "bx", "by"), "t"), "image_id", "left"))


def _grouped(found: DataFrame) -> DataFrame:
    rows = found.select("image_id", F.inline(F.arrays_zip("p", "g")))
    return rows.select("image_id", component_of(F.col("p.id")).alias("ci"), place_of(F.col("p.id")).alias("pi"), "g")


def port_groups(ports: DataFrame, links: DataFrame, jj: DataFrame, final: bool = False) -> DataFrame:
    """(image_id, ci, pi, g): ports joined through junctions; g is the smallest port of the group.

    The final pass keeps the first port of a junction apart from ports of its own component and adds
    no reverse pairs. The rows of a small picture meet in one list.
    """
    jj = spatial.counted(jj, "jj")
    crowd = spatial.crowded(ports, links, jj)
    return spatial.split(ports, crowd, lambda few: _grouped(_listed(few, links, jj).withColumn(
        "g", lists.grouped(F.col("p"), F.col("l"), F.col("t"), final))), lambda many: _groups_by_edges(
        many, links.join(crowd, "image_id", "left_semi"), jj.join(crowd, "image_id", "left_semi"), final))


def _groups_by_edges(ports: DataFrame, links: DataFrame, jj: DataFrame, final: bool) -> DataFrame:
    edges = _group_edges(links, jj, between_comps=final)
    if not final:
        edges = edges.unionByName(reverse_pairs(links, ports))
    nodes = ports.select("image_id", port_id().alias("node"))
    comp = graph.connected_components(nodes, edges)
    return comp.select("image_id", component_of(F.col("node")).alias("ci"), place_of(F.col("node")).alias("pi"), F.col("comp").alias("g"))


def unshort(ports: DataFrame, links: DataFrame, groups: DataFrame) -> DataFrame:
    """Links without those of the farther port of two-port components whose ports share a group."""
    p = ports.where("n_ports = 2").select("image_id", "ci", "pi", "px", "py")
    first = links.groupBy("image_id", "ci", "pi").agg(F.min_by(F.struct("jx", "jy"), "ord").alias("j"))
    at = p.join(first, ["image_id", "ci", "pi"]).join(groups, ["image_id", "ci", "pi"]).select(
        "image_id", "ci", "pi", "g", geom.dist(F.col("px"), F.col("py"), F.col("j.jx"), F.col("j.jy")).alias("d"))
    wide = at.groupBy("image_id", "ci").agg(*[F.max(F.when(F.col("pi") == i, F.col(c))).alias(f"{c}{i}") for i in (0, 1) for c in ("g", "d")])
    drop = wide.where("g0 = g1").select("image_id", "ci", F.when(F.col("d0") > F.col("d1"), 0).otherwise(1).alias("pi"))
    return links.join(drop, ["image_id", "ci", "pi"], "left_anti")


def eligible(groups: DataFrame) -> DataFrame:
    """Groups that join two components or more."""
    big = groups.groupBy("image_id", "g").agg((F.max("ci") != F.min("ci")).alias("ok")).where("ok").select("image_id", "g")
    return groups.join(big, ["image_id", "g"])


def settled_groups(ports: DataFrame, links: DataFrame, jj: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups that join two components or more, and the links left: `port_groups`, `unshort`, and the final pass.

    In small pictures all three go by the lists of a picture, which are made once.
    """
    jj = spatial.counted(jj, "jj")
    crowd = spatial.crowded(ports, links, jj)
    few = ports if crowd is None else ports.join(crowd, "image_id", "left_anti")
    p, l, t = (F.col(c) for c in "plt")
    found = _listed(few, links, jj, "n_ports").withColumn("g", lists.grouped(p, l, t)).withColumn("kept", lists.unshorted(p, F.col("g"), l))
    found = found.withColumn("l", F.transform(F.filter(F.arrays_zip("l", "kept"), lambda e: e["kept"]), lambda e: e["l"]))
    found = cut(found.select("image_id", "p", "l", lists.grouped(p, l, t, final=True, several=True).alias("g")), "groups")
    groups, kept = _grouped(found).where("g is not null"), found.select("image_id", F.inline("l")).select(*links.columns)
    if crowd is not None:
        ports, links, jj = (df.join(crowd, "image_id", "left_semi") for df in (ports, links, jj))
        held = cut(unshort(ports, links, _groups_by_edges(ports, links, jj, False)), "links")
        groups, kept = groups.unionByName(eligible(_groups_by_edges(ports, held, jj, True))), kept.unionByName(held)
    return groups, kept


# ---- routes ---------------------------------------------------------------------------------------------------
def bends(margin: int = 20) -> Column:
    """Ordered bend points of a link (px, py) -> (qx, qy). Their order is fixed: the first clear one is taken."""
    x1, y1, x2, y2 = (F.col(c) for c in ("px", "py", "qx", "qy"))
    mx, my = geom.half(x1, x2), geom.half(y1, y2)
    steps = [s * k * margin for k in (1, 2, 3) for s in (1, -1)]
    pts = [(x2, y1), (x1, y2)] + [(x2 + s, y1) for s in steps] + [(x1, y2 + s) for s in steps]
    for k in (1, 2):
        m = k * margin
        pts += [(mx + m, my), (mx - m, my), (mx, my + m), (mx, my - m)]
    return F.array(*[F.struct(F.lit(i).alias("n"), x.cast("bigint").alias("mx"), y.cast("bigint").alias("my")) for i, (x, y) in enumerate(pts)])


WAVES = (2, 8, 22)  # bends are tried in this many steps; lines that found one take no further part


def routes(lines: DataFrame, comps: DataFrame, ports: DataFrame) -> DataFrame:
    """(image_id, line, n, mx, my) for lines(image_id, line, own, px, py, qx, qy, port_link): the first bend
    with both legs clear; n = -1 for the straight line of a port link that is clear or ends at a port.

    `line` is any key that is unique in its picture; `own` is the component a port link starts from, -1 for others.
    """
    crowd = spatial.crowded(ports, comps)
    clear = lambda rows, keys, legs: spatial.split(rows, crowd, lambda few: _unmet(few, comps, F.col("own"), legs), lambda many: many.join(
        crossing(reduce(DataFrame.unionByName, [many.select("image_id", *keys, "own", *[F.col(c).alias(n) for c, n in zip(leg, ("sx1", "sy1", "sx2", "sy2"))]) for leg in legs]), comps, keys),
        ["image_id", *keys], "left_anti"))
    pending, found, low = cut(lines, "lines"), None, 0
    for high in WAVES:
        cand = spatial.laid(pending, crowd).select("*", F.inline(F.slice(bends(), low + 1, high - low)))
        free = clear(cand, ["line", "n"], [("px", "py", "mx", "my"), ("mx", "my", "qx", "qy")])
        best = free.groupBy("image_id", "line").agg(F.min(F.struct("n", "mx", "my")).alias("b")).select("image_id", "line", "b.n", "b.mx", "b.my")
        best = cut(best, "routes")
        found = best if found is None else found.unionByName(best)
        pending, seen = cut_counting(pending.join(best.select("image_id", "line"), ["image_id", "line"], "left_anti"), "lines", n=count_all())
        if not seen["n"]:
            return found
        low = high
    rest = pending.where("port_link")
    spots = ports.select("image_id", F.col("px").alias("qx"), F.col("py").alias("qy"))
    keys = ["image_id", "line"]
    on_port = rest.join(spots, ["image_id", "qx", "qy"], "left_semi").select(*keys)
    straight = on_port.unionByName(clear(rest.join(spots, ["image_id", "qx", "qy"], "left_anti"), ["line"], [("px", "py", "qx", "qy")]).select(*keys))
    return found.unionByName(straight.select(*keys, F.lit(-1).alias("n"), F.lit(None).cast("bigint").alias("mx"), F.lit(None).cast("bigint").alias("my")))


def lines_of(links: DataFrame, jj: DataFrame, ports: DataFrame) -> DataFrame:
    """Lines to route: links of ports to junctions, and links between junctions (both ways are lines of their own)."""
    def key(kind, x, y, way):
        return F.struct(F.lit(kind).alias("kind"), x.alias("from"), y.alias("to"), way.cast("int").alias("way")).alias("line")
    to = point_id(F.col("jx"), F.col("jy"))
    first = links.join(ports.select("image_id", "ci", "pi", "px", "py"), ["image_id", "ci", "pi"]).select(
        "image_id", key(0, port_id(), to, F.lit(0)), F.col("ci").cast("bigint").alias("own"), "px", "py", F.col("jx").alias("qx"), F.col("jy").alias("qy"), F.lit(True).alias("port_link")).distinct()
    way = F.col("way") if "way" in jj.columns else F.lit(0)
    second = jj.select("image_id", key(1, point_id(F.col("ax"), F.col("ay")), point_id(F.col("bx"), F.col("by")), way), F.lit(-1).cast("bigint").alias("own"),
                       F.col("ax").alias("px"), F.col("ay").alias("py"), F.col("bx").alias("qx"), F.col("by").alias("qy"), F.lit(False).alias("port_link"))
    return first.unionByName(second)


# ---- the whole run -----------------------------------------------------------------------------------------------
def prepare(comps: DataFrame, ports: DataFrame, raw_junctions: DataFrame, limits: DataFrame) -> dict[str, DataFrame]:
    """Everything that no switch changes: placed ports, junctions and links up to the port fallbacks. Written once, shared
    by all settings, as are the junction links that `wire` adds for each setting of the nearest filter."""
    comps, limits = cut(comps, "comps"), cut(limits, "limits")
    ports = cut(prepare_ports(ports), "ports")
    junctions = cut(prepare_junctions(raw_junctions, limits), "junctions")
    links = cut(drop_own_shorts(nearest_junctions(ports, junctions, comps, limits, PORT), ports), "links")
    more = cut(port_fallback(ports, comps, limits, links, "p2p_max", 1), "more")
    links, junctions = cut(links.unionByName(more), "links"), cut(add_junctions(junctions, more), "junctions")
    links = cut(links.unionByName(second_junctions(ports, junctions, comps, limits, links, 2)), "links")
    more = cut(port_fallback(ports, comps, limits, links, "agg_p2p", 3), "more")
    links, junctions = cut(links.unionByName(more), "links"), cut(add_junctions(junctions, more), "junctions")
    return {"comps": comps, "limits": limits, "ports": ports, "junctions": junctions, "links": links}


def _junction_links(prepared: dict[str, DataFrame], nearest: bool) -> DataFrame:
    key = "nearest" if nearest else "pairs"
    if key not in prepared:
        args = [prepared[k] for k in ("junctions", "links", "comps", "limits")]
        if nearest:
            jj = in_list_order(cut(nearest_by_direction(*args), "nearest"), *args)
        else:
            jj = junction_pairs(*args).withColumn("ord", F.struct("oa", "ob"))
        prepared[key] = cut(jj, "jj")
    return prepared[key]


VECTOR_SWITCHES = ("use_nn_filter", "use_degree_constraint", "use_los", "use_force_connect", "use_close_port")


def in_effect(switches: dict | None) -> tuple:
    """The values of the switches that `wire` reads; settings that agree in them give the same groups."""
    on = {**dims.DEFAULT_SWITCHES, **(switches or {})}
    return tuple(bool(on[k]) for k in VECTOR_SWITCHES)


def wire(prepared: dict[str, DataFrame], switches: dict | None = None) -> dict[str, DataFrame]:
    """Groups, links, junction links and junctions of all pictures under one set of switches. Made once for `prepared` and
    the switches in effect, and kept with it as are its tables."""
    own = switches or {}
    raster = [k for k in dims.RASTER_SWITCHES if own.get(k)]
    if raster:
        raise ValueError(f"these switches need pictures, which the vector path does not read: {', '.join(raster)}")
    on = {**dims.DEFAULT_SWITCHES, **own}
    if (made := prepared.get(in_effect(own))) is not None:
        return made
    comps, limits, ports, junctions, links = (prepared[k] for k in ("comps", "limits", "ports", "junctions", "links"))
    jj = _junction_links(prepared, on["use_nn_filter"])
    spatial.crowded(jj)
    if on["use_degree_constraint"]:
        jj = degree_cap(jj)
    if on["use_los"]:
        links = cut(links.unionByName(sight_lines(ports, comps, links)), "links")
    if on["use_force_connect"]:
        links = cut(links.unionByName(force_last(ports, junctions, comps, links)), "links")
    if on["use_close_port"]:
        more = cut(close_ports(ports, links), "more")
        links, junctions = cut(links.unionByName(more), "links"), cut(add_junctions(junctions, more), "junctions")
    groups, kept = settled_groups(ports, links, jj)
    made = {"groups": groups, "links": kept, "all_links": links, "jj": jj, "junctions": junctions, "ports": ports}
    prepared[in_effect(own)] = made
    return made
