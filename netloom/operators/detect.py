"""Detector boxes to components and ports: routing, naming, ports, overlaps, designators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from netloom.functions import dims, geom
from netloom.operators import graph, ranks, spatial

CELL_SIZE = 128  # pixels; boxes are registered in every cell they touch


# ---- filters ------------------------------------------------------------------------------------
def route_boxes(raw: DataFrame) -> DataFrame:
    """Adds `route`: junction, text, component, or NULL for boxes that are dropped."""
    c, conf = F.col("cls"), F.col("conf")
    return raw.withColumn("route", F.when(c.isin("junction", "terminal") & (conf >= dims.JUNCTION_CONF), "junction")
                          .when((c == "text") & (conf >= dims.CONF["wiring"]), "text")
                          .when(~c.isin(*dims.SKIP["wiring"]) & (conf >= dims.CONF["wiring"]), "component"))


def profile_filter(raw: DataFrame, profile: str) -> DataFrame:
    """Boxes that count as components for the profile."""
    if profile == "wiring":
        return route_boxes(raw).where("route = 'component'").drop("route")
    return raw.where(~F.col("cls").isin(*dims.SKIP[profile]) & (F.col("conf") >= dims.CONF[profile]))


def is_part_class(c: Column) -> Column:
    """Class counted as a component when annotations are counted."""
    return ~c.isin(*dims.NOT_COMPONENTS)


def with_centre(df: DataFrame) -> DataFrame:
    return df.withColumn("cx", geom.half(F.col("x1"), F.col("x2"))).withColumn("cy", geom.half(F.col("y1"), F.col("y2")))


# ---- names and ports ----------------------------------------------------------------------------
def with_names(boxes: DataFrame, profile: str) -> DataFrame:
    """Adds name, display and port_key; a class without entry keeps its own name."""
    spark = boxes.sparkSession
    out = boxes.join(dims.mapping(spark, dims.NAMES[profile], "cls", "_name"), "cls", "left")
    for table, col in ((dims.DISPLAY.get(profile, {}), "display"), (dims.PORT_KEYS.get(profile, {}), "port_key")):
        if table:
            out = out.join(dims.mapping(spark, table, "cls", "_" + col), "cls", "left").withColumn(
                col, F.coalesce("_" + col, "cls")).drop("_" + col)
        elif col == "port_key":
            out = out.withColumn("port_key", F.coalesce("_name", "cls"))
        else:
            out = out.withColumn("display", F.coalesce("_name", "cls"))
    return out.withColumn("name", F.coalesce("_name", "cls")).drop("_name")


def aspect(b) -> Column:
    w, h = b[2] - b[0], b[3] - b[1]
    return h.cast("double") / F.greatest(w, F.lit(1))


def turned(b, cls: Column, name: Column, n_ports: Column, flat: Column) -> Column:
    """Whether a two-port component stands against its default direction, by the shape of its box."""
    w, h, r = b[2] - b[0], b[3] - b[1], aspect(b)
    low = F.lower(cls)
    by_shape = (F.when((w <= 0) | (h <= 0), F.lit(False))
                .when(low.contains("light_emitting"), r < 0.55)
                .when(low.contains("capacitor.polarized"), r < 0.75)
                .when(flat, r > 1.5).otherwise(r < 0.6))
    return (n_ports == 2) & ~cls.isin("gnd", "vss", "GND") & (name != "GND") & by_shape


def place_ports(comps: DataFrame, profile: str, always_one: bool | None = None) -> DataFrame:
    """Ports of each component from its template: (component columns, pi, px, py, n_ports).

    The annotation profile gives a class without template one port in the middle.
    """
    middle = profile == "annotation" if always_one is None else always_one
    t = dims.templates(comps.sparkSession, profile)
    out = comps.join(t, "port_key", "left" if middle else "inner")
    if middle:
        known = F.col("port_key").isin(*dims.TEMPLATES[profile])
        out = out.where(F.col("pi").isNotNull() | ~known).withColumn(
            "pi", F.coalesce("pi", F.lit(0))).withColumn("n_ports", F.coalesce("n_ports", F.lit(1))).withColumn(
            "flat", F.coalesce("flat", F.lit(False))).withColumn(
            "rx", F.coalesce("rx", F.lit(0.5))).withColumn("ry", F.coalesce("ry", F.lit(0.5)))
    b = geom.box("")
    if profile == "segments":
        turn = (b[3] - b[1]) > (b[2] - b[0])
    else:
        turn = turned(b, F.col("cls"), F.col("name"), F.col("n_ports"), F.col("flat"))
    sx = F.when(turn, F.lit(1.0) - F.col("ry")).otherwise(F.col("rx"))
    sy = F.when(turn, F.col("rx")).otherwise(F.col("ry"))
    return (out.withColumn("px", (b[0] + sx * (b[2] - b[0])).cast("bigint"))
            .withColumn("py", (b[1] + sy * (b[3] - b[1])).cast("bigint")).drop("rx", "ry", "flat"))


def side_ports(comps: DataFrame) -> DataFrame:
    """Segment profile for names without template: left and right middle."""
    b = geom.box("")
    cy = geom.half(b[1], b[3])
    pts = F.array(F.struct(F.lit(0).alias("pi"), b[0].alias("px"), cy.alias("py")),
                  F.struct(F.lit(1).alias("pi"), b[2].alias("px"), cy.alias("py")))
    return comps.where(~F.col("name").isin(*dims.TEMPLATES["segments"])).select("*", F.inline(pts)).withColumn(
        "n_ports", F.lit(2))


def with_labels(ports: DataFrame, profile: str, by_index: bool = False) -> DataFrame:
    """Port labels; `?` or the port index where the name has none."""
    lab = dims.labels(ports.sparkSession, profile)
    fallback = F.col("pi").cast("string") if by_index else F.lit("?")
    return ports.join(lab, ["name", "pi"], "left").withColumn("label", F.coalesce("label", fallback))


def thresholds(images: DataFrame) -> DataFrame:
    """Distance limits of each picture, scaled by its diagonal."""
    h, w = F.col("height").cast("double"), F.col("width").cast("double")
    out = images.withColumn("scale", F.sqrt(h * h + w * w) / dims.DIAGONAL)
    for name, (length, floor) in dims.SCALED.items():
        v = (F.lit(length) * F.col("scale")).cast("int")
        out = out.withColumn(name, v if floor is None else F.greatest(F.lit(floor), v))
    return out


# ---- designators --------------------------------------------------------------------------------
def prefix_of(name: Column, profile: str, spark) -> Column:
    table = F.create_map(*[F.lit(x) for kv in dims.PREFIXES[profile].items() for x in kv])
    other = F.substring(name, 1, 1) if profile == "annotation" else F.lit("X")
    return F.coalesce(F.try_element_at(table, name), other)


def designators(comps: DataFrame, profile: str, guard: ranks.SkewGuard | None = None) -> DataFrame:
    """Prefix plus running number per picture; the wiring profile leaves grounds unnumbered."""
    named = comps.withColumn("prefix", prefix_of(F.col("name"), profile, comps.sparkSession))
    out = ranks.row_number(named, ["image_id", "prefix"], ["idx"], "_no", guard=guard)
    label = F.concat("prefix", F.col("_no").cast("string"))
    if profile == "wiring":
        label = F.when(F.col("name") == "GND", F.lit("GND")).otherwise(label)
    return out.withColumn("designator", label).drop("_no", "prefix")


def reindex(comps: DataFrame, guard: ranks.SkewGuard | None = None) -> DataFrame:
    """Dense positions after removals."""
    return ranks.row_number(comps, ["image_id"], ["idx"], "new_idx", start=0, guard=guard)


# ---- overlaps -----------------------------------------------------------------------------------
def _prefixed(df: DataFrame, p: str) -> DataFrame:
    return df.select("image_id", *[F.col(c).alias(p + c) for c in df.columns if c != "image_id"])


def overlap_pairs(left: DataFrame, right: DataFrame, same: bool = False, extra: Column | None = None) -> DataFrame:
    """Overlapping boxes of two tables of a picture; columns prefixed l_ and r_.

    Pairs meet in the cells both touch and are kept in the first such cell only, so none repeats. Small pictures, if they
    have been counted, meet by picture.
    """
    size = F.lit(CELL_SIZE)
    la, rb = geom.box("l_"), geom.box("r_")
    a, z = _prefixed(left, "l_"), _prefixed(right, "r_")
    cond = geom.overlapping(la, rb)
    if same:
        cond = cond & (F.col("l_idx") < F.col("r_idx"))
    if extra is not None:
        cond = cond & extra
    first = ((F.col("cell_x") == spatial.cell(F.greatest(la[0], rb[0]), size))
             & (F.col("cell_y") == spatial.cell(F.greatest(la[1], rb[1]), size)))

    def by_cell(many, others):
        return spatial.with_cells(many, *la, size).join(spatial.with_cells(others, *rb, size), ["image_id", *spatial.CELL]).where(cond & first).drop(*spatial.CELL)
    if not (spatial.is_settled(left) and spatial.is_settled(right)):
        return by_cell(a, z)
    crowd = spatial.crowded(left, right)
    return spatial.split(a, crowd, lambda few: few.join(z, "image_id").where(cond), lambda many: by_cell(many, z.join(crowd, "image_id", "left_semi")))


def family_of(cls: Column, profile: str) -> Column:
    table = F.create_map(*[F.lit(x) for i, fam in enumerate(dims.FAMILIES[profile]) for c in fam for x in (c, i)])
    return F.try_element_at(table, cls)


def specificity(cls: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in dims.SPECIFICITY.items() for x in kv])
    return F.coalesce(F.try_element_at(table, cls), F.lit(0))


def family_conflicts(comps: DataFrame, profile: str, limit: float = 0.35) -> DataFrame:
    """Ordered same-family overlaps with the box that loses."""
    slim = spatial.settled(comps.select("image_id", "idx", "cls", "x1", "y1", "x2", "y2"), comps)
    same = family_of(F.col("l_cls"), profile) == family_of(F.col("r_cls"), profile)
    pairs = overlap_pairs(slim, slim, same=True, extra=same)
    return pairs.where(geom.iou(geom.box("l_"), geom.box("r_")) > limit).select(
        "image_id", F.col("l_idx").alias("a"), F.col("r_idx").alias("b"),
        F.struct(F.col("l_idx").alias("a"), F.col("r_idx").alias("b")).alias("ord"),
        F.when(specificity(F.col("l_cls")) >= specificity(F.col("r_cls")), F.col("r_idx"))
        .otherwise(F.col("l_idx")).alias("loser"))


def any_conflicts(comps: DataFrame, limit: float = 0.7) -> DataFrame:
    """Ordered overlaps of any classes with the less sure box as loser, the later one on a tie."""
    slim = comps.select("image_id", "idx", "conf", "x1", "y1", "x2", "y2")
    pairs = overlap_pairs(slim, slim, same=True)
    return pairs.where(geom.iou(geom.box("l_"), geom.box("r_")) > limit).select(
        "image_id", F.col("l_idx").alias("a"), F.col("r_idx").alias("b"),
        F.struct(F.col("l_idx").alias("a"), F.col("r_idx").alias("b")).alias("ord"),
        F.when(F.col("l_conf") >= F.col("r_conf"), F.col("r_idx")).otherwise(F.col("l_idx")).alias("loser"))


def suppress(comps: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Components left after the conflicts were walked in order; removed boxes take no further part."""
    acting = graph.resolve_pairs(conflicts, F.array("loser"))
    return comps.join(acting.select("image_id", F.col("loser").alias("idx")).distinct(), ["image_id", "idx"], "left_anti")


def context_flags(comps: DataFrame) -> DataFrame:
    """Per picture: has ground, has a resistive load."""
    return comps.groupBy("image_id").agg(
        F.bool_or(F.col("name") == "GND").alias("has_gnd"),
        F.bool_or(F.col("name").isin(*dims.RESISTIVE_LOADS)).alias("has_load"))


def fix_sources(comps: DataFrame) -> DataFrame:
    """AC sources beside ground and load become DC; unsure DC sources without ground become AC."""
    out = comps.join(context_flags(comps), "image_id")
    to_dc = (F.col("name") == "V-AC") & F.col("has_gnd") & F.col("has_load")
    to_ac = (F.col("name") == "V-DC") & ~F.col("has_gnd") & (F.col("conf") < 0.5)
    return (out.withColumn("_to", F.when(to_dc, "V-DC").when(to_ac, "V-AC"))
            .withColumn("cls", F.when(F.col("_to") == "V-DC", "voltage.dc").when(F.col("_to") == "V-AC", "voltage.ac")
                        .otherwise(F.col("cls")))
            .withColumn("name", F.coalesce("_to", "name")).drop("_to", "has_gnd", "has_load"))


def outside(texts: DataFrame, comps: DataFrame, key: str = "text_ord") -> DataFrame:
    """Texts not covered by more than half by any of the given components."""
    t = spatial.settled(texts.select("image_id", F.col(key).alias("idx"), "x1", "y1", "x2", "y2"), texts)
    c = spatial.settled(comps.select("image_id", "idx", "x1", "y1", "x2", "y2"), comps)
    lb, rb = geom.box("l_"), geom.box("r_")
    covered = overlap_pairs(t, c, extra=geom.overlap_area(lb, rb) > geom.area(lb) * 0.5)
    return texts.join(covered.select("image_id", F.col("l_idx").alias(key)).distinct(), ["image_id", key], "left_anti")


def duplicates(comps: DataFrame, tol: int = 10) -> DataFrame:
    """Pairs of boxes at the same place: all four edges within `tol`. Keyed by small corner cells."""
    size = F.lit(tol)
    slim = comps.select("image_id", "idx", "x1", "y1", "x2", "y2")
    a = spatial.with_cell(_prefixed(slim, "l_"), F.col("l_x1"), F.col("l_y1"), size)
    b = spatial.with_near_cells(_prefixed(slim, "r_"), F.col("r_x1"), F.col("r_y1"), size)
    return a.join(b, ["image_id", *spatial.CELL]).where(
        (F.col("l_idx") < F.col("r_idx")) & geom.same_position(geom.box("l_"), geom.box("r_"), tol)).select(
        "image_id", F.col("l_idx").alias("a"), F.col("r_idx").alias("b"))


def match_boxes(pred: DataFrame, ref: DataFrame) -> DataFrame:
    """One-to-one match: predicted boxes in order each take the free reference box of highest IoU > 0.3."""
    cols = ["image_id", "idx", "x1", "y1", "x2", "y2"]
    value = geom.iou(geom.box("l_"), geom.box("r_"))
    pairs = overlap_pairs(*[spatial.settled(df.select(*cols), df) for df in (pred, ref)]).withColumn("iou", value).where("iou > 0.3").select(
        "image_id", F.col("l_idx").alias("a"), (-F.col("r_idx") - 1).alias("b"),
        F.struct(F.col("l_idx").alias("p"), (-F.col("iou")).alias("s"), F.col("r_idx").alias("d")).alias("ord"))
    return graph.greedy_matching(pairs).select("image_id", F.col("a").alias("pred_idx"), (-F.col("b") - 1).alias("ref_idx"))


