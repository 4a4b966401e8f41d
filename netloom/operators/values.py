"""Attaching read values to components, and the texts rendered from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from netloom.functions import dims, geom, text
from netloom.lineage import count_all, cut
from netloom.operators import graph, ranks, spatial
from netloom.operators.nearest import nearest

REACH = 250


def _in_reach(comps: DataFrame, texts: DataFrame) -> DataFrame:
    """Components (idx, name, conf) with the texts at most REACH away by Manhattan distance. Small pictures, if both tables
    have been counted, meet by picture."""
    size = F.lit(256)
    a = comps.select("image_id", "idx", "name", "cx", "cy")
    b = texts.select("image_id", "text_ord", "text", F.col("cx").alias("tx"), F.col("cy").alias("ty"))
    near = lambda a: spatial.with_near_cells(a, F.col("cx"), F.col("cy"), size, F.lit(REACH))
    here = lambda b: spatial.with_cell(b, F.col("tx"), F.col("ty"), size)
    if spatial.is_settled(comps) and spatial.is_settled(texts):
        pairs = spatial.met(a, b, spatial.crowded(comps, texts), near, here)
    else:
        pairs = near(a).join(here(b), ["image_id", *spatial.CELL])
    d = geom.manhattan(F.col("cx"), F.col("cy"), F.col("tx"), F.col("ty"))
    return pairs.withColumn("d", d).where(F.col("d") <= REACH).select("image_id", "idx", "name", "text_ord", "text", "d")


def match_nearest(comps: DataFrame, texts: DataFrame) -> DataFrame:
    """(image_id, idx, value): nearest text that suits the component; one text may serve many."""
    good = _in_reach(comps, texts).withColumn("v", text.fits_reading(F.col("text"), F.col("name"))).where("v is not null")
    best = good.groupBy("image_id", "idx").agg(F.min_by("v", F.struct("d", "text_ord")).alias("value"))
    return comps.select("image_id", "idx").join(best, ["image_id", "idx"], "left").withColumn("value", F.coalesce("value", F.lit("")))


def text_choices(comps: DataFrame, texts: DataFrame) -> DataFrame:
    """(image_id, text_ord, idx, value, score): the component each text settles on.

    Per text the candidates are walked by component and variant; one replaces the best only if its
    score is lower, by over 20 if the best was exact. So only a score below all before it can replace the
    best, which is the first of its score: one candidate for each whole score is kept, at most REACH + 41
    a text however many components are about.
    """
    cand = _in_reach(comps, texts).select("image_id", "text_ord", "idx", "name", "text", "d", F.posexplode(text.variants(F.col("text"))).alias("k", "v"))
    cand = cand.withColumn("value", text.fits(F.col("v.value"), F.col("name"))).where("value is not null")
    exact = F.col("v.value") == F.col("text")
    first = cand.select("image_id", "text_ord", (F.col("d") - F.when(exact, 40).otherwise(0)).cast("bigint").alias("score"),
                        F.struct("idx", "k", F.when(F.col("value") == "", F.col("v.value")).otherwise(F.col("value")).alias("value"), exact.alias("exact")).alias("f"))
    first = first.groupBy("image_id", "text_ord", "score").agg(F.min("f").alias("f"))
    lists = first.groupBy("image_id", "text_ord").agg(F.sort_array(F.collect_list(F.struct("f.idx", "f.k", "f.value", "score", "f.exact"))).alias("cs"))

    def step(best, c):
        better = c["score"] < best["score"] - F.when(best["exact"], 20).otherwise(0)
        return F.when(better, c).otherwise(best)
    won = F.aggregate(F.slice("cs", F.lit(2), F.size("cs")), F.get("cs", F.lit(0)), step)
    return lists.select("image_id", "text_ord", won.alias("w")).select("image_id", "text_ord", "w.idx", "w.value", "w.score")


def match_by_proximity(comps: DataFrame, texts: DataFrame) -> DataFrame:
    """(image_id, idx, value): each text to one component, each component its best text, then the
    components left over to the nearest unused text that suits, in index order."""
    chosen = cut(text_choices(comps, texts), "chosen")
    first = cut(chosen.groupBy("image_id", "idx").agg(F.min(F.struct("score", "text_ord", "value")).alias("w")).select(
        "image_id", "idx", F.col("w.text_ord").alias("text_ord"), F.col("w.value").alias("value")), "first")
    rest = _in_reach(spatial.settled(comps.where("name <> 'GND'").join(first.select("image_id", "idx"), ["image_id", "idx"], "left_anti"), comps),
                     spatial.settled(texts.join(first.select("image_id", "text_ord"), ["image_id", "text_ord"], "left_anti"), texts))
    fit = F.filter(F.transform(text.variants(F.col("text")), lambda v: text.fits(v["value"], F.col("name"))), lambda v: v.isNotNull())
    rest = rest.withColumn("value", F.get(fit, F.lit(0))).where("value is not null and value <> ''")
    pairs = rest.select("image_id", F.col("idx").alias("a"), (-F.col("text_ord") - 1).alias("b"),
                        F.struct("idx", "d", "text_ord").alias("ord"), "idx", "value")
    second = graph.greedy_matching(pairs).select("image_id", "idx", "value")
    got = first.select("image_id", "idx", "value").unionByName(second)
    return comps.select("image_id", "idx").join(got, ["image_id", "idx"], "left").withColumn("value", F.coalesce("value", F.lit("")))


def nearest_texts(comps: DataFrame, texts: DataFrame) -> DataFrame:
    """(image_id, idx, text_ord, text, d): the nearest text of each component at any distance. Small pictures, if both tables
    have been counted, meet by picture."""
    left = comps.select("image_id", "idx", F.col("cx").alias("lx"), F.col("cy").alias("ly"))
    right = texts.select("image_id", "text_ord", "text", F.col("cx").alias("rx"), F.col("cy").alias("ry"))
    at_any = lambda left, right: nearest(left, right, ["image_id"], ["idx"], ["text_ord", "text"], geom.manhattan)
    if spatial.is_settled(comps) and spatial.is_settled(texts):
        crowd, d = spatial.crowded(comps, texts), geom.manhattan(*[F.col(c).cast("bigint") for c in ("lx", "ly", "rx", "ry")])
        found = spatial.split(left, crowd, lambda few: few.join(right, "image_id").groupBy("image_id", "idx").agg(
            F.min(F.struct(d.alias("d"), "text_ord", "text")).alias("best")), lambda many: at_any(many, right.join(crowd, "image_id", "left_semi")))
    else:
        found = at_any(left, right)
    return found.select("image_id", "idx", "best.text_ord", "best.text", "best.d")


def repair_units(comps: DataFrame, texts: DataFrame) -> DataFrame:
    """comps(image_id, idx, name, conf, value, cx, cy) with values of sure components given a valid unit."""
    near = nearest_texts(comps, texts).select("image_id", "idx", F.col("text").alias("_near"))
    return comps.join(near, ["image_id", "idx"], "left").withColumn(
        "value", F.coalesce(text.unit_repair(F.col("name"), F.col("conf"), F.col("value"), F.col("_near")), "value")).drop("_near")


def texts_about(comps: DataFrame, texts: DataFrame, margin: int = 20) -> DataFrame:
    """(image_id, idx, text_ord): texts centred in the box plus margin, else the nearest one."""
    size = F.lit(128)
    box = geom.grow(geom.box(""), margin)
    w = comps.select("image_id", "idx", *[c.alias(n) for c, n in zip(box, ("wx1", "wy1", "wx2", "wy2"))])
    a = spatial.with_cells(w, *[F.col(n) for n in ("wx1", "wy1", "wx2", "wy2")], size)
    b = spatial.with_cell(texts.select("image_id", "text_ord", "cx", "cy"), F.col("cx"), F.col("cy"), size)
    inside = cut(a.join(b, ["image_id", *spatial.CELL]).where(
        F.col("cx").between(F.col("wx1"), F.col("wx2")) & F.col("cy").between(F.col("wy1"), F.col("wy2"))).select("image_id", "idx", "text_ord"), "about")
    rest = comps.join(inside.select("image_id", "idx").distinct(), ["image_id", "idx"], "left_anti")
    return inside.unionByName(nearest_texts(rest, texts).select("image_id", "idx", "text_ord"))


def inferred_sources(comps: DataFrame, texts: DataFrame) -> DataFrame:
    """(image_id, kind, text_ord, text): first text in volts (amperes) of pictures without such a source."""
    has = comps.groupBy("image_id").agg(F.bool_or(F.col("name").startswith("V-")).alias("v"), F.bool_or(F.col("name").startswith("I-")).alias("i"))
    t = texts.join(has, "image_id", "left")
    kind = F.when(F.col("text").rlike(r"[0-9.][Vv]$") & ~F.coalesce("v", F.lit(False)), "V").when(
        F.col("text").rlike(r"[0-9.][Aa]$") & ~F.coalesce("i", F.lit(False)), "I")
    return t.withColumn("kind", kind).where("kind is not null").groupBy("image_id", "kind").agg(
        F.min(F.struct("text_ord", "text")).alias("w")).select("image_id", "kind", "w.text_ord", "w.text")


# fixed values: wording of descriptions
OPENING = "以下是YOLO目标检测从电路图中自动识别的元器件："
QUESTIONS = ("", "请作为电路评审专家，评价以上元器件组成的电路图：", "1. 是否存在元器件数值标注错误（如电容标了电流单位）？",
             "2. 根据元器件组合，推测这可能是什么类型的电路？", "3. 整体质量如何？有无明显设计缺陷？")
LED_HINT = "4. （注意：如果二极管实际是LED，请分析限流电阻阻值是否合理、是否需要调整）"


def description_lines(comps: DataFrame, texts: DataFrame, guard: ranks.SkewGuard | None = None) -> DataFrame:
    """Descriptions as (image_id, section, ord, line) from comps(image_id, idx, name, display, value)."""
    real = comps.where("name <> 'Wire Crossover'")
    per = comps.groupBy("image_id").agg(F.count_if(F.col("name") != "Wire Crossover").alias("n"),
                                        (F.bool_or(F.col("name") == "Diode") & F.bool_or(F.col("name") == "Resistor")).alias("led"))
    head = per.select("image_id", F.lit(0).alias("section"), F.posexplode(F.array(
        F.lit(OPENING), F.concat(F.lit("（共检测到"), F.col("n").cast("string"), F.lit("个元器件）")))).alias("ord", "line"))
    what = F.when(F.col("kind") == "V", F.struct(F.lit("电压").alias("a"))).otherwise(F.struct(F.lit("电流").alias("a")))["a"]
    src = inferred_sources(comps, texts).select("image_id", F.lit(1).alias("section"), (-F.col("text_ord")).alias("ord"), F.concat(
        F.lit("- 推测"), what, F.lit("源：数值="), "text", F.lit("（检测到"), what, F.lit("标注但元件漏检）")).alias("line"))
    gap = per.select("image_id", F.lit(2).alias("section"), F.lit(0).alias("ord"), F.lit("").alias("line"))
    numbered = ranks.row_number(real, ["image_id", "name"], ["idx"], "no", guard=guard)
    placed = ranks.row_number(numbered, ["image_id"], ["name", "idx"], "ord", guard=guard)
    items = placed.select("image_id", F.lit(3).alias("section"), "ord", F.concat(
        F.lit("- "), "display", F.col("no").cast("string"), F.when(F.col("value") != "", F.concat(F.lit("：数值="), "value")).otherwise("：数值未识别")).alias("line"))
    tail = per.select("image_id", F.lit(4).alias("section"), F.posexplode(F.array(
        *[F.lit(q) for q in QUESTIONS], F.when(F.col("led"), LED_HINT))).alias("ord", "line")).where("line is not null")
    out = None
    for d in (head, src, gap, items, tail):
        d = d.withColumn("ord", F.col("ord").cast("bigint"))
        out = d if out is None else out.unionByName(d)
    return out


def report_lines(comps: DataFrame, texts: DataFrame, junctions: DataFrame, listings: DataFrame,
                 guard: ranks.SkewGuard | None = None) -> DataFrame:
    """Picture reports as (image_id, section, ord, line): parts, texts, nodes, groups, each under its title.

    comps(.., name, designator, value), texts(.., text), junctions(image_id, jx, jy), listings(image_id, g, listing).
    """
    images = comps.select("image_id").distinct()

    def title(df, section, before, after):
        n = df.groupBy("image_id").agg(count_all().alias("n"))
        line = F.concat(F.lit(before), F.coalesce("n", F.lit(0)).cast("string"), F.lit(after))
        return images.join(n, "image_id", "left").select("image_id", F.lit(section).alias("section"), F.lit(0).alias("ord"), line.alias("line"))
    zh = F.create_map(*[F.lit(x) for kv in dims.CHINESE.items() for x in kv])
    value = F.when(F.col("value") != "", F.concat(F.lit("值="), "value")).otherwise("值未识别")
    ports = F.create_map(*[F.lit(x) for n, labs in dims.LABELS["wiring"].items() if labs for x in (n, ",".join(labs))])
    pinfo = F.try_element_at(ports, F.col("name"))
    parts = comps.select("image_id", F.lit(0).alias("section"), (F.col("idx") + 1).alias("ord"), F.concat(
        F.format_string("  %-6s %-10s ", "designator", F.coalesce(F.try_element_at(zh, F.col("name")), "name")), value,
        F.when(pinfo.isNotNull() & (F.col("n_ports") == F.size(F.split(pinfo, ","))), F.concat(F.lit(" 端口:"), pinfo)).otherwise("")).alias("line"))
    words = texts.select("image_id", F.lit(1).alias("section"), (F.col("text_ord") + 1).alias("ord"), F.concat(F.lit('  "'), "text", F.lit('"')).alias("line"))
    nodes = ranks.row_number(junctions, ["image_id"], ["jy", "jx"], "n", guard=guard).select(
        "image_id", F.lit(2).alias("section"), F.col("n").alias("ord"), F.format_string("  J%d: (%d,%d)", "n", "jx", "jy").alias("line"))
    nets = ranks.row_number(listings, ["image_id"], ["g"], "n", guard=guard).select(
        "image_id", F.lit(3).alias("section"), F.col("n").alias("ord"), F.concat(F.lit("  连通组"), F.col("n").cast("string"), F.lit(": "), "listing").alias("line"))
    none = images.join(listings.select("image_id").distinct(), "image_id", "left_anti").select(
        "image_id", F.lit(3).alias("section"), F.lit(1).alias("ord"), F.lit("  (未检测到连接)").alias("line"))
    heads = images.select("image_id", F.lit(3).alias("section"), F.lit(0).alias("ord"), F.lit("[连接关系]").alias("line"))
    out = None
    for d in (title(comps, 0, "[检测元件] ", "个"), parts, title(texts, 1, "[OCR文字] ", "个"), words,
              title(junctions, 2, "[节点] ", "个"), nodes, heads, nets, none):
        d = d.withColumn("ord", F.col("ord").cast("bigint"))
        out = d if out is None else out.unionByName(d)
    return out


def confidence_lines(comps: DataFrame, texts: DataFrame) -> DataFrame:
    """The other report form, (image_id, section, ord, line), from comps(.., idx, name, value, conf) and
    texts(.., text_ord, text, conf): parts, then texts, each with its confidence in whole per cent."""
    def percent(c):
        return F.format_string("  [%d%%] ", F.bround(F.col(c) * 100).cast("bigint"))

    def part(df, section, title, at, body, images):
        n = images.join(df.groupBy("image_id").agg(count_all().alias("n")), "image_id", "left")
        head = n.select("image_id", F.lit(section).alias("section"), F.lit(0).cast("bigint").alias("ord"), F.concat(F.lit(title), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" 个")).alias("line"))
        return head.unionByName(df.select("image_id", F.lit(section).alias("section"), (F.col(at) + 1).cast("bigint").alias("ord"), F.concat(percent("conf"), body).alias("line")))
    images = comps.select("image_id").distinct()
    value = F.when(F.col("value") != "", F.concat(F.lit("= "), "value")).otherwise("(未识别)")
    parts = part(comps, 0, "[元件检测] 共 ", "idx", F.format_string("%-15s %s", "name", value), images)
    return parts.unionByName(part(texts.join(images, "image_id", "left_semi"), 1, "[OCR文字] 共 ", "text_ord", F.concat(F.lit('"'), "text", F.lit('"')), images))
