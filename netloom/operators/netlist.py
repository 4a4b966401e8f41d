"""Netlists both ways. Texts are tables of lines, so a long netlist is never one value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from netloom.functions import dims, text
from netloom.operators import ranks

GROUND = ("GND", "GROUND", "0")


def node_numbers(parts: DataFrame, guard: ranks.SkewGuard | None = None) -> DataFrame:
    """(circuit_id, node, num, first): ground spellings 0, others numbered by first appearance."""
    seen = (parts.select("circuit_id", "idx", F.posexplode("nodes").alias("pos", "node"))
            .groupBy("circuit_id", "node").agg(F.min(F.struct("idx", "pos")).alias("first")))
    ground = F.upper("node").isin(*GROUND)
    numbered = ranks.row_number(seen.where(~ground), ["circuit_id"], ["first"], "num", guard=guard)
    return numbered.unionByName(seen.where(ground).withColumn("num", F.lit(0).cast("bigint")))


def part_lines(parts: DataFrame, numbers: DataFrame) -> DataFrame:
    """(circuit_id, idx, line): one netlist entry per part; grounds and wires have none."""
    at = parts.select("circuit_id", "idx", F.posexplode("nodes").alias("pos", "node")).join(
        numbers.select("circuit_id", "node", "num"), ["circuit_id", "node"])
    wide = at.groupBy("circuit_id", "idx").agg(
        *[F.max(F.when(F.col("pos") == i, F.col("num"))).alias(f"n{i}") for i in range(5)])
    t, i = F.col("type"), F.col("id")
    n = [F.col(f"n{k}").cast("string") for k in range(5)]
    value = text.netlist_value(F.col("value"))

    def line(*xs):
        return F.concat_ws(" ", *[F.lit(x) if isinstance(x, str) else x for x in xs])

    def model(name: Column, nodes: list, rest: Column) -> Column:
        return F.concat(line(i, *nodes, name), F.lit("\n.MODEL "), name, rest)
    dname, lname = F.concat(F.lit("D_"), i), F.concat(F.lit("LED_"), i)
    out = F.when(F.size("nodes") > 3, n[4]).otherwise(n[2])
    entry = (F.when(t.isin("resistor", "capacitor", "inductor"), line(i, n[0], n[1], value))
             .when(t.isin("voltage_source", "current_source"), line(i, n[0], n[1], "DC", value))
             .when(t == "diode", model(dname, n[:2], F.lit(" D (IS=1e-14 N=1.0)")))
             .when(t == "led", model(lname, n[:2], F.concat(F.lit(" D (IS="), text.led_saturation(F.col("value")), F.lit(" N=2.0 RS=5)"))))
             .when(t == "transistor_npn", model(F.lit("QNPN"), n[:3], F.lit(" NPN (BF=200 IS=1e-14 VAF=100)")))
             .when(t == "transistor_pnp", model(F.lit("QPNP"), n[:3], F.lit(" PNP (BF=100 IS=1e-14 VAF=80)")))
             .when(t == "opamp", F.concat(
                 F.lit("* "), i, F.lit(": Simplified opamp model (VCVS, gain=1e5)\nE_"), line(i, out, "0", n[0], n[1], "1e5"),
                 F.lit("\nRin_"), line(i, n[0], n[1], "1e6")))
             .when(t == "switch", F.concat(F.lit("S_"), line(i, n[0], n[1], "99 0 SMOD"), F.lit("\n.MODEL SMOD SW (RON=0.01 ROFF=1e6 VTH=0.5)")))
             .when(~t.isin("ground", "wire"), F.concat(F.lit("* "), i, F.lit(": "), t, F.lit(" not implemented in SPICE converter"))))
    return parts.join(wide, ["circuit_id", "idx"]).select("circuit_id", "idx", entry.alias("line")).where("line is not null")


def netlist_lines(circuits: DataFrame, parts: DataFrame, analysis: str = "op",
                  guard: ranks.SkewGuard | None = None) -> DataFrame:
    """Whole netlists as (circuit_id, section, ord, line), to be read in that order."""
    nums = node_numbers(parts, guard)
    head = circuits.select("circuit_id", F.lit(0).alias("section"), F.posexplode(F.array(
        F.concat(F.lit("* "), "name"), F.lit("* Generated netlist for SPICE simulation"), F.lit(""), F.lit("* Node mapping:"))).alias("ord", "line"))
    listed = ranks.row_number(nums.where("node <> '0'"), ["circuit_id"], ["num", "first"], "ord", guard=guard).select(
        "circuit_id", F.lit(1).alias("section"), "ord",
        F.format_string("*   %s -> N%03d", "node", "num").alias("line"))
    body = part_lines(parts, nums).select("circuit_id", F.lit(3).alias("section"), F.col("idx").alias("ord"), "line")
    gap = circuits.select("circuit_id", F.lit(2).alias("section"), F.lit(0).alias("ord"), F.lit("").alias("line"))
    tail = F.array(F.lit(""), F.lit({"op": ".OP", "tran": ".TRAN 1u 10m"}.get(analysis)).cast("string"), F.lit(".END"))
    ends = circuits
    if analysis == "dc":
        first = parts.where("type = 'voltage_source'").groupBy("circuit_id").agg(F.min_by("id", "idx").alias("src"))
        ends = circuits.join(first, "circuit_id", "left")
        tail = F.array(F.lit(""), F.when(F.col("src").isNotNull(), F.concat(F.lit(".DC "), "src", F.lit(" 0 5 0.1"))), F.lit(".END"))
    foot = ends.select("circuit_id", F.lit(4).alias("section"), F.posexplode(tail).alias("ord", "line")).where("line is not null")
    out = None
    for d in (head, listed, gap, body, foot):
        d = d.select("circuit_id", "section", F.col("ord").cast("bigint").alias("ord"), "line")
        out = d if out is None else out.unionByName(d)
    return out


# ---- reading netlists: everything happens inside the row of a text -------------------------------
def _live_lines(texts: DataFrame) -> DataFrame:
    """(circuit_id, lines): trimmed lines before the first one starting with .END (any case, also .ENDS).

    The trimmed lines and the end are columns of their own, so each is worked out once.
    """
    lines = F.transform(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(" \t\r\x0b\x0c")))
    end = F.array_position(F.transform("all", lambda x: F.upper(F.substring(x, 1, 4)) == ".END"), True)
    return (texts.select("circuit_id", lines.alias("all")).withColumn("end", end.cast("int")).select(
        "circuit_id", F.when(F.col("end") > 0, F.slice("all", F.lit(1), F.col("end") - 1)).otherwise(F.col("all")).alias("lines")))


def netlist_headers(texts: DataFrame) -> DataFrame:
    """(circuit_id, title, analysis): first comment and last of the .OP/.DC/.TRAN directives."""
    live = _live_lines(texts)
    title = F.get(F.filter("lines", lambda x: x.startswith("* ")), F.lit(0))
    kinds = F.filter(F.transform("lines", lambda x: F.when(F.upper(x).startswith(".OP"), "op").when(
        F.upper(x).startswith(".DC"), "dc").when(F.upper(x).startswith(".TRAN"), "tran")), lambda k: k.isNotNull())
    return live.select("circuit_id", F.coalesce(F.trim(F.substr(title, F.lit(3))), F.lit("")).alias("title"),
                       F.coalesce(F.try_element_at(kinds, F.lit(-1)), F.lit("op")).alias("analysis"))


def netlist_parts(texts: DataFrame) -> DataFrame:
    """(circuit_id, line_no, id, type, nodes, value, model) of every usable part line."""
    rows = _live_lines(texts).select("circuit_id", F.posexplode("lines").alias("line_no", "line"))
    w = rows.where((F.col("line") != "") & ~F.col("line").startswith("*") & ~F.col("line").startswith(".")).withColumn(
        "w", F.split("line", r"\s+"))
    letters = F.create_map(*[F.lit(x) for kv in dims.LETTER_TYPES.items() for x in kv])
    t = F.coalesce(F.try_element_at(letters, F.upper(F.substring(F.get("w", F.lit(0)), 1, 1))), F.lit("unknown"))
    w = w.withColumn("type", t).withColumn("n", F.size("w"))
    t, n = F.col("type"), F.col("n")
    three, source = t.isin("transistor", "mosfet"), t.isin("voltage_source", "current_source")

    def word(k):
        return F.get("w", F.lit(k))
    kind = F.upper(word(3))
    src_value = (F.when((kind == "DC") & (n > 4), word(4)).when(kind == "AC", F.when(n > 4, word(4)).otherwise("AC")).otherwise(word(3)))
    usable = F.when(three | source, n >= 4).otherwise(n >= 3)
    return w.where(usable).select(
        "circuit_id", "line_no", word(0).alias("id"), "type",
        F.slice("w", F.lit(2), F.when(three, 3).otherwise(2)).alias("nodes"),
        F.when(source, src_value).when(~three & (t != "diode"), word(3)).alias("value"),
        F.when(three, word(4)).when(t == "diode", word(3)).alias("model"))


def listing(parts: DataFrame) -> DataFrame:
    """Printable line of every parsed part: (circuit_id, line_no, line)."""
    def opt(name):
        return F.when(F.coalesce(F.col(name), F.lit("")) != "", F.concat(F.lit(f", {name}="), name)).otherwise("")
    nodes = F.concat(F.lit("['"), F.array_join("nodes", "', '"), F.lit("']"))
    return parts.select("circuit_id", "line_no", F.concat(
        F.lit("  "), "id", F.lit(": "), "type", F.lit(", nodes="), nodes, opt("value"), opt("model")).alias("line"))
