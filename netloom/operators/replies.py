"""Review replies: text to typed issues, and the prompts that ask for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from netloom.functions import text
from netloom.operators.rules import normal_severity

ISSUE = "array<struct<type:string,severity:string,description:string,suggestion:string,nodes:array<string>,components:array<string>,location:string>>"
REPLY = f"overall_score int, fatal_errors {ISSUE}, correctness_issues {ISSUE}, quality_issues {ISSUE}, summary string"


def with_json(replies: DataFrame) -> DataFrame:
    """Adds `json`: the first JSON value of the response. The body is its own column, worked out once."""
    return replies.withColumn("_body", text.strip_fences(F.col("response"))).withColumn("json", text.first_json(F.col("_body"))).drop("_body")


def parse_replies(replies: DataFrame) -> DataFrame:
    """Adds `json`, `ok` and `reply`; what is not JSON is kept with ok = false instead of asked again."""
    out = with_json(replies)
    out = out.withColumn("ok", F.try_parse_json("json").isNotNull() & F.col("json").rlike(r"^\s*[\[{]"))
    return out.withColumn("reply", F.when(F.col("ok"), F.from_json("json", REPLY)))


def array_issues(replies: DataFrame, family: Column) -> DataFrame:
    """Issues of replies that are JSON arrays, all of one family a reply, with every field; others give no rows."""
    out = with_json(replies.withColumn("family", family)).where(F.col("json").rlike(r"^\s*\[") & F.try_parse_json("json").isNotNull())
    out = out.select("circuit_id", "family", F.posexplode(F.from_json("json", ISSUE)).alias("ord", "i")).select("circuit_id", "family", "ord", "i.*")
    return out.withColumn("severity", normal_severity(F.col("family"), F.col("severity")))


CIRCUIT = ("name string, expected_function string, components array<struct<id:string,type:string,value:string,nodes:array<string>>>, "
           "connections array<struct<from_node:string,to_node:string,via:string>>, notes string")


def circuit_replies(replies: DataFrame) -> DataFrame:
    """Adds `ok` and `circuit` for replies that describe a circuit; `reject` names the first required field that is missing."""
    # rows of a generator are made once; as plain columns both would be worked out again for each field that a filter asks for
    out = with_json(replies).withColumn("json", F.explode(F.array("json")))
    out = out.withColumn("ok", F.try_parse_json("json").isNotNull() & F.col("json").rlike(r"^\s*\{"))
    out = out.withColumn("circuit", F.explode(F.array(F.when(F.col("ok"), F.from_json("json", CIRCUIT)))))
    required = [F.when(F.col(f"circuit.{n}").isNull(), n) for n in ("name", "expected_function", "components", "connections")]
    return out.withColumn("reject", F.when(~F.coalesce("ok", F.lit(False)), "json").otherwise(F.coalesce(*required)))


def circuit_parts(parsed: DataFrame) -> DataFrame:
    """(circuit_id, idx, id, type, value, nodes) of good circuit replies, for `rules.part_rejects` and the rules."""
    return parsed.where("reject is null").select("circuit_id", F.posexplode("circuit.components").alias("idx", "p")).select("circuit_id", "idx", "p.*")


def circuit_links(parsed: DataFrame) -> DataFrame:
    """(circuit_id, idx, from_node, to_node, via) of good circuit replies."""
    return parsed.where("reject is null").select("circuit_id", F.posexplode("circuit.connections").alias("idx", "l")).select("circuit_id", "idx", "l.*")


def reply_issues(parsed: DataFrame) -> DataFrame:
    """Issues of good replies in long form with normalised severities."""
    lists = F.array(*[F.struct(F.lit(family).alias("family"), F.col("reply")[col].alias("items")) for family, col in (
        ("safety", "fatal_errors"), ("correctness", "correctness_issues"), ("quality", "quality_issues"))])
    out = (parsed.where("ok").select("circuit_id", F.inline(lists)).select("circuit_id", "family", F.posexplode("items").alias("ord", "i"))
           .select("circuit_id", "family", "ord", "i.type", "i.severity", "i.description", "i.suggestion"))
    return out.withColumn("severity", normal_severity(F.col("family"), F.col("severity")))


def fill(template: str, **columns: Column) -> Column:
    """Template with {name} places filled from columns."""
    out, rest = [], template
    while rest:
        at = min((rest.find("{%s}" % n), n) for n in columns if "{%s}" % n in rest) if any("{%s}" % n in rest for n in columns) else None
        if at is None:
            out.append(F.lit(rest))
            break
        out += [F.lit(rest[:at[0]]), F.coalesce(columns[at[1]].cast("string"), F.lit("None"))]
        rest = rest[at[0] + len(at[1]) + 2:]
    return F.concat(*out)


def part_bullets(parts: DataFrame) -> DataFrame:
    """(circuit_id, ord, line) for the part list of a prompt."""
    nodes = F.concat(F.lit("['"), F.array_join("nodes", "', '"), F.lit("']"))
    return parts.select("circuit_id", F.col("idx").alias("ord"), fill(
        "- {id}: {type}, value={value}, nodes={nodes}", id=F.col("id"), type=F.col("type"), value=F.col("value"), nodes=nodes).alias("line"))


def link_bullets(links: DataFrame) -> DataFrame:
    """(circuit_id, ord, line) for the link list of a prompt."""
    via = F.when(F.coalesce(F.col("via"), F.lit("")) != "", F.concat(F.lit(" via "), "via")).otherwise("")
    return links.select("circuit_id", F.col("idx").alias("ord"), F.concat(
        F.lit("- "), "from_node", F.lit(" → "), "to_node", via).alias("line"))


def prompt_lines(circuits: DataFrame, parts: DataFrame, links: DataFrame, head: list[str], middle: list[str],
                 tail: list[str]) -> DataFrame:
    """Prompts as (circuit_id, section, ord, line): head lines (with {name}, {expected_function}), part
    bullets, middle lines, link bullets, tail lines. The wording belongs to the caller."""
    places = {"name": F.col("name"), "expected_function": F.col("expected_function")}

    def fixed(lines, section):
        return circuits.select("circuit_id", F.lit(section).alias("section"), F.posexplode(
            F.array(*[fill(x, **places) for x in lines])).alias("ord", "line"))
    blocks = [fixed(head, 0), part_bullets(parts).select("circuit_id", F.lit(1).alias("section"), "ord", "line"),
              fixed(middle, 2), link_bullets(links).select("circuit_id", F.lit(3).alias("section"), "ord", "line"), fixed(tail, 4)]
    out = None
    for b in blocks:
        b = b.withColumn("ord", F.col("ord").cast("bigint"))
        out = b if out is None else out.unionByName(b)
    return out


# slots of each prompt shape, and how many characters of a slot it takes
PROMPT_SHAPES = {
    "description": {"description": None}, "netlist_request": {"description": None}, "netlist_review": {"name": None, "netlist": 2000},
    "simulation": {"name": None, "result": None}, "wired_review": {"name": None, "components": None, "groups": None},
}


def prompts(table: DataFrame, shape: str, wording: str) -> DataFrame:
    """(circuit_id, prompt): the caller's wording with the slots of a shape filled from columns of `table`."""
    slots = PROMPT_SHAPES[shape]
    absent = [s for s in slots if "{%s}" % s not in wording]
    if absent:
        raise ValueError(f"the wording for {shape} has no place for {', '.join(absent)}")
    filled = {s: F.col(s) if n is None else shortened(F.col(s), n) for s, n in slots.items()}
    return table.select("circuit_id", fill(wording, **filled).alias("prompt"))


def shortened(c: Column, n: int) -> Column:
    """First n characters, for listings."""
    return F.substring(c, 1, n)
