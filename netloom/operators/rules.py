"""Electrical rules and review scores over long tables.

parts(circuit_id, idx, id, type, value, nodes), links(circuit_id, idx, from_node, to_node, via).
Issues carry `times`: how often the same finding holds (several sources on one node give one row).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from netloom.functions import dims

ISSUE = ["circuit_id", "rule", "ord", "type", "severity", "refs", "description", "times"]


def _issue(df: DataFrame, rule: int, kind: str) -> DataFrame:
    return df.select("circuit_id", F.lit(rule).alias("rule"), "ord", F.lit(kind).alias("type"),
                     F.lit("critical").alias("severity"), "refs", "description", "times")


def supply_nodes(parts: DataFrame) -> DataFrame:
    """(circuit_id, node, plus, minus, n_plus, n_minus): roles from sources and ground parts."""
    src, gnd = F.col("type") == "voltage_source", F.col("type") == "ground"
    roles = F.when(src, F.array(F.struct(F.get("nodes", F.lit(0)).alias("node"), F.lit(1).alias("p"), F.lit(0).alias("m"), F.lit(0).alias("g")),
                                F.struct(F.get("nodes", F.lit(1)).alias("node"), F.lit(0).alias("p"), F.lit(1).alias("m"), F.lit(0).alias("g")))
                   ).when(gnd, F.array(F.struct(F.get("nodes", F.lit(0)).alias("node"), F.lit(0).alias("p"), F.lit(0).alias("m"), F.lit(1).alias("g"))))
    return (parts.where(src | gnd).select("circuit_id", F.inline(roles)).groupBy("circuit_id", "node")
            .agg(F.sum("p").alias("n_plus"), F.sum("m").alias("n_minus"), F.sum("g").alias("n_ground"))
            .withColumn("plus", F.col("n_plus") > 0).withColumn("minus", (F.col("n_minus") + F.col("n_ground")) > 0))


# the sentences of the findings below and of the summary are fixed values
def short_circuits(parts: DataFrame, links: DataFrame) -> DataFrame:
    """Links without a part between a supply and a ground node, in either direction."""
    roles = supply_nodes(parts).select("circuit_id", "node", "plus", "minus")
    a = roles.select("circuit_id", F.col("node").alias("from_node"), F.col("plus").alias("fp"), F.col("minus").alias("fm"))
    b = roles.select("circuit_id", F.col("node").alias("to_node"), F.col("plus").alias("tp"), F.col("minus").alias("tm"))
    hit = (links.where("via is null").join(a, ["circuit_id", "from_node"]).join(b, ["circuit_id", "to_node"])
           .where("(fp and tm) or (fm and tp)"))
    return _issue(hit.select(
        "circuit_id", F.col("idx").alias("ord"), F.array("from_node", "to_node").alias("refs"), F.lit(1).cast("bigint").alias("times"),
        F.concat(F.lit("电源到地直接短接："), "from_node", F.lit(" ↔ "), "to_node").alias("description")), 0, "short_circuit")


def reverse_polarity(parts: DataFrame) -> DataFrame:
    """Polarised two-node parts with the cathode on a source's plus or the anode on its minus."""
    roles = supply_nodes(parts)
    p = parts.where(F.col("type").isin(*dims.POLARISED) & (F.size("nodes") == 2)).select(
        "circuit_id", "idx", "id", "type", "nodes")
    ends = F.array(F.struct(F.lit(0).alias("rule"), F.get("nodes", F.lit(1)).alias("node")),
                   F.struct(F.lit(1).alias("rule"), F.get("nodes", F.lit(0)).alias("node")))
    hit = (p.select("*", F.inline(ends).alias("side", "node")).join(roles, ["circuit_id", "node"])
           .withColumn("times", F.when(F.col("side") == 0, F.col("n_plus")).otherwise(F.col("n_minus"))).where("times > 0"))
    why = F.when(F.col("side") == 0, "阴极连接到电源正极").otherwise("阳极连接到地")
    return _issue(hit.select(
        "circuit_id", (F.col("idx") * 2 + F.col("side")).alias("ord"), F.col("nodes").alias("refs"), "times",
        F.concat("id", F.lit("("), "type", F.lit(")极性接反："), why).alias("description")), 1, "reverse_polarity")


def node_degrees(parts: DataFrame, links: DataFrame) -> DataFrame:
    """How often each node is named by parts and link ends."""
    ends = links.select("circuit_id", F.explode(F.array("from_node", "to_node")).alias("node"))
    return (parts.select("circuit_id", F.explode("nodes").alias("node")).unionByName(ends)
            .groupBy("circuit_id", "node").agg(F.count(F.lit(1)).alias("degree")))


def open_circuits(parts: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes named once."""
    hit = node_degrees(parts, links).where("degree = 1")
    return _issue(hit.select(
        "circuit_id", F.lit(0).cast("bigint").alias("ord"), F.array("node").alias("refs"), F.lit(1).cast("bigint").alias("times"),
        F.concat(F.lit("悬空节点 "), "node", F.lit("：只连接到一个元件，可能断路")).alias("description")), 2, "open_circuit")


def safety(parts: DataFrame, links: DataFrame) -> DataFrame:
    """Shorts, reversals and open nodes, in this order by `rule`, then `ord`, then reference."""
    return short_circuits(parts, links).unionByName(reverse_polarity(parts)).unionByName(open_circuits(parts, links))


def tallies(issues: DataFrame) -> DataFrame:
    """Per circuit: critical, major, minor and quality counts of issues(circuit_id, family, severity[, times])."""
    n = F.col("times") if "times" in issues.columns else F.lit(1)

    def total(cond: Column, name: str):
        return F.coalesce(F.sum(F.when(cond, n)), F.lit(0)).cast("bigint").alias(name)
    fam, sev = F.col("family"), F.col("severity")
    return issues.groupBy("circuit_id").agg(
        total((fam == "safety") & (sev == "critical"), "critical"), total((fam == "correctness") & (sev == "major"), "major"),
        total((fam == "correctness") & (sev == "minor"), "minor"), total(fam == "quality", "quality"),
        total(fam == "correctness", "correctness"))


def score() -> Column:
    raw = F.lit(100) - F.col("critical") * 30 - F.col("major") * 15 - F.col("minor") * 5 - F.col("quality") * 3
    return F.greatest(F.lit(0), F.least(F.lit(100), raw)).cast("int")


def summary() -> Column:
    bad = F.concat_ws("；",
                      F.when(F.col("critical") > 0, F.concat(F.lit("发现"), F.col("critical").cast("string"), F.lit("处致命错误"))),
                      F.when(F.col("major") > 0, F.concat(F.lit("发现"), F.col("major").cast("string"), F.lit("处功能问题"))))
    rest = F.col("correctness") + F.col("quality")
    return (F.when(bad != "", bad).when(rest > 0, F.concat(F.lit("电路基本正确，有"), rest.cast("string"), F.lit("处优化建议")))
            .otherwise("电路设计正确，质量良好"))


def reports(circuits: DataFrame, issues: DataFrame) -> DataFrame:
    """Score and summary of every circuit, also of those without issues."""
    out = circuits.select("circuit_id").join(tallies(issues), "circuit_id", "left").na.fill(0)
    return out.withColumn("overall_score", score()).withColumn("summary", summary())


def type_counts(issues: DataFrame) -> DataFrame:
    """Counts per circuit, family and type with subtotals per circuit and family."""
    return issues.rollup("circuit_id", "family", "type").agg(F.count(F.lit(1)).alias("n")).where("circuit_id is not null")


def band(c: Column) -> Column:
    return F.when(c >= 70, "ok").when(c >= 30, "warn").otherwise("fail")


def normal_severity(family: Column, severity: Column) -> Column:
    """Severities outside the family's list become minor."""
    return (F.when((family == "correctness") & ~F.coalesce(severity, F.lit("")).isin("major", "minor"), "minor")
            .when((family == "quality") & ~F.coalesce(severity, F.lit("")).isin("minor", "suggestion"), "minor").otherwise(severity))


def problems(reports_: DataFrame, below: int = 80) -> DataFrame:
    return reports_.where(F.col("overall_score") < below).orderBy("circuit_id")


def part_rejects(parts: DataFrame) -> DataFrame:
    """Adds `reject`: why a part is not valid, NULL when it is."""
    return parts.withColumn("reject", F.when(F.col("id").isNull(), "id").when(
        ~F.coalesce(F.col("type").isin(*dims.PART_TYPES), F.lit(False)), "type").when(F.col("nodes").isNull(), "nodes"))


def link_rejects(links: DataFrame) -> DataFrame:
    """Adds `reject` for links without an end."""
    return links.withColumn("reject", F.when(F.col("from_node").isNull(), "from_node").when(F.col("to_node").isNull(), "to_node"))


def report_rejects(reports_: DataFrame) -> DataFrame:
    """Adds `reject` for reports whose score is missing or outside 0 to 100, or that have no summary."""
    return reports_.withColumn("reject", F.when(~F.coalesce(F.col("overall_score").between(0, 100), F.lit(False)), "overall_score")
                               .when(F.col("summary").isNull(), "summary"))


def field_rejects(issues: DataFrame) -> DataFrame:
    """Adds `reject`: the first required field an issue lacks (safety: nodes, description; others: components, description, suggestion)."""
    safety = F.col("family") == "safety"
    return issues.withColumn("reject", F.when(safety & F.col("nodes").isNull(), "nodes").when(~safety & F.col("components").isNull(), "components")
                             .when(F.col("description").isNull(), "description").when(~safety & F.col("suggestion").isNull(), "suggestion"))


def issue_rejects(issues: DataFrame) -> DataFrame:
    """Adds `reject` for issues outside the enumerations of their family."""
    f, t, s = F.col("family"), F.col("type"), F.col("severity")
    types = (((f == "safety") & t.isin(*dims.SAFETY_TYPES)) | ((f == "correctness") & t.isin(*dims.CORRECTNESS_TYPES))
             | ((f == "quality") & t.isin(*dims.QUALITY_TYPES)))
    sev = (((f == "safety") & (s == "critical")) | ((f == "correctness") & s.isin("major", "minor"))
           | ((f == "quality") & s.isin("minor", "suggestion")))
    return issues.withColumn("reject", F.when(~F.coalesce(types, F.lit(False)), "type").when(~F.coalesce(sev, F.lit(False)), "severity"))
