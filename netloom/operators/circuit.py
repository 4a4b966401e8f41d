"""The whole run over pictures: read texts to values, components to designators, wiring to groups, routes and a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from netloom.lineage import cut
from netloom.operators import dataset, detect, lines, ranks, spatial, values, wiring


def usable_texts(texts: DataFrame, comps: DataFrame, memory: DataFrame | None = None) -> DataFrame:
    """Texts that no ground covers, with the corrections of `memory`; empty ones go."""
    kept = detect.outside(texts, comps.where("name = 'GND'"))
    return (kept if memory is None else dataset.apply_corrections(kept, memory)).where("text <> ''")


def valued(comps: DataFrame, texts: DataFrame, guard: ranks.SkewGuard | None = None) -> DataFrame:
    """comps(.., cx, cy) with value and designator: each text to one component, leftovers to what is near, then units of
    sure components repaired."""
    found = cut(values.match_by_proximity(comps, texts), "values")
    repaired = values.repair_units(spatial.settled(comps.join(found, ["image_id", "idx"]), comps), texts)
    return detect.designators(repaired, "wiring", guard)


def listings(groups: DataFrame, comps: DataFrame, ports: DataFrame) -> DataFrame:
    """(image_id, g, listing): the ports of each group as `designator.label`, grounds as GND, in order of text."""
    named = detect.with_labels(ports.select("image_id", "ci", "pi", "name"), "wiring", by_index=True)
    at = (groups.join(named, ["image_id", "ci", "pi"]).join(comps.select("image_id", F.col("idx").alias("ci"), "designator"), ["image_id", "ci"])
          .select("image_id", "g", F.when(F.col("designator") == "GND", "GND").otherwise(F.concat("designator", F.lit("."), "label")).alias("e"), "ci", "pi"))
    return lines.joined(at, ["image_id", "g"], ["e", "ci", "pi"], "e", ", ", "listing")


def run(prepared: dict[str, DataFrame], comps: DataFrame, texts: DataFrame, switches: dict | None = None, memory: DataFrame | None = None,
        guard: ranks.SkewGuard | None = None) -> dict[str, DataFrame]:
    """Everything the run tells of a picture: comps (with value and designator), texts, groups, junctions, routes, report.

    `prepared` comes from `wiring.prepare` over the same comps(image_id, idx, name, conf, x1..y2).
    """
    centred = cut(detect.with_centre(comps), "comps")
    words = cut(usable_texts(texts, centred, memory), "words")
    spatial.crowded(centred, words)  # counted once for all that meets by picture
    parts = cut(valued(centred, words, guard), "parts")
    wired = wiring.wire(prepared, switches)
    groups, ports, junctions = cut(wired["groups"], "groups"), wired["ports"], cut(wired["junctions"], "junctions")
    # a route belongs to every link, also to those that a short later takes away
    routes = wiring.routes(wiring.lines_of(wired["all_links"], wired["jj"], ports), centred, ports)
    n = ports.select("image_id", F.col("ci").alias("idx"), "n_ports").distinct()
    counted = parts.join(n, ["image_id", "idx"], "left").withColumn("n_ports", F.coalesce("n_ports", F.lit(0)))
    seen = parts.select("image_id").distinct()
    # the report reads each of its tables for titles and for lines
    spots = cut(junctions.select("image_id", "jx", "jy").distinct().join(seen, "image_id", "left_semi"), "spots")
    counted, told = cut(counted, "counted"), cut(words.join(seen, "image_id", "left_semi"), "told")
    report = values.report_lines(counted, told, spots, cut(listings(groups, parts, ports), "listings"), guard)
    return {"comps": parts, "texts": words, "groups": groups, "junctions": spots, "routes": routes, "report": report}
