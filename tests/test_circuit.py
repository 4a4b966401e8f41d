from collections import Counter, defaultdict

from pyspark.sql import functions as F

from netloom.functions import dims
from netloom.operators import circuit
from netloom.plans import q_wiring
from netloom.plans.fixtures import Tables

BOX = "image_id bigint, idx bigint, name string, conf double, x1 bigint, y1 bigint, x2 bigint, y2 bigint, cx bigint, cy bigint"
TEXT = "image_id bigint, text_ord bigint, text string, x1 bigint, y1 bigint, x2 bigint, y2 bigint, cx bigint, cy bigint"


def test_texts_values_and_designators(spark):
    comps = spark.createDataFrame([(1, 0, "Resistor", 0.9, 0, 0, 40, 20, 20, 10), (1, 1, "GND", 0.9, 200, 200, 240, 240, 220, 220), (1, 2, "Resistor", 0.9, 300, 0, 340, 20, 320, 10),
                                   (1, 3, "Capacitor", 0.9, 0, 300, 20, 340, 10, 320)], BOX)
    texts = spark.createDataFrame([(1, 0, "1Ok", 10, 30, 40, 40, 25, 35), (1, 1, "5V", 205, 205, 235, 235, 220, 220), (1, 2, "22k", 300, 30, 330, 40, 315, 35), (1, 3, "?", 0, 0, 9, 9, 4, 4)], TEXT)
    memory = spark.createDataFrame([("O", "0", 1), ("?", "", 2)], "pattern string, replacement string, first bigint")
    words = circuit.usable_texts(texts, comps, memory)
    assert {r.text_ord: r.text for r in words.collect()} == {0: "10k", 2: "22k"}  # one lies on the ground, one is corrected away
    got = {r.idx: (r.designator, r.value) for r in circuit.valued(comps, words).collect()}
    assert got == {0: ("R1", "10kΩ"), 1: ("GND", ""), 2: ("R2", "22kΩ"), 3: ("C1", "")}


def test_the_whole_run_tells_one_story(spark):
    """Report, groups, routes and components of all pictures of a folder agree with each other."""
    t = Tables(spark, "/root/testdata/sf0.001")
    out = q_wiring.whole_run(t)
    comps = {(r.image_id, r.idx): r for r in out["comps"].collect()}
    groups, labels = defaultdict(list), dims.LABELS["wiring"]
    for r in out["groups"].collect():
        c = comps[r.image_id, r.ci]
        own = labels.get(c.name) or ()
        groups[r.image_id, r.g].append("GND" if c.designator == "GND" else f"{c.designator}.{own[r.pi] if r.pi < len(own) else r.pi}")
    report = out["report"].collect()
    listed = Counter((r.image_id, r.line.split(": ", 1)[1]) for r in report if r.section == 3 and r.line.startswith("  连通组"))
    assert listed == Counter((i, ", ".join(sorted(ports))) for (i, _), ports in groups.items()) and listed
    texts, spots = Counter(r.image_id for r in out["texts"].collect()), Counter(r.image_id for r in out["junctions"].collect())
    for r in report:
        if r.ord == 0 and r.section < 3:
            n = (sum(i == r.image_id for i, _ in comps), texts[r.image_id], spots[r.image_id])[r.section]
            assert r.line.endswith(f"] {n}个")
    for r in report:
        if r.section == 0 and r.ord > 0:
            c = comps[r.image_id, r.ord - 1]
            assert r.line.startswith(f"  {c.designator}") and (f"值={c.value}" in r.line if c.value else "值未识别" in r.line)
    routes = out["routes"]
    assert routes.count() == routes.select("image_id", "line").distinct().count() > 0
    kinds = {r.kind: r.n for r in routes.groupBy("line.kind").agg(F.count("n").alias("n")).collect()}
    assert set(kinds) == {0, 1} and routes.where("line.kind = 1 AND n < 0").isEmpty()
