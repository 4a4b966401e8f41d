import random

from pyspark.sql import functions as F

from netloom.lineage import cut
from netloom.operators import graph, spatial, values, wiring


def told(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def drawn(spark, n=60):
    rng = random.Random(7)
    ports = [(i, c, p, rng.randrange(60), rng.randrange(60), 2 if c % 3 else 3) for i in (1, 2, 3) for c in range(n // 6) for p in range(2 if c % 3 else 3)]
    place = {(i, c, p): (x, y) for i, c, p, x, y, _ in ports}
    spots = [(i, *place[i, c, p]) for i in (1, 2) for c in range(4) for p in (0, 1)] + [(i, k * 9, 100 + k) for i in (1, 2) for k in range(6)]
    links = []
    for i, c, p, *_ in ports:
        for k, (_, x, y) in enumerate(rng.sample([s for s in spots if s[0] == i], 2)) if i < 3 and rng.random() < 0.7 else ():
            links.append((i, c, p, x, y, 10 * k + p))
    a, b = spots[0][1:], spots[4][1:]  # two ports that are each other's target
    links += [(1, 0, 0, *b, 99), (1, 2, 0, *a, 99)]
    jj = [(i, x, y, *rng.choice(spots)[1:], 0) for i, x, y in rng.sample(spots, 12)]
    limits = spark.createDataFrame([(i, 5, 8) for i in (1, 2, 3)], "image_id bigint, grid_snap int, uf_merge int")
    linked = spark.createDataFrame(links, "image_id bigint, ci bigint, pi int, jx bigint, jy bigint, o int")
    return (spark.createDataFrame(ports, "image_id bigint, ci bigint, pi int, px bigint, py bigint, n_ports int"),
            linked.withColumn("ord", wiring.order(1, F.col("o"), F.col("ci"), F.col("pi"))).drop("o"),
            spark.createDataFrame(jj, "image_id bigint, ax bigint, ay bigint, bx bigint, by bigint, way int"), limits)


def found(spark):
    ports, links, jj, limits = (cut(df) for df in drawn(spark))
    junctions = links.select("image_id", "jx", "jy")
    groups, kept = wiring.settled_groups(ports, links, jj)
    return {"ports": wiring.prepare_ports(ports), "junctions": wiring.prepare_junctions(junctions, limits), "snap": wiring.snap(ports, "px", "py", F.lit(4)),
            "merge": wiring.merge_points(ports, "px", "py", F.lit(6)), "groups": groups, "kept": kept,
            "first": wiring.port_groups(ports, links, jj), "final": wiring.port_groups(ports, links, jj, final=True)}


def test_lists_of_small_pictures_and_rows_of_crowded_ones_agree(spark, monkeypatch):
    few = {n: told(df) for n, df in found(spark).items()}
    ports, links, jj, _ = drawn(spark)
    kept = wiring.unshort(ports, links, wiring.port_groups(ports, links, jj))
    assert few["kept"] == told(kept) and links.count() > kept.count() > 0
    assert few["groups"] == told(wiring.eligible(wiring.port_groups(ports, kept, jj, final=True)))
    monkeypatch.setattr(spatial, "FEW", 0)
    many = {n: told(df) for n, df in found(spark).items()}
    for n in few:
        assert few[n] and few[n] == many[n], n


def test_small_pictures_are_placed_and_grouped_without_joins_of_points(spark):
    """Snapping, merging and grouping shuffle rows by picture only; points were joined to their clusters axis by axis."""
    ports, links, jj, limits = (cut(df) for df in drawn(spark))
    assert "Join" not in plan(wiring.prepare_ports(ports)) and "Window" not in plan(wiring.snap(ports, "px", "py", F.lit(5)))
    assert plan(wiring.port_groups(ports, links, jj)).count("Join ") == 2  # links and junction links come to the ports of a picture
    assert plan(wiring.prepare_junctions(links.select("image_id", "jx", "jy"), limits)).count("Join ") == 1


def test_capped_pairs_of_small_pictures_are_shuffled_once(spark, monkeypatch):
    """Lists and walks accept the same pairs; written and counted tables were joined to their busy ends twice."""
    rng = random.Random(3)
    rows = [(i, rng.randrange(6), rng.randrange(6), k, k % 5) for i in (1, 2) for k in range(40)]
    pairs = spark.createDataFrame(rows, "image_id bigint, a bigint, b bigint, k int, way int").withColumn("ord", F.struct("k")).drop("k")
    few = graph.capped_pairs(cut(pairs), 4)
    assert "Join" not in plan(few)
    few = told(few)
    monkeypatch.setattr(spatial, "FEW", 0)
    assert few == told(graph.capped_pairs(cut(pairs), 4)) and 0 < len(few) < 80


def test_texts_of_small_pictures_meet_their_components_by_picture(spark, monkeypatch):
    rng = random.Random(5)
    comps = cut(spark.createDataFrame([(i, k, rng.choice(["Resistor", "Capacitor", "GND"]), 0.9, rng.randrange(600), rng.randrange(600)) for i in (1, 2) for k in range(9)],
                                      "image_id bigint, idx bigint, name string, conf double, cx bigint, cy bigint"))
    texts = cut(spark.createDataFrame([(i, k, rng.choice(["10k", "5uF", "7", "22Ω"]), rng.randrange(600), rng.randrange(600)) for i in (1, 2, 3) for k in range(9)],
                                      "image_id bigint, text_ord bigint, text string, cx bigint, cy bigint"))
    both = lambda: (told(values.match_by_proximity(comps, texts)), told(values.nearest_texts(comps, texts)))
    by_cell = both()  # not counted
    spatial.crowded(comps, texts)
    assert "cell_x" not in plan(values._in_reach(comps, texts)) and both() == by_cell and all(by_cell)
    monkeypatch.setattr(spatial, "FEW", 5)
    spatial.crowded(comps, texts)
    assert both() == by_cell


def test_wired_results_are_kept_with_what_was_prepared(spark):
    made = {"groups": None}
    ready = {wiring.in_effect({"skip_llm": True}): made}
    assert wiring.wire(ready, {"skip_llm": True}) is made and wiring.wire(ready, {"use_sobel": False}) is made
