"""Pictures with few rows meet by picture, crowded ones by cells and lanes; both give the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from netloom.lineage import cut
from netloom.operators import graph, replies, segments, spatial, wiring


def drawn(spark):
    rng = random.Random(7)
    comps, ports, junctions = [], [], []
    for image in (1, 2):
        for i in range(14):
            x, y = rng.randrange(0, 500), rng.randrange(0, 500)
            w, h = rng.randrange(10, 90), rng.randrange(10, 70)
            name = rng.choice(["Resistor", "GND", "Diode"])
            comps.append((image, i, name, x, y, x + w, y + h))
            n = rng.choice([1, 2, 3])
            ports += [(image, i, p, x + rng.randrange(w), y + rng.randrange(h), n, name) for p in range(n)]
        junctions += [(image, rng.randrange(0, 520), rng.randrange(0, 520) // 8 * 8) for _ in range(25)]
    return (spark.createDataFrame(comps, "image_id bigint, idx bigint, name string, x1 bigint, y1 bigint, x2 bigint, y2 bigint"),
            spark.createDataFrame(ports, "image_id bigint, ci bigint, pi int, px bigint, py bigint, n_ports int, name string"),
            wiring.base_junctions(spark.createDataFrame(junctions, "image_id bigint, jx bigint, jy bigint")),
            spark.createDataFrame([(i, 120, 90, 150, 110, 12, 300) for i in (1, 2)], "image_id bigint, pjr int, pjf int, p2p_max int, agg_p2p int, jj_align int, jj_max int"))


def stages(spark):
    comps, ports, junctions, limits = drawn(spark)
    comps, ports, junctions = (cut(df) for df in (comps, ports, junctions))
    links = cut(wiring.nearest_junctions(ports, junctions, comps, limits))
    held = links.where("(ci + pi) % 3 <> 0")
    nn = cut(wiring.nearest_by_direction(junctions, links, comps, limits))
    return {"links": links, "close": wiring.close_ports(ports, held), "sight": wiring.sight_lines(ports, comps, held),
            "pairs": wiring.junction_pairs(junctions, links, comps, limits), "nearest": nn, "routes": wiring.routes(wiring.lines_of(links, nn, ports), comps, ports),
            "merged": wiring.merge_points(ports, "px", "py", F.lit(30))}


def test_both_ways_agree(spark, monkeypatch):
    few = {n: sorted(map(str, df.collect())) for n, df in stages(spark).items()}
    monkeypatch.setattr(spatial, "FEW", 10)
    many = {n: sorted(map(str, df.collect())) for n, df in stages(spark).items()}
    assert all(few.values())
    for n in few:
        assert few[n] == many[n], n


def test_few_rows_are_not_repeated_by_cells(spark):
    comps, ports, junctions, limits = drawn(spark)
    plan = wiring.nearest_junctions(ports, junctions, comps, limits)._jdf.queryExecution().optimizedPlan().toString()
    assert "cell_x" not in plan


@pytest.mark.parametrize("limit", [0, 5, 1000])
def test_components_by_one_pass_and_by_rounds(spark, monkeypatch, limit):
    monkeypatch.setattr(graph, "FOLD_ROWS", limit)
    nodes = spark.createDataFrame([(k, n) for k in (1, 2) for n in range(12)], "image_id bigint, node bigint")
    edges = spark.createDataFrame([(1, 3, 9), (1, 9, 5), (1, 5, 4), (2, 11, 10), (2, 10, 2), (2, 8, 7), (2, 7, 6), (2, 6, 2), (2, 1, 0), (2, 0, 3)], "image_id bigint, a bigint, b bigint")
    got = {(r[0], r[1]): r[2] for r in graph.connected_components(nodes, edges).collect()}
    assert got == {(1, n): 3 if n in (3, 4, 5, 9) else n for n in range(12)} | {(2, n): 2 if n in (2, 6, 7, 8, 10, 11) else 0 if n in (0, 1, 3) else n for n in range(12)}


def test_segments_both_ways_agree(spark, monkeypatch):
    rng = random.Random(3)
    segs = spark.createDataFrame([(k, i, rng.randrange(120), rng.randrange(120), rng.randrange(120), rng.randrange(120)) for k in (1, 2) for i in range(18)],
                                 "image_id bigint, seg bigint, x1 bigint, y1 bigint, x2 bigint, y2 bigint")
    ports = spark.createDataFrame([(k, i // 2, i % 2, rng.randrange(120), rng.randrange(120), 2, "R") for k in (1, 2) for i in range(16)],
                                  "image_id bigint, ci bigint, pi int, px bigint, py bigint, n_ports int, name string")

    def made():
        grouped = cut(segments.wire_groups(segs))
        on = cut(segments.ports_on_wires(ports, segments.leaf_ends(grouped)))
        tables = [segments.drop_repeats(segs, 60), grouped, on, segments.proximity(ports), segments.nearest_on_wire(ports, cut(segments.merge_wires(on)))]
        return [sorted(map(str, t.select(sorted(t.columns)).collect())) for t in tables]
    few = made()
    assert all(few)
    monkeypatch.setattr(spatial, "FEW", 3)
    assert made() == few


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_wires_of_small_pictures_are_shuffled_by_picture_only(spark):
    rng = random.Random(5)
    segs = cut(spark.createDataFrame([(k, i, *[rng.randrange(120) for _ in range(4)]) for k in (1, 2) for i in range(9)],
                                     "image_id bigint, seg bigint, x1 bigint, y1 bigint, x2 bigint, y2 bigint"))
    ports = cut(spark.createDataFrame([(k, i // 2, i % 2, rng.randrange(120), rng.randrange(120)) for k in (1, 2) for i in range(8)],
                                      "image_id bigint, ci bigint, pi int, px bigint, py bigint"))
    assert spatial.crowded(segs, ports) is None
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        grouped = segments.wire_groups(segs)
        assert exchanges(grouped) == 1
        on = segments.ports_on_wires(ports, segments.leaf_ends(grouped))
        assert exchanges(on) <= 3  # segments, their leaves, ports
        assert exchanges(segments.merge_wires(on)) <= 4
    finally:
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_components_in_lists(spark):
    rows = spark.createDataFrame([(1, [5, 9, 4, 7, 5], [9, 5], [5, 4]), (2, [3, 1], [], []), (3, [], [], []), (4, [1 << 60, (1 << 60) + 1, 0], [1 << 60], [(1 << 60) + 1])],
                                 "k int, n array<bigint>, a array<bigint>, b array<bigint>")
    got = {r.k: r.c for r in rows.select("k", graph.components_in_lists(F.col("n"), F.col("a"), F.col("b")).alias("c")).collect()}
    assert got == {1: [4, 4, 4, 7, 4], 2: [3, 1], 3: [], 4: [1 << 60, 1 << 60, 0]}


@pytest.mark.parametrize("pairs", [1, 7, 4_000_000])
def test_wires_do_not_depend_on_the_slices(spark, monkeypatch, pairs):
    rng = random.Random(11)
    rows = [(k, i, *[rng.randrange(90) for _ in range(4)]) for k in range(6) for i in range(rng.randrange(1, 14))]
    near = lambda p, q: any(((p[i] - q[k]) ** 2 + (p[i + 1] - q[k + 1]) ** 2) ** .5 <= 12 for i in (2, 4) for k in (2, 4))
    want = {r[:2]: r[1] for r in rows}
    for _ in rows:
        for p in rows:
            for q in rows:
                if p[0] == q[0] and near(p, q):
                    want[p[:2]] = min(want[p[:2]], want[q[:2]])
    monkeypatch.setattr(segments, "PAIRS", pairs)
    segs = spark.createDataFrame(rows, "image_id bigint, seg bigint, x1 bigint, y1 bigint, x2 bigint, y2 bigint")
    assert {(r.image_id, r.seg): r.g for r in segments.wire_groups(segs).collect()} == want


def test_circuit_replies_are_parsed_once(spark):
    good = '{"name": "a", "expected_function": "f", "components": [{"id": "R1"}], "connections": [{"from_node": "A", "to_node": "B", "via": "R1"}]}'
    rows = spark.createDataFrame([(1, good), (2, "no json"), (3, None), (4, '{"name": "a"}')], "circuit_id bigint, response string")
    parsed = replies.circuit_replies(rows)
    links = replies.circuit_links(parsed)
    assert [tuple(r) for r in links.collect()] == [(1, 0, "A", "B", "R1")]
    assert {r.circuit_id: r.reject for r in parsed.collect()} == {1: None, 2: "json", 3: "json", 4: "expected_function"}
    assert links._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
