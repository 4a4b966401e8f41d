"""Properties of node numbers, and pictures worked out by hand."""

import random

import pytest

from netloom.operators import segments

PORTS = "image_id long, ci long, pi int, px long, py long, n_ports int, name string"
MERGED = "image_id long, ci long, pi int, m long, first long"


def nodes_of(spark, ports, merged):
    got = segments.assign_nodes(spark.createDataFrame(ports, PORTS), spark.createDataFrame(merged, MERGED))
    return {(r.image_id, r.ci, r.pi): r.node for r in got.collect()}


@pytest.fixture(scope="module")
def drawn(spark):
    """Random pictures: ports far apart, each on one wire at most, and their node numbers."""
    rnd, ports, merged = random.Random(5), [], []
    for image in range(12):
        spots = rnd.sample([(x, y) for x in range(0, 2000, 100) for y in range(0, 2000, 100)], 30)
        for ci in range(10):
            n = rnd.choice([1, 2, 2, 2, 3])
            name = "GND" if n == 1 and rnd.random() < 0.6 else "Resistor"
            for pi in range(n):
                ports.append((image, ci, pi, *spots.pop(), n, name))
                if rnd.random() < 0.7:
                    wire = rnd.choice([0, 5, 9])
                    merged.append((image, ci, pi, wire, wire + rnd.randint(0, 2)))
    return ports, merged, nodes_of(spark, ports, merged)


def test_every_port_has_a_node_and_numbers_have_no_gap(drawn):
    ports, _, got = drawn
    assert set(got) == {p[:3] for p in ports}
    for image in {p[0] for p in ports}:
        used = {n for (i, _, _), n in got.items() if i == image}
        assert used - {0} == set(range(1, len(used - {0}) + 1))


def test_ground_is_zero_and_only_wires_lead_to_it(drawn):
    ports, merged, got = drawn
    wires = {}
    for image, ci, pi, m, _ in merged:
        wires.setdefault((image, ci, pi), (image, m))
    grounded = {wires.get(p[:3]) for p in ports if p[6] == "GND"} - {None}
    for *key, _, _, _, name in ports:
        if name == "GND":
            assert got[tuple(key)] == 0
        elif got[tuple(key)] == 0:
            assert wires[tuple(key)] in grounded


def test_both_ports_of_a_part_differ(drawn):
    ports, _, got = drawn
    for image, ci, pi, *_, n, _ in ports:
        if n == 2 and pi == 1:
            assert got[image, ci, 0] != got[image, ci, 1]


def test_a_free_port_is_alone(drawn):
    ports, merged, got = drawn
    on_wire = {m[:3] for m in merged}
    for p in ports:
        if p[:3] not in on_wire and p[6] != "GND":
            assert [k for k, n in got.items() if k[0] == p[0] and n == got[p[:3]]] == [p[:3]]


def test_a_chain_by_hand(spark):
    # battery 0 between wires 1 and 2, lamp 1 between wires 2 and 3, ground 2 on wire 3
    ports = [(1, 0, 0, 0, 0, 2, "Battery"), (1, 0, 1, 0, 200, 2, "Battery"), (1, 1, 0, 300, 200, 2, "Lamp"), (1, 1, 1, 300, 600, 2, "Lamp"), (1, 2, 0, 400, 600, 1, "GND"), (1, 3, 0, 900, 0, 1, "Antenna")]
    merged = [(1, 0, 1, 2, 2), (1, 1, 0, 2, 2), (1, 1, 1, 3, 3), (1, 2, 0, 3, 3), (1, 0, 0, 1, 1), (1, 3, 0, 1, 1)]
    assert nodes_of(spark, ports, merged) == {(1, 2, 0): 0, (1, 1, 1): 0, (1, 0, 1): 1, (1, 1, 0): 1, (1, 0, 0): 2, (1, 3, 0): 2}


def test_a_bridged_part_by_hand(spark):
    # both ports of part 0 are nearest to part 1 on one wire; the second gets a node of its own
    ports = [(1, 0, 0, 0, 0, 2, "Resistor"), (1, 0, 1, 100, 0, 2, "Resistor"), (1, 1, 0, 50, 60, 1, "Antenna")]
    assert nodes_of(spark, ports, [(1, 0, 0, 4, 4), (1, 0, 1, 4, 4), (1, 1, 0, 4, 4)]) == {(1, 0, 0): 1, (1, 1, 0): 1, (1, 0, 1): 2}


def test_ports_close_to_each_other_by_hand(spark):
    # no wires: ports of different parts within 35 pixels share a node
    ports = [(1, 0, 0, 0, 0, 1, "Lamp"), (1, 1, 0, 20, 0, 1, "Lamp"), (1, 2, 0, 200, 0, 1, "Lamp")]
    assert nodes_of(spark, ports, []) == {(1, 0, 0): 1, (1, 1, 0): 1, (1, 2, 0): 2}
