from pyspark.sql import functions as F

from netloom.operators import netlist, rules

CIRCUITS = {
    1: ([("V1", "voltage_source", "A,GND"), ("R1", "resistor", "A,B"), ("LED1", "led", "B,GND")], [("A", "B", "R1"), ("B", "GND", "LED1")]),
    2: ([("V1", "voltage_source", "A,GND"), ("LED1", "led", "A,GND")], [("A", "GND", "LED1")]),
    3: ([("V1", "voltage_source", "A,GND"), ("LED1", "led", "GND,A")], [("A", "GND", "LED1")]),
    4: ([("V1", "voltage_source", "A,GND"), ("R1", "resistor", "B,C"), ("LED1", "led", "D,E")], []),
    5: ([("V1", "voltage_source", "A,GND")], [("GND", "A", None)]),
}


def _tables(spark):
    parts = [(c, i, p, t, "5V", n.split(",")) for c, (ps, _) in CIRCUITS.items() for i, (p, t, n) in enumerate(ps)]
    links = [(c, i, a, b, v) for c, (_, ls) in CIRCUITS.items() for i, (a, b, v) in enumerate(ls)]
    return (spark.createDataFrame(parts, "circuit_id long, idx long, id string, type string, value string, nodes array<string>"),
            spark.createDataFrame(links, "circuit_id long, idx long, from_node string, to_node string, via string"))


def test_safety_rules(spark):
    parts, links = _tables(spark)
    count = {(r.circuit_id, r.type): r.n for r in rules.safety(parts, links).groupBy("circuit_id", "type").agg(F.sum("times").alias("n")).collect()}
    assert (1, "short_circuit") not in count and (1, "reverse_polarity") not in count and (1, "open_circuit") not in count
    assert (2, "short_circuit") not in count
    assert count[(3, "reverse_polarity")] == 2
    assert count[(4, "open_circuit")] == 6
    assert count[(5, "short_circuit")] == 1


def test_scores(spark):
    circuits = spark.createDataFrame([(1,), (2,), (3,)], "circuit_id long")
    issues = spark.createDataFrame([(2, "safety", "critical")] + [(3, "safety", "critical")] * 10, "circuit_id long, family string, severity string")
    got = {r.circuit_id: (r.overall_score, r.summary) for r in rules.reports(circuits, issues).collect()}
    assert got == {1: (100, "电路设计正确，质量良好"), 2: (70, "发现1处致命错误"), 3: (0, "发现10处致命错误")}


def test_many_sources_stay_one_row(spark):
    parts = spark.createDataFrame([(1, i, f"V{i}", "voltage_source", "5V", ["A", "GND"]) for i in range(50)] + [(1, 50, "D1", "diode", None, ["B", "A"])],
                                  "circuit_id long, idx long, id string, type string, value string, nodes array<string>")
    out = rules.reverse_polarity(parts).collect()
    assert len(out) == 1 and out[0].times == 50


def test_netlist_reading(spark):
    text = "* My title\nV1 1 0 DC 5\nQ1 2 3 0 NPN\nE1 3 0 1 2 1e5\n.OPTIONS x\nR1 1\nI1 1 0 AC\n.ENDS\nR9 1 2 3"
    t = spark.createDataFrame([(1, text)], "circuit_id long, text string")
    got = {r.id: (r.type, r.nodes, r.value, r.model) for r in netlist.netlist_parts(t).collect()}
    assert got == {"V1": ("voltage_source", ["1", "0"], "5", None), "Q1": ("transistor", ["2", "3", "0"], None, "NPN"),
                   "E1": ("vcvs", ["3", "0"], "1", None), "I1": ("current_source", ["1", "0"], "AC", None)}
    head = netlist.netlist_headers(t).first()
    assert (head.title, head.analysis) == ("My title", "op")


def test_netlist_round_trip(spark):
    parts, _ = _tables(spark)
    circuits = spark.createDataFrame([(c, f"c{c}", "x") for c in CIRCUITS], "circuit_id long, name string, expected_function string")
    lines = netlist.netlist_lines(circuits, parts)
    whole = {c: "\n".join(r.line for r in sorted((r for r in lines.collect() if r.circuit_id == c), key=lambda r: (r.section, r.ord))) for c in CIRCUITS}
    back = netlist.netlist_parts(spark.createDataFrame(list(whole.items()), "circuit_id long, text string"))
    ids = {(r.circuit_id, r.id) for r in back.collect()}
    assert ids == {(c, p[0]) for c, (ps, _) in CIRCUITS.items() for p in ps}
    assert whole[1].splitlines()[-1] == ".END" and "*   A -> N001" in whole[1]
