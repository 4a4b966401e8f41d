from netloom.functions import dims
from netloom.operators import experiments, metrics, wiring
from netloom.plans import q_wiring
from netloom.plans.fixtures import Tables

ENTRY = "image_id bigint, g bigint, member_ord bigint, designator string, label string"


def joins(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_rates_come_from_written_counts(spark):
    """The driver holds the plan of one count at a time, not of all of them."""
    true = spark.createDataFrame([(1, 0, 0, "R1", "1"), (1, 0, 1, "R2", "1"), (1, 1, 2, "R3", "1"), (9, 0, 0, "R1", "1")], ENTRY)
    found = spark.createDataFrame([(1, 5, 0, "R1", "1"), (1, 5, 1, "R2", "1"), (9, 5, 0, "R1", "1")], ENTRY)
    images = spark.createDataFrame([(1,), (2,)], "image_id bigint")
    rates = metrics.evaluate(images, true, found)
    assert joins(rates) == 0
    got = {r.image_id: (r.n_gt_groups, r.n_pred_groups, r.port_correct_rate) for r in rates.collect()}
    assert got == {1: (1, 1, 1.0), 2: (0, 0, 0.0)}  # a picture that was not asked for has no row


def test_equal_settings_are_wired_once(spark, monkeypatch):
    calls, wire = [], wiring.wire
    monkeypatch.setattr(wiring, "wire", lambda ready, switches=None: calls.append(switches) or wire(ready, switches))
    t = Tables(spark, "/root/testdata/sf0.001")
    named, ports, truth = q_wiring.ablation_inputs(t)
    ready = q_wiring.prepared(t)
    rows = experiments.run(ready, ready["comps"], named, ports, t.images, truth)
    assert wiring.in_effect(dims.ABLATIONS["Ours"]) == wiring.in_effect(dims.ABLATIONS["w/o_Sobel"]) != wiring.in_effect(dims.ABLATIONS["Baseline"])
    assert len(calls) == 2 and {r.config for r in rows.select("config").distinct().collect()} == {"Ours", "Baseline", "w/o_Sobel"}


def test_the_report_reads_written_tables(spark):
    report = q_wiring.whole_run(Tables(spark, "/root/testdata/sf0.001"))["report"]
    assert joins(report) <= 4  # three titles, and the pictures without groups


def test_small_pictures_stay_together_from_the_first_step(spark, monkeypatch):
    """Whether pictures are crowded is settled before the run is prepared, not after it."""
    name, seen = "spark.sql.requireAllClusterKeysForCoPartition", []

    def prepare(comps, ports, raw, limits):
        seen.append(spark.conf.get(name))
        return {"ports": ports, "junctions": raw}
    monkeypatch.setattr(q_wiring, "_prepared", {})
    monkeypatch.setattr(wiring, "prepare", prepare)
    spark.conf.set(name, "true")
    q_wiring.prepared(Tables(spark, "/root/testdata/sf0.001"))
    assert seen == ["false"]
