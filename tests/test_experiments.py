import pytest

from netloom.functions import dims
from netloom.operators import experiments, wiring


def test_settings_of_the_vector_path():
    assert list(experiments.honoured()) == ["Ours", "Baseline", "w/o_Sobel"]
    for name in set(dims.ABLATIONS) - set(experiments.honoured()):
        with pytest.raises(ValueError):
            wiring.wire({}, dims.ABLATIONS[name])


def test_entries_of_wired_ports(spark):
    groups = spark.createDataFrame([(1, 0, 0, 7), (1, 1, 1, 7), (1, 2, 0, 8)], "image_id long, ci long, pi int, g long")
    ids = spark.createDataFrame([(1, 0, 0, "R1.1"), (1, 1, 1, "U1.a.OUT")], "image_id long, ci long, pi int, port_id string")
    got = {tuple(r) for r in experiments.predicted_entries(groups, ids).collect()}
    assert got == {(1, 7, "R1", "1"), (1, 7, "U1.a", "OUT")}


def test_rates_of_every_setting(spark):
    """The run over all settings equals sets of pairs listed for each picture."""
    from collections import defaultdict
    from itertools import combinations

    from netloom.operators import detect, metrics
    from netloom.plans import q_wiring
    from netloom.plans.catalog import QUERIES
    from netloom.plans.fixtures import Tables

    folder = "/root/testdata/sf0.001"
    t = Tables(spark, folder)
    ready, (named, ports, truth) = q_wiring.prepared(t), q_wiring.ablation_inputs(t)
    ids = {(r.image_id, r.ci, r.pi): r.port_id for r in metrics.port_identity(detect.match_boxes(ready["comps"], named), ready["ports"], ports).collect()}
    true = defaultdict(list)
    for r in truth.collect():
        true[r.image_id, r.g].append(f"{r.designator}.{r.label}")

    def edges(groups):
        out = defaultdict(set)
        for (image, _), members in groups.items():
            if len(members) >= 2:
                out[image] |= set(combinations(sorted(set(members)), 2))
        return out
    want, rows, seen = edges(true), {(r.config, r.image_id): r for r in QUERIES["A10_ablation_run"](spark, folder).collect()}, 0
    assert {c for c, _ in rows} == set(experiments.honoured()) and len(rows) == 3 * t.images.count()
    for config, switches in experiments.honoured().items():
        found = defaultdict(set)
        for r in wiring.wire(ready, switches)["groups"].collect():
            if (r.image_id, r.ci, r.pi) in ids:
                found[r.image_id, r.g].add(ids[r.image_id, r.ci, r.pi])
        got = edges(found)
        for image in {i for c, i in rows if c == config}:
            a, b, r = want[image], got[image], rows[config, image]
            assert (round(r.port_correct_rate or 0, 9), round(r.fp_rate or 0, 9)) == (round(len(a & b) / len(a), 9) if a else 0, round(len(b - a) / len(b), 9) if b else 0)
            seen += len(a & b)
    assert seen > 0
