import random
from itertools import combinations

from netloom.operators import metrics

SCHEMA = "image_id long, g long, designator string, label string"


def _rates(spark, truth, pred):
    images = spark.createDataFrame([(1,)], "image_id long")
    rows = lambda gs: [(1, g, *m.split(".")) for g, ms in enumerate(gs) for m in ms]
    r = metrics.evaluate(images, spark.createDataFrame(rows(truth), SCHEMA), spark.createDataFrame(rows(pred), SCHEMA)).first()
    return tuple(r[m] for m in metrics.RATES)


def test_perfect(spark):
    g = [["R1.1", "C1.1"], ["R2.2", "U1.+", "L1.1"]]
    assert _rates(spark, g, g) == (1.0, 0.0, 0.0, 1.0, 1.0)


def test_nothing_predicted(spark):
    assert _rates(spark, [["R1.1", "R2.1", "C1.1"]], []) == (0.0, 0.0, 1.0, 0.0, 0.0)


def test_part_of_group(spark):
    got = _rates(spark, [["R1.1", "R2.1", "C1.1"]], [["R1.1", "R2.1"]])
    assert [round(x, 6) for x in got] == [0.333333, 0.0, 0.666667, 0.0, 0.0]


def test_pair_counts_with_shared_members(spark):
    rnd = random.Random(3)
    groups = {(i, g): set(rnd.sample(range(12), rnd.randint(2, 8))) for i in range(5) for g in range(6)}
    df = spark.createDataFrame([(i, g, str(x)) for (i, g), ms in groups.items() for x in ms], "image_id long, g long, id string")
    got = {r.image_id: r.pairs for r in metrics.pair_counts(df).collect()}
    for i in range(5):
        assert got[i] == len({p for (k, _), ms in groups.items() if k == i for p in combinations(sorted(map(str, ms)), 2)})


def test_equal_groups_match_once(spark):
    rows = lambda gs: [(1, g, x, x[0]) for g, ms in enumerate(gs) for x in ms]
    t = spark.createDataFrame(rows([["a", "b"], ["a", "b"], ["c", "d"]]), "image_id long, g long, id string, designator string")
    p = spark.createDataFrame(rows([["a", "b"], ["c", "d"], ["c", "d"]]), "image_id long, g long, id string, designator string")
    assert {(r.g, r.p) for r in metrics.matched_groups(t, p).collect()} == {(0, 0), (2, 1)}


def _plain_edges(groups):
    return {p for g in groups for p in combinations(sorted(g), 2)}


def test_edges_equal_listed_pairs(spark):
    rnd, truth, pred, want = random.Random(11), [], [], {}
    for i in range(8):
        t, p = ([set(rnd.sample(range(14), rnd.randint(2, 7))) for _ in range(5)] for _ in range(2))
        truth += [(i, g, str(x)) for g, ms in enumerate(t) for x in ms]
        pred += [(i, g, str(x)) for g, ms in enumerate(p) for x in ms]
        a, b = (_plain_edges([set(map(str, m)) for m in gs]) for gs in (t, p))
        want[i] = (len(a & b), len(b - a), len(a - b))
    frame = lambda rows: spark.createDataFrame(rows, "image_id long, g long, id string")
    got = {r.image_id: (r.tp, r.fp, r.fn) for r in metrics.edge_counts(frame(truth), frame(pred)).collect()}
    assert got == want


def test_an_id_in_many_groups_on_both_sides(spark):
    n = 1000
    rows = [(1, g, x) for g in range(n) for x in ("hot", f"x{g}")]
    df = spark.createDataFrame(rows, "image_id long, g long, id string")
    assert [tuple(r) for r in metrics.edge_counts(df, df).select("tp", "fp", "fn").collect()] == [(n, 0, 0)]


def test_heavy_groups_count_the_same(spark):
    """Every border between light and heavy groups gives the pairs of a plain listing."""
    rnd = random.Random(21)
    t, p = ({(i, g): set(rnd.sample(range(16), rnd.randint(2, 11))) for i in range(4) for g in range(6)} for _ in range(2))
    frame = lambda gs: spark.createDataFrame([(i, g, str(x)) for (i, g), ms in gs.items() for x in ms], "image_id long, g long, id string")
    plain = lambda gs, i: _plain_edges([set(map(str, ms)) for (k, _), ms in gs.items() if k == i])
    for heavy in (1, 4, 7):
        assert {r.image_id: r.pairs for r in metrics.pair_counts(frame(t), heavy=heavy).collect()} == {i: len(plain(t, i)) for i in range(4)}
        for product in (1, 100):
            got = {r.image_id: r.pairs for r in metrics.shared_pairs(frame(t), frame(p), heavy=heavy, product=product).collect()}
            assert got == {i: len(plain(t, i) & plain(p, i)) for i in range(4)}


def test_a_group_with_ten_thousand_classes(spark):
    """All ids lie in group 0, each in another group of its own too: no two classes are alike, and they never meet in pairs."""
    n = 10_000
    df = spark.range(n).selectExpr("1L AS image_id", "explode(array(0L, id + 1)) AS g", "concat('x', id) AS id")
    df = df.unionByName(spark.range(n).selectExpr("1L AS image_id", "id + 1 AS g", "concat('y', id) AS id"))
    assert [tuple(r) for r in metrics.edge_counts(df, df).select("tp", "fp", "fn").collect()] == [(n * (n - 1) // 2 + n, 0, 0)]


def test_groups_of_equal_digest_are_compared_by_members(spark):
    found = spark.createDataFrame([(1, 0, 5, 2), (1, 1, 6, 2)], "image_id long, g long, p long, n long")
    t = spark.createDataFrame([(1, 0, "a"), (1, 0, "b"), (1, 1, "c"), (1, 1, "d")], "image_id long, g long, id string")
    p = spark.createDataFrame([(1, 5, "a"), (1, 5, "x"), (1, 6, "d"), (1, 6, "c")], "image_id long, g long, id string")
    assert [tuple(r) for r in metrics._verified(found, t, p).collect()] == [(1, 1, 6)]
