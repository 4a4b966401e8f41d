import numpy as np
import pytest

from netloom.llm import packed


def plain(edges):
    nodes, root = sorted({x for e in edges for x in e}), {}
    for n in nodes:
        root[n] = n
    for a, b in edges:
        x, y = root[a], root[b]
        if x != y:
            for n in nodes:
                if root[n] in (x, y):
                    root[n] = min(x, y)
    return sorted(root.items())


def frame(spark, edges, parts):
    return spark.createDataFrame(edges, "a bigint, b bigint").repartition(parts)


@pytest.mark.parametrize("n", [400, 800])
def test_edges_stay_in_proportion_to_nodes(spark, n):
    """A group of copies with many links, dealt over many partitions."""
    rng = np.random.default_rng(n)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, n, (n * 30, 2)) if a != b]
    table, some = packed.folded(frame(spark, edges, 64))
    assert some and table.count() <= 2 * n
    assert sorted(map(tuple, packed.components(frame(spark, edges, 64)).collect())) == plain(edges)


def test_paths_stars_and_several_components(spark):
    rng = np.random.default_rng(2)
    ids = rng.permutation(300)
    path = [(int(ids[i]), int(ids[i + 1])) for i in range(120)]
    star = [(int(ids[200]), int(x)) for x in ids[201:260]]
    loose = [(1000 + i, 2000 + i) for i in range(10)] + [(5000, 5000)]
    edges = path + star + loose
    got = dict(packed.components(frame(spark, edges, 16)).collect())
    want = dict(plain(edges))
    assert {k: v for k, v in want.items() if k != 5000} == {k: v for k, v in got.items() if k != 5000}
    assert packed.components(frame(spark, edges, 2).limit(0)).collect() == []
