import numpy as np
import pytest

from netloom.llm import pivots


def plain(rows, cosine=0.9):
    good = {k: np.array(v, float) for k, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)}
    ids, comp, links = [i for i, _ in rows], list(range(len(rows))), [0] * len(rows)
    for a in good:
        for b in good:
            if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= cosine:
                links[a] += 1
                links[b] += 1
                old, new = comp[b], comp[a]
                comp = [new if c == old else c for c in comp]
    least = {c: min(ids[k] for k in range(len(rows)) if comp[k] == c) for c in set(comp)}
    return sorted((i, n, least[c], i == least[c]) for i, n, c in zip(ids, links, comp))


def vectors(seed, n, dims=24, groups=12, noise=0.2):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, dims))
    rows = [list(map(float, (centres[k % groups] + noise * r.normal(size=dims)) if k % 2 else r.normal(size=dims))) for k in range(n)]
    return rows + [rows[1]] * 3 + [[x * 5 for x in rows[1]]]


@pytest.mark.parametrize("block", [1024, 5])
def test_equals_all_pairs(spark, block):
    rows = list(enumerate(vectors(1, 150)))
    rows += [(500, None), (501, [0.0] * 24), (502, [float("nan")] * 24), (503, [None] * 24), (504, []), (505, [1.0, 2.0]), (506, [2.0, 4.0]), (507, [float("inf")] * 24)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<double>, n int")
    got = sorted(tuple(r) for r in pivots.near_duplicates(df, block=block).collect())
    want = plain(rows)
    assert sum(w[1] for w in want) > 100
    found, all_ = sum(g[1] for g in got), sum(w[1] for w in want)
    assert len(got) == len(want) and all(g[1] <= w[1] for g, w in zip(got, want)) and found >= 0.97 * all_
    assert [g for g in got if g[0] >= 500] == [w for w in want if w[0] >= 500]


def test_recall_over_the_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").limit(600)
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    near = [(10_000 + i, [x + 0.02 * ((i + k) % 7 - 3) for k, x in enumerate(v)]) for i, v in rows[:200]]
    df = spark.createDataFrame(rows + near, "vec_id bigint, embedding array<double>")
    got, want = {r.vec_id: r.n_links for r in pivots.near_duplicates(df).collect()}, {w[0]: w[1] for w in plain(rows + near)}
    assert sum(want.values()) > 100 and sum(got.values()) >= 0.95 * sum(want.values()) and all(got[i] <= want[i] for i in want)


@pytest.mark.parametrize("n_points", [44, 280, 1000, 4096])
def test_recall_near_the_threshold_with_many_points(spark, n_points):
    r, pairs, dims = np.random.default_rng(n_points), 600, 64
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    u, w = unit(r.normal(size=(pairs, dims))), r.normal(size=(pairs, dims))
    v = 0.901 * u + np.sqrt(1 - 0.901 ** 2) * unit(w - (w * u).sum(1)[:, None] * u)
    classes = spark.createDataFrame([(i, 1, bytearray(x.tobytes())) for i, x in enumerate([*u, *v])], "node bigint, n bigint, v binary")
    posted = pivots.postings(classes, unit(r.normal(size=(n_points, dims)))).selectExpr("list", "0 AS i", "0 AS j", "0 AS part", "node", "n", "near", "v")
    found = pivots.verified(posted.repartition(4, "list").sortWithinPartitions("list"), n_points).groupBy().sum("links").collect()[0][0]
    assert 2 * pairs * 0.97 <= found <= 2 * pairs


def test_empty_and_unlinked(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert pivots.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    assert [tuple(r) for r in pivots.near_duplicates(spark.createDataFrame([(3, None)], schema)).collect()] == [(3, 0, 3, True)]
    assert sorted(tuple(r) for r in pivots.near_duplicates(spark.createDataFrame([(3, [1.0]), (4, [2.0]), (5, [-1.0])], schema)).collect()) == [(3, 1, 3, True), (4, 1, 3, False), (5, 0, 5, True)]


def test_null_and_repeated_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (None, [0.0, 1.01]), (None, [-1.0, 0.0]), (None, [-1.0, 0.01]), (4, [0.5, -1.0]), (None, None)]
    got = pivots.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (None, 1, 1, False), (None, 1, None, True), (None, 1, None, True),
                                                       (4, 0, 4, True), (None, 0, None, True)], key=str)
