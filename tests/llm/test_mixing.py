import pytest

from netloom.llm import mixing


def test_targets_fill_up_to_the_limit():
    # the first two sources are small for their weights: they take twice their size, the last the rest
    assert mixing.targets([10, 900, 1100], [5, 2, 1], 1.5, 2) == [20.0, 1800.0, 1195.0]
    assert mixing.targets([100], [5], 1.5, 2) == [150.0]
    assert mixing.targets([], [], 1.5, 2) == []
    assert mixing.targets([0, 0], [5, 2], 1.5, 2) == [0.0, 0.0]


def plain_apportion(votes, caps, seats):
    out = [0] * len(votes)
    for _ in range(min(seats, sum(c for c, v in zip(caps, votes) if v > 0))):
        i = min((i for i in range(len(votes)) if out[i] < caps[i] and votes[i] > 0), key=lambda i: (-votes[i] / (2 * out[i] + 1), i))
        out[i] += 1
    return out


@pytest.mark.parametrize("votes,caps,seats", [([53, 24, 23], [9, 9, 9], 7), ([10, 10, 10], [5, 5, 5], 7), ([100, 1], [3, 50], 20), ([0, 5], [9, 9], 4), ([1], [0], 3), ([7, 3, 3, 1], [4, 9, 1, 9], 12)])
def test_apportion_equals_highest_quotients(votes, caps, seats):
    assert mixing.apportion(votes, caps, seats) == plain_apportion(votes, caps, seats)


def test_hot_source_nulls_and_reruns(spark, make_docs):
    docs = make_docs([None, "", "a b"] + [f"word {i} " * (i % 40) for i in range(600)], source=lambda i: None if i % 7 == 0 else "hot" if i % 3 else f"s{i % 5}").withColumn("size", mixing.F.lit("x"))
    rows = mixing.mix(docs, docs_per_shard=50, block=16).collect()
    assert len(rows) == 603
    assert sorted(rows) == sorted(mixing.mix(docs.repartition(7), docs_per_shard=50, block=16).collect())
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.source, [0, r.target, r.source_size, 0])[0] += r.taken
        by[r.source][3] += r["size"]
    assert all(abs(taken - target) <= 16 * 8 and size == total for taken, target, size, total in by.values())
    assert sum(t for _, t, _, _ in by.values()) == pytest.approx(1.5 * sum(s for *_, s in by.values()))


def test_empty(spark, make_docs):
    assert mixing.mix(make_docs([]).limit(0)).collect() == []
    assert [r.taken for r in mixing.mix(make_docs(["", None])).collect()] == [0, 0]
