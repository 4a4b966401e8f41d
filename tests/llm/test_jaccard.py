import random
import re

import numpy as np
import pytest

from netloom.llm import jaccard
from tests.llm.conftest import sentence


def plain(rows, k=4, percent=85):
    """Sizes and components by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^ \t-\r]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        m = min(k, len(w))
        sets.append({tuple(w[i:i + m]) for i in range(len(w) - m + 1)} if m else set())
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            x, y = sets[i], sets[j]
            if x and y and 100 * len(x & y) >= percent * len(x | y) and comp[i] != comp[j]:
                old, new = comp[i], comp[j]
                comp = [new if c == old else c for c in comp]
    least = {}
    for (i, _), c in zip(rows, comp):
        least[c] = min(least.get(c, i), i)
    return sorted((i, len(s), least[c]) for (i, _), s, c in zip(rows, sets, comp))


def corpus(seed, groups, size):
    """Groups of near copies that drift apart, exact copies, and a passage in many documents."""
    rng = random.Random(seed)
    passage, texts = sentence(rng, 30), [None, "", " \t", "one", "ONE", "two words", "a b c d", "A b\nc d", "a b c d e"]
    for _ in range(groups):
        words = sentence(rng, rng.randrange(20, 160)).split()
        for _ in range(rng.randrange(1, size)):
            words = list(words)
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10 ** 6)}"
            texts.append(" ".join(words))
        if rng.random() < 0.4:
            texts += [texts[-1].upper(), texts[-1]]
        if rng.random() < 0.5:
            texts.append(sentence(rng, 25) + " " + passage)
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("short,parts,k,percent", [(64, 20_000, 4, 85), (3, 20_000, 4, 85), (3, 7, 5, 80)])
def test_equals_all_pairs(spark, make_docs, short, parts, k, percent):
    rows = corpus(short + k, 25, 9)
    got = jaccard.join(make_docs(rows), k=k, percent=percent, short=short, block_nodes=parts).collect()
    want = plain(rows, k, percent)
    assert len({c for _, _, c in want}) < len(rows) - 20
    assert sorted(map(tuple, got)) == want


def test_one_large_group(spark, make_docs):
    rng = random.Random(9)
    base = sentence(rng, 120).split()
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(5)):
            words[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(words)))
    assert sorted(map(tuple, jaccard.join(make_docs(rows), short=8).collect())) == plain(rows)


def test_block_search_equals_counting():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 60, 80).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 70, replace=False), rng.integers(0, 1 << 60, rng.integers(0, 12)).astype(np.uint64)])) for _ in range(40)]
    block, all_ = jaccard.Block(sets), np.ones(40, bool)
    for q in range(40):
        want = [i for i in range(40) if 100 * len(np.intersect1d(sets[q], sets[i])) >= 85 * len(np.union1d(sets[q], sets[i]))]
        assert sorted(block.search(q, all_, 85)) == want


def test_empty_repeated_and_null_ids(spark, make_docs):
    assert jaccard.join(make_docs([]).limit(0)).collect() == []
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, "A B C D E"), (3, None), (3, None), (None, "z z")]
    out = jaccard.join(make_docs(rows).withColumnRenamed("lang", "node")).collect()
    assert sorted(map(tuple, out), key=str) == sorted([(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (3, 0, 3), (None, 1, None)], key=str)


def test_without_broadcasts(spark, make_docs, monkeypatch):
    """Beyond the limit of a broadcast the wanted texts are joined by a shuffle."""
    monkeypatch.setattr(jaccard, "small_enough", lambda df, rows: df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = corpus(3, 10, 6)
        assert sorted(map(tuple, jaccard.join(make_docs(rows)).collect())) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
