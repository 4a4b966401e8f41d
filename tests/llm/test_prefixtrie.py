import hashlib
import random
import re
import zlib

import pytest

from netloom.llm import prefixtrie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def plain(rows):
    """Nodes of a trie of rebuilt conversations, as dictionaries of tuples."""
    given = {}
    for c, turn, role, text in rows:
        if c is not None:
            given.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    given = {c: [(r, t) for _, r, t in sorted(v)] for c, v in given.items()}
    built = {}
    for c, own in given.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = given.get(base, [])[:h] + own[h:]
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for key, members in nodes.items():
        inside = [k for k in nodes if k[:len(key)] == key]
        parent = nodes[key[:-1]] if key else None
        ends = sorted(c for c in members if len(built[c]) == len(key))
        childless = [k for k in inside if not any(len(x) == len(k) + 1 and x[:-1] == k for x in nodes)]
        saved = sum((len(nodes[k]) - 1) * len(re.findall(r"[^ \t-\r]+", k[-1][1])) for k in inside if k)
        out.append((min(members), len(key), min(parent) if key else None, len(members), sum(len(x) == len(key) + 1 and x[:-1] == key for x in nodes),
                    len(childless), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def talks(seed, n=90):
    rng = random.Random(seed)
    lines = ["", "yes", "no", "a b  c", "a b c", None, "what is\tthis"]
    rows = []
    for c in rng.sample(range(-30, 200), n):
        turns = [(rng.choice(["user", "assistant", None]), rng.choice(lines)) for _ in range(rng.randrange(1, 7))]
        for t, (role, text) in enumerate(turns):
            rows.append((c, None if t == 0 and rng.random() < 0.2 else t if rng.random() < 0.9 else 1, role, text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_trie(spark, seed):
    rows = talks(seed)
    assert found(prefixtrie.trie(spark.createDataFrame(rows, SCHEMA).repartition(3))) == plain(rows)


def test_copies_long_paths_null_ids_and_extra_columns(spark, monkeypatch):
    """Long equal conversations go over several ranges and blocks; many conversations end at one node."""
    monkeypatch.setattr(prefixtrie, "BLOCK", 4)
    monkeypatch.setattr(prefixtrie, "PIECE", 20)
    rows = [(c, t, "user", f"turn {t}") for c in (1000, 1003, 1005, 1007) for t in range(60)]
    rows += [(c, 0, "user", "hello there") for c in range(100, 160)] + [(None, 0, "user", "x")] + rows[:3]
    data = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS depth", "'x' AS conv", "2 AS part", "3 AS f1")
    assert found(prefixtrie.trie(data)) == plain(rows)


def test_empty(spark):
    assert prefixtrie.trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_equal_hashes_of_turns_are_noticed(spark):
    rows = spark.createDataFrame([(1, "a", "b", 5, 6), (2, "a", "c", 5, 6)], "conv bigint, role string, text string, t1 bigint, t2 bigint")
    assert prefixtrie.colliding(rows) and not prefixtrie.colliding(rows.where("conv = 1"))
