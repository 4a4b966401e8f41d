import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.llm import repeats
from tests.llm.conftest import sentence


def plain(rows):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k:k + 100] in seen:
                gone[k:k + 100] = b"\1" * 100
            seen.add(b[k:k + 100])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    passages = [sentence(rng, n) for n in (18, 20, 21, 40, 90)] + ["é" * 70, "ab" * 80]
    texts = [None, "", "x" * 99, "x" * 100, "x" * 101, "x" * 350]
    for _ in range(60):
        parts = [sentence(rng, rng.randrange(40)) for _ in range(4)]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            parts.insert(rng.randrange(5), p[:rng.randrange(60, 600)] if rng.random() < 0.5 else p)
        t = " ".join(parts)
        texts.append(t)
        if rng.random() < 0.3:
            at = rng.randrange(len(t) + 1)
            texts += [t, t[:at] + "#" + t[at:]]
        if rng.random() < 0.2:
            texts.append(t + " " + t)
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk", [4 << 20, 150])
def test_equals_plain_version(spark, make_docs, monkeypatch, chunk):
    rows = corpus(chunk)
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    df = make_docs(rows).withColumnRenamed("source", "digest").repartition(5)
    assert sorted(map(tuple, repeats.remove_repeats(df).collect())) == plain(rows)


@pytest.mark.parametrize("flush", [250_000, 40])
def test_hot_hashes_are_met_by_single_strings(spark, make_docs, monkeypatch, flush):
    """A passage in many different surroundings: its hashes are hot, and the result is that of the plain version."""
    monkeypatch.setattr(repeats, "HOT_LEAST", 5)
    monkeypatch.setattr(repeats, "FLUSH", flush)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 1000)
    rng = random.Random(11)
    passage = sentence(rng, 60)
    rows = corpus(9) + [(1000 + i, f"{sentence(rng, 8, 10 ** 6)} {passage[i % 7:]} {sentence(rng, 8, 10 ** 6)}") for i in range(80)]
    rng.shuffle(rows)
    df = make_docs(rows).repartition(6)
    assert len(repeats.hot_grams(repeats.marks(df, 7))) > 0
    assert sorted(map(tuple, repeats.remove_repeats(df).collect())) == plain(rows)


def test_entries_of_a_hot_passage_are_combined_and_its_strings_spread(spark, make_docs, monkeypatch):
    """A passage in a third of all documents: no bucket of strings holds much more than the others."""
    monkeypatch.setattr(repeats, "HOT_LEAST", 50)
    rng = random.Random(12)
    passage = sentence(rng, 60)
    rows = [(i, sentence(rng, 40, 10 ** 6) + (" " + passage + " " + sentence(rng, 40, 10 ** 6) if i % 3 == 0 else "")) for i in range(3000)]
    df = make_docs(rows).repartition(4)
    marked = repeats.marks(df, 8)
    asking = df.select(F.col("doc_id").alias("doc"))
    found = repeats.contexts(df, marked, asking, 3000, 8, repeats.hot_grams(marked)).where("kind <> 2")
    held = [r.n for r in found.groupBy("bucket").agg(F.sum(F.length("bytes") * F.when(F.col("kind") == 1, 1).otherwise(0)).alias("n")).collect()]
    assert len(held) == 8 and max(held) < 1.5 * sorted(held)[4]
    stretches = found.where("kind = 0").agg(F.coalesce(F.max(F.length("doc") / 8), F.lit(0)).alias("n")).first().n
    assert stretches <= 2 * repeats.HOT_LEAST


def test_levels_grow_geometrically():
    rng, family, seen = np.random.default_rng(0), repeats.Family(), {}
    for batch in range(40):
        n = int(rng.integers(1, 60))
        gram, stretch = rng.integers(0, 50, n).astype(np.uint64), rng.integers(0, 4, n).astype(np.uint64)
        doc, start = np.full(n, batch), np.arange(n)
        got = family.add(gram, stretch, doc, start)
        want = []
        for g, s in zip(gram, stretch):
            want.append((g, s) in seen)
            seen[g, s] = True
        assert got.tolist() == want
        sizes = [len(x) for x in family.levels]
        assert all(a > 2 * b for a, b in zip(sizes, sizes[1:]))
    assert len(family.levels) <= 8


def test_batches_do_not_change_the_marks():
    rng = np.random.default_rng(5)
    n = 4000
    c = {"gram": rng.integers(0, 300, n).astype(np.uint64), "stretch": rng.integers(0, 3, n).astype(np.uint64), "doc": rng.integers(0, 200, n), "start": np.arange(n), "count": np.ones(n, np.uint8)}
    one, many = (next(repeats.scanned(c, size)) for size in (n, 37))
    assert all((x == y).all() for x, y in zip(one, many))


def test_repeated_rows_null_ids_and_empty_tables(spark, make_docs):
    assert repeats.remove_repeats(make_docs([]).limit(0)).collect() == []
    t = "".join(random.Random(1).choices("abcdef ", k=300))
    out = sorted(map(tuple, repeats.remove_repeats(make_docs([(1, t), (1, t), (None, t[50:200]), (2, "short")])).collect()), key=str)
    assert [(r[0], r[2]) for r in out] == [(1, 150), (1, 150), (2, 0), (None, 0)]


def test_without_broadcasts(spark, make_docs, monkeypatch):
    """Beyond the limit of a broadcast the wanted texts are joined by a shuffle."""
    monkeypatch.setattr(repeats, "small_enough", lambda df, rows: df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = corpus(8)[:60]
        assert sorted(map(tuple, repeats.remove_repeats(make_docs(rows)).collect())) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
