import hashlib
import itertools
import random

import pytest

from netloom.llm import anchors
from tests.llm.conftest import sentence


def plain(rows, window=13):
    """Every window of every document against all documents of smaller ids."""
    first, words = {}, [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        for s in range(len(w) - window + 1):
            key = tuple(w[s:s + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if i is not None and first[tuple(w[s:s + window])] < i:
                gone[s:s + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    passages = [sentence(rng, n) for n in (12, 13, 14, 19, 20, 60)]
    texts = [None, "", " \t\n", "one", sentence(rng, 12), sentence(rng, 13)]
    for _ in range(60):
        parts = [sentence(rng, rng.randrange(0, 40))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(passages), sentence(rng, rng.randrange(0, 25))]
        texts.append(rng.choice([" ", "\n\n", " \t "]).join(parts))
        if rng.random() < 0.2:
            texts.append(texts[-1])
        if rng.random() < 0.2:
            w = texts[-1].split()
            if w:
                w[rng.randrange(len(w))] = "changed"
            texts.append("  ".join(w))
    texts.append(" ".join(["again"] * 90))  # a window that repeats inside one document
    texts.append("é b " * 30 + " ".join(["again"] * 40))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts))


def rows_of(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


def test_every_difference_is_in_the_cover():
    assert {(a - b) % anchors.PERIOD for a, b in itertools.product(anchors.COVER, repeat=2)} == set(range(anchors.PERIOD))


@pytest.mark.parametrize("seed,size,window", [(1, 1 << 22, 13), (2, 700, 13), (3, 3000, 8), (4, 2000, 20)])
def test_equals_all_windows(spark, make_docs, seed, size, window):
    rows = corpus(seed)
    got = anchors.remove_repeats(make_docs(rows), window=window, chunk_bytes=size)
    assert rows_of(got) == plain(rows, window)
    assert all(r.n_removed == sum(s.stop - s.start for s in r.removed) for r in got.collect())


def test_null_and_repeated_ids_and_other_columns(spark, make_docs):
    rng = random.Random(5)
    text, other = sentence(rng, 30), sentence(rng, 30)
    rows = [(None, text), (3, text), (3, text), (3, other), (2, other + " " + text), (None, text + " end"), (9, text), (9, "x " + text)]
    got = anchors.remove_repeats(make_docs(rows).withColumnRenamed("lang", "chunk").withColumnRenamed("source", "bucket"), chunk_bytes=300)
    assert rows_of(got) == plain(rows)
    assert anchors.remove_repeats(make_docs([]).limit(0)).collect() == []


def test_a_passage_in_most_documents_and_many_buckets(spark, make_docs):
    rng = random.Random(6)
    passage = sentence(rng, 50)
    rows = [(i, sentence(rng, rng.randrange(30)) + " " + passage + " " + sentence(rng, 20)) for i in range(200)]
    rows += [(200 + i, rows[7][1]) for i in range(120)]
    assert rows_of(anchors.remove_repeats(make_docs(rows), chunk_bytes=2000, bucket_bytes=500)) == plain(rows)


def test_long_texts_go_in_pieces(monkeypatch):
    monkeypatch.setattr(anchors, "PIECE", 50)
    rng = random.Random(7)
    data = anchors.utf8(sentence(rng, 100) + " " * 200 + "w" * 300 + " end")
    cut = anchors.hashed_words(data)
    monkeypatch.setattr(anchors, "PIECE", 1 << 20)
    assert all((a == b).all() for a, b in zip(cut, anchors.hashed_words(data)))
