import hashlib
import random
import re

import numpy as np

from netloom.llm import decontaminate as d
from tests.llm.conftest import sentence

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def plain(docs, items):
    out = {}
    for i, t in docs:
        w, hit, names = WORD.findall(lower(t)), set(), set()
        for name, item in items:
            v = WORD.findall(lower(item))
            m = min(10, len(v))
            windows = {tuple(v[k:k + m]) for k in range(len(v) - m + 1)} if m else set()
            for k in range(len(w) - m + 1):
                if tuple(w[k:k + m]) in windows:
                    hit.update(range(k, k + m))
                    names.add(str(name))
        out[i] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))
    return out


def test_index_finds_every_pattern():
    rng = np.random.default_rng(1)
    s = rng.integers(1, 4, 3000)
    index = d.FMIndex(s, 4, sample=5)
    patterns = rng.integers(1, 4, (50, 6))
    lengths = rng.integers(1, 7, 50)
    low, high = index.search(patterns, lengths)
    for p, n, a, b in zip(patterns, lengths, low, high):
        want = [i for i in range(len(s) - n + 1) if (s[i:i + n] == p[6 - n:]).all()]
        assert sorted(index.locate(np.arange(a, max(a, b)))) == want


def corpus():
    rng = random.Random(4)
    items = [(k, sentence(rng, rng.choice([3, 9, 10, 14, 40]))) for k in range(12)] + [(3, sentence(rng, 20)), (50, None), (51, "!!")]
    docs = []
    for i in range(80):
        t = sentence(rng, rng.randrange(120))
        if i % 3 == 0:
            name, item = rng.choice(items[:13])
            t = f"{t} -- {item.upper().replace(' ', ', ')}! {sentence(rng, 5)}"
        docs.append((i, t))
    return docs + [(90, None), (91, ""), (92, "é" * 10), (93, docs[3][1]), (94, items[1][1] + " " + items[1][1])], items


def run(spark, docs, items, **options):
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id bigint, text string, _found int")
    tests = spark.createDataFrame(items, "item_id bigint, text string")
    return {r.doc_id: tuple(r)[1:] for r in d.report(df, tests, **options).collect()}


def test_equals_plain_version(spark):
    docs, items = corpus()
    want = plain(docs, items)
    assert sum(w[4] for w in want.values()) > 20
    assert run(spark, docs, items) == want
    assert run(spark, docs, items, shard_bytes=200) == want  # most documents are searched in pieces
    assert run(spark, docs, items, block_bytes=300) == want  # the test set in several blocks
    assert run(spark, docs, [(1, None)]) == plain(docs, [])
    assert run(spark, docs[:0] or [], items) == {}


def test_spans_are_cut_out(spark, make_docs):
    rng = random.Random(2)
    item, rest = sentence(rng, 20), "Some other Words,"
    docs = make_docs([f"{rest} {item}. End", item, "clean text", None, ""])
    out = d.without_spans(docs, spark.createDataFrame([(1, item)], "item_id bigint, text string"))
    assert out.columns == docs.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {0: (f"{rest} . End", len(rest) + 6), 2: ("clean text", 10), 3: (None, 0), 4: ("", 0)}


def test_windows_across_long_gaps_in_long_texts():
    rng = random.Random(8)
    item = sentence(rng, 12).split()
    tests = d.TestSet([("a", " ".join(item)), ("b", "short item")], 10)
    texts = [" ".join(item[:5]) + " " * 2_100 + " ".join(item[5:]), ("-" * 700).join(item), sentence(rng, 90) + " short" + "." * 3000 + "item " + sentence(rng, 30),
             item[0] + " " * 900 + "x" * 4000 + " " * 900 + " ".join(item[1:]), " ".join(item[:6] + ["y" * 2000] + item[6:]), " " * 5000]
    assert d.find(texts, tests, shard_bytes=500) == d.find(texts, tests, shard_bytes=1 << 20)
    assert [sum(b - a for a, b, *_ in spans) for _, spans, _ in d.find(texts, tests, shard_bytes=500)] == [12, 12, 2, 11, 0, 0]
