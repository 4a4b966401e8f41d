import math

import numpy as np
from pyspark.sql import functions as F

from netloom.llm import langid


def all_cuts(w, ids, p, unknown):
    if not w:
        return 1.0
    return sum((p[ids[w[:j]]] if w[:j] in ids else p[unknown]) * all_cuts(w[j:], ids, p, unknown) for j in range(1, len(w) + 1) if w[:j] in ids or j == 1)


def test_forward_sums_every_segmentation():
    pieces = sorted({"▁", "a", "b", "ab", "▁a", "ba", "aba", "▁ab"})
    p = np.random.default_rng(0).random((len(pieces) + 1, 2))
    lattices = langid.Lattices(pieces)
    found = ["abab", "b", "abcab", "aaaa", "ab"]
    got = langid.log_words(found, lattices, p)
    for w, row in zip(found, got):
        for k in range(2):
            assert math.isclose(row[k], math.log(all_cuts("▁" + w, lattices.ids, p[:, k], lattices.unknown)), rel_tol=1e-9)
    assert np.isfinite(langid.log_words(["ab" * 5000], lattices, p * 1e-5)).all()
    e = langid.expected_pieces(["abab", "b"], np.array([2.0, 1.0]), lattices, p[:, 0])
    lengths = np.array([*map(len, pieces), 1])
    assert math.isclose(float((e * lengths).sum()), 2 * 5 + 2)  # expected pieces cover every character


def test_predictions(spark):
    words = {"en": "the of and that with this from have were which", "de": "der und nicht auch werden eine über können für zwischen"}
    rows = [(i, " ".join(words[lang].split()[(i * k) % 10] for k in range(1, 9)), lang, "x") for i in range(120) for lang in [("en", "de")[i % 2]]]
    rows += [(200, None, "en", "x"), (201, "123 ... 45²", "de", "x"), (202, "", None, "x"), (203, "the " * 30_000, None, "x"), (None, "und der", None, "x"), (1, rows[1][1], "de", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string")
    out = langid.identify(docs).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert all(by[i].lang_pred == lang for i, _, lang, _ in rows[:120])
    assert [(by[i].lang_pred, by[i].score) for i in (200, 201, 202)] == [("und", 0.0)] * 3
    assert by[203].lang_pred == "en" and by[None].lang_pred == "de" and all(0 <= r.score <= 1 for r in out)
    assert langid.identify(docs.limit(0)).collect() == []
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.98 * len(out) > 20
