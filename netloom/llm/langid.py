"""Language identification by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the
sum over all ways to cut it into pieces (forward algorithm); a text scores the sum of the logarithms over its
words. The probabilities come from expectation maximisation over the words of labelled documents.

Texts that are null or hold no letter are `und` with score 0; with no labelled text at all, every text is. Ties go
to the language that sorts first. Very long words are scored whole, with rescaled sums. Repeated rows are
scored alike; other columns are not read.

`TRAIN_DOCS` bounds the documents of a language that the fit reads: about so many are drawn by a hash of the id.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from netloom.lineage import cut
from netloom.llm.common import hash63, map_arrow, sliced, small_batches

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
TRAIN_DOCS, ROUNDS, SMOOTHING, CACHE = 2000, 2, 0.1, 400_000
EDGE = "▁"
_WORDS = re.compile(r"[^\W\d_]+")


def read_pieces(path: str = VOCABULARY) -> list[str]:
    """Plain pieces of a sentencepiece file, lower case, each once."""
    import sentencepiece
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [m.id_to_piece(i).lower() for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
    return sorted({p for p in plain if p})


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters; none if no character is a letter."""
    found = _WORDS.findall((text or "").lower())
    return found if any(any(map(str.isalpha, w)) for w in found) else []


class Lattices:
    """Words of one length with the pieces that fit at each place; a character no piece covers is piece `unknown`."""

    def __init__(self, pieces: list[str]):
        self.ids = {p: i for i, p in enumerate(pieces)}
        self.unknown = len(pieces)
        self.longest = max(map(len, pieces), default=1)

    def by_length(self, found: list[str]):
        """(indexes of words, {(i, j): (words that have a piece there, the pieces)}) for each length."""
        groups: dict[int, list[int]] = {}
        for k, w in enumerate(found):
            groups.setdefault(len(w) + 1, []).append(k)
        get = self.ids.get
        for n, ks in groups.items():
            marked = [EDGE + found[k] for k in ks]
            arcs = {}
            for i in range(n):
                for j in range(i + 1, min(n, i + self.longest) + 1):
                    ids = np.array([get(w[i:j], -1) for w in marked])
                    if j == i + 1:
                        ids[ids < 0] = self.unknown
                    at = np.flatnonzero(ids >= 0)
                    if len(at):
                        arcs[i, j] = at, ids[at]
            yield np.array(ks), n, arcs


def forward(arcs: dict, n: int, count: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all segmentations up to each place, with the logarithm of what was scaled out. p: (pieces, languages)."""
    a = np.zeros((n + 1, count, p.shape[1]))
    scale = np.zeros((n + 1, count, p.shape[1]))
    a[0] = 1
    into: dict[int, list[int]] = {}
    for i, j in arcs:
        into.setdefault(j, []).append(i)
    for j in range(1, n + 1):
        base = scale[j - 1]
        for i in into[j]:
            at, ids = arcs[i, j]
            a[j][at] += a[i][at] * p[ids] * np.exp(scale[i][at] - base[at])
        small = a[j] < 1e-100
        scale[j] = base + np.where(small, np.log(np.maximum(a[j], 1e-300)), 0)
        a[j] = np.where(small, 1, a[j])
    return a, scale


def log_words(found: list[str], lattices: Lattices, p: np.ndarray) -> np.ndarray:
    """Log-probability of each word in each language."""
    out = np.zeros((len(found), p.shape[1]))
    for ks, n, arcs in lattices.by_length(found):
        a, scale = forward(arcs, n, len(ks), p)
        out[ks] = np.log(a[n]) + scale[n]
    return out


def expected_pieces(found: list[str], counts: np.ndarray, lattices: Lattices, p: np.ndarray) -> np.ndarray:
    """Expected uses of every piece in the words, under the probabilities p of one language."""
    out = np.zeros(lattices.unknown + 1)
    for ks, n, arcs in lattices.by_length(found):
        a, scale = forward(arcs, n, len(ks), p[:, None])
        a, scale = a[:, :, 0], scale[:, :, 0]
        b = np.zeros((n + 1, len(ks)))  # chance of being in this place, passed back along the arcs
        b[n] = counts[ks]
        for i, j in sorted(arcs, key=lambda x: -x[1]):
            at, ids = arcs[i, j]
            share = b[j][at] * a[i][at] * p[ids] / a[j][at] * np.exp(scale[i][at] - scale[j][at])
            b[i][at] += share
            np.add.at(out, ids, share)
    return out


class Model:
    def __init__(self, pieces: list[str], languages: list[str], p: np.ndarray):
        self.pieces, self.languages, self.p = pieces, languages, p


def fit(docs: DataFrame, pieces: list[str] | None = None, train_docs: int = TRAIN_DOCS, rounds: int = ROUNDS) -> Model:
    """Probabilities from rows (doc_id, text, lang); the driver gets a count for each piece and language."""
    spark = docs.sparkSession
    small_batches(spark)
    pieces = read_pieces() if pieces is None else pieces
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model(pieces, [], np.zeros((len(pieces) + 1, 0)))
    drawn = F.lit(False)
    for lang, n in sizes.items():
        drawn = drawn | ((F.col("lang") == lang) & (hash63(F.col("doc_id"), "lang") % 1_000_000 < min(1_000_000, 1_000_000 * train_docs // n)))

    def count(batches):
        seen: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b.lang, b.text):
                seen.setdefault(lang, Counter()).update(words(text))
        for lang, c in seen.items():
            yield pd.DataFrame({"lang": lang, "word": list(c.keys()), "n": list(c.values())})

    counted = cut(labelled.where(drawn).mapInPandas(count, "lang string, word string, n bigint")
                  .groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    lattices = Lattices(pieces)
    p = np.full((len(pieces) + 1, len(languages)), 1e-4)
    for _ in range(rounds):
        held = spark.sparkContext.broadcast((lattices, p, languages))

        def expect(batches):
            lattices, p, languages = held.value
            for b in batches:
                for k, lang in enumerate(languages):
                    own = b[b.lang == lang]
                    e = expected_pieces(list(own.word), own.n.to_numpy(float), lattices, p[:, k])
                    at = np.flatnonzero(e)
                    yield pd.DataFrame({"k": k, "piece": at, "n": e[at]})

        rows = counted.mapInPandas(expect, "k int, piece int, n double").groupBy("k", "piece").agg(F.sum("n").alias("n")).toPandas()
        e = np.zeros_like(p)
        e[rows.piece, rows.k] = rows.n
        p = (e + SMOOTHING) / (e + SMOOTHING).sum(0)
    return Model(pieces, languages, p)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The given columns, lang_pred and score (posterior of the language, all languages alike before)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema.fields)

    def score(batches):
        import pyarrow as pa
        m = held.value
        lattices, index, table = Lattices(m.pieces), {}, np.zeros((0, len(m.languages)))
        for b in sliced(batches):
            if len(index) > CACHE:
                index, table = {}, table[:0]
            found = [words(t) if m.languages else [] for t in b.column(text).to_pylist()]
            fresh = list({w for ws in found for w in ws}.difference(index))
            index.update(zip(fresh, range(len(index), len(index) + len(fresh))))
            for i in range(0, len(fresh), 20_000):
                table = np.concatenate([table, log_words(fresh[i:i + 20_000], lattices, m.p)])
            langs, scores = [], []
            for ws in found:
                if not ws:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                total = table[[index[w] for w in ws]].sum(0)
                best = int(total.argmax())
                langs.append(m.languages[best])
                scores.append(float(1 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             [*names, "lang_pred", "score"])

    return map_arrow(docs.select(*names), score, f"{schema}, lang_pred string, score double")


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from documents that are not held out."""
    model = fit(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
