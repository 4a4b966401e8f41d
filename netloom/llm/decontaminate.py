"""Benchmark decontamination with an FM-index for every training shard.

A task turns its documents into shards of about a megabyte. The words of a shard, as numbers of the test
vocabulary, get a suffix array, a Burrows-Wheeler transform held in a wavelet matrix and sampled suffix
positions. All windows of the test items are searched backwards at once, their occurrences located, and the
covered words of each document merged into spans. Words that no test item contains share one symbol, and a
run of them is kept once: no window can hold them. Documents are never shuffled.

The test set is read in blocks of bounded size; with several blocks, the documents pass through one search for
each and the spans and items are merged. A document longer than a shard is searched in pieces that overlap by a
window. Null texts and items have no words; an empty test set finds nothing; repeated items with one id count
once; items with a null id are named "null"; other columns of the documents are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from netloom.llm.common import LOWER, map_arrow, runs, sha, sliced, utf8, word_hashes

WINDOW, SHARD_BYTES, BLOCK_BYTES, SAMPLE = 10, 1_000_000, 8 << 20, 16
FOUND = "_found"
FOUND_TYPE = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField(x, T.LongType()) for x in ("word_start", "word_end", "byte_start", "byte_end")]))),
    T.StructField("items", T.ArrayType(T.StringType()))])

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[48:58] = _WORD_BYTE[97:123] = _WORD_BYTE[128:] = True


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the lower-cased words of UTF-8 bytes."""
    low = LOWER[data]
    return word_hashes(low, _WORD_BYTE[low])


def suffix_array(s: np.ndarray, bits: int) -> np.ndarray:
    """Positions in the order of their suffixes; `s` ends with its only 0. Ranks double, and only tied suffixes are sorted again."""
    n, k = len(s), max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for j in range(k):
        key <<= bits
        if j < n:
            key[:n - j] |= s[j:]
    order = np.argsort(key)
    first = np.concatenate([[True], np.diff(key[order]) != 0])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    h = k
    while True:
        tied = np.flatnonzero(~(first & np.concatenate([first[1:], [True]])))
        if not len(tied):
            return order
        p = order[tied]
        both = rank[p] * n + rank[p + h]  # a tied suffix is longer than h: the closing 0 stands once
        o = np.argsort(both)
        p, both = p[o], both[o]
        new = np.concatenate([[True], np.diff(both) != 0])
        order[tied], first[tied] = p, new
        rank[p] = tied[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        h *= 2


class WaveletMatrix:
    """Ranks of symbols in a sequence, a packed bit vector with counts for each bit of the symbols."""

    def __init__(self, s: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        for b in reversed(range(bits)):
            bit = ((s >> b) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view(np.uint64)
            counts = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            self.levels.append((packed, counts, len(s) - int(bit.sum())))
            s = np.concatenate([s[~bit], s[bit]])

    @staticmethod
    def _ones(level, at: np.ndarray) -> np.ndarray:
        packed, counts, _ = level
        w = at >> 6
        return counts[w] + np.bitwise_count(packed[w] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))

    def follow(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Place below all levels; minus that of `at` = 0, the rank of the symbol before `at`."""
        for i, level in enumerate(self.levels):
            one, ones = ((symbol >> (self.bits - 1 - i)) & 1).astype(bool), self._ones(level, at)
            at = np.where(one, level[2] + ones, at - ones)
        return at

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol at a place, and the place below all levels."""
        symbol = np.zeros(len(at), np.int64)
        for level in self.levels:
            one = ((level[0][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            ones = self._ones(level, at)
            at = np.where(one, level[2] + ones, at - ones)
            symbol = symbol * 2 + one
        return symbol, at


class FMIndex:
    """Counts and places of patterns in a sequence of symbols 1 .. symbols - 1."""

    def __init__(self, s: np.ndarray, symbols: int, sample: int = SAMPLE):
        s = np.concatenate([s.astype(np.int64), [0]])
        bits = max(1, int(symbols - 1).bit_length())
        sa = suffix_array(s, bits)
        self.n, self.wavelet = len(s), WaveletMatrix(s[sa - 1], bits)
        every = np.arange(symbols)
        smaller = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=symbols))[:-1]])
        self.start = smaller - self.wavelet.follow(every, np.zeros(symbols, np.int64))
        self.sampled = sa % sample == 0
        self.sample_index = np.cumsum(self.sampled) - 1
        self.samples = sa[self.sampled]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of each pattern (right-aligned in its row), by backward search."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for step in range(patterns.shape[1]):
            on = np.flatnonzero((low < high) & (step < lengths))
            if not len(on):
                break
            c = patterns[on, patterns.shape[1] - 1 - step]
            low[on] = self.start[c] + self.wavelet.follow(c, low[on])
            high[on] = self.start[c] + self.wavelet.follow(c, high[on])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of rows: steps backwards in the text until a sampled position."""
        out, on, at, steps = np.zeros(len(rows), np.int64), np.arange(len(rows)), rows, 0
        while len(on):
            hit = self.sampled[at]
            out[on[hit]] = self.samples[self.sample_index[at[hit]]] + steps
            on, at = on[~hit], at[~hit]
            if len(on):
                c, below = self.wavelet.access(at)
                at = self.start[c] + below
                steps += 1
        return out


class TestSet:
    """Windows of test items as patterns over their own vocabulary."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.window, tokens, owners = window, [], []
        for name, text in items:
            h = words(utf8(text))[0]
            m = min(window, len(h))
            for i in range(len(h) - m + 1 if m else 0):
                tokens.append(h[i:i + m])
                owners.append(name)
        self.vocabulary = np.unique(np.concatenate(tokens)) if tokens else np.zeros(0, np.uint64)
        by_window: dict[bytes, set[str]] = {}
        for t, name in zip(tokens, owners):
            by_window.setdefault(t.tobytes(), set()).add(name)
        self.patterns, self.lengths = np.zeros((len(by_window), window), np.int64), np.zeros(len(by_window), np.int64)
        self.items = [sorted(x) for x in by_window.values()]
        for row, raw in enumerate(by_window):
            t = np.frombuffer(raw, np.uint64)
            self.patterns[row, window - len(t):] = np.searchsorted(self.vocabulary, t) + 2
            self.lengths[row] = len(t)

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """2 and more: a word of the vocabulary; 1: any other."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 2, 1)


def search_shard(texts: list[np.ndarray], tests: TestSet) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]]:
    """For each text of one shard: word starts and ends (bytes), and hits (first word, past last, pattern)."""
    joined = np.concatenate([x for t in texts for x in (t, np.zeros(1, np.uint8))])
    hashes, start, end = words(joined)
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    owner = np.searchsorted(text_ends, start, "right")
    found: list[np.ndarray] = [np.zeros((0, 3), np.int64)] * len(texts)
    first_word = np.searchsorted(owner, np.arange(len(texts) + 1))
    if len(hashes) and len(tests.vocabulary):
        # a symbol 1 stands between texts
        s = np.ones(len(hashes) + len(texts), np.int64)
        s[np.arange(len(hashes)) + owner] = tests.symbols(hashes)
        kept = np.flatnonzero((s != 1) | np.concatenate([[True], s[:-1] != 1]))
        word_at = np.full(len(s), -1)
        word_at[np.arange(len(hashes)) + owner] = np.arange(len(hashes))
        index = FMIndex(s[kept], len(tests.vocabulary) + 2)
        low, high = index.search(tests.patterns, tests.lengths)
        n = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(n)), n)
        rows = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        first = word_at[kept[index.locate(rows)]]
        order = np.argsort(first)
        first, which = first[order], which[order]
        bounds = np.searchsorted(first, first_word)
        for i in range(len(texts)):
            a, b = bounds[i], bounds[i + 1]
            if b > a:
                f = first[a:b] - first_word[i]
                found[i] = np.stack([f, f + tests.lengths[which[a:b]], which[a:b]], 1)
    text_starts = text_ends - np.array([len(t) + 1 for t in texts])
    return [(start[a:b] - o, end[a:b] - o, found[i])
            for i, (a, b, o) in enumerate(zip(first_word[:-1], first_word[1:], text_starts))]


def _pieces(data: np.ndarray, size: int):
    """Stretches of a long text, one behind the other, that end between words, as long as `size` allows."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and _WORD_BYTE[LOWER[data[end - 1]]]:
            gap = np.flatnonzero(~_WORD_BYTE[LOWER[data[end:end + size]]])
            end = end + int(gap[0]) + 1 if len(gap) else min(end + size, len(data))
        yield at, end
        at = end


def find(texts: list[str | None], tests: TestSet, shard_bytes: int = SHARD_BYTES) -> list[tuple[int, list[tuple[int, int, int, int]], list[str]]]:
    """Words, merged spans (words and bytes) and items for each text, shard by shard."""
    out: list = [None] * len(texts)

    def merged(n_words, hits, starts, ends):
        if not len(hits):
            return n_words, [], []
        mark = np.zeros(n_words + 1, np.int64)
        np.add.at(mark, hits[:, 0], 1)
        np.add.at(mark, hits[:, 1], -1)
        a, b = runs(np.cumsum(mark[:-1]) > 0)
        names = set().union(*(tests.items[w] for w in np.unique(hits[:, 2])))
        return n_words, [(int(x), int(y), int(starts[x]), int(ends[y - 1])) for x, y in zip(a, b)], sorted(names)

    def flush():
        for (i, _), (start, end, hits) in zip(held, search_shard([d for _, d in held], tests)):
            out[i] = merged(len(start), hits, start, end)

    held, size = [], 0
    for i, t in enumerate(texts):
        data = utf8(t)
        if len(data) > shard_bytes:
            out[i] = _find_long(data, tests, shard_bytes, merged)
            continue
        held.append((i, data))
        size += len(data)
        if size >= shard_bytes:
            flush()
            held, size = [], 0
    if held:
        flush()
    return out


def _find_long(data, tests, shard_bytes, merged):
    """Like `find` for one long text. The last words of a piece, as many as a window less one, stand before the next
    piece, however far apart the two are."""
    starts, ends, hits, n = [], [], [np.zeros((0, 3), np.int64)], 0
    carried: list[bytes] = []
    for a, b in _pieces(data, shard_bytes):
        before = np.frombuffer(b"".join(w + b" " for w in carried), np.uint8)
        piece = np.concatenate([before, data[a:b]])
        start, end, found = search_shard([piece], tests)[0]
        k = len(carried)
        hits.append(found + np.array([n - k, n - k, 0]))
        starts.append(start[k:] - len(before) + a)
        ends.append(end[k:] - len(before) + a)
        n += len(start) - k
        if tests.window > 1:
            carried = [piece[x:y].tobytes() for x, y in zip(start[1 - tests.window:], end[1 - tests.window:])]
    return merged(n, np.concatenate(hits), np.concatenate(starts), np.concatenate(ends))


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
         shard_bytes: int = SHARD_BYTES, cut_out: bool = False) -> DataFrame:
    """The documents with a column `_found`: n_words, spans and items of `benchmark` (item_id, text). With `cut_out` they
    come without that column and without the spans in their texts."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    names = [c for c in docs.columns if c != FOUND]
    out = docs.select(*names)
    plain = out.schema
    schema = T.StructType([*plain.fields, T.StructField(FOUND, FOUND_TYPE)])
    for b in range(blocks):
        block = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        tests = spark.sparkContext.broadcast(TestSet([(r.item_id, r.text) for r in block.collect()], window))
        last = cut_out and b == blocks - 1
        out = map_arrow(out, _searcher(tests, text, shard_bytes, last), plain if last else schema)
    return out


def _searcher(tests, text: str, shard_bytes: int, cut_out: bool):
    def search(batches):
        from pyspark.sql.pandas.types import to_arrow_type
        kind = to_arrow_type(FOUND_TYPE)
        for batch in sliced(batches, 512):
            earlier = batch.column(FOUND).to_pylist() if FOUND in batch.schema.names else [None] * batch.num_rows
            texts, rows = batch.column(text).to_pylist(), []
            for (n, spans, items), old in zip(find(texts, tests.value, shard_bytes), earlier):
                if old:
                    spans = _union(spans + [tuple(s.values()) for s in old["spans"]])
                    items = sorted({*items, *old["items"]})
                rows.append((n, spans, items))
            kept = {c: batch.column(c) for c in batch.schema.names if c != FOUND}
            if cut_out:
                yield _without(kept, text, texts, rows)
                continue
            found = [{"n_words": n, "items": items, "spans": [dict(zip(("word_start", "word_end", "byte_start", "byte_end"), s)) for s in spans]} for n, spans, items in rows]
            yield pa.RecordBatch.from_arrays([*kept.values(), pa.array(found, kind)], [*kept, FOUND])
    return search


def _without(columns: dict, text: str, texts: list, rows: list) -> pa.RecordBatch:
    """Rows with their spans cut out of the text and n_chars to match; those left without a word go."""
    sizes = columns["n_chars"].to_pylist() if "n_chars" in columns else [None] * len(texts)
    keep = []
    for i, (n_words, spans, _) in enumerate(rows):
        keep.append(not spans or sum(s[1] - s[0] for s in spans) < n_words)
        if spans:
            data, at, parts = texts[i].encode("utf-8", "surrogatepass"), 0, []
            for s in spans:
                parts.append(data[at:s[2]])
                at = s[3]
            texts[i] = b"".join([*parts, data[at:]]).decode("utf-8", "surrogatepass")
            sizes[i] = len(texts[i])
    new = {text: texts, "n_chars": sizes}
    arrays = [pa.array(new[c], x.type) if c in new else x for c, x in columns.items()]
    return pa.RecordBatch.from_arrays(arrays, list(columns)).filter(pa.array(keep, pa.bool_()))


def _union(spans: list[tuple]) -> list[tuple]:
    out: list[tuple] = []
    for s in sorted(spans):
        if out and s[0] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s[1]), out[-1][2], max(out[-1][3], s[3]))
        else:
            out.append(s)
    return out


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Counts of words, of words under a window, and of the items found, for each document."""
    found = mark(docs.select("doc_id", "text"), benchmark, **options)
    hit = F.aggregate(f"{FOUND}.spans", F.lit(0).cast("bigint"), lambda n, s: n + s["word_end"] - s["word_start"])
    items = F.col(f"{FOUND}.items")
    return found.select("doc_id", F.col(f"{FOUND}.n_words").alias("n_words"), hit.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"),
                        F.sha2(F.concat_ws(",", F.array_sort(items)), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def without_spans(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents with every span cut out of their texts; those left without a word go."""
    return mark(docs, benchmark, cut_out=True, **options)


SQL = r"""
WITH low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS win
       FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT item_id, w, least(len(w), 10) AS m FROM item WHERE len(w) > 0))),
lens AS (SELECT DISTINCT m FROM iw),
word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM low),
around AS (SELECT doc_id, pos, list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS l FROM word),
occ AS (SELECT a.doc_id, a.pos, iw.m, iw.item_id FROM (SELECT doc_id, pos, m, array_to_string(l[1:m], ' ') AS win FROM around, lens WHERE len(l) >= m) a
        JOIN iw ON iw.m = a.m AND iw.win = a.win),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + m)) AS p FROM occ) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM occ) GROUP BY doc_id)
SELECT low.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""
