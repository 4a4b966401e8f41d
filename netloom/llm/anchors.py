"""Repeated windows of words by difference-cover anchors.

Positions of a document count modulo PERIOD. Only windows of ANCHOR words that begin at a position of COVER are
hashed: every difference modulo PERIOD is a difference of two places of COVER, so of any two equal windows of WINDOW
words, wherever they begin, one offset below PERIOD puts both on the cover, and the ANCHOR words there are equal.

1. Texts go into chunks of CHUNK bytes, written once, compressed.
2. Every chunk sends each of its anchors once, packed by bucket; a bucket answers with one bit for each: does it occur
   again? The hash of all words of a document travels the same way and is answered with the first document.
3. An anchor that occurs again extends: every window that holds it is hashed whole, once a chunk, with the smallest
   document of the chunk that has it. A document all of whose words stand in an earlier one needs no windows.
4. A bucket answers with the smallest document of each window; the chunk marks the words of later documents.

Hot passages cost one entry for each chunk, and no pairs are formed. Equality is up to collisions of 64-bit hashes.

Null and empty texts have no words. A null doc_id is neither smaller nor larger than another: nothing is removed from
it, and it removes nothing. Every row gives one row: of repeated ids, none is smaller than the other. Other columns are
ignored. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from netloom.lineage import cut, cut_counting, drop_table
from netloom.llm.common import map_arrow, mixed, not_space, prefix_hash, runs, stretch_hash, tasks_of, utf8, word_hashes

WINDOW, PERIOD, COVER = 13, 7, (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
CHUNK, PIECE, BUCKET_BYTES = 4 << 20, 1 << 20, 24 << 20
LOW = np.uint64((1 << 47) - 1)
RESULT = "doc_id bigint, n_words bigint, n_removed bigint, removed array<struct<start:bigint,stop:bigint>>, kept_sha256 string"


def hashed_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of long bytes, a piece at a time, cut between words."""
    if len(data) <= PIECE:
        return word_hashes(data, not_space(data))
    gaps, parts, at = np.flatnonzero(~not_space(data)), [], 0
    while at < len(data):
        i = np.searchsorted(gaps, at + PIECE)
        end = int(gaps[i]) + 1 if i < len(gaps) else len(data)
        h, s, e = word_hashes(data[at:end], not_space(data[at:end]))
        parts.append((h, s + at, e + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts))


class Chunk:
    """Documents of one chunk with the hashes of their words."""

    def __init__(self, ids: list, texts: list[bytes]):
        self.ids, self.texts = ids, texts
        self.known = np.array([i is not None for i in ids], bool)
        self.doc = np.array([0 if i is None else i for i in ids], np.int64)
        joined = np.frombuffer(b" ".join(texts), np.uint8)
        self.begin = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1].astype(np.int64)
        words, self.start, self.stop = hashed_words(joined)
        self.data, self.prefix = joined, prefix_hash(words)
        self.first = np.searchsorted(self.start, self.begin)  # first word of each document
        self.n = np.diff(np.append(self.first, len(words)))
        self.owner = np.repeat(np.arange(len(ids)), self.n)
        self.place = np.arange(len(words)) - np.repeat(self.first, self.n)

    def digest(self) -> np.ndarray:
        """Hash of all words of each document."""
        return stretch_hash(self.prefix, self.first, self.first + self.n)

    def starts(self, length: int) -> np.ndarray:
        """Words at which `length` words of one document with an id begin."""
        fits = self.place + length <= self.n[self.owner]
        return np.flatnonzero(fits & self.known[self.owner])

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the anchors."""
        at = self.starts(window - PERIOD + 1)
        at = at[np.isin(self.place[at] % PERIOD, COVER)]
        return at, stretch_hash(self.prefix, at, at + window - PERIOD + 1)

    def windows(self, at: np.ndarray, window: int) -> np.ndarray:
        return stretch_hash(self.prefix, at, at + window) & ~np.uint64(1)

    def of(self, keep: np.ndarray) -> tuple[list, list[bytes]]:
        on = np.flatnonzero(keep)
        return [self.ids[i] for i in on], [self.texts[i] for i in on]

    def row(self, i: int, gone: np.ndarray) -> tuple:
        """Result of one document; `gone` marks its words."""
        x, y = self.first[i], self.first[i] + self.n[i]
        if gone.any():
            kept = b" ".join(self.data[s:e].tobytes() for s, e in zip(self.start[x:y][~gone], self.stop[x:y][~gone]))
        else:
            kept = b" ".join(self.texts[i].split())
        spans = [{"start": int(a), "stop": int(b)} for a, b in zip(*runs(gone))]
        return self.ids[i], int(self.n[i]), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()


def frozen(ids: list, texts: list[bytes]) -> bytes:
    """Documents as compressed bytes."""
    head = np.array([len(ids)], np.int64).tobytes()
    numbers = np.array([0 if i is None else i for i in ids], np.int64).tobytes() + np.array([i is not None for i in ids], np.uint8).tobytes()
    raw = head + numbers + np.array([len(t) for t in texts], np.int64).tobytes() + b"".join(texts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def thawed(blob: bytes) -> tuple[list, list[bytes]]:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    ids, known = np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.uint8, n, 8 + 8 * n)
    ends = np.cumsum(np.frombuffer(raw, np.int64, n, 8 + 9 * n)) + 8 + 17 * n
    begins = np.concatenate([[8 + 17 * n], ends[:-1]]).astype(np.int64)
    return [int(i) if k else None for i, k in zip(ids, known)], [raw[a:b] for a, b in zip(begins, ends)]


def chunks(docs: DataFrame, size: int) -> tuple[DataFrame, int]:
    """chunk, raw (bytes of text), blob, written; and the bytes of all texts."""
    def run(batches):
        from pyspark import TaskContext
        number, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([held], pa.int64()), pa.array([frozen(ids, texts)], pa.binary())], ["chunk", "raw", "blob"])

        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                t = (t or "").encode("utf-8", "surrogatepass")
                if ids and held + len(t) > size:
                    yield flush()
                    number, ids, texts, held = number + 1, [], [], 0
                ids.append(i)
                texts.append(t)
                held += len(t)
        if ids:
            yield flush()

    rows = map_arrow(docs.select(F.col("doc_id").cast("bigint"), "text"), run, "chunk bigint, raw bigint, blob binary")
    table, seen = cut_counting(rows, "chunks", raw=F.sum("raw"))
    return table, seen["raw"] or 0


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((mixed(h) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def _groups(bucket: np.ndarray, order: np.ndarray):
    """(bucket, index range into `order`) for each used bucket."""
    used, begin = np.unique(bucket[order], return_index=True)
    return zip(used.tolist(), begin.tolist(), [*begin[1:].tolist(), len(order)])


def _six(x: np.ndarray) -> bytes:
    """The low six bytes of each value."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(b) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view(np.uint64)


def sent_anchors(c: Chunk, window: int, buckets: int):
    """Per bucket: the distinct anchors (47 bits, then whether two documents of the chunk have it), for each start its
    place among them, and the digests of documents with their smallest id."""
    at, h = c.anchors(window)
    distinct, inverse = np.unique(h, return_inverse=True)
    owner = c.owner[at]
    low, high = np.full(len(distinct), len(c.ids)), np.full(len(distinct), -1)
    np.minimum.at(low, inverse, owner)
    np.maximum.at(high, inverse, owner)
    entry = ((distinct & LOW) << np.uint64(1)) | (low < high).astype(np.uint64)
    bucket = _bucket(distinct, buckets)
    order = np.lexsort((distinct, bucket))
    whole = np.flatnonzero(c.known & (c.n >= window))
    digest = c.digest()[whole]
    return at, inverse, entry, bucket, order, whole, digest, _bucket(digest, buckets)


def _least(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the least value of each, and the place of each key among them."""
    order = np.lexsort((values, keys))
    k = keys[order]
    new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
    place = np.empty(len(k), np.int64)
    place[order] = np.cumsum(new) - 1
    return k[new], values[order][new], place


ENTRIES = "bucket int, chunk bigint, anchors binary, digests binary, docs binary"


def entries(table: DataFrame, window: int, buckets: int) -> DataFrame:
    def run(batches):
        for b in batches:
            for number, blob in zip(b.column("chunk").to_pylist(), b.column("blob")):
                c = Chunk(*thawed(blob.as_py()))
                _, _, entry, bucket, order, whole, digest, home = sent_anchors(c, window, buckets)
                groups = {k: order[x:y] for k, x, y in _groups(bucket, order)}
                homes = {k: o for k, x, y in _groups(home, np.argsort(home, kind="stable")) for o in [np.argsort(home, kind="stable")[x:y]]}
                rows = []
                for k in sorted({*groups, *homes}):
                    o = homes.get(k, np.zeros(0, np.int64))
                    d, first, _ = _least(digest[o], c.doc[whole[o]])
                    rows.append((k, number, _six(entry[groups[k]]) if k in groups else b"", d.tobytes(), first.tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))],
                                                     ["bucket", "chunk", "anchors", "digests", "docs"])

    return table.select("chunk", "blob").mapInArrow(run, ENTRIES)


def answered_anchors(rows: DataFrame, buckets: int) -> DataFrame:
    """chunk, bucket, bits (does the anchor occur again), digests, docs: the first documents of digests with two at least."""
    def run(batches):
        names, held, keys, docs = [], [], [], []
        for b in batches:
            for k, c, a, d, f in zip(b.column("bucket").to_pylist(), b.column("chunk").to_pylist(), b.column("anchors"), b.column("digests"), b.column("docs")):
                names.append((k, c))
                held.append(_from_six(a.as_buffer()))
                keys.append(np.frombuffer(d.as_buffer(), np.uint64))
                docs.append(np.frombuffer(f.as_buffer(), np.int64))
        if not names:
            return
        # a task may hold several buckets; an anchor of one meets another's only by an accident, which removes nothing
        size = np.array([len(x) for x in held])
        everything = np.concatenate(held)
        order = np.argsort(everything >> np.uint64(1), kind="stable")
        v = everything[order]
        same = (v[1:] >> np.uint64(1)) == (v[:-1] >> np.uint64(1))
        again = (v & np.uint64(1)).astype(bool)
        again[1:] |= same
        again[:-1] |= same
        bits = np.zeros(len(v), bool)
        bits[order] = again
        found = np.split(bits, np.cumsum(size)[:-1])
        _, first, place = _least(np.concatenate(keys), np.concatenate(docs))
        ends = np.cumsum([len(x) for x in keys])
        for i, ((k, c), own) in enumerate(zip(names, found)):
            p = place[ends[i] - len(keys[i]):ends[i]]
            # the smallest document of the chunk is answered only if an earlier one exists; equal ones in the chunk know
            far = first[p] < docs[i]
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([c], pa.int64()), pa.array([np.packbits(own).tobytes()], pa.binary()),
                                              pa.array([keys[i][far].tobytes()], pa.binary()), pa.array([first[p][far].tobytes()], pa.binary())],
                                             ["bucket", "chunk", "bits", "digests", "docs"])

    return rows.repartitionById(buckets, F.col("bucket")).mapInArrow(run, "bucket int, chunk bigint, bits binary, digests binary, docs binary")


def _by_chunk(table: DataFrame, answers: DataFrame, tasks: int, work, schema: str) -> DataFrame:
    """Call work(number, blob, answers of the chunk) with the answers streamed before the blob of their chunk."""
    names = [n for n in answers.columns if n != "chunk"]
    left = table.select("chunk", F.lit(1).alias("is_text"), "blob")
    right = answers.withColumn("is_text", F.lit(0))
    both = left.unionByName(right, allowMissingColumns=True).repartition(tasks, "chunk").sortWithinPartitions("chunk", "is_text", *(n for n in names if n == "bucket"))

    def run(batches):
        number, held = None, []
        for b in batches:
            for i, (c, text) in enumerate(zip(b.column("chunk").to_pylist(), b.column("is_text").to_pylist())):
                if c != number:
                    number, held = c, []
                if text:
                    yield from work(c, b.column("blob")[i].as_py(), held)
                    held = []
                else:
                    held.append(tuple(b.column(n)[i].as_py() for n in names))

    return map_arrow(both, run, schema)


EXTENDED = f"{RESULT}, kind int, chunk bigint, bucket int, windows binary, docs binary, blob binary"
_RESULT_NAMES = ["doc_id", "n_words", "n_removed", "removed", "kept_sha256"]
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
_RESULT_TYPES = [pa.int64(), pa.int64(), pa.int64(), _SPANS, pa.string()]
_EXTRA = dict(kind=pa.int32(), chunk=pa.int64(), bucket=pa.int32(), windows=pa.binary(), docs=pa.binary(), blob=pa.binary())


def _result_batch(rows: list[tuple], kind: int | None = None) -> pa.RecordBatch:
    arrays = [pa.array(list(x), t) for x, t in zip(zip(*rows), _RESULT_TYPES)]
    if kind is None:
        return pa.RecordBatch.from_arrays(arrays, _RESULT_NAMES)
    n = len(rows)
    extra = [pa.array([kind] * n, pa.int32()), *(pa.nulls(n, t) for k, t in _EXTRA.items() if k != "kind")]
    return pa.RecordBatch.from_arrays(arrays + extra, [*_RESULT_NAMES, *_EXTRA])


def _extra_batch(kind: int, chunk: int, rows: list[tuple]) -> pa.RecordBatch:
    """rows: bucket, windows, docs, blob."""
    n, columns = len(rows), list(zip(*rows))
    arrays = [pa.nulls(n, t) for t in _RESULT_TYPES] + [pa.array([kind] * n, pa.int32()), pa.array([chunk] * n, pa.int64())]
    arrays += [pa.array(list(x), _EXTRA[k]) for k, x in zip(("bucket", "windows", "docs", "blob"), columns)]
    return pa.RecordBatch.from_arrays(arrays, [*_RESULT_NAMES, *_EXTRA])


def extended(table: DataFrame, answers: DataFrame, window: int, buckets: int, tasks: int) -> DataFrame:
    """Kind 0: results of documents that are settled. Kind 1: packed windows with their smallest document. Kind 2: the
    other documents of the chunk."""
    def work(number, blob, held):
        c = Chunk(*thawed(blob))
        at, inverse, _, bucket, order, whole, digest, _ = sent_anchors(c, window, buckets)
        again = np.zeros(len(order), bool)
        by_bucket = {k: (bits, d, f) for k, bits, d, f in held}
        for k, x, y in _groups(bucket, order):
            again[order[x:y]] = np.unpackbits(np.frombuffer(by_bucket[k][0], np.uint8), count=y - x).astype(bool)
        # first documents of the digests, of this chunk and of others
        keys = np.concatenate([digest, *(np.frombuffer(d, np.uint64) for _, d, _ in by_bucket.values())])
        docs = np.concatenate([c.doc[whole], *(np.frombuffer(f, np.int64) for _, _, f in by_bucket.values())])
        _, first, place = _least(keys, docs)
        copy = np.zeros(len(c.ids), bool)
        copy[whole] = first[place[:len(whole)]] < c.doc[whole]
        # windows that hold an anchor which occurs again
        mark = np.zeros(len(c.owner) + 1, np.int64)
        shared = at[again[inverse]]
        np.add.at(mark, np.maximum(shared - (PERIOD - 1), 0), 1)
        np.add.at(mark, shared + 1, -1)
        begin = c.starts(window)
        begin = begin[(np.cumsum(mark[:-1]) > 0)[begin] & ~copy[c.owner[begin]]]
        open_ = np.zeros(len(c.ids), bool)
        open_[c.owner[begin]] = True
        rows = [c.row(i, np.full(c.n[i], copy[i])) for i in np.flatnonzero(~open_)]
        if rows:
            yield _result_batch(rows, 0)
        if not len(begin):
            return
        h, owner = c.windows(begin, window), c.doc[c.owner[begin]]
        keys, first, place = _least(h, owner)
        several = np.zeros(len(keys), bool)
        several[place[owner > first[place]]] = True
        home = _bucket(keys, buckets)
        order = np.argsort(home, kind="stable")
        keys = keys | several.astype(np.uint64)
        yield _extra_batch(1, number, [(k, keys[order[x:y]].tobytes(), first[order[x:y]].tobytes(), None) for k, x, y in _groups(home, order)])
        yield _extra_batch(2, number, [(None, None, None, frozen(*c.of(open_)))])

    return _by_chunk(table, answers, tasks, work, EXTENDED)


def answered_windows(rows: DataFrame, buckets: int) -> DataFrame:
    """chunk, windows, docs: windows of the chunk that have an earlier document, with the first one."""
    def run(batches):
        names, keys, docs = [], [], []
        for b in batches:
            for c, w, d in zip(b.column("chunk").to_pylist(), b.column("windows"), b.column("docs")):
                names.append(c)
                keys.append(np.frombuffer(w.as_buffer(), np.uint64))
                docs.append(np.frombuffer(d.as_buffer(), np.int64))
        if not names:
            return
        everything, owners = np.concatenate(keys), np.concatenate(docs)
        plain = everything & ~np.uint64(1)
        _, first, place = _least(plain, owners)
        asked = (everything & np.uint64(1)).astype(bool) | (first[place] < owners)
        ends = np.cumsum([len(k) for k in keys])
        for c, k, end in zip(names, keys, ends):
            on = np.flatnonzero(asked[end - len(k):end]) + end - len(k)
            if len(on):
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([plain[on].tobytes()], pa.binary()), pa.array([first[place[on]].tobytes()], pa.binary())],
                                                 ["chunk", "windows", "docs"])

    return rows.repartitionById(buckets, F.col("bucket")).mapInArrow(run, "chunk bigint, windows binary, docs binary")


def marked(table: DataFrame, answers: DataFrame, window: int, tasks: int) -> DataFrame:
    def work(number, blob, held):
        c = Chunk(*thawed(blob))
        gone = np.zeros(len(c.owner) + 1, np.int64)
        if held:
            keys = np.concatenate([np.frombuffer(w, np.uint64) for w, _ in held])
            docs = np.concatenate([np.frombuffer(d, np.int64) for _, d in held])
            order = np.argsort(keys)
            keys, docs = keys[order], docs[order]
            begin = c.starts(window)
            h = c.windows(begin, window)
            place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            begin = begin[(keys[place] == h) & (docs[place] < c.doc[c.owner[begin]])]
            np.add.at(gone, begin, 1)
            np.add.at(gone, begin + window, -1)
        gone = np.cumsum(gone[:-1]) > 0
        yield _result_batch([c.row(i, gone[c.first[i]:c.first[i] + c.n[i]]) for i in range(len(c.ids))])

    return _by_chunk(table, answers, tasks, work, RESULT)


def remove_repeats(docs: DataFrame, window: int = WINDOW, chunk_bytes: int = CHUNK, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, removed (ranges of words), kept_sha256 of every document: words of windows that also
    begin in a document with a smaller doc_id go. `window` is PERIOD at least."""
    if window < PERIOD:
        raise ValueError(f"a window has at least {PERIOD} words")
    spark = docs.sparkSession
    table, raw = chunks(docs, chunk_bytes)
    # about three anchors of six bytes for seven words; a task of texts holds a few chunks
    buckets, tasks = tasks_of(spark, -(-raw // (2 * bucket_bytes))), tasks_of(spark, -(-raw // (4 * chunk_bytes)))
    answers = answered_anchors(entries(table, window, buckets), buckets)
    parts = cut(extended(table, answers, window, buckets, tasks), "extended")
    drop_table(table)
    first = cut(answered_windows(parts.where("kind = 1").select("bucket", "chunk", "windows", "docs"), buckets), "first")
    rest = marked(parts.where("kind = 2").select("chunk", "blob"), first, window, tasks)
    return parts.where("kind = 0").select(*_RESULT_NAMES).unionByName(rest)


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
word AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM w),
around AS (SELECT *, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS g FROM word),
hit AS (SELECT doc_id, pos, word, pos + 12 <= n AND doc_id > min(CASE WHEN pos + 12 <= n THEN doc_id END) OVER (PARTITION BY CASE WHEN pos + 12 <= n THEN g END) AS hit FROM around),
gone AS (SELECT doc_id, pos, word, bool_or(coalesce(hit, false)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM hit)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(g.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(g.kept, '')) AS kept_sha256
FROM w LEFT JOIN (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM gone GROUP BY doc_id) g USING (doc_id)"""
