"""Removal of repeated byte strings by a logarithmic family of sparse suffix arrays.

Of all strings of 100 bytes that occur more than once, only the first occurrence (smaller doc_id, then earlier
start) stays; each byte under a later one is removed. A suffix is indexed where the hash of its first 32 bytes is the
least among the 69 that begin within a string of 100 bytes, so that every such string has one indexed suffix, at the
same place in every copy. The strings that share an indexed suffix form its stretch.

Suffixes are dealt to buckets by that hash. In a bucket, the batches of documents come in order of doc_id: each gets a
suffix array (ordered by hash and stretch), is merge-scanned against the arrays of all existing levels, and becomes a
level itself; levels of like size merge, so that there are logarithmically many. A stretch that is whole in an earlier
place is removed at once. Where only the first bytes agree, the bytes of the stretches are fetched and their strings
compared one by one, beside the levels.

Equal entries are combined before they are dealt. A hash that very many different stretches share (a passage that
many documents carry in their own surroundings) is not met in one task: its strings are dealt one by one, by their own
hash, after each task has kept the earliest of equal ones. The number of buckets follows the bytes of the texts.

Null and empty texts have no bytes. Texts shorter than 100 bytes lose nothing. Repeated
rows (one id, one text) are judged alike and do not count as earlier copies of each other; different texts of one id
are cut by the marks of both. Null ids come first. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from netloom.lineage import cut
from netloom.llm.common import map_arrow, prefix_hash, runs, stretch_hash, tasks_of, utf8
from netloom.llm.packed import dealt, pack, schema_of, small_enough, unpack

LENGTH, GRAM, CHUNK, FLUSH, BATCH_IDS = 100, 32, 1_000_000, 250_000, 65536
BUCKET_BYTES = 64 << 20  # text behind the entries of one bucket
HOT_SHARE, HOT_LEAST = 100_000, 5_000  # a hash with more asked stretches than both say is met by single strings
GRAMS = LENGTH - GRAM + 1
PLACE_BITS = 23  # places within a chunk, below the hash in one number

ENTRY = {"gram": np.uint64, "stretch": np.uint64, "doc": np.int64, "start": np.int64, "count": np.uint8}
MARK = {"doc": np.int64, "start": np.int64, "count": np.uint8, "ask": np.uint8, "gram": np.uint64}
NULL_ID = -(1 << 63)


def stretches(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every indexed suffix: hash of its gram, hash of its stretch, first string start and number of starts, of one text."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    out = [_chunk(data[at:at + CHUNK + LENGTH - 1], at) for at in range(0, n, CHUNK)]
    return tuple(np.concatenate(x) for x in zip(*out))


def _chunk(data: np.ndarray, offset: int):
    h = prefix_hash(data.astype(np.uint64) + np.uint64(1))
    at = np.arange(len(data) - GRAM + 1)
    gram = stretch_hash(h, at, at + GRAM)
    keyed = (gram >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | at.astype(np.uint64)
    owner = (_least(keyed) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    count = np.diff(np.append(first, len(owner)))
    return gram[owner[first]], stretch_hash(h, first, first + count - 1 + LENGTH), first + offset, count


def _least(x: np.ndarray) -> np.ndarray:
    """Minimum of every GRAMS values in a row, from running minima within blocks."""
    w = GRAMS
    full = np.concatenate([x, np.full(-len(x) % w, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(full[:, ::-1], 1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(full, 1).ravel()
    n = len(x) - w + 1
    return np.minimum(ahead[:n], behind[w - 1:w - 1 + n])


def key_of(doc_id) -> int:
    return NULL_ID if doc_id is None else doc_id


def texts_of(docs: DataFrame) -> DataFrame:
    """doc (null ids first), n_bytes, digest of the text, and the digest of what is kept if nothing is removed."""
    def run(batches):
        for b in batches:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([key_of(d) for d in b.column("doc_id").to_pylist()], pa.int64()), pa.array(list(map(len, raw)), pa.int64()),
                 pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string())], ["doc", "n_bytes", "digest"])

    return map_arrow(docs.select(F.col("doc_id").cast("bigint"), "text"), run, "doc bigint, n_bytes bigint, digest string")


def entries(docs: DataFrame, buckets: int) -> DataFrame:
    """Packed suffix entries of every batch, the earliest of equal ones; the others are marks (`sure`), dealt by document."""
    def run(batches):
        for b in batches:
            ids = [key_of(d) for d in b.column("doc_id").to_pylist()]
            texts, seen = b.column("text").to_pylist(), set()
            columns: dict[str, list] = {k: [] for k in ENTRY}
            size = 0
            for i in sorted(range(len(ids)), key=lambda i: ids[i]):
                data = utf8(texts[i])
                if len(data) < LENGTH or (d := hashlib.blake2b(data.tobytes(), digest_size=16).digest()) in seen:
                    continue
                seen.add(d)
                gram, stretch, start, count = stretches(data)
                for k, v in zip(ENTRY, (gram, stretch, np.full(len(gram), ids[i], np.int64), start, count.astype(np.uint8))):
                    columns[k].append(v)
                size += len(gram)
                if size > FLUSH:
                    yield from _packed(columns, buckets)
                    columns, size = {k: [] for k in ENTRY}, 0
            if size:
                yield from _packed(columns, buckets)

    return map_arrow(docs.select(F.col("doc_id").cast("bigint"), "text"), run, schema_of(list(ENTRY)) + ", sure boolean")


def later(doc: np.ndarray, start: np.ndarray, *key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the entries of each key: the first of the earliest ones, and all that stand later than it (masks)."""
    order = np.lexsort((start, doc, *key[::-1]))
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in key], 0)
    lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    first, after = np.zeros(len(order), bool), np.zeros(len(order), bool)
    first[order[new]] = True
    after[order] = (doc[order] != doc[lead]) | (start[order] != start[lead])
    return first, after


def _marked(batches, **same):
    """Batches with constant columns added."""
    for b in batches:
        for name, value in same.items():
            b = b.append_column(name, pa.array([value] * b.num_rows, pa.int32() if type(value) is int else None))
        yield b


def _packed(columns, buckets):
    c = {k: np.concatenate(v) for k, v in columns.items()}
    first, after = later(c["doc"], c["start"], c["gram"], c["stretch"])
    keep = {k: v[first] for k, v in c.items()}
    yield from _marked(pack(keep, keep["gram"] * np.uint64(0x9E3779B97F4A7C15), buckets), sure=False)
    gone = {k: v[after] for k, v in c.items()}
    yield from _marked(pack(gone, _by_document(gone["doc"]), buckets), sure=True)


class Level:
    """Sorted entries of some batches, first by hash, then by stretch; of equal ones only the earliest."""

    def __init__(self, gram, stretch, doc, start):
        order = np.lexsort((start, doc, stretch, gram))
        gram, stretch, doc, start = gram[order], stretch[order], doc[order], start[order]
        new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (stretch[1:] != stretch[:-1])])
        self.gram, self.stretch, self.doc, self.start = gram[new], stretch[new], doc[new], start[new]

    def __len__(self):
        return len(self.gram)

    def merged(self, other: Level) -> Level:
        return Level(*(np.concatenate([getattr(self, k), getattr(other, k)]) for k in ("gram", "stretch", "doc", "start")))

    def scan(self, gram: np.ndarray, stretch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each stretch in this level, or -1; and whether its hash occurs here with another stretch."""
        low, high = np.searchsorted(self.gram, gram, "left"), np.searchsorted(self.gram, gram, "right")
        place = np.full(len(gram), -1)
        at = low.copy()
        n_same = np.zeros(len(gram), np.int64)
        on = np.flatnonzero(low < high)
        lo, hi = low[on], high[on]
        while len(on):  # binary search for the stretch among the entries of one hash
            mid = (lo + hi) // 2
            less = self.stretch[mid] < stretch[on]
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
            over = lo >= hi
            at[on[over]] = lo[over]
            on, lo, hi = on[~over], lo[~over], hi[~over]
        found = (at < high) & (self.stretch[np.minimum(at, len(self) - 1)] == stretch)
        place[found] = at[found]
        n_same = high - low - found
        return place, n_same > 0


class Family:
    """Levels of geometrically growing size; entries must come in the order of their documents."""

    def __init__(self):
        self.levels: list[Level] = []

    def add(self, gram, stretch, doc, start) -> np.ndarray:
        """For each entry of the new batch, whether its whole stretch stands earlier."""
        if not len(gram):
            return np.zeros(0, bool)
        own = Level(gram, stretch, doc, start)
        place, _ = own.scan(gram, stretch)
        earlier = (own.doc[place] < doc) | ((own.doc[place] == doc) & (own.start[place] < start))
        for level in self.levels:
            earlier |= level.scan(gram, stretch)[0] >= 0
        self.levels.append(own)
        while len(self.levels) > 1 and len(self.levels[-2]) <= 2 * len(self.levels[-1]):
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(a.merged(b))
        return earlier


def batched(doc: np.ndarray, per_batch: int):
    """Index ranges of entries sorted by document, cut between documents."""
    at = 0
    while at < len(doc):
        end = min(at + per_batch, len(doc))
        if end < len(doc):
            end = int(np.searchsorted(doc, doc[end - 1], "right"))
        yield at, end
        at = end


def scanned(c: dict[str, np.ndarray], per_batch: int = BATCH_IDS):
    """Marks of one task's entries: stretches to remove, and stretches whose bytes are needed."""
    order = np.lexsort((c["start"], c["doc"]))
    gram, stretch, doc, start, count = (c[k][order] for k in ENTRY)
    family, earlier = Family(), np.zeros(len(gram), bool)
    for a, b in batched(doc, per_batch):
        earlier[a:b] = family.add(gram[a:b], stretch[a:b], doc[a:b], start[a:b])
    while len(family.levels) > 1:
        b, a = family.levels.pop(), family.levels.pop()
        family.levels.append(a.merged(b))
    whole = family.levels[0]
    grams, n = np.unique(whole.gram, return_counts=True)
    shared = n[np.searchsorted(grams, gram)] > 1
    # the earliest of each different stretch of a shared hash is compared string by string
    ask = shared & ~earlier
    use = earlier | ask
    # one id may come with equal entries of repeated rows: they are asked for once
    yield doc[use], start[use], count[use], ask[use].astype(np.uint8), gram[use]


def _by_document(doc: np.ndarray) -> np.ndarray:
    x = doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def marks(docs: DataFrame, buckets: int) -> DataFrame:
    """Packed (doc, start, count, ask, gram), dealt by document."""
    def run(batches):
        held = []
        for b in batches:
            sure = b.filter(b.column("sure"))
            if sure.num_rows:
                zeros = pa.array([bytes(len(x.as_buffer())) for x in sure.column("count")], pa.binary())
                yield pa.RecordBatch.from_arrays([sure.column("bucket"), sure.column("doc"), sure.column("start"), sure.column("count"), zeros, sure.column("gram")], ["bucket", *MARK])
            held.append(b.filter(pc.invert(b.column("sure"))))
        c = unpack(held, ENTRY)
        if len(c["gram"]):
            for doc, start, count, ask, gram in scanned(c):
                yield from pack({"doc": doc, "start": start, "count": count, "ask": ask, "gram": gram}, _by_document(doc), buckets)

    return cut(dealt(entries(docs, buckets), buckets).mapInArrow(run, schema_of(list(MARK))), "marks")


def hot_grams(marked: DataFrame) -> np.ndarray:
    """Hashes with very many asked stretches, fewer than HOT_SHARE of them."""
    def run(batches):
        for b in batches:
            asked = [np.frombuffer(g.as_buffer(), np.uint64)[np.frombuffer(a.as_buffer(), np.uint8) == 1] for g, a in zip(b.column("gram"), b.column("ask"))]
            gram, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *asked]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n)], ["gram", "n"])

    counted = marked.select("gram", "ask").mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    counted = cut(counted, "asked")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    hot = counted.where(F.col("n") > max(HOT_LEAST, total // HOT_SHARE)).select("gram").collect()
    return np.sort(np.array([r.gram for r in hot], np.int64).view(np.uint64))


def _with_texts(docs: DataFrame, packed: DataFrame, wanted: DataFrame, count: int, buckets: int, kinds: dict, work, schema: str) -> DataFrame:
    """Meet packed rows and the texts of the wanted documents in tasks dealt by document; `work` gets ids, texts and columns."""
    names = list(kinds)

    def deal(batches):
        for b in batches:
            ids = np.array([key_of(d) for d in b.column("doc_id").to_pylist()], np.int64)
            to = ((_by_document(ids) >> np.uint64(16)) % np.uint64(buckets)).astype(np.int32)
            empty = pa.nulls(b.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(to), *[empty] * len(names), pa.array(ids), b.column("text")], ["bucket", *names, "id", "text"])

    keyed = docs.select(F.col("doc_id").cast("bigint"), "text").withColumn("doc", F.coalesce("doc_id", F.lit(NULL_ID)))
    texts = map_arrow(keyed.join(small_enough(wanted, count), "doc", "left_semi").select("doc_id", "text"), deal, f"{schema_of(names)}, id bigint, text string")
    both = texts.unionByName(packed.withColumn("id", F.lit(None).cast("bigint")).withColumn("text", F.lit(None).cast("string")))

    def run(batches):
        columns, name, ids, texts = {n: [] for n in names}, None, [], []

        def flush():
            order = {n: np.concatenate(v) if v else np.zeros(0, kinds[n]) for n, v in columns.items()}
            yield from work(ids, texts, order)

        for b in batches:
            is_text = b.column("id").is_valid().to_pylist()
            for i, bucket in enumerate(b.column("bucket").to_pylist()):
                if bucket != name:
                    if ids:
                        yield from flush()
                    columns, name, ids, texts = {n: [] for n in names}, bucket, [], []
                if is_text[i]:
                    ids.append(b.column("id")[i].as_py())
                    texts.append(b.column("text")[i].as_py())
                else:
                    for n in names:
                        columns[n].append(np.frombuffer(b.column(n)[i].as_buffer(), kinds[n]))
        if ids:
            yield from flush()

    return dealt(both, buckets).mapInArrow(run, schema)


CONTEXT = {"doc": np.int64, "start": np.int64, "count": np.uint8}
STRETCH, STRING, SURE = 0, 1, 2
CONTEXTS = schema_of([*CONTEXT, "bytes"]) + ", kind int"


def contexts(docs: DataFrame, asked: DataFrame, wanted: DataFrame, count: int, buckets: int, hot: np.ndarray) -> DataFrame:
    """Packed rows of three kinds: stretches with their bytes, dealt by the hash of the indexed suffix; for the hot hashes
    single strings (their hash in `bytes`), the earliest of equal ones of a task, dealt by their own hash; and marks of
    the strings that stand earlier in the same task, dealt by document."""
    sent = docs.sparkSession.sparkContext.broadcast(hot)

    def work(ids, texts, c):
        on = c["ask"] == 1
        doc, start, size, gram = (c[k][on] for k in ("doc", "start", "count", "gram"))
        order = np.argsort(doc, kind="stable")
        doc, start, size, gram = doc[order], start[order], size[order].astype(np.int64), gram[order]
        out, rows, done = [], [], set()
        for i, t in zip(ids, texts):
            a, b = np.searchsorted(doc, i, "left"), np.searchsorted(doc, i, "right")
            data = utf8(t)
            if a == b or i in done or len(data) < LENGTH:
                continue
            known = start[a:b] + size[a:b] - 1 + LENGTH <= len(data)
            if not known.all():
                continue  # another text of this id
            done.add(i)
            out += [data[x:x + n - 1 + LENGTH] for x, n in zip(start[a:b], size[a:b])]
            rows.append(np.arange(a, b))
        if not rows:
            return
        at = np.concatenate(rows)
        doc, start, size, gram = doc[at], start[at], size[at], gram[at]
        is_hot = np.isin(gram, sent.value)
        to = (((gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)
        for bucket in np.unique(to[~is_hot]):
            own = np.flatnonzero((to == bucket) & ~is_hot)
            yield pa.RecordBatch.from_arrays(
                [pa.array([bucket], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in (doc[own], start[own], size[own].astype(np.uint8), np.concatenate([out[k] for k in own]))),
                 pa.array([STRETCH], pa.int32())], ["bucket", *CONTEXT, "bytes", "kind"])
        own = np.flatnonzero(is_hot)
        if len(own):
            owner, offset, string = _strings(np.concatenate([out[k] for k in own]), size[own])
            first, after = later(doc[own][owner], start[own][owner] + offset, string)
            yield from _marked(_flagged(after, owner, offset, doc[own], start[own], buckets, bytes=b""), kind=SURE)
            owner, string = owner[first], string[first]
            named = {"doc": doc[own][owner], "start": start[own][owner] + offset[first], "count": np.ones(len(owner), np.uint8), "bytes": string}
            yield from _marked(pack(named, string, buckets), kind=STRING)

    return _with_texts(docs, asked, wanted, count, buckets, MARK, work, CONTEXTS)


def _string_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of all strings of the stretches, a piece of the bytes at a time."""
    out, i = [], 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(ends, begins[i] + CHUNK, "right")))
        h = prefix_hash(data[begins[i]:ends[j - 1]].astype(np.uint64) + np.uint64(1))
        n = size[i:j]
        at = np.repeat(begins[i:j] - begins[i], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out.append(stretch_hash(h, at, at + LENGTH))
        i = j
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _strings(data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretch, offset and hash of every string of the stretches whose bytes follow one another."""
    ends = np.cumsum(size - 1 + LENGTH)
    owner = np.repeat(np.arange(len(size)), size)
    offset = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return owner, offset, _string_hashes(data, ends - (size - 1 + LENGTH), ends, size)


def _flagged(flag: np.ndarray, owner: np.ndarray, offset: np.ndarray, doc: np.ndarray, start: np.ndarray, buckets: int, **same):
    """Packed runs of flagged starts within one stretch, dealt by document."""
    edge = np.ones(len(owner), bool)
    edge[1:] = owner[1:] != owner[:-1]
    begin = np.flatnonzero(flag & (edge | ~np.concatenate([[False], flag[:-1]])))
    stop = np.flatnonzero(flag & np.concatenate([edge[1:] | ~flag[1:], [True]]))
    doc, start, count = doc[owner[begin]], start[owner[begin]] + offset[begin], (stop - begin + 1).astype(np.uint8)
    yield from _marked(pack({"doc": doc, "start": start, "count": count}, _by_document(doc), buckets), **same)


def compared(c: dict[str, np.ndarray], buckets: int):
    """Runs of starts, among the asked stretches of one task, whose strings stand earlier."""
    owner, offset, string = _strings(c["bytes"], c["count"].astype(np.int64))
    _, after = later(c["doc"][owner], c["start"][owner] + offset, string)
    yield from _flagged(after, owner, offset, c["doc"], c["start"], buckets)


def settled(context: DataFrame, buckets: int) -> DataFrame:
    """Packed marks of all that `contexts` gives."""
    def run(batches):
        held = {STRETCH: [], STRING: []}
        for b in batches:
            kind = b.column("kind")
            sure = b.filter(pc.equal(kind, SURE))
            if sure.num_rows:
                yield sure.select(["bucket", *CONTEXT])
            for k, parts in held.items():
                parts.append(b.filter(pc.equal(kind, k)))
        c = unpack(held[STRETCH], CONTEXT | {"bytes": np.uint8})
        if len(c["doc"]):
            yield from compared(c, buckets)
        c = unpack(held[STRING], CONTEXT | {"bytes": np.uint64})
        if len(c["doc"]):
            _, after = later(c["doc"], c["start"], c["bytes"])
            yield from pack({k: c[k][after] for k in CONTEXT}, _by_document(c["doc"][after]), buckets)

    return dealt(context, buckets).mapInArrow(run, schema_of(list(CONTEXT)))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    texts = cut(texts_of(docs), "texts")
    buckets = tasks_of(docs.sparkSession, -(-(texts.agg(F.sum("n_bytes")).first()[0] or 0) // BUCKET_BYTES))
    long = texts.where(F.col("n_bytes") >= LENGTH)
    copies = long.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("last > first").select("digest", "first")
    marked = marks(docs, buckets)

    def ids(kind):
        def run(batches):
            for b in batches:
                for d, a in zip(b.column("doc"), b.column("ask")):
                    doc, ask = np.frombuffer(d.as_buffer(), np.int64), np.frombuffer(a.as_buffer(), np.uint8)
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(doc[ask == 1] if kind else doc), pa.int64())], ["doc"])
        return run

    asking = cut(marked.select("doc", "ask").mapInArrow(ids(True), "doc bigint").distinct(), "asking")
    context = contexts(docs, marked, asking, asking.count(), buckets, hot_grams(marked))
    extra = cut(settled(context, buckets), "extra")

    def sure(batches):
        for b in batches:
            for bucket, *row in zip(b.column("bucket").to_pylist(), *(b.column(n) for n in MARK)):
                v = {n: np.frombuffer(x.as_buffer(), MARK[n]) for n, x in zip(MARK, row)}
                on = v["ask"] == 0
                if on.any():
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *(pa.array([v[n][on].tobytes()], pa.binary()) for n in CONTEXT)], ["bucket", *CONTEXT])

    found = cut(marked.mapInArrow(sure, schema_of(list(CONTEXT))).unionByName(extra), "found")
    touched = cut(found.select("doc").mapInArrow(ids_of, "doc bigint").distinct(), "touched")
    whole_copies = long.join(copies, "digest").where("doc > first").select("doc", "digest", "n_bytes").distinct()
    whole_copies = cut(whole_copies, "copies")

    def work(ids, texts, c):
        order = np.argsort(c["doc"], kind="stable")
        doc, start, count = c["doc"][order], c["start"][order], c["count"][order].astype(np.int64)
        rows = []
        for i, t in zip(ids, texts):
            a, b = np.searchsorted(doc, i, "left"), np.searchsorted(doc, i, "right")
            data = utf8(t)
            mark = np.zeros(len(data) + 1, np.int64)
            x, y = start[a:b], start[a:b] + count[a:b] - 1 + LENGTH
            inside = y <= len(data)
            np.add.at(mark, x[inside], 1)
            np.add.at(mark, y[inside], -1)
            gone = np.cumsum(mark[:-1]) > 0
            rows.append((i, hashlib.sha256(data.tobytes()).hexdigest(), int(gone.sum()), len(runs(gone)[0]), hashlib.sha256(data[~gone].tobytes()).hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["doc", "digest", "n_removed", "n_spans", "kept_sha256"])

    cutting = _with_texts(docs, found, touched, touched.count(), buckets, CONTEXT, work, "doc bigint, digest string, n_removed bigint, n_spans bigint, kept_sha256 string").distinct()
    empty = hashlib.sha256(b"").hexdigest()
    out = (texts.join(whole_copies.select("doc", "digest", F.lit(True).alias("copy")), ["doc", "digest"], "left")
           .join(cutting, ["doc", "digest"], "left"))
    copy = F.col("copy").isNotNull()
    return out.select(F.when(F.col("doc") != NULL_ID, F.col("doc")).alias("doc_id"), "n_bytes",
                      F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
                      F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
                      F.when(copy, empty).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"))


def ids_of(batches):
    for b in batches:
        for d in b.column("doc"):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.frombuffer(d.as_buffer(), np.int64)), pa.int64())], ["doc"])
