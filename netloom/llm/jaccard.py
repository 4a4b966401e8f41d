"""Similarity join of documents on word shingles: T-occurrence search over inverted lists, as in DivideSkip.

Equal shingle sets are one node. Shingles are ordered by hash; a node posts its first ones, enough that two linked
nodes share a known number of them. Lists of the posted shingles are met in buckets: short lists give pairs with
the number of shared shingles, long lists only mark their nodes. What reaches the required number makes
candidate blocks. Every block then gets the whole shingle sets of its nodes, in one task: inverted lists, the short
ones merged for each query node, the long ones probed by binary search, and exact overlaps for what reaches
the threshold. A node whose block is already connected is not searched again, since only components are asked for.

Null and empty texts, and texts without words, have no shingles and link with nothing. Equal rows share a component.
Repeated ids keep a row each. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from netloom.lineage import cut
from netloom.llm.common import LOWER, map_arrow, not_space, prefix_hash, sliced, stretch_hash, tasks_of, utf8, word_hashes
from netloom.llm.packed import components, pack, reduce, schema_of, small_enough

SHINGLE, PERCENT, SHORT_LIST, BLOCK_NODES, SPARE = 4, 85, 64, 20_000, 10
NODES = "doc_id bigint, th bigint, n bigint, node bigint"


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; a shorter text is one shingle."""
    data = LOWER[utf8(text)]
    h, _, _ = word_hashes(data, not_space(data))
    if not len(h):
        return h
    m = min(k, len(h))
    start = np.arange(len(h) - m + 1)
    return np.unique(stretch_hash(prefix_hash(h), start, start + m))


def node_of(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def least_overlap(n, percent: int):
    """Shingles that a set of n shares with any set it links with."""
    return -(-percent * n // 100)


def spare(n):
    """Shingles that two linked nodes share among the posted ones, at least that of the smaller."""
    return np.maximum(1, np.asarray(n) // SPARE)


def posted(n: int, percent: int) -> int:
    return min(n, int(n - least_overlap(n, percent) + spare(n)))


def nodes_of(docs: DataFrame, k: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, th (hash of the text), number of shingles, node (a digest of the set; null if empty) and the carried bigints."""
    def run(batches):
        for b in sliced(batches, 1024):
            sets = [shingle_set(t, k) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array([len(s) for s in sets], pa.int64()),
                                              pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()), *(b.column(c) for c in carried)],
                                             ["doc_id", "th", "n", "node", *carried])

    return map_arrow(docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("th"), "text", *carried), run, ", ".join([NODES, *(f"`{c}` bigint" for c in carried)]))


def postings(docs: DataFrame, k: int, percent: int, buckets: int) -> DataFrame:
    """Packed (shingle, node, size), the first shingles of every distinct set of a batch."""
    def run(batches):
        for b in batches:
            seen, columns = set(), {"shingle": [], "node": [], "n": []}
            for t in b.column("text").to_pylist():
                s = shingle_set(t, k)
                if not len(s) or (node := node_of(s)) in seen:
                    continue
                seen.add(node)
                p = posted(len(s), percent)
                columns["shingle"].append(s[:p])
                columns["node"].append(np.full(p, node, np.int64))
                columns["n"].append(np.full(p, len(s), np.uint32))
            if seen:
                joined = {c: np.concatenate(x) for c, x in columns.items()}
                # the low part of the range of hashes is posted most: deal by other bits
                yield from pack(joined, joined["shingle"] * np.uint64(0x9E3779B97F4A7C15), buckets)

    return map_arrow(docs.select("text"), run, schema_of(["shingle", "node", "n"]))


def _short_pairs(c: dict, short: int, percent: int):
    """a, b, shared: pairs on short lists with the number of lists; a = b marks the long lists a node is on, by -1 - list."""
    order = np.lexsort((c["node"], c["shingle"]))
    shingle, node, n = c["shingle"][order], c["node"][order], c["n"][order].astype(np.int64)
    new = np.concatenate([[True], (shingle[1:] != shingle[:-1]) | (node[1:] != node[:-1])])  # a set posted by several batches counts once
    shingle, node, n = shingle[new], node[new], n[new]
    start = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]]))
    size = np.diff(np.append(start, len(shingle)))
    a, b = [], []

    def table(kind, x, y, w):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind), pa.int32()), pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(w, pa.int64())],
                                          ["kind", "a", "b", "shared"])

    def flush():
        x, y = np.concatenate(a), np.concatenate(b)
        ids, at = np.unique(np.concatenate([x, y]), return_inverse=True)
        pair, count = np.unique(at[:len(x)].astype(np.int64) * len(ids) + at[len(x):], return_counts=True)
        return table(0, ids[pair // len(ids)], ids[pair % len(ids)], count)

    held = 0
    for m in np.unique(size[(size > 1) & (size <= short)]):
        for lists in np.array_split(start[size == m], max(1, len(start[size == m]) * m * m // 1_000_000)):
            rows = lists[:, None] + np.arange(m)
            i, j = np.triu_indices(m, 1)
            x, y = rows[:, i].ravel(), rows[:, j].ravel()
            fit = np.minimum(n[x], n[y]) * 100 >= percent * np.maximum(n[x], n[y])
            a.append(node[x[fit]])
            b.append(node[y[fit]])
            held += int(fit.sum())
            if held > 1_000_000:
                yield flush()
                a, b, held = [], [], 0
    if held:
        yield flush()
    long = np.repeat(size > short, size)
    if long.any():
        yield table(1, node[long], shingle[long].view(np.int64), n[long])


def candidates(docs: DataFrame, sizes: DataFrame, k: int, percent: int, short: int) -> DataFrame:
    """Edges (a, b) that join every pair of nodes which can be linked. sizes: node, n."""
    buckets = tasks_of(docs.sparkSession)
    found = cut(reduce(postings(docs, k, percent, buckets), buckets, {"shingle": np.uint64, "node": np.int64, "n": np.uint32},
                       lambda c: _short_pairs(c, short, percent), "kind int, a bigint, b bigint, shared bigint"), "pairs")
    on_long = found.where("kind = 1")
    long = on_long.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("long"), F.first("shared").alias("n"))
    shared = (found.where("kind = 0").groupBy("a", "b").agg(F.sum("shared").alias("shared"))
              .join(long.select(F.col("node").alias("a"), F.col("long").alias("la")), "a", "left")
              .join(long.select(F.col("node").alias("b"), F.col("long").alias("lb")), "b", "left")
              .join(sizes.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b"))
    spare_of = lambda n: F.greatest(F.lit(1).cast("bigint"), F.floor(n / SPARE))
    met = shared.where(F.col("shared") + F.coalesce(F.least("la", "lb"), F.lit(0)) >= spare_of(F.least("na", "nb")))
    # two nodes without a short list in common share long ones only, as many as their spare: such nodes of a list are joined
    heavy = long.where(F.col("long") >= spare_of(F.ceil(F.col("n") * percent / 100))).select(F.col("node").alias("a"))
    stars = on_long.join(heavy, "a").select("a", F.col("b").alias("list"))
    hub = stars.groupBy("list").agg(F.min("a").alias("b"))
    return met.select("a", "b").unionByName(stars.join(hub, "list").where("a <> b").select("a", "b").distinct())


class Block:
    """Inverted lists of the shingle sets of one block."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.n = sets, np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), self.n)
        joined = np.concatenate(sets)
        order = np.argsort(joined, kind="stable")
        self.owners = owner[order]
        self.shingles, self.start = np.unique(joined[order], return_index=True)
        self.end = np.append(self.start[1:], len(joined))

    def search(self, q: int, others: np.ndarray, percent: int) -> np.ndarray:
        """Nodes among `others` (a mask) that link with q."""
        at = np.searchsorted(self.shingles, self.sets[q])
        start, end = self.start[at], self.end[at]
        order = np.argsort(end - start, kind="stable")
        least = int(least_overlap(int(self.n[q]), percent))
        # least - 1 lists at most may be left out of the merge: the longest
        size = (end - start)[order]
        long = min(least - 1, int(least / (0.01 * math.log2(max(2, size[-1])) + 1)))
        short = order[:len(order) - long]
        merged = np.concatenate([self.owners[start[i]:end[i]] for i in short])
        merged = merged[others[merged]]
        ids, count = np.unique(merged, return_counts=True)
        keep = count >= least - long
        ids, count = ids[keep], count[keep]
        for done, i in enumerate(order[len(order) - long:][::-1]):
            if not len(ids):
                break
            owners = self.owners[start[i]:end[i]]
            place = np.minimum(np.searchsorted(owners, ids), len(owners) - 1)
            count = count + (owners[place] == ids)
            keep = count + (long - done - 1) >= least
            ids, count = ids[keep], count[keep]
        return ids[100 * count >= percent * (self.n[q] + self.n[ids] - count)]


def linked(nodes: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect every component of the block, all of them links."""
    block, root = Block(sets), np.arange(len(sets))
    a, b = [], []
    todo = list(np.argsort(-block.n, kind="stable"))
    for q in todo:
        others = root != root[q]
        if not others.any():
            break
        # the members of the largest component need no search of their own: all others look for them
        if (root == root[q]).sum() * 2 > len(root):
            continue
        found = block.search(int(q), others, percent)
        if len(found):
            a.append(np.full(len(found), nodes[q]))
            b.append(nodes[found])
            low = min(root[q], root[found].min())
            root[np.isin(root, np.append(root[found], root[q]))] = low
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2


def verified(docs: DataFrame, members: DataFrame, count: int, k: int, percent: int) -> DataFrame:
    """Links (a, b) inside candidate blocks. members: id, digest (of the text), node, block, parts, one document for each node."""
    spark, buckets = docs.sparkSession, tasks_of(docs.sparkSession)
    # null ids meet by the text alone
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("th")).join(small_enough(members, count), (F.col("th") == F.col("digest")) & F.col("doc_id").eqNullSafe(F.col("id")))

    def sets(batches):
        seen = set()
        for b in sliced(batches, 1024):
            found = [shingle_set(t, k) for t in b.column("text").to_pylist()]
            # a hash of a text may stand for several, and one text in many rows is sent once
            own = [node_of(s) == node and node not in seen and not seen.add(node) for s, node in zip(found, b.column("node").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("block"), b.column("parts"), pa.array([s.tobytes() for s in found], pa.binary())],
                                             ["node", "block", "parts", "shingles"]).filter(pa.array(own, pa.bool_()))

    rows = map_arrow(texts.select("node", "block", "parts", "text"), sets, "node bigint, block bigint, parts int, shingles binary")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.least(p, F.col("own")).alias("i"), F.greatest(p, F.col("own")).alias("j")))
    spread = rows.withColumn("own", own).withColumn("g", F.explode(pairs)).select("block", "g.i", "g.j", "node", "shingles")
    dealt = spread.repartition(buckets, "block", "i", "j").sortWithinPartitions("block", "i", "j", "node")

    def run(batches):
        name, nodes, held = None, [], []

        def flush():
            x, y = linked(np.array(nodes, np.int64), held, percent)
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

        for batch in batches:
            for block, i, j, node, raw in zip(*(batch.column(c).to_pylist() for c in ("block", "i", "j", "node", "shingles"))):
                if (block, i, j) != name:
                    if len(held) > 1:
                        yield flush()
                    name, nodes, held = (block, i, j), [], []
                elif node == nodes[-1]:
                    continue
                nodes.append(node)
                held.append(np.frombuffer(raw, np.uint64))
        if len(held) > 1:
            yield flush()

    return dealt.mapInArrow(run, "a bigint, b bigint")


def grouped(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, short: int = SHORT_LIST, block_nodes: int = BLOCK_NODES, carried: tuple[str, ...] = ()) -> DataFrame:
    """The rows of `nodes_of` with comp (the least node of the component; null without shingles) and component_id (its least doc_id)."""
    rows = cut(nodes_of(docs, k, carried), "nodes")
    distinct = cut(rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.coalesce(F.min_by("th", "doc_id"), F.min("th")).alias("th"), F.first("n").alias("n")), "distinct")
    blocks = components(candidates(docs, distinct, k, percent, short))
    sizes = blocks.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    members = cut(blocks.join(sizes, "comp").join(distinct, "node").select(F.col("doc_id").alias("id"), F.col("th").alias("digest"), "node", F.col("comp").alias("block"), F.ceil(F.col("size") / block_nodes).cast("int").alias("parts")), "members")
    count = members.count()
    comp = components(cut(verified(docs, members, count, k, percent), "links"))
    named = distinct.join(comp, "node", "left").select("node", "doc_id", F.coalesce("comp", "node").alias("comp"))
    least = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    of_node = cut(named.join(least, "comp").select("node", "comp", "component_id"), "of_node")
    return rows.join(of_node, "node", "left")


def join(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, short: int = SHORT_LIST, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """doc_id, n_shingles, component_id: documents whose sets link when 100 * shared >= percent * union."""
    return grouped(docs, k, percent, short, block_nodes).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
word AS (SELECT doc_id, len(w) AS nw, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM w),
around AS (SELECT doc_id, nw, pos, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS g FROM word),
s AS MATERIALIZED (SELECT DISTINCT doc_id, g FROM around WHERE pos <= greatest(nw - 3, 1)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS node, doc_id AS other FROM w UNION SELECT r.node, l.b FROM reach r JOIN link l ON l.a = r.other)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(other) FROM reach r WHERE r.node = w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id)"""
