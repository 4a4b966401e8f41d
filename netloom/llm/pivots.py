"""Near-duplicate vectors by an index of pivot permutations.

Reference points are drawn from the vectors. Every vector is described by its nearest reference points in order
(its permutation), as many as `nearest_of` says: the more points there are, the more of them a near vector may have
in between. Inverted lists stand for pairs of points, so that two vectors on one list share at least two of
their nearest points. A list verifies its vectors by cosine in double precision; a pair that meets on several lists
counts on the first only. Long lists are cut into blocks, and every pair of blocks is a group of its own.

Equal vectors are one class with a count. Vectors that are null, zero or hold null or non-finite components link
with nothing; vectors of different lengths never link. Repeated ids are separate vectors of one id; a null id is
larger than any other, and a component without ids has a null component_id.
`MAX_PIVOTS` bounds the reference points; all vectors are indexed.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from netloom.lineage import cut
from netloom.llm.common import hash63, tasks_of
from netloom.llm.packed import components, forest

MIN_PIVOTS, MAX_PIVOTS, NEAREST, BLOCK, COSINE = 32, 4096, 6, 1024, 0.9
CODED = "vec_id bigint, class string, dims int, v binary"
POSTING = "list bigint, node bigint, n bigint, near binary, v binary"


def nearest_of(n_points: int) -> int:
    """Nearest points of a vector: NEAREST up to 64 points, and two more for every eightfold number."""
    return NEAREST + max(0, round(2 / 3 * math.log2(max(n_points, 1) / 64)))


def coded(vectors: DataFrame) -> DataFrame:
    """vec_id with a digest and the double values of the vector scaled to length 1; null where it links with nothing."""
    def run(batches):
        for b in batches:
            classes, dims, out = [], [], []
            for x in b.column("embedding").to_pylist():
                v = np.array(x if x and None not in x else [], float)
                with np.errstate(all="ignore"):
                    top = np.abs(v).max(initial=0)
                    good = len(v) > 0 and np.isfinite(v).all() and top > 0
                    u = v / top if good else v
                    u = u / np.sqrt((u * u).sum()) if good else v
                raw = u.tobytes()
                classes.append(hashlib.md5(raw).hexdigest() if good else None)
                dims.append(len(v) if good else None)
                out.append(raw if good else None)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(classes, pa.string()), pa.array(dims, pa.int32()), pa.array(out, pa.binary())],
                                             ["vec_id", "class", "dims", "v"])

    return vectors.select(F.col("vec_id").cast("bigint"), "embedding").mapInArrow(run, CODED)


def _matrix(column) -> np.ndarray:
    return np.stack([np.frombuffer(x.as_buffer()) for x in column])


def postings(classes: DataFrame, points: np.ndarray, nearest: int | None = None) -> DataFrame:
    """A row for every vector and pair of its nearest points; `near` holds the points in order of closeness."""
    held, nearest = classes.sparkSession.sparkContext.broadcast(points), nearest or nearest_of(len(points))

    def run(batches):
        p = held.value
        pairs = list(itertools.combinations(range(min(nearest, len(p))), 2)) or [(0, 0)]
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                v = _matrix(part.column("v"))
                near = np.argsort(-(v @ p.T), 1, kind="stable")[:, :nearest].astype(np.int32)
                low = np.sort(near, 1)
                keys = np.stack([low[:, i].astype(np.int64) * len(p) + low[:, j] for i, j in pairs], 1)
                take = pa.array(np.repeat(np.arange(part.num_rows), len(pairs)))
                near_bytes = pa.array([x.tobytes() for x in near], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel(), pa.int64()), part.column("node").take(take), part.column("n").take(take),
                                                  near_bytes.take(take), part.column("v").take(take)], ["list", "node", "n", "near", "v"])

    return classes.select("node", "n", "v").mapInArrow(run, POSTING)


def verified(rows: DataFrame, n_points: int, cosine: float = COSINE) -> DataFrame:
    """a, b, links: for each group of rows (list, i, j, part) the linked weight of every vector `a`, and a smaller vector it reaches."""
    def link(node, n, near, v, part, split, key):
        left = np.flatnonzero(part == 0) if split else np.arange(len(node))
        right = np.flatnonzero(part == 1) if split else left
        links, ea, eb = np.zeros(len(node), np.int64), [], []
        low, high = divmod(key, n_points)
        for a in range(0, len(left), BLOCK):
            rows_a = left[a:a + BLOCK]
            for b in range(0 if split else a, len(right), BLOCK):
                rows_b = right[b:b + BLOCK]
                s = v[rows_a] @ v[rows_b].T >= cosine
                if not split and a == b:
                    s = np.triu(s, 1)
                x, y = np.nonzero(s)
                x, y = rows_a[x], rows_b[y]
                first = np.ones(len(x), bool)
                for at in range(0, len(x), 200_000):  # the two least points that both have must be those of this list
                    c = slice(at, at + 200_000)
                    nx, ny = near[x[c]], near[y[c]]
                    shared = (nx[:, :, None] == ny[:, None, :]).any(2) & (nx < high) & (nx != low)
                    first[c] = ~shared.any(1)
                x, y = x[first], y[first]
                np.add.at(links, x, n[y])
                np.add.at(links, y, n[x])
                ea.append(x)
                eb.append(y)
        x, y = np.concatenate(ea or [np.zeros(0, int)]), np.concatenate(eb or [np.zeros(0, int)])
        if not len(x):
            return None
        nodes, roots = forest(node[x], node[y])
        total = np.zeros(len(nodes), np.int64)
        np.add.at(total, np.searchsorted(nodes, node[links > 0]), links[links > 0])
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots), pa.array(total)], ["a", "b", "links"])

    def run(batches):
        held, name = [], None
        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in ("list", "i", "j")], 1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1 if len(keys) else []
            for x, y in zip([0, *cuts], [*cuts, len(keys)]):
                if x == y:
                    continue
                if name is not None and tuple(keys[x]) != name:
                    yield from group(name, held)
                    held = []
                name = tuple(keys[x])
                held.append(b.slice(x, y - x))
        if held:
            yield from group(name, held)

    def group(name, parts):
        t = pa.Table.from_batches(parts)
        if t.num_rows < 2:
            return
        near = np.stack([np.frombuffer(x.as_buffer(), np.int32) for x in t.column("near")])
        out = link(t.column("node").to_numpy(), t.column("n").to_numpy(), near, _matrix(t.column("v")), t.column("part").to_numpy(), name[1] != name[2], int(name[0]))
        if out is not None:
            yield out

    return rows.mapInArrow(run, "a bigint, b bigint, links bigint")


def links(classes: DataFrame, n_classes: int, cosine: float = COSINE, nearest: int | None = None, block: int = BLOCK) -> DataFrame:
    """Linked weights and star edges of the distinct vectors (node, class, n, v) of one length."""
    spark = classes.sparkSession
    n_points = min(n_classes, max(MIN_PIVOTS, min(MAX_PIVOTS, math.isqrt(n_classes))))
    points = np.stack([np.frombuffer(r.v) for r in classes.select("v").orderBy(hash63(F.col("class"), "pivots"), "class").limit(n_points).collect()])
    posted = postings(classes, points, nearest)
    long = posted.groupBy("list").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > block).select("list", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # a vector of a long list goes to every pair of blocks that has its own
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(
        F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j"), (F.col("own") > k).cast("int").alias("part")))
    grouped = (posted.join(cut(long, "long"), "list", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", own)
               .withColumn("g", F.explode(pairs)).select("list", "g.i", "g.j", "g.part", "node", "n", "near", "v"))
    dealt = grouped.repartition(tasks_of(spark), "list", "i", "j").sortWithinPartitions("list", "i", "j")
    return verified(dealt, len(points), cosine)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, **options) -> DataFrame:
    """vec_id, n_links, component_id, kept for every vector (vec_id, embedding)."""
    rows = cut(coded(vectors), "vectors")
    # a class has a number of its own, since one id may have several vectors, or be null
    classes = rows.where("class IS NOT NULL").groupBy("class").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("dims").alias("dims"), F.first("v").alias("v"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    found = None
    for r in classes.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).collect():
        own = links(classes.where(F.col("dims") == r["dims"]), r["n"], cosine, **options)
        found = own if found is None else found.unionByName(own)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = cut(found, "links")
    comp = components(found.where("a <> b").select("a", "b"))
    weight = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    named = cut(classes.select("class", "rep", "n", "node").join(comp, "node", "left").join(weight, "node", "left")
                .select("class", "rep", "n", F.coalesce("comp", "node").alias("comp"), F.coalesce("links", F.lit(0)).alias("links")), "named")
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    state = named.join(least, "comp").select("class", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "class").join(state, "class", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.when(F.col("class").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    # a null id is kept where no vector of its component has one
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("vec_id"), F.col("component_id").isNull()))
