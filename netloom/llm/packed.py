"""Shuffles of packed numpy columns: a row holds the bytes of many entries that belong to one bucket."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from netloom.lineage import cut, cut_counting, drop_table

Columns = dict[str, np.ndarray]


def schema_of(names: list[str]) -> str:
    return "bucket int, " + ", ".join(f"`{n}` binary" for n in names)


def pack(columns: Columns, key: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of `columns` dealt to buckets by `key`, one row of bytes for each bucket."""
    if not len(key):
        return
    to = ((key.astype(np.uint64) >> np.uint64(16)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(to, kind="stable")
    used, start = np.unique(to[order], return_index=True)
    ends = np.append(start[1:], len(order))
    arrays = [pa.array(used, pa.int32())]
    for c in columns.values():
        c = np.ascontiguousarray(c[order])
        arrays.append(pa.array([c[a:b].tobytes() for a, b in zip(start, ends)], pa.binary()))
    yield pa.RecordBatch.from_arrays(arrays, ["bucket", *columns])


def unpack(batches, kinds: dict[str, type]) -> Columns:
    """All entries of the batches. A task holds its share of the buckets, which the number of partitions sets."""
    parts: dict[str, list] = {n: [] for n in kinds}
    for b in batches:
        for n, kind in kinds.items():
            parts[n] += [np.frombuffer(x.as_buffer(), kind) for x in b.column(n)]
    return {n: np.concatenate(parts[n]) if parts[n] else np.zeros(0, kind) for n, kind in kinds.items()}


def dealt(rows: DataFrame, buckets: int) -> DataFrame:
    """One partition for each bucket."""
    return rows.repartitionById(buckets, F.col("bucket"))


def reduce(rows: DataFrame, buckets: int, kinds: dict[str, type], work: Callable[[Columns], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Meet the entries of each bucket in one task and apply `work` to them."""
    def run(batches):
        columns = unpack(batches, kinds)
        if len(next(iter(columns.values()))):
            yield from work(columns)

    return dealt(rows, buckets).mapInArrow(run, schema)


def small_enough(df: DataFrame, rows: int, limit: int = 1_000_000) -> DataFrame:
    """Broadcast a table of a few narrow columns if its counted rows are at most `limit`; else it is joined by a shuffle."""
    return F.broadcast(df) if rows <= limit else df


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and the smallest node that each reaches by them."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = np.arange(len(nodes))
    x, y = at[:len(a)], at[len(a):]
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) replaced, partition by partition, by a star for each component seen there."""
    def run(batches):
        a, b = [], []
        for x in batches:
            a.append(x.column("a").to_numpy(zero_copy_only=False))
            b.append(x.column("b").to_numpy(zero_copy_only=False))
        if a:
            nodes, roots = forest(np.concatenate(a), np.concatenate(b))
            other = nodes != roots
            yield pa.RecordBatch.from_arrays([pa.array(nodes[other], pa.int64()), pa.array(roots[other], pa.int64())], ["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a bigint, b bigint")


def folded(edges: DataFrame) -> tuple[DataFrame, bool]:
    """Edges contracted until there are at most twice as many as nodes, written; and whether there are any.

    A contraction leaves stars: `a` is a member, `b` the least node it reached there. The stars of all partitions meet
    by member, so what one member joined is contracted in the next round, however many partitions there are. Tasks hold
    no more edges than they get.
    """
    table, last = cut(contracted(edges).distinct(), "edges"), None
    while True:
        n = table.count()
        nodes = table.select("a").unionByName(table.select(F.col("b").alias("a"))).distinct().count()
        if n <= 2 * nodes or (last is not None and n > 0.9 * last):
            return table, n > 0
        smaller = cut(contracted(table.repartition("a")).distinct(), "edges")
        drop_table(table)
        table, last = smaller, n


def components(edges: DataFrame) -> DataFrame:
    """node, comp: the smallest node reachable along edges (a, b), for every node of an edge.

    The contracted edges are walked in rounds: the least label among the neighbours, then the label of that label.
    """
    table, some = folded(edges)
    both = table.unionByName(table.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = table.select("a", "b").unionByName(table.select(F.col("b").alias("a"), "b"))
    labels = cut(labels.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp")), "labels")
    while some:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        stepped = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("step"))
        roots = labels.select(F.col("node").alias("step"), F.col("comp").alias("jump"))
        moved, seen = cut_counting(stepped.join(roots, "step", "left").select("node", F.least("step", F.coalesce("jump", "step")).alias("comp"), "old"),
                                   "labels", moved=F.sum((F.col("comp") < F.col("old")).cast("bigint")))
        drop_table(labels)
        labels, some = moved.drop("old"), bool(seen["moved"])
    return labels
