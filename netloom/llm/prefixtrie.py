"""Trie of the conversations' shared beginnings, by fingerprints that compose.

A conversation c is rebuilt from the first h turns of c - c % 20 and its own turns after the first h. Turns have a hash
of role and text; a sequence of turns has the element (sum of hash * BASE**place, length) of a monoid whose product puts
one sequence behind the other. The element of every rebuilt beginning is the product of the head of the base and a
stretch of the own turns, both read off the running products of the given conversations, so no rebuilt text is made.
Beginnings of equal depth and element are one node. That is verified: turns of equal hash are compared by role and text,
and all members of a node must end in the same turn and have the same parent; by induction over the depth they are then
equal. If a check fails, everything is done again with other hashes.

Conversations may be of any length: turns are laid out by ranges of (conv_id, turn), a running product starts anew in
each range and is completed by the products of the ranges before. Sums over subtrees need no walk: a node belongs to its
smallest member, the nodes of a member are the lower end of its path, and a subtree consists of the nodes that belong
to its members, cut at the top for the smallest one. Conversation ids at a node are joined range by range; only the
hash itself, which must be taken in order, streams these pieces through one task.

Turns are ordered by turn (null first), rows of equal turn by role, then text; null role and text are empty. Rows
without conv_id are dropped. An empty table has no nodes. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from netloom.lineage import count_all, cut, cut_counting
from netloom.llm.common import BASE, MIX_B, WORD, map_arrow, mixed, tasks_of

FAMILY, HEADS, BLOCK, PIECE = 20, 4, 4096, 1 << 16
BASES = (BASE, MIX_B)
INVERSE = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in BASES)
KEY = ["depth", "f1", "f2"]


def power(base: np.uint64, n: np.ndarray) -> np.ndarray:
    """base**n modulo 2**64 for each n."""
    out, left, square = np.ones(len(n), np.uint64), n.astype(np.uint64), np.full(len(n), base)
    while left.any():
        out = np.where(left & np.uint64(1), out * square, out)
        square, left = square * square, left >> np.uint64(1)
    return out


def joined(h1: np.ndarray, n1: np.ndarray, h2: np.ndarray, base: np.uint64) -> np.ndarray:
    """Element of a sequence (h1, n1) with another one behind it."""
    return h1 + power(base, n1) * h2


def column(b, name: str, kind=np.uint64) -> np.ndarray:
    return b.column(name).to_numpy(zero_copy_only=False).astype(np.int64).view(kind)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def turns_of(conversations: DataFrame, seed: int) -> DataFrame:
    """conv, turn, role, text, two hashes of the turn, its number of words."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv"), "turn", role.alias("role"), text.alias("text")).where("conv IS NOT NULL")
    return rows.withColumns({"t1": F.xxhash64(F.lit(2 * seed), "role", "text"), "t2": F.xxhash64(F.lit(2 * seed + 1), "text", "role"),
                             "words": F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).cast("bigint")})


def colliding(turns: DataFrame) -> bool:
    """Whether different turns have the same hashes."""
    same = turns.groupBy("t1", "t2").agg(count_all().alias("n"), *(f(c).alias(f"{f.__name__}_{c}") for c in ("role", "text") for f in (F.min, F.max)))
    return not same.where("n > 1 AND (min_role <> max_role OR min_text <> max_text)").isEmpty()


def laid_out(turns: DataFrame) -> DataFrame:
    """conv, part, k (place in the part), t1, t2, words, s1, s2 (product of the turns of the part up to this one)."""
    ranged = turns.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(tasks_of(turns.sparkSession), "conv", "turn", "role", "text", "row") \
        .sortWithinPartitions("conv", "turn", "role", "text").select("conv", F.spark_partition_id().alias("part"), "t1", "t2", "words")

    def run(batches):
        last, count, carry = None, 0, [np.uint64(0)] * 2
        for b in batches:
            if not b.num_rows:
                continue
            conv = column(b, "conv", np.int64)
            new = np.concatenate([[last is None or conv[0] != last], conv[1:] != conv[:-1]])
            begin = np.maximum.accumulate(np.where(new, np.arange(len(conv)), 0))
            first = ~new[begin]  # rows that go on with the conversation of the batch before
            k = np.arange(len(conv)) - begin + np.where(first, count, 0)
            out = []
            for lane, base in enumerate(BASES):
                own = mixed(column(b, f"t{lane + 1}")) * power(base, k)
                total = np.cumsum(own, dtype=np.uint64)
                out.append(total - (total - own)[begin] + np.where(first, carry[lane], np.uint64(0)))
                carry[lane] = out[lane][-1]
            last, count = conv[-1], int(k[-1]) + 1
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("conv", "part")), pa.array(k), *(b.column(n) for n in ("t1", "t2", "words")), *map(signed, out)],
                                             ["conv", "part", "k", "t1", "t2", "words", "s1", "s2"])

    return cut(map_arrow(ranged, run, "conv bigint, part int, k bigint, t1 bigint, t2 bigint, words bigint, s1 bigint, s2 bigint"), "turns")


def offsets(laid: DataFrame) -> DataFrame:
    """conv, part, o (turns before the part), o1, o2 (their product), n (turns of the part): few rows for a conversation."""
    last = F.max(F.struct("k", "s1", "s2"))
    pieces = laid.groupBy("conv", "part").agg(last.alias("last")).select("conv", "part", (F.col("last.k") + 1).alias("n"), "last.s1", "last.s2")

    def run(batches):
        name, at, before = None, 0, [0, 0]
        for b in batches:
            rows = []
            for conv, part, n, *own in zip(*(b.column(c).to_pylist() for c in ("conv", "part", "n", "s1", "s2"))):
                if conv != name:
                    name, at, before = conv, 0, [0, 0]
                rows.append((conv, part, at, *before, n))
                before = [_wrapped(x + pow(int(base), at, 1 << 64) * s) for x, s, base in zip(before, own, BASES)]
                at += n
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["conv", "part", "o", "o1", "o2", "n"]).cast(_OFFSETS)

    return cut(pieces.repartition("conv").sortWithinPartitions("conv", "part").mapInArrow(run, "conv bigint, part int, o bigint, o1 bigint, o2 bigint, n bigint"), "offsets")


_OFFSETS = pa.schema([("conv", pa.int64()), ("part", pa.int32()), *((n, pa.int64()) for n in ("o", "o1", "o2", "n"))])


def _wrapped(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def heads_of(laid: DataFrame, starts: DataFrame) -> DataFrame:
    """conv, d, f1, f2 (product of the first d turns), t1, t2, words (of turn d): for the first turns of conversations."""
    rows = laid.where(F.col("k") < HEADS - 1).join(starts, ["conv", "part"]).where(F.col("k") + F.col("o") < HEADS - 1)

    def run(batches):
        for b in batches:
            o = column(b, "o", np.int64)
            f = [joined(column(b, f"o{i}"), o, column(b, f"s{i}"), base) for i, base in zip((1, 2), BASES)]
            yield pa.RecordBatch.from_arrays([b.column("conv"), pa.array(o + column(b, "k", np.int64) + 1), *map(signed, f), *(b.column(n) for n in ("t1", "t2", "words"))],
                                             ["conv", "d", "f1", "f2", "t1", "t2", "words"])

    return cut(rows.mapInArrow(run, "conv bigint, d bigint, f1 bigint, f2 bigint, t1 bigint, t2 bigint, words bigint"), "heads")


def plans_of(starts: DataFrame, heads: DataFrame) -> DataFrame:
    """conv, h, hb (turns taken from the base), b1, b2 (their product), g1, g2 (product of the own turns left out), total."""
    crc = F.crc32(F.col("conv").cast("string").cast("binary"))
    sized = starts.groupBy("conv").agg(F.sum("n").alias("n")).withColumns({"h": crc % HEADS, "base": F.col("conv") - F.col("conv") % FAMILY})
    bases = sized.select(F.col("conv").alias("base"), F.col("n").alias("nb"))
    taken = sized.join(bases, "base", "left").withColumn("hb", F.least("h", F.coalesce("nb", F.lit(0).cast("bigint"))))
    at = lambda name, d: heads.select(F.col("conv").alias(name), F.col("d").alias(d), F.col("f1").alias(f"{name}_1"), F.col("f2").alias(f"{name}_2"))
    with_heads = taken.join(at("base", "hb"), ["base", "hb"], "left").join(at("conv", "h"), ["conv", "h"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    return cut(with_heads.select("conv", "base", "h", "hb", zero("base_1").alias("b1"), zero("base_2").alias("b2"), zero("conv_1").alias("g1"), zero("conv_2").alias("g2"),
                                 (F.col("hb") + F.greatest(F.col("n") - F.col("h"), F.lit(0).cast("bigint"))).alias("total")), "plans")


PATH = "conv bigint, depth bigint, f1 bigint, f2 bigint, p1 bigint, p2 bigint, t1 bigint, t2 bigint, words bigint, last boolean"


def paths_of(laid: DataFrame, starts: DataFrame, heads: DataFrame, plans: DataFrame) -> DataFrame:
    """One row for each rebuilt conversation and depth: element of the beginning and of the one before, hashes and words
    of its last turn, and whether the conversation ends there."""
    own = laid.join(starts.drop("n").join(plans, "conv"), ["conv", "part"]).where(F.col("k") + F.col("o") >= F.col("h"))

    def run(batches):
        for b in batches:
            place = column(b, "k", np.int64) + column(b, "o", np.int64)
            h, hb = column(b, "h", np.int64), column(b, "hb", np.int64)
            depth, f, p = place - h + hb + 1, [], []
            for i, base, inverse in zip((1, 2), BASES, INVERSE):
                whole = joined(column(b, f"o{i}"), column(b, "o", np.int64), column(b, f"s{i}"), base)
                stretch = (whole - column(b, f"g{i}")) * power(inverse, h)  # the own turns from h on
                f.append(joined(column(b, f"b{i}"), hb, stretch, base))
                p.append(f[-1] - mixed(column(b, f"t{i}")) * power(base, depth - 1))
            yield pa.RecordBatch.from_arrays([b.column("conv"), pa.array(depth), *map(signed, [*f, *p]), *(b.column(n) for n in ("t1", "t2", "words")), pa.array(depth == column(b, "total", np.int64))],
                                             ["conv", "depth", "f1", "f2", "p1", "p2", "t1", "t2", "words", "last"])

    before = heads.select("conv", (F.col("d") + 1).alias("d"), F.col("f1").alias("p1"), F.col("f2").alias("p2"))
    zero = F.lit(0).cast("bigint")
    head = heads.join(before, ["conv", "d"], "left").withColumns({"p1": F.coalesce("p1", zero), "p2": F.coalesce("p2", zero)}).withColumnRenamed("conv", "base")
    taken = plans.join(head, "base").where("d <= hb").select("conv", F.col("d").alias("depth"), "f1", "f2", "p1", "p2", "t1", "t2", "words", (F.col("d") == F.col("total")).alias("last"))
    return taken.unionByName(own.mapInArrow(run, PATH))


def grouped(paths: DataFrame) -> tuple[DataFrame, bool]:
    """Nodes with conv_id, n_convs, element of the parent and saved (own share); and whether all members agree."""
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("p1", "p2", "t1", "t2") for f in (F.min, F.max)]
    found = paths.groupBy(*KEY).agg(F.min("conv").alias("conv_id"), count_all().alias("n_convs"), F.max("words").alias("words"), *ends)
    agree = F.lit(True)
    for c in ("p1", "p2", "t1", "t2"):
        agree = agree & (F.col(f"min_{c}") == F.col(f"max_{c}"))
    nodes, seen = cut_counting(found.select(*KEY, "conv_id", "n_convs", F.col("min_p1").alias("p1"), F.col("min_p2").alias("p2"), ((F.col("n_convs") - 1) * F.col("words")).alias("own"), agree.alias("agree")),
                               "nodes", odd=F.sum((~F.col("agree")).cast("bigint")))
    return nodes.drop("agree"), not seen["odd"]


def suffix_sums(nodes: DataFrame) -> DataFrame:
    """conv_id, depth, below: sum of `own` over the nodes of the same smallest member from this depth down, in blocks of
    depths, so that a long path is no single window."""
    rows = nodes.where("n_convs > 1").select("conv_id", "depth", "own", F.floor(F.col("depth") / BLOCK).alias("block"))
    blocks = rows.groupBy("conv_id", "block").agg(F.sum("own").alias("sum"))
    later = W.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    after = blocks.select("conv_id", "block", F.coalesce(F.sum("sum").over(later), F.lit(0)).alias("after"))
    inner = W.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("inner", F.sum("own").over(inner)).join(after, ["conv_id", "block"]).select("conv_id", "depth", (F.col("inner") + F.col("after")).alias("below"))


def ends_of(ends: DataFrame) -> DataFrame:
    """Key of a node and ends_sha256 of the ids of conversations that end there. ends: key, conv."""
    laid = ends.repartitionByRange(tasks_of(ends.sparkSession), *KEY, "conv").sortWithinPartitions(*KEY, "conv")

    def pieces(batches):
        name, held, size, first = None, [], 0, None
        out = []

        def flush():
            out.append((*name, first, ",".join(held)))

        for b in batches:
            for *key, conv in zip(*(b.column(c).to_pylist() for c in [*KEY, "conv"])):
                if key != name or size > PIECE:
                    if name is not None:
                        flush()
                    name, held, size, first = key, [], 0, conv
                held.append(str(conv))
                size += len(held[-1]) + 1
            if out:
                yield batch(out)
                out.clear()
        if name is not None:
            flush()
            yield batch(out)

    def batch(rows):
        *numbers, texts = zip(*rows)
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in numbers), pa.array(texts)], [*KEY, "first", "ids"])

    def hashed(batches):
        name, state = None, None
        for b in batches:
            out = []
            for *key, ids in zip(*(b.column(c).to_pylist() for c in [*KEY, "ids"])):
                if key != name:
                    if name is not None:
                        out.append((*name, state.hexdigest()))
                    name, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield result(out)
        if name is not None:
            yield result([(*name, state.hexdigest())])

    def result(rows):
        *numbers, texts = zip(*rows)
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in numbers), pa.array(texts)], [*KEY, "ends_sha256"])

    key = ", ".join(f"{k} bigint" for k in KEY)
    parts = laid.mapInArrow(pieces, f"{key}, first bigint, ids string")
    return parts.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(hashed, f"{key}, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    for seed in range(8):
        turns = turns_of(conversations, seed)
        if colliding(turns):
            continue
        laid = laid_out(turns)
        starts = offsets(laid)
        heads = heads_of(laid, starts)
        plans = plans_of(starts, heads)
        paths = cut(paths_of(laid, starts, heads, plans), "paths")
        nodes, agree = grouped(paths)
        if agree:
            break
    else:
        raise RuntimeError("fingerprints collide with every seed")
    zero = F.lit(0).cast("bigint")
    root = plans.agg(F.min("conv").alias("conv_id"), count_all().alias("n_convs")).where("n_convs > 0")
    root = root.select(*(zero.alias(k) for k in KEY), "conv_id", "n_convs", zero.alias("p1"), zero.alias("p2"), zero.alias("own"))
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2")).agg(count_all().alias("n_children"))
    nodes = cut(nodes.unionByName(root).join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", zero)), "nodes")
    # what belongs to each smallest member: saved tokens of its nodes, and whether its last node has no children
    owned = nodes.groupBy(F.col("conv_id").alias("conv")).agg(F.sum("own").alias("owned"), F.sum((F.col("n_children") == 0).cast("bigint")).alias("leaf"))
    of_conv = cut(plans.select("conv", "total").join(owned, "conv", "left").select("conv", "total", F.coalesce("owned", zero).alias("owned"), F.coalesce("leaf", zero).alias("leaf")), "owned")
    # a path of any length meets the numbers of its conversation block by block
    blocked = of_conv.withColumn("block", F.explode(F.sequence(zero, F.floor(F.col("total") / BLOCK)))).drop("total")
    members = paths.select("conv", *KEY, F.floor(F.col("depth") / BLOCK).alias("block")).join(blocked, ["conv", "block"])
    sums = members.groupBy(*KEY).agg(F.sum("owned").alias("members_saved"), F.sum("leaf").alias("n_leaves"))
    at_root = of_conv.agg(F.sum("owned").alias("members_saved"), F.sum("leaf").alias("n_leaves")).select(*(zero.alias(k) for k in KEY), "members_saved", "n_leaves")
    ends = paths.where("last").select(*KEY, "conv").unionByName(plans.where("total = 0").select(*(zero.alias(k) for k in KEY), "conv"))
    mine = of_conv.select(F.col("conv").alias("conv_id"), "owned")
    full = (nodes.join(sums.unionByName(at_root), KEY).join(mine, "conv_id").join(suffix_sums(nodes), ["conv_id", "depth"], "left")
            .join(ends_of(ends), KEY, "left"))
    saved = F.col("members_saved") - F.col("owned") + F.coalesce("below", zero)
    full = cut(full.select(*KEY, "conv_id", "p1", "p2", "n_convs", "n_children", "n_leaves", saved.cast("bigint").alias("saved_tokens"),
                           F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")), "trie")
    # children meet their parent; one with many children is split by the skew join of the adaptive plan, and the root by a constant
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("conv_id").alias("parent_conv_id")).where("depth > 1")
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    top = root.select(F.col("conv_id").alias("parent_conv_id"))
    deep = full.where("depth > 1").join(parents, ["depth", "p1", "p2"]).select(out)
    shallow = full.where("depth = 1").crossJoin(F.broadcast(top)).select(out)  # one row
    return deep.unionByName(shallow).unionByName(full.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("bigint")).select(out))


SQL = r"""
WITH RECURSIVE step(i, k, c) AS (SELECT i, 0, i::BIGINT FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
rows_ AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
digits AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base, conv_id::VARCHAR AS s FROM rows_),
crc(conv_id, base, s, i, c) AS (SELECT conv_id, base, s, 0, 4294967295 FROM digits
  UNION ALL SELECT conv_id, base, s, i + 1, xor(c >> 8, (SELECT t FROM tab)[(xor(c, ascii(substr(s, i + 1, 1))) & 255) + 1]) FROM crc WHERE i < length(s)),
conv AS (SELECT conv_id, base, (xor(c, 4294967295) % 4) AS h FROM crc WHERE i = length(s)),
heads AS (SELECT c.conv_id, r.pos AS depth, r.role, r.text FROM conv c JOIN rows_ r ON r.conv_id = c.base AND r.pos <= c.h),
got AS (SELECT c.conv_id, c.h, count(d.depth) AS hb FROM conv c LEFT JOIN heads d USING (conv_id) GROUP BY ALL),
built AS (SELECT * FROM heads UNION ALL SELECT g.conv_id, r.pos - g.h + g.hb, r.role, r.text FROM got g JOIN rows_ r ON r.conv_id = g.conv_id AND r.pos > g.h),
path AS MATERIALIZED (SELECT conv_id, depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
  sha256(string_agg(length(role) || ':' || length(text) || ':' || role || text, '' ) OVER (PARTITION BY conv_id ORDER BY depth)) AS node,
  depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM built
  UNION ALL SELECT conv_id, 0, 0, '', conv_id NOT IN (SELECT conv_id FROM built) FROM conv),
node AS MATERIALIZED (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(words) AS own,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM path GROUP BY ALL),
edge AS MATERIALIZED (SELECT DISTINCT p.node AS parent, q.node FROM path p JOIN path q ON q.conv_id = p.conv_id AND q.depth = p.depth + 1),
kids AS (SELECT parent AS node, count(*) AS n_children FROM edge GROUP BY ALL),
below AS (SELECT DISTINCT p.node AS top, q.node FROM path p JOIN path q ON q.conv_id = p.conv_id AND q.depth >= p.depth),
subtree AS (SELECT b.top AS node, sum(n.own) AS saved_tokens, count(*) FILTER (k.node IS NULL) AS n_leaves FROM below b JOIN node n USING (node) LEFT JOIN kids k USING (node) GROUP BY ALL)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM node n JOIN subtree s USING (node) LEFT JOIN kids k USING (node) LEFT JOIN edge e ON e.node = n.node LEFT JOIN node p ON p.node = e.parent"""
