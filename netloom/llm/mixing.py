"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Words stand for tokens. Targets come from weights in the order of the source names, limited to a
multiple of what a source has. Blocks go to sources, then to the shards of a source, by the highest
quotients size / (2k + 1); a seeded systematic draw picks the blocks of a shard that its quota takes
once more. Documents stand in a shard in the order of a seeded hash, so the draw is one of documents too.

Null texts have size 0 and nothing is taken; null source names are a source of their own, sorted last.
Repeated rows are separate documents. A table without words yields targets of 0. Other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from netloom.lineage import cut
from netloom.llm.common import WORD, hash63

BLOCK, SEED, DOCS_PER_SHARD, MAX_SHARDS = 64, "mix-1", 4000, 256


def targets(sizes: list[int], weights: list[float], share: float, limit: float) -> list[float]:
    """Weights times one level, none above `limit` times its size, together `share` of all sizes."""
    caps = [limit * s for s in sizes]
    left, weight = share * sum(sizes), sum(weights)
    level = 0.0
    for i in sorted(range(len(sizes)), key=lambda i: (caps[i] / weights[i], i)):
        level = left / weight
        if caps[i] / weights[i] >= level:
            break
        left, weight = left - caps[i], weight - weights[i]
    return [float(min(c, w * level)) for c, w in zip(caps, weights)]


def apportion(votes: list[float], caps: list[int], seats: int) -> list[int]:
    """Seats by the highest quotients votes / (2k + 1), the first of equals first, none above its cap."""
    v, c = np.asarray(votes, float), np.asarray(caps, np.int64)
    seats = min(int(seats), int(c[v > 0].sum()) if len(c) else 0)
    if seats <= 0:
        return [0] * len(v)
    given = lambda d: np.minimum(c, np.floor(v / d + 0.5).astype(np.int64))
    low, high = v.sum() / (seats + len(v)) / 4, 4 * v.sum() / seats + 1
    while given(low).sum() < seats:  # caps can push the divisor far down
        low /= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if given(mid).sum() >= seats else (low, mid)
    out = given(high)  # just too few; the last seats go one by one
    queue = [(-v[i] / (2 * int(out[i]) + 1), i) for i in range(len(v)) if out[i] < c[i] and v[i] > 0]
    heapq.heapify(queue)
    for _ in range(seats - int(out.sum())):
        _, i = heapq.heappop(queue)
        out[i] += 1
        if out[i] < c[i]:
            heapq.heappush(queue, (-v[i] / (2 * int(out[i]) + 1), i))
    return [int(x) for x in out]


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, limit: int = 2, block: int = BLOCK,
        seed: str = SEED, docs_per_shard: int = DOCS_PER_SHARD, max_shards: int = MAX_SHARDS, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, shard and the carried columns of every document.

    The driver sees one row per source and per shard (at most `max_shards` a source), never documents.
    """
    spark = docs.sparkSession
    sized = cut(docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint").alias("size"), *carried), "sized")
    per_source = sorted(sized.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("size")).collect(),
                        key=lambda r: (r.source is None, r.source or ""))
    wanted = targets([r["size"] for r in per_source], [weights[i % len(weights)] for i in range(len(per_source))], share, limit)
    source_schema = "source string, sid int, shards bigint, source_size bigint, target double"
    sources = spark.createDataFrame([(r.source, i, min(max_shards, -(-r.docs // docs_per_shard)), r["size"], t)
                                     for i, (r, t) in enumerate(zip(per_source, wanted))], source_schema)
    placed = sized.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s") \
        .withColumn("h", hash63(F.col("doc_id"), seed)).withColumn("shard", F.col("h") % F.col("shards"))
    shards = sorted(placed.groupBy("sid", "shard").agg(F.sum("size").alias("size")).collect())
    blocks = {(r.sid, r.shard): -(-r["size"] // block) for r in shards}
    room = [sum(limit * n for (s, _), n in blocks.items() if s == i) for i in range(len(per_source))]
    seats = apportion(wanted, room, round(sum(wanted) / block))
    rows = []
    for i in range(len(per_source)):
        own = [r for r in shards if r.sid == i]
        quota = apportion([r["size"] for r in own], [limit * blocks[i, r.shard] for r in own], seats[i])
        for r, q in zip(own, quota):
            n = max(1, blocks[i, r.shard])
            rows.append((i, r.shard, n, q // n, q % n))
    quotas = spark.createDataFrame(rows, "sid int, shard bigint, n bigint, times bigint, more bigint")
    before = W.partitionBy("sid", "shard").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    ranged = (placed.join(quotas, ["sid", "shard"])
              .withColumn("a", F.coalesce(F.sum("size").over(before), F.lit(0)))
              .withColumn("phase", hash63(F.concat_ws("/", "sid", "shard"), seed) % F.col("n"))
              .withColumn("first", F.expr(f"a div {block}")).withColumn("last", F.expr(f"(a + size - 1) div {block}")))
    upto = lambda j: F.expr(f"(({j}) * more + phase) div n")  # noqa: E731 - blocks taken once more before block j
    ranged = ranged.withColumn("in_first", upto("first + 1") - upto("first")).withColumn("in_last", upto("last + 1") - upto("last"))
    once_more = F.when(F.col("size") == 0, 0).when(F.col("first") == F.col("last"), F.col("in_first") * F.col("size")).otherwise(
        F.col("in_first") * ((F.col("first") + 1) * block - F.col("a")) + F.col("in_last") * (F.col("a") + F.col("size") - F.col("last") * block)
        + block * (upto("last") - upto("first + 1")))
    return ranged.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size") + once_more).cast("bigint").alias("taken"),
                         "source", "shard", *carried)


SQL = rf"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
per AS (SELECT source, count(*) AS docs, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
named AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS sid FROM per),
weighed AS (SELECT *, CASE sid % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS cap FROM named),
ordered AS (SELECT *, row_number() OVER o AS pos,
                   (SELECT 1.5::DOUBLE * sum(source_size)::DOUBLE FROM per) - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS remaining,
                   (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS weights
            FROM weighed WINDOW o AS (ORDER BY cap::DOUBLE / weight, sid)),
level AS (SELECT remaining / weights AS mu FROM ordered WHERE cap::DOUBLE / weight >= remaining / weights ORDER BY pos LIMIT 1),
src AS (SELECT source, sid, docs, source_size, least(cap::DOUBLE, weight * mu) AS target, least({MAX_SHARDS}, (docs + {DOCS_PER_SHARD} - 1) // {DOCS_PER_SHARD}) AS shards FROM weighed, level),
placed AS (SELECT d.doc_id, d.size, s.source, s.sid, s.source_size, s.target, ('0x' || substr(md5('{SEED}:' || d.doc_id), 1, 15))::BIGINT AS h, s.shards
           FROM sized d JOIN src s ON d.source IS NOT DISTINCT FROM s.source),
sharded AS (SELECT *, h % shards AS shard FROM placed),
shard AS (SELECT sid, shard, sum(size)::BIGINT AS words, ((sum(size) + {BLOCK} - 1) // {BLOCK})::BIGINT AS blocks FROM sharded GROUP BY sid, shard),
seat_rows AS (SELECT sid, target / (2 * k + 1) AS q FROM (
    SELECT s.sid, s.target, unnest(range((SELECT sum(2 * blocks) FROM shard h WHERE h.sid = s.sid)::BIGINT)) AS k FROM src s)),
seats AS (SELECT sid, count(*) AS seats FROM (SELECT sid, row_number() OVER (ORDER BY q DESC, sid) AS pos FROM seat_rows)
          WHERE pos <= (SELECT round(sum(target) / {BLOCK}) FROM src) GROUP BY sid),
quota_rows AS (SELECT sid, shard, words / (2 * k + 1) AS q FROM (SELECT sid, shard, words::DOUBLE AS words, unnest(range(2 * blocks)) AS k FROM shard)),
quota AS (SELECT sid, shard, count(*) AS q FROM (SELECT sid, shard, row_number() OVER (PARTITION BY sid ORDER BY q DESC, shard) AS pos FROM quota_rows) r
          JOIN seats USING (sid) WHERE pos <= seats GROUP BY sid, shard),
part AS (SELECT sid, shard, greatest(blocks, 1) AS n, coalesce(q, 0) // greatest(blocks, 1) AS times, coalesce(q, 0) % greatest(blocks, 1) AS more,
                ('0x' || substr(md5('{SEED}:' || sid || '/' || shard), 1, 15))::BIGINT % greatest(blocks, 1) AS phase
         FROM shard LEFT JOIN quota USING (sid, shard)),
ranged AS (SELECT d.*, n, times, more, phase,
                  coalesce(sum(size) OVER (PARTITION BY sid, shard ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a
           FROM sharded d JOIN part USING (sid, shard)),
cornered AS (SELECT *, a // {BLOCK} AS f, (a + size - 1) // {BLOCK} AS l FROM ranged)
SELECT doc_id, size, source_size, target, (times * size + CASE WHEN size = 0 THEN 0
    WHEN f = l THEN (((f + 1) * more + phase) // n - (f * more + phase) // n) * size
    ELSE (((f + 1) * more + phase) // n - (f * more + phase) // n) * ((f + 1) * {BLOCK} - a)
       + (((l + 1) * more + phase) // n - (l * more + phase) // n) * (a + size - l * {BLOCK})
       + {BLOCK} * ((l * more + phase) // n - ((f + 1) * more + phase) // n) END)::BIGINT AS taken
FROM cornered"""
