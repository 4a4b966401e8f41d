"""Row numbers that survive hot groups.

A window puts a whole group into one task. `SkewGuard` finds the groups above a row limit (one
map-side-combined count); those few are numbered by range partitions with offsets, all others by
the ordinary window. Without hot groups the plan is the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from netloom.lineage import cut

HOT_ROWS = 2_000_000


class SkewGuard:
    """Lazily found keys of `df` that hold more than `limit` rows; None when there are none."""

    def __init__(self, df: DataFrame, keys: list[str], limit: int | None = None):
        self.df, self.keys, self.limit = df, keys, limit
        self._done, self._hot = False, None

    def renamed(self, key: str) -> SkewGuard:
        """The same groups for a table that names the (only) key differently."""
        other = SkewGuard(self.df.withColumnRenamed(self.keys[0], key), [key], self.limit)
        other._hot, other._done = None if self.hot is None else self.hot.withColumnRenamed(self.keys[0], key), True
        return other

    @property
    def hot(self) -> DataFrame | None:
        if not self._done:
            limit = HOT_ROWS if self.limit is None else self.limit
            hot = (self.df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("_n"))
                   .where(F.col("_n") > limit).select(*self.keys))
            self._hot = None if hot.isEmpty() else cut(hot, "hot")
            self._done = True
        return self._hot


def _ranged(df: DataFrame, keys: list[str], order: list, out: str) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(k) if isinstance(k, str) else k for k in [*keys, *order]]
    laid = cut(df.repartitionByRange(parts, *by).withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = laid.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_size"))
    # at most one row per (hot key, partition): small whatever the data
    before = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy("_part")
    starts = sizes.select(*keys, "_part", F.coalesce(
        F.sum("_size").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    inner = W.partitionBy(*keys, "_part").orderBy(*order)
    return (laid.withColumn("_pos", F.row_number().over(inner))
            .join(starts, [*keys, "_part"])
            .withColumn(out, F.col("_start") + F.col("_pos"))
            .drop("_part", "_start", "_pos"))


def row_number(df: DataFrame, keys: list[str], order: list, out: str, start: int = 1,
               guard: SkewGuard | None = None) -> DataFrame:
    """Position of each row in its group by `order`, beginning at `start`."""
    guard = guard or SkewGuard(df, keys)
    shift = F.lit(start - 1).cast("bigint")
    plain = F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("bigint") + shift
    hot = guard.hot
    if hot is None:
        return df.withColumn(out, plain)
    cold_rows = df.join(hot, guard.keys, "left_anti").withColumn(out, plain)
    hot_rows = _ranged(df.join(hot, guard.keys, "left_semi"), keys, order, out)
    return cold_rows.unionByName(hot_rows.withColumn(out, F.col(out) + shift))


def global_number(df: DataFrame, order: list, out: str, start: int = 1) -> DataFrame:
    """Running number over the whole table, by range partitions plus offsets."""
    return _ranged(df, [], order, out).withColumn(out, F.col(out) + F.lit(start - 1))


def cutoff_value(df: DataFrame, digest: Column, k: int) -> str | None:
    """The k-th smallest hex digest, found by histograms over growing prefixes.

    Only counts per prefix (16^3 per step) reach the driver; the prefix of full width is the answer.
    """
    if k <= 0:
        return None
    data, prefix, left = df.select(digest.alias("_h")), "", k
    while True:
        inside = data.where(F.col("_h").startswith(prefix)) if prefix else data
        bins = sorted((r["p"], r["n"], r["top"]) for r in inside.groupBy(F.substring("_h", 1, len(prefix) + 3).alias("p"))
                      .agg(F.count(F.lit(1)).alias("n"), F.max("_h").alias("top")).collect())
        for p, n, top in bins:
            if left <= n:
                break
            left -= n
        else:
            return None
        if left == n or p == top:  # the last of its prefix, or a whole digest
            return top
        prefix = p
