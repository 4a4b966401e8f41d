"""Joining rows to one text per group, as the file formats want it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def joined(df: DataFrame, keys: list[str], order: list[str], value: str, sep: str, out: str) -> DataFrame:
    """One text per group, rows in order. The rows themselves are the form for anything but writing."""
    packed = F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(packed, lambda x: x["_v"]), sep).alias(out))
