"""Helpers shared by the corpus operators."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


ROWS_PER_BATCH = 1000


def small_batches(spark: SparkSession) -> None:
    """Let Python get ROWS_PER_BATCH rows at once at most, since texts are long; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ROWS_PER_BATCH:
        spark.conf.set(name, str(ROWS_PER_BATCH))


def map_arrow(df: DataFrame, work, schema) -> DataFrame:
    """mapInArrow in small batches."""
    small_batches(df.sparkSession)
    return df.mapInArrow(work, schema)


def tasks_of(spark: SparkSession, at_least: int = 1) -> int:
    """Partitions for a shuffle whose rows the caller has packed itself."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), at_least)


def hash63(column, seed: str):
    """Fifteen hexadecimal digits of an MD5 as a number: the same here and in other SQL engines."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(column.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def sliced(batches, rows: int = 256):
    """Arrow batches in slices of a few rows, so that what Python makes of long texts stays small."""
    for b in batches:
        for at in range(0, max(b.num_rows, 1), rows):
            yield b.slice(at, rows)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def utf8(text: str | None) -> np.ndarray:
    """Bytes of a text as an array; null is empty."""
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# odd multipliers of a 64-bit polynomial hash (fixed values)
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n at least, kept between calls."""
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << max(10, math.ceil(math.log2(n)))
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        grow = lambda b: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))])
        _powers, _inverses = grow(BASE), grow(inverse)
    return _powers[:n], _inverses[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = sum of values[i:j] * BASE**position, for hashes of any stretch."""
    p, _ = powers(len(values) + 1)
    h = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * p[:len(values)], out=h[1:])
    return h


def stretch_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each stretch [start, end), the same wherever it stands."""
    _, inv = powers(len(h))
    n = (end - start).astype(np.uint64)
    return mixed((h[end] - h[start]) * inv[start] + n * MIX_B)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return edge[0::2], edge[1::2]


def not_space(data: np.ndarray) -> np.ndarray:
    """True at bytes of words [^\\x20\\x09-\\x0D]+ in UTF-8."""
    return (data != 32) & ((data < 9) | (data > 13))


def word_hashes(data: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes, starts and ends (bytes) of the words that `mask` marks."""
    start, end = runs(mask)
    if not len(start):
        return np.zeros(0, np.uint64), start, end
    return stretch_hash(prefix_hash(data.astype(np.uint64) + np.uint64(1)), start, end), start, end
