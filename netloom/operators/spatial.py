"""Cell keys for joins of nearby things.

A range join keyed by image alone puts a crowded image into one task. Both sides therefore also
carry square cells: the work of an image spreads over its cells and a row meets only its vicinity.
Images with few rows on every side need no cells: they meet by image, so no row is repeated and what
follows by image needs no other shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, functions as F

from netloom.lineage import count_all, cut

FEW = 256  # rows of an image in one table; more make it a crowded one
_crowds: WeakKeyDictionary = WeakKeyDictionary()


def _crowd(df: DataFrame) -> DataFrame | None:
    found = _crowds.get(df)
    if found is None or found[0] != FEW:
        many = df.groupBy("image_id").agg(count_all().alias("n")).where(F.col("n") > FEW).select("image_id")
        found = _crowds[df] = (FEW, None if many.isEmpty() else cut(many, "crowd"))
    return found[1]


def crowded(*tables: DataFrame) -> DataFrame | None:
    """Images with more than FEW rows in one of the tables, None if there are none. Counted once for each DataFrame."""
    found = [c for c in map(_crowd, tables) if c is not None]
    return reduce(DataFrame.unionByName, found).distinct() if found else None


def settled(df: DataFrame, *of: DataFrame) -> DataFrame:
    """`df`, whose images are crowded where those of the tables it was made of are; nothing where these were not counted."""
    if all(is_settled(o) for o in of):
        _crowds[df] = (FEW, crowded(*of))
    return df


def is_settled(df: DataFrame) -> bool:
    found = _crowds.get(df)
    return found is not None and found[0] == FEW


def counted(df: DataFrame, label: str) -> DataFrame:
    """`df`, written first if its images still have to be counted or some are crowded."""
    return df if is_settled(df) and _crowd(df) is None else cut(df, label)


def split(df: DataFrame, crowd: DataFrame | None, few: Callable, many: Callable) -> DataFrame:
    """`few` over the rows of images that are not crowded, `many` over the others."""
    if crowd is None:
        return few(df)
    return few(df.join(crowd, "image_id", "left_anti")).unionByName(many(df.join(crowd, "image_id", "left_semi")))


def met(a: DataFrame, b: DataFrame, crowd: DataFrame | None, cells_a: Callable, cells_b: Callable) -> DataFrame:
    """Rows of a with all rows of b of their image; in crowded images with those that share a cell of `cells_a` and
    `cells_b`, where a pair must not share more than one."""
    return split(a, crowd, lambda few: few.join(b, "image_id"), lambda many: cells_a(many).join(
        cells_b(b.join(crowd, "image_id", "left_semi")), ["image_id", *CELL]).drop(*CELL))


def laid(df: DataFrame, crowd: DataFrame | None) -> DataFrame:
    """The rows shuffled by image, for all that follows, where no image is crowded."""
    return df.repartition("image_id") if crowd is None else df


def cell(v: Column, size: Column) -> Column:
    return F.floor(v / size).cast("bigint")


def with_cell(df: DataFrame, x: Column, y: Column, size: Column) -> DataFrame:
    """One cell per row: the one holding the point."""
    return df.withColumn("cell_x", cell(x, size)).withColumn("cell_y", cell(y, size))


def with_cells(df: DataFrame, x1: Column, y1: Column, x2: Column, y2: Column, size: Column) -> DataFrame:
    """One row per cell that the rectangle touches."""
    return (df.withColumn("cell_x", F.explode(F.sequence(cell(x1, size), cell(x2, size))))
            .withColumn("cell_y", F.explode(F.sequence(cell(y1, size), cell(y2, size)))))


def with_near_cells(df: DataFrame, x: Column, y: Column, size: Column, reach: Column | None = None) -> DataFrame:
    """One row per cell within `reach` (default one cell) of the point."""
    r = size if reach is None else reach
    return with_cells(df, x - r, y - r, x + r, y + r, size)


CELL = ["cell_x", "cell_y"]
