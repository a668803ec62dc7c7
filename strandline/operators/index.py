"""Row numbers: in a recording's own order, and over all rows."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import quoted
from ..session import cut_lineage
from .tree import tree_map


def with_row_index(
    tables: Any, name: str = "_idx_", order: str | Sequence[str] = "seq", by: Sequence[str] = ("input_id",), offset: int = 0, dtype: str = "bigint"
) -> Any:
    """Put a 0-based row number (plus ``offset``) before the columns of each table of a tree.

    Rows are numbered within ``by`` along ``order``, which must tell rows apart for the numbers to be
    determined. Other recordings need no look, so tasks are as many as recordings.
    """
    keys = [order] if isinstance(order, str) else list(order)
    window = Window.partitionBy(*map(quoted, by)).orderBy(*map(quoted, keys))

    def one(df: DataFrame) -> DataFrame:
        return df.select((F.row_number().over(window) - 1 + offset).cast(dtype).alias(name), *map(quoted, df.columns))

    return tree_map(one, tables)


def numbered(df: DataFrame, order: Sequence[str], name: str = "sample_idx") -> DataFrame:
    """Put a global 0-based number along ``order`` (which tells rows apart) without sorting in one task.

    Rows are dealt into ranges of that order, as many as shuffles have partitions or as their bytes ask for,
    sorted there and written once with their place, so a task that runs again later changes nothing. A
    row's number is its place in the range moved by the sizes of the ranges before, a row for each.
    """
    keys = list(map(quoted, order))
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    row = F.struct(*map(quoted, df.columns)).alias("_row")  # apart from the working columns, whatever its names are
    once = cut_lineage(ranged.select(F.monotonically_increasing_id().alias("_place"), row))
    # a place has the range above its 33 lower bits and the row within it in them
    dealt = once.withColumn("_range", F.shiftright("_place", 33))
    sizes = dealt.groupBy("_range").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("_range", before.alias("_start")))
    number = F.col("_start") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    columns = (F.col("_row").getField(c).alias(c) for c in df.columns)
    return dealt.join(starts, "_range").select(number.cast("long").alias(name), *columns)
