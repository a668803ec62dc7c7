"""Forward windows of fixed length over a recording's points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import quoted


def with_waypoints(
    df: DataFrame, points: str, output: str, length: int, order: str = "seq", by: Sequence[str] = ("input_id",)
) -> DataFrame:
    """Put ``output`` first: the row's point and the next length - 1 ones along ``order``; near the end the
    last point is repeated. A length of 1 gives lists of one point."""
    if length < 1:
        raise ValueError("a window needs one point at least")
    window = Window.partitionBy(*map(quoted, by)).orderBy(quoted(order)).rowsBetween(0, length - 1)
    held = F.transform(F.collect_list(F.struct(quoted(points).alias("p"))).over(window), lambda s: s["p"])
    padded = df.withColumn("_w", held).withColumn(
        output, F.concat("_w", F.array_repeat(F.element_at("_w", -1), F.lit(length) - F.size("_w")))
    )
    return padded.select(quoted(output), *map(quoted, [c for c in df.columns if c != output]))
