"""The dynamic grouping over an endless stream of timed rows: event-time windows with a watermark.

Windows are aligned to the epoch (``start_by="window"``), as a stream has no first row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import quoted
from ..functions.durations import parse
from ..operators.group_dynamic import _field


def group_stream(df: DataFrame, time: str, every: str, period: str | None = None, by: Sequence[str] = ("input_id",), late: str = "1m") -> DataFrame:
    """Lists of every column, in time order, for each window; a window is given once the watermark has passed it."""
    text = lambda d: f"{parse(d).nanos // 1000} microseconds"
    columns = [c for c in df.columns if c not in by]
    window = F.window(quoted(time), text(period or every), text(every))
    held = F.sort_array(F.collect_list(F.struct(quoted(time).alias("_t"), F.struct(*(quoted(c).alias(f"c{i}") for i, c in enumerate(columns))).alias("_v"))))
    grouped = df.withWatermark(time, text(late)).groupBy(*map(quoted, by), window.alias("_w")).agg(held.alias("_l"))
    return grouped.select(*map(quoted, by), F.col("_w.start").alias("window_start"), *(_field("_l", f"c{i}").alias(c) for i, c in enumerate(columns)))
