"""Tumbling and sliding windows over an ordered key, each collected into lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import gather_every as thin
from ..functions.columns import quoted
from ..functions.durations import NANOS, Duration, key_number, key_unit, parse, shifted

WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
_WEEK_US, _MONDAY_US = 7 * 86_400_000_000, 4 * 86_400_000_000  # 1970-01-05 was a Monday


def floor_div(a: Column, b: int) -> Column:
    """Quotient rounded towards minus infinity, in integers."""
    return (a - F.pmod(a, F.lit(b))).cast("long") / F.lit(b)


def _quotient(a: Column, b: int, up: bool) -> Column:
    lower = F.floor(floor_div(a, b)).cast("long")
    return lower + F.when(F.pmod(a, F.lit(b)) != 0, 1).otherwise(0) if up else lower


def window_bounds(d: Column, every: int, period: int, closed: str) -> tuple[Column, Column]:
    """The first and last number of the windows [i * every, i * every + period] that hold an offset ``d``."""
    low = _quotient(d - period, every, True) if closed in ("right", "both") else _quotient(d - period, every, False) + 1
    high = _quotient(d, every, False) if closed in ("left", "both") else _quotient(d, every, True) - 1
    return low, high


def month_number(column: Column) -> Column:
    """Months since January of year 0 of a date or time."""
    return F.year(column).cast("long") * 12 + F.month(column) - 1


def calendar_windows(rows: DataFrame, column: Column, first: Column, kind, every: Duration, period: Duration, closed: str, start_by: str) -> DataFrame:
    """``rows`` once for each window ``_w`` that holds them, of windows that begin whole months apart.

    Window i begins at ``first`` moved by i times ``every`` and ends where ``first`` moved by the months of both
    and then by the rest of ``period`` is, so windows as long as their steps leave no gap. Bounds are instants, so the candidates by month
    numbers, a few for each row, are held against them; months differ in length, so they can't be divided.
    """
    if every.nanos or period.months <= 0 and period.nanos <= 0:
        raise ValueError("windows by months begin whole months apart and have a positive length")
    span = period.months + period.nanos // NANOS["d"] // 28 + 2  # months that a window can touch
    at = (month_number(column) - month_number(first)) / F.lit(every.months)
    low = F.floor(at - F.lit(span / every.months)).cast("long")
    low = F.greatest(low, F.lit(0).cast("long")) if start_by != "window" else low
    high = F.floor(at).cast("long") + 1
    rows = rows.withColumns({"_f": first, "_low": low, "_high": high}).where("_low <= _high").withColumn("_w", F.explode(F.sequence("_low", "_high")))
    months = (F.col("_w") * every.months).cast("int")
    rows = rows.withColumns({"_s": shifted(F.col("_f"), kind, months), "_e": shifted(F.col("_f"), kind, months + period.months, period.nanos)})
    after = column >= F.col("_s") if closed in ("left", "both") else column > F.col("_s")
    before = column <= F.col("_e") if closed in ("right", "both") else column < F.col("_e")
    return rows.where(after & before).drop("_f", "_low", "_high", "_s", "_e")


def _field(rows: str, name: str) -> Column:
    return F.transform(rows, lambda s: s["_v"][name])


def group_dynamic(
    df: DataFrame,
    index_column: str,
    every: str | int,
    period: str | int | None = None,
    group_by: Sequence[str] = (),
    closed: str = "left",
    label: str = "datapoint",
    start_by: str = "datapoint",
    include_boundaries: bool = False,
    gather_every: int | Mapping[str, int] | None = None,
    order: str | None = None,
    unit: str | None = None,
) -> DataFrame:
    """One row per window that holds a row, every column but ``group_by`` a list in key order.

    Windows start ``every`` apart and are ``period`` long (default: ``every``); both may count calendar
    months (``1mo``, ``1q``, ``1y``) where the key is a date or time. ``start_by``: the group's
    first key (no window starts before it), the key's epoch (``window``) or a weekday. ``label`` and
    ``include_boundaries`` are accepted for the sake of callers and change nothing, as labels aren't part
    of the result. ``gather_every`` n keeps every n-th element of the lists; a mapping does so for its
    columns, which then come last. Nulls stay in the lists. Rows with a null key belong to no window.
    Windows whose ``every`` equals ``period`` need no copies of rows; else a row is copied to each of its
    windows. The start is a minimum over the group, so rows are shuffled once, by ``group_by``.
    """
    if closed not in ("left", "right", "both", "none"):
        raise ValueError(f"no such way to close a window: {closed}")
    if label not in ("left", "right", "datapoint"):
        raise ValueError(f"no such label: {label}")
    if start_by not in ("datapoint", "window", *WEEKDAYS):
        raise ValueError(f"no such start: {start_by}")
    kind = df.schema[index_column].dataType
    unit = key_unit(kind, unit)
    spans = parse(every), parse(period if period is not None else every)
    by_months = any(d.calendar for d in spans)
    if by_months:
        if not isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            raise ValueError("months need a key of dates or times")
        if spans[0].months <= 0 or start_by in WEEKDAYS:
            raise ValueError("windows by months begin a positive number of months apart, from the first key or the epoch")
        step = length = 0
    else:
        step, length = (d.steps(unit) for d in spans)
        if step <= 0 or length <= 0:
            raise ValueError("windows need positive steps and lengths")
    columns = [c for c in df.columns if c not in group_by]
    k = key_number(quoted(index_column), kind)
    rows = df.withColumns({"_k": k, "_tie": quoted(order) if order else F.xxhash64(*map(quoted, df.columns))}).where("_k IS NOT NULL")
    if by_months and start_by == "window":
        rows = rows.withColumn("_first", F.lit("1970-01-01").cast(kind))
    elif by_months:
        first = F.min(quoted(index_column))
        if group_by:
            rows = rows.withColumn("_first", first.over(Window.partitionBy(*map(quoted, group_by))))
        else:
            rows = rows.join(F.broadcast(rows.agg(first.alias("_first"))))
    elif start_by == "window":
        rows = rows.withColumn("_first", F.lit(0).cast("long"))
    elif group_by:
        rows = rows.withColumn("_first", F.min("_k").over(Window.partitionBy(*map(quoted, group_by))))
    else:  # one row with the least key
        rows = rows.join(F.broadcast(rows.agg(F.min("_k").alias("_first"))))
    if start_by in WEEKDAYS:
        shift = _MONDAY_US + WEEKDAYS.index(start_by) * 86_400_000_000
        rows = rows.withColumn("_first", F.col("_first") - F.pmod(F.col("_first") - shift, F.lit(_WEEK_US)))
    low = high = None
    if not by_months:
        low, high = window_bounds(F.col("_k") - F.col("_first"), step, length, closed)
        if start_by != "window":
            low = F.greatest(low, F.lit(0).cast("long"))
    if by_months:
        rows = calendar_windows(rows, quoted(index_column), F.col("_first"), kind, *spans, closed, start_by)
    elif step == length and closed == "left":
        rows = rows.withColumn("_w", high)
    else:
        rows = rows.withColumns({"_low": low, "_high": high}).where("_low <= _high").withColumn("_w", F.explode(F.sequence("_low", "_high")))
    collected = F.sort_array(F.collect_list(F.struct("_k", "_tie", F.struct(*(quoted(c).alias(f"c{i}") for i, c in enumerate(columns))).alias("_v"))))
    grouped = rows.groupBy(*map(quoted, group_by), "_w").agg(collected.alias("_l"))
    lists = {c: _field("_l", f"c{i}") for i, c in enumerate(columns)}
    if isinstance(gather_every, Mapping):
        lists = {c: v for c, v in lists.items() if c not in gather_every} | {c: thin(lists[c], n) for c, n in gather_every.items()}
    elif gather_every is not None:
        lists = {c: thin(v, gather_every) for c, v in lists.items()}
    return grouped.select(*map(quoted, group_by), *(v.alias(c) for c, v in lists.items()))
