"""Durations such as ``20ms``, ``1h30m``, ``2mo`` and ``6i`` (index steps)."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Nanoseconds of each unit, months of each calendar unit.
NANOS = {"ns": 1, "us": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9, "d": 86400 * 10**9, "w": 7 * 86400 * 10**9}
MONTHS = {"mo": 1, "q": 3, "y": 12}
_TERM = re.compile(r"(\d+)(mo|ns|us|ms|[smhdwqyi])")
UNITS = {"ns": 1, "us": 10**3, "ms": 10**6, "s": 10**9}


@dataclass(frozen=True)
class Duration:
    months: int = 0
    nanos: int = 0
    index: int = 0

    @property
    def calendar(self) -> bool:
        """Whether it counts months, which have no fixed length."""
        return self.months != 0

    def steps(self, unit: str) -> int:
        """This duration in steps of a key: ``unit`` is ``i`` for integer keys, else a time unit."""
        if self.months:
            raise ValueError("calendar months have no fixed length")
        if unit == "i":
            if self.nanos:
                raise ValueError("a time duration can't step through an integer key")
            return self.index
        if self.index:
            raise ValueError("index steps need an integer key")
        if self.nanos % UNITS[unit]:
            raise ValueError(f"the duration is finer than the key's unit {unit}")
        return self.nanos // UNITS[unit]


def parse(value: str | int | timedelta | Duration) -> Duration:
    if isinstance(value, Duration):
        return value
    if isinstance(value, timedelta):
        return Duration(nanos=(value.days * 86400 + value.seconds) * 10**9 + value.microseconds * 1000)
    if isinstance(value, int):
        return Duration(index=value)
    sign, text = (-1, value[1:]) if value.startswith("-") else (1, value)
    terms = _TERM.findall(text)
    if not terms or "".join(a + b for a, b in terms) != text:
        raise ValueError(f"no duration: {value!r}")
    months = sum(int(n) * MONTHS[u] for n, u in terms if u in MONTHS)
    nanos = sum(int(n) * NANOS[u] for n, u in terms if u in NANOS)
    index = sum(int(n) for n, u in terms if u == "i")
    if bool(index) + bool(months or nanos) > 1:
        raise ValueError(f"index steps and time don't mix: {value!r}")
    return Duration(sign * months, sign * nanos, sign * index)


def key_unit(kind: T.DataType, unit: str | None = None) -> str:
    """The unit that a key column counts in; long keys that hold nanoseconds are named so by ``unit``."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "us"
    return unit or "i"


def key_number(column: Column, kind: T.DataType) -> Column:
    """A key as a number in its unit, whatever the session's time zone is."""
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("long") * 86_400_000_000
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), column)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    return column if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)) else column.cast("long")


def shifted(column: Column, kind: T.DataType, months: Column | int, nanos: int = 0) -> Column:
    """A time or date moved by months (a day that the month lacks becomes its last) and then by a fixed span."""
    if nanos % 1000:
        raise ValueError("a time moves by whole microseconds")
    days, rest = divmod(nanos // 1000, 86_400_000_000)
    months = F.lit(months).cast("int") if isinstance(months, int) else months.cast("int")
    if isinstance(kind, T.DateType):
        if rest:
            raise ValueError("a date moves by whole days")
        return F.date_add(F.add_months(column, months), days)
    return column + F.make_interval(months=months) + F.make_interval(days=F.lit(days), secs=F.lit(rest / 1e6).cast("decimal(18,6)"))
