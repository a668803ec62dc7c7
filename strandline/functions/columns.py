"""Column helpers: fixed arrays, thinning, categories, physical values, null tests."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> Column:
    """A column by its literal name: qualified names hold slashes and dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def fixed_array(column: Column, element: str, *sizes: int) -> Column:
    """Cast to an array of fixed sizes (outermost first); another length is an error, null stays null."""
    kind = element
    for _ in sizes:
        kind = f"array<{kind}>"
    checked = F.when(_sized(column, sizes), column).otherwise(
        F.raise_error(F.concat(F.lit(f"cannot cast a list to an array of {'x'.join(map(str, sizes))}: length "), F.size(column).cast("string")))
    )
    return F.when(column.isNull(), F.lit(None)).otherwise(checked).cast(kind)


def _sized(column: Column, sizes: Sequence[int]) -> Column:
    here = F.size(column) == sizes[0]
    return here & F.forall(column, lambda x: _sized(x, sizes[1:])) if len(sizes) > 1 else here


def gather_every(column: Column, n: int) -> Column:
    """Every n-th element of an array, from the first on."""
    return F.filter(column, lambda _, i: i % n == 0)


def category(column: Column, categories: Sequence[str]) -> Column:
    """The string itself where it is one of the categories or null; an error otherwise."""
    known = F.array(*map(F.lit, categories))
    return F.when(column.isNull() | F.array_contains(known, column), column).otherwise(
        F.raise_error(F.concat(F.lit("no such category: "), column))
    )


def code(column: Column, categories: Sequence[str]) -> Column:
    """The 0-based place of a category; null for null."""
    return (F.array_position(F.array(*map(F.lit, categories)), column) - 1).cast("int")


def physical(df: DataFrame, categories: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Times as microseconds and categories as codes; other columns as they are."""
    from .durations import key_number

    out = []
    for field in df.schema:
        column = quoted(field.name)
        if field.name in (categories or {}):
            column = code(column, categories[field.name])
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = key_number(column, field.dataType)
        elif isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, (T.TimestampType, T.TimestampNTZType)):
            column = _physical_list(column, field.dataType.elementType)
        out.append(column.alias(field.name))
    return df.select(*out)


def _physical_list(column: Column, kind: T.DataType) -> Column:
    from .durations import key_number

    return F.transform(column, lambda x: key_number(x, kind))


def all_not_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without a null in any of the columns; NaN isn't null."""
    return df.where(reduce(lambda a, b: a & b, (quoted(c).isNotNull() for c in columns or df.columns), F.lit(True)))


def datetime_from_nanos(column: Column) -> Column:
    """Nanoseconds since 1970 to a timestamp of microseconds, by way of seconds in double precision."""
    return F.timestamp_micros(F.round(column / F.lit(1e9) * 1e6).cast("long"))


def nanos_from_text(column: Column) -> Column:
    """``yyyy-mm-ddThh:mm:ss[.fraction]`` to nanoseconds, all nine places kept; an error for other text."""
    bare = F.regexp_replace(column, r"[Zz]$", "")
    whole = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.regexp_replace(bare, r"\.\d+$", "").cast("timestamp_ntz"))
    part = F.rpad(F.regexp_extract(bare, r"\.(\d{1,9})\d*$", 1), 9, "0").cast("long")
    return whole * 1_000_000_000 + part
