"""Concatenation of tables, with or without a key that tells where a row comes from."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import category
from .index import numbered

HOW = ("vertical", "vertical_relaxed", "diagonal", "diagonal_relaxed", "horizontal", "align", "align_full", "align_inner", "align_left", "align_right")


def concat(
    tables: Sequence[DataFrame], keys: Sequence[str] | None = None, key_column: str | None = None, how: str = "vertical", order: str | None = None
) -> DataFrame:
    """``vertical`` stacks equal schemas and ``vertical_relaxed`` ones with common supertypes; ``diagonal``
    fills missing columns with null; ``horizontal`` puts rows side by side by their number along ``order``;
    ``align`` joins on the common columns (``align_full`` and so on). With ``key_column`` and ``keys`` (both
    or none), each table's key is added as the last column."""
    if how not in HOW:
        raise ValueError(f"no such way: {how}")
    if (keys is None) != (key_column is None):
        raise ValueError("key_column and keys go together")
    if not tables:
        raise ValueError("nothing to concatenate")
    if keys is not None:
        if len(keys) != len(tables):
            raise ValueError("there must be a key for each table")
        tables = [t.withColumn(key_column, category(F.lit(k), list(keys))) for t, k in zip(tables, keys)]
    if how == "vertical":
        first = [(f.name, f.dataType) for f in tables[0].schema]
        if any([(f.name, f.dataType) for f in t.schema] != first for t in tables[1:]):
            raise ValueError("vertical needs equal schemas")
        return reduce(DataFrame.unionAll, tables)
    if how == "vertical_relaxed":
        return reduce(DataFrame.unionByName, tables)
    if how.startswith("diagonal"):
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    if how == "horizontal":
        if order is None:
            raise ValueError("rows have no place without an order")
        placed = [numbered(t, [order], "_n") for t in tables]
        return reduce(lambda a, b: a.join(b.drop(order), "_n", "full_outer"), placed).drop("_n")
    kind = {"align": "full_outer", "align_full": "full_outer"}.get(how, how.removeprefix("align_"))
    common = [c for c in tables[0].columns if all(c in t.columns for t in tables[1:])]
    return reduce(lambda a, b: a.join(b, common, kind), tables)
