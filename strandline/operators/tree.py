"""Trees of tables: nested dicts of DataFrames by name. Only names live on the driver, never rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import quoted

Tree = dict[str, Any]


def leaves(tree: Any, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], Any]]:
    """(path, leaf) of each leaf, in declaration order."""
    if isinstance(tree, dict):
        for name, branch in tree.items():
            yield from leaves(branch, (*path, name))
    else:
        yield path, tree


def tree_map(f: Callable[..., Any], tree: Any, *rest: Any) -> Any:
    """Apply ``f`` to every leaf; a tree in ``rest`` that ends earlier is broadcast to all leaves below."""
    if isinstance(tree, dict):
        return {k: tree_map(f, v, *(r[k] if isinstance(r, dict) else r for r in rest)) for k, v in tree.items()}
    return f(tree, *rest)


#: The most tables that a table is split into by its values.
TABLES = 10_000


def partition_split(df: DataFrame, key: str, values: list[str] | None = None) -> dict[str, DataFrame]:
    """One table for each value of ``key``, without that column. Without ``values`` the distinct ones are read;
    they name tables, and more than TABLES are an error."""
    if values is None:
        values = sorted(r[0] for r in df.select(quoted(key)).where(quoted(key).isNotNull()).distinct().limit(TABLES + 1).collect())
        if len(values) > TABLES:
            raise ValueError(f"{key} has more than {TABLES} values")
    return {v: df.where(quoted(key) == F.lit(v)).drop(key) for v in values}


def unnest(df: DataFrame, column: str, separator: str | None = None) -> DataFrame:
    """Replace a struct column by its fields, one level; with ``separator`` they keep the column's name before theirs."""
    out = []
    for field in df.schema:
        if field.name == column:
            out += [
                quoted(column).getField(f.name).alias(f.name if separator is None else f"{column}{separator}{f.name}")
                for f in field.dataType
            ]
        else:
            out.append(quoted(field.name))
    return df.select(*out)
