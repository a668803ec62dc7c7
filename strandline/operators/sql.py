"""SQL over tables and named parameters: one SELECT, in Spark's dialect or with a few common spellings of others."""

from __future__ import annotations

import re
from datetime import timedelta
from pathlib import PurePath
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

_TOKEN = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/|\$(\w+)|::|\bEXCLUDE\b|\bself\b", re.S | re.I)
# What a parsed query's topmost node can be. Everything else is a command or writes.
_QUERIES = frozenset(
    "Project Filter Aggregate Distinct Sort GlobalLimit LocalLimit Offset Union Intersect Except UnresolvedWith UnresolvedHaving UnresolvedInlineTable "
    "UnresolvedRelation UnresolvedSubqueryColumnAliases WithWindowDefinition Join Generate Pivot Unpivot SubqueryAlias Sample Tail LateralJoin "
    "UnresolvedTableValuedFunction OneRowRelation RepartitionByExpression LogicalRelation".split()
)


class InvalidQuery(ValueError):
    pass


def translate(query: str) -> str:
    """``$name`` parameters, double-quoted names, ``EXCLUDE`` and ``FROM self`` in Spark's spelling."""

    def swap(m: re.Match) -> str:
        token = m[0]
        if m[1]:
            return f":{m[1]}"
        if token.startswith('"'):
            return "`" + token[1:-1].replace('""', '"').replace("`", "``") + "`"
        if token.upper() == "EXCLUDE":
            return "EXCEPT"
        return "{_self}" if token.lower() == "self" else token

    return _TOKEN.sub(swap, query)


def expand_all_not_null(query: str, columns: list[str]) -> str:
    """``COLUMNS(*) IS NOT NULL`` as a conjunction over the columns of the table that it is asked of."""
    every = " AND ".join(f"`{c.replace('`', '``')}` IS NOT NULL" for c in columns)
    return re.sub(r"COLUMNS\(\*\)\s+IS\s+NOT\s+NULL", f"({every})", query, flags=re.I)


def check(spark: SparkSession, query: str) -> None:
    """Raise unless the text is one statement and that a query."""
    bare = re.sub(r"\{\w+\}", "placeholder", query)
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(bare)
    except (ParseException, Py4JJavaError) as e:
        raise InvalidQuery(f"invalid query: {e}") from e
    if plan.getClass().getSimpleName().rstrip("$") not in _QUERIES:
        raise InvalidQuery("invalid query: only SELECT is allowed")


def sql(spark: SparkSession, query: str, **values: Any) -> DataFrame:
    """Run a query. DataFrames among ``values`` are tables by their names (``self`` too), everything else is
    a named parameter (``$name`` or ``:name``): text, paths, booleans, numbers, timedeltas and None."""
    tables = {k: v for k, v in values.items() if isinstance(v, DataFrame)}
    params = {k: v.as_posix() if isinstance(v, PurePath) else v for k, v in values.items() if k not in tables}
    for k, v in params.items():
        if v is not None and not isinstance(v, (str, bool, int, float, timedelta)):
            raise TypeError(f"parameter {k} has no SQL type")
    text = translate(query)
    sole = next(iter(tables.values())) if len(tables) == 1 else None
    if re.search(r"COLUMNS\(\*\)", text, re.I):
        if sole is None:
            raise InvalidQuery("COLUMNS(*) needs one table")
        text = expand_all_not_null(text, sole.columns)
    check(spark, text)
    names = {}
    for k, df in tables.items():
        names["_self" if k == "self" else k] = df
        if k != "self":
            text = re.sub(rf"(?<![\w.`{{:]){re.escape(k)}(?![\w`}}(.])(?=\s|,|\)|;|$)(?<!AS )", lambda m, k=k: f"{{{k}}}" if _table_place(text, m.start()) else m[0], text)
    return spark.sql(text, args=params or None, **names)


def _table_place(text: str, at: int) -> bool:
    """Does a name at this place follow FROM, JOIN or a comma of a FROM list?"""
    before = text[:at].rstrip()
    return bool(re.search(r"(\bFROM|\bJOIN)$", before, re.I)) or bool(re.search(r"\bFROM\s+[^()]*,$", before, re.I) and not re.search(r"\b(WHERE|ON|GROUP|ORDER|SELECT)\b[^()]*,$", before, re.I))
