"""Sinks for looking at data: the console, a flat projection, and rows by recording and entity for viewers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import quoted


def log_to_console(df: DataFrame, rows: int = 20) -> None:
    df.show(rows, truncate=False)


def flatten_for_viewer(samples: DataFrame, time: str, static: Sequence[str] = (), key: str = "sample_idx") -> DataFrame:
    """One row per element of the lists: key, place, time, the other lists' elements and the static columns."""
    lists = [f.name for f in samples.schema if isinstance(f.dataType, T.ArrayType)]
    if time not in lists:
        raise ValueError("the time column isn't a list")
    zipped = F.posexplode(F.arrays_zip(*(quoted(c).alias(f"c{i}") for i, c in enumerate(lists))))
    rows = samples.select(key, *map(quoted, static), zipped.alias("pos", "_z"))
    first = [time, *(c for c in lists if c != time)]
    return rows.select(key, "pos", *(F.col("_z").getField(f"c{lists.index(c)}").alias(c) for c in first), *map(quoted, static))


@dataclass(frozen=True)
class Component:
    """What a viewer shows of a column: its kind (``Scalars``, ``Image``, ``Points3D``, ...), whether it holds for
    all times, and which places of an element are kept."""

    kind: str
    static: bool = False
    indices: Sequence[int] | None = None


class ViewerSink:
    """Writes samples as rows for a viewer, a folder for each recording and entity.

    ``schema`` gives each column its part: ``"time"`` for a timeline or the components made of it. Columns that
    are lists have an element for each of a sample's steps, as the timelines have; others belong to the
    sample's first step. ``recording`` names the columns that tell recordings apart.
    """

    def __init__(self, schema: Mapping[str, str | Component | Sequence[Component]], recording: str | Sequence[str] = "input_id", key: str = "sample_idx"):
        self.times = [c for c, v in schema.items() if v == "time"]
        self.components = {c: [v] if isinstance(v, Component) else list(v) for c, v in schema.items() if v != "time"}
        wrong = [c for c, v in self.components.items() if not all(isinstance(x, Component) for x in v)]
        if wrong:
            raise TypeError(f"neither a timeline nor components: {wrong}")
        if not self.times and any(not x.static for v in self.components.values() for x in v):
            raise ValueError("what isn't static needs a timeline")
        self.recording, self.key = [recording] if isinstance(recording, str) else list(recording), key

    def rows(self, samples: DataFrame) -> DataFrame:
        """(recording, entity, kind, static, key, pos, times: map of timeline to value, shape, data: flat doubles).

        Static components have one row for each recording, that of its first sample. Null elements are left out.
        """
        missing = {*self.times, *self.components, *self.recording, self.key} - set(samples.columns)
        if missing:
            raise ValueError(f"no such columns: {sorted(missing)}")
        named = F.concat_ws("/", *(quoted(c).cast("string") for c in self.recording))
        parts = [self._part(samples, named, c, x) for c, items in self.components.items() for x in items]
        return reduce(DataFrame.unionAll, parts)

    def _part(self, samples: DataFrame, named: Column, column: str, item: Component) -> DataFrame:
        kinds = {f.name: f.dataType for f in samples.schema}
        listed = [c for c in self.times if isinstance(kinds[c], T.ArrayType)]
        step = lambda c: quoted(c) if isinstance(kinds[c], T.ArrayType) else F.array(quoted(c))
        own = step(column) if listed or not isinstance(kinds[column], T.ArrayType) else F.array(quoted(column))
        kind = kinds[column].elementType if isinstance(kinds[column], T.ArrayType) and listed else kinds[column]
        zipped = F.arrays_zip(own.alias("v"), *(step(c).alias(f"t{i}") for i, c in enumerate(self.times)))
        rows = samples.select(named.alias("recording"), quoted(self.key).alias("key"), F.posexplode(zipped).alias("pos", "_z"))
        value = F.col("_z").getField("v")
        if item.static:
            rows = rows.groupBy("recording").agg(F.min(F.struct("key", "pos", value.alias("v"))).alias("_z"))
            rows = rows.select("recording", F.col("_z.key").alias("key"), F.col("_z.pos").alias("pos"), F.struct(F.col("_z.v").alias("v")).alias("_z"))
            times = F.create_map().cast("map<string,string>")
        else:
            times = F.create_map(*(x for i, c in enumerate(self.times) for x in (F.lit(c), F.col("_z").getField(f"t{i}").cast("string"))))
        shape, data = _flat(value, kind, item.indices)
        return rows.where(value.isNotNull()).select(
            "recording", F.lit(column).alias("entity"), F.lit(item.kind).alias("kind"), F.lit(item.static).alias("static"), "key", "pos", times.alias("times"), shape.alias("shape"), data.alias("data")
        )

    def log(self, samples: DataFrame, path: str, mode: str = "append") -> None:
        self.rows(samples).write.mode(mode).partitionBy("recording", "entity").parquet(path)


def _flat(value: Column, kind: T.DataType, indices: Sequence[int] | None) -> tuple[Column, Column]:
    """Shape and flat doubles of a number, a list, a list of lists, or a struct of shape and values."""
    if isinstance(kind, T.StructType):
        return value.getField("shape").cast("array<int>"), value.getField("values").cast("array<double>")
    depth, inner = 0, kind
    while isinstance(inner, T.ArrayType):
        depth, inner = depth + 1, inner.elementType
    if depth > 2:
        raise TypeError("lists of lists of lists need shape and values")
    if indices is not None and depth:
        value = F.array(*(F.get(value, F.lit(i)) for i in indices))
    shape = F.array() if depth == 0 else F.array(F.size(value)) if depth == 1 else F.array(F.size(value), F.coalesce(F.size(F.get(value, F.lit(0))), F.lit(0)))
    data = F.array(value) if depth == 0 else value if depth == 1 else F.flatten(value)
    return shape.cast("array<int>"), data.cast("array<double>")
