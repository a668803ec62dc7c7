"""Alignment of tables of different rates to one reference clock: as-of and interpolation joins in one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import timedelta
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import quoted
from ..functions.durations import key_number, key_unit, parse
from .tree import leaves


@dataclass(frozen=True)
class AsOf:
    """One row of the right table by key: ``backward`` (the last at or before), ``forward`` (the first at or
    after) or ``nearest`` (the later one of two equally near), within ``tolerance``, bounds included.

    Of rows with one key, backward and nearest take the last and forward the first. The row counts even
    where its value is null.
    """

    strategy: str = "backward"
    tolerance: str | int | timedelta | None = None

    def __post_init__(self) -> None:
        if self.strategy not in ("backward", "forward", "nearest"):
            raise ValueError(f"no such strategy: {self.strategy}")


@dataclass(frozen=True)
class Interp:
    """Linear between the nearest values that aren't null, by key; null outside them, the value itself on a hit."""


@dataclass(frozen=True)
class Field:
    """A leaf's key and the columns taken from it, each with its way of joining; ``unit`` is the key's where
    its type doesn't tell (``ns`` for a long of nanoseconds)."""

    key: str
    columns: Mapping[str, AsOf | Interp] | None = None
    unit: str | None = None


def align(
    tables: dict[str, Any], fields: dict[str, Any], separator: str = "/", by: Sequence[str] = ("input_id",), order: str | None = None,
    bucket: str | int | timedelta | None = None,
) -> DataFrame:
    """Join every leaf of ``tables`` to the first one.

    Columns get their path as prefix (``camera/frame_idx``) except ``by``, which every table has. The
    result has the reference's columns and then each leaf's, as declared; a key that is asked for is kept
    under its name. There is one row for each reference row. ``order`` names the column that tells rows of
    one key apart (default: a hash of the row). A null reference key matches nothing.

    All leaves share one union and one shuffle by ``by``: nearest earlier rows come from one ascending
    window and nearest later ones from one descending window, both with running frames, so a recording is
    sorted twice whatever the number of columns. ``nearest`` adds a third order for repeated keys.

    A recording too long for one task is cut by ``bucket``, a length of the key: windows then run within
    buckets, what is nearest beyond a bucket comes from a window over one row per bucket, and the shuffle is
    by recording and bucket. ``order`` must be a number then. The result is the same.
    """
    flat = list(leaves(tables))
    spec = dict(leaves(fields))
    if not flat:
        raise ValueError("nothing to align")
    (ref_path, ref), rest = flat[0], flat[1:]
    name = lambda path, c: c if c in by else separator.join((*path, c))
    ref_key = spec[ref_path].key
    kind = ref.schema[ref_key].dataType
    unit = key_unit(kind, spec[ref_path].unit)

    def base(path: tuple[str, ...], df: DataFrame, right: bool) -> list[Column]:
        key = spec[path].key
        k = key_number(quoted(key), df.schema[key].dataType)
        tie = quoted(order) if order else F.xxhash64(*map(quoted, df.columns))
        return [*map(quoted, by), k.alias("_k"), F.lit(int(right)).alias("_right"), tie.alias("_tie")]

    own = [c for c in ref.columns if c not in by]
    parts, payloads = [], {"_left": T.StructType([ref.schema[c] for c in own])}
    asofs: list[tuple[str, tuple[str, ...], list[str]]] = []
    interps: list[tuple[str, tuple[str, ...], str]] = []
    for j, (path, df) in enumerate(rest):
        wanted = spec[path].columns or {}
        taken = [c for c, how in wanted.items() if isinstance(how, AsOf)]
        values = {}
        if taken:
            values[f"_r{j}"] = F.struct(F.col("_k").alias("k"), *(quoted(c).alias(f"c{i}") for i, c in enumerate(taken)))
            asofs.append((f"_r{j}", path, taken))
        for i, (c, how) in enumerate(wanted.items()):
            if isinstance(how, Interp):
                if c == spec[path].key:
                    raise ValueError("cannot interpolate key")
                values[f"_i{j}_{i}"] = F.when(quoted(c).isNotNull(), F.struct(F.col("_k").alias("k"), quoted(c).cast("double").alias("v")))
                interps.append((f"_i{j}_{i}", path, c))
        if values:
            k = key_number(quoted(spec[path].key), df.schema[spec[path].key].dataType)
            with_key = df.withColumn("_k", k)
            part = with_key.where("_k IS NOT NULL").select(*base(path, df, True), *(v.alias(n) for n, v in values.items()))
            for n in values:
                payloads[n] = part.schema[n].dataType
            parts.append(part)
    left = ref.select(*base(ref_path, ref, False), F.struct(*map(quoted, own)).alias("_left"))
    union = left
    for part in parts:
        union = union.unionByName(part, allowMissingColumns=True)

    group = [*map(quoted, by)]
    if bucket is not None:
        union = union.withColumn("_b", F.floor(F.col("_k") / parse(bucket).steps(unit)))
        group.append(F.col("_b"))
    up = Window.partitionBy(*group).orderBy(F.asc("_k"), F.desc("_right"), F.asc("_tie")).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*group).orderBy(F.desc("_k"), F.desc("_right"), F.desc("_tie")).rowsBetween(Window.unboundedPreceding, 0)
    down_last = Window.partitionBy(*group).orderBy(F.desc("_k"), F.desc("_right"), F.asc("_tie")).rowsBetween(Window.unboundedPreceding, 0)
    uses = lambda path, taken: {spec[path].columns[c].strategy for c in taken}
    before = {f"{n}_b": F.last(n, ignorenulls=True).over(up) for n, p, t in asofs if uses(p, t) & {"backward", "nearest"}}
    before |= {f"{n}_b": F.last(n, ignorenulls=True).over(up) for n, _, _ in interps}
    after = {f"{n}_f": F.last(n, ignorenulls=True).over(down) for n, p, t in asofs if "forward" in uses(p, t)}
    after |= {f"{n}_f": F.last(n, ignorenulls=True).over(down) for n, _, _ in interps}
    after_last = {f"{n}_n": F.last(n, ignorenulls=True).over(down_last) for n, p, t in asofs if "nearest" in uses(p, t)}
    for columns in (before, after, after_last):
        if columns:
            union = union.withColumns(columns)
    if bucket is not None:
        union = _carried(union, by, before, {**after, **after_last})
        group.pop()
    rows = union.where("_right = 0")

    out = {(ref_path, c): quoted("_left").getField(c).alias(name(ref_path, c)) for c in own}
    at = F.col("_k")
    for n, path, taken in asofs:
        for i, c in enumerate(taken):
            how = spec[path].columns[c]
            if how.strategy == "nearest":
                b, f = F.col(f"{n}_b"), F.col(f"{n}_n")
                match = F.when(b.isNull() | (f["k"] - at <= at - b["k"]), f).otherwise(b)
                match = F.when(f.isNull(), b).otherwise(match)
            else:
                match = F.col(f"{n}_b" if how.strategy == "backward" else f"{n}_f")
            fits = at.isNotNull()
            if how.tolerance is not None:
                fits &= F.abs(match["k"] - at) <= parse(how.tolerance).steps(unit)
            out[path, c] = F.when(fits, match[f"c{i}"]).alias(name(path, c))
    for n, path, c in interps:
        b, f = F.col(f"{n}_b"), F.col(f"{n}_f")
        between = b["v"] + (f["v"] - b["v"]) * (at - b["k"]) / (f["k"] - b["k"])
        value = F.when(at.isNull(), None).when(b["k"] == at, b["v"]).when(f["k"] == at, f["v"]).when(f["k"] > b["k"], between)
        source = dict(flat)[path].schema[c].dataType
        out[path, c] = value.cast("float" if isinstance(source, T.FloatType) else "double").alias(name(path, c))
    ordered = [out[ref_path, c] for c in own]
    for path, _ in rest:
        ordered += [out[path, c] for c in spec[path].columns or {}]
    return rows.select(*group, *ordered)


def _carried(union: DataFrame, by: Sequence[str], before: Mapping[str, Column], after: Mapping[str, Column]) -> DataFrame:
    """Where a bucket has nothing before (or after) a row, take what the nearest bucket that has something ends
    (or begins) with: the running values at a bucket's last and first row are what it hands on."""
    last, first = F.struct("_k", -F.col("_right"), "_tie"), F.struct("_k", "_right", "_tie")
    # of rows with one key the first order wants the last one and the second the first: the tie is turned for it
    turned = F.struct("_k", "_right", -F.col("_tie"))
    ends = union.where("_k IS NOT NULL").groupBy(*map(quoted, by), "_b").agg(
        *(F.max_by(c, last).alias(c) for c in before), *(F.min_by(c, turned if c.endswith("_n") else first).alias(c) for c in after)
    )
    over = Window.partitionBy(*map(quoted, by))
    earlier = over.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    later = over.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    hand = ends.select(
        *map(quoted, by), "_b", *(F.last(c, ignorenulls=True).over(earlier).alias(f"{c}_c") for c in before),
        *(F.last(c, ignorenulls=True).over(later).alias(f"{c}_c") for c in after),
    )
    joined = union.join(hand, [*by, "_b"], "left")
    return joined.withColumns({c: F.coalesce(c, f"{c}_c") for c in [*before, *after]})
