"""File listings matched by a pattern: one row per file whose path has all of the pattern's groups."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_GROUP = re.compile(r"\(\?P?<(?P<name>[A-Za-z_]\w*)>")


def walk(root: str) -> Iterator[str]:
    """Paths below ``root`` relative to it; folders are entered, links to folders are entries themselves."""
    with os.scandir(root) as entries:
        for entry in entries:
            if entry.is_dir(follow_symlinks=False):
                for below in walk(entry.path):
                    yield f"{entry.name}/{below}"
            else:
                yield entry.name


class _Listing(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[InputPartition]:
        """A part for each entry of the root, so large trees are listed by many tasks."""
        with os.scandir(self.root) as entries:
            names = sorted((e.name, e.is_dir(follow_symlinks=False)) for e in entries)
        return [InputPartition(n) for n in names] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        name, folder = partition.value
        yield from ((f"{name}/{p}",) for p in walk(os.path.join(self.root, name))) if folder else iter([(name,)])


class PathListing(DataSource):
    """``spark.read.format("path_listing").load(folder)``: column ``path``. The folder is one that all workers mount."""

    @classmethod
    def name(cls) -> str:
        return "path_listing"

    def schema(self) -> str:
        return "path string"

    def reader(self, schema) -> DataSourceReader:
        return _Listing(self.options["path"])


def groups(pattern: str) -> tuple[list[str], str]:
    """The pattern's named groups and the same pattern with plain ones, as Java's names allow no underscore."""
    names = [m["name"] for m in _GROUP.finditer(pattern)]
    if not names:
        raise ValueError("the pattern has no named group")
    return names, _GROUP.sub("(", pattern)


def extract_path(df: DataFrame, pattern: str, fields: Mapping[str, str | None], path: str = "path", keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns from the pattern's groups, projected to ``fields`` and cast to their types (null: text).

    Rows that don't match, or whose match lacks one of the groups, are dropped. A value that can't be cast
    is an error. ``fields`` must name all the groups.
    """
    names, plain = groups(pattern)
    if set(names) != set(fields):
        raise ValueError(f"fields {sorted(fields)} aren't the pattern's groups {sorted(names)}")
    plain_groups = [i for i, m in enumerate(re.finditer(r"(?<!\\)\((?!\?)|" + _GROUP.pattern, pattern), 1) if m["name"]]
    found = df.where(F.col(path).rlike(plain))
    found = found.select(*keep, *(F.nullif(F.regexp_extract(path, plain, i), F.lit("")).alias(n) for n, i in zip(names, plain_groups)))
    found = found.dropna("any", subset=names)
    return found.select(*keep, *(F.col(n).cast(kind) if kind else F.col(n) for n, kind in fields.items()))


def scan_paths(spark: SparkSession, root: str, pattern: str, fields: Mapping[str, str | None]) -> DataFrame:
    spark.dataSource.register(PathListing)
    return extract_path(spark.read.format("path_listing").load(root), pattern, fields)
