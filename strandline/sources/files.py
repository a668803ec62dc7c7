"""Files of any store, opened where they are read: by seeks if Python reaches the store, else from their whole content."""

from __future__ import annotations

import io
from functools import lru_cache
from pathlib import Path
from typing import BinaryIO
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Schemes of stores that pyarrow opens; a path without one is local.
SEEKABLE = frozenset(("", "file", "s3", "gs", "gcs", "hdfs", "abfs", "abfss"))


def scan_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path, length, content) of every file below ``root``; hidden ones (``.`` or ``_`` before the name) aren't listed.

    ``content`` is null where workers can open the file themselves, so nothing is read here; in other
    stores Spark reads it whole, which bounds files to 2 GB.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(root)
    content = F.lit(None).cast("binary") if urlsplit(root).scheme in SEEKABLE else F.col("content")
    return files.select("path", "length", content.alias("content"))


def open_file(path: str, content: bytes | None = None) -> BinaryIO:
    """A file for reading and seeking; ``content`` if given is all of it."""
    if content is not None:
        return io.BytesIO(content)
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return open(parts.path if parts.scheme else path, "rb")
    store, inside = _store(path)
    return pa.PythonFile(store.open_input_file(inside), mode="r")


def _store(path: str) -> tuple[fs.FileSystem, str]:
    parts = urlsplit(path)
    return _opened(parts.scheme, parts.netloc), f"{parts.netloc}{parts.path}" if parts.scheme != "hdfs" else parts.path


@lru_cache(16)
def _opened(scheme: str, place: str) -> fs.FileSystem:
    return fs.FileSystem.from_uri(f"{scheme}://{place}/")[0]


def size_of(file: BinaryIO) -> int:
    return file.seek(0, io.SEEK_END)


def read_at(file: BinaryIO, at: int, n: int) -> bytes:
    file.seek(at)
    return file.read(n)


def create_file(path: str) -> BinaryIO:
    """A new file for writing, with the folders above it."""
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        place = Path(parts.path if parts.scheme else path)
        place.parent.mkdir(parents=True, exist_ok=True)
        return open(place, "wb")
    store, inside = _store(path)
    store.create_dir(inside.rpartition("/")[0], recursive=True)
    return store.open_output_stream(inside)
