"""Media that samples point to: numpy files, files by path template, HDF5; and their lookup join."""

from __future__ import annotations

import io
import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import quoted
from .files import SEEKABLE, open_file, scan_files
from .video import frame_count, scan_video  # noqa: F401

#: Rows of an HDF5 dataset that are read at once.
HDF5_ROWS = 4096


def path_from_template(template: str, index: Column, kind: str) -> Column:
    """``{:04d}`` and ``{}`` for integers, ``{:%Y-%m-%dT%H:%M:%S.%f}`` for times."""
    m = re.fullmatch(r"(.*)\{(?::([^}]*))?\}(.*)", template)
    if not m:
        raise ValueError("a template has one place for the index")
    before, form, after = m[1], m[2] or "", m[3]
    if "%" in form:
        for theirs, ours in (("%Y", "yyyy"), ("%m", "MM"), ("%d", "dd"), ("%H", "HH"), ("%M", "mm"), ("%S", "ss"), ("%f", "SSSSSS")):
            form = form.replace(theirs, ours)
        text = F.date_format(index, re.sub(r"([A-Za-z])(?<![yMdHmsS])", r"'\1'", form))
    elif form:
        text = F.format_string("%" + form, index)
    else:
        text = index.cast("string")
    return F.concat(F.lit(before), text, F.lit(after))


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of every file below a folder of any store that Spark reads; content is null where workers
    open the files themselves."""
    return scan_files(spark, root).select("path", "content")


def read_paths(spark: SparkSession, paths: DataFrame, root: str) -> DataFrame:
    """``paths`` (with a column path) and the files' content, null where workers open them: none but these are
    read. In stores that only Spark reads they are found among the files below ``root``."""
    if urlsplit(root).scheme in SEEKABLE:
        return paths.withColumn("content", F.lit(None).cast("binary"))
    return paths.join(scan_files(spark, root).select("path", "content"), "path")


def decode_files(files: DataFrame, decoder: Callable[[bytes], np.ndarray], keep: Sequence[str] = ("path",), dtype: str = "double", missing: str = "error") -> DataFrame:
    """``keep``, shape and values (flat) of each file (path, content), by ``decoder``. A file that isn't there is
    an error or, with ``missing="null"``, has null for both."""
    if missing not in ("error", "null"):
        raise ValueError(f"no such way: {missing}")
    kinds = {"double": pa.float64(), "float": pa.float32(), "int": pa.int32(), "long": pa.int64(), "tinyint": pa.int8(), "short": pa.int16()}
    schema = files.select(*keep).schema
    text = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + f", shape array<int>, values array<{dtype}>"

    def load(path: str, content: bytes | None) -> np.ndarray | None:
        try:
            with open_file(path, content) as file:
                return decoder(file.read())
        except FileNotFoundError:
            if missing == "error":
                raise
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                got = load(batch.column("path")[i].as_py(), batch.column("content")[i].as_py())
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k).slice(i, 1) for k in keep),
                        pa.array([None if got is None else list(got.shape)], pa.list_(pa.int32())),
                        pa.array([None if got is None else got.reshape(-1)], pa.list_(kinds[dtype])),
                    ],
                    [*keep, "shape", "values"],
                )

    return files.mapInArrow(run, text)


def path_media(samples: DataFrame, root: str, template: str, index: str, decoder: Callable[[bytes], np.ndarray], kind: str = "int", by: Sequence[str] = ("input_id",), dtype: str = "double", transform: Callable[[Column], Column] | None = None, missing: str = "error") -> DataFrame:
    """(by, seq, data: shape and values) of the files that the samples' indices address, for ``lookup``.

    A path is ``root``, the ``by`` columns and ``template`` filled with the index (after ``transform``), parted
    by slashes. Each distinct one is read once, and no other file is listed or read.
    """
    asked = F.explode(quoted(index)) if samples.schema[index].dataType.typeName() == "array" else quoted(index)
    rows = samples.select(*map(quoted, by), asked.alias("seq")).where("seq IS NOT NULL").distinct()
    place = path_from_template(template, transform(F.col("seq")) if transform else F.col("seq"), kind)
    rows = rows.withColumn("path", F.concat_ws("/", F.lit(root.rstrip("/")), *(quoted(c).cast("string") for c in by), place))
    got = decode_files(read_paths(samples.sparkSession, rows, root), decoder, [*by, "seq"], dtype, missing)
    return got.select(*map(quoted, by), "seq", F.struct("shape", "values").alias("data"))


def npy_decoder(select: Sequence[str] | None = None) -> Callable[[bytes], np.ndarray]:
    """Decoder of ``.npy``: the named fields of a structured array as columns of floats."""

    def decode(data: bytes) -> np.ndarray:
        got = np.load(io.BytesIO(data), allow_pickle=False)
        if got.dtype.names:
            names = list(select or got.dtype.names)
            return np.stack([got[n].astype(np.float64) for n in names], axis=-1)
        return got

    return decode


def _hdf5():
    try:
        import h5py
    except ImportError as e:
        raise ImportError("HDF5 files need the optional package h5py") from e
    return h5py.File


def _node(file, path: str):
    """A dataset of an open file, None if it's missing; a group in its place is an error."""
    node = file.get(path)
    if node is not None and not hasattr(node, "shape"):
        raise NotImplementedError(f"{path} is a group")
    return node


def scan_hdf5(spark: SparkSession, files: DataFrame, fields: Mapping[str, Any], prefix: str = "/", opener: Callable | None = None) -> Any:
    """(input_id, seq, fields): the datasets at ``prefix``/field, side by side; a missing one is null. Needs h5py.

    ``files`` has path and content. A field without a declared type is read as doubles (rows of a
    two-dimensional dataset as arrays, declared ``array<...>``). A group in a dataset's place is an error.
    Where ``fields`` has mappings, the result is a tree of tables: a mapping's fields lie in the group of its
    name, and what stands beside mappings makes a table of its own under the name ``""``. Files are read by
    seeks and in slices of HDF5_ROWS rows. ``opener`` opens a file instead of h5py.
    """
    opener = opener or _hdf5()
    groups = {k: v for k, v in fields.items() if isinstance(v, Mapping)}
    if groups:
        own = {k: v for k, v in fields.items() if k not in groups}
        tree = {"": scan_hdf5(spark, files, own, prefix, opener)} if own else {}
        return tree | {k: scan_hdf5(spark, files, v, f"{prefix.rstrip('/')}/{k}", opener) for k, v in groups.items()}
    kinds = {f: t or "double" for f, t in fields.items()}

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                with open_file(path, content) as raw, opener(raw) as file:
                    nodes = {f: _node(file, f"{prefix.rstrip('/')}/{f}") for f in fields}
                    n = max((x.shape[0] for x in nodes.values() if x is not None), default=0)
                    for at in range(0, n, HDF5_ROWS):
                        end = min(n, at + HDF5_ROWS)
                        part = {f: [None] * (end - at) if x is None else padded(list(x[at:end]), end - at) for f, x in nodes.items()}
                        yield pd.DataFrame({"input_id": path, "seq": np.arange(at, end), **part})

    return files.select("path", "content").mapInPandas(run, "input_id string, seq long, " + ", ".join(f"`{f}` {t}" for f, t in kinds.items()))


def padded(rows: list, n: int) -> list:
    return rows + [None] * (n - len(rows))


def hdf5_rows(files: DataFrame, wanted: DataFrame, key: str, dtype: str = "double", opener: Callable | None = None) -> DataFrame:
    """(input_id, seq, data: shape and values) of the rows of dataset ``key`` that ``wanted`` (input_id, seq) names,
    each once; of each file only these rows are read, in runs of HDF5_ROWS."""
    opener = opener or _hdf5()
    parts = wanted.select(F.col("input_id").alias("path"), F.col("seq").cast("long").alias("seq")).where("seq IS NOT NULL").distinct()
    parts = parts.groupBy("path", F.floor(F.col("seq") / HDF5_ROWS).alias("_part")).agg(F.sort_array(F.collect_list("seq")).alias("seqs"))  # HDF5_ROWS at most

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for path, content, seqs in zip(pdf["path"], pdf["content"], pdf["seqs"]):
                with open_file(path, content) as raw, opener(raw) as file:
                    node = _node(file, key)
                    if node is None:
                        raise KeyError(key)
                    got = np.asarray(node[list(map(int, seqs))])
                yield pd.DataFrame({"input_id": path, "seq": list(seqs), "data": [{"shape": list(x.shape), "values": x.reshape(-1)} for x in got]})

    rows = parts.join(files.select("path", "content"), "path").select("path", "content", "seqs")
    return rows.mapInPandas(run, f"input_id string, seq long, data struct<shape: array<int>, values: array<{dtype}>>")


def lookup(samples: DataFrame, media: DataFrame, index: str, output: str, by: Sequence[str] = ("input_id",), media_index: str = "seq", value: str = "data", key: str = "sample_idx") -> DataFrame:
    """Join media to samples by a column of indices (one number or a list), in the list's order.

    ``output`` is the value or the list of values; a missing index gives null in its place. The samples'
    list is exploded to (sample, place), equi-joined on (by, index) and collected again, so heavy values
    are shuffled once and only where asked for.
    """
    many = samples.schema[index].dataType.typeName() == "array"
    place = F.posexplode_outer(quoted(index)) if many else None
    asked = samples.select(key, *map(quoted, by), place.alias("_p", "_i")) if many else samples.select(key, *map(quoted, by), F.lit(0).alias("_p"), quoted(index).alias("_i"))
    found = asked.join(media.select(*map(quoted, by), quoted(media_index).cast("long").alias("_i"), quoted(value).alias("_v")), [*by, "_i"], "left")
    if not many:
        return samples.join(found.select(key, F.col("_v").alias(output)), key)
    lists = found.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_p", "_v"))), lambda s: s["_v"]).alias(output))
    return samples.join(lists, key)
