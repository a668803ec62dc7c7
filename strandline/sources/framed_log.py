"""Framed binary logs: a header of three numbers, then frames of a type, a length and a payload."""

from __future__ import annotations

import io
import struct
import warnings
from collections.abc import Iterator, Mapping
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import open_file, read_at, scan_files, size_of

# Fixed values of the format: the header's numbers and the types' ids.
HEADER = (12, 1, 8)
MESSAGE_TYPES = {"Gnss": 0, "ImageMetadata": 4, "VehicleMotion": 7, "VehicleState": 8}


def frames(file: BinaryIO | bytes, types: set[int] | None = None) -> Iterator[tuple[int, int, bytes]]:
    """(place, type, payload) of each frame of the wanted types, read as a stream; others are passed over by a
    seek. A last frame that is cut short is given as far as it goes; a cut frame header ends the log with a
    warning."""
    file = io.BytesIO(file) if isinstance(file, bytes) else file
    end = size_of(file)
    head = read_at(file, 0, 12)
    for at, expected in enumerate(HEADER):
        if len(head) < 4 * at + 4 or struct.unpack_from("=I", head, 4 * at)[0] != expected:
            raise ValueError(f"header number {at} isn't {expected}")
    at, seq = 12, 0
    while at < end:
        if at + 8 > end:
            warnings.warn("the log ends inside a frame's header", stacklevel=2)
            return
        kind, size = struct.unpack("=II", read_at(file, at, 8))
        if types is None or kind in types:
            yield seq, kind, read_at(file, at + 8, min(size, end - at - 8))
        at, seq = at + 8 + size, seq + 1


def scan_frames(spark: SparkSession, path: str, message_types: list[str] | None = None) -> DataFrame:
    """(input_id, seq, message_type, payload): files below ``path``, each read by one task as a stream, as a log
    has no index; frames of types that aren't asked for are never read."""
    unknown = set(message_types or ()) - MESSAGE_TYPES.keys()
    if unknown:
        raise ValueError(f"no such message types: {sorted(unknown)}")
    wanted = {MESSAGE_TYPES[t] for t in message_types} if message_types is not None else None
    names = {i: n for n, i in MESSAGE_TYPES.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                held, size = [], 0
                with open_file(name, content) as file:
                    for seq, kind, payload in frames(file, wanted):
                        held.append((name, seq, names.get(kind, str(kind)), payload))
                        size += len(payload)
                        if size > 8 << 20:
                            yield _rows(held)
                            held, size = [], 0
                if held:
                    yield _rows(held)

    return scan_files(spark, path).select("path", "content").mapInArrow(run, "input_id string, seq long, message_type string, payload binary")


def _rows(held: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*held), kinds)], ["input_id", "seq", "message_type", "payload"])


def decode(frames_: DataFrame, fields: Mapping[str, Mapping[str, str | None]], descriptor_set: bytes, messages: Mapping[str, str], split: Mapping[str, str] | None = None) -> dict[str, DataFrame]:
    """A table for each message type with its fields, cast where a type is declared.

    ``descriptor_set`` is a serialised FileDescriptorSet and ``messages`` gives the full message name of each
    type. ``split`` names a column by whose values a type's table is parted, as ``Type.value``, without it.
    """
    from ..operators.tree import partition_split
    from .protobuf import decode_protobuf

    out = {}
    for kind, wanted in fields.items():
        part = frames_.where(F.col("message_type") == kind)
        table = decode_protobuf(part, descriptor_set, messages[kind], list(wanted), "payload", ["input_id", "seq"])
        table = table.select("input_id", "seq", *(F.col(c).cast(t) if t else F.col(c) for c, t in wanted.items()))
        if split and kind in split:
            out |= {f"{kind}.{value}": df for value, df in partition_split(table, split[kind]).items()}
        else:
            out[kind] = table
    return out
