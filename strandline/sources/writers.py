"""Writers of the log formats that the sources read: a file for each group of rows, written where the rows are."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import mcap
from .files import create_file
from .framed_log import HEADER

#: Messages of an MCAP chunk.
CHUNK_MESSAGES = 1000


def _blob(data: bytes) -> bytes:
    return struct.pack("<I", len(data)) + data


def _record(op: int, body: bytes) -> bytes:
    return struct.pack("<BQ", op, len(body)) + body


def mcap_bytes(messages: Sequence[tuple[str, int, bytes]]) -> bytes:
    """A file of JSON messages (topic, log time in nanoseconds, data) in their order: zstd chunks with message
    indexes, statistics and a summary."""
    import zstandard

    topics = {t: i + 1 for i, t in enumerate(dict.fromkeys(m[0] for m in messages))}
    head = _record(mcap.SCHEMA, struct.pack("<H", 1) + _blob(b"message") + _blob(b"jsonschema") + _blob(b"{}"))
    head += b"".join(_record(mcap.CHANNEL, struct.pack("<HH", i, 1) + _blob(t.encode()) + _blob(b"json") + _blob(b"")) for t, i in topics.items())
    out = io.BytesIO()
    out.write(mcap.MAGIC + _record(1, _blob(b"") + _blob(b"")))
    summary, counts = [head], dict.fromkeys(topics.values(), 0)
    for at in range(0, len(messages), CHUNK_MESSAGES):
        part = messages[at : at + CHUNK_MESSAGES]
        inner, places = bytearray(), {}
        for topic, time, data in part:
            channel = topics[topic]
            places.setdefault(channel, []).append((time, len(inner)))
            counts[channel] += 1
            inner += _record(mcap.MESSAGE, struct.pack("<HIQQ", channel, counts[channel], time, time) + data)
        first, last = min(m[1] for m in part), max(m[1] for m in part)
        packed = zstandard.ZstdCompressor().compress(bytes(inner))
        chunk = _record(mcap.CHUNK, struct.pack("<QQQI", first, last, len(inner), zlib.crc32(inner)) + _blob(b"zstd") + struct.pack("<Q", len(packed)) + packed)
        offset, index, offsets = out.tell(), b"", b""
        for channel, found in places.items():
            offsets += struct.pack("<HQ", channel, offset + len(chunk) + len(index))
            index += _record(mcap.MESSAGE_INDEX, struct.pack("<H", channel) + _blob(b"".join(struct.pack("<QQ", *x) for x in found)))
        out.write(chunk + index)
        summary.append(_record(mcap.CHUNK_INDEX, struct.pack("<QQQQ", first, last, offset, len(chunk)) + _blob(offsets) + struct.pack("<Q", len(index)) + _blob(b"zstd") + struct.pack("<QQ", len(packed), len(inner))))
    out.write(_record(15, struct.pack("<I", 0)))
    start = out.tell()
    times = [m[1] for m in messages] or [0]
    stats = struct.pack("<QHIIIIQQ", len(messages), 1, len(topics), 0, 0, len(summary) - 1, min(times), max(times))
    summary.append(_record(mcap.STATISTICS, stats + _blob(b"".join(struct.pack("<HQ", *x) for x in counts.items()))))
    out.write(b"".join(summary) + _record(mcap.FOOTER, struct.pack("<QQI", start, 0, 0)) + mcap.MAGIC)
    return out.getvalue()


def framed_bytes(frames: Sequence[tuple[int, bytes]]) -> bytes:
    """A framed log of (type, payload)."""
    return struct.pack("=III", *HEADER) + b"".join(struct.pack("=II", kind, len(payload)) + payload for kind, payload in frames)


def npy_bytes(values: Sequence[float]) -> bytes:
    out = io.BytesIO()
    np.save(out, np.asarray(values))
    return out.getvalue()


def write_files(df: DataFrame, folder: str, name: str, row: Sequence[str], order: Sequence[str], build, suffix: str) -> DataFrame:
    """Write ``build``(rows of ``row``) for each value of ``name`` to folder/value+suffix; (path) of each.

    A file's rows are one group, gathered in ``order``; a group is as large as its file.
    """
    packed = F.sort_array(F.collect_list(F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), F.struct(*row).alias("r")))).alias("rows")
    groups = df.groupBy(F.col(name).cast("string").alias("name")).agg(packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = []
            for key, rows in zip(batch.column("name").to_pylist(), batch.column("rows")):
                paths.append(f"{folder}/{key}{suffix}")
                with create_file(paths[-1]) as file:
                    file.write(build([tuple(x["r"].values()) for x in rows.as_py()]))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])

    return groups.mapInArrow(run, "path string")


def write_mcap(df: DataFrame, folder: str, name: str, topic: str, time: str, data: str, order: Sequence[str]) -> DataFrame:
    """An MCAP file of JSON messages for each value of ``name``; ``time`` holds nanoseconds."""
    return write_files(df, folder, name, [topic, time, data], order, lambda rows: mcap_bytes([(t, n, d.encode()) for t, n, d in rows]), ".mcap")


def write_framed_log(df: DataFrame, folder: str, name: str, kind: str, payload: str, order: Sequence[str]) -> DataFrame:
    """A framed log for each value of ``name``; ``kind`` holds the type's number."""
    return write_files(df, folder, name, [kind, payload], order, lambda rows: framed_bytes([(k, bytes(p)) for k, p in rows]), ".log")
