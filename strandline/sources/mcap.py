"""MCAP logs: messages by topic, with their decoders."""

from __future__ import annotations

import io
import struct
import warnings
import zlib
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import BinaryIO
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import quoted
from .files import SEEKABLE, open_file, read_at, scan_files, size_of

# Fixed values of the MCAP format: magic bytes and the records' opcodes.
MAGIC = b"\x89MCAP0\r\n"
FOOTER, SCHEMA, CHANNEL, MESSAGE, CHUNK, MESSAGE_INDEX, CHUNK_INDEX, STATISTICS = 2, 3, 4, 5, 6, 7, 8, 11
SPECIAL = ("log_time", "publish_time")


class _Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, form: str) -> tuple:
        out = struct.unpack_from("<" + form, self.data, self.at)
        self.at += struct.calcsize("<" + form)
        return out

    def blob(self, form: str = "I") -> bytes:
        (n,) = self.take(form)
        self.at += n
        return self.data[self.at - n : self.at]

    def text(self) -> str:
        return self.blob().decode()


def records(data: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[int, bytes]]:
    end = len(data) if end is None else end
    while at + 9 <= end:
        op, size = struct.unpack_from("<BQ", data, at)
        yield op, data[at + 9 : at + 9 + size]
        at += 9 + size


@dataclass
class Chunk:
    """Where a chunk and the indexes of its messages lie; a file without chunks is one whose place is -1."""

    offset: int
    length: int
    channels: frozenset[int]
    index_length: int


@dataclass
class Summary:
    schemas: dict[int, tuple[str, str, bytes]] = field(default_factory=dict)
    channels: dict[int, tuple[int, str, str]] = field(default_factory=dict)
    chunks: list[Chunk] = field(default_factory=list)
    counts: dict[int, int] | None = None


def read_summary(file: BinaryIO) -> Summary:
    """Schemas (name, encoding, data), channels (schema, topic, encoding), chunks and message counts; only the
    file's head and tail are read."""
    size = size_of(file)
    tail = read_at(file, max(0, size - 37), 37)  # the footer's record and the magic bytes
    if read_at(file, 0, 8) != MAGIC or tail[-8:] != MAGIC or size < 45:
        raise ValueError("no MCAP file")
    (start,) = struct.unpack_from("<Q", tail, 9)
    if start == 0:
        raise ValueError("the file has no summary")
    out = Summary()
    for op, body in records(read_at(file, start, size - 8 - start)):
        c = _Cursor(body)
        if op == SCHEMA:
            (i,) = c.take("H")
            out.schemas[i] = (c.text(), c.text(), c.blob())
        elif op == CHANNEL:
            i, schema = c.take("HH")
            out.channels[i] = (schema, c.text(), c.text())
        elif op == CHUNK_INDEX:
            _, _, offset, length = c.take("QQQQ")
            (n,) = c.take("I")
            channels = frozenset(c.take("HQ")[0] for _ in range(n // 10))
            out.chunks.append(Chunk(offset, length, channels, c.take("Q")[0]))
        elif op == STATISTICS:
            c.take("QHIIIIQQ")
            (n,) = c.take("I")
            out.counts = dict(c.take("HQ") for _ in range(n // 10))
    out.chunks.sort(key=lambda c: c.offset)
    return out


def open_chunk(body: bytes, crc: bool) -> bytes:
    c = _Cursor(body)
    _, _, size, expected = c.take("QQQI")
    kind, packed = c.text(), c.blob("Q")
    if kind == "zstd":
        import zstandard

        data = zstandard.ZstdDecompressor().decompress(packed, max_output_size=size)
    elif kind == "lz4":
        data = pa.Codec("lz4").decompress(packed, size, asbytes=True)
    elif kind == "":
        data = packed
    else:
        raise ValueError(f"no such compression: {kind}")
    if crc and expected and zlib.crc32(data) != expected:
        raise ValueError("a chunk's checksum is wrong")
    return data


def _topic_channels(summary: Summary, topics: set[str] | None) -> dict[int, str]:
    missing = (topics or set()) - {ch[1] for ch in summary.channels.values()}
    if missing:
        warnings.warn(f"no such topics: {sorted(missing)}", stacklevel=3)
    return {i: ch[1] for i, ch in summary.channels.items() if topics is None or ch[1] in topics}


def _walk(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(channel, log time, place) of the messages among a chunk's records."""
    at = 0
    while at + 9 <= len(data):
        op, size = struct.unpack_from("<BQ", data, at)
        if op == MESSAGE:
            channel, _, log = struct.unpack_from("<HIQ", data, at + 9)
            yield channel, log, at
        at += 9 + size


def _walk_file(file: BinaryIO) -> Iterator[tuple[int, int, int]]:
    """The same for the records of a file without chunks, of which only the heads are read."""
    at, end = 8, size_of(file) - 8
    while at + 9 <= end:
        head = read_at(file, at, 23)
        op, size = struct.unpack_from("<BQ", head)
        if op == MESSAGE:
            channel, _, log = struct.unpack_from("<HIQ", head, 9)
            yield channel, log, at
        at += 9 + size


def message_places(file: BinaryIO, topics: set[str] | None = None, crc: bool = True) -> list[tuple[Chunk, list[int], list[int], list[int], list[int]]]:
    """For each chunk that holds wanted messages: the chunk, and their ordinals, places, channels and log times.

    From the indexes that stand behind chunks; a chunk without them is opened. The ordinal counts a topic's
    messages in log-time order (file order among equals). Chunks with none of the topics aren't touched.
    """
    summary = read_summary(file)
    wanted = _topic_channels(summary, topics)
    chunks = [c for c in summary.chunks if not c.channels or not c.channels.isdisjoint(wanted)] or ([] if summary.chunks else [Chunk(-1, 0, frozenset(), 0)])
    parts = []
    for n, chunk in enumerate(chunks):
        found: list[tuple[int, int, int]] = []
        if chunk.index_length:
            for op, body in records(read_at(file, chunk.offset + chunk.length, chunk.index_length)):
                if op == MESSAGE_INDEX:
                    channel, size = struct.unpack_from("<HI", body)
                    if channel in wanted:
                        found += [(channel, *pair) for pair in struct.iter_unpack("<QQ", body[6 : 6 + size])]
        else:
            walked = _walk_file(file) if chunk.offset < 0 else _walk(_chunk_data(file, chunk.offset, chunk.length, crc))
            found = [x for x in walked if x[0] in wanted]
        if found:
            parts.append(np.array([(n, *x) for x in found], np.int64))
    if not parts:
        return []
    table = np.concatenate(parts)  # chunk, channel, log time, place
    table = table[np.lexsort((table[:, 3], table[:, 0], table[:, 2]))]
    names = sorted(set(wanted.values()))
    topic = np.array([names.index(wanted[c]) for c in table[:, 1].tolist()])
    order = np.argsort(topic, kind="stable")
    ordinal = np.empty(len(table), np.int64)
    first = np.searchsorted(topic[order], topic[order])
    ordinal[order] = np.arange(len(table)) - first
    out = []
    for n, chunk in enumerate(chunks):
        rows = np.flatnonzero(table[:, 0] == n)
        if len(rows):
            rows = rows[np.argsort(table[rows, 3])]
            out.append((chunk, ordinal[rows].tolist(), table[rows, 3].tolist(), table[rows, 1].tolist(), table[rows, 2].tolist()))
    return out


def _chunk_data(file: BinaryIO, offset: int, length: int, crc: bool) -> bytes:
    _, body = next(records(read_at(file, offset, length)))
    return open_chunk(body, crc)


def read_messages(file: BinaryIO, summary: Summary, offset: int, length: int, seqs: list[int], places: list[int], crc: bool = True) -> Iterator[tuple]:
    """(topic, ordinal, log_time, publish_time, encoding, schema name, schema encoding, schema data, message) of
    the messages at ``places`` of one chunk, which is opened once."""
    data = _chunk_data(file, offset, length, crc) if offset >= 0 else None
    for seq, at in zip(seqs, places):
        if data is None:
            _, size = struct.unpack("<BQ", read_at(file, at, 9))
            body = read_at(file, at + 9, size)
        else:
            _, size = struct.unpack_from("<BQ", data, at)
            body = data[at + 9 : at + 9 + size]
        channel, _, log, publish = struct.unpack_from("<HIQQ", body)
        schema, topic, encoding = summary.channels[channel]
        yield (topic, seq, log, publish, encoding, *summary.schemas.get(schema, ("", "", b"")), body[22:])


def messages(data: bytes, topics: set[str] | None, crc: bool = True) -> Iterator[tuple]:
    """All messages of a file's bytes in log-time order, as ``read_messages`` gives them."""
    file = io.BytesIO(data)
    summary, found = read_summary(file), []
    for chunk, seqs, places, *_ in message_places(file, topics, crc):
        found += read_messages(file, summary, chunk.offset, chunk.length, seqs, places, crc)
    yield from sorted(found, key=lambda m: (m[2], m[0], m[1]))


_COLUMNS = {"input_id": pa.string(), "topic": pa.string(), "seq": pa.int64(), "log_time": pa.int64(), "publish_time": pa.int64(), "encoding": pa.string(), "schema_name": pa.string(), "schema_encoding": pa.string(), "schema_data": pa.binary(), "data": pa.binary()}
_SCHEMA = "input_id string, topic string, seq long, log_time long, publish_time long, encoding string, schema_name string, schema_encoding string, schema_data binary, data binary"
_CHUNKS = "path string, content binary, chunk_offset long, chunk_length long, seqs array<long>, places array<long>, channels array<long>, log_times array<long>"


def _chunk_rows(files: DataFrame, topics: set[str] | None, crc: bool) -> DataFrame:
    """A row for each chunk with wanted messages; files' bodies aren't read but for chunks without indexes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                with open_file(path, content) as file:
                    for chunk, *lists in message_places(file, topics, crc):
                        row = [path, content, chunk.offset, chunk.length, *lists]
                        kinds = [pa.string(), pa.binary(), pa.int64(), pa.int64()] + [pa.list_(pa.int64())] * 4
                        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], [c.split()[0] for c in _CHUNKS.split(", ")])

    return files.select("path", "content").mapInArrow(run, _CHUNKS)


def _fetched(chunks: DataFrame, crc: bool) -> DataFrame:
    """The messages at the places of (path, content, chunk_offset, chunk_length, seqs, places)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, file, summary = None, None, None
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("path", "content", "chunk_offset", "chunk_length", "seqs", "places")}
                if row["path"] != last:
                    if file is not None:
                        file.close()
                    last, file = row["path"], open_file(row["path"], row["content"])
                    summary = read_summary(file)
                for m in read_messages(file, summary, row["chunk_offset"], row["chunk_length"], row["seqs"], row["places"], crc):
                    held.append((last, *m))
                    size += len(m[-1]) + len(m[-2])
                    if size > 8 << 20:
                        yield _message_rows(held)
                        held, size = [], 0
        if file is not None:
            file.close()
        if held:
            yield _message_rows(held)

    return chunks.mapInArrow(run, _SCHEMA)


def _message_rows(held: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*held), _COLUMNS.values())], list(_COLUMNS))


def scan_messages(spark: SparkSession, path: str, topics: list[str] | None = None, validate_crcs: bool = True) -> DataFrame:
    """Every message of the topics below ``path``; times are nanoseconds and ``seq`` is the ordinal in the topic,
    the same that addresses a message as media.

    Files are planned by their summaries and message indexes, read by seeks; chunks are then dealt to tasks
    one by one, so a large file is read by many and none holds more than a chunk. Where only Spark reaches
    the store, a file is one task's.
    """
    chunks = _chunk_rows(scan_files(spark, path), set(topics) if topics is not None else None, validate_crcs)
    if urlsplit(path).scheme in SEEKABLE:
        chunks = chunks.repartition(4 * spark.sparkContext.defaultParallelism)
    return _fetched(chunks, validate_crcs)


def message_index(spark: SparkSession, path: str, topics: list[str] | None = None, validate_crcs: bool = False) -> DataFrame:
    """(input_id, topic, seq, log_time, chunk_offset, chunk_length, place) of every message, without its data."""
    topics_of = _topic_table(spark, path)
    rows = _chunk_rows(scan_files(spark, path), set(topics) if topics is not None else None, validate_crcs)
    each = rows.select(F.col("path").alias("input_id"), "chunk_offset", "chunk_length", F.explode(F.arrays_zip("seqs", "places", "channels", "log_times")).alias("m"))
    each = each.select("input_id", "chunk_offset", "chunk_length", F.col("m.seqs").alias("seq"), F.col("m.places").alias("place"), F.col("m.channels").alias("channel"), F.col("m.log_times").alias("log_time"))
    return each.join(topics_of.select("input_id", "channel", "topic"), ["input_id", "channel"]).select("input_id", "topic", "seq", "log_time", "chunk_offset", "chunk_length", "place")


def fetch_messages(spark: SparkSession, path: str, wanted: DataFrame, validate_crcs: bool = False) -> DataFrame:
    """The messages that ``wanted`` (input_id, topic, seq) names, like ``scan_messages``; repeated names once.

    Only chunks that hold one are read, each once, its messages in the order of their places.
    """
    named = message_index(spark, path, None, validate_crcs).join(wanted.select("input_id", "topic", "seq").distinct(), ["input_id", "topic", "seq"], "left_semi")
    # at most the messages of a chunk
    places = F.sort_array(F.collect_list(F.struct("place", "seq"))).alias("m")
    chunks = named.groupBy("input_id", "chunk_offset", "chunk_length").agg(places)
    files = scan_files(spark, path).select(F.col("path").alias("input_id"), "content")
    rows = chunks.join(files, "input_id").sortWithinPartitions("input_id", "chunk_offset")
    return _fetched(rows.select(F.col("input_id").alias("path"), "content", "chunk_offset", "chunk_length", F.col("m.seq").alias("seqs"), F.col("m.place").alias("places")), validate_crcs)


def _topic_table(spark: SparkSession, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                with open_file(name, content) as file:
                    summary = read_summary(file)
                rows = [(name, i, ch[1], None if summary.counts is None else summary.counts.get(i, 0)) for i, ch in summary.channels.items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.int64()))], ["input_id", "channel", "topic", "messages"])

    return scan_files(spark, path).select("path", "content").mapInArrow(run, "input_id string, channel long, topic string, messages long")


def message_counts(spark: SparkSession, path: str) -> DataFrame:
    """(input_id, topic, messages) from the files' statistics; null where a file has none."""
    return _topic_table(spark, path).groupBy("input_id", "topic").agg(F.sum("messages").alias("messages"))


def json_decoder(encoding: str, schema_encoding: str) -> Callable | None:
    """Decodes messages of JSON with a JSON schema; None for others, so that the next decoder is tried."""
    if encoding != "json" or schema_encoding != "jsonschema":
        return None

    def decode(df: DataFrame, _: str, __: bytes, fields: Mapping[str, str | None]) -> DataFrame:
        text = F.col("data").cast("string")
        kinds = ", ".join(f"`{f}` {t or 'string'}" for f, t in fields.items() if f not in SPECIAL)
        return df.withColumn("_m", F.from_json(text, kinds)) if kinds else df.withColumn("_m", F.struct())

    return decode


def protobuf_decoder(encoding: str, schema_encoding: str) -> Callable | None:
    """Decodes protobuf messages by the descriptors that the file carries."""
    if encoding != "protobuf" or schema_encoding != "protobuf":
        return None

    def decode(df: DataFrame, schema_name: str, schema_data: bytes, fields: Mapping[str, str | None]) -> DataFrame:
        from .protobuf import decode_protobuf

        tops = list(dict.fromkeys(f.split(".")[0] for f in fields if f not in SPECIAL))
        keep = ["input_id", "seq", *SPECIAL]
        out = decode_protobuf(df, schema_data, schema_name, tops, "data", keep)
        return out.select(*keep, F.struct(*map(quoted, tops)).alias("_m")) if tops else out.withColumn("_m", F.struct())

    return decode


DECODERS = (json_decoder, protobuf_decoder)


def decode_topics(scanned: DataFrame, fields: Mapping[str, Mapping[str, str | None]], decoders: tuple = DECODERS) -> dict[str, DataFrame]:
    """A table for each topic: input_id, seq, the message's fields (``a.b`` goes into structs), then the times of
    the envelope that are asked for. A topic without messages gives no table. Messages are decoded by their own
    channel's encoding and schema, of which a topic may have several."""
    kind_of = ["encoding", "schema_name", "schema_encoding", "schema_data"]
    kinds: dict[str, list] = {}
    for row in scanned.where(F.col("topic").isin(list(fields))).select("topic", *kind_of).distinct().collect():
        kinds.setdefault(row[0], []).append(row[1:])
    out = {}
    for topic, wanted in fields.items():
        for head in sorted(kinds.get(topic, []), key=str):
            decode = next((d for f in decoders if (d := f(head[0], head[2]))), None)
            if decode is None:
                raise ValueError(f"no decoder for {head[0]} with {head[2]}")
            part = scanned.where(F.col("topic") == topic)
            for name, value in zip(kind_of, head):
                part = part.where(F.col(name).eqNullSafe(F.lit(value if value is None or isinstance(value, str) else bytes(value))))
            table = decode(part, head[1], bytes(head[3] or b""), wanted)
            columns = []
            for name, kind in wanted.items():
                if name not in SPECIAL:
                    column = F.col("_m")
                    for step in name.split("."):
                        column = column.getField(step)
                    columns.append((column.cast(kind) if kind else column).alias(name))
            columns += [F.col(n).cast(wanted[n] or "long") for n in wanted if n in SPECIAL]
            table = table.select("input_id", "seq", *columns)
            out[topic] = out[topic].unionAll(table) if topic in out else table
    return out
