"""Video: headers and sample tables of MP4 files read by seeks, and frames decoded from their key frames on."""

from __future__ import annotations

import io
import struct
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import open_file, read_at, size_of
from .images import Transform, compose

#: Frames of one file that one task decodes; a longer video is several tasks'.
FRAMES = 1024
#: Decodes the samples of a run that begins with a key frame: (codec, codec's set-up box, samples) to one array a sample.
Decoder = Callable[[str, bytes, Sequence[bytes]], Sequence[np.ndarray]]


def boxes(data: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(type, first byte, last byte) of the boxes between two places."""
    end = len(data) if end is None else end
    while at + 8 <= end:
        kind, head, size = _box_head(data[at : at + 16], end - at)
        if size < head:
            return
        yield kind, at + head, min(end, at + size)
        at += size


def _box_head(raw: bytes, rest: int) -> tuple[bytes, int, int]:
    size, kind = struct.unpack_from(">I4s", raw)
    if size == 1 and len(raw) >= 16:
        return kind, 16, struct.unpack_from(">Q", raw, 8)[0]
    return kind, 8, rest if size == 0 else size


def top_boxes(file: BinaryIO) -> Iterator[tuple[bytes, int, int]]:
    """The same for a file's outermost boxes, of which only the heads are read."""
    at, end = 0, size_of(file)
    while at + 8 <= end:
        kind, head, size = _box_head(read_at(file, at, 16), end - at)
        if size < head:
            return
        yield kind, at + head, min(end, at + size)
        at += size


def find(data: bytes, *path: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[int, int]]:
    """Places of the boxes at a path of types."""
    for kind, a, b in boxes(data, at, end):
        if kind == path[0]:
            if len(path) == 1:
                yield a, b
            else:
                yield from find(data, *path[1:], at=a, end=b)


@dataclass
class Track:
    """A video track: its codec, the codec's description, and of each sample its place, size and whether it is a key frame."""

    codec: str
    setup: bytes
    offsets: np.ndarray
    sizes: np.ndarray
    keys: np.ndarray

    def __len__(self) -> int:
        return len(self.sizes)

    def run(self, index: int) -> tuple[int, int]:
        """The samples that frame ``index`` needs: from the key frame at or before it."""
        if not 0 <= index < len(self):
            raise IndexError(f"the video has {len(self)} frames, not {index}")
        return int(self.keys[max(0, bisect_right(self.keys, index) - 1)]), index


def read_track(file: BinaryIO) -> Track:
    """The first video track. Only the header and, of fragmented files, the fragments' headers are read."""
    tops = list(top_boxes(file))
    for kind, a, b in tops:
        if kind == b"moov":
            data = read_at(file, a, b - a)
            for x, y in find(data, b"trak"):
                handler = next(find(data, b"mdia", b"hdlr", at=x, end=y), None)
                if handler and data[handler[0] + 8 : handler[0] + 12] == b"vide":
                    return _track(file, data, x, y, [t for t in tops if t[0] == b"moof"])
    raise RuntimeError("the file has no video track")


def _track(file: BinaryIO, data: bytes, x: int, y: int, fragments: list[tuple[bytes, int, int]]) -> Track:
    tables = next(find(data, b"mdia", b"minf", b"stbl", at=x, end=y), None)
    if tables is None:
        raise RuntimeError("the header has no sample table")
    at = {kind: (a, b) for kind, a, b in boxes(data, *tables)}
    codec, setup = "", b""
    if b"stsd" in at:
        entry = next(boxes(data, at[b"stsd"][0] + 8, at[b"stsd"][1]), None)
        if entry:
            codec, setup = entry[0].decode("latin-1"), data[entry[1] : entry[2]]
    sizes = _sizes(data, at)
    offsets = _offsets(data, at, sizes)
    keys = np.arange(len(sizes))
    if b"stss" in at:
        a = at[b"stss"][0]
        (n,) = struct.unpack_from(">I", data, a + 4)
        keys = np.frombuffer(data, ">u4", n, a + 8).astype(np.int64) - 1
    track_id = _track_id(data, x, y)
    defaults = next((struct.unpack_from(">IIIII", data, a + 4)[1:] for a, _ in find(data, b"mvex", b"trex") if struct.unpack_from(">I", data, a + 4)[0] == track_id), (1, 0, 0, 0))
    for _, a, b in fragments:
        more = _fragment(read_at(file, a, b - a), a - 8, track_id, defaults)
        if more is not None:
            keys = np.concatenate([keys, more[2] + len(sizes)])
            offsets, sizes = np.concatenate([offsets, more[0]]), np.concatenate([sizes, more[1]])
    if not {b"stsz", b"stz2"} & at.keys() and not fragments:
        raise RuntimeError("the header has no number of frames")
    return Track(codec, setup, offsets, sizes, keys if len(keys) else np.arange(min(1, len(sizes))))


def _track_id(data: bytes, x: int, y: int) -> int:
    for a, _ in find(data, b"tkhd", at=x, end=y):
        return struct.unpack_from(">I", data, a + (20 if data[a] == 1 else 12))[0]
    return 0


def _sizes(data: bytes, at: dict[bytes, tuple[int, int]]) -> np.ndarray:
    if b"stsz" in at:
        a = at[b"stsz"][0]
        same, n = struct.unpack_from(">II", data, a + 4)
        if same or at[b"stsz"][1] - a < 12 + 4 * n:  # a table that is cut short still tells how many there are
            return np.full(n, same, np.int64)
        return np.frombuffer(data, ">u4", n, a + 12).astype(np.int64)
    if b"stz2" in at:
        a = at[b"stz2"][0]
        bits, n = struct.unpack_from(">xxxBI", data, a + 4)
        if bits == 4:
            raw = np.frombuffer(data, np.uint8, (n + 1) // 2, a + 12)
            return np.stack([raw >> 4, raw & 15], axis=1).reshape(-1)[:n].astype(np.int64)
        return np.frombuffer(data, f">u{bits // 8}", n, a + 12).astype(np.int64)
    return np.zeros(0, np.int64)


def _offsets(data: bytes, at: dict[bytes, tuple[int, int]], sizes: np.ndarray) -> np.ndarray:
    """Of each sample, from the places of chunks and the numbers of samples in them."""
    wide = b"co64" in at
    place = at.get(b"co64" if wide else b"stco")
    if place is None or b"stsc" not in at or not len(sizes):
        return np.full(len(sizes), -1, np.int64)
    (n,) = struct.unpack_from(">I", data, place[0] + 4)
    chunks = np.frombuffer(data, ">u8" if wide else ">u4", n, place[0] + 8).astype(np.int64)
    a = at[b"stsc"][0]
    (m,) = struct.unpack_from(">I", data, a + 4)
    runs = np.frombuffer(data, ">u4", 3 * m, a + 8).astype(np.int64).reshape(m, 3)
    per_chunk = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], n + 1)))[:n]
    chunk = np.repeat(np.arange(n), per_chunk)[: len(sizes)]
    before = np.cumsum(sizes) - sizes
    first = np.searchsorted(chunk, np.arange(n))
    return chunks[chunk] + before[: len(chunk)] - before[np.minimum(first[chunk], len(sizes) - 1)]


def _fragment(data: bytes, begin: int, track_id: int, defaults: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Places, sizes and key frames of a track's samples in one fragment, which begins at ``begin``."""
    offsets, sizes, keys = [], [], []
    for x, y in find(data, b"traf"):
        (a, _) = next(find(data, b"tfhd", at=x, end=y))
        flags, own = struct.unpack_from(">II", data, a)
        if track_id and own != track_id:
            continue
        flags &= 0xFFFFFF
        at, base, size, sample_flags = a + 8, begin, defaults[2], defaults[3]
        if flags & 1:
            (base,) = struct.unpack_from(">Q", data, at)
            at += 8
        at += 4 * (bool(flags & 2) + bool(flags & 8))
        if flags & 16:
            (size,) = struct.unpack_from(">I", data, at)
            at += 4
        if flags & 32:
            (sample_flags,) = struct.unpack_from(">I", data, at)
        place = base
        for a, _ in find(data, b"trun", at=x, end=y):
            flags, n = struct.unpack_from(">II", data, a)
            flags &= 0xFFFFFF
            at, first = a + 8, None
            if flags & 1:
                place = base + struct.unpack_from(">i", data, at)[0]
                at += 4
            if flags & 4:
                (first,) = struct.unpack_from(">I", data, at)
                at += 4
            for i in range(n):
                own_size, own_flags = size, first if i == 0 and first is not None else sample_flags
                at += 4 * bool(flags & 0x100)
                if flags & 0x200:
                    (own_size,) = struct.unpack_from(">I", data, at)
                    at += 4
                if flags & 0x400:
                    (own_flags,) = struct.unpack_from(">I", data, at)
                    at += 4
                at += 4 * bool(flags & 0x800)
                if not own_flags & 0x10000:  # a sample that others aren't needed for
                    keys.append(len(sizes))
                offsets.append(place)
                sizes.append(own_size)
                place += own_size
    return (np.array(offsets, np.int64), np.array(sizes, np.int64), np.array(keys, np.int64)) if sizes else None


def frame_count(file: BinaryIO | bytes) -> int:
    """Frames of the first video track, from its sample table and fragments."""
    return len(read_track(io.BytesIO(file) if isinstance(file, bytes) else file))


def scan_video(files: DataFrame, dtype: str = "int") -> DataFrame:
    """(path, frame_idx): a row for each frame 0 to n - 1 of each file (path, content); only headers are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                with open_file(path, content) as file:
                    counts.append(frame_count(file))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(counts, pa.int64())], ["path", "n"])

    counted = files.select("path", "content").mapInArrow(run, "path string, n long").where("n > 0")
    frames = counted.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("frame_idx"))
    return frames.withColumn("frame_idx", F.col("frame_idx").cast(dtype))


def read_frames(file: BinaryIO, track: Track, indices: Sequence[int], decoder: Decoder) -> Iterator[tuple[int, np.ndarray]]:
    """(index, frame) of sorted distinct frames; each run from a key frame is read and decoded once, as far as asked."""
    runs: dict[int, list[int]] = {}
    for index in indices:
        runs.setdefault(track.run(index)[0], []).append(index)
    for key, wanted in runs.items():
        samples = [read_at(file, int(track.offsets[i]), int(track.sizes[i])) for i in range(key, wanted[-1] + 1)]
        frames = list(decoder(track.codec, track.setup, samples))
        if len(frames) < len(samples):
            raise ValueError(f"the decoder gave {len(frames)} frames of {len(samples)}")
        for index in wanted:
            yield index, np.asarray(frames[index - key])


def decode_frames(files: DataFrame, wanted: DataFrame, decoder: Decoder, transforms: Sequence[Transform] = (), by: str = "input_id", index: str = "frame_idx") -> DataFrame:
    """(by, index, shape, values as flat bytes, dtype) of the frames that ``wanted`` (by, index) names, each once.

    ``files`` has path and content; ``by`` names its path. Frames of a file are dealt to tasks by FRAMES, and
    in each only the byte ranges from key frames to frames that are asked for are read.
    """
    change = compose(transforms)
    parts = wanted.select(F.col(by).alias("path"), F.col(index).cast("long").alias("_i")).where("_i IS NOT NULL").distinct()
    parts = parts.groupBy("path", F.floor(F.col("_i") / FRAMES).alias("_part")).agg(F.sort_array(F.collect_list("_i")).alias("frames"))  # FRAMES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, content, frames = (batch.column(c)[i].as_py() for c in ("path", "content", "frames"))
                with open_file(path, content) as file:
                    for at, frame in read_frames(file, read_track(file), frames, decoder):
                        frame = np.ascontiguousarray(change(frame))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([path]), pa.array([at], pa.int64()), pa.array([list(frame.shape)], pa.list_(pa.int32())), pa.array([frame.tobytes()], pa.binary()), pa.array([frame.dtype.str])],
                            [by, index, "shape", "data", "dtype"],
                        )

    return parts.join(files.select("path", "content"), "path").select("path", "content", "frames").mapInArrow(run, f"`{by}` string, `{index}` long, shape array<int>, data binary, dtype string")


def image_samples(codec: str, setup: bytes, samples: Sequence[bytes]) -> list[np.ndarray]:
    """A decoder of videos whose samples are whole images."""
    from .images import decode_image

    return [decode_image(s) for s in samples]


def raw_samples(codec: str, setup: bytes, samples: Sequence[bytes]) -> list[np.ndarray]:
    """A decoder of uncompressed RGB frames, whose size the codec's description tells."""
    width, height = struct.unpack_from(">HH", setup, 24)
    return [np.frombuffer(s, np.uint8, width * height * 3).reshape(height, width, 3) for s in samples]
