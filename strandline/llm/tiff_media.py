"""TIFF media columns: a reader of pages in Arrow batches, and the writer that its round trip needs."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import arrow_limits, as_text, only, table

# Fixed values of the TIFF 6.0 format: tags, compressions, and bytes of field types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS_PER_STRIP, STRIP_SIZES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_SIZES, FILL_ORDER, FORMAT = 284, 317, 322, 323, 324, 325, 266, 339
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
FIELD_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
FIELD_CODE = {1: "B", 3: "H", 4: "I"}


class BadTiff(ValueError):
    """The bytes aren't a TIFF that this reader covers."""


def unpack_bits(data: bytes, size: int) -> bytes:
    """PackBits: a count byte below 128 copies the next count + 1 bytes, one above 128 repeats the next byte."""
    out, i, n = bytearray(), 0, len(data)
    while i < n and len(out) < size:
        c = data[i]
        if c < 128:
            out += data[i + 1 : i + 2 + c]
            i += 2 + c
        elif c > 128:
            out += data[i + 1 : i + 2] * (257 - c)
            i += 2
        else:
            i += 1
    return bytes(out[:size])


def pack_bits(data: bytes, row: int) -> bytes:
    """PackBits row by row."""
    out = bytearray()
    for begin in range(0, len(data), row):
        line = data[begin : begin + row]
        i, n = 0, len(line)
        while i < n:
            run = 1
            while i + run < n and run < 128 and line[i + run] == line[i]:
                run += 1
            if run >= 2:
                out += bytes((257 - run, line[i]))
                i += run
                continue
            end = i + 1
            while end < n and end - i < 128 and not (end + 1 < n and line[end] == line[end + 1]):
                end += 1
            out.append(end - i - 1)
            out += line[i:end]
            i = end
    return bytes(out)


def un_lzw(data: bytes, size: int) -> bytes:
    """LZW with codes of 9 to 12 bits, high bits first; 256 clears the table and 257 ends the data."""
    out, table_, width, held, bits = [], [], 9, 0, 0
    fresh = [bytes((i,)) for i in range(256)] + [b"", b""]
    previous, done = None, 0
    table_ = list(fresh)
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table_, width, previous = list(fresh), 9, None
            continue
        if previous is None:
            word = table_[code]
        else:
            if code < len(table_):
                word = table_[code]
            elif code == len(table_):
                word = previous + previous[:1]
            else:
                raise BadTiff("an LZW code comes before its entry")
            table_.append(previous + word[:1])
        out.append(word)
        done += len(word)
        previous = word
        if done >= size:
            break
        width = 9 if (n := len(table_)) < 511 else 10 if n < 1023 else 11 if n < 2047 else 12
    return b"".join(out)[:size]


def lzw(data: bytes) -> bytes:
    held, bits, out = 0, 0, bytearray()
    width, codes, word = 9, {bytes((i,)): i for i in range(256)}, b""

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    put(256)
    n = 258
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in codes:
            word = longer
            continue
        put(codes[word])
        codes[longer] = n
        n += 1
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
        if n >= 4094:
            put(256)
            width, codes, n = 9, {bytes((i,)): i for i in range(256)}, 258
        word = data[i : i + 1]
    if word:
        put(codes[word])
        n += 1
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def expand(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        return data[:size]
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    if compression == PACKBITS:
        return unpack_bits(data, size)
    if compression == LZW:
        return un_lzw(data, size)
    raise BadTiff(f"compression {compression}")


def directories(data: bytes) -> Iterator[tuple[str, dict[int, list[int]]]]:
    """Byte order and the integer fields of each image directory, in the file's chain; a loop ends the walk."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise BadTiff("no TIFF header")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        try:
            count = struct.unpack_from(order + "H", data, at)[0]
            fields = {}
            for k in range(count):
                entry = at + 2 + 12 * k
                tag, kind, n = struct.unpack_from(order + "HHI", data, entry)
                if kind in FIELD_CODE:
                    place = entry + 8 if n * FIELD_BYTES[kind] <= 4 else struct.unpack_from(order + "I", data, entry + 8)[0]
                    fields[tag] = list(struct.unpack_from(f"{order}{n}{FIELD_CODE[kind]}", data, place))
            at = struct.unpack_from(order + "I", data, at + 2 + 12 * count)[0]
        except struct.error as e:
            raise BadTiff("a directory runs over the file's end") from e
        yield order, fields


def page(data: bytes, order: str, fields: dict[int, list[int]]) -> np.ndarray:
    """Samples of one page, as rows x columns x samples: integers of 1 to 64 bits (below 8 bits one byte each), or floats."""
    one = lambda tag, default=None: fields.get(tag, [default])[0]
    width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    depths, formats = set(fields.get(BITS, [1])), set(fields.get(FORMAT, [1]))
    compression, predictor, planar = one(COMPRESSION, NONE), one(PREDICTOR, 1), one(PLANAR, 1)
    if not width or not height or not samples or len(depths) != 1 or len(formats) != 1 or planar not in (1, 2):
        raise BadTiff("a page's layout isn't covered")
    bits, form = depths.pop(), formats.pop()
    code = {1: "u", 2: "i", 3: "f", 4: "u"}.get(form)
    if code is None or bits not in {"u": (1, 2, 4, 8, 16, 32, 64), "i": (8, 16, 32, 64), "f": (16, 32, 64)}[code]:
        raise BadTiff(f"samples of {bits} bits and format {form}")
    if predictor not in (1, 2, 3) or predictor == 2 and (bits < 8 or code == "f") or predictor == 3 and code != "f" or bits < 8 and one(FILL_ORDER, 1) != 1:
        raise BadTiff("a page's predictor or fill order isn't covered")
    kind = np.dtype(f"{order}{code}{max(bits // 8, 1)}")
    if TILES in fields:
        step_x, step_y = one(TILE_WIDTH), one(TILE_HEIGHT)
        places, sizes = fields[TILES], fields[TILE_SIZES]
    else:
        step_x, step_y = width, min(one(ROWS_PER_STRIP, height), height)
        places, sizes = fields[STRIPS], fields[STRIP_SIZES]
    if not step_x or not step_y:
        raise BadTiff("strips or tiles without rows or columns")
    across, down = -(-width // step_x), -(-height // step_y)
    planes, each = (samples, 1) if planar == 2 else (1, samples)
    if len(places) < across * down * planes:
        raise BadTiff("strips or tiles are missing")
    out = np.zeros((height, width, samples), kind.newbyteorder("="))
    line = -(-step_x * each * bits // 8)
    for k, (place, size) in enumerate(zip(places, sizes, strict=True)):
        plane, at = divmod(k, across * down)
        if plane >= planes:
            break
        y, x = at // across * step_y, at % across * step_x
        rows = step_y if TILES in fields else min(step_y, height - y)
        raw = expand(data[place : place + size], compression, rows * line)
        if len(raw) < rows * line:
            raise BadTiff("a strip or tile is too short")
        if bits < 8:
            bit = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(rows, line), axis=1)
            part = np.packbits(bit.reshape(rows, -1, bits), axis=2)[:, : step_x * each] >> (8 - bits)
            part = part.reshape(rows, step_x, each)
        elif predictor == 3:  # differences of bytes, of which a row has all the highest first
            part = np.cumsum(np.frombuffer(raw, np.uint8).reshape(rows, -1, each), axis=1, dtype=np.uint8)
            part = np.ascontiguousarray(part.reshape(rows, kind.itemsize, step_x * each).transpose(0, 2, 1))
            part = part.view(kind.newbyteorder(">")).astype(kind.newbyteorder("=")).reshape(rows, step_x, each)
        else:
            part = np.frombuffer(raw, kind).astype(kind.newbyteorder("=")).reshape(rows, step_x, each)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=part.dtype)
        out[y : y + rows, x : x + step_x, plane : plane + each] = part[: height - y, : width - x]
    return out


def read_tiff(data: bytes) -> list[np.ndarray]:
    return [page(data, order, fields) for order, fields in directories(data)]


def write_tiff(
    pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, tile: int = 0, strip_rows: int = 64, order: str = "<"
) -> bytes:
    """Pages of 8, 16 or 32-bit samples (rows x columns or rows x columns x samples), in strips or square tiles."""
    out = bytearray(struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 0))
    link = 4
    for image in pages:
        image = image.reshape(*image.shape[:2], -1)
        height, width, samples = image.shape
        kind = image.dtype.newbyteorder(order)
        step_x, step_y = (tile, tile) if tile else (width, min(strip_rows, height))
        places, sizes = [], []
        for y in range(0, height, step_y):
            for x in range(0, width, step_x):
                part = image[y : y + step_y, x : x + step_x]
                if tile:
                    part = np.pad(part, ((0, tile - part.shape[0]), (0, tile - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
                raw = part.astype(kind).tobytes()
                row = step_x * samples * kind.itemsize
                raw = {NONE: bytes, DEFLATE: lambda b: zlib.compress(b, 1), PACKBITS: lambda b: pack_bits(b, row), LZW: lzw}[compression](raw)
                places.append(len(out))
                sizes.append(len(raw))
                out += raw
        fields = {
            WIDTH: (4, [width]), HEIGHT: (4, [height]), BITS: (3, [8 * kind.itemsize] * samples), COMPRESSION: (3, [compression]),
            PHOTOMETRIC: (3, [1 if samples < 3 else 2]), SAMPLES: (3, [samples]), PLANAR: (3, [1]), PREDICTOR: (3, [predictor]),
        } | ({TILE_WIDTH: (4, [tile]), TILE_HEIGHT: (4, [tile]), TILES: (4, places), TILE_SIZES: (4, sizes)} if tile
             else {STRIPS: (4, places), ROWS_PER_STRIP: (4, [step_y]), STRIP_SIZES: (4, sizes)})
        entries = b""
        for tag in sorted(fields):
            code, values = fields[tag]
            packed = struct.pack(f"{order}{len(values)}{FIELD_CODE[code]}", *values)
            if len(packed) > 4:
                place = len(out)
                out += packed
                packed = struct.pack(order + "I", place)
            entries += struct.pack(order + "HHI", tag, code, len(values)) + packed.ljust(4, b"\0")
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def page_features(image: np.ndarray) -> dict:
    counts = np.bincount((image.reshape(-1) >> (8 * image.itemsize - 3)).astype(np.int64), minlength=8)
    return {"mean": float(image.mean()), "low": int(image.min()), "high": int(image.max()), "counts": counts.tolist()}


def read_pages(media: DataFrame, keep: list[str], content: str = "content") -> DataFrame:
    """One row per page of each TIFF in a binary column.

    Columns: ``keep``, page (0-based), height, width, samples, bits, data (samples row by row, one byte each
    up to 8 bits, big-endian where over), error and format (1 unsigned, 2 signed, 3 floating). A page that
    can't be read gives a row with its number and the reason in ``error``, and so does the place where the
    chain of directories breaks; other pages stay. Null content or content without a readable first
    directory gives one row with page -1; content without a directory gives none.
    """
    schema = media.select(*keep).schema
    for name in ("page", "height", "width", "samples", "bits"):
        schema = schema.add(name, T.IntegerType())
    schema = schema.add("data", T.BinaryType()).add("error", T.StringType()).add("format", T.IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = []
                raw = batch.column(content)[i].as_py()
                bad = lambda k, e: (k, None, None, None, None, None, str(e) or type(e).__name__, None)
                try:
                    if raw is None:
                        raise BadTiff("no content")
                    for k, (order, fields) in enumerate(directories(raw)):
                        try:
                            image = page(raw, order, fields)
                            depth, form = fields.get(BITS, [1])[0], fields.get(FORMAT, [1])[0]
                            rows.append((k, *image.shape, depth, image.astype(image.dtype.newbyteorder(">")).tobytes(), None, form))
                        except (BadTiff, zlib.error, LookupError, ValueError, TypeError, MemoryError) as e:
                            rows.append(bad(k, e))
                except BadTiff as e:
                    rows.append(bad(len(rows) or -1, e))
                if rows:
                    kept = [pa.array([batch.column(k)[i].as_py()] * len(rows), batch.schema.field(k).type) for k in keep]
                    columns = [pa.array(list(x), t) for x, t in zip(zip(*rows), (*[pa.int32()] * 5, pa.binary(), pa.string(), pa.int32()))]
                    yield pa.RecordBatch.from_arrays([*kept, *columns], schema.names)

    return media.mapInArrow(run, schema)


#: The round trip's page: columns, rows at most, and the side of its tiles, twelve of which lie side by side.
SIDE, PAGE_ROWS, TILE = 576, 1024, 48


def store(payload: bytes) -> bytes:
    """A TIFF of a payload whose length is a multiple of 576, as pages of 576 columns.

    Its form follows from the number of rows: one is a PackBits page, two are LZW, fewer than a tile's are
    deflated strips and more are deflated tiles; all but the first with the horizontal predictor.
    """
    samples = np.frombuffer(payload, np.uint8).reshape(-1, SIDE)
    pages = [samples[y : y + PAGE_ROWS] for y in range(0, len(samples), PAGE_ROWS)]
    if len(samples) == 1:
        return write_tiff(pages, PACKBITS, 1)
    if len(samples) == 2:
        return write_tiff(pages, LZW)
    return write_tiff(pages, tile=TILE if len(samples) >= TILE else 0)


def round_trip(docs: DataFrame) -> DataFrame:
    """Store every text's padded bytes as a TIFF, read its pages back and compute features of them.

    A null text is empty and, like an empty one, a page of padding alone; a long one is many pages. Rows that
    repeat are stored each and get equal values; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), as_text(batch.column("text"))):
                raw = text.as_buffer().to_pybytes()
                media = store(raw + b"\xff" * (-len(raw) % SIDE or (0 if raw else SIDE)))
                pages = read_tiff(media)
                back = b"".join([p.tobytes() for p in pages])
                found = [page_features(p) for p in pages]
                counts = np.sum([f["counts"] for f in found], axis=0)
                feature = f"pages={len(pages)};low={min(f['low'] for f in found)};high={max(f['high'] for f in found)};counts={','.join(map(str, counts))}"
                out.append((doc_id, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(x), t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            ) if out else pa.RecordBatch.from_pylist([], empty)

    empty = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    )
    return docs.mapInArrow(
        run,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )


def op9_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` stored as TIFF pages and read back (null text: empty)."""
    arrow_limits(spark)
    return round_trip(only(table(spark, sf_dir, "documents"), doc_id="long", text="string"))
