"""Images as arrays: PNG and portable pixmaps by plain numpy, others by Pillow where it is installed; and transforms."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Callable, Sequence

import numpy as np

Transform = Callable[[np.ndarray], np.ndarray]
# Fixed values of the formats: signatures, samples of a pixel by colour type.
_PNG, _CHANNELS = b"\x89PNG\r\n\x1a\n", {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def decode_image(data: bytes) -> np.ndarray:
    """Height by width by samples of 8 or 16 bits."""
    if data[:8] == _PNG:
        return decode_png(data)
    if data[:2] in (b"P5", b"P6"):
        return decode_pnm(data)
    try:
        from PIL import Image
    except ImportError as e:
        raise ImportError("images other than PNG and PNM need the optional package Pillow") from e
    return np.asarray(Image.open(io.BytesIO(data)))


def decode_pnm(data: bytes) -> np.ndarray:
    fields, at = [], 2
    while len(fields) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while not data[end : end + 1].isspace():
            end += 1
        fields.append(int(data[at:end]))
        at = end
    width, height, most = fields
    samples = 3 if data[:2] == b"P6" else 1
    kind = np.dtype(">u2" if most > 255 else np.uint8)
    return np.frombuffer(data, kind, width * height * samples, at + 1).reshape(height, width, samples).astype(kind.newbyteorder("="))


def decode_png(data: bytes) -> np.ndarray:
    at, body, palette, alpha = 8, [], None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + part) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IHDR":
            width, height, bits, colour, _, _, laced = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS" and colour == 3:
            alpha = np.frombuffer(part, np.uint8)
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + size
    if laced:
        raise ValueError("interlaced images aren't read")
    per_pixel = _CHANNELS[colour]
    row, step = (width * per_pixel * bits + 7) // 8, max(1, per_pixel * bits // 8)
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, row + 1)
    lines = np.zeros((height, row), np.uint8)
    above = np.zeros(row, np.uint8)
    for y in range(height):
        above = lines[y] = _unfiltered(int(raw[y, 0]), raw[y, 1:], above, step)
    if bits == 16:
        out = lines.view(">u2").astype(np.uint16).reshape(height, width, per_pixel)
    elif bits == 8:
        out = lines.reshape(height, width, per_pixel)
    else:
        places = np.arange(8 // bits)[::-1] * bits
        out = (lines[:, :, None] >> places & (1 << bits) - 1).reshape(height, -1)[:, :width, None].astype(np.uint8)
        if colour == 0:
            out = out * np.uint8(255 // ((1 << bits) - 1))
    if colour == 3:
        if palette is None:
            raise ValueError("the palette is missing")
        index = out[:, :, 0]
        out = palette[index]
        if alpha is not None:
            full = np.concatenate([alpha, np.full(max(0, len(palette) - len(alpha)), 255, np.uint8)])
            out = np.concatenate([out, full[index][:, :, None]], axis=2)
    return out


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line.copy()
    if kind == 2:
        return line + above
    if kind == 1:  # each byte on the one a pixel before it: running sums
        n = -(-len(line) // step) * step
        padded = np.zeros(n, np.uint8)
        padded[: len(line)] = line
        return np.cumsum(padded.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)[: len(line)]
    out, up = bytearray(len(line)), above.tolist()
    for i, x in enumerate(line.tolist()):
        left = out[i - step] if i >= step else 0
        if kind == 3:
            guess = (left + up[i]) // 2
        elif kind == 4:
            corner = up[i - step] if i >= step else 0
            p = left + up[i] - corner
            guess = min((abs(p - left), 0, left), (abs(p - up[i]), 1, up[i]), (abs(p - corner), 2, corner))[2]
        else:
            raise ValueError(f"no such filter: {kind}")
        out[i] = (x + guess) & 255
    return np.frombuffer(bytes(out), np.uint8)


def compose(transforms: Sequence[Transform]) -> Transform:
    """One after another."""

    def run(image: np.ndarray) -> np.ndarray:
        for t in transforms:
            image = t(image)
        return image

    return run


def resize(height: int, width: int, smooth: bool = True) -> Transform:
    """To a size, by the nearest pixel or linearly between the four around (half-pixel centres)."""

    def run(image: np.ndarray) -> np.ndarray:
        h, w = image.shape[:2]
        y, x = (np.arange(height) + 0.5) * h / height - 0.5, (np.arange(width) + 0.5) * w / width - 0.5
        if not smooth:
            return image[np.clip(np.rint(y), 0, h - 1).astype(int)][:, np.clip(np.rint(x), 0, w - 1).astype(int)]
        y, x = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
        y0, x0 = y.astype(int), x.astype(int)
        y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
        trail = (1,) * (image.ndim - 2)
        fy, fx = (y - y0).reshape(-1, 1, *trail), (x - x0).reshape(1, -1, *trail)
        whole = image.astype(np.float64)
        rows = whole[y0] * (1 - fy) + whole[y1] * fy
        out = rows[:, x0] * (1 - fx) + rows[:, x1] * fx
        return np.rint(out).astype(image.dtype) if image.dtype.kind in "iu" else out.astype(image.dtype)

    return run


def channels_first(image: np.ndarray) -> np.ndarray:
    return np.moveaxis(image, -1, 0)
