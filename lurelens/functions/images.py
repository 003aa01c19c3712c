"""Grey pixels of encoded images, in numpy: PNG in all its kinds, also inside an icon file, and resampling by Lanczos."""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels of each colour type.
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: First column, first row, and the steps of both, of each pass of an interlaced image.
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
_MOST_PIXELS = 1 << 26
_PRECISION = 22  #: bits of a weight of the resampling


def _unfiltered(data: bytes, rows: int, width: int, step: int) -> tuple[np.ndarray, int]:
    """(bytes of ``rows`` lines, how much of the data they took); ``step`` is the bytes of a pixel, one at least."""
    out = np.zeros((rows + 1, width), np.uint8)
    at = 0
    for y in range(1, rows + 1):
        kind = data[at]
        line = np.frombuffer(data, np.uint8, width, at + 1)
        above = out[y - 1]
        if kind == 0:
            out[y] = line
        elif kind == 2:
            out[y] = line + above
        elif kind == 1:  # the sum of each channel along the line
            for c in range(step):
                out[y, c::step] = np.cumsum(line[c::step], dtype=np.uint8)
        elif kind in (3, 4):
            now, up, raw = bytearray(step + width), bytes(step) + above.tobytes(), line.tobytes()
            for x in range(width):
                left, over, corner = now[x], up[x + step], up[x]
                if kind == 3:
                    guess = (left + over) >> 1
                else:
                    a, b, c = abs(over - corner), abs(left - corner), abs(left + over - 2 * corner)
                    guess = left if a <= b and a <= c else over if b <= c else corner
                now[x + step] = (raw[x] + guess) & 0xFF
            out[y] = np.frombuffer(bytes(now[step:]), np.uint8)
        else:
            raise ValueError("unknown filter")
        at += width + 1
    return out[1:], at


def _samples(lines: np.ndarray, width: int, channels: int, depth: int) -> np.ndarray:
    """Samples (rows, width, channels) of packed lines; of 16 bits the upper eight."""
    n = width * channels
    if depth == 16:
        flat = lines[:, : 2 * n : 2]
    elif depth == 8:
        flat = lines[:, :n]
    else:
        bits = np.unpackbits(lines, axis=1)[:, : n * depth].reshape(len(lines), n, depth)
        flat = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(2).astype(np.uint8)
    return flat.reshape(len(lines), width, channels)


def png_gray(data: bytes) -> np.ndarray:
    """The luminance of a PNG, without its transparency; an error if it is damaged."""
    if not data.startswith(_SIGNATURE):
        raise ValueError("no PNG")
    at, body, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        chunk = data[at + 8 : at + 8 + size]
        if len(chunk) < size or zlib.crc32(kind + chunk) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(chunk)
        elif kind == b"IEND":
            break
        at += size + 12
    width, height, depth, colour, _, _, interlaced = head
    if not 0 < width * height <= _MOST_PIXELS:
        raise ValueError("no size that can be read")
    channels = _CHANNELS[colour]
    raw, step = zlib.decompress(b"".join(body)), max(1, channels * depth // 8)
    pixels = np.zeros((height, width, channels), np.uint8)
    at = 0
    for x, y, dx, dy in _PASSES if interlaced else ((0, 0, 1, 1),):
        columns, rows = len(range(x, width, dx)), len(range(y, height, dy))
        if columns and rows:
            lines, used = _unfiltered(raw[at:], rows, -(-columns * channels * depth // 8), step)
            pixels[y::dy, x::dx] = _samples(lines, columns, channels, depth)
            at += used
    if colour == 3:
        return luminance(palette[pixels[:, :, 0]])
    if colour in (2, 6):
        return luminance(pixels[:, :, :3])
    return pixels[:, :, 0] * np.uint8(255 // ((1 << depth) - 1)) if depth < 8 else pixels[:, :, 0]


def luminance(rgb: np.ndarray) -> np.ndarray:
    """Rec. 601 luma, in 16-bit fixed point."""
    r, g, b = (rgb[..., k].astype(np.uint32) for k in range(3))
    return ((r * 19595 + g * 38470 + b * 7471 + 0x8000) >> 16).astype(np.uint8)


def gray_pixels(data: bytes) -> np.ndarray:
    """Grey pixels of a PNG, or of the largest PNG in an icon file."""
    if data[:4] == b"\x00\x00\x01\x00":
        found = []
        for k in range(struct.unpack_from("<H", data, 4)[0]):
            size, offset = struct.unpack_from("<II", data, 6 + 16 * k + 8)
            found.append(data[offset : offset + size])
        return png_gray(max((x for x in found if x.startswith(_SIGNATURE)), key=lambda x: struct.unpack_from(">II", x, 16)))
    return png_gray(data)


def _sinc(x: float) -> float:
    return math.sin(math.pi * x) / (math.pi * x) if x else 1.0


def _weights(size: int, out: int) -> np.ndarray:
    """(out, size): the Lanczos weights of three lobes of each new sample, in fixed point."""
    scale = size / out
    wide = max(scale, 1.0)
    found = np.zeros((out, size), np.int64)
    for k in range(out):
        centre = (k + 0.5) * scale
        first, last = max(0, int(centre - 3 * wide + 0.5)), min(size, int(centre + 3 * wide + 0.5))
        at = [(x - centre + 0.5) / wide for x in range(first, last)]
        w = [_sinc(x) * _sinc(x / 3) if -3 <= x < 3 else 0.0 for x in at]
        total = sum(w)
        found[k, first:last] = [int(math.floor(v / total * (1 << _PRECISION) + 0.5)) if v >= 0 else -int(math.floor(-v / total * (1 << _PRECISION) + 0.5)) for v in w]
    return found


def resized(gray: np.ndarray, size: int = 32) -> np.ndarray:
    """``size`` x ``size`` pixels: along the lines first, rounded to bytes, then down the columns."""
    out = gray.astype(np.int64)
    for axis in (1, 0):
        if out.shape[axis] != size:
            w = _weights(out.shape[axis], size)
            summed = out @ w.T if axis == 1 else w @ out
            out = np.clip((summed + (1 << (_PRECISION - 1))) >> _PRECISION, 0, 255)
    return out.astype(np.uint8)
