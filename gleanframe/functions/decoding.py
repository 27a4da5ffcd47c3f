"""Pixels of one image in memory, blue first as the JVM's reader gives them.

PNG files are read with zlib and NumPy alone; for other formats Pillow is used where it is installed.
"""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np

# The PNG signature, and the samples of each colour type.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def decode(content: bytes | None) -> np.ndarray | None:
    """(height, width, channels) bytes, or nothing where the image can't be read."""
    if not content:
        return None
    try:
        return _png(content) if content.startswith(SIGNATURE) else _by_pillow(content)
    except Exception:  # noqa: BLE001  whatever a broken file leads to, it is a file that can't be read
        return None


def _by_pillow(content: bytes) -> np.ndarray | None:
    try:
        from PIL import Image
    except ImportError:
        return None
    return np.ascontiguousarray(np.asarray(Image.open(io.BytesIO(content)).convert("RGB"))[..., ::-1])


def _chunks(content: bytes):
    at = len(SIGNATURE)
    while at + 8 <= len(content):
        (size,), kind = struct.unpack(">I", content[at : at + 4]), content[at + 4 : at + 8]
        yield kind, content[at + 8 : at + 8 + size]
        at += size + 12


def _unfiltered(raw: np.ndarray, lines: int, width: int, step: int) -> np.ndarray:
    """Lines of `width` bytes as they were before each was filtered; step: bytes from a pixel to the next."""
    raw = raw[: lines * (width + 1)].reshape(lines, width + 1)
    out = np.zeros((lines, width), np.uint8)
    above = np.zeros(width, np.uint8)
    for y in range(lines):
        kind, line = int(raw[y, 0]), raw[y, 1:]
        if kind == 1:  # the sum of all before it in its column of samples
            whole = np.zeros((-(-width // step), step), np.uint8)
            whole.ravel()[:width] = line
            line = np.add.accumulate(whole, axis=0, dtype=np.uint8).ravel()[:width]
        elif kind == 2:
            line = line + above
        elif kind in (3, 4):
            own = [0] * (width + step)
            up, given = [0] * step + above.tolist(), line.tolist()
            for x in range(width):
                left, high, corner = own[x], up[x + step], up[x]
                if kind == 3:
                    guess = (left + high) >> 1
                else:
                    a, b, c = abs(high - corner), abs(left - corner), abs(left + high - 2 * corner)
                    guess = left if a <= b and a <= c else high if b <= c else corner
                own[x + step] = (given[x] + guess) & 255
            line = np.array(own[step:], np.uint8)
        out[y] = above = line
    return out


def _png(content: bytes) -> np.ndarray | None:
    data, palette, head = bytearray(), None, None
    for kind, value in _chunks(content):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", value)
        elif kind == b"PLTE":
            palette = np.frombuffer(value, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data += value
    width, height, depth, colour, _, _, interlaced = head
    if depth != 8 or interlaced:
        return _by_pillow(content)
    samples = SAMPLES[colour]
    pixels = _unfiltered(np.frombuffer(zlib.decompress(bytes(data)), np.uint8), height, width * samples, samples).reshape(height, width, samples)
    if colour == 3:
        pixels = palette[pixels[..., 0]]
    elif colour in (4, 6):
        pixels = pixels[..., :-1]
    return np.ascontiguousarray(pixels[..., ::-1])


def _means(x: np.ndarray, axis: int, size: int) -> np.ndarray:
    """x with `size` entries along an axis, each the mean of the part it stands for; entries at a border count by their share."""
    n = x.shape[axis]
    sums = np.concatenate((np.zeros_like(x.take([0], axis)), np.cumsum(x, axis=axis)), axis=axis)
    at = np.arange(size + 1) * n / size
    low = np.minimum(at.astype(int), n - 1)
    shape = [-1 if k == axis else 1 for k in range(x.ndim)]
    up_to = sums.take(low, axis) + x.take(low, axis) * (at - low).reshape(shape)
    return np.diff(up_to, axis=axis) * size / n


def fitted(pixels: np.ndarray, side: int) -> np.ndarray:
    """Pixels that fit a square of `side`, in proportion; smaller ones stay as they are. Alpha is left out."""
    pixels = pixels[..., :3] if pixels.shape[2] >= 3 else np.repeat(pixels[..., :1], 3, axis=2)
    h, w, _ = pixels.shape
    scale = side / max(h, w)
    if scale >= 1:
        return np.ascontiguousarray(pixels)
    small = _means(_means(pixels.astype(np.float64), 0, max(1, round(h * scale))), 1, max(1, round(w * scale)))
    return np.clip(np.rint(small), 0, 255).astype(np.uint8)


def encoded(pixels: np.ndarray) -> tuple[bytes, str]:
    """(content, media type) of (height, width, 3) bytes, blue first."""
    rgb = np.ascontiguousarray(pixels[..., ::-1])
    try:
        from PIL import Image
    except ImportError:
        return _as_png(rgb), "image/png"
    Image.fromarray(rgb).save(out := io.BytesIO(), format="WEBP", quality=80)
    return out.getvalue(), "image/webp"


def _as_png(rgb: np.ndarray) -> bytes:
    h, w, _ = rgb.shape
    lines = np.concatenate((np.zeros((h, 1), np.uint8), rgb.reshape(h, w * 3)), axis=1).tobytes()

    def chunk(kind: bytes, value: bytes) -> bytes:
        return struct.pack(">I", len(value)) + kind + value + struct.pack(">I", zlib.crc32(kind + value))

    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines, 6)) + chunk(b"IEND", b"")
