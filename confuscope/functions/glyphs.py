"""Pictures of text without a font: each character is a box with the six hexadecimal digits of its code point, in two rows
of three, as fallback fonts draw characters that they do not have. So texts of any script can be drawn, and be read back
from the pixels. A space is an empty box.

Images are grey PNG files; the reader takes what the format allows for eight bits a channel without interlacing.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

from .render import RenderSettings

# The digits 0 to F on a grid of three by five, row by row.
DIGITS = (
    "111101101101111", "010110010010111", "111001111100111", "111001111001111", "101101111001001", "111100111001111", "111100111101111", "111001010010010",
    "111101111101111", "111101111001111", "010101111101101", "110101110101110", "011100100100011", "110101101101110", "111100111100111", "111100111100100",
)
SHAPES = np.array([[int(b) for b in d] for d in DIGITS], dtype=bool).reshape(16, 5, 3)
ROWS, COLUMNS = 2, 3
#: Height and width of a box in dots; every digit has a dot's margin above and to its left, and the box one around it all.
BOX_HEIGHT, BOX_WIDTH = ROWS * 6 + 2, COLUMNS * 4 + 2
INK, PAPER = 0, 255


def _box(code: int) -> np.ndarray:
    out = np.zeros((BOX_HEIGHT, BOX_WIDTH), dtype=bool)
    if code != 0x20:
        for k in range(ROWS * COLUMNS):
            digit = code >> 4 * (ROWS * COLUMNS - 1 - k) & 15
            y, x = k // COLUMNS * 6 + 1, k % COLUMNS * 4 + 1
            out[y : y + 5, x : x + 3] = SHAPES[digit]
    return out


def draw(text: str, settings: RenderSettings | None = None, scale: int = 1) -> np.ndarray:
    """Grey pixels of a text, as large as layout() says for boxes: what lies beyond the largest image is cut off, and lines
    that would reach into the lower padding are left out."""
    s, lines = settings or RenderSettings(), text.split("\n")
    height, step = BOX_HEIGHT * scale, int(BOX_HEIGHT * scale * s.line_spacing)
    width = min(max(map(len, lines)) * BOX_WIDTH * scale + 2 * s.padding, s.max_width)
    out = np.full((min(int(len(lines) * height * s.line_spacing + 2 * s.padding), s.max_height), width), PAPER, dtype=np.uint8)
    y = s.padding
    for line in lines:
        if y + height > len(out) - s.padding:
            break
        if line:
            dots = np.concatenate([_box(ord(c)) for c in line], axis=1).repeat(scale, axis=0).repeat(scale, axis=1)[:, : max(0, width - s.padding)]
            out[y : y + height, s.padding : s.padding + dots.shape[1]][dots] = INK
        y += step
    return out


def read(pixels: np.ndarray, settings: RenderSettings | None = None, scale: int = 1) -> tuple[str, list[float]]:
    """The text of drawn pixels, and for each character how sure it is (0 to 1): every digit is the one whose shape lies
    nearest. Empty boxes at the end of a line, and empty lines at the end, are not read; boxes that were cut off are."""
    s = settings or RenderSettings()
    height, step = BOX_HEIGHT * scale, int(BOX_HEIGHT * scale * s.line_spacing)
    dark = (pixels.max(initial=0) - pixels.astype(float)) / max(1.0, float(pixels.max(initial=0)) - float(pixels.min(initial=255)))
    shapes = SHAPES.reshape(16, 15).astype(float)
    lines, sure = [], []
    for y in range(s.padding, len(pixels) - s.padding - height + 1, step):
        n = -(-(pixels.shape[1] - 2 * s.padding) // (BOX_WIDTH * scale))
        strip = np.zeros((height, n * BOX_WIDTH * scale))
        part = dark[y : y + height, s.padding : s.padding + strip.shape[1]]
        strip[:, : part.shape[1]] = part
        dots = strip.reshape(BOX_HEIGHT, scale, n * BOX_WIDTH, scale).mean(axis=(1, 3)).reshape(BOX_HEIGHT, n, BOX_WIDTH).transpose(1, 0, 2)
        digits = np.stack([dots[:, k // COLUMNS * 6 + 1 : k // COLUMNS * 6 + 6, k % COLUMNS * 4 + 1 : k % COLUMNS * 4 + 4].reshape(n, 15) for k in range(ROWS * COLUMNS)], axis=1)
        far = ((digits[:, :, None, :] - shapes) ** 2).sum(axis=3)
        best = far.argmin(axis=2)
        codes = (best << 4 * np.arange(ROWS * COLUMNS - 1, -1, -1)).sum(axis=1)
        blank = digits.mean(axis=(1, 2)) < 0.2
        chars = [" " if b else chr(c) if c <= 0x10FFFF and not 0xD800 <= c < 0xE000 else "�" for c, b in zip(codes.tolist(), blank.tolist(), strict=True)]
        trust = np.where(blank, 1.0, np.clip(1 - far.min(axis=2).max(axis=1) / 15, 0, 1)).tolist()
        kept = len("".join(chars).rstrip(" "))
        lines.append("".join(chars[:kept]))
        sure.append(trust[:kept])
    while lines and not lines[-1]:
        lines.pop()
        sure.pop()
    text = "\n".join(lines)
    return text, [t for k, ts in enumerate(sure) for t in ([1.0] if k else []) + ts]


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(pixels: np.ndarray) -> bytes:
    """Grey pixels as a PNG file."""
    h, w = pixels.shape
    rows = np.concatenate([np.zeros((h, 1), dtype=np.uint8), pixels], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows, 6)) + _chunk(b"IEND", b"")


def from_png(content: bytes) -> np.ndarray:
    """Grey pixels of a PNG file with eight bits a channel, not interlaced; colours become their mean, opacity is left out."""
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, data, head = 8, b"", None
    while at + 8 <= len(content):
        n, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", content[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged PNG file")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(head[3]) if head else None
    if head is None or head[2] != 8 or channels is None or head[6]:
        raise ValueError("a kind of PNG file that is not read here")
    w, h = head[:2]
    raw = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(h, 1 + w * channels)
    out = np.zeros((h, w * channels), dtype=np.uint8)
    above = np.zeros(w * channels, dtype=np.uint8)
    for y in range(h):
        above = out[y] = _unfiltered(int(raw[y, 0]), raw[y, 1:], above, channels)
    grey = out.reshape(h, w, channels)
    if channels in (2, 4):
        grey = grey[:, :, :-1]
    return grey[:, :, 0] if grey.shape[2] == 1 else np.rint(grey.mean(axis=2)).astype(np.uint8)


def _unfiltered(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A row of bytes before one of the format's five filters."""
    if kind == 0:
        return row
    if kind == 1:
        return np.cumsum(row.reshape(-1, step), axis=0, dtype=np.uint64).astype(np.uint8).reshape(-1)
    if kind == 2:
        return row + above
    if kind not in (3, 4):
        raise ValueError("damaged PNG file")
    out, up = [0] * step + row.tolist(), [0] * step + above.tolist()
    for i in range(step, len(out)):
        left, top, corner = out[i - step], up[i], up[i - step]
        if kind == 3:
            guess = (left + top) // 2
        else:
            nearest = left + top - corner
            guess = min((left, top, corner), key=lambda v: abs(nearest - v))
        out[i] = out[i] + guess & 255
    return np.array(out[step:], dtype=np.uint8)
