"""AVI motion-JPEG columns.

Writing: an 8-bit grey payload becomes frames of 16 x 12 samples, each a lossless JPEG (the
sequential Huffman process with SOF3, first-order prediction) in an AVI file with an ``idx1`` index.
The Huffman table gives difference category s a code of 9 - s bits, so that every difference takes
exactly 9 bits with its extra bits; a frame is then packed and unpacked as one bit matrix.

Reading: the RIFF tree and ``idx1`` are parsed, frames are taken by the index (or by walking
``movi`` where there is none) and decoded by what their own headers say: lossless frames of any
Huffman table, predictor and restart interval, and baseline (DCT) frames, of which the luminance is
taken.  Shots come from differences of consecutive frames'
histograms that exceed the running mean of the shot by a multiple of its spread.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evmatch.llm.common import table

WIDTH, HEIGHT, FPS = 16, 12, 25
UNIT = WIDTH * HEIGHT
BLOCK = 2048  # frames at a time
BINS, SPREADS, LEAST, WARM = 16, 3.0, 0.15, 2
MOST = 768 << 20  # bytes of a payload; stored they take at most 2 GiB

# ---------------------------------------------------------------- lossless JPEG


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


#: code lengths 1 to 9, one code each, for categories 8 down to 0
_DHT = _segment(0xC4, bytes([0x00]) + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1)))


def _head(width: int, height: int) -> bytes:
    sof = _segment(0xC3, struct.pack(">BHHB", 8, height, width, 1) + bytes([1, 0x11, 0]))
    return b"\xff\xd8" + _DHT + sof + _segment(0xDA, bytes([1, 1, 0x00, 1, 0, 0]))


_HEAD, _TAIL = _head(WIDTH, HEIGHT), b"\xff\xd9"


def _code_table() -> tuple[np.ndarray, np.ndarray]:
    """9-bit words of the differences -255 to 255, and differences of the 512 words."""
    word, back = np.zeros(511, dtype=np.uint16), np.zeros(512, dtype=np.int16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        prefix = (1 << 9 - s) - 2  # ones and a final zero: the canonical code of category s
        extra = d if d > 0 else d + (1 << s) - 1
        word[d + 255] = prefix << s | extra
        back[word[d + 255]] = d
    return word, back


_WORD, _BACK = _code_table()
_BITS = np.unpackbits(_WORD.astype(">u2").view(np.uint8).reshape(-1, 2), axis=1)[:, 7:]
_WEIGHTS = (1 << np.arange(8, -1, -1)).astype(np.uint16)


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """Lossless JPEGs of (frames, HEIGHT, WIDTH) uint8 samples; each is predicted from its left, or upper, neighbour."""
    n = len(samples)
    if n > BLOCK:
        return [f for i in range(0, n, BLOCK) for f in encode_frames(samples[i : i + BLOCK])]
    x = samples.astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    packed = np.packbits(_BITS[d.reshape(n, -1) + 255].reshape(n, -1), axis=1)  # a whole number of bytes
    size, data = packed.shape[1], packed.tobytes()
    return [_HEAD + data[i : i + size].replace(b"\xff", b"\xff\x00") + _TAIL for i in range(0, n * size, size)]


def _restore(d: np.ndarray) -> np.ndarray:
    """Samples from differences, predictor 1, for a stack of frames."""
    d = d.astype(np.int32)
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1)
    return (np.cumsum(d, axis=2) & 0xFFFF).astype(np.uint8)


class Damaged(ValueError):
    """What cannot be read as the file or frame that it says it is."""


def _readable(read: Callable) -> Callable:
    """Whatever goes wrong in reading bytes that anybody may have written is one kind of error."""

    @wraps(read)
    def careful(data: bytes):
        try:
            return read(data)
        except (ValueError, LookupError, struct.error, StopIteration, TypeError, OverflowError, ZeroDivisionError) as e:
            raise Damaged(str(e)) from e

    return careful


def _fits(width: int, height: int, data: bytes) -> None:
    """A sample takes a bit at least, so that no header makes a reader fill more than the file can hold."""
    if width * height > 8 * 32 * len(data):
        raise ValueError("fewer bits than samples")


@dataclass
class Header:
    width: int
    height: int
    precision: int
    predictor: int
    shift: int
    restart: int
    codes: dict[tuple[int, int], int]  # (length, code) -> category
    start: int


def parse_header(jpeg: bytes) -> Header:
    """Of a one-component lossless JPEG; anything else is a ValueError."""
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, size, restart, tables = 2, None, 0, {}
    while True:
        if at + 4 > len(jpeg) or jpeg[at] != 0xFF:
            raise ValueError("broken JPEG marker")
        marker, length = jpeg[at + 1], struct.unpack(">H", jpeg[at + 2 : at + 4])[0]
        body = jpeg[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xC4:
            while body:
                which, counts, code, k, found = body[0], body[1:17], 0, 17, {}
                for bits, many in enumerate(counts, 1):
                    for _ in range(many):
                        found[bits, code] = body[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                tables[which], body = found, body[k:]
        elif marker == 0xC3:
            precision, height, width, parts = struct.unpack(">BHHB", body[:6])
            if parts != 1:
                raise ValueError("one component is expected")
            size = (width, height, precision)
        elif 0xC0 <= marker <= 0xCF and marker != 0xCC:
            raise ValueError("not the lossless process")
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            if size is None:
                raise ValueError("scan before frame")
            return Header(*size, predictor=body[3], shift=body[5] & 15, restart=restart, codes=tables[body[2] >> 4], start=at)


@_readable
def decode_frame(jpeg: bytes) -> np.ndarray:
    """Samples of any one-component lossless JPEG, difference by difference."""
    h = parse_header(jpeg)
    data = jpeg[h.start : jpeg.rindex(_TAIL)]
    _fits(h.width, h.height, data)
    out = np.zeros((h.height, h.width), dtype=np.int32)
    first, left, bits, held, at, row0 = 1 << h.precision - h.shift - 1, h.restart, 0, 0, 0, 0

    def take(n: int) -> int:
        nonlocal bits, held, at
        while held < n:
            if at > len(data) + 4:
                raise ValueError("the data ends too soon")
            byte = data[at] if at < len(data) else 0
            at += 2 if byte == 0xFF else 1
            bits, held = (bits << 8 | byte) & (1 << 40) - 1, held + 8
        held -= n
        return bits >> held & (1 << n) - 1

    for y in range(h.height):
        for x in range(h.width):
            if h.restart and left == 0:
                at = next(i for i in range(at, len(data) - 1) if data[i] == 0xFF and 0xD0 <= data[i + 1] <= 0xD7) + 2
                bits, held, left, row0 = 0, 0, h.restart, y
            code, n = 0, 0
            while (n, code) not in h.codes or n == 0:
                code, n = code << 1 | take(1), n + 1
                if n > 16:
                    raise ValueError("no such Huffman code")
            s = h.codes[n, code]
            extra = take(s) if 0 < s < 16 else 0
            d = 1 << 15 if s == 16 else extra if not s or extra >> s - 1 else extra - (1 << s) + 1
            ra, rb, rc = (int(out[y, x - 1]) if x else 0), (int(out[y - 1, x]) if y else 0), (int(out[y - 1, x - 1]) if x and y else 0)
            if y == row0:
                p = ra if x else first
            elif not x:
                p = rb
            else:
                p = {1: ra, 2: rb, 3: rc, 4: ra + rb - rc, 5: ra + (rb - rc >> 1), 6: rb + (ra - rc >> 1), 7: ra + rb >> 1}[h.predictor]
            out[y, x] = p + d & 0xFFFF
            left -= 1
    return (out << h.shift).astype(np.uint8 if h.precision <= 8 else np.uint16)


# ---------------------------------------------------------------- baseline JPEG

#: fixed values: the Huffman tables that motion-JPEG frames may leave out: symbols in code order, of
#: luminance and chrominance coefficients, and how many codes there are of each length
_LUMA = [
    0x01, 0x02, 0x03, 0x00, 0x04, 0x11, 0x05, 0x12, 0x21, 0x31, 0x41, 0x06, 0x13, 0x51, 0x61, 0x07, 0x22, 0x71,
    0x14, 0x32, 0x81, 0x91, 0xa1, 0x08, 0x23, 0x42, 0xb1, 0xc1, 0x15, 0x52, 0xd1, 0xf0, 0x24, 0x33, 0x62, 0x72,
    0x82, 0x09, 0x0a, 0x16, 0x17, 0x18, 0x19, 0x1a, 0x25, 0x26, 0x27, 0x28, 0x29, 0x2a, 0x34, 0x35, 0x36, 0x37,
    0x38, 0x39, 0x3a, 0x43, 0x44, 0x45, 0x46, 0x47, 0x48, 0x49, 0x4a, 0x53, 0x54, 0x55, 0x56, 0x57, 0x58, 0x59,
    0x5a, 0x63, 0x64, 0x65, 0x66, 0x67, 0x68, 0x69, 0x6a, 0x73, 0x74, 0x75, 0x76, 0x77, 0x78, 0x79, 0x7a, 0x83,
    0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8a, 0x92, 0x93, 0x94, 0x95, 0x96, 0x97, 0x98, 0x99, 0x9a, 0xa2, 0xa3,
    0xa4, 0xa5, 0xa6, 0xa7, 0xa8, 0xa9, 0xaa, 0xb2, 0xb3, 0xb4, 0xb5, 0xb6, 0xb7, 0xb8, 0xb9, 0xba, 0xc2, 0xc3,
    0xc4, 0xc5, 0xc6, 0xc7, 0xc8, 0xc9, 0xca, 0xd2, 0xd3, 0xd4, 0xd5, 0xd6, 0xd7, 0xd8, 0xd9, 0xda, 0xe1, 0xe2,
    0xe3, 0xe4, 0xe5, 0xe6, 0xe7, 0xe8, 0xe9, 0xea, 0xf1, 0xf2, 0xf3, 0xf4, 0xf5, 0xf6, 0xf7, 0xf8, 0xf9, 0xfa,
]
_CHROMA = [
    0x00, 0x01, 0x02, 0x03, 0x11, 0x04, 0x05, 0x21, 0x31, 0x06, 0x12, 0x41, 0x51, 0x07, 0x61, 0x71, 0x13, 0x22,
    0x32, 0x81, 0x08, 0x14, 0x42, 0x91, 0xa1, 0xb1, 0xc1, 0x09, 0x23, 0x33, 0x52, 0xf0, 0x15, 0x62, 0x72, 0xd1,
    0x0a, 0x16, 0x24, 0x34, 0xe1, 0x25, 0xf1, 0x17, 0x18, 0x19, 0x1a, 0x26, 0x27, 0x28, 0x29, 0x2a, 0x35, 0x36,
    0x37, 0x38, 0x39, 0x3a, 0x43, 0x44, 0x45, 0x46, 0x47, 0x48, 0x49, 0x4a, 0x53, 0x54, 0x55, 0x56, 0x57, 0x58,
    0x59, 0x5a, 0x63, 0x64, 0x65, 0x66, 0x67, 0x68, 0x69, 0x6a, 0x73, 0x74, 0x75, 0x76, 0x77, 0x78, 0x79, 0x7a,
    0x82, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8a, 0x92, 0x93, 0x94, 0x95, 0x96, 0x97, 0x98, 0x99, 0x9a,
    0xa2, 0xa3, 0xa4, 0xa5, 0xa6, 0xa7, 0xa8, 0xa9, 0xaa, 0xb2, 0xb3, 0xb4, 0xb5, 0xb6, 0xb7, 0xb8, 0xb9, 0xba,
    0xc2, 0xc3, 0xc4, 0xc5, 0xc6, 0xc7, 0xc8, 0xc9, 0xca, 0xd2, 0xd3, 0xd4, 0xd5, 0xd6, 0xd7, 0xd8, 0xd9, 0xda,
    0xe2, 0xe3, 0xe4, 0xe5, 0xe6, 0xe7, 0xe8, 0xe9, 0xea, 0xf2, 0xf3, 0xf4, 0xf5, 0xf6, 0xf7, 0xf8, 0xf9, 0xfa,
]
_COUNTS = {
    0x00: [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], 0x01: [0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0],
    0x10: [0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125], 0x11: [0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119],
}
_ZIGZAG = sorted(range(64), key=lambda k: (k // 8 + k % 8, (k // 8 if (k // 8 + k % 8) % 2 else k % 8)))


def huffman(counts: list[int], symbols: list[int]) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol, by canonical codes."""
    found, code, k = {}, 0, 0
    for bits, many in enumerate(counts, 1):
        for _ in range(many):
            found[bits, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return found


def standard_tables() -> dict[int, dict[tuple[int, int], int]]:
    out = {which: huffman(_COUNTS[which], list(range(12))) for which in (0x00, 0x01)}
    return out | {0x10: huffman(_COUNTS[0x10], _LUMA), 0x11: huffman(_COUNTS[0x11], _CHROMA)}


_DCT = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(1 / 8) if u == 0 else 0.5) for x in range(8)] for u in range(8)])


@_readable
def decode_baseline(jpeg: bytes) -> np.ndarray:
    """Luminance of a baseline or extended sequential JPEG of 8 bits in one interleaved scan."""
    at, quant, tables, restart, parts = 2, {}, standard_tables(), 0, None
    while True:
        if at + 4 > len(jpeg) or jpeg[at] != 0xFF:
            raise ValueError("broken JPEG marker")
        marker, length = jpeg[at + 1], struct.unpack(">H", jpeg[at + 2 : at + 4])[0]
        body = jpeg[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], dtype=">u2" if wide == 2 else "u1").astype(np.int64)
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0]], body = huffman(list(body[1:17]), list(body[17:n])), body[n:]
        elif marker in (0xC0, 0xC1):
            height, width = struct.unpack(">HH", body[1:5])
            parts = [(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)]
        elif 0xC2 <= marker <= 0xCF and marker != 0xCC:
            raise ValueError("not a sequential JPEG")
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            if parts is None or body[0] != len(parts):
                raise ValueError("one interleaved scan is expected")
            uses = {body[k]: (body[k + 1] >> 4, body[k + 1] & 15) for k in range(1, 1 + 2 * body[0], 2)}
            break
    data = jpeg[at:]
    _fits(width, height, data)
    place, bits, held = 0, 0, 0

    def take(n: int) -> int:
        nonlocal place, bits, held
        while held < n:
            if place > len(data) + 4:
                raise ValueError("the data ends too soon")
            byte = data[place] if place < len(data) else 0
            place += 2 if byte == 0xFF and data[place + 1 : place + 2] == b"\0" else 1
            bits, held = (bits << 8 | byte) & (1 << 40) - 1, held + 8
        held -= n
        return bits >> held & (1 << n) - 1

    def symbol(codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | take(1)
            if (n, code) in codes:
                return codes[n, code]
        raise ValueError("no such Huffman code")

    def signed(n: int) -> int:
        x = take(n) if n else 0
        return x if not n or x >> n - 1 else x - (1 << n) + 1

    if len(parts) == 1:  # a scan of one component has no sampling
        parts = [(parts[0][0], 1, 1, parts[0][3])]
    across, down = max(p[1] for p in parts), max(p[2] for p in parts)
    columns, rows = -(-width // (8 * across)), -(-height // (8 * down))
    first = parts[0]
    out = np.zeros((rows * first[2] * 8, columns * first[1] * 8))
    before = dict.fromkeys((p[0] for p in parts), 0)
    for unit in range(rows * columns):
        if restart and unit and unit % restart == 0:
            place = next(k for k in range(max(0, place - 2), len(data) - 1) if data[k] == 0xFF and 0xD0 <= data[k + 1] <= 0xD7) + 2
            bits, held, before = 0, 0, dict.fromkeys(before, 0)
        for name, h, v, q in parts:
            dc, ac = uses[name]
            for k in range(h * v):
                block = np.zeros(64, dtype=np.int64)
                before[name] += signed(symbol(tables[dc]))
                block[0], n = before[name], 1
                while n < 64:
                    rs = symbol(tables[0x10 | ac])
                    if rs == 0:
                        break
                    n += rs >> 4
                    if rs & 15:
                        if n > 63:
                            raise ValueError("a run beyond the block")
                        block[n] = signed(rs & 15)
                    n += 1
                if name == first[0]:
                    square = np.zeros(64)
                    square[_ZIGZAG] = block * quant[q]
                    y, x = (unit // columns * v + k // h) * 8, (unit % columns * h + k % h) * 8
                    out[y : y + 8, x : x + 8] = _DCT.T @ square.reshape(8, 8) @ _DCT
    return np.clip(np.rint(out[:height, :width] + 128), 0, 255).astype(np.uint8)


@_readable
def decode_any(jpeg: bytes) -> np.ndarray:
    """A frame by the process that its header names, as samples of 8 bits."""
    at = 2
    while at + 4 <= len(jpeg) and jpeg[at] == 0xFF and jpeg[at + 1] not in (0xC0, 0xC1, 0xC3):
        at += 2 + struct.unpack(">H", jpeg[at + 2 : at + 4])[0]
    if jpeg[at + 1 : at + 2] in (b"\xc0", b"\xc1"):
        return decode_baseline(jpeg)
    found = decode_frame(jpeg)
    return found if found.dtype == np.uint8 else (found >> max(0, parse_header(jpeg).precision - 8) & 255).astype(np.uint8)


def decode_frames(jpegs: list[bytes]) -> list[np.ndarray]:
    """Samples of each frame.  Frames that all begin with the 9-bit header are unpacked as one bit matrix."""
    size = UNIT * 9 // 8
    if len(jpegs) > BLOCK:
        return [f for i in range(0, len(jpegs), BLOCK) for f in decode_frames(jpegs[i : i + BLOCK])]
    if jpegs and all(j.startswith(_HEAD) for j in jpegs):
        cut = [j[len(_HEAD) : -2].replace(b"\xff\x00", b"\xff") for j in jpegs]
        if all(len(c) == size for c in cut):
            bits = np.unpackbits(np.frombuffer(b"".join(cut), dtype=np.uint8).reshape(len(cut), size), axis=1).reshape(len(cut), UNIT, 9)
            words = bits.astype(np.uint16) @ _WEIGHTS
            return list(_restore(_BACK[words].reshape(len(cut), HEIGHT, WIDTH)))
    return [decode_any(j) for j in jpegs]


# ---------------------------------------------------------------- AVI


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(frames: list[bytes], width: int = WIDTH, height: int = HEIGHT, fps: int = FPS) -> bytes:
    most = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, fps, 0, len(frames), most, 10_000, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    bodies, index, at = [b"movi"], [], 4
    for f in frames:
        c = _chunk(b"00dc", f)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        bodies.append(c)
        at += len(c)
    return _chunk(b"RIFF", b"AVI " + hdrl + _chunk(b"LIST", b"".join(bodies)) + _chunk(b"idx1", b"".join(index)))


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        yield name, at + 8, min(end, at + 8 + size)
        at += 8 + size + size % 2


@dataclass
class Avi:
    width: int
    height: int
    frame_us: int
    frames: list[bytes]


@_readable
def read_avi(data: bytes) -> Avi:
    """Of the first video stream; Damaged if it is no AVI file.

    Frames are taken by the index where its entries lie in the file and do not overlap, else by walking ``movi``.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    size, us, movi, index = (0, 0), 1_000_000 // FPS, None, None
    for name, lo, hi in _chunks(data, 12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0])):
        if name == b"LIST" and data[lo : lo + 4] == b"hdrl":
            for inner, a, _ in _chunks(data, lo + 4, hi):
                if inner == b"avih":
                    us, size = struct.unpack_from("<I", data, a)[0], struct.unpack_from("<II", data, a + 32)
        elif name == b"LIST" and data[lo : lo + 4] == b"movi":
            movi = (lo, hi)
        elif name == b"idx1":
            index = np.frombuffer(data[lo : hi - (hi - lo) % 16], dtype="<u4").reshape(-1, 4)
    if movi is None:
        raise ValueError("no movi list")
    video = int.from_bytes(b"00dc", "little")
    if index is not None:
        rows = index[index[:, 0] == video].astype(np.int64)
        base = movi[0] if not len(rows) or data[movi[0] + int(rows[0, 2]) : movi[0] + int(rows[0, 2]) + 4] == b"00dc" else 0  # offsets from movi or from the file
        spans = rows[np.argsort(rows[:, 2], kind="stable"), 2:]
        ends = base + spans[:, 0] + 8 + spans[:, 1]
        if not len(rows) or (ends[-1] <= len(data) and (ends[:-1] <= base + spans[1:, 0]).all()):
            return Avi(*size, us, [data[base + o + 8 : base + o + 8 + n] for o, n in rows[:, 2:].tolist()])
    return Avi(*size, us, [data[a:b] for name, a, b in _chunks(data, movi[0] + 4, movi[1]) if name == b"00dc"])


# ---------------------------------------------------------------- shots


def cuts(frames: np.ndarray) -> list[int]:
    """First frames of the shots.  A cut is where the histogram difference (0 to 1) exceeds the mean of
    the shot's differences so far by SPREADS of their deviations, and LEAST."""
    n = len(frames)
    if not n:
        return []
    flat = frames.reshape(n, -1)
    binned = (flat.astype(np.int64) * BINS >> 8) + np.arange(n)[:, None] * BINS
    hist = np.bincount(binned.ravel(), minlength=n * BINS).reshape(n, BINS)
    diff = (np.abs(np.diff(hist, axis=0)).sum(axis=1) / (2 * flat.shape[1])).tolist()
    found, many, total, squares = [0], 0, 0.0, 0.0
    for at, d in enumerate(diff, 1):
        if many >= WARM and d > LEAST and d > total / many + SPREADS * max(0.0, squares / many - (total / many) ** 2) ** 0.5:
            found.append(at)
            many, total, squares = 0, 0.0, 0.0
        else:
            many, total, squares = many + 1, total + d, squares + d * d
    return found


def _samples(avi: Avi) -> np.ndarray:
    frames = decode_frames(avi.frames)
    if len({f.shape for f in frames}) > 1:
        raise Damaged("frames of different sizes")
    if frames and not frames[0].size:
        raise Damaged("frames without samples")
    return np.stack(frames) if frames else np.zeros((0, max(1, avi.height), max(1, avi.width)), dtype=np.uint8)


def store(payload: bytes) -> bytes:
    """An AVI file whose samples, in order, are the payload; a multiple of UNIT bytes.

    A file holds 2 GiB, as does a cell of a table: a payload beyond MOST bytes is a ValueError.
    """
    if len(payload) > MOST:
        raise ValueError(f"a payload of {len(payload)} bytes; a file takes {MOST}")
    return write_avi(encode_frames(np.frombuffer(payload, dtype=np.uint8).reshape(-1, HEIGHT, WIDTH)))


def padded(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + b" " * ((-len(data)) % UNIT if data else UNIT)


FLUSH = 16 << 20


def with_media(df: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row_id, n_bytes, media): texts stored as AVI files.  A null text is stored like an empty one."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, media, held = [], [], [], 0
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                n, payload = padded(t.as_py())
                ids.append(i.as_py())
                sizes.append(n)
                media.append(store(payload))
                held += len(media[-1])
                if held > FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, type=batch.schema.field(0).type), pa.array(sizes, type=pa.int64()), pa.array(media, type=pa.binary())], [row_id, "n_bytes", "media"])
                    ids, sizes, media, held = [], [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, type=batch.schema.field(0).type), pa.array(sizes, type=pa.int64()), pa.array(media, type=pa.binary())], [row_id, "n_bytes", "media"])

    return df.select(F.col(row_id), F.col(text)).mapInArrow(each, f"`{row_id}` {df.schema[row_id].dataType.simpleString()}, n_bytes long, media binary")


def clips(df: DataFrame, row_id: str = "doc_id", media: str = "media") -> DataFrame:
    """One row per shot: row_id, clip, start_s, end_s, frames.  A null or damaged file, or one with a frame
    that is damaged or of another size, has no clips; no bytes make the job fail."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, m in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    avi = read_avi(m.as_py() or b"")
                    frames = _samples(avi)
                except Damaged:
                    continue
                starts = cuts(frames)
                rows += [(i.as_py(), k, a * avi.frame_us / 1e6, b * avi.frame_us / 1e6, b - a) for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(frames)], strict=True))]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [batch.schema.field(0).type, pa.int32(), pa.float64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, kinds, strict=True)], [row_id, "clip", "start_s", "end_s", "frames"])

    return df.select(F.col(row_id), F.col(media)).mapInArrow(each, f"`{row_id}` {df.schema[row_id].dataType.simpleString()}, clip int, start_s double, end_s double, frames long")


def described(df: DataFrame, row_id: str = "doc_id") -> DataFrame:
    """Of (row_id, n_bytes, media): what reading the stored bytes back gives.

    ``feature`` names the frames, the shots' first frames and the mean sample of each shot.
    """
    names = [row_id, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, n, m in zip(*batch.columns, strict=True):
                m = m.as_py()
                frames = _samples(read_avi(m))
                payload, starts = frames.tobytes(), cuts(frames)
                means = np.add.reduceat(frames.reshape(len(frames), -1).sum(axis=1, dtype=np.int64), starts) // (np.diff([*starts, len(frames)]) * UNIT)
                feature = f"frames={len(frames)};" + ",".join(f"{s}:{x}" for s, x in zip(starts, means.tolist(), strict=True))
                rows.append((i.as_py(), n.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, kinds, strict=True)], names)

    return df.mapInArrow(each, f"`{row_id}` {df.schema[row_id].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(with_media(table(spark, sf_dir, "documents")))


QUERIES = {"op2_media": op2_media}
ORACLES: dict[str, str] = {}
