"""Numbers as byte strings in the same order, for sorted stores outside Spark; inside, DoubleType sorts them as they are."""

from __future__ import annotations

import struct


def to_bits(x: float) -> int:
    """A 64-bit unsigned integer; greater for greater numbers.  NaN has no place."""
    raw = struct.unpack(">Q", struct.pack(">d", x + 0.0))[0]
    return raw ^ (0xFFFFFFFFFFFFFFFF if raw >> 63 else 1 << 63)


def to_key(x: float) -> bytes:
    """Ten base-128 digits, most significant first, without trailing zeros."""
    bits = to_bits(x)
    digits = bytes(bits >> 7 * k & 127 for k in range(9, -1, -1))
    return digits.rstrip(b"\0")


def text_to_key(text: str) -> bytes:
    return to_key(float(text))


def key_to_text(key: bytes) -> str:
    bits = 0
    for d in key.ljust(10, b"\0"):
        bits = bits << 7 | d
    raw = bits ^ (1 << 63 if bits >> 63 else 0xFFFFFFFFFFFFFFFF)
    return repr(struct.unpack(">d", struct.pack(">Q", raw))[0])

