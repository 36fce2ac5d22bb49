"""Elias-Fano code of a non-decreasing sequence of non-negative 64-bit integers.

The lowest ``low`` bits of each value stand side by side; the rest is a bitmap in which value i sets
bit (value >> low) + i. That takes two bits and a logarithm of the mean gap a value. ``select`` finds
a value through a directory of 32-bit counts, one per 512 bits of the bitmap, so no table of offsets
is ever made.
"""

from __future__ import annotations

import struct

import numpy as np

WORDS = 8  # 64-bit words of a directory block
_HEAD = "<QQQQ"  # values, low bits, words of the bitmap, words of the low bits
_BYTES = np.arange(256, dtype=np.uint8)
#: Set bits of each byte, and the place of its k-th set bit (8 where there is none).
_COUNT = np.unpackbits(_BYTES[:, None], axis=1).sum(axis=1).astype(np.int64)
_PLACE = np.full((256, 8), 8, np.int64)
for _b in range(256):
    _PLACE[_b, : _COUNT[_b]] = [k for k in range(8) if _b >> k & 1]


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """``width`` lowest bits of each value, in 64-bit words."""
    out = np.zeros(-(-len(values) * width // 64) + 1, np.uint64)
    if width:
        at = np.arange(len(values), dtype=np.uint64) * np.uint64(width)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        part = values & np.uint64((1 << width) - 1)
        np.bitwise_or.at(out, word, part << shift)
        over = np.flatnonzero(shift + np.uint64(width) > 64)
        np.bitwise_or.at(out, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
    return out


def _unpack(words: np.ndarray, width: int, index: np.ndarray) -> np.ndarray:
    if not width:
        return np.zeros(len(index), np.uint64)
    at = index.astype(np.uint64) * np.uint64(width)
    word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    part = words[word] >> shift
    over = np.flatnonzero(shift + np.uint64(width) > 64)
    part[over] |= words[word[over] + 1] << (np.uint64(64) - shift[over])
    return part & np.uint64((1 << width) - 1)


class EliasFano:
    def __init__(self, n: int, low: int, bitmap: np.ndarray, lows: np.ndarray, ranks: np.ndarray):
        self.n, self.low, self.bitmap, self.lows, self.ranks = n, low, bitmap, lows, ranks

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values).astype(np.uint64)
        n = len(values)
        if n >= 1 << 32:
            raise ValueError("a sequence holds fewer than 2^32 values")
        if n and (values[1:] < values[:-1]).any():
            raise ValueError("values have to be in order")
        top = int(values[-1]) if n else 0
        low = max(0, (top // max(n, 1)).bit_length() - 1)
        at = (values >> np.uint64(low)) + np.arange(n, dtype=np.uint64)
        blocks = (int(at[-1]) if n else 0) // (64 * WORDS) + 1
        bitmap = np.zeros(blocks * WORDS, np.uint64)
        np.bitwise_or.at(bitmap, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        return cls(n, low, bitmap, _pack(values, low), cls._ranks(bitmap))

    @staticmethod
    def _ranks(bitmap: np.ndarray) -> np.ndarray:
        """Set bits before each block."""
        held = np.bitwise_count(bitmap).reshape(-1, WORDS).sum(axis=1)
        return (np.cumsum(held) - held).astype(np.uint32)

    def to_bytes(self) -> bytes:
        head = struct.pack(_HEAD, self.n, self.low, len(self.bitmap), len(self.lows))
        return b"".join([head, self.bitmap.astype("<u8").tobytes(), self.lows.astype("<u8").tobytes(), self.ranks.astype("<u4").tobytes()])

    @classmethod
    def from_bytes(cls, data: bytes, at: int = 0) -> tuple[EliasFano, int]:
        """The sequence written at ``at``, and the place behind it."""
        n, low, bits, lows = struct.unpack_from(_HEAD, data, at)
        at += struct.calcsize(_HEAD)
        bitmap = np.frombuffer(data, "<u8", bits, at)
        low_words = np.frombuffer(data, "<u8", lows, at + 8 * bits)
        ranks = np.frombuffer(data, "<u4", bits // WORDS, at + 8 * (bits + lows))
        return cls(n, low, bitmap, low_words, ranks), at + 8 * (bits + lows) + 4 * (bits // WORDS)

    def select(self, index: np.ndarray) -> np.ndarray:
        """Values at the given positions."""
        index = np.asarray(index, np.int64)
        if len(index) and not 0 <= index.min() <= index.max() < self.n:
            raise IndexError("no such position")
        block = np.searchsorted(self.ranks, index, side="right") - 1
        left = index - self.ranks[block]  # set bits still to pass
        # To the 64-bit word, then to its byte, then to the bit.
        held = np.bitwise_count(self.bitmap.reshape(-1, WORDS)[block]).astype(np.int64)
        passed = np.cumsum(held, axis=1)
        word = (passed <= left[:, None]).sum(axis=1)
        row = np.arange(len(index))
        left -= passed[row, word] - held[row, word]
        word += block * WORDS
        parts = self.bitmap[word].astype("<u8").view(np.uint8).reshape(-1, 8)
        held = _COUNT[parts]
        passed = np.cumsum(held, axis=1)
        byte = (passed <= left[:, None]).sum(axis=1)
        left -= passed[row, byte] - held[row, byte]
        at = word * 64 + byte * 8 + _PLACE[parts[row, byte], left]
        return ((at - index).astype(np.uint64) << np.uint64(self.low)) | _unpack(self.lows, self.low, index)
