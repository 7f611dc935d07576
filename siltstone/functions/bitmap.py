"""Compressed bitmaps over 32-bit ordinals, in NumPy.

The high 16 bits choose a container; a container holds the low 16 bits as a sorted array while it is sparse and as a
bit field once that is smaller. Set operations work container by container and never expand a dense bit field into
positions unless asked to.
"""

from __future__ import annotations

import struct

import numpy as np

#: Above this count a container's bit field (8 KiB) is smaller than its array.
SPARSE = 4096
_WORDS = 65536 // 8


def _pack(low: np.ndarray) -> np.ndarray:
    bits = np.zeros(65536, dtype=np.uint8)
    bits[low] = 1
    return np.packbits(bits, bitorder="little")


def _unpack(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words, bitorder="little")).astype(np.uint16)


def _dense(c: np.ndarray) -> bool:
    return c.dtype == np.uint8


def _shrink(words: np.ndarray) -> np.ndarray:
    low = _unpack(words)
    return low if len(low) <= SPARSE else words


def _has(words: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (words[low >> 3] >> (low & 7).astype(np.uint8)) & 1 == 1


class Bitmap:
    __slots__ = ("containers",)

    def __init__(self, containers: dict[int, np.ndarray] | None = None):
        self.containers = containers or {}

    @classmethod
    def of(cls, ordinals: np.ndarray) -> "Bitmap":
        """From ordinals in any order, repeats allowed."""
        o = np.unique(np.asarray(ordinals, dtype=np.uint32))
        high = (o >> 16).astype(np.int64)
        cuts = np.flatnonzero(np.diff(high)) + 1
        out = {}
        for part in np.split(o, cuts):
            if len(part):
                low = (part & 0xFFFF).astype(np.uint16)
                out[int(part[0] >> 16)] = low if len(low) <= SPARSE else _pack(low)
        return cls(out)

    def and_not(self, other: "Bitmap") -> "Bitmap":
        out = {}
        for k, a in self.containers.items():
            b = other.containers.get(k)
            if b is None:
                out[k] = a
                continue
            if _dense(a) and _dense(b):
                c = _shrink(a & ~b)
            elif _dense(a):
                c = a.copy()
                np.bitwise_and.at(c, b >> 3, ~np.left_shift(np.uint8(1), (b & 7).astype(np.uint8)))
                c = _shrink(c)
            elif _dense(b):
                c = a[~_has(b, a)]
            else:
                c = np.setdiff1d(a, b, assume_unique=True)
            if len(c):
                out[k] = c
        return Bitmap(out)

    def and_(self, other: "Bitmap") -> "Bitmap":
        out = {}
        for k, a in self.containers.items():
            b = other.containers.get(k)
            if b is None:
                continue
            if _dense(a) and _dense(b):
                c = _shrink(a & b)
            elif _dense(a):
                c = b[_has(a, b)]
            elif _dense(b):
                c = a[_has(b, a)]
            else:
                c = np.intersect1d(a, b, assume_unique=True)
            if len(c):
                out[k] = c
        return Bitmap(out)

    def ordinals(self) -> np.ndarray:
        parts = []
        for k in sorted(self.containers):
            c = self.containers[k]
            parts.append((_unpack(c) if _dense(c) else c).astype(np.uint32) | np.uint32(k << 16))
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)

    def __len__(self) -> int:
        return sum(int(np.unpackbits(c).sum()) if _dense(c) else len(c) for c in self.containers.values())

    def to_bytes(self) -> bytes:
        out = [struct.pack("<I", len(self.containers))]
        for k in sorted(self.containers):
            c = self.containers[k]
            out.append(struct.pack("<HI", k, 0 if _dense(c) else len(c)) + c.tobytes())
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes) -> "Bitmap":
        (n,), at, out = struct.unpack_from("<I", data), 4, {}
        for _ in range(n):
            k, size = struct.unpack_from("<HI", data, at)
            at += 6
            kind, count = (np.uint16, size) if size else (np.uint8, _WORDS)
            out[k] = np.frombuffer(data, kind, count, at)
            at += out[k].nbytes
        return cls(out)
