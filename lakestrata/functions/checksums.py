"""Checksums and hashes that Spark has no function for.

CRC-32C is computed for a whole batch at once: buffers are cut into segments
that run in lock step, and neighbours are joined in pairs by the linear operator
that appends so many zero bytes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_POLYNOMIAL = 0x82F63B78  # Castagnoli, reflected
_SEGMENT = 64


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(_POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


_TABLE = _byte_table()
_PAIRS = np.arange(1 << 16, dtype=np.uint32)  # two bytes at a time
_PAIRS = _TABLE[(_TABLE[_PAIRS & 0xFF] ^ (_PAIRS >> np.uint32(8))) & np.uint32(0xFF)] ^ (_TABLE[_PAIRS & 0xFF] >> np.uint32(8))


@lru_cache(maxsize=64)
def _zeros(n: int) -> np.ndarray:
    """What n zero bytes (a power of two) make of a register: a table for each
    of its four bytes."""
    tables = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    if n == 1:
        return _TABLE[tables & np.uint32(0xFF)] ^ (tables >> np.uint32(8))
    half = _zeros(n // 2)
    return _append(half, half)


def _append(tables: np.ndarray, register: np.ndarray) -> np.ndarray:
    out = tables[0][register & np.uint32(0xFF)]
    for k in range(1, 4):
        out = out ^ tables[k][register >> np.uint32(8 * k) & np.uint32(0xFF)]
    return out


def crc32c_many(buffers: list[bytes | None]) -> np.ndarray:
    """CRC-32C of each buffer (None: empty). Zeros in front of a buffer do not
    count; the start value is folded into its first four bytes."""
    out = np.zeros(len(buffers), dtype=np.uint32)
    groups: dict[int, list[int]] = {}
    for i, b in enumerate(buffers):
        if b is not None and len(b) >= 4:
            groups.setdefault(max(0, (-(-len(b) // _SEGMENT) - 1).bit_length()), []).append(i)
        elif b:
            register = 0xFFFFFFFF
            for byte in b:
                register = int(_TABLE[(register ^ byte) & 0xFF]) ^ register >> 8
            out[i] = register ^ 0xFFFFFFFF
    for level, members in groups.items():
        width = _SEGMENT << level
        data = np.zeros((len(members), width), dtype=np.uint8)
        for row, i in zip(data, members, strict=True):
            at = width - len(buffers[i])
            row[at:] = np.frombuffer(buffers[i], np.uint8)
            row[at : at + 4] ^= 0xFF
        register = np.zeros((len(members), 1 << level), dtype=np.uint32)
        for column in np.ascontiguousarray(data.view("<u2").reshape(len(members), -1, _SEGMENT // 2).transpose(2, 0, 1)):
            register = _PAIRS[(register ^ column) & np.uint32(0xFFFF)] ^ (register >> np.uint32(16))
        size = _SEGMENT
        while register.shape[1] > 1:
            register = _append(_zeros(size), register[:, 0::2]) ^ register[:, 1::2]
            size *= 2
        out[members] = register[:, 0] ^ np.uint32(0xFFFFFFFF)
    return out


def crc32c(data: bytes) -> int:
    return int(crc32c_many([data])[0])


def crc32c_zeroed(data: bytes, at: int) -> int:
    """CRC-32C as if the four bytes at `at` (a stored checksum) were zero."""
    return crc32c(data[:at] + bytes(4) + data[at + 4 :])


@lru_cache(maxsize=1)
def _crc_udf():
    @F.arrow_udf("long")
    def crc(data: pa.Array) -> pa.Array:
        return pa.array(crc32c_many(data.to_pylist()).astype(np.int64))

    return crc


def crc32c_column(data: Column) -> Column:
    return _crc_udf()(data)


def crc_sequence_hash(crcs: list[int]) -> int:
    """CRC-32C over page CRCs as little-endian 32-bit words: a block's fingerprint."""
    return crc32c(np.array(crcs, dtype="<u4").tobytes())


_MASK = (1 << 64) - 1


def mix64(x: int) -> int:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _MASK
    return x ^ (x >> 31)


def mix128(hi: int, lo: int) -> int:
    """One 64-bit hash of a 128-bit key."""
    return mix64(hi ^ ((lo << 32 | lo >> 32) & _MASK) ^ 0x9E3779B97F4A7C15)


def domain_hash(domain: str, payload: bytes) -> int:
    """FNV-1a-64 of domain, a zero byte and the payload."""
    h = 0xCBF29CE484222325
    for b in domain.encode() + b"\0" + payload:
        h = (h ^ b) * 0x100000001B3 & _MASK
    return h


def content_hash(data: Column) -> Column:
    return F.sha2(data, 256)
