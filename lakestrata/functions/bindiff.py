"""Binary deltas between two byte strings.

A delta says which stretches of the new bytes resemble stretches of the old
(covers), what to add to them byte by byte (mostly zeros, so run-length coded),
and the rest as it is. Its format is our own:

    magic, old size, new size, CRC-32C of the new bytes, number of covers, and
    three streams (covers, differences, rest), each with its packed and raw
    size, packed with LZ4 where that helps.

Damage of any kind, or the wrong old bytes, raises an error.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

from ..errors import ChecksumMismatch, Corruption, PreconditionFailed
from .checksums import crc32c

MAGIC = b"LSDELTA1"
_HEAD = struct.Struct("<8sQQII")
_STREAM = struct.Struct("<QQ")
GRAM = 16  # bytes that must agree to start a cover
STEP = 8  # old positions that are indexed
REACH = 4096  # a cover grows by blocks of this size
MIN_RUN = 3
MIN_PACK = 32


def put_varint(out: bytearray, value: int) -> None:
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)


def put_signed(out: bytearray, value: int) -> None:
    put_varint(out, value << 1 if value >= 0 else (-value << 1) | 1)


class Cursor:
    """Reads numbers from bytes; running off the end is corruption."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def varint(self) -> int:
        value = shift = 0
        while True:
            if self.at >= len(self.data) or shift > 63:
                raise Corruption("varint")
            b = self.data[self.at]
            self.at += 1
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value
            shift += 7

    def signed(self) -> int:
        v = self.varint()
        return -(v >> 1) if v & 1 else v >> 1

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise Corruption("stream is cut short")
        self.at += n
        return self.data[self.at - n : self.at]


ZERO, ONES, REPEAT, LITERAL = range(4)


def rle_encode(data: bytes) -> bytes:
    """Runs of 0, of 255, of another byte, and literals."""
    out = bytearray()
    if not data:
        return b""
    a = np.frombuffer(data, np.uint8)
    edges = np.concatenate(([0], np.flatnonzero(a[1:] != a[:-1]) + 1, [len(a)]))
    literal = 0  # where pending literals begin

    def flush(end: int) -> None:
        if end > literal:
            put_varint(out, (end - literal) << 2 | LITERAL)
            out.extend(data[literal:end])

    for begin in np.flatnonzero(np.diff(edges) >= MIN_RUN):
        a0, a1 = int(edges[begin]), int(edges[begin + 1])
        flush(a0)
        byte = data[a0]
        kind = ZERO if byte == 0 else ONES if byte == 255 else REPEAT
        put_varint(out, (a1 - a0) << 2 | kind)
        if kind == REPEAT:
            out.append(byte)
        literal = a1
    flush(len(data))
    return bytes(out)


def rle_decode(packed: bytes, size: int) -> bytes:
    c, out = Cursor(packed), bytearray()
    while c.at < len(packed):
        head = c.varint()
        n, kind = head >> 2, head & 3
        if n == 0 or len(out) + n > size:
            raise Corruption("run length")
        out += c.take(n) if kind == LITERAL else bytes([(0, 255)[kind] if kind < REPEAT else c.take(1)[0]]) * n
    if len(out) != size:
        raise Corruption("difference size")
    return bytes(out)


def find_covers(old: bytes, new: bytes) -> list[tuple[int, int, int]]:
    """(old start, new start, length), ascending in the new bytes. The shift of
    the last cover is tried first; a cover goes on over blocks of which at least
    5 of 8 bytes agree."""
    index: dict[bytes, int] = {}
    for i in range(0, len(old) - GRAM + 1, STEP):
        index.setdefault(old[i : i + GRAM], i)
    a, b = np.frombuffer(old, np.uint8), np.frombuffer(new, np.uint8)
    covers: list[tuple[int, int, int]] = []
    at, done, shift = 0, 0, 0
    while at + GRAM <= len(new):
        gram = new[at : at + GRAM]
        i = at + shift if 0 <= at + shift and old[at + shift : at + shift + GRAM] == gram else index.get(gram)
        if i is None:
            at += 1
            continue
        back = min(i, at - done)
        if back:
            differ = np.flatnonzero(a[i - back : i] != b[at - back : at])
            back -= int(differ[-1]) + 1 if len(differ) else 0
        length = GRAM
        while True:
            n = min(REACH, len(old) - i - length, len(new) - at - length)
            if n <= 0:
                break
            same = a[i + length : i + length + n] == b[at + length : at + length + n]
            if 8 * int(same.sum()) >= 5 * n:
                length += n
                continue
            score = np.cumsum(np.where(same, 3, -5))  # the best end within the block
            best = int(np.argmax(score))
            length += best + 1 if score[best] > 0 else 0
            break
        while length > GRAM and a[i + length - 1] != b[at + length - 1]:
            length -= 1
        covers.append((i - back, at - back, length + back))
        at += length
        done, shift = at, i - at + length
    return covers


def _pack(raw: bytes) -> bytes:
    if len(raw) >= MIN_PACK:
        packed = pa.Codec("lz4_raw").compress(raw, asbytes=True)
        if len(packed) < len(raw):
            return _STREAM.pack(len(packed), len(raw)) + packed
    return _STREAM.pack(len(raw), len(raw)) + raw


def diff(old: bytes, new: bytes) -> bytes:
    covers = find_covers(old, new)
    where, rest, differences = bytearray(), bytearray(), bytearray()
    a, b = np.frombuffer(old, np.uint8), np.frombuffer(new, np.uint8)
    old_at = new_at = 0
    for i, at, n in covers:
        put_signed(where, i - old_at)
        put_varint(where, at - new_at)
        put_varint(where, n)
        rest += new[new_at:at]
        differences += (b[at : at + n] - a[i : i + n]).tobytes()
        old_at, new_at = i + n, at + n
    rest += new[new_at:]
    return _HEAD.pack(MAGIC, len(old), len(new), crc32c(new), len(covers)) + _pack(bytes(where)) + _pack(rle_encode(bytes(differences))) + _pack(bytes(rest))


def _streams(delta: bytes) -> tuple[tuple, list[bytes]]:
    if len(delta) < _HEAD.size:
        raise Corruption("delta is cut short")
    head = _HEAD.unpack_from(delta)
    if head[0] != MAGIC:
        raise Corruption("delta magic")
    at, out = _HEAD.size, []
    for _ in range(3):
        if at + _STREAM.size > len(delta):
            raise Corruption("delta is cut short")
        packed, raw = _STREAM.unpack_from(delta, at)
        at += _STREAM.size
        if packed > raw or at + packed > len(delta) or raw > max(1 << 20, 4 * (head[2] + len(delta)) + 64 * head[4]):
            raise Corruption("stream size")
        data = delta[at : at + packed]
        at += packed
        if packed < raw:
            try:
                data = pa.Codec("lz4_raw").decompress(data, decompressed_size=raw, asbytes=True)
            except (OSError, pa.ArrowInvalid) as e:
                raise Corruption(f"stream: {e}") from e
        out.append(data)
    if at != len(delta) or head[4] * 3 > len(out[0]):
        raise Corruption("delta shape")
    return head, out


def header_ok(delta: bytes) -> bool:
    """Do header and stream sizes of a delta make sense?"""
    try:
        _streams(delta)
    except Corruption:
        return False
    return True


def patch(old: bytes, delta: bytes) -> bytes:
    (_, old_size, new_size, crc, n_covers), (where, packed, rest) = _streams(delta)
    if old_size != len(old):
        raise PreconditionFailed("old size")
    c, covers, old_at, new_at, total = Cursor(where), [], 0, 0, 0
    for _ in range(n_covers):
        i, at, n = old_at + c.signed(), new_at + c.varint(), c.varint()
        if i < 0 or i + n > len(old) or at + n > new_size:
            raise Corruption("cover outside of its bytes")
        covers.append((i, at, n))
        old_at, new_at, total = i + n, at + n, total + n
    if c.at != len(where) or len(rest) != new_size - total:
        raise Corruption("delta sizes")
    differences = np.frombuffer(rle_decode(packed, total), np.uint8)
    a, out = np.frombuffer(old, np.uint8), np.zeros(new_size, np.uint8)
    extra, new_at, taken, used = np.frombuffer(rest, np.uint8), 0, 0, 0
    for i, at, n in covers:
        out[new_at:at] = extra[taken : taken + at - new_at]
        taken += at - new_at
        out[at : at + n] = a[i : i + n] + differences[used : used + n]
        used, new_at = used + n, at + n
    out[new_at:] = extra[taken:]
    made = out.tobytes()
    if crc32c(made) != crc:
        raise ChecksumMismatch("patched bytes")
    return made
