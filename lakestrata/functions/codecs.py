"""Page codecs: none and LZ4 blocks."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa

from ..errors import ChecksumMismatch, Corruption, UnsupportedCodec
from .checksums import crc32c


@dataclass(frozen=True)
class Capabilities:
    """What a codec can do at run time; `deterministic` allows comparing stored bytes."""

    compress: bool
    decompress: bool
    deterministic: bool


CODECS = {
    "none": Capabilities(True, True, True),
    "lz4": Capabilities(True, True, True),
    "zstd": Capabilities(False, False, False),  # reserved
}


def capabilities(codec: str) -> Capabilities:
    try:
        return CODECS[codec]
    except KeyError:
        raise UnsupportedCodec(codec) from None


def build_tag(codec: str) -> str:
    """Names the encoder's build: page deltas of compressed pages depend on it."""
    return f"{codec}-{pa.__version__}" if codec != "none" else codec


def encode(codec: str, raw: bytes) -> tuple[str, bytes]:
    """(codec, payload); what does not shrink is stored as it is."""
    if not capabilities(codec).compress:
        raise UnsupportedCodec(codec)
    if codec == "lz4" and raw:
        packed = pa.Codec("lz4_raw").compress(raw, asbytes=True)
        if len(packed) < len(raw):
            return "lz4", packed
    return "none", raw


def decode(codec: str, payload: bytes, raw_size: int, raw_crc: int | None = None) -> bytes:
    """The raw page; sizes and the CRC (if given) must agree."""
    if not capabilities(codec).decompress:
        raise UnsupportedCodec(codec)
    if codec == "lz4":
        try:
            raw = pa.Codec("lz4_raw").decompress(payload, decompressed_size=raw_size, asbytes=True) if raw_size else b""
        except (OSError, pa.ArrowInvalid) as e:
            raise Corruption(f"lz4 block: {e}") from e
    else:
        raw = payload
    if len(raw) != raw_size:
        raise Corruption("page size")
    if raw_crc is not None and crc32c(raw) != raw_crc:
        raise ChecksumMismatch("page")
    return raw
