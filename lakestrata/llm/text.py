"""Shared plumbing of the text operators: Arrow batches in, columns out, and
vectorised word tables over UTF-8 bytes.

Texts are always taken whole. A batch that Spark hands to Python is cut into
pieces of bounded bytes (whole texts; one longer text is a piece of its own),
so the memory of a worker follows the longest text, not the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

PIECE_BYTES = 1 << 20
try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library: nothing to do
    _LIBC = None

#: ASCII white space that separates plain words: \x20 and \x09-\x0D.
_BLANK = bytes([0x20, *range(0x09, 0x0E)])
#: ASCII that separates letter words: everything but digits and letters.
_PUNCT = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def _table(separators: bytes, fold: bool) -> bytes:
    """A byte translation table: separators to a space, A-Z to a-z if folding."""
    out = bytearray(range(256))
    if fold:
        for b in range(0x41, 0x5B):
            out[b] = b + 32
    for b in separators:
        out[b] = 0x20
    return bytes(out)


PLAIN = _table(_BLANK, False)  # words [^\x20\x09-\x0D]+
PLAIN_FOLDED = _table(_BLANK, True)  # the same, A-Z lower-cased
LETTERS_FOLDED = _table(_PUNCT, True)  # words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z


def two_columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under fixed names; other columns never matter."""
    return df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))


def _pieces(batch: pa.RecordBatch, most: int = PIECE_BYTES) -> Iterator[tuple[pa.Array, list[str | None]]]:
    texts = batch.column("_text")
    sizes = np.diff(np.frombuffer(texts.cast(pa.large_string()).buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]) if len(texts) else np.zeros(0, np.int64)
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and held + n > most:
            yield batch.column("_id")[begin:i], texts[begin:i].to_pylist()
            begin, held = i, 0
        held += int(n)
    if begin < len(texts):
        yield batch.column("_id")[begin:], texts[begin:].to_pylist()


#: Whose memos the worker holds, and how they are given back.
_held: list = ["", None]


def tidy() -> None:
    """Gives freed memory back to the system; called where a task ends, as the
    worker stays for others."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def claim(name: str, forget: Callable[[], None] | None = None) -> None:
    """Called where a task begins: memos of another operator go, those of the
    same one stay for the worker's next task."""
    if _held[0] != name:
        if _held[1]:
            _held[1]()
        _held[:] = [name, forget]


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL string; call it on the driver."""
    return to_arrow_schema(StructType.fromDDL(ddl))


def map_texts(df: DataFrame, id_col: str, text_col: str, out_id: str, columns: str, fn: Callable[[list[str | None]], dict], keep_text: str | None = None, forget: Callable[[], None] | None = None, piece: int = PIECE_BYTES, keep: bool = True) -> DataFrame:
    """One output row for each input row, without a shuffle.

    fn gets a list of texts (None for null) and returns a list or array for
    each of `columns` (a DDL string). keep_text names a column that carries
    the text through; forget gives back what fn keeps between tasks, once the
    worker goes on to another operator, or at the end of every task (keep=False);
    piece is how many bytes of texts fn gets at most (a longer text comes alone).
    """
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"`{out_id}` {id_type}" + (f", `{keep_text}` string" if keep_text else "") + f", {columns}"

    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(columns if forget else "", forget)
        try:
            for batch in batches:
                for ids, texts in _pieces(batch, piece):
                    made = fn(texts)
                    arrays = []
                    for field in out:
                        if field.name == out_id:
                            arrays.append(ids.cast(field.type))
                        elif keep_text and field.name == keep_text:
                            arrays.append(pa.array(texts, field.type))
                        else:
                            arrays.append(pa.array(made[field.name], field.type))
                    yield pa.RecordBatch.from_arrays(arrays, schema=out)
        finally:
            if not keep:
                claim("")
            tidy()

    return two_columns(df, id_col, text_col).mapInArrow(run, schema)


# ---------------------------------------------------------------- word tables

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, kept for the next call."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, PIECE_BYTES + 4096)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            np.cumprod(have, out=have)
        if size > 8 * PIECE_BYTES:
            return have
        _powers[int(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words (the splitmix64 constants)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hash_spaced(spaced: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the space-separated words of one piece."""
    b = np.frombuffer(spaced, dtype=np.uint8)
    inside = np.empty(len(b) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    np.not_equal(b, 0x20, out=inside[1:-1].view(bool))
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(b) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_CODE[b] * powers(_BASE, len(b)), out=total[1:])
        h = (total[ends] - total[starts]) * powers(_BASE_INVERSE, len(b) + 1)[starts]
        h = mix(h + (ends - starts).astype(np.uint64))
    return starts, ends, h


def word_hashes(texts: list[str | None], table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts in order, and the index in that
    array at which each text begins (with one more entry for the end)."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    first = np.zeros(len(raw) + 1, dtype=np.int64)
    if sum(map(len, raw)) <= 4 * PIECE_BYTES:
        spaced = b" ".join(raw).translate(table)
        starts, _, h = _hash_spaced(spaced)
        at = np.cumsum([0, *(len(x) + 1 for x in raw)])
        first[:] = np.searchsorted(starts, at)
        return h, first
    hashes = []
    for i, x in enumerate(raw):
        spaced, begin, n = x.translate(table), 0, 0
        while begin < len(spaced):
            end = len(spaced) if len(spaced) - begin <= PIECE_BYTES else spaced.find(b" ", begin + PIECE_BYTES)
            end = len(spaced) if end < 0 else end
            h = _hash_spaced(spaced[begin:end])[2]
            hashes.append(h)
            n += len(h)
            begin = end
        first[i + 1] = first[i] + n
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), first


def window_hashes(words: np.ndarray, n: int, base: int = 0xD1342543DE82EF95) -> np.ndarray:
    """Hashes of every run of n consecutive words of one array, len - n + 1 of
    them; runs may cross texts, the caller masks those out."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    one = np.uint64(base | 1)
    with np.errstate(over="ignore"):
        if n <= 8:
            h = np.zeros(len(words) - n + 1, dtype=np.uint64)
            for j in range(n):
                h = h * one + words[j : len(words) - n + 1 + j]
            return mix(h)
        inverse = np.uint64(pow(base | 1, -1, 2**64))
        total = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(words * powers(one, len(words)), out=total[1:])
        return mix((total[n:] - total[:-n]) * powers(inverse, len(words) + 1)[: len(words) - n + 1])


def covered(starts: np.ndarray, n: int, length: int) -> np.ndarray:
    """Which of `length` words lie in a window of n words at one of `starts`."""
    step = np.zeros(length + 1, dtype=np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + n, length), -1)
    return np.cumsum(step[:-1]) > 0


def flat_map_texts(df: DataFrame, keys: list[str], columns: str, fn: Callable[[list[str | None]], tuple[np.ndarray, dict]]) -> DataFrame:
    """Any number of rows for each row of df(_id, _text, keys...), without a
    shuffle. fn returns which text each new row comes from, and the columns;
    the key columns are repeated in front of them."""
    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), columns])
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("")
        for batch in batches:
            at = 0
            for ids, texts in _pieces(batch):
                part, at = batch.slice(at, len(ids)), at + len(ids)
                row, made = fn(texts)
                take = pa.array(row, pa.int64())
                arrays = [part.column(k).take(take) for k in keys] + [pa.array(made[f.name], f.type) for f in list(out)[len(keys) :]]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, out, strict=True)], schema=out)
        tidy()

    return df.mapInArrow(run, schema)
