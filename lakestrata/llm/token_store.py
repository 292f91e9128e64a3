"""Token ids in files with random access: directly addressable codes.

Every id is cut into chunks of eight bits, lowest first. Level k holds the k-th
chunk of the ids that need one, and a bitmap that says which of its entries go
on at level k + 1. An entry's place on the next level is the number of ones
before its bit, read from a rank directory plus the bits of one group. So any
token is read from a few bytes at computed places, without decoding a block.

File layout (little-endian): the magic, then counts, the table of section
offsets, document ids, document starts (in tokens, one more than documents),
then for each level its chunks, its bitmap and its rank directory, and last a
CRC-32 of all that stands before it.

Documents are stored in ascending id order, ties by hash and text. A task writes its
sorted rows to files of bounded size, under names of that attempt's own, so that
a task that runs again never meets files of a lost one and nothing is renamed.
The manifest, committed with the tasks that succeed, lists the files that count;
the global token position of each follows from it. A document id with more rows
than a partition should hold is cut into ranges of the text's hash.

Defined results: a null or empty text has only the end id; null ids come first;
repeated rows are stored each by itself; only id and text are read, so clashing
column names do no harm; an empty table gives an empty store.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.running import running_sums
from . import text as T
from .bpe import Chunks, byte_letters, encode_chunks, encode_many
from .shared import new_dir, partitions_for

MAGIC = b"DACTOK01"
GROUP = 512  # bits for each entry of a rank directory
FILE_TOKENS = 1 << 22
#: Entries of the largest memo in each of two generations (about 180 MB with those
#: beside it), and bytes of the texts that are encoded together.
MEMO_LIMIT = 400_000
PIECE = 16 << 20
_HEAD = struct.Struct("<8sQQQ")


# ------------------------------------------------------------------ the code


def build(ids: np.ndarray) -> list[tuple[bytes, bytes, bytes]]:
    """Chunks, bitmap and rank directory of every level."""
    levels, rest = [], np.ascontiguousarray(ids, dtype="<u4")
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        words = np.zeros(-(-max(len(bits), 1) // (GROUP // 8)) * (GROUP // 8), dtype=np.uint8)
        words[: len(bits)] = bits
        ones = np.bitwise_count(words.view("<u8")).reshape(-1, GROUP // 64).sum(axis=1, dtype=np.uint64)
        ranks = np.concatenate((np.zeros(1, np.uint64), np.cumsum(ones)[:-1])).astype("<u8")
        levels.append((rest.view(np.uint8)[::4].tobytes(), bits.tobytes(), ranks.tobytes()))
        if not more.any():
            return levels
        rest = rest[more] >> np.uint32(8)


def pack(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of one file. A null document id is stored as the least long."""
    levels = build(ids)
    sections = [np.array([-(2**63) if d is None else d for d in doc_ids], "<i8").tobytes(), np.concatenate(([0], np.cumsum(counts))).astype("<u8").tobytes()]
    for level in levels:
        sections += level
    at = _HEAD.size + 8 * (len(sections) + 1)
    offsets = [at]
    for s in sections:
        at += len(s)
        offsets.append(at)
    body = _HEAD.pack(MAGIC, len(doc_ids), len(ids), len(levels)) + np.array(offsets, "<u8").tobytes() + b"".join(sections)
    return body + struct.pack("<I", zlib.crc32(body))


class Reader:
    """One file, through any object with read_at(n, offset)."""

    def __init__(self, source):
        self.source = source
        magic, self.n_docs, self.n_tokens, self.n_levels = _HEAD.unpack(self._read(_HEAD.size, 0))
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.offsets = np.frombuffer(self._read(8 * (3 + 3 * self.n_levels), _HEAD.size), "<u8").astype(int).tolist()

    def _read(self, n: int, at: int) -> bytes:
        got = self.source.read_at(n, at)
        if len(got) != n:
            raise ValueError("token file is cut short")
        return bytes(got)

    def _section(self, k: int) -> bytes:
        return self._read(self.offsets[k + 1] - self.offsets[k], self.offsets[k])

    def verify(self) -> None:
        end = self.offsets[-1]
        if zlib.crc32(self._read(end, 0)) != struct.unpack("<I", self._read(4, end))[0]:
            raise ValueError("token file is damaged")

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        """Document ids, and starts with one more for the end."""
        return np.frombuffer(self._section(0), "<i8"), np.frombuffer(self._section(1), "<u8").astype(np.int64)

    def token(self, i: int) -> int:
        """Token i of the file, from a few bytes of each level."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value, shift, k = 0, 0, 0
        while True:
            chunks, bitmap, ranks = self.offsets[2 + 3 * k : 5 + 3 * k]
            value |= self._read(1, chunks + i)[0] << shift
            group = i // GROUP
            bits = int.from_bytes(self._read(i // 8 - group * GROUP // 8 + 1, bitmap + group * GROUP // 8), "little")
            if not bits >> (i % GROUP) & 1:
                return value
            before = struct.unpack("<Q", self._read(8, ranks + 8 * group))[0]
            i = before + (bits & ((1 << (i % GROUP)) - 1)).bit_count()
            shift += 8
            k += 1

    def tokens(self) -> np.ndarray:
        """All tokens of the file."""
        out = np.frombuffer(self._section(2), np.uint8).astype("<u4")
        at = None
        for k in range(1, self.n_levels):
            bits = np.frombuffer(self._section(3 * k), np.uint8)
            on = np.flatnonzero(np.unpackbits(bits, count=self.n_tokens if at is None else len(at), bitorder="little"))
            at = on if at is None else at[on]
            out[at] |= np.frombuffer(self._section(2 + 3 * k), np.uint8).astype("<u4") << np.uint32(8 * k)
        return out


# ----------------------------------------------------------------- encoding


class LibraryEncoder:
    """The tokenizers library behind a memo: a text falls into pieces that the
    library encodes independently, its model encodes each piece, and a piece
    seen before is not encoded again. Texts that hold special tokens go to the
    library as they are."""

    def __init__(self, path: str, pattern: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._letters = {b: c for b, c in byte_letters().items() if chr(b) != c}
        self._space = self._letters[0x20]
        self._chunks = Chunks(regex.compile(pattern).findall, self._word, MEMO_LIMIT)

    def _word(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            spelled = piece.replace(" ", self._space)
        else:
            spelled = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self._letters)
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        return encode_many(texts, self._chunks, self.encode, lambda t: any(s in t for s in self.specials))

    def forget(self) -> None:
        """Gives the memory of all memos back."""
        self._chunks.forget()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if any(s in text for s in self.specials):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return encode_chunks(text, self._chunks)


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> LibraryEncoder:
    return LibraryEncoder(path, pattern)


# -------------------------------------------------------------------- store

MANIFEST = "part int, segment int, path string, n_docs long, n_tokens long, n_bytes long"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write_store(df: DataFrame, tokenizer: str, pattern: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> str:
    """Encodes all texts, appends the end id to each, writes the files and the
    manifest under `path` (in the shared folder if not given); returns it.

    One shuffle, by ranges of the document id.
    """
    spark = df.sparkSession
    path = path or new_dir(spark, "tokens")
    files = f"{path}/files"
    fs, local = _open(files)
    fs.create_dir(local, recursive=True)
    ddl = MANIFEST
    out = T.arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        part, enc, fs_dir = task.partitionId(), encoder(tokenizer, pattern), _open(files)
        end = np.array([end_id], "<u4").tobytes()
        held: list[tuple[int | None, bytes]] = []
        size = segment = 0

        def flush() -> pa.RecordBatch:
            counts = np.array([len(x) // 4 for _, x in held], np.int64)
            data = pack([d for d, _ in held], counts, np.frombuffer(b"".join(x for _, x in held), "<u4"))
            name = f"{part:06d}-{segment:06d}-{task.taskAttemptId()}.dac"
            fs, folder = fs_dir
            with fs.open_output_stream(f"{folder}/{name}") as f:
                f.write(data)
            row = (part, segment, f"{files}/{name}", len(held), int(counts.sum()), len(data))
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, out, strict=True)], schema=out)

        T.claim("token store", enc.forget)
        for batch in batches:
            for ids, texts in T._pieces(batch, PIECE):
                for d, x in zip(ids.to_pylist(), enc.encode_many(texts), strict=True):
                    held.append((d, x + end))
                    size += len(held[-1][1]) // 4
                    if size >= FILE_TOKENS:
                        yield flush()
                        held, size, segment = [], 0, segment + 1
        if held:
            yield flush()
        held = []
        T.tidy()

    docs = T.two_columns(df, id_col, text_col)
    docs = docs.withColumn("_id", F.col("_id").cast("long")).withColumn("_tie", F.xxhash64("_text"))
    docs = docs.repartitionByRange(partitions_for(docs), "_id", "_tie").sortWithinPartitions("_id", "_tie", "_text").drop("_tie")
    docs.mapInArrow(run, ddl).write.parquet(f"{path}/manifest")
    return path


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The files in order, each with the number of tokens before it."""
    files = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    placed = files.select("*", F.lit(0).alias("all"), (F.col("part").cast("long") * (1 << 20) + F.col("segment")).alias("place"))
    return running_sums(placed, ["all"], "place", {"start": F.col("n_tokens")}, step=1 << 30).drop("all", "place")


def read_store(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row for each stored document: id, start (tokens of all documents
    before it), n_tokens, ids_crc32, and the ids if asked for. One task reads
    a few whole files; each is checked against its CRC."""
    ddl = f"`{id_col}` long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    out = T.arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                fs, local = _open(uri)
                with fs.open_input_file(local) as f:
                    reader = Reader(f)
                    reader.verify()
                    docs, starts = reader.documents()
                    tokens = reader.tokens()
                ids = [tokens[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]
                columns = [pa.array(docs, pa.int64(), mask=docs == -(2**63)), pa.array(starts[:-1] + base, pa.int64()), pa.array(np.diff(starts), pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.binary())] if with_ids else []), schema=out)

    files = manifest(spark, path).select("path", "start")
    return files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path").mapInArrow(run, ddl)


def token_at(spark: SparkSession, path: str, position: int) -> int:
    """The token at a global position: one manifest row, one file, a few bytes."""
    row = manifest(spark, path).where((F.col("start") <= position) & (position < F.col("start") + F.col("n_tokens"))).first()
    if row is None:
        raise IndexError(position)
    fs, local = _open(row.path)
    with fs.open_input_file(local) as f:
        return Reader(f).token(position - row.start)
