"""Build configurations: `key=value` lines, `#` comments, and for each file
`file=path|entry|source[|page size|codec|level|strategy]`."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..functions.codecs import CODECS
from ..functions.paths import normalize

STRATEGIES = ("auto", "logical", "page", "replace")
_NUMBERS = {"pack_id", "pack_version", "default_page_size", "default_codec_level", "shards"}


@dataclass(frozen=True)
class FileConfig:
    path: str
    entry: int
    source: str
    page_size: int | None = None
    codec: str | None = None
    level: int | None = None
    strategy: str | None = None


@dataclass(frozen=True)
class BuildConfig:
    pack_path: str = ""
    pack_id: int = 1
    pack_version: int = 1
    pack_name: str = "pack"
    default_page_size: int = 65536
    default_codec: str = "none"
    default_codec_level: int = 0
    default_diff_strategy: str = "auto"
    shards: int = 1
    files: tuple[FileConfig, ...] = field(default=())
    raw_hash: str = ""


def _number(text: str) -> int:
    try:
        return int(text, 0)
    except ValueError:
        raise InvalidArgument(text) from None


def _choice(text: str, allowed) -> str:
    if text not in allowed:
        raise InvalidArgument(text)
    return text


def _file(value: str) -> FileConfig:
    parts = value.split("|")
    if not 3 <= len(parts) <= 7:
        raise InvalidArgument(value)
    path, entry, source, *more = parts
    page, codec, level, strategy = [x or None for x in more] + [None] * (4 - len(more))
    return FileConfig(
        path, _number(entry), source, page and _number(page), codec and _choice(codec, CODECS), None if level is None else _number(level), strategy and _choice(strategy, STRATEGIES)
    )


def parse(data: bytes) -> BuildConfig:
    """Unknown keys, missing values and files, and zero sizes are InvalidArgument."""
    values: dict = {}
    files = []
    for line in data.decode().split("\n"):
        line = line.strip(" \t\r")
        if not line or line.startswith("#"):
            continue
        key, sign, value = line.partition("=")
        key, value = key.strip(" \t"), value.strip(" \t")
        if not sign or key not in BuildConfig.__dataclass_fields__ and key != "file" or key in ("files", "raw_hash"):
            raise InvalidArgument(line)
        if key == "file":
            files.append(_file(value))
        else:
            values[key] = _number(value) if key in _NUMBERS else value
    config = BuildConfig(**values, files=tuple(files), raw_hash=hashlib.sha256(data).hexdigest())
    _choice(config.default_codec, CODECS)
    _choice(config.default_diff_strategy, STRATEGIES)
    if not config.pack_path or not files or config.default_page_size == 0 or config.shards < 1:
        raise InvalidArgument("build configuration")
    return config


PLAN = "ordinal long, path string, entry long, source string, page_size int, codec string, level int, strategy string"


def plan(spark: SparkSession, config: BuildConfig) -> DataFrame:
    """The files with all defaults resolved, in order."""
    rows = [
        (
            i, normalize(f.path), f.entry, f.source, f.page_size or config.default_page_size, f.codec or config.default_codec,
            config.default_codec_level if f.level is None else f.level, f.strategy or config.default_diff_strategy,
        )
        for i, f in enumerate(config.files)
    ]
    return spark.createDataFrame(rows, PLAN)


def with_sources(spark: SparkSession, planned: DataFrame) -> DataFrame:
    """Adds data, the bytes of each source file, read by executors."""
    wanted = [r.source for r in planned.select("source").distinct().collect()]
    read = spark.read.format("binaryFile").load(wanted).select(F.col("path").alias("_uri"), F.col("content").alias("data"))
    name = F.regexp_replace("_uri", "^file:/+", "/")
    source = F.regexp_replace("source", "^file:/+", "/")
    return planned.withColumn("_uri", source).join(read.withColumn("_uri", name), "_uri").drop("_uri")
