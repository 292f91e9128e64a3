"""Small files next to tables, through Hadoop's file systems: pointers,
manifests, intents and locks. Whatever the tables are on, these are too."""

from __future__ import annotations

import json
import os
import time
import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import SparkSession

from ..errors import Busy, Corruption, NotFound


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def listing(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_bytes(spark: SparkSession, path: str) -> bytes:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        raise NotFound(path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """The whole file or nothing: written aside, then renamed over."""
    fs, p = _fs(spark, path)
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(aside, True)
    stream.write(bytearray(data))
    stream.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration()) if "://" in path or path.startswith("/") else None
    if context is not None:
        qualified = [context.makeQualified(x) for x in (aside, p)]
        options = spark._jvm.java.lang.reflect.Array.newInstance(spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
        context.rename(qualified[0], qualified[1], options)
    else:
        fs.delete(p, False)
        fs.rename(aside, p)


def write_new(spark: SparkSession, path: str, data: bytes) -> bool:
    """The whole file under a name that no one has, or False. Written aside and
    then linked or renamed without replacing, so of two writers one wins and no
    reader sees a part. On stores without an atomic rename a lock is needed."""
    fs, p = _fs(spark, path)
    aside = f"{path}.{uuid.uuid4().hex}.tmp"
    fs.mkdirs(p.getParent())
    if p.toUri().getScheme() in (None, "file"):
        local, mine = (spark._jvm.org.apache.hadoop.fs.Path(x).toUri().getPath() for x in (path, aside))
        with open(mine, "wb") as f:
            f.write(data)
        try:
            os.link(mine, local)
        except FileExistsError:
            return False
        finally:
            os.unlink(mine)
        return True
    stream = fs.create(spark._jvm.org.apache.hadoop.fs.Path(aside), True)
    stream.write(bytearray(data))
    stream.close()
    try:
        if not fs.exists(p) and fs.rename(spark._jvm.org.apache.hadoop.fs.Path(aside), p):
            return True
    except Exception as e:  # a name that was taken meanwhile
        if not fs.exists(p):
            raise e
    delete(spark, aside)
    return False


# ------------------------------------------------------------------- pointers


def slot_paths(path: str) -> list[str]:
    return [f"{path}.A", f"{path}.B"]


def write_pointer(spark: SparkSession, path: str, value: dict) -> None:
    """A pointer in two slots, used in turn by its epoch, each with a CRC: the
    one before stays whole while a new one is written."""
    body = json.dumps(value, sort_keys=True)
    write_json(spark, slot_paths(path)[value["epoch"] % 2], {"body": body, "crc": zlib.crc32(body.encode())})


def parse_slot(data: bytes) -> dict | None:
    """The value of a slot, or None if it is damaged."""
    try:
        kept = json.loads(data)
        return json.loads(kept["body"]) if zlib.crc32(kept["body"].encode()) == kept["crc"] else None
    except (ValueError, KeyError, TypeError, AttributeError):
        return None


def _slot(spark: SparkSession, path: str) -> dict | None:
    return parse_slot(read_bytes(spark, path))


def read_pointer(spark: SparkSession, path: str, usable: Callable[[dict], bool] = lambda value: True) -> dict:
    """The newest whole value that can be used; NotFound if there never was one,
    Corruption if none is left."""
    there = [s for s in slot_paths(path) if exists(spark, s)]
    if not there:
        raise NotFound(path)
    for value in sorted(filter(None, (_slot(spark, s) for s in there)), key=lambda v: -v["epoch"]):
        if usable(value):
            return value
    raise Corruption(f"no usable pointer at {path}")


def damaged_slots(spark: SparkSession, path: str) -> list[str]:
    return [s for s in slot_paths(path) if exists(spark, s) and _slot(spark, s) is None]


def pointer_exists(spark: SparkSession, path: str) -> bool:
    return any(exists(spark, s) for s in slot_paths(path))


def age_s(spark: SparkSession, path: str) -> float:
    """Seconds since anything below a path changed, by its file system's clock."""
    fs, p = _fs(spark, path)
    newest, files = fs.getFileStatus(p).getModificationTime(), fs.listFiles(p, True)
    while files.hasNext():
        newest = max(newest, files.next().getModificationTime())
    return time.time() - newest / 1000


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(read_bytes(spark, path))


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    write_bytes(spark, path, json.dumps(value, sort_keys=True).encode())


class Lock:
    """A lock file made exclusively; a second holder gets Busy."""

    def __init__(self, spark: SparkSession, path: str, owner: str):
        self.spark, self.path, self.owner = spark, path, owner

    def __enter__(self) -> Lock:
        fs, p = _fs(self.spark, self.path)
        try:
            stream = fs.create(p, False)
        except Exception as e:
            raise Busy(self.path) from e
        stream.write(bytearray(self.owner.encode()))
        stream.close()
        return self

    def __exit__(self, *_) -> None:
        delete(self.spark, self.path)


def break_lock(spark: SparkSession, path: str, owner: str) -> bool:
    """Removes a lock left by a crashed owner; only the same owner may."""
    if exists(spark, path) and read_bytes(spark, path).decode() == owner:
        delete(spark, path)
        return True
    return False
