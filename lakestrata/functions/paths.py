"""Virtual paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidArgument

SEPARATORS = r"[/\\]+"


def segments(path: Column) -> Column:
    return F.filter(F.split(path, SEPARATORS), lambda s: s != "")


def is_valid_path(path: Column) -> Column:
    """Not empty, no '.' or '..' segment, no NUL."""
    parts = segments(path)
    return (F.size(parts) > 0) & ~F.exists(parts, lambda s: s.isin(".", "..")) & ~F.contains(path, F.lit("\0"))


def normalize_path(path: Column) -> Column:
    """Backslashes are slashes, leading and repeated ones go; null if invalid."""
    return F.when(is_valid_path(path), F.array_join(segments(path), "/"))


def checked_path(path: Column) -> Column:
    """As normalize_path, but an invalid path fails the query."""
    return F.coalesce(normalize_path(path), F.raise_error(F.concat(F.lit("invalid_argument: path "), F.coalesce(path, F.lit("null")))))


def normalize(path: str) -> str:
    """The same for one path on the driver."""
    parts = [p for p in path.replace("\\", "/").split("/") if p]
    if not parts or any(p in (".", "..") for p in parts) or "\0" in path:
        raise InvalidArgument(path)
    return "/".join(parts)
