"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from ..sources import fs
from ..sources.work import base_dir, new_dir

__all__ = ["base_dir", "new_dir", "partitions_for", "scratch", "written"]

#: Paths of the tables made in the scopes that are open, the innermost last.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that were written inside, at the end. Those written
    with keep=True pass to the scope around it, or stay if there is none."""
    made: list[str] = []
    token = _scopes.set((*_scopes.get(), made))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in made:
            fs.delete(spark, path)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """The rows written to the shared folder and read again: cuts the lineage
    at files that survive the loss of any executor. keep=True where a lazy
    result still reads the table after the scope's end."""
    spark, path = df.sparkSession, new_dir(df.sparkSession, name)
    scopes = _scopes.get()
    owner = scopes[:-1] if keep else scopes
    if owner:
        owner[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions_for(df: DataFrame, bytes_each: int = 64 << 20) -> int:
    """Partitions for a shuffle of these rows: the session's number, or more
    where the planner's size estimate asks for it."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(n, min(1_000_000, -(-size // bytes_each)) if size < 1 << 60 else n)
