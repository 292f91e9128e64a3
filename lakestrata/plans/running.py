"""Running sums, maxima and neighbours that no single task has to carry.

A window over a whole shard puts that shard into one task. Here the order is
cut into steps: sums per step are small, their running sums are the offsets,
and the window runs within a step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEP = 1 << 16


def running_sums(df: DataFrame, by: list[str], order: str, values: dict[str, Column], step: int = STEP) -> DataFrame:
    """Adds, for each name, the sum of its value over earlier rows (this one
    excluded) within `by`. `order` must be a whole number and tie-free."""
    rows = df.select("*", F.floor(F.col(order) / step).cast("long").alias("_step"), *[v.alias(f"_{n}") for n, v in values.items()])
    earlier = Window.partitionBy(*by).orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*by, "_step").agg(*[F.sum(f"_{n}").alias(f"_s_{n}") for n in values])
    offsets = sums.select(*by, "_step", *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in values])
    within = Window.partitionBy(*by, "_step").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(offsets, [*by, "_step"])
    made = {n: (F.coalesce(F.sum(f"_{n}").over(within), F.lit(0)) + F.col(f"_o_{n}")).cast("long") for n in values}
    return out.select(*df.columns, *[c.alias(n) for n, c in made.items()])


def running_max(df: DataFrame, by: list[str], order: str, value: Column, name: str, step: int = STEP) -> DataFrame:
    """Adds the greatest value of earlier rows (this one excluded) within `by`,
    null where there is none. Rows that tie in `order` come in any order."""
    rows = df.select("*", F.floor(F.col(order) / step).cast("long").alias("_step"), value.alias("_value"))
    earlier = Window.partitionBy(*by).orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy(*by, "_step").agg(F.max("_value").alias("_top"))
    reached = tops.select(*by, "_step", F.max("_top").over(earlier).alias("_reached"))
    within = Window.partitionBy(*by, "_step").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(reached, [*by, "_step"])
    return out.select(*df.columns, F.greatest(F.max("_value").over(within), F.col("_reached")).alias(name))


def before(df: DataFrame, by: list[str], order: str, value: str, name: str, step: int = STEP) -> DataFrame:
    """Adds the value of the row before within `by`, null for the first."""
    rows = df.select("*", F.floor(F.col(order) / step).cast("long").alias("_step"))
    lasts = rows.groupBy(*by, "_step").agg(F.max_by(value, order).alias("_last"))
    carried = lasts.select(*by, "_step", F.lag("_last").over(Window.partitionBy(*by).orderBy("_step")).alias("_carried"))
    within = Window.partitionBy(*by, "_step").orderBy(order)
    out = rows.join(carried, [*by, "_step"])
    first = F.row_number().over(within) == 1
    return out.select(*df.columns, F.when(first, F.col("_carried")).otherwise(F.lag(value).over(within)).alias(name))
