"""Ordered-sequence building blocks: keep-first, steps, islands, runs, bridging. All share one window specification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEY = ("mmsi",)


def micros(t: Column | str) -> Column:
    return F.unix_micros(F.col(t) if isinstance(t, str) else t)


def by_time(key: Sequence[str] = KEY, order: Sequence[str] = ("t",)) -> WindowSpec:
    return Window.partitionBy(*key).orderBy(*order)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row for each key: the first in `order`, which should end in a unique column."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def islands(df: DataFrame, starts: Column, key: Sequence[str] = KEY, name: str = "island", order: Sequence[str] = ("t",)) -> DataFrame:
    """Number of rows so far, this one included, at which an island starts."""
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(by_time(key, order).rowsBetween(Window.unboundedPreceding, 0)))


def runs(df: DataFrame, flag: str, max_gap_s: float, key: Sequence[str] = KEY, name: str = "run") -> DataFrame:
    """The flagged rows with the number of their run: an unflagged row or a step over max_gap_s ends it."""
    step = (micros("t") - F.lag(micros("t")).over(by_time(key))) / 1e6
    marked = df.withColumn("_step", step)
    marked = islands(marked, ~F.col(flag) | F.col("_step").isNull() | (F.col("_step") > max_gap_s), key, name)
    return marked.where(flag).drop("_step")


def bridge(df: DataFrame, flag: str, max_s: float, key: Sequence[str] = KEY) -> DataFrame:
    """Flag unflagged rows between two flagged ones at most max_s apart."""
    at = F.when(F.col(flag), micros("t"))
    before = F.last(at, ignorenulls=True).over(by_time(key).rowsBetween(Window.unboundedPreceding, -1))
    # Backwards in time, as a frame that shrinks towards the end would be walked again for every row.
    after = F.last(at, ignorenulls=True).over(Window.partitionBy(*key).orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_b", before).withColumn("_a", after).withColumn(flag, F.col(flag) | F.coalesce((F.col("_a") - F.col("_b")) / 1e6 <= max_s, F.lit(False))).drop("_a", "_b")


def forward_fill(df: DataFrame, column: str, key: Sequence[str] = KEY, default: float = 0.0) -> DataFrame:
    return df.withColumn(column, F.coalesce(F.last(column, ignorenulls=True).over(by_time(key).rowsBetween(Window.unboundedPreceding, 0)), F.lit(default)))


def decimate(df: DataFrame, most: int, key: Sequence[str]) -> DataFrame:
    """Every k-th row of each key, such that at most `most` remain."""
    n, k = F.count("*").over(Window.partitionBy(*key)), F.row_number().over(by_time(key)) - 1
    return df.withColumn("_n", n).withColumn("_k", k).where(F.col("_k") % F.greatest(F.lit(1), F.ceil(F.col("_n") / most)) == 0).drop("_n", "_k")


def seeded_sample(df: DataFrame, n: int, seed: int, *ids: str) -> DataFrame:
    """n rows without replacement, the same ones however the data are partitioned."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in ids))), *ids).limit(n)
