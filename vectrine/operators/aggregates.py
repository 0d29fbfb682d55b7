"""Aggregates of vectors and of numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrine.functions.vectors import mean, std


def exploded(df: DataFrame, vector: str = "vector", *keep: str) -> DataFrame:
    """A row ``(pos, value)`` for each element, with the kept columns."""
    return df.select(*keep, F.posexplode(vector).alias("pos", "value")).withColumn("value", F.col("value").cast("double"))


def by_dimension(df: DataFrame, vector: str = "vector", group: tuple[str, ...] = ()) -> DataFrame:
    """Minimum, maximum, mean, population variance and deviation of each dimension.

    Elements are reduced before the shuffle, so it holds one row for each
    group, dimension and task. Null and empty vectors count for nothing.
    """
    v = F.col("value")
    return exploded(df, vector, *group).groupBy(*group, "pos").agg(
        F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"), F.var_pop(v).alias("variance"), F.stddev_pop(v).alias("std")
    )


def centroid(df: DataFrame, vector: str = "vector", group: tuple[str, ...] = ()) -> DataFrame:
    """Mean vector of each group; an error where the vectors differ in length."""
    ragged = F.assert_true(F.min("n") == F.max("n"), F.lit("vectors of different length"))
    per = by_dimension(df, vector, group)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda x: x["mean"])  # one entry for each dimension
    return per.groupBy(*group).agg(ordered.alias("centroid"), ragged.alias("_")).drop("_")


def vector_statistics(v: Column) -> dict[str, Column]:
    """Minimum, maximum, mean, population deviation and range of a vector's elements."""
    low, high = F.array_min(v).cast("double"), F.array_max(v).cast("double")
    return {"low": low, "high": high, "mean": mean(v), "std": std(v), "span": high - low}


def batch_statistics(df: DataFrame, vector: str = "vector") -> DataFrame:
    """Statistics of each dimension and, where ``pos`` is null, of all elements: one scan, grouping sets."""
    v = F.col("value")
    return exploded(df, vector).groupingSets([["pos"], []], "pos").agg(F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))


def nearest_rank(value: str, shares: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99)) -> list[Column]:
    """Percentiles by nearest rank, named p50 and so on."""
    return [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").cast("double").alias(f"p{round(p * 100)}") for p in shares]


def profile(df: DataFrame, value: str, group: tuple[str, ...] = ()) -> DataFrame:
    """Count, range, mean, total and percentiles of timings."""
    v = F.col(value)
    return df.groupBy(*group).agg(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"), F.sum(v).alias("total"), *nearest_rank(value))
