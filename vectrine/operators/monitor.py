"""Usage history, quotas, health, capabilities and targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def latest(history: DataFrame, n: int) -> DataFrame:
    """The last ``n`` samples (ts, usage), with ``place`` from the oldest of them."""
    top = history.orderBy(F.desc("ts")).limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy("ts")))


def usage_trend(history: DataFrame, samples: int = 5) -> DataFrame:
    """``(trend, rate, confidence)``: growth in bytes an hour over the last samples."""
    last = latest(history, samples)
    s = last.agg(F.count(F.lit(1)).alias("n"), F.min_by("usage", "ts").alias("u0"), F.max_by("usage", "ts").alias("u1"), F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    span = F.col("t1") - F.col("t0")
    rate = (F.col("u1") - F.col("u0")) / F.nullif(span, F.lit(0)) * 3_600_000
    few = F.col("n") < 3
    trend = F.when(few, "insufficient_data").when((span == 0) | (F.abs(rate) < 1024), "stable").when(rate > 0, "increasing").otherwise("decreasing")
    sure = F.when(few, 0.0).when(span == 0, 0.5).otherwise(F.least(F.col("n") / 10, F.lit(1.0)))
    return s.select(trend.alias("trend"), F.when(~few, rate).alias("rate"), sure.alias("confidence"))


def time_to_full(history: DataFrame, available: float, samples: int = 10, least: int = 5) -> DataFrame:
    """``(ms)`` until the available bytes are used up; null without growth or with too few samples."""
    last = latest(history, samples)
    s = last.agg(F.count(F.lit(1)).alias("n"), F.min_by("usage", "ts").alias("u0"), F.max_by("usage", "ts").alias("u1"), F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    grown, span = F.col("u1") - F.col("u0"), F.col("t1") - F.col("t0")
    return s.select(F.when((F.col("n") >= least) & (grown > 0) & (span > 0), F.lit(float(available)) / (grown / span)).alias("ms"))


def quota_level(ratio: Column, margin: float = 0.15) -> Column:
    return F.when(ratio >= 0.95, "emergency").when(ratio >= 0.9, "critical").when(ratio >= 1 - margin, "warning").otherwise("ok")


def check_interval(ratio: Column) -> Column:
    """Operations until the next check."""
    return F.when(ratio > 0.9, 10).when(ratio > 0.8, 50).when(ratio > 0.7, 100).when(ratio > 0.5, 500).otherwise(1000)


def breakdown(df: DataFrame, group: str, size: Column) -> DataFrame:
    """``(group, records, bytes)`` of storage."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("records"), F.sum(size).alias("bytes"))


class QuotaError(RuntimeError):
    """A write would pass the safety margin."""


def guard_write(used: float, quota: float, evict) -> float:
    """Checks a store before a write. From 95 % on ``evict(share)`` is asked for a tenth, from 98 % for a fifth, of the bytes; returns the bytes in use."""
    ratio = used / quota if quota else 0.0
    if ratio < 0.95:
        return used
    used = evict(0.2 if ratio >= 0.98 else 0.1)
    if quota and used / quota >= 0.95:
        raise QuotaError(f"{used:.0f} of {quota:.0f} bytes are in use")
    return used


def health(parts: dict[str, float | bool | None]) -> dict:
    """Worst state of the parts: a share in use (degraded from 0.8, critical from 0.95) or whether a part works."""
    order = ("healthy", "unknown", "degraded", "critical")

    def state(x: float | bool | None) -> str:
        if x is None:
            return "unknown"
        if isinstance(x, bool):
            return "healthy" if x else "critical"
        return "critical" if x >= 0.95 else "degraded" if x >= 0.8 else "healthy"

    states = {k: state(v) for k, v in parts.items()}
    return {"status": max(states.values(), key=order.index, default="unknown"), "parts": states}


# Storage kinds with their tier, place, persistence, transactions and writers.
CAPABILITIES = (
    ("parquet", "core", "cluster", True, True, "many"),
    ("memory", "core", "session", False, False, "one"),
    ("json", "import", "cluster", True, False, "many"),
    ("vecf", "import", "cluster", True, False, "many"),
    ("jdbc", "import", "external", True, True, "many"),
)


def capabilities(spark: SparkSession) -> DataFrame:
    """What each kind of storage can do."""
    return spark.createDataFrame(list(CAPABILITIES), "kind string, tier string, place string, persistent boolean, transactions boolean, writers string")


# Rows from which each way of execution is chosen, the first that holds.
EXECUTION = (("gpu", 5000), ("shared-memory", 5000), ("workers", 1000), ("plain", 200), ("wasm", 128), ("simd", 100))


def execution_path(n: Column, available: tuple[str, ...] = ("workers", "plain", "simd")) -> Column:
    """Name of the way of execution that a number of rows asks for; here it documents intent only."""
    out = F.lit("sequential")
    for name, least in reversed([x for x in EXECUTION if x[0] in available]):
        out = F.when(n >= least, name).otherwise(out)
    return out


def meets_target(value: Column, target: Column, tolerance: Column, greater_is_better: Column) -> Column:
    """Whether a measurement is within the tolerance of its target."""
    return F.when(greater_is_better, value >= target * (1 - tolerance)).otherwise(value <= target * (1 + tolerance))
