"""Current and usable records of a table of delivered vector records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOWEST = -(2**63)


def change_time(timestamp: str = "timestamp", last_accessed: str = "last_accessed") -> Column:
    """Time of a row's last change: the write time, or the read time where that is null or 0.

    Null if both are missing.
    """
    ts, la = F.col(timestamp), F.col(last_accessed)
    return F.when(ts.isNull() | (ts == 0), la).otherwise(ts)


def current_rows(df: DataFrame, *columns: str) -> DataFrame:
    """One row for each id: that of the greatest change time, then of the latest arrival.

    Rows with a null id are left out. A missing change time or arrival counts
    as the earliest. Rows that tie in both are equal by contract, so any of
    them may be taken. Partial aggregation drops outdated versions before the
    shuffle; a hot id is therefore no hot task.
    """
    order = F.struct(
        F.coalesce(change_time(), F.lit(LOWEST)).alias("c"),
        F.coalesce(F.unix_micros(F.col("ingested_at").cast("timestamp")), F.lit(LOWEST)).alias("i"),
    )
    kept = df.where(F.col("id").isNotNull()).groupBy("id").agg(F.max_by(F.struct(*columns), order).alias("r"))
    return kept.select("id", *[F.col(f"r.{c}").alias(c) for c in columns])


def is_usable(vector: str = "vector", dimension: int = 128) -> Column:
    """True if the vector has ``dimension`` elements, all finite and not all 0; never null."""
    v = F.col(vector)
    limit = F.lit(3.5e38)
    finite = F.forall(v, lambda x: F.coalesce((x <= limit) & (x >= -limit), F.lit(False)))
    return F.coalesce((F.size(v) == dimension) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def usable_records(df: DataFrame, *extra: str, dimension: int = 128) -> DataFrame:
    """Current rows whose own vector is usable, as ``(id, vector, *extra)``.

    No older version stands in for a current row that isn't usable.
    """
    return current_rows(df, "vector", *extra).where(is_usable("vector", dimension))
