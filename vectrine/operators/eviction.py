"""Which records to evict: pure selections, ordered running sums over the records.

A selection gives ``(id, size, place)``; applying it is an anti-join. ``now_ms``
is always given, so a selection can be repeated. Running sums are exact and
distributed: records are range-partitioned by their order, each partition
summed, and the sums of the partitions before it added.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from vectrine.session import materialize

HOUR = 3_600_000
DAY = 24 * HOUR
# Bytes that a record and the values of its metadata are counted as.
RECORD, ELEMENT, CHARACTER = 64, 4, 2
NULL, BOOLEAN, NUMBER, ARRAY, OBJECT = 8, 4, 8, 24, 48


def value_size(value: object) -> int:
    """Bytes that a JSON value is counted as."""
    if value is None:
        return NULL
    if isinstance(value, bool):
        return BOOLEAN
    if isinstance(value, (int, float)):
        return NUMBER
    if isinstance(value, str):
        return CHARACTER * len(value.encode("utf-16-le")) // 2
    if isinstance(value, list):
        return ARRAY + sum(map(value_size, value))
    return OBJECT + sum(CHARACTER * len(k) + value_size(v) for k, v in value.items())


@F.pandas_udf(LongType())
def metadata_size(texts: pd.Series) -> pd.Series:
    """Bytes that metadata is counted as; 0 where there is none, an empty object where it is broken."""

    def size(t: str | None) -> int:
        if t is None:
            return 0
        try:
            return value_size(json.loads(t))
        except ValueError:
            return OBJECT

    return texts.map(size)


def record_size(vector: Column, metadata: Column, key: Column) -> Column:
    """Estimated bytes of a record."""
    return ELEMENT * F.greatest(F.size(vector), F.lit(0)) + metadata_size(metadata) + CHARACTER * F.length(key) + RECORD


def last_access() -> Column:
    """Time of the last read, or of the write if there was none or it is 0."""
    return F.when(F.coalesce(F.col("last_accessed"), F.lit(0)) == 0, F.col("timestamp")).otherwise(F.col("last_accessed"))


def is_permanent(metadata: str = "metadata") -> Column:
    """``metadata.permanent`` is the boolean true."""
    v = F.try_parse_json(F.col(metadata))
    inside = F.try_variant_get(v, "$.permanent", "variant")
    return F.coalesce((F.schema_of_variant(inside) == "BOOLEAN") & F.try_variant_get(inside, "$", "boolean"), F.lit(False))


def measured(df: DataFrame, sizes: Column | None = None) -> DataFrame:
    """Records with ``size``, ``accessed`` and ``permanent``; those with a null id are left out."""
    size = sizes if sizes is not None else record_size(F.col("vector"), F.col("metadata"), F.col("id"))
    return df.where(F.col("id").isNotNull()).select("id", "timestamp", F.coalesce("access_count", F.lit(0)).alias("access_count"), "metadata", size.cast("bigint").alias("size"), last_access().alias("accessed"), is_permanent().alias("permanent"))


def running(df: DataFrame, order: list[Column], value: str = "size") -> DataFrame:
    """Adds ``place`` (from 1) and ``before``, the sum of ``value`` over all rows before, in a total order.

    One sort by range; the number and sum of each partition, a row each, go to
    the driver.
    """
    sorted_ = materialize(df.sort(*order).withColumn("_part", F.spark_partition_id()), "sorted")
    local = Window.partitionBy("_part").orderBy(*order)
    parts = sorted_.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s")).orderBy("_part").collect()
    offsets, n, s = [], 0, 0
    for p in parts:
        offsets.append((p["_part"], n, int(s)))
        n, s = n + p.n, s + (p.s or 0)
    off = df.sparkSession.createDataFrame(offsets, "_part int, _n bigint, _s bigint")
    inner = sorted_.withColumn("_place", F.row_number().over(local)).withColumn("_before", F.coalesce(F.sum(value).over(local.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return inner.join(F.broadcast(off), "_part").withColumn("place", (F.col("_place") + F.col("_n")).cast("bigint")).withColumn("before", (F.col("_before") + F.col("_s")).cast("bigint")).drop("_part", "_place", "_before", "_n", "_s")


def _take(df: DataFrame, order: list[Column], target: int, most: int | None, keep_permanent: bool) -> DataFrame:
    rows = df.where(~F.col("permanent")) if keep_permanent else df
    found = running(rows, order)
    if target > 0:
        found = found.where(F.col("before") < target)
    if most:
        found = found.where(F.col("place") <= most)
    return found.select("id", "size", "place")


def lru(df: DataFrame, target: int = 0, most: int | None = None, keep_permanent: bool = True) -> DataFrame:
    """Least recently used records until ``target`` bytes are freed or ``most`` records are named (0 or None: no limit)."""
    return _take(df, [F.col("accessed"), F.col("id")], target, most, keep_permanent)


def lfu(df: DataFrame, target: int = 0, most: int | None = None, keep_permanent: bool = True) -> DataFrame:
    """Least often used records, then the least recently used."""
    return _take(df, [F.col("access_count"), F.col("accessed"), F.col("id")], target, most, keep_permanent)


def ttl(df: DataFrame, now_ms: int, hours: float = 24, keep_permanent: bool = True) -> DataFrame:
    """``(id, size)`` of records not used for more than ``hours``; byte and count limits don't apply."""
    rows = df.where(~F.col("permanent")) if keep_permanent else df
    return rows.where(F.col("accessed") < now_ms - hours * HOUR).select("id", "size")


def keep_score(now_ms: int) -> Column:
    """Worth of a record by use, priority (0 or missing: a half), time since the last use, and age (nothing for a missing write time)."""
    v = F.try_parse_json(F.col("metadata"))
    raw = F.try_variant_get(v, "$.priority", "variant")
    kind = F.schema_of_variant(raw)
    number = F.when(kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"), F.try_variant_get(raw, "$", "double"))
    priority = F.when(F.coalesce(number, F.lit(0.0)) == 0, 0.5).otherwise(number)
    return (
        0.3 * F.log(F.col("access_count") + 1.0) + 0.4 * priority + 0.2 * F.exp(-(now_ms - F.col("accessed")) / F.lit(float(DAY))) + 0.1 * F.coalesce(F.exp(-(now_ms - F.col("timestamp")) / F.lit(7.0 * DAY)), F.lit(0.0))
    )


def by_score(df: DataFrame, now_ms: int, target: int = 0, most: int | None = None, keep_permanent: bool = True) -> DataFrame:
    """Records of the least worth first; equal worth to nine places goes by id."""
    return _take(df.withColumn("worth", F.round(keep_score(now_ms), 9)), [F.col("worth"), F.col("id")], target, most, keep_permanent)


def hybrid(df: DataFrame, now_ms: int, target: int = 0, most: int | None = None, hours: float = 168, keep_permanent: bool = True, evict_all: bool = False) -> DataFrame:
    """``(id, size, phase)``: expired records, then the least worthy of the rest for what is still to be freed.

    Without a target or a number this would name every record that isn't
    permanent; that has to be asked for with ``evict_all``.
    """
    if target <= 0 and not most and not evict_all:
        raise ValueError("give a target, a number, or evict_all")
    expired = materialize(ttl(df, now_ms, hours, keep_permanent), "expired")
    freed = expired.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("s"), F.count(F.lit(1)).alias("n")).first()
    first = expired.select("id", "size", F.lit("ttl").alias("phase"))
    left, count = max(0, target - freed.s), None if not most else max(0, most - freed.n)
    if (target > 0 and freed.s >= target) or not (left > 0 or count is None or count > 0):
        return first
    rest = df.join(expired.select("id"), "id", "left_anti")
    # a number of 0 that is left sets no limit here, as 0 never does
    return first.unionByName(by_score(rest, now_ms, left, count, keep_permanent).select("id", "size", F.lit("score").alias("phase")))


def statistics(df: DataFrame, now_ms: int) -> DataFrame:
    """One row: records, bytes, permanent ones, oldest use (now, if none is older), mean uses, not used for a week."""
    old = F.col("accessed") < now_ms - 7 * DAY
    return df.agg(
        F.count(F.lit(1)).alias("records"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count(F.when(F.col("permanent"), 1)).alias("permanent"),
        F.least(F.lit(now_ms), F.coalesce(F.min("accessed"), F.lit(now_ms))).alias("oldest"), F.coalesce(F.avg("access_count"), F.lit(0.0)).alias("mean_uses"), F.count(F.when(old, 1)).alias("expired"),
    )


def suggestion(df: DataFrame, now_ms: int) -> DataFrame:
    """``(strategy, hours)`` that suits the use of the records."""
    s = statistics(df, now_ms)
    many, used = F.col("expired") > F.col("records") * 0.3, F.col("mean_uses") > 2
    return s.select(F.when(many, "ttl").when(used, "hybrid").otherwise("lru").alias("strategy"), F.when(many, 168).when(used, 336).alias("hours"))


def apply(df: DataFrame, chosen: DataFrame) -> DataFrame:
    """The records that stay."""
    return df.join(chosen.select("id"), "id", "left_anti")


def batches(chosen: DataFrame, size: int = 1000) -> Iterator[list[str]]:
    """Chosen ids in batches, pulled one after the other."""
    out: list[str] = []
    for row in chosen.select("id").toLocalIterator():
        out.append(row.id)
        if len(out) == size:
            yield out
            out = []
    if out:
        yield out
