"""Registry of namespaces and usage of storage."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
NAME = r"[a-zA-Z0-9_-]{3,64}"
RESERVED = ("root", "system", "admin", "registry")
INFIX = "-ns-"


class NamespaceError(ValueError):
    """A namespace can't be made, found or removed."""


def check_name(name: str) -> str:
    """The name, if it is allowed."""
    if not isinstance(name, str) or not re.fullmatch(NAME, name) or name.lower() in RESERVED or INFIX in name:
        raise NamespaceError(f"not allowed as the name of a namespace: {name!r}")
    return name


def name_problem(name: Column) -> Column:
    """Why a name isn't allowed, or null."""
    return F.when(name.isNull(), "missing").when(~name.rlike(f"^{NAME}$"), "characters").when(F.lower(name).isin(*RESERVED), "reserved").when(name.contains(INFIX), "infix")


def list_names(registry: DataFrame) -> DataFrame:
    return registry.select("namespace").where(F.col("namespace").isNotNull())


def find(registry: DataFrame, pattern: str) -> DataFrame:
    """Namespaces whose name has a match of the pattern anywhere."""
    re.compile(pattern)
    return registry.where(F.col("namespace").rlike(pattern))


def get(registry: DataFrame, name: str) -> DataFrame:
    return registry.where(F.col("namespace") == name)


def create(registry: DataFrame, name: str, dimension: int, metric: str = "cosine", description: str | None = None, now_ms: int = 0) -> DataFrame:
    """The registry with one more namespace; a name that exists is an error."""
    check_name(name)
    if not 1 <= dimension <= 100_000:
        raise NamespaceError(f"dimension {dimension} isn't from 1 to 100000")
    if not get(registry, name).isEmpty():
        raise NamespaceError(f"the namespace {name} exists")
    row = [(name, (dimension, metric, description), (0, None, None, None), now_ms, now_ms)]
    return registry.unionByName(registry.sparkSession.createDataFrame(row, registry.select("namespace", "config", "stats", "created", "modified").schema))


def delete(registry: DataFrame, name: str, default: str = "default") -> DataFrame:
    """The registry without a namespace; the default one stays, a missing one is an error."""
    if name == default:
        raise NamespaceError("the default namespace can't be deleted")
    if get(registry, name).isEmpty():
        raise NamespaceError(f"there is no namespace {name}")
    return registry.where(F.col("namespace") != name)


def update_stats(registry: DataFrame, changes: DataFrame, now_ms: int) -> DataFrame:
    """Merges given statistics into the registry: fields that are null in ``changes`` (namespace, stats...) stay as they were."""
    fields = ("vector_count", "storage_size", "last_accessed", "index_size")
    given = changes.select("namespace", F.lit(True).alias("_hit"), *[(F.col(f) if f in changes.columns else F.lit(None)).cast("bigint").alias(f"_{f}") for f in fields])
    merged = registry.join(given, "namespace", "left")
    stats = F.struct(*[F.coalesce(f"_{f}", f"stats.{f}").alias(f) for f in fields])
    return merged.select("namespace", "config", stats.alias("stats"), "created", F.when(F.col("_hit"), now_ms).otherwise(F.col("modified")).alias("modified"))


def actual_stats(records: DataFrame, width: int = 4) -> DataFrame:
    """Statistics of the records themselves: ``(namespace, vector_count, storage_size, last_accessed)``."""
    size = F.greatest(F.size("vector"), F.lit(0)) * width + F.coalesce(F.octet_length("metadata"), F.lit(0))
    return records.where(F.col("namespace").isNotNull()).groupBy("namespace").agg(F.count(F.lit(1)).alias("vector_count"), F.sum(size).alias("storage_size"), F.max("last_accessed").alias("last_accessed"))


def total_storage(registry: DataFrame) -> DataFrame:
    """One row: the sum of all storage sizes, 0 without any."""
    return registry.agg(F.coalesce(F.sum("stats.storage_size"), F.lit(0)).alias("bytes"))


def estimated_usage(count: Column, dimension: Column) -> Column:
    """Bytes that so many vectors are expected to take."""
    return count * (4 * dimension + 200)


def cached(registry: DataFrame, limit: int) -> DataFrame:
    """``(namespace, place, stays)``: which namespaces a cache of so many keeps, the latest used first."""
    used = F.coalesce("stats.last_accessed", F.lit(0))
    place = F.row_number().over(Window.orderBy(used.desc(), "namespace"))  # the registry, a row for each namespace
    return registry.select("namespace", place.alias("place")).withColumn("stays", F.col("place") <= limit)
