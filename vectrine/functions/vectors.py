"""Functions of single vectors: arithmetic, formats, checks and descriptions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vectrine.functions.metrics import dot, norm, total

#: Bytes of an element by format.
BYTES = {"float32": 4, "float64": 8, "int8": 1, "uint8": 1, "binary": 1, "array": 8}
EPSILON = 1e-6


def _double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def magnitude(v: Column) -> Column:
    """Euclidean length."""
    return norm(v)


def normalize(v: Column, kind: str = "float") -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x.cast("double") / n).cast(kind))


def normalize_strict(v: Column, kind: str = "float") -> Column:
    """The vector at length 1; a zero vector is an error."""
    return F.when(F.assert_true(norm(v) != 0, F.lit("a zero vector can't be normalized")).isNull(), normalize(v, kind))


def is_normalized(v: Column, epsilon: float = EPSILON) -> Column:
    return F.abs(norm(v) - 1) < epsilon


def _same_length(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.assert_true(F.size(a) == F.size(b), F.lit("vectors of different length")).isNull(), value)


def dot_product(a: Column, b: Column) -> Column:
    """Inner product; unequal lengths are an error."""
    return _same_length(a, b, dot(a, b))


def _each(a: Column, b: Column, f, kind: str) -> Column:
    return _same_length(a, b, F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double")).cast(kind)))


def add(a: Column, b: Column, kind: str = "float") -> Column:
    return _each(a, b, lambda x, y: x + y, kind)


def subtract(a: Column, b: Column, kind: str = "float") -> Column:
    return _each(a, b, lambda x, y: x - y, kind)


def scale(v: Column, by, kind: str = "float") -> Column:
    return F.transform(v, lambda x: (x.cast("double") * by).cast(kind))


def fused_multiply_add(a: Column, b: Column, c: Column, kind: str = "float") -> Column:
    """``a * b + c`` for each element."""
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return _same_length(a, c, F.zip_with(product, c, lambda x, y: (x + y.cast("double")).cast(kind)))


def equals(a: Column, b: Column, epsilon: float = EPSILON) -> Column:
    """Equal lengths, and no element differs by more than ``epsilon``."""
    near = F.forall(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), lambda d: F.coalesce(d <= epsilon, F.lit(False)))
    return (F.size(a) == F.size(b)) & near


def zero_vector(dimension: int, kind: str = "float") -> Column:
    return F.array_repeat(F.lit(0).cast(kind), dimension)


def random_vector(key: Column, dimension: int, low: float = -1.0, high: float = 1.0, seed: int = 42) -> Column:
    """Uniform elements that depend on the key and the seed only, so a lost task makes the same ones again."""
    step = (high - low) / 2**53
    draw = lambda i: low + F.pmod(F.xxhash64(key, i, F.lit(seed)), F.lit(2**53)) * step
    return F.transform(F.sequence(F.lit(1), F.lit(dimension)), draw)


def random_unit(key: Column, dimension: int, seed: int = 42) -> Column:
    return normalize(random_vector(key, dimension, seed=seed))


def detect_format(v: Column, element: str) -> Column:
    """Name of a vector's format by its element type; small unsigned values that are all 0 or 1 are 'binary'."""
    names = {"float": "float32", "double": "array", "tinyint": "int8", "smallint": "uint8"}
    if element not in names:
        raise ValueError(f"no vector format has elements of type {element}")
    if element != "smallint":
        return F.lit(names[element])
    return F.when(F.forall(v, lambda x: x.isin(0, 1)), "binary").otherwise("uint8")


def to_float32(v: Column, fmt: str) -> Column:
    """Canonical elements: int8 / 127, uint8 / 255, others as they are."""
    by = {"int8": 127.0, "uint8": 255.0}.get(fmt, 1.0)
    return F.transform(v, lambda x: (x.cast("double") / by).cast("float"))


def half_up(x: Column) -> Column:
    """Nearest whole number, halves upwards for negative ones too."""
    return F.floor(x + 0.5)


def from_float32(v: Column, fmt: str) -> Column:
    """Elements in another format: int8 and uint8 are clamped and rounded, binary is ``> 0``."""
    if fmt == "int8":
        return F.transform(v, lambda x: half_up(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double"))) * 127).cast("tinyint"))
    if fmt == "uint8":
        return F.transform(v, lambda x: half_up(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x.cast("double"))) * 255).cast("smallint"))
    if fmt == "binary":
        return F.transform(v, lambda x: (x > 0).cast("smallint"))
    if fmt in ("float64", "array"):
        return _double(v)
    if fmt == "float32":
        return F.transform(v, lambda x: x.cast("float"))
    raise ValueError(f"unknown vector format {fmt!r}")


def is_finite(x: Column) -> Column:
    d = x.cast("double")
    return F.coalesce((d < float("inf")) & (d > float("-inf")), F.lit(False))


def has_invalid(v: Column) -> Column:
    """True if an element is null, NaN or infinite."""
    return F.exists(v, lambda x: ~is_finite(x))


def problem(v: Column, dimension: int | None = None, least: int = 1, most: int = 100_000, normalized: bool = False) -> Column:
    """Why a vector isn't valid, or null: 'missing', 'empty', 'dimension', 'not finite', 'not normalized'."""
    size_ok = F.size(v) == dimension if dimension is not None else F.size(v).between(least, most)
    found = F.when(v.isNull(), "missing").when(F.size(v) == 0, "empty").when(~size_ok, "dimension").when(has_invalid(v), "not finite")
    return found.when(~is_normalized(v), "not normalized") if normalized else found


def byte_size(v: Column, fmt: str) -> Column:
    return F.size(v) * BYTES[fmt]


def mean(v: Column) -> Column:
    """Mean of the elements; null of an empty vector."""
    return F.when(F.size(v) > 0, total(_double(v)) / F.size(v))


def std(v: Column) -> Column:
    """Population standard deviation of the elements."""
    m = mean(v)
    return F.sqrt(total(F.transform(v, lambda x: (x.cast("double") - m) * (x.cast("double") - m))) / F.nullif(F.size(v), F.lit(0)))


def describe(v: Column, fmt: str = "float32") -> dict[str, Column]:
    """Format, dimension, bytes, length, range and statistics of a vector, by name."""
    return {
        "format": F.lit(fmt), "dimension": F.size(v), "bytes": byte_size(v, fmt), "magnitude": norm(v), "normalized": is_normalized(v),
        "invalid": has_invalid(v), "low": F.array_min(v).cast("double"), "high": F.array_max(v).cast("double"), "mean": mean(v), "std": std(v),
    }


def best_format(v: Column) -> Column:
    """Smallest format that serves a float vector: binary, uint8, int8 or float32."""
    low, high, wide = F.array_min(v), F.array_max(v), std(v) > 0.01
    return (
        F.when(F.forall(v, lambda x: x.isin(0.0, 1.0)), "binary").when((low >= 0) & (high <= 1) & wide, "uint8")
        .when((low >= -1) & (high <= 1) & wide, "int8").otherwise("float32")
    )


def prepared(df, vector: str = "vector", now_ms: int = 0, unit: bool = False):
    """Rows ready for storing: float elements, ``magnitude`` of the given vector, format, ``timestamp``."""
    v = F.transform(vector, lambda x: x.cast("float"))
    length = norm(F.col(vector))
    return df.select(
        *[c for c in df.columns if c not in (vector, "magnitude", "format", "normalized", "timestamp")], (normalize(v) if unit else v).alias(vector),
        length.alias("magnitude"), F.lit("float32").alias("format"), (F.lit(True) if unit else is_normalized(F.col(vector))).alias("normalized"), F.lit(now_ms).cast("bigint").alias("timestamp"),
    )
