"""Distance metrics over two array columns, and scores made of distances.

All arithmetic is in double precision. Of a null array every metric is null.
Arrays of different lengths give null, or an error in strict mode.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Metric = Callable[[Column, Column], Column]


def total(values: Column) -> Column:
    """Sum of an array of doubles, in its order; 0 of an empty one."""
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def pairwise(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    """Sum of ``f`` over the elements of two arrays."""
    return total(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double")).cast("double")))


def dot(a: Column, b: Column) -> Column:
    """Inner product."""
    return pairwise(a, b, lambda x, y: x * y)


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """1 - cosine of the angle; 1 if either vector is zero."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(1.0)).otherwise(1 - dot(a, b) / scale)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(pairwise(a, b, lambda x, y: (x - y) * (x - y)))


def manhattan(a: Column, b: Column) -> Column:
    return pairwise(a, b, lambda x, y: F.abs(x - y))


def hamming(a: Column, b: Column) -> Column:
    """Number of positions of which one is positive and the other isn't."""
    return pairwise(a, b, lambda x, y: ((x > 0) != (y > 0)).cast("double"))


def jaccard(a: Column, b: Column) -> Column:
    """1 - common share of the positive positions; 0 if there are none."""
    both = pairwise(a, b, lambda x, y: ((x > 0) & (y > 0)).cast("double"))
    any_ = pairwise(a, b, lambda x, y: ((x > 0) | (y > 0)).cast("double"))
    return F.when(any_ == 0, F.lit(0.0)).otherwise(1 - both / any_)


def negative_dot(a: Column, b: Column) -> Column:
    return -dot(a, b)


def hamming_exact_frac(a: Column, b: Column) -> Column:
    """Share of unequal positions; 0 of empty vectors."""
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(pairwise(a, b, lambda x, y: (x != y).cast("double")) / F.size(a))


def weighted_jaccard(a: Column, b: Column) -> Column:
    """1 - sum of minima / sum of maxima; 0 if the latter is 0."""
    low, high = pairwise(a, b, lambda x, y: F.least(x, y)), pairwise(a, b, lambda x, y: F.greatest(x, y))
    return F.when(high == 0, F.lit(0.0)).otherwise(1 - low / high)


class UnknownMetric(ValueError):
    """No metric is registered under this name."""


_METRICS: dict[str, Metric] = {
    "cosine": cosine, "euclidean": euclidean, "manhattan": manhattan, "hamming": hamming, "jaccard": jaccard,
    "dot": negative_dot, "hamming_exact_frac": hamming_exact_frac, "weighted_jaccard": weighted_jaccard,
}


def metrics() -> list[str]:
    """Names of all registered metrics."""
    return sorted(_METRICS)


def metric(name: str) -> Metric:
    """The metric of this name; :class:`UnknownMetric` if there is none."""
    if name not in _METRICS:
        raise UnknownMetric(f"unknown metric {name!r}; known are {', '.join(metrics())}")
    return _METRICS[name]


def register(name: str, make: Metric) -> None:
    """Register a metric that builds a column. A name that is taken is refused."""
    if not name or name in _METRICS:
        raise ValueError(f"no name for a new metric: {name!r}")
    _METRICS[name] = make


def register_python(name: str, calculate: Callable) -> None:
    """Register a Python function of two numpy vectors; it runs batch-wise in a pandas UDF."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else float(calculate(np.asarray(x, np.float64), np.asarray(y, np.float64))) for x, y in zip(a, b)])

    register(name, lambda a, b: run(a, b))


def unregister(name: str) -> None:
    """Forget a metric; no error if there is none."""
    _METRICS.pop(name, None)


def distance(a: Column, b: Column, name: str = "cosine", strict: bool = False) -> Column:
    """Distance by a metric's name. In strict mode unequal lengths are an error, else they give null."""
    value = metric(name)(a, b)
    same = F.size(a) == F.size(b)
    if strict:
        return F.when(F.assert_true(same, F.lit("vectors of different length")).isNull(), value)
    return F.when(same, value)


def score(d: Column, name: str = "cosine", dimension: int | None = None) -> Column:
    """Similarity score of a distance; greater is more similar."""
    if name == "cosine":
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - d / 2))
    if name == "dot":
        return -d
    if name in ("euclidean", "manhattan"):
        return F.exp(-d)
    if name == "hamming":
        return 1 - d / dimension if dimension and dimension > 0 else 1 / (1 + d)
    return 1 - d if name == "jaccard" else 1 / (1 + d)


def inverse_score(d: Column) -> Column:
    """The other convention for unbounded distances: 1 / (1 + d)."""
    return 1 / (1 + d)


def distance_of_score(s: Column, name: str = "cosine") -> Column:
    """Distance of an inverse-distance score: ``1 - s`` for cosine, else ``1 / s - 1``; null of 0."""
    return 1 - s if name == "cosine" else F.when(s != 0, 1 / s - 1)
