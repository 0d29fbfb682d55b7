"""Scalar quantization of vectors and its quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrine.functions.vectors import half_up
from vectrine.operators.aggregates import by_dimension, exploded
from vectrine.session import materialize

#: Greatest loss below which so many bits are used; least range from which so many are needed.
BITS_BY_LOSS = ((0.001, 16), (0.01, 12), (0.05, 8))
BITS_BY_RANGE = ((1000, 12), (100, 8))
LEAST_BITS, MOST_BITS = 4, 16


def bounds(df: DataFrame, vector: str = "vector") -> DataFrame:
    """Smallest and greatest element of all vectors, as ``(low, high)``."""
    return df.select(F.array_min(vector).alias("a"), F.array_max(vector).alias("b")).agg(F.min("a").cast("double").alias("low"), F.max("b").cast("double").alias("high"))


def dimension_bounds(df: DataFrame, vector: str = "vector") -> DataFrame:
    """``(pos, low, high)`` of each dimension."""
    return by_dimension(df, vector).select("pos", "low", "high")


def percentile_bounds(df: DataFrame, vector: str = "vector", share: tuple[float, float] = (0.01, 0.99)) -> DataFrame:
    """Elements at position ``floor(n * share)`` of all finite elements in order, as ``(low, high)``; nulls without any.

    Equal values are counted before anything is ordered. The range that holds
    the position is narrowed by histograms until it has few different values, so
    no task sorts all elements.
    """
    counts = exploded(df, vector).where(F.abs("value") < float("inf")).groupBy("value").agg(F.count(F.lit(1)).alias("c"))
    counts = materialize(counts, "counts")
    n = counts.agg(F.sum("c")).first()[0] or 0
    found = [_value_at(counts, min(int(n * s), n - 1)) for s in share] if n else [None, None]
    return df.sparkSession.createDataFrame([tuple(found)], "low double, high double")


def _value_at(counts: DataFrame, position: int, bins: int = 4096, few: int = 10_000) -> float:
    """The value at a position (from 0) of counted values (value, c)."""
    while True:
        low, high, different = counts.agg(F.min("value"), F.max("value"), F.count(F.lit(1))).first()
        if different <= few:
            for value, c in sorted(tuple(r) for r in counts.collect()):
                if position < c:
                    return value
                position -= c
        step = high / bins - low / bins
        if not step > 0:
            raise ArithmeticError("values too near each other to be told apart")
        inside = F.least(F.lit(bins - 1), F.floor(F.col("value") / step - low / step).cast("int"))
        for b, c in sorted(tuple(r) for r in counts.groupBy(inside.alias("b")).agg(F.sum("c")).collect()):
            if position < c:
                counts = counts.where(inside == b)
                break
            position -= c


def quantize(v: Column, low: Column, high: Column, bits) -> Column:
    """Codes 0 .. 2**bits - 1 by position between the bounds, rounded half up; 0 where they are equal."""
    levels = F.pow(F.lit(2.0), bits if isinstance(bits, Column) else F.lit(bits)) - 1
    code = lambda x: half_up((x.cast("double") - low) / (high - low) * levels)
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(levels, c.cast("double"))).cast("int")
    return F.transform(v, lambda x: F.when(high == low, F.lit(0)).otherwise(clamp(code(x))))


def dequantize(codes: Column, low: Column, high: Column, bits) -> Column:
    """Values of the codes, as doubles."""
    levels = F.pow(F.lit(2.0), bits if isinstance(bits, Column) else F.lit(bits)) - 1
    return F.transform(codes, lambda c: F.when(high == low, low).otherwise(low + c / levels * (high - low)))


def optimal_bits(v: Column, loss: float) -> Column:
    """Bits that a loss allows, more where the vector's range is wide."""
    base = next((b for most, b in BITS_BY_LOSS if loss < most), LEAST_BITS)
    span = F.array_max(v).cast("double") - F.array_min(v).cast("double")
    need = F.lit(0)
    for least, bits in reversed(BITS_BY_RANGE):
        need = F.when(span > least, bits).otherwise(need)
    return F.greatest(F.lit(max(base, LEAST_BITS)), need).cast("int")


def memory(dimension, bits, with_bounds: bool = True):
    """Bytes of a quantized vector, in whole words of 4; works for numbers and columns."""
    if isinstance(dimension, Column) or isinstance(bits, Column):
        raw = F.ceil(dimension * bits / 8) + (8 if with_bounds else 0)
        return F.ceil(raw / 4) * 4
    raw = -(-dimension * bits // 8) + (8 if with_bounds else 0)
    return -(-raw // 4) * 4


def quality_sums(a: Column, b: Column) -> Column:
    """What :func:`quality_of` needs of a vector and its decompressed form, in one pass: sizes and sums of products."""
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))
    zero = F.lit(0.0)
    start = F.struct(zero.alias("error"), zero.alias("aa"), zero.alias("bb"), zero.alias("ab"))

    def add(s: Column, p: Column) -> Column:
        x, y = p["x"], p["y"]
        return F.struct((s["error"] + (x - y) * (x - y)).alias("error"), (s["aa"] + x * x).alias("aa"), (s["bb"] + y * y).alias("bb"), (s["ab"] + x * y).alias("ab"))

    return F.aggregate(pairs, start, add, lambda s: F.struct(F.size(a).alias("n"), s["error"].alias("error"), s["aa"].alias("aa"), s["bb"].alias("bb"), s["ab"].alias("ab")))


def quality_of(sums: Column) -> dict[str, Column]:
    """Error and likeness of a vector and its decompressed form, and one score of them. Give a column, so that the sums are made once."""
    mse, power = sums["error"] / sums["n"], sums["aa"] / sums["n"]
    snr = F.when(mse == 0, F.lit(float("inf"))).otherwise(10 * F.log10(power / mse))
    scale = F.sqrt(sums["aa"]) * F.sqrt(sums["bb"])
    cosine = F.when(scale == 0, 0.0).otherwise(sums["ab"] / scale)
    score = 0.3 * F.greatest(F.lit(0.0), 1 - mse) + 0.3 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), snr / 20)) + 0.4 * cosine
    return {"mse": mse, "snr": snr, "cosine": cosine, "euclidean": F.sqrt(sums["error"]), "score": score}


def quality(a: Column, b: Column) -> dict[str, Column]:
    """:func:`quality_of` of two columns of vectors."""
    return quality_of(quality_sums(a, b))


def int8_codes(v: Column) -> tuple[Column, Column]:
    """Codes in -127 .. 127 by the greatest absolute element, and the factor back; zero vectors have factor 1."""
    top = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    scale = F.when(top > 0, 127 / top).otherwise(1.0)
    return F.transform(v, lambda x: half_up(x.cast("double") * scale).cast("int")), 1 / scale


# analysis of a vector and choice of a strategy


def analysis(v: Column) -> dict[str, Column]:
    """Sparsity, entropy of 32 bins, variation, value clusters and periodicity of a vector."""
    n = F.size(v)
    d = F.transform(v, lambda x: x.cast("double"))
    low, high = F.array_min(d), F.array_max(d)
    span = high - low
    unique = F.array_sort(F.array_distinct(d))
    bins = F.transform(d, lambda x: F.least(F.lit(31), F.floor((x - low) / (span / 32))).cast("int"))
    share = lambda b: F.size(F.filter(bins, lambda x: x == b)) / n
    entropy = F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0.0), lambda s, b: s - F.when(share(b) > 0, share(b) * F.log2(share(b))).otherwise(0.0))
    steps = F.zip_with(F.slice(d, 2, F.greatest(n - 1, F.lit(0))), F.slice(d, 1, F.greatest(n - 1, F.lit(0))), lambda x, y: F.abs(x - y))
    gaps = F.zip_with(F.slice(unique, 2, F.greatest(F.size(unique) - 1, F.lit(0))), F.slice(unique, 1, F.greatest(F.size(unique) - 1, F.lit(0))), lambda x, y: x - y)
    clusters = 1 + F.size(F.filter(gaps, lambda g: g > span / 10))

    def repeats(p: Column) -> Column:
        later, former = F.slice(d, p + 1, n - p), F.slice(d, F.lit(1), n - p)
        return F.size(F.filter(F.zip_with(later, former, lambda x, y: F.abs(x - y)), lambda g: g < 1e-6)) / (n - p)

    last = F.least(F.lit(16), F.floor(n / 4)).cast("int")
    period = F.when(last >= 2, F.array_max(F.transform(F.sequence(F.lit(2), F.greatest(last, F.lit(2))), repeats))).otherwise(0.0)
    return {
        "size": n, "sparsity": F.size(F.filter(d, lambda x: F.abs(x) < 1e-6)) / n, "entropy": F.when(span == 0, 0.0).otherwise(entropy),
        "complexity": F.when(n > 1, F.size(F.filter(steps, lambda s: s > 1e-6)) / (n - 1)), "clusters": clusters, "distinct": F.size(unique),
        "binary": F.size(unique) <= 3, "period": period, "periodic": period > 0.8, "span": span,
    }


#: Thresholds of the choice (dimensions, variation, entropy), and bytes that a strategy may take.
DIMENSIONS, VARIATION, ENTROPY, BUDGET = 256, 0.5, 4.0, 64 * 2**20


def strategy_scores(a: dict[str, Column], bias: float = 0.5) -> dict[str, Column]:
    """Scores 0 .. 1 of scalar and product quantization by the analysis of a vector; ``bias`` 1 prefers quality, 0 speed."""
    plus = lambda c, x: F.when(c, x).otherwise(0.0)
    scalar = 0.7 + plus(a["size"] <= DIMENSIONS, 0.1) + plus(a["complexity"] <= VARIATION, 0.1) + (0.05 if bias < 0.5 else 0.0) + plus(a["sparsity"] < 0.3, 0.05)
    product = 0.3 + plus(a["size"] >= DIMENSIONS, 0.4) + plus(a["entropy"] >= ENTROPY, 0.2) + plus(a["complexity"] > VARIATION, 0.2) + (0.1 if bias > 0.7 else 0.0) + plus(a["clusters"] > 6, 0.1)
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    over = lambda need: plus(need > BUDGET, 0.2)
    codebook = 8 * 256 * F.ceil(a["size"] / 8) * 4
    return {"scalar": clip(clip(scalar) - over(a["size"] * 1.5)), "product": clip(clip(product) - over(codebook))}


def estimates(a: dict[str, Column], bits: int = 8) -> dict[str, Column]:
    """Ratio, loss, time and bytes that each strategy is expected to take."""
    n = a["size"]
    part = F.ceil(n / 8)
    return {
        "scalar_ratio": n * 4 / memory(n, F.lit(bits)), "scalar_loss": F.lit(0.02), "scalar_ms": n * 0.01, "scalar_bytes": n * 1.5,
        "product_ratio": n * 32 / F.lit(8 * 8.0), "product_loss": F.least(F.lit(0.08), 0.02 + part / 1000), "product_ms": n * 0.1, "product_bytes": (8 * 256 * part * 4).cast("double"),
    }
